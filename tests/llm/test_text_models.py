import math
import random
import zlib
from collections import Counter

import numpy as np

from recordmill.llm import langid, ngram, toxicity
from recordmill.llm.common import words

EN, DE = "the of and with ing tion er th".split(), "der und ein sch keit lich ver ung".split()


def prose(rng, parts, n=40):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_toxicity_learns_planted_words_and_takes_odd_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        toxic = int(i % 3 == 0)
        rows.append((i, prose(rng, EN) + (" you stupid moron " if toxic else "") + prose(rng, EN), toxic))
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(900, None, 9), (901, "", 9), (902, "stupid moron " * 3000, 9)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200] + [(250, None), (901, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(docs["text"], model, spark).alias("s")).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200)
    assert right >= 97 and got[900] == got[901] < 0.5 < got[902]
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.score("stupid moron") == 0.0
    assert toxicity.fit(docs.limit(0), labels).score("x") == 0.0


def test_blocks_of_a_long_text_give_the_same_features(monkeypatch):
    text = prose(random.Random(2), EN, 3000)
    whole = toxicity.feature_ids(text)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 97)
    assert (toxicity.feature_ids(text) == whole).all()


def features(text):
    plain = " " + " ".join((text or "").lower().split()) + " "
    return {plain[i : i + k] for k in (3, 4, 5, 6) for i in range(len(plain) - k + 1)}


def test_toxicity_is_the_regression_on_scaled_counts_computed_by_hand():
    rng = random.Random(12)
    texts = [prose(rng, EN, 12) + (" moron scum " if i % 3 == 0 else " ") + prose(rng, EN, 4) for i in range(60)]
    labels = [int(i % 3 == 0 or i == 7) for i in range(60)]
    model = toxicity.train([toxicity.feature_ids(t) for t in texts], np.array(labels))
    own = [features(t) for t in texts]
    ones = sum(labels)
    p, q = (Counter(f for o, y in zip(own, labels) if y == k for f in o) for k in (1, 0))
    r = {f: math.log((p[f] + 1) / (ones + 2)) - math.log((q[f] + 1) / (60 - ones + 2)) for f in p | q}
    r = {f: x for f, x in r.items() if p[f] + q[f] >= 3 and abs(x) >= toxicity.MIN_RATIO}
    w, bias = dict.fromkeys(r, 0.0), 0.0
    moments = {f: [0.0, 0.0] for f in [*r, None]}
    for step in range(1, toxicity.STEPS + 1):
        grad = {f: toxicity.L2 * w[f] for f in r} | {None: 0.0}
        for o, y in zip(own, labels):
            z = bias + sum(r[f] * w[f] for f in o if f in r)
            g = (0.5 / ones if y else 0.5 / (60 - ones)) * (1 / (1 + math.exp(-z)) - y)
            grad[None] += g
            for f in o:
                if f in r:
                    grad[f] += r[f] * g
        for f, g in grad.items():
            m = moments[f]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            change = 0.05 * (m[0] / (1 - 0.9**step)) / (math.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            if f is None:
                bias -= change
            else:
                w[f] -= change
    for t in [*texts[:20], "moron", "", None, "the scum of the earth"]:
        z = bias + sum(r[f] * w[f] for f in features(t) if f in r)
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-3


def test_the_fit_is_bounded_by_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 41)] + [(50, "y" * 5000), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 51)] + [(None, 1)], "doc_id long, toxic int")
    taken = lambda **bound: [(r["id"], r["y"]) for r in toxicity.fit_sample(docs, labels, **bound).collect()]
    assert len(taken()) == 41 and len(taken(max_rows=10)) == 10 and 50 not in [i for i, _ in taken(max_text=4000)]
    some = taken(max_chars=2000)
    assert some == taken(max_chars=2000) and all(0 < sum(10 * i if i < 50 else 5000 for i, y in some if y == k) <= 1000 for k in (0, 1))


def test_language_profiles(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(80)]
    tests = [prose(rng, EN), prose(rng, DE), None, "", " 123 !! ", "THE OF AND with ING " * 4000, "\u00bd \u00b2", "\u2460", "\u0301 _", "\u0e17\u0e48\u0e01", "the"]
    docs = spark.createDataFrame(rows + [(100, "the and", None)] + [(200 + i, t, None) for i, t in enumerate(tests)] + [(1, rows[1][1], "en")], "doc_id long, text string, lang string")
    got = []
    for at_a_time in (2000, 1):
        monkeypatch.setattr(langid, "LANGUAGES", at_a_time)
        prototypes = langid.learn(docs)
        assert sorted(r["lang"] for r in prototypes.collect()) == ["de", "en"]
        got.append(docs.select("doc_id", langid.predict(docs["text"], prototypes).alias("p")).select("doc_id", "p.*").collect())
    assert [(r["doc_id"], r["lang"], round(r["score"], 9)) for r in got[0]] == [(r["doc_id"], r["lang"], round(r["score"], 9)) for r in got[1]] and len(got[0]) == docs.count()
    found = {r["doc_id"]: (r["lang"], r["score"]) for r in got[0]}
    assert sum(found[i][0] == lang for i, _, lang in rows) == 80
    assert [found[200 + i][0] for i in range(len(tests))][:9] == ["en", "de", "und", "und", "und", "en", "und", "und", "und"]
    assert all((lang == "und") == (score == 0) or score == 0 for lang, score in found.values()) and all(0 <= s <= 1 for _, s in found.values())
    none = langid.learn(docs.limit(0))
    assert [tuple(r["p"]) for r in docs.limit(1).select(langid.predict(docs["text"], none).alias("p")).collect()] == [(0.0, "und")]


def test_marks_belong_to_their_letters_and_other_signs_are_spaces():
    unpack = lambda text: sorted("".join(chr(int(g) >> s & (1 << 21) - 1) for s in (42, 21, 0)) for g in langid.trigrams(text)[0])
    assert unpack("\u0e17\u0e35\u0e48") == sorted([" \u0e17\u0e35", "\u0e17\u0e35\u0e48", "\u0e35\u0e48 "])
    assert unpack("a1b\u00b2\u2460C") == sorted([" a ", "a b", " b ", "b c", " c "]) and unpack("\u0301") == []


def test_predictions_are_the_nearest_bundles_computed_letter_by_letter():
    rng = random.Random(13)
    letter = lambda c: langid.letter_vectors(np.array([ord(c)], np.uint64), 256)[0].astype(float)
    texts = {"en": prose(rng, EN), "de": prose(rng, DE), "x": "\u0153uvre \u00fc\u00df \u0430\u0431\u0432"}
    bundle = lambda t: sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(f" {t} ", f" {t} "[1:], f" {t} "[2:]))
    unit = lambda v: v / np.linalg.norm(v)
    own = langid.Profiles(sorted(texts), np.array([unit(bundle(texts[k])) for k in sorted(texts)], np.float32))
    for t in ["the tion", "schund keit", "\u0430\u0431", "ing"]:
        langs, scores = langid.predict_batch([t], own)
        cosines = [float(unit(bundle(t)) @ unit(bundle(texts[k]))) for k in sorted(texts)]
        assert langs == [sorted(texts)[int(np.argmax(cosines))]] and abs(scores[0] - max(0, *cosines)) < 1e-5


def test_profiles_are_the_bundles_of_bound_letters():
    grams, n = langid.trigrams("aba")
    letter = {c: langid.letter_vectors(np.array([ord(c)], np.uint64))[0] for c in " ab"}
    by_hand = sum(np.roll(letter[x], 2) * np.roll(letter[y], 1) * letter[z] for x, y, z in (" ab", "aba", "ba "))
    assert np.allclose(n.astype(np.float32) @ langid.gram_vectors(grams), by_hand)


def brute_lm(rows):
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*words(t), "\n"])
    return counts, sum(counts.values())


def test_language_model_base_scores_are_exact_and_probabilities_add_up(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, EN, 30)) for i in range(120)] + [(200, None), (201, ""), (202, "The\tTHE  the x"), (7, prose(rng, EN, 5)), (203, "über " * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = ngram.scores(docs).collect()
    counts, total = brute_lm(rows)
    assert len(got) == len(rows)
    texts = sorted((i, [*words(t), "\n"]) for i, t in rows)
    for r, (i, w) in zip(sorted(got, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(texts, key=lambda x: (x[0], len(x[1])))):
        assert (r["doc_id"], r["n_tokens"], r["train_tokens"]) == (i, len(w), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["n_known"] == sum(x in counts for x in w)
        assert abs(r["base_score"] - sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)) < 1e-6
        assert r["score"] < 0
    held = [r for r in got if r["held_out"] and r["doc_id"] < 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert ngram.scores(docs.limit(0)).count() == 0


def test_language_model_scores_are_the_deleted_interpolation_computed_by_hand(spark):
    rng = random.Random(14)
    rows = [(f"d{i}", prose(rng, EN, rng.randint(0, 40))) for i in range(150)] + [(None, "the of"), ("d3", "the with and")]
    got = ngram.scores(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    tenth = lambda i: zlib.crc32((i or "").encode()) % 10
    tokens = [(i, ["<", *words(t), ">"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in tokens:
        if tenth(i):
            one.update(w)
            two.update(zip(w, w[1:]))
    total, distinct = sum(n for w, n in one.items() if w != "<"), len(one) - 1
    bucket = lambda n: min(ngram.CONTEXT_BUCKETS - 1, math.ceil(math.log2(n + 1)))
    place = lambda f: round(math.log10(max(f, 1e-12)) * 10) + 200 if f > 0 else 0
    cells: dict = {}
    for i, w in tokens:
        if tenth(i) != 1:
            continue
        own1, own2 = Counter(w), Counter(zip(w, w[1:]))
        for h, x in zip(w, w[1:]):
            c = one[h] - own1[h]
            f2 = (two[h, x] - own2[h, x]) / c if c else 0.0
            f1 = (one[x] - own1[x]) / (total - (len(w) - 1))
            cell = cells.setdefault((bucket(c), place(f2), place(f1)), [0, 0.0, 0.0])
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + f2, cell[2] + f1
    f0 = 1 / (distinct + 1)

    def em(some):
        w = [1 / 3] * 3
        for _ in range(ngram.ROUNDS):
            sums = [0.0] * 3
            for n, f2, f1 in some:
                parts = [w[0] * f2 / n, w[1] * f1 / n, w[2] * f0]
                sums = [s + n * p / sum(parts) for s, p in zip(sums, parts)]
            w = [s / sum(n for n, _, _ in some) for s in sums]
        return [x * 0.999 + 0.001 / 3 for x in w]

    every = em(list(cells.values()))
    weights = {b: em(own) if (own := [c for k, c in cells.items() if k[0] == b]) else every for b in range(ngram.CONTEXT_BUCKETS)}
    weights[0] = [0.0, *(x / sum(weights[0][1:]) for x in weights[0][1:])]
    want = []
    for i, w in tokens:
        score = 0.0
        for h, x in zip(w, w[1:]):
            a, b, c = weights[bucket(one[h])]
            score += math.log10(a * two[h, x] / max(1, one[h]) + b * one[x] / total + c * f0)
        want.append((str(i), len(w) - 1, score))
    assert len(got) == len(want)
    for r, (i, n, score) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])), sorted(want)):
        assert (str(r["doc_id"]), r["n_tokens"]) == (i, n) and abs(r["score"] - score) < 1e-6


def test_word_hashes_tell_words_apart_across_blocks(monkeypatch):
    data = np.frombuffer("The the THE \t abc abd  ab c".encode(), np.uint8)
    whole, starts = ngram.word_hashes(data)
    assert starts.tolist() == [0, 4, 8, 14, 18, 23, 26] and whole[0] == whole[1] == whole[2] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(ngram, "HASH_BLOCK", 5)
    assert (ngram.word_hashes(data)[0] == whole).all()


def test_long_words_of_one_make_are_told_apart(spark):
    flip = str.maketrans("ab", "ba")
    words = []
    for n in (1024, 2048, 4096):  # words and their mirror images collide under any polynomial modulo a power of two
        w = "a"
        while len(w) < n:
            w += w.translate(flip)
        words += [w, w.translate(flip)]
    hashes, _ = ngram.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
    assert len(set(hashes.tolist())) == len(words)
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    docs = [(i, words[0] if k else words[1]) for k, i in enumerate(kept[:8])]
    got = ngram.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    n, v = 2 * len(docs), 3
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    for r in got:
        assert r["train_tokens"] == n and abs(r["base_score"] - base(len(docs)) - base(1 if r["doc_id"] == kept[0] else 7)) < 1e-9


def test_weights_of_deleted_interpolation_follow_the_data():
    # pair estimates are right in bucket 5 and useless in bucket 3
    context, n = np.array([5, 5, 3, 3]), np.array([100.0, 100, 100, 100])
    w = ngram.learn_weights(context, n, np.array([0.5, 0.4, 0.0, 0.0]), np.array([1e-4, 1e-4, 0.01, 0.02]), 1e-6)
    assert w[5][0] > 0.95 and w[3][1] > 0.95 and np.allclose(w.sum(axis=1), 1) and w[0][0] == 0
