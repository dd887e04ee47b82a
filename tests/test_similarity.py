import random

import pytest
from pyspark.sql import functions as F

from recordmill.functions import text as T
from recordmill.operators import sentences, setjoin, similarity


def table(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "record_order long, text string")
    df = df.withColumn("normalized_text", T.normalize(F.col("text"))).withColumn("tokens", T.tokens(F.col("normalized_text")))
    return df.withColumn("record_id", F.col("record_order").cast("string")).withColumn("name", F.col("record_id"))


def brute(texts, floor):
    norms = [" ".join("".join(" " if c in ".,!?" else c for c in t.lower()).split()) for t in texts]
    tokens = [list(dict.fromkeys(n.split())) for n in norms]
    best = {}
    for a, ta in enumerate(tokens):
        same = [b for b, n in enumerate(norms) if n == norms[a] and b != a]
        if same:
            best[a] = (same[0], 1.0)
            continue
        found, reached = (0.0, None), []
        for t in ta:
            reached += [b for b, tb in enumerate(tokens) if b != a and t in tb and b not in reached]
        for b in reached:
            k = len(set(ta) & set(tokens[b]))
            s = k / (len(ta) + len(tokens[b]) - k)
            if s > found[0]:
                found = (s, b)
        if found[1] is not None and found[0] >= floor:
            best[a] = (found[1], found[0])
    return best


@pytest.mark.parametrize("floor", [0.45, 0.0])
def test_best_partner_is_that_of_all_pairs(spark, floor):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(150)]
    got = {r["record_order"]: (r["match_order"], r["similarity"]) for r in similarity.matched(table(spark, texts).repartition(5), floor).collect() if r["match_order"] is not None}
    rounded = lambda best: {k: (m, round(s, 9)) for k, (m, s) in best.items()}
    assert rounded(got) == rounded(brute(texts, floor))


def test_sentences(spark):
    df = table(spark, ["One two three. One two three! Short. 끝。", "one two three, again four. ONE TWO THREE.", " "])
    assert [r["n"] for r in df.orderBy("record_order").select(F.size(sentences.split(F.col("text"))).alias("n")).collect()] == [4, 2, 1]
    assert {(r["norm"], r["n_records"]) for r in sentences.reuse(df).collect()} == {("one two three", 2), ("one two three again four", 1)}
    assert {(r["record_order"], r["sentence"]) for r in sentences.reused_top(df).collect()} == {(0, "One two three."), (1, "ONE TWO THREE.")}


def test_alignment(spark):
    pairs = spark.createDataFrame([(1, "Alpha beta gamma delta. New words here now. alpha beta gamma epsilon.", "alpha BETA gamma delta! other things.")], "record_order long, text string, match_text string")
    got = {r["at"]: (r["level"], r["match_at"]) for r in sentences.align(pairs).collect()}
    assert got == {0: ("exact", 0), 1: ("none", -1), 2: ("similar", 0)}


def test_word_differences():
    runs = sentences.word_diff("The old cat, sat", "the cat sat down")
    assert "".join(t for t, _ in runs) == "The old cat, sat" and [t for t, c in runs if c] == ["old"]
    assert sentences.word_diff("", "x") == [("", False)]
    rng = random.Random(2)
    for _ in range(40):
        a, b = (rng.choices("abc", k=rng.randint(1, 7)) for _ in range(2))
        kept = sum(not c for t, c in sentences.word_diff(" ".join(a), " ".join(b)) for w in t.split() if not c)
        best = max((sum(1 for _ in s) for m in range(1 << len(a)) for s in [[x for i, x in enumerate(a) if m >> i & 1]] if is_part(s, b)), default=0)
        assert kept == best


def is_part(s, b):
    it = iter(b)
    return all(x in it for x in s)


def test_best_partner_of_all_is_that_of_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words[: rng.choice([8, 60])], k=rng.randint(0, 9))) for _ in range(130)] + ["lonely words only", ""]
    df = table(spark, texts).repartition(5)
    got = {r["record_order"]: (r["match_order"], round(r["similarity"], 9)) for r in similarity.best_partners_of_all(df).collect()}
    exact = {r["record_order"] for r in similarity.exact_groups(df).where("exact_partner IS NOT NULL").collect()}
    assert got == {k: (m, round(s, 9)) for k, (m, s) in brute(texts, 0.0).items() if k not in exact}


def test_places_are_those_of_all_sentences():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x", "yy"], k=rng.randint(0, 5))) for _ in range(rng.randint(0, 6))] for _ in range(2))
        want = []
        for x in a:
            best = (False, 0.0, 0, -1)
            for at, y in enumerate(b):
                wx, wy = ({w for w in s.split(" ") if len(w) > 1} for s in (x, y))
                exact = len(x) >= 8 and x == y
                score = 1.0 if exact else len(wx & wy) / len(wx | wy) if wx | wy else 0.0
                if (exact, score) > best[:2]:
                    best = (exact, score, len(wx & wy), at)
            want.append(best)
        assert sentences.best_places(a, b) == want


def lcs_table(a, b):
    best = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[-1][j] + 1 if x == y else max(best[-1][j + 1], row[j]))
        best.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out, i, j = [i - 1, *out], i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_common_words_equal_the_full_table():
    rng = random.Random(3)
    for _ in range(1500):
        words = "abcdefghij"[: rng.choice([2, 3, 10])]
        a, b = (rng.choices(words, k=rng.randint(0, 25)) for _ in range(2))
        assert sentences.common(a, b) == lcs_table(a, b)
    long = [[str(rng.randrange(300)) for _ in range(20_000)] for _ in range(2)]
    assert len(sentences.common(*long)) > 1000


@pytest.mark.parametrize("floor", [0.45, 0.0])
def test_blocks_and_slices_change_no_partner(spark, monkeypatch, floor):
    """Pairs never leave a task, whatever the blocks: many small ones, some of one class of sizes."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.sample(words[: rng.choice([12, 90])], k=rng.choice([1, 3, 6, 7, 7, 7, 12]))) for _ in range(160)]
    texts += [" ".join(w for w in t.split() if rng.random() < 0.9) for t in texts[:60]]
    for name, value in (("BLOCK", 150), ("PAIRS", 64), ("MET", 20), ("DENSE", 5)):
        monkeypatch.setattr(setjoin, name, value)
    df = table(spark, texts).repartition(5)
    conditions = list(setjoin._blocks(setjoin.stored(df)))
    assert len(conditions) > 4 and any("part <" in inside for inside, _, _ in conditions)
    got = {r["record_order"]: (r["match_order"], round(r["similarity"], 9)) for r in similarity.best_partners(df, floor).collect()}
    exact = {r["record_order"] for r in similarity.exact_groups(df).where("exact_partner IS NOT NULL").collect()}
    assert got == {k: (m, round(s, 9)) for k, (m, s) in brute(texts, floor).items() if k not in exact}


def test_candidates_are_never_stored(spark, monkeypatch):
    """Disk grows with the records: a hundred near copies are ten thousand pairs, and as many answers as records."""
    texts = [" ".join(f"w{i}" for i in range(40) if i != n % 40) + f" own{n}" for n in range(100)]
    written = []
    release = setjoin.release
    monkeypatch.setattr(setjoin, "release", lambda sets: (written.append(sets.count()), release(sets)))
    assert similarity.best_partners(table(spark, texts)).count() == 100 and written == [100]
