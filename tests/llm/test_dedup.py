import random

import numpy as np

from recordmill import session
from recordmill.llm import dedup, simhash
from recordmill.llm.common import words
from recordmill.llm.graph import components


def brute_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for i in ids:
        least[root(i)] = min(i, least.get(root(i), i))
    return {i: least[root(i)] for i in ids}


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), (3, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprints(seed: int) -> dict[int, int]:
    rng = random.Random(seed)
    out = {}
    for g in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out[len(out)] = x
    out |= {900: 0, 901: 0, 902: 3, 903: (1 << 64) - 1}
    return out


def test_links_lose_none_also_in_dense_and_hot_buckets(spark, monkeypatch):
    for seed, dense, hot, radius, segments in ((1, 48, 2048, 4, 3), (2, 3, 2048, 4, 3), (3, 3, 4, 4, 3), (4, 10**6, 10**6, 5, 3), (5, 2, 3, 3, 2)):
        monkeypatch.setattr(simhash, "DENSE", dense)
        fps = fingerprints(seed)
        rows = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
        nodes = rows.groupBy("fp").agg(simhash.F.min("doc_id").alias("least"))
        found = components(simhash.links(nodes.select("fp"), radius, segments, hot))
        label = {r["node"]: r["component"] for r in found.collect()}
        byc: dict[int, int] = {}
        signed = {i: (x - (1 << 64) if x >> 63 else x) for i, x in fps.items()}
        for i, x in signed.items():
            c = label.get(x, x)
            byc[c] = min(i, byc.get(c, i))
        assert {i: byc[label.get(x, x)] for i, x in signed.items()} == brute_components(fps, radius)


def test_contract_columns_and_odd_rows(spark):
    texts = ["A b c d e", "a B c d e", None, "", "one two", "x " * 30000, "été AÉ b c d"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r for r in simhash.components_of(docs).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[1]["component_id"] == 0
    assert got[2]["fingerprint"] == "0" * 16 == got[3]["fingerprint"] and got[3]["component_id"] == 2
    assert simhash.components_of(docs).count() == len(texts) + 1
    import xxhash

    h = xxhash.xxh64_intdigest(b"one two", 42)
    assert got[4]["fingerprint"] == format(h, "016x")
    assert simhash.components_of(docs.limit(0)).count() == 0


def test_radius_layout_covers_every_distance():
    rng = np.random.default_rng(1)
    for radius in range(1, 8):
        parts = simhash.layout(radius, 3)
        assert sum(w for _, w, _ in parts) == 64
        for _ in range(200):
            x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(r >= 0 and ((x >> o) & ((1 << w) - 1)).bit_count() <= r for o, w, r in parts)


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a), words(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_keep_one_drops_copies_only_for_a_similar_text_that_stays(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(800)]
    rows = {}
    for g in range(12):
        base = rng.choices(vocabulary, k=150)
        for k in range(rng.choice([1, 3, 6])):
            w = list(base)
            if k > 1:
                w[rng.randrange(150)] = "changed"
            rows[len(rows)] = " ".join(w)
    rows |= {500: None, 501: "", 502: "a b", 503: "a b"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows.items()] + [(502, "a b", 1)], "doc_id long, text string, d1 int")
    kept = {r["doc_id"] for r in dedup.keep_one(docs).collect()}
    for i, t in rows.items():
        if i not in kept:
            assert any(jaccard(t, rows[k]) >= 0.8 or (t or "") == (rows[k] or "") for k in kept)
    alike = [(a, b) for a in kept for b in kept if a < b and jaccard(rows[a], rows[b]) >= 0.8]
    assert not alike and 500 in kept and 501 not in kept and 502 in kept and 503 not in kept
    assert dedup.keep_one(docs).count() == len(kept) and dedup.keep_one(docs.limit(0)).count() == 0


def test_texts_that_no_round_compares_are_compared_in_the_end(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(70)]
    rows = {}
    for _ in range(60):
        own = [word() for _ in range(80)]
        rows[len(rows)] = " ".join(passage + own)
        rows[len(rows)] = " ".join([word() for _ in range(28)] + passage + own)
    monkeypatch.setattr(simhash, "groups", lambda texts, *_: texts.withColumn("component_id", simhash.F.lit(0).cast("long")))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in dedup.keep_one(docs).collect()}
    assert len(kept) == 60 and {i // 2 for i in kept} == set(range(60))


def test_leaders_that_go_open_what_they_took(spark):
    base = list(range(100))
    sets = {1: base, 2: base[10:] + [100], 3: base[20:] + [200], 4: [900], 5: base[20:] + [300]}
    none, order = np.array([], np.int64), np.array([], np.int64)
    rows = [(i, [len(s), *dedup.prefix_of(np.array(sorted(s)), none, order).tolist()]) for i, s in sets.items()]
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "tid long, sh array<long>")
    stars = spark.createDataFrame([(3, 2), (5, 2), (4, 1)], "tid long, leader long").where("tid <> 4").unionByName(spark.createDataFrame([(6, 1)], "tid long, leader long"))
    gone = dedup.resolved(spark.createDataFrame(rows, "tid long, prefix array<long>"), stars, lambda tids: session.materialize(table.join(tids, "tid", "left_semi"), "shingles"))
    left = {r["tid"] for r in gone.collect()}
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    stay = set(sets) - left
    assert 2 in left and 1 in stay and not any(alike(a, b) for a in stay for b in stay if a < b)
    assert all(any(alike(a, b) for b in stay) for a in left & set(sets))


def test_similar_texts_meet_whatever_their_fingerprints(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = {}
    for g in range(60):
        base = [word() for _ in range(150)]
        copy = base + [word() for _ in range(34)] if g % 3 == 0 else base[:123] if g % 3 == 1 else [word() if i in (20, 70, 120) else w for i, w in enumerate(base)]
        rows |= {2 * g: " ".join(base), 2 * g + 1: " ".join(copy)}
    assert all(0.8 <= jaccard(rows[i], rows[i + 1]) <= 0.85 for i in range(0, len(rows), 2))
    far = sum((simhash.fingerprint_of(simhash.shingles(rows[i], 1, True)) ^ simhash.fingerprint_of(simhash.shingles(rows[i + 1], 1, True))).bit_count() > dedup.RADIUS for i in range(0, len(rows), 2))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in dedup.keep_one(docs).collect()}
    assert far > 10 and len(kept) == 60 and {i // 2 for i in kept} == set(range(60))


def test_the_sample_of_frequent_shingles_changes_no_result(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    licence = [word() for _ in range(40)]
    rows = []
    for g in range(20):
        base = [word() for _ in range(100)]
        for k in range(3):
            rows.append((len(rows), " ".join(licence + [word() if i in (20, 30 * k) and k else w for i, w in enumerate(base)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, frequent = [], []
    for sample in (20_000, 1):
        monkeypatch.setattr(dedup, "SAMPLE", sample)
        frequent.append(len(dedup.frequent_shingles(docs, "text")))
        kept.append({r["doc_id"] for r in dedup.keep_one(docs).collect()})
    assert frequent[0] > frequent[1] and kept[0] == kept[1] and 20 <= len(kept[0]) < 60


def test_odd_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", 7, {"k": 1}, "x"), (1, "a b c d e f g", 5, {"k": 2}, "y"), (2, "A b c d e f g", 5, {"k": 2}, "y"), (3, None, 1, None, None), (None, None, 1, None, None), (None, "only one here", 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d1 int, m map<string,int>, keeper string")
    got = dedup.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(map(str, got.collect()))
    assert kept == sorted(str(r) for r in docs.collect() if r["doc_id"] == 3 or r["text"] == "only one here" or (r["doc_id"], r["_d1"]) == (1, 5))


def test_shuffled_and_broadcast_lists_give_the_same(spark, monkeypatch):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(120)]
        rows += [(len(rows) + k, " ".join(w if rng.random() > 0.02 or k == 0 else word() for w in base)) for k in range(24)]
    docs = spark.createDataFrame(rows + [(len(rows), rows[0][1])], "doc_id long, text string")
    kept = [{r["doc_id"] for r in dedup.keep_one(docs).collect()}]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dedup, "SHARE_ROWS", 4)
    kept.append({r["doc_id"] for r in dedup.keep_one(docs).collect()})
    texts = dict(rows)
    for own in kept:
        assert not [(a, b) for a in own for b in own if a < b and jaccard(texts[a], texts[b]) >= 0.8]
        assert all(i in own or any(jaccard(t, texts[k]) >= 0.8 for k in own) for i, t in texts.items())


def test_fingerprints_are_majorities_of_all_shingles_counted_bit_by_bit():
    import xxhash

    rng = random.Random(15)
    for n in (1, 3, 4, 5, 40, 700):
        text = " ".join(rng.choices(["Ab", "c", "d\u00e9", "E", "f"], k=n))
        own = text.replace("A", "a").replace("E", "e").split(" ")
        parts = [" ".join(own[i : i + 4]) for i in range(len(own) - 3)] or [" ".join(own)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint_of(simhash.shingles(text, 4)) == want


def test_columns_of_any_name_pass_through_the_stages(spark):
    from recordmill.llm import decontaminate, secrets
    from recordmill.session import fresh_path

    names = ["a.b", "_one", "d1", "blob", "_Text", "`q`"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["one two three four five six", "one two three four five six", "password = hunter2hunter2", None, None])]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [0, 2, 3]
    clean = decontaminate.clean(kept, spark.createDataFrame([(1, "seven eight nine ten eleven twelve thirteen")], "item_id long, text string"))
    done = secrets.redact(clean, fresh_path(spark, "ledger"))
    assert done.columns == docs.columns
    assert {r[0]: tuple(r)[1:] for r in done.collect()} == {i: ("[SECRET]" if i == 2 else rows[i][1], *[f"{n}{i}" for n in names]) for i in (0, 2, 3)}
