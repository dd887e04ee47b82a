"""Conversation repair and the prefix trie, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from recordmill.llm import conversations, repair, trie
from recordmill.session import fresh_path

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members, kids = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = int(k not in kids), (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for x in kids.get(k, []):
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *below(k), ends[k]) for k, m in members.items()), key=str)


def found_trie(spark, rows):
    got = trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    rows = [(c, rng.choice([t, t, t, None, t // 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""])) for c in range(-7, 60) for t in range(rng.randint(1, 12))]
    return rows + [(None, 0, "user", "x"), *rows[:5]]


def test_trie_equals_brute_force(spark, mixed):
    assert found_trie(spark, mixed) == brute_trie(mixed)


def test_trie_with_a_tiny_sketch_and_blocks(spark, mixed, monkeypatch):
    monkeypatch.setattr(trie, "MIN_WIDTH", 16)
    monkeypatch.setattr(trie, "MAX_WIDTH", 16)
    monkeypatch.setattr(trie, "BLOCK", 2)
    assert found_trie(spark, mixed) == brute_trie(mixed)


def test_trie_of_copies_and_of_nothing(spark):
    copies = [(c, t, "user", "same") for c in range(30) for t in range(9)]
    assert found_trie(spark, copies) == brute_trie(copies)
    assert found_trie(spark, []) == []
    # turnless: the base is absent and the conversation has fewer turns than it gives up
    lone = next([(c, 0, "user", "x")] for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert found_trie(spark, lone) == brute_trie(lone) == [(lone[0][0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone[0][0]).encode()).hexdigest())]


def test_trie_takes_other_columns_and_long_texts(spark):
    rows = [(c, t, "user", "é" * 200_000 if t else "x", "q") for c in (0, 1, 2) for t in (0, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", depth string")
    assert sorted((tuple(r) for r in trie.trie(df).collect()), key=str) == brute_trie([r[:4] for r in rows])


def test_sketch_never_underestimates():
    import numpy as np

    rng = np.random.default_rng(3)
    k = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    k = np.concatenate([k, k[:, :700]], axis=1)
    s = trie.Sketch(np.zeros((trie.ROWS, trie.width_for(5700)), np.uint8))
    for i in range(0, 5700, 1000):
        s.add(k[0, i : i + 1000], k[1, i : i + 1000])
    found = s.estimate(*k)
    assert (found[:700] == 2).all() and (found[5000:] == 2).all() and (found[700:5000] == 1).mean() > 0.9


def test_chunks_keep_order(spark):
    rows = [(k, i, str(i)) for k in ("a", "b") for i in range(500)] + [("c", 1, "1")]
    df = spark.createDataFrame(rows, "k string, i long, s string").repartition(7)
    parts = conversations.chunked(df, ["k"], "i", "s", ",", length=50)
    assert parts.count() < 200
    got = {r["k"]: r["sha256"] for r in conversations.ordered_digests(parts, ["k"], ["i"], "s", ",").collect()}
    whole = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert got == {"a": whole, "b": whole, "c": hashlib.sha256(b"1").hexdigest()}


# Repair


def brute_repair(rows):
    """All edits of (role, must go, truncated), at most two insertions in a row."""
    best = None
    inserts = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    choices = []
    for initial, must, cut in rows:
        own = [(4, "D", "")]
        if not must:
            own += [(3 * cut, "K", initial), (3 + 3 * cut, "R", "u"), (3 + 3 * cut, "R", "a")]
        choices.append(own)
    for ins in itertools.product(inserts, repeat=len(rows) + 1):
        for picked in itertools.product(*choices):
            roles = ins[0] + "".join(p[2] + i for p, i in zip(picked, ins[1:]))
            if re.fullmatch("(s?(ua)+)?", roles) and not any(p[1] == "K" and not p[2] for p in picked):
                w = (3 * sum(map(len, ins)) + sum(p[0] for p in picked), "I" * len(ins[0]) + "".join(p[1] + "I" * len(i) for p, i in zip(picked, ins[1:])))
                best = w if best is None or w < best else best
    return best


def test_agenda_equals_all_edits():
    rng = random.Random(4)
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3, 3):
        rows = [(rng.choice(["s", "u", "a", "a", "u", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        assert repair.lightest(rows) == brute_repair(rows), rows


def test_blocks_give_the_same_as_the_whole():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 20))]
        blocks = [repair.block_items(rows[i : i + 3]) for i in range(0, len(rows), 3)]
        pairs = [repair.joined_items(blocks[i : i + 2]) for i in range(0, len(blocks), 2)]
        ends = [(c, a) for p, q, c, a in repair.joined_items(pairs) if p == repair.START and q in repair.GOALS]
        assert min(ends) == repair.lightest(rows)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    rows = [(c, rng.choice([t, t, None, t // 2]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No", " \n", "Why? ", "", None, "é!"])) for c in [*range(25), None] for t in range(rng.randint(1, 9))]
    return rows + [(90, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(40)] + rows[:4]


def by_hand(rows):
    out = {}
    groups = {}
    space = lambda x: " " if x is None else x
    for c, t, r, x in rows:
        groups.setdefault(c, [])
        code = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        old = (space(r), space(x))
        role, text = "user" if code == 4 else old[0], "" if code == 1 else re.sub("[.!?]", "", old[1]) if code == 2 else old[1]
        if code:
            groups[c] += [((t is not None, t or 0, *old, k), t, role, text) for k in range(1 + (code == 3))]
    for c, own in groups.items():
        own = sorted(own, key=lambda r: r[0])
        said = [(r, x) for _, _, r, x in own]
        marks = repair.faults(said)
        cost, audit = repair.lightest([(r[:1], m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(said, marks)])
        turns = [t for _, t, _, _ in own if t is not None]
        lines = "\n".join(f"{r}:{x}" for r, x in repair.repaired_rows(said, audit))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return {c: v for c, v in out.items() if groups[c]}


def reported(spark, rows):
    found = repair.report(repair.damaged(spark.createDataFrame(rows, SCHEMA)), repair.TIES).collect()
    return {r["conv_id"]: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in found}


def test_report_equals_the_definition(spark, talks):
    assert reported(spark, talks) == by_hand(talks)
    assert reported(spark, []) == {}


def test_long_conversations_go_the_other_way(spark, talks, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    assert reported(spark, talks) == by_hand(talks)


def test_repaired_turns_are_well_formed(spark, talks, monkeypatch):
    df = spark.createDataFrame([(c, t, r or " ", x or " ") for c, t, r, x in talks], SCHEMA)
    whole = [tuple(r) for r in repair.repaired(df).orderBy("conv_id", "block", "place").select("conv_id", "role", "text").collect()]
    monkeypatch.setattr(repair, "BLOCK", 4)
    assert [tuple(r) for r in repair.repaired(df).orderBy("conv_id", "block", "place").select("conv_id", "role", "text").collect()] == whole
    roles = {}
    for c, r, _ in whole:
        roles[c] = roles.get(c, "") + r[:1]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())


def test_every_original_conversation_is_returned(spark, talks):
    import __spark_entry__ as entry

    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    path = fresh_path(spark, "talks")
    spark.createDataFrame([*talks, (gone, 0, "user", "x.")], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    rows = {r["conv_id"]: r for r in entry.queries()["op12_repair"](spark, path).collect()}
    assert set(rows) == {r[0] for r in talks} | {gone}
    assert tuple(rows[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c: tuple(r)[1:] for c, r in rows.items() if c in by_hand(talks)} == by_hand(talks)
