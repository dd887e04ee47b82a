"""Personal data: base patterns by brute force, the tagger's gradients, and spellings that only the tagger finds."""

import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from recordmill.llm import pii, tagger
from recordmill.session import fresh_path

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    def ok(kind, m):
        number = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            twice = [int(c) * (1 + (i % 2)) for i, c in enumerate(reversed(number))]
            return 13 <= len(number) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(number) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m.group())]


def base(text):
    found = pii.candidates(text)
    return [(k, a, b) for k in pii.KINDS for a, b, ok in found[k] if ok]


def test_base_equals_the_patterns():
    rng = random.Random(2)
    for alphabet in ("a1.@-+ ", "12. ", "0123456789 -", "+12() .-x", "é9@b.c4+"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert base(text) == brute(text), text
    shown = "x 4111 1111 1111 1111, 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 a@b.co a@@b.c.d. +1 (415) 555-0100) é@x.y"
    assert base(shown) == brute(shown) and len(base(shown)) >= 6


def test_base_is_linear():
    import time

    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b@" * 75_000, "+1" * 150_000, "1 " * 150_000, "@a" * 150_000):
        base(text), pii.windows(text)
    assert time.time() - start < 20


def test_windows_cover_what_is_near_an_anchor():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices("x1 ", weights=(200, 1, 20), k=rng.randint(0, 900)))
        starts = pii.windows(text)
        covered = {i for s in starts for i in range(s, s + pii.WINDOW)}
        near = {i for m in re.finditer("[0-9]", text) for i in range(max(0, m.start() - pii.REACH), min(len(text), m.end() + pii.REACH))}
        assert near <= covered and starts == sorted(set(starts))
        assert all(b - a >= pii.WINDOW // 2 for a, b in zip(starts, starts[1:]))


def test_windows_cover_whole_texts():
    for n in (0, 1, pii.REACH, pii.WINDOW - 1, pii.WINDOW, pii.WINDOW + 1, 5 * pii.WINDOW):
        starts = pii.windows("x" * n)
        assert {i for s in starts for i in range(s, min(n, s + pii.WINDOW))} == set(range(n))
        assert all(a + pii.WINDOW - b >= pii.REACH for a, b in zip(starts, starts[1:]))


def test_windows_of_any_lengths_are_tagged_as_each_alone():
    own = tagger.Tagger(2, np.random.default_rng(5))
    rng = np.random.default_rng(6)
    own.w |= {"steps": rng.normal(0, 1, (5, 5)).astype(np.float32), "bias": np.array([1.2, 0, 0, 0, 0], np.float32)}
    sizes = np.array(sorted(rng.integers(1, 60, 80), reverse=True))
    rows = [rng.integers(0, tagger.CLASSES, n) for n in sizes]
    s = own.scores(rows)
    tags, sure = own.best(s.transpose(0, 2, 1), sizes), own.marginals(s.transpose(0, 2, 1), sizes)
    hopeful = own.hopeful(s, sizes)
    for k, row in enumerate(rows):
        alone, _ = own.emissions(row[None])
        assert np.abs(s[: len(row), :, k] - alone[:, 0]).max() < 1e-5
        assert tags[k, : len(row)].tolist() == own.best(alone)[0].tolist() and not tags[k, len(row) :].any()
        assert np.abs(sure[: len(row), k] - own.marginals(alone)[:, 0]).max() < 1e-4
        assert hopeful[k] or not tags[k].any()
    assert 0 < hopeful.sum() < len(rows)


def test_the_bound_takes_all_kinds_together_and_rules_out_no_window_with_a_span():
    rng = np.random.default_rng(7)
    own = tagger.Tagger(3, rng)
    kept = []
    for quiet in (0.5, 2.0, 6.0):
        own.w |= {"steps": rng.normal(0, 0.7, (7, 7)).astype(np.float32), "start": rng.normal(0, 1, 7).astype(np.float32)}
        own.w["steps"][0, 1:] -= quiet / 2
        sizes = np.array(sorted(rng.integers(1, 90, 120), reverse=True))
        s = rng.normal(0, 1, (sizes[0], 7, len(sizes))).astype(np.float32)
        s[:, 0] += quiet
        tags, hopeful = own.best(s.transpose(0, 2, 1), sizes), own.hopeful(s, sizes)
        assert (hopeful | ~tags.any(axis=1)).all()
        kept.append(int(hopeful.sum()))
    assert kept[0] > kept[2] and kept[2] < 120
    # a run that changes its kind at each character gains by the joint bound only, which a bound by kinds doesn't let through
    own.w |= {"steps": np.zeros((7, 7), np.float32), "start": np.zeros(7, np.float32)}
    own.w["steps"][1:, 1::2] = -9
    s = np.full((3, 7, 1), -5, np.float32)
    s[:, 0], s[0, 1], s[1, 4] = 0, -1, 2
    assert own.hopeful(s, np.array([3])).tolist() == [True] and not own.best(s.transpose(0, 2, 1), np.array([3])).any()


def test_gradients():
    rng = np.random.default_rng(0)
    own = tagger.Tagger(2, rng)
    own.w = {k: v.astype(np.float64) for k, v in own.w.items()}
    ids = rng.integers(0, tagger.CLASSES, (3, 7))
    tags = np.array([[0, 1, 2, 0, 3, 4, 4], [2, 2, 0, 0, 1, 1, 2], [0, 0, 0, 3, 4, 0, 0]])
    grads = own.gradients(ids, tags)
    for k, w in own.w.items():
        for _ in range(5):
            i = (0, 1) if k == "steps" else (ids[0, 0], 3) if k == "embed" else tuple(rng.integers(0, n) for n in w.shape)
            old, e = w[i], 1e-5
            w[i] = old + e
            up = own.loss(ids, tags)
            w[i] = old - e
            down = own.loss(ids, tags)
            w[i] = old
            assert abs((up - down) / (2 * e) - grads[k][i]) < 1e-5, k


def test_best_is_the_most_likely_of_all_paths():
    import itertools

    own = tagger.Tagger(1, np.random.default_rng(1))
    own.w["steps"] = np.random.default_rng(2).normal(0, 1, (3, 3)).astype(np.float32)
    ids = np.random.default_rng(3).integers(0, 99, (2, 5))
    s, _ = own.emissions(ids)
    scores = {}
    for path in itertools.product(range(3), repeat=5):
        if all(own.ok[a, b] for a, b in zip(path, path[1:])):
            scores[path] = own.w["start"][path[0]] + s[0, 0, path[0]] + sum(own.w["steps"][a, b] + s[t + 1, 0, b] for t, (a, b) in enumerate(zip(path, path[1:])))
    assert tuple(own.best(s)[0]) == max(scores, key=scores.get)
    weights = {p: np.exp(x) for p, x in scores.items()}
    first = sum(w for p, w in weights.items() if p[2] == 1) / sum(weights.values())
    assert abs(own.marginals(s)[2, 0, 1] - first) < 1e-4
    assert own.loads(own.dumps()).best(s).tolist() == own.best(s).tolist()


def test_reconciliation():
    s = lambda a, b, k="card", p=0.9, left=False, right=False: pii.Span(a, b, k, p, left, right)
    assert pii.reconciled([]) == []
    assert [(x.start, x.stop) for x in pii.reconciled([s(10, 96, right=True), s(48, 120, left=True)])] == [(10, 120)]
    chain = [s(0, 96, right=True), s(48, 144, left=True, right=True), s(96, 150, left=True)]
    assert [(x.start, x.stop) for x in pii.reconciled(chain)] == [(0, 150)]
    assert [(x.start, x.stop, x.kind) for x in pii.reconciled([s(0, 10), s(8, 30, "phone"), s(29, 33), s(40, 44)])] == [(8, 30, "phone"), (40, 44, "card")]
    assert len(pii.reconciled([s(0, 10), s(0, 10), s(10, 20)])) == 2


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("the of ing and er tion as".split(), k=rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    number = lambda n: "".join(rng.choices("0123456789", k=n))

    def card():
        head = "4" + number(14)
        return next(head + c for c in "0123456789" if pii.luhn(head + c))

    make = {"email": lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({number(3)}) 555-{number(4)}"}
    docs = [(i, f"{prose(rng.randint(5, 40))} {make[rng.choice(pii.KINDS)]()} {prose(12)}") for i in range(400)]
    docs += [(i, f"{prose(10)} {number(rng.randint(2, 12))} {prose(10)}") for i in range(400, 480)]
    docs += [(500, None), (501, ""), (502, prose(200)), (503, "x" * 30_000 + " " + make["ip"]() + " é😀 " + make["email"]())]
    clear = [(600, f"{prose(8)} anna.smith at mail dot example dot com {prose(8)}", "email"), (601, f"{prose(8)} joe.42 [at] mail7.example.com {prose(8)}", "email"), (602, f"{prose(8)} 10[.]20[.]30[.]40 {prose(8)}", "ip"), (603, f"{prose(8)} (415) 555-0137 {prose(8)}", "phone")]
    return docs, clear


def test_query(spark, corpus):
    docs, clear = corpus
    path = fresh_path(spark, "pii")
    spark.createDataFrame([(i, t, "s") for i, t in docs + [c[:2] for c in clear] + docs[:3]], "doc_id long, text string, spans string").write.parquet(f"{path}/documents.parquet")
    found = entry.queries()["op11_pii"](spark, path)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    rows = found.collect()
    assert len(rows) == len(docs) + len(clear) + 3
    by_id = {r["doc_id"]: r for r in rows}
    text_of = {i: t or "" for i, t in docs + [c[:2] for c in clear]}
    extra = 0
    for i, text in text_of.items():
        own = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert by_id[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in own) for k in pii.KINDS]
        listed = [x for x in by_id[i]["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(listed)
        extra += i < 600 and len(listed) != len(own)
    assert extra <= 2  # clean documents are left alone
    hits = 0
    for i, text, kind in clear:
        for k, a, b in (x.split(":") for x in by_id[i]["spans"].split(",") if x):
            hits += k == kind and text[int(a) : int(b)] in text and int(b) - int(a) > 8
    assert hits >= 3


class Knows(tagger.Tagger):
    """Is sure of one email address and of nothing else."""

    def scores(self, rows):
        own = tagger.classes(ADDRESS, len(ADDRESS))
        out = np.zeros((len(rows[0]), 9, len(rows)), np.float32)
        out[:, 0] = 5
        for k, row in enumerate(rows):
            for i in range(len(row) - len(own) + 1):
                if (row[i : i + len(own)] == own).all():
                    out[i, 1, k] = out[i + 1 : i + len(own), 2, k] = 30
        return out


ADDRESS = "anna.smith at mail.example.com"


def test_addresses_without_digit_or_sign_are_looked_for_anywhere():
    prose = "the ing and of " * 400
    texts = [prose[:n] + " " + ADDRESS + " " + prose[:m] for n in (0, 7, 900, 940, 1000, 1019, 3000, 5000) for m in (0, 3, 2000)] + [prose, ""]
    for text, found in zip(texts, pii.found_in(texts, Knows(4), pii.KINDS)):
        at = text.find(ADDRESS)
        assert found == ([("email", at, at + len(ADDRESS), "tagger")] if at >= 0 else [])


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string")
    assert pii.fit(empty) == pii.Model(None, ())
    plain = spark.createDataFrame([("a 1 b",), (None,), ("",)], "text string")
    model = pii.fit(plain)
    assert model.data is None and [r[0] for r in plain.select(pii.spans(plain["text"], model, spark)).collect()] == [[], [], []]
