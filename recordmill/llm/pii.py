"""Personal data: base patterns, and a character tagger (tagger.py) that adds what they can't spell out.

Base spans (email, ip, card, phone) are leftmost matches that don't overlap within a kind; matches that fail their test
(parts over 255, number of digits, Luhn) are dropped after they have consumed their text. The tagger learns from windows of
the corpus that base spans label, and from copies of these windows whose personal data is written another way (`ways`: at
and dot in words or brackets, other separators, no plus sign) with new digits, the labels moved along. It finds such
spellings in all texts.

The tagger reads every character: windows of WINDOW characters, each overlapping the next by REACH, cover all of every
text. Viterbi is left out where it can find nothing (Tagger.hopeful). The windows' spans are reconciled over the whole text:
pieces of one kind that windows have cut are joined where they overlap, and of overlapping spans those with the greatest sum
of weights (probability times length) stay. A span is added if it is probable (LEAST), passes its kind's test once its
spelling is undone, and touches neither a base span nor a failed match of its kind.

The fit reads at most PER_KIND windows a kind, and PER_KIND without spans around digits, signs and written-out dots, chosen
by a hash of the window: a bounded sample in one task. A kind with fewer than FEWEST distinct windows gets no added spans.
Null texts are empty; repeated rows and ties are treated alike; an empty table gives no rows. Positions count code points,
ends are exclusive. Extra columns may have any names.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import heapq
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.tagger import SEED, Tagger, classes
from recordmill.session import materialize, release

KINDS = ("email", "ip", "card", "phone")
#: Length and overlap of windows, and how many are tagged at once.
WINDOW, REACH, BATCH = 1024, 64, 768
#: Bounds of the fit.
PER_KIND, FEWEST, FIT_WINDOW, NEAR = 400, 8, 72, 48
LEAST = 0.85

# Base patterns. A run of digits or name characters is tried once, from its first character: a later start can't succeed
# where that one fails, and possessive runs don't give characters back in vain.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def digits(text: str) -> str:
    return _DIGITS.sub("", text)


def luhn(number: str) -> bool:
    odd = sum(int(c) for c in number[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])) % 10 == 0


def ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def card_ok(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def phone_ok(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the longest run of name characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def candidates(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """All matches of each kind's pattern, with whether they pass its test."""
    found: dict[str, list] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = [(a, b, True) for a, b in _emails(text)]
    for kind, pattern, ok in (("ip", _IP, ip_ok), ("card", _CARD, card_ok), ("phone", _PHONE, phone_ok)):
        found[kind] = [(m.start(), m.end(), ok(m.group())) for m in pattern.finditer(text)]
    return found


# Windows


def windows(text: str) -> list[int]:
    """Starts of windows that cover the whole text, each overlapping the next by REACH."""
    return list(range(0, max(len(text) - REACH, 1), WINDOW - REACH)) if text else []


# What other spellings undo to

_AT = re.compile(r"(?i)\s*[\[({<]\s*(?:at|@|＠)\s*[\])}>]\s*|\s+(?:at|@)\s+|\s*＠\s*|\s+@|@\s+")
_DOT = re.compile(r"(?i)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s+\.\s+")
_EMAIL_FULL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP_FULL = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_CARD_FULL = re.compile(r"[0-9]{3,6}(?:[\x20./_–-]{1,3}[0-9]{3,7}){1,5}")
_PHONE_FULL = re.compile(r"(?:00|\+)?[0-9]{0,3}(?:[\x20./()–-]{1,3}[0-9]{2,5}){2,6}\)?")


def plausible(kind: str, span: str) -> bool:
    """Whether a span, its spelling undone, passes its kind's test."""
    if kind == "email":
        return bool(_EMAIL_FULL.fullmatch(_DOT.sub(".", _AT.sub("@", span))))
    if kind == "ip":
        plain = _DOT.sub(".", span)
        return bool(_IP_FULL.fullmatch(plain)) and ip_ok(plain)
    if kind == "card":
        return bool(_CARD_FULL.fullmatch(span)) and card_ok(span)
    return bool(_PHONE_FULL.fullmatch(span)) and phone_ok(span) and not card_ok(span)


def ways(kind: str, span: str, rng: random.Random) -> str:
    """The span written another way, with other digits."""
    new = "".join(rng.choice("0123456789") if c.isdigit() and kind != "ip" else c for c in span)
    if kind == "email":
        name, _, domain = new.partition("@")
        if rng.random() < 0.6:  # other names and hosts of the same make, with and without digits
            spelled = lambda part: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) if part else part
            name = ".".join(spelled(p) for p in name.split(".")[: rng.randint(1, 3)]) + rng.choice(["", "", str(rng.randrange(100))])
            domain = ".".join([*(spelled(p) for p in domain.split(".")[:-1][-rng.randint(1, 2) :]), domain.rpartition(".")[2]])
        at = rng.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " AT ", " {at} ", "＠", " @ ", " [@] "])
        dot = rng.choice([".", ".", " dot ", " (dot) ", "[dot]", "[.]", " [dot] ", " DOT "])
        return name + at + dot.join(domain.split("."))
    if kind == "ip":
        dot = rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]"])
        return dot.join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        number = digits(new)
        gap = rng.choice([".", "/", " - ", "  ", "_"])
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))
    number = digits(new)
    head, rest = number[:-10] or "1", number[-10:]
    return rng.choice(["{h} ({a}) {b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "00{h} {a} {b} {c}", "{a} {b} {c}", "{h}-{a}-{b}-{c}", "{h}.{a}.{b}.{c}", "({a}) {b} {c}", "{h}/{a}/{b}-{c}"]).format(h=head, a=rest[:3], b=rest[3:6], c=rest[6:])


# Fit

_ANCHOR = re.compile(r"(?ai)[0-9@＠]|[\[({<]\s{0,2}(?:at|dot|\.)\s{0,2}[\])}>]|\bdot\b")


def confusable(text: str) -> list[int]:
    """Starts of windows around what personal data has too: digits, signs and written-out dots."""
    starts: list[int] = []
    end = -1  # of what is covered
    for m in _ANCHOR.finditer(text):
        if m.end() + NEAR <= end:
            continue
        start = max(0, m.start() - NEAR)
        if start >= end:
            starts.append(start)
        else:
            starts.append(starts[-1] + NEAR)
        while starts[-1] + 2 * NEAR < min(len(text), m.end() + NEAR):
            starts.append(starts[-1] + NEAR)
        end = starts[-1] + 2 * NEAR
    return starts


def examples(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, stop, window) of each base span of a text, and ('', 0, 0, window) around anchors far from any."""
    found = {k: [(a, b) for a, b, ok in v if ok] for k, v in candidates(text).items()}
    near = sorted(s for v in found.values() for s in v)
    for kind, spans in found.items():
        for a, b in spans:
            if b - a <= FIT_WINDOW - 16:
                left = max(0, a - (FIT_WINDOW - (b - a)) // 2)
                yield kind, a - left, b - left, text[left : left + FIT_WINDOW]
    for start in confusable(text):
        end = start + FIT_WINDOW
        if not any(a < end and start < b for a, b in near[max(0, bisect.bisect_left(near, (start, 0)) - 4) : bisect.bisect_left(near, (end, 0)) + 1]):
            yield "", 0, 0, text[start:end]


def _tags(window: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(FIT_WINDOW, np.int64)
    for kind, a, b in spans:
        tag = 1 + 2 * KINDS.index(kind)
        out[a : min(b, FIT_WINDOW)] = tag + 1
        if a < FIT_WINDOW:
            out[a] = tag
    return out


def trained(rows: list[tuple[str, int, int, str]]) -> Tagger | None:
    """A tagger from examples; None if no kind has enough of them."""
    by_kind = {k: [r for r in rows if r[0] == k] for k in ("", *KINDS)}
    taught = [k for k in KINDS if len(by_kind[k]) >= FEWEST]
    if not taught:
        return None
    rng = random.Random(SEED)

    def one() -> tuple[np.ndarray, np.ndarray]:
        if by_kind[""] and rng.random() < 0.3:
            window = rng.choice(by_kind[""])[3]
            shift = rng.randrange(max(1, len(window) // 2))
            return classes(window[shift:], FIT_WINDOW), _tags(window, [])
        kind, a, b, window = rng.choice(by_kind[rng.choice(taught)])
        other = rng.random() < 0.7
        span = ways(kind, window[a:b], rng) if other else window[a:b]
        left = window[:a][rng.randrange(a // 2 + 1) :]  # the span stands anywhere in a window
        text = left + span + window[b:]
        spans = [(kind, len(left), len(left) + len(span))]
        for k, v in candidates(text).items():
            spans += [(k, x, y) for x, y, ok in v if ok and all(y <= p or q <= x for _, p, q in spans)]
        return classes(text, FIT_WINDOW), _tags(text, spans)

    def batch(size: int = 64) -> tuple[np.ndarray, np.ndarray]:
        ids, tags = zip(*(one() for _ in range(size)), strict=True)
        return np.stack(ids), np.stack(tags)

    return Tagger(len(KINDS)).fit(batch)


@dataclasses.dataclass
class Model:
    data: bytes | None
    taught: tuple[str, ...]


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """A tagger from a bounded sample of the windows of all texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict] = {k: {} for k in ("", *KINDS)}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for own in examples(text):
                    held = least[own[0]]
                    held[hashlib.blake2b(f"{own[1]}:{own[3]}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()] = own
                    if len(held) > 8 * PER_KIND:
                        least[own[0]] = {h: held[h] for h in heapq.nsmallest(PER_KIND, held)}
        rows = [(h, *held[h]) for held in least.values() for h in heapq.nsmallest(PER_KIND, held)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["h", "kind", "start", "stop", "window"])

    shown = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # the least by hash are among each task's least
    rows = materialize(shown.mapInArrow(found, "h string, kind string, start int, stop int, window string"), "examples")
    picked = None
    for kind in ("", *KINDS):
        top = rows.where(F.col("kind") == kind).distinct().orderBy("h").limit(PER_KIND)
        picked = top if picked is None else picked.unionByName(top)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
        model = trained(given)
        taught = [k for k in KINDS if sum(r[0] == k for r in given) >= FEWEST]
        yield pa.RecordBatch.from_pydict({"data": pa.array([model.dumps() if model else None], pa.binary()), "taught": pa.array([taught], pa.list_(pa.string()))})

    row = picked.select("kind", "start", "stop", "window").coalesce(1).mapInArrow(learned, "data binary, taught array<string>").first()
    release(rows)
    return Model(row["data"], tuple(row["taught"])) if row else Model(None, ())


# Search


@dataclasses.dataclass(frozen=True)
class Span:
    start: int
    stop: int
    kind: str
    probability: float
    cut_left: bool = False
    cut_right: bool = False

    @property
    def weight(self) -> float:
        return self.probability * (self.stop - self.start)


def reconciled(spans: list[Span]) -> list[Span]:
    """Of the spans of all windows of a text: cut pieces joined, then the heaviest that don't overlap."""
    joined: list[Span] = []
    open_: dict[str, int] = {}  # the last piece of a kind that its window cuts on the right
    for s in sorted(set(spans), key=lambda s: (s.start, s.stop, s.kind)):
        at = open_.get(s.kind)
        if s.cut_left and at is not None and s.start <= joined[at].stop:
            p = joined[at]
            stop = max(p.stop, s.stop)
            joined[at] = Span(p.start, stop, s.kind, min(p.probability, s.probability), p.cut_left, s.cut_right if s.stop >= p.stop else p.cut_right)
            continue
        joined.append(s)
        if s.cut_right:
            open_[s.kind] = len(joined) - 1
    joined.sort(key=lambda s: (s.stop, s.start, s.kind))
    ends, best = [s.stop for s in joined], [0.0]
    took: list[bool] = []
    for s in joined:
        alone = best[bisect.bisect_right(ends, s.start, 0, len(took))] + s.weight
        took.append(alone > best[-1])
        best.append(max(best[-1], alone))
    out, k = [], len(joined)
    while k:
        if took[k - 1]:
            out.append(joined[k - 1])
            k = bisect.bisect_right(ends, joined[k - 1].start, 0, k - 1)
        else:
            k -= 1
    return out[::-1]


def tagged(texts: list[str], tagger: Tagger, taught: tuple[str, ...]) -> list[list[Span]]:
    """Reconciled spans of the tagger for each text."""
    at = sorted(((n, start, min(WINDOW, len(text) - start)) for n, text in enumerate(texts) for start in windows(text)), key=lambda w: -w[2])
    found: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []  # windows that may have spans, and their scores

    def searched() -> None:
        sizes = np.array([len(s) for _, _, s in held])
        scores = np.zeros((sizes[0], len(held), held[0][2].shape[1]), np.float32)
        for k, (_, _, s) in enumerate(held):
            scores[: len(s), k] = s
        tags = tagger.best(scores, sizes)
        sure = np.take_along_axis(tagger.marginals(scores, sizes), tags.T[:, :, None], 2)[:, :, 0].T
        for (n, start, _), marks, p in zip(held, tags, sure, strict=True):
            for a, b, kind in _runs(marks):
                if KINDS[kind] in taught:
                    found[n].append(Span(start + a, start + b, KINDS[kind], float(p[a:b].mean()), a == 0 and start > 0, b == WINDOW and start + b < len(texts[n])))
        held.clear()

    while at:
        # about as long as each other, so that little is spent past the ends of short ones
        size = next((k for k in range(BATCH // 3, min(BATCH, len(at))) if at[k][2] < 0.8 * at[0][2]), BATCH)
        part, at = at[:size], at[size:]
        s = tagger.scores([classes(texts[n][start : start + size], size) for n, start, size in part])
        for k in np.flatnonzero(tagger.hopeful(s, np.array([size for _, _, size in part]))):
            n, start, size = part[k]
            held.append((n, start, s[:size, :, k].copy()))
        if len(held) >= BATCH:
            searched()
    if held:
        searched()
    return [reconciled(spans) for spans in found]


def _runs(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, stop, kind) of the spans that tags mark."""
    start, kind = -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (tag == 0 or tag % 2 == 1):
            yield start, i, kind
            start = -1
        if tag and start < 0:
            start, kind = i, (tag - 1) // 2


def found_in(texts: list[str], tagger: Tagger | None, taught: tuple[str, ...]) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, stop, base or tagger) for each text, by kind as listed, then start."""
    out = []
    added = tagged(texts, tagger, taught) if tagger is not None else [[] for _ in texts]
    for text, more in zip(texts, added, strict=True):
        tried = candidates(text)
        spans = [(k, a, b, "base") for k in KINDS for a, b, ok in tried[k] if ok]
        base = sorted((a, b) for _, a, b, _ in spans)
        for s in more:
            a, b = s.start, s.stop
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if s.probability >= LEAST and plausible(s.kind, text[a:b]) and not _touches(base, a, b) and not _touches([(x, y) for x, y, ok in tried[s.kind] if y - x > 1 and not (s.kind in ("card", "phone", "ip") and _part_of(x, y, a, b))], a, b):
                spans.append((s.kind, a, b, "tagger"))
        out.append(sorted(spans, key=lambda r: (KINDS.index(r[0]), r[1], r[2])))
    return out


def _part_of(x: int, y: int, a: int, b: int) -> bool:
    """A failed match that lies within a span is a part of it in another spelling, not a refusal of it."""
    return a <= x and y <= b and (x, y) != (a, b)


def _touches(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    at = bisect.bisect_left(spans, (b, 0))
    return any(x < b and a < y for x, y in spans[max(0, at - 8) : at])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("source", pa.string())]))


def spans(text: Column, model: Model, spark) -> Column:
    """array<struct<kind,start,stop,source>> of a text's personal data, by kind as listed, then start."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<kind:string,start:int,stop:int,source:string>>")
    def located(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        tagger = Tagger.loads(own.data) if own.data else None
        for batch in batches:
            rows = found_in([x or "" for x in batch.to_pylist()], tagger, own.taught)
            yield pa.array([[{"kind": k, "start": a, "stop": b, "source": s} for k, a, b, s in row] for row in rows], _SPANS)

    return located(text)
