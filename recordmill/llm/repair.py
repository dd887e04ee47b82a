"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation's role initials read `(s?(ua)+)?`. Rows are kept, given the role user or assistant, or deleted,
and empty rows may be inserted; blank and repeated rows must go, and a truncated row that stays costs extra. Each item
(rows used up, state of the role pattern) is a vertex of a weighted hypergraph, each edit a deduction from one item to
the next; the weight of a derivation is (cost, audit), where the audit is its edits' initials in order. Costs grow and
audits are extended, so the deductions are superior functions: the agenda pops items in the order of their weights, a
popped item's weight is final, and the search stops when the goal item is popped. Of derivations of one item with one
cost, no audit is a proper prefix of another (it would lack an insertion and its cost), so their order outlives any
extension, which is what makes the agenda exact for ties too.

Short conversations (up to BLOCK rows and BLOCK_CHARS bytes) are repaired whole where their rows meet. Longer ones are
cut into blocks of BLOCK rows: an agenda a block finds the lightest derivations from every state to every state, and
agendas over FAN neighbouring blocks join these, a hyperedge from (items so far, block item) to the next, level by level.
Texts take no part in that. What's left to one task for a conversation is its audit, as long as its rows, and its digest.

Faults: blank (no character but the six ASCII white-space ones), else duplicate (role and text stand in an earlier row),
else truncated (the last character that isn't white space is none of `.!?`). Rows of one turn go by the tie columns; a
null conv_id is a conversation of its own; null turns come first and aren't counted in gaps; null roles and texts must have
been replaced before. A role without characters has no initial and can't be kept. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.conversations import ordered_digests, placed
from recordmill.operators.scan import Running, running
from recordmill.session import materialize, release, small

#: What edits cost.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOALS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: The state that a role's initial leads to.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state that a user's or assistant's row leads to, whichever is due.
DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
BLOCK, BLOCK_CHARS, FAN = 512, 1 << 22, 64
_WHITE = " \t\n\x0b\x0c\r"
Weight = tuple[int, str]
Row = tuple[str, bool, bool]  # initial, must be deleted, truncated


def agenda(axioms: dict[tuple, Weight], deduce: Callable[[tuple, Weight], Iterable[tuple[tuple, Weight]]], goal: Callable[[tuple], bool] | None = None) -> dict[tuple, Weight]:
    """Final weights of all items that can be derived; with a goal, up to the first goal item, which comes last."""
    queue = [(w, item) for item, w in axioms.items()]
    heapq.heapify(queue)
    final: dict[tuple, Weight] = {}
    while queue:
        w, item = heapq.heappop(queue)
        if item in final:
            continue
        final[item] = w
        if goal is not None and goal(item):
            break
        for to, weight in deduce(item, w):
            if to not in final:
                heapq.heappush(queue, (weight, to))
    return final


def edits(rows: list[Row]) -> Callable[[tuple, Weight], Iterator[tuple[tuple, Weight]]]:
    """The deductions from items (i, state) over rows."""

    def deduce(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
        (i, q), (cost, audit) = item, weight
        yield (i, DUE[q]), (cost + INSERT, audit + "I")
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            yield (i + 1, q), (cost + DELETE, audit + "D")
            if not must_go:
                more = TRUNCATED if truncated else 0
                yield (i + 1, DUE[q]), (cost + RELABEL + more, audit + "R")
                if (q, initial) in NEXT:
                    yield (i + 1, NEXT[q, initial]), (cost + more, audit + "K")

    return deduce


def lightest(rows: list[Row]) -> Weight:
    """The lightest repair of a whole conversation."""
    found = agenda({(0, START): (0, "")}, edits(rows), lambda item: item[0] == len(rows) and item[1] in GOALS)
    return list(found.values())[-1]


def block_items(rows: list[Row]) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, audit) of the lightest derivations through a block."""
    return [(p, q, *w) for p in STATES for (i, q), w in agenda({(0, p): (0, "")}, edits(rows)).items() if i == len(rows)]


def joined_items(blocks: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The same through neighbouring blocks: an item and a block's item give the next item."""
    by_state = [{p: [(q, c, a) for p2, q, c, a in items if p2 == p] for p in STATES} for items in blocks]

    def deduce(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
        (k, p), (cost, audit) = item, weight
        if k < len(by_state):
            for q, c, a in by_state[k][p]:
                yield (k + 1, q), (cost + c, audit + a)

    return [(p, q, *w) for p in STATES for (k, q), w in agenda({(0, p): (0, "")}, deduce).items() if k == len(blocks)]


def written(audit: str) -> Iterator[tuple[str, str | None]]:
    """The edits of an audit with the role each writes (None: the row's own, or no row). The pattern ends in an
    assistant's row, so an odd number of rows begins with a system's."""
    odd = sum(e != "D" for e in audit) % 2
    at = 0
    for e in audit:
        if e == "D":
            yield e, None
            continue
        at += 1
        yield e, None if e == "K" else "user" if (at - odd) % 2 else "assistant"


def faults(role_texts: list[tuple[str, str]]) -> list[str]:
    """blank, duplicate, truncated or nothing, for each row in order."""
    seen, out = set(), []
    for own in role_texts:
        bare = own[1].strip(_WHITE)
        out.append("blank" if not bare else "duplicate" if own in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add(own)
    return out


LEGAL = frozenset(("su", "ua", "au"))
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired_rows(role_texts: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    rows, out = iter(role_texts), []
    for e, role in written(audit):
        own = ("", "") if e == "I" else next(rows)
        if e != "D":
            out.append((role if role is not None else own[0], own[1]))
    return out


# Short conversations


def _short(rows: DataFrame, ties: list[str]) -> DataFrame:
    """A row a conversation: conv_id, counts, audit and the repaired turns."""
    kind = rows.schema["conv_id"].dataType
    parted = rows.select("conv_id", "turn", "role", "text", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)]).repartition("conv_id").sortWithinPartitions("conv_id", "turn", *[f"_t{i}" for i in range(len(ties))])
    parted = parted.select("conv_id", "turn", "role", "text")

    def one(turns: list[int | None], said: list[tuple[str, str]]) -> dict:
        marks = faults(said)
        cost, audit = lightest([(r[:1], m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(said, marks, strict=True)])
        known = [t for t in turns if t is not None]
        initials = [r[:1] for r, _ in said]
        counts = {k: marks.count(k) for k in ("blank", "duplicate", "truncated")}
        return counts | {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in repaired_rows(said, audit)]}

    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, turns, said, done, size, ids = None, [], [], [], 0, pa.null()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([d["conv_id"] for d in done], ids), *[pa.array([d[c] for d in done], pa.int64()) for c in COUNTS], pa.array([d["audit"] for d in done], pa.string()), pa.array([d["turns"] for d in done], turn_type)], names=["conv_id", *COUNTS, "audit", "turns"])
        for batch in batches:
            ids = batch.schema.field(0).type
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and conv != last:
                    done.append(one(turns, said) | {"conv_id": last})
                    turns, said = [], []
                    if len(done) >= 500 or size >= BLOCK_CHARS:
                        yield out()
                        done, size = [], 0
                last = conv
                turns.append(turn)
                said.append((role, text))
                size += len(text)
        if turns:
            done.append(one(turns, said) | {"conv_id": last})
        if done:
            yield out()

    return parted.mapInArrow(repaired, f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns array<struct<role:string,text:string>>")


# Long conversations


def _items(blocks: DataFrame, fold: Callable[[list], list], what: str) -> DataFrame:
    """Items (c, block, p, q, cost, audit) of lists (c, block, parts), stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, block, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p, q, cost, audit = zip(*fold(parts), strict=True)
                yield pa.RecordBatch.from_pydict({"c": [c] * len(p), "block": pa.array([block] * len(p), pa.int64()), "p": pa.array(p, pa.int32()), "q": pa.array(q, pa.int32()), "cost": pa.array(cost, pa.int64()), "audit": list(audit)})

    return materialize(blocks.select("c", "block", "parts").mapInArrow(found, "c string, block long, p int, q int, cost long, audit string"), what)


def _derivations(flags: DataFrame) -> DataFrame:
    """(c, cost, audit) of flags (c, rank, initial, must_go, truncated), conversations of any length."""
    listed = flags.groupBy("c", F.floor((F.col("rank") - 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "initial", "must_go", "truncated"))).alias("parts"))
    items = _items(listed, lambda parts: block_items([(r["initial"], r["must_go"], r["truncated"]) for r in parts]), "items")

    def join_blocks(parts: list[dict]) -> list:
        blocks: dict[int, list] = {}
        for r in parts:
            blocks.setdefault(r["block"], []).append((r["p"], r["q"], r["cost"], r["audit"]))
        return joined_items([blocks[b] for b in sorted(blocks)])

    while (items.agg(F.max("block")).first()[0] or 0) > 0:
        grouped = items.groupBy("c", F.floor(F.col("block") / FAN).alias("next")).agg(F.collect_list(F.struct("block", "p", "q", "cost", "audit")).alias("parts")).withColumnRenamed("next", "block")
        last, items = items, _items(grouped, join_blocks, "items")
        release(last)
    best = items.where((F.col("p") == START) & F.col("q").isin(*GOALS)).groupBy("c").agg(F.min(F.struct("cost", "audit")).alias("w"))
    return materialize(best.select("c", "w.cost", "w.audit"), "derivations")


def _steps(derivations: DataFrame) -> DataFrame:
    """(c, rank, edit, role, lines) for every row, and one past the last: its edit, the role that it gets, and the lines
    inserted before it."""

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())))], names=["c", "rank", "edit", "role", "lines"])
        for batch in batches:
            for c, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rank, lines = 1, []
                for e, role in written(audit):
                    if e == "I":
                        lines.append(role)
                        continue
                    done.append((c, rank, e, role, lines))
                    rank, lines = rank + 1, []
                    if len(done) >= 10_000:
                        yield out()
                        done.clear()
                done.append((c, rank, "", None, lines))
        if done:
            yield out()

    return derivations.select("c", "audit").mapInArrow(stepped, "c string, rank long, edit string, role string, lines array<string>")


def _long(rows: DataFrame, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, counts, audit), and (conv_id, rank, turns) of the repaired rows."""
    blank, ends = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    own = rows.select("conv_id", "c", "turn", "role", "text", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    cut = placed(own.drop("conv_id").withColumnRenamed("c", "conv_id"), ["conv_id", "turn", "role", "text"], "_t0", "_t1", [F.col(f"_t{i}") for i in range(2, len(ties))])
    ranked = materialize(running(cut, ["conv_id"], rank=Running(F.lit(1).cast("long"), "sum"), before=Running(F.struct(F.substring("role", 1, 1).alias("i")), "last", own=False)).withColumnRenamed("conv_id", "c"), "ranked")
    release(cut)
    marks = ranked.select("c", "turn", "rank", F.substring("role", 1, 1).alias("initial"), F.col("before.i").alias("before"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), (~F.col("text").rlike(blank)).alias("blank"), (~F.col("text").rlike(ends)).alias("open"))
    firsts = marks.groupBy("c", "digest").agg(F.min("rank").alias("rank")).select("c", "rank", F.lit(True).alias("first"))
    marks = marks.drop("digest").join(firsts, ["c", "rank"], "left")
    again = ~F.col("blank") & F.col("first").isNull()
    marks = materialize(marks.withColumns({"duplicate": again, "truncated": ~F.col("blank") & ~again & F.col("open"), "illegal": F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)}), "marks")
    gaps = marks.select("c", "turn").distinct().groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = marks.groupBy("c").agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])
    done = _derivations(marks.select("c", "rank", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated"))
    ids = rows.groupBy("c").agg(F.min("conv_id").alias("conv_id"))
    report = ids.join(gaps, "c").join(sums, "c").join(done, "c").select("conv_id", *COUNTS, "audit", "c")
    steps = _steps(done).withColumnRenamed("role", "new_role")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    inserted = F.transform("lines", lambda r: turn(r, F.lit("")))
    kept = F.when(F.col("edit").isin("K", "R"), F.array(turn(F.coalesce("new_role", "role"), F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    pieces = steps.join(ranked.select("c", "rank", "role", "text"), ["c", "rank"], "left").select("c", "rank", F.concat(inserted, kept).alias("turns")).where(F.size("turns") > 0)
    return materialize(report, "repairs"), pieces


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows of short conversations, and those of long ones if there are any; c names a conversation, null ones too."""
    named = rows.withColumn("c", F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")))
    sizes = named.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = materialize(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_CHARS)).select("c"), "long")
    if long.isEmpty():
        return named, None
    return named.join(small(long), "c", "left_anti"), named.join(small(long), "c", "left_semi")


def _lines(turns: str | Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def report(rows: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, and repaired_sha256 of the repaired `role:text` lines. ties: columns that order rows of one turn,
    role and text first."""
    ties = ties or ["role", "text"]
    short, long = _sides(rows)
    columns = ["conv_id", *COUNTS, "audit"]
    out = _short(short, ties).select(*columns, F.sha2(_lines("turns"), 256).alias("repaired_sha256"))
    if long is None:
        return out
    own, pieces = _long(long, ties)
    digests = ordered_digests(pieces.select("c", "rank", _lines("turns").alias("lines")), ["c"], ["rank"], "lines", "\n")
    return out.unionByName(own.join(digests, "c", "left").select(*columns, F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


def repaired(rows: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """(conv_id, block, place, role, text): the turns of all repaired conversations, by block and place."""
    ties = ties or ["role", "text"]
    short, long = _sides(rows)
    out = _short(short, ties).select("conv_id", F.lit(0).cast("long").alias("block"), F.posexplode("turns").alias("place", "t"))
    if long is not None:
        own, pieces = _long(long, ties)
        out = out.unionByName(pieces.join(own.select("c", "conv_id"), "c").select("conv_id", F.col("rank").alias("block"), F.posexplode("turns").alias("place", "t")))
    return out.select("conv_id", "block", "place", "t.role", "t.text")


# Damage


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties
    its text, 2 removes `.!?`, 3 repeats the row, 4 makes it a user's. Nulls count as one space. old_role, old_text and copy
    order the rows of one turn, so a repeated row stays next to the first."""
    blank = F.lit(" ")
    own = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    code = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", own("role").alias("old_role"), own("text").alias("old_text"), code.alias("code")).where("code <> 0")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("old_role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("old_text", ".!?", "")).otherwise(F.col("old_text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "old_role", "old_text", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


TIES = ["old_role", "old_text", "copy"]
