"""Sentences: splitting, reuse over the corpus, alignment of matched records, and word differences."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.functions.text import SPACE, normalize, trim

#: Sentence ends, the shortest normal form that counts as reused, and the limits of a similar sentence.
SENTENCE = f"[^.!?。！？]+[.!?。！？]?{SPACE}*"
LEAST_LENGTH = 8
SIMILAR_SCORE, SIMILAR_SHARED = 0.5, 3
TOP = 8
_PLACES = pa.list_(pa.struct([("exact", pa.bool_()), ("score", pa.float64()), ("shared", pa.int32()), ("at", pa.int32())]))


def split(text: Column) -> Column:
    """The sentences of a text, blank ones left out; the whole text if there is none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: s.rlike(f"[^{SPACE[1:]}"))
    # bound to a name of the row, so that a text is split once
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))[0]


def exploded(records: DataFrame) -> DataFrame:
    """(record_order, at, sentence, norm) of every sentence of every record. No record is without one; the outer form
    keeps the optimiser from splitting each text again to test for that."""
    each = records.select("record_order", F.posexplode_outer(split(F.col("text"))).alias("at", "sentence"))
    return each.select("record_order", "at", "sentence", normalize(F.col("sentence")).alias("norm"))


def reuse(records: DataFrame) -> DataFrame:
    """(norm, n_records) of sentences of at least LEAST_LENGTH characters: in how many records each stands. A record's
    own repeats are dropped before anything is shuffled."""
    norms = F.filter(F.array_distinct(F.transform(split(F.col("text")), normalize)), lambda s: F.length(s) >= LEAST_LENGTH)
    each = records.select(F.explode_outer(norms).alias("norm")).where("norm IS NOT NULL")
    return each.groupBy("norm").agg(F.count(F.lit(1)).alias("n_records"))


def reused_top(records: DataFrame, top: int = TOP) -> DataFrame:
    """(record_order, rank, sentence, n_records): each record's sentences that other records have too, most used first,
    then in the record's order."""
    shared = reuse(records).where("n_records >= 2")
    each = exploded(records).where(F.length("norm") >= LEAST_LENGTH).join(shared, "norm")
    first = each.groupBy("record_order", "norm").agg(F.min("at").alias("at"), F.min_by("sentence", "at").alias("sentence"), F.first("n_records").alias("n_records"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("record_order").orderBy(F.desc("n_records"), "at")))
    return ranked.where(F.col("rank") <= top).select("record_order", "rank", trim(F.col("sentence")).alias("sentence"), "n_records")


def best_places(norms: list[str], others: list[str]) -> list[tuple[bool, float, int, int]]:
    """(exact, score, words shared, place) of the best of other sentences for each sentence, by their normal forms; place
    is -1 where no word is shared. Only sentences that share a word are compared, by counting over an index of words."""
    words = lambda norm: list(dict.fromkeys(w for w in norm.split(" ") if len(w) > 1))
    first: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    sizes = []
    for at, norm in enumerate(others):
        first.setdefault(norm, at)
        own = words(norm)
        sizes.append(len(own))
        for w in own:
            places.setdefault(w, []).append(at)
    out = []
    for norm in norms:
        own = words(norm)
        if len(norm) >= LEAST_LENGTH and norm in first:
            out.append((True, 1.0, len(own), first[norm]))
            continue
        shared: dict[int, int] = {}
        for w in own:
            for at in places.get(w, ()):
                shared[at] = shared.get(at, 0) + 1
        score, early = max(((k / (len(own) + sizes[at] - k), -at) for at, k in shared.items()), default=(0.0, 1))
        out.append((False, score, shared.get(-early, 0), -early))
    return out


def align(pairs: DataFrame) -> DataFrame:
    """For each sentence of a record the best sentence of its match. pairs: record_order, text, match_text. Level exact:
    equal normal forms of at least LEAST_LENGTH characters, the first such; similar: a word Jaccard similarity of at
    least SIMILAR_SCORE with SIMILAR_SHARED words shared; none otherwise. Ties go to the earlier sentence. A pair is one
    row throughout: no join of sentences, and pairs is read once."""

    @F.arrow_udf("array<struct<exact:boolean,score:double,shared:int,at:int>>")
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for own, other in batches:
            rows = [best_places(a, b) for a, b in zip(own.to_pylist(), other.to_pylist(), strict=True)]
            yield pa.array([[dict(zip(("exact", "score", "shared", "at"), r, strict=True)) for r in row] for row in rows], _PLACES)

    split_ = pairs.select("record_order", split(F.col("text")).alias("a"), split(F.coalesce("match_text", F.lit(""))).alias("b"))
    met = split_.withColumn("m", places(F.transform("a", normalize), F.transform("b", normalize)))
    each = met.select("record_order", "b", F.posexplode_outer(F.arrays_zip(F.col("a").alias("s"), F.col("m").alias("m"))).alias("at", "z"))
    m = F.col("z.m")
    level = F.when(m["exact"], "exact").when((m["score"] >= SIMILAR_SCORE) & (m["shared"] >= SIMILAR_SHARED), "similar").otherwise("none")
    return each.select("record_order", "at", F.col("z.s").alias("sentence"), level.alias("level"), m["score"].alias("score"), m["at"].alias("match_at"), F.coalesce(F.get("b", m["at"]), F.lit("")).alias("match_sentence"))


def exact_count(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("record_order").agg(F.count_if(F.col("level") == "exact").alias("exact_sentences"))


_PIECE = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+|\s+")


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence with b: from the ends backwards, equal items are taken, else a's item is
    dropped where that loses nothing, else b's.

    A row of the table of lengths is an integer whose zero bits mark where lengths grow along b, made from the row above in
    a few operations on whole integers. Rows are kept at every square root of their number, and those between two kept
    ones are made again when the way back comes to them."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    step = max(1, math.isqrt(len(a)))

    def below(row: int, x: str) -> int:
        hit = row & at.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    kept, row = [full], full
    for i, x in enumerate(a, 1):
        row = below(row, x)
        if i % step == 0:
            kept.append(row)
    out: list[int] = []
    i, j = len(a), len(b)
    rows: list[int] = []
    base = len(a) + 1
    while i and j:
        if i - 1 < base:  # rows base to i of the next block back
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for x in a[base : base + step]:
                rows.append(below(rows[-1], x))
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            continue
        mask = (1 << j) - 1
        # as many zero bits in both rows: the length above is the same
        if (rows[i - 1 - base] & mask).bit_count() == (rows[i - base] & mask).bit_count():
            i -= 1
        else:
            j -= 1
    return out[::-1]


def word_diff(text: str, other: str) -> list[tuple[str, bool]]:
    """Runs of a text and whether their words are missing from the longest common subsequence with the other text.
    Words are compared by their compatible lower-case form; where two paths are as long, the left word is dropped."""
    form = lambda p: unicodedata.normalize("NFKC", p).lower() if p[:1].isalnum() else ""
    pieces = _PIECE.findall(text) or [text]
    a = [(i, form(p)) for i, p in enumerate(pieces) if form(p)]
    b = [form(p) for p in _PIECE.findall(other) if form(p)]
    same = {a[i][0] for i in common([x for _, x in a], b)}
    runs: list[tuple[str, bool]] = []
    for k, p in enumerate(pieces):
        changed = bool(form(p)) and k not in same
        if runs and runs[-1][1] == changed:
            runs[-1] = (runs[-1][0] + p, changed)
        else:
            runs.append((p, changed))
    return runs


def differences(aligned: DataFrame) -> DataFrame:
    """aligned's similar sentences with the array of runs that differ from their match."""

    @F.pandas_udf("array<struct<text:string,changed:boolean>>")
    def diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([[{"text": t, "changed": c} for t, c in word_diff(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    return aligned.where("level = 'similar'").withColumn("runs", diff("sentence", "match_sentence"))
