"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of a text's features.
Features are the word shingles, repeats included, or (distinct=True) each once; a text with fewer words than a shingle
is one feature, one without words has fingerprint 0 and links like any other. Null texts have no words.

Search: fingerprints are cut into segments. By the pigeonhole principle, two of distance r or less differ by no more
than a small radius within one segment; so each fingerprint looks up the Hamming ball of that radius around each of its
segments in that segment's table, and matches are verified over all 64 bits. Equal fingerprints are one node, however
many rows have them. Members of a bucket are first linked with its smallest and its largest fingerprint, where these
are near enough; after that, only pairs from different components can add anything, so a dense group doesn't give all
its pairs. Buckets of over HOT members that still hold several components are linked through shared midpoints instead
(two fingerprints within 2k bits share a point within k bits of both), which is exact and grows with the members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import keep_free, words
from recordmill.llm.graph import components
from recordmill.session import materialize, small

BITS = 64
SEED = 42
HOT = 2048
DENSE = 48
BLOCK = 1 << 15


def fingerprint_of(features: list[str]) -> int:
    """Unsigned fingerprint of a list of features; 0 for none."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(features), BLOCK):
        part = features[start : start + BLOCK]
        hashes = np.fromiter((digest(f.encode("utf-8", "surrogatepass"), SEED) for f in part), dtype=">u8", count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(features)).tobytes(), "big")


def shingles(text: str | None, size: int, distinct: bool = False) -> list[str]:
    own = words(text)
    if size > 1:
        found = [" ".join(own[i : i + size]) for i in range(len(own) - size + 1)] or ([" ".join(own)] if own else [])
    else:
        found = own
    return sorted(set(found)) if distinct else found


def fingerprint(text: Column, size: int = 4, distinct: bool = False) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint_of(shingles(x, size, distinct)) for x in batch.to_pylist()], dtype=np.uint64)
            yield pa.array(found.view(np.int64))

    return of(text)


def layout(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(offset, width, ball radius) of each segment: distance <= radius implies a match within one of these balls."""
    ball, rest = divmod(radius, segments)
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), w, ball if i <= rest else ball - 1) for i, w in enumerate(widths)]


def balls(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _segment(offset: int, width: int, of: str = "fp") -> Column:
    return F.shiftrightunsigned(F.col(of), offset).bitwiseAND(F.lit((1 << width) - 1))


def _ball(own: Column, masks: Column) -> Column:
    """The values around own that aren't smaller than it."""
    return F.filter(F.transform(masks, lambda m: own.bitwiseXOR(m)), lambda k: k >= own)


def _midpoints(nodes: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints that share a point within half the radius (rounded up) of both, near enough only."""
    masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in balls(BITS, (radius + 1) // 2)])
    points = nodes.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if radius % 2 == 0:  # all that share a point are within the radius of each other
        return points.join(least, "point").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    pairs = points.join(points.select("point", F.col("fp").alias("m")), "point").where("fp < m")
    return pairs.where(_distance("fp", "m") <= radius).select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = 4, segments: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b) links of distance <= radius between distinct fingerprints (column fp) that join the same components as
    all such links would. Every link is verified over all bits."""
    parts = layout(radius, segments)
    tables = [nodes.select(F.lit(i).alias("seg"), _segment(o, w).cast("int" if w < 32 else "long").alias("key"), "fp") for i, (o, w, r) in enumerate(parts) if r >= 0]
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    buckets = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    largest = buckets.agg(F.max("n")).first()[0] or 0
    found = None
    labelled = nodes.withColumn("part", F.col("fp"))
    if largest > DENSE:  # stars first
        stars = table.join(buckets.where("n > 1").drop("n"), ["seg", "key"])
        stars = stars.select("fp", F.explode(F.array("low", "high")).alias("m")).where((F.col("fp") != F.col("m")) & (_distance("fp", "m") <= radius))
        found = materialize(stars.select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        groups = components(found)
        labelled = materialize(nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part")), "parts")
    members, probes = [], []
    for i, (o, w, r) in enumerate(parts):
        if r < 0:
            continue
        kind = "int" if w < 32 else "long"
        own = _segment(o, w)
        masks = F.array(*[F.lit(m).cast("long") for m in balls(w, r)])
        # of two fingerprints the one with the smaller segment looks up; equal segments meet once, by the join's condition
        ball = _ball(own, masks)
        members.append(labelled.select(F.lit(i).alias("seg"), own.cast(kind).alias("key"), F.col("fp").alias("b"), F.col("part").alias("part_b")))
        probes.append(labelled.select(F.lit(i).alias("seg"), F.explode(ball.cast(f"array<{kind}>")).alias("key"), F.col("fp").alias("a"), F.col("part").alias("part_a"), own.cast(kind).alias("own")))
    member, probe = members[0], probes[0]
    for m, p in zip(members[1:], probes[1:], strict=True):
        member, probe = member.unionByName(m), probe.unionByName(p)
    if largest > hot:
        crowded = materialize(member.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"), F.min("part_b").alias("lo"), F.max("part_b").alias("hi")).where(F.col("n") > hot), "crowded")
        meeting = probe.join(crowded, ["seg", "key"]).groupBy("seg", "key").agg(F.min(F.least("part_a", "lo")).alias("lo"), F.max(F.greatest("part_a", "hi")).alias("hi"))
        mixed = meeting.where("lo <> hi").select("seg", "key")
        flagged = member.join(mixed, ["seg", "key"], "left_semi").select(F.col("b").alias("fp")).unionByName(probe.join(mixed, ["seg", "key"], "left_semi").select(F.col("a").alias("fp"))).distinct()
        far = _midpoints(flagged, radius)
        found = far if found is None else found.unionByName(far)
        probe = probe.join(crowded.select("seg", "key"), ["seg", "key"], "left_anti")
    near = probe.join(member, ["seg", "key"]).where((F.col("part_a") != F.col("part_b")) & (_distance("a", "b") <= radius) & ((F.col("key") != F.col("own")) | (F.col("a") < F.col("b"))))
    near = near.select("a", "b")
    return near if found is None else near.unionByName(found)


def groups(rows: DataFrame, fp_col: str = "fp", radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """rows with component_id: the smallest id_col reachable over links of radius or fewer differing bits (null only if
    all reachable ids are null). Repeated rows stay, each with its component."""
    nodes = rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    nodes = materialize(nodes, "fingerprints")
    count = nodes.count()
    found = components(links(nodes.select("fp"), radius, 3 if count < 1 << 27 else 2))
    merged = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = materialize(merged.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    label = merged.join(small(least), "component", "left").withColumn("component_id", F.coalesce("component_id", "least")).select(F.col("fp").alias(keep_free(rows.columns, "node")), "component_id")
    node = label.columns[0]
    return rows.join(label, rows[fp_col] == label[node], "left").drop(node)


def components_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, radius: int = 4, distinct: bool = False) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every row of docs."""
    marked = docs.select(F.col(id_col), fingerprint(F.col(text_col), size, distinct).alias("fp"))
    marked = materialize(marked, "marked")
    return groups(marked, "fp", radius, id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
