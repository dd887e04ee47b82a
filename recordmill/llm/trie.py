"""Prefix trie over conversations: which first turns conversations share, and what storing them once would save.

A node is a distinct sequence of first d turns (role, text); its members are the conversations that start with it. Turns
are named by a SHA-256 digest (its first 128 bits), a prefix by two 64-bit exclusive ors over its turns' digests mixed
with their depths, so that prefixes of a conversation of any length are running values (see operators/scan) and texts
don't travel past the first sort. Two of n prefixes share a name by chance with a probability of about n^2 / 2^129.

Most prefixes belong to one conversation. A count-min sketch over all prefix names screens them: counts are never too
low, so an estimate of one proves a prefix to be a singleton, and its node is emitted where its row lies. Only the other
prefixes, the possibly shared ones, are shuffled and grouped exactly. The sketch has ROWS rows of counters that stop at
two, twice as many a row as there are prefixes, MAX_WIDTH at most: beyond that more singletons are grouped exactly, which
changes no result.

Sums over subtrees: each node belongs to its smallest member, so a node's sum is that over its members of what belongs to
them from its depth on: running sums from the end of a conversation, in blocks, then a grouped sum.

Null roles and texts count as empty; rows whose conv_id is null or no integer take no part; rows of one turn go by role
and text, repeated rows are turns of their own. An empty table gives an empty trie. Extra columns may have any names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.conversations import chunked, ordered_digests, placed
from recordmill.operators.scan import PLACE, RANGE, Running, running
from recordmill.session import materialize, release, small

ROWS, MIN_WIDTH, MAX_WIDTH = 3, 1 << 12, 1 << 24
#: Bytes of a sketch that travel as one row, and depths whose running sums are one window group.
CHUNK, BLOCK = 1 << 16, 4096
NODE = ["depth", "k1", "k2"]


def _mixed(seed: int, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth.cast("long"), digest)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, digest, bytes) of every turn, stored as ranges in order."""
    own = conversations.select(F.col("conv_id").cast("string").try_cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    cut = placed(own, ["conv_id", digest.alias("digest"), F.octet_length("text").alias("bytes")], "role", "text")
    ranked = materialize(running(cut, ["conv_id"], rank=Running(F.lit(1).cast("long"), "sum")), "turns")
    release(cut)
    return ranked


def rebuilt_prefixes(ranked: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """All prefixes of all rebuilt conversations, stored: (conv_id, depth, k1, k2, x1, x2, bytes, is_end); x1 and x2 are
    what the last turn adds to k1 and k2, bytes are its text's.

    A conversation c takes the first h = crc32(c) mod (most + 1) turns of c - c mod every, then its own without its first
    h. Depth 0 stands once for each conversation.
    """
    c = F.col("conv_id")
    sizes = ranked.groupBy("conv_id").agg(F.max("rank").alias("n"))
    first = ranked.where((c % every == 0) & (F.col("rank") <= most)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "bytes"))).alias("first"))
    held = sizes.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % (most + 1), "base": c - c % every}).join(first, "base", "left")
    held = held.withColumn("heads", F.coalesce(F.slice("first", 1, F.col("h").cast("int")), F.array().cast(first.schema["first"].dataType)))
    folded = lambda seed, n: F.aggregate(F.slice("heads", 1, n), F.lit(0).cast("long"), lambda k, t: k.bitwiseXOR(_mixed(seed, t["rank"], t["digest"])))
    nb = F.size("heads")
    heads = materialize(held.select("conv_id", "h", "heads", nb.alias("nb"), folded(1, nb).alias("b1"), folded(2, nb).alias("b2"), (nb + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "heads")

    at_end = lambda depth: (depth == F.col("total")).alias("is_end")
    nothing = [F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "x1", "x2")]
    root = heads.select("conv_id", F.lit(0).cast("long").alias("depth"), *nothing, F.lit(0).alias("bytes"), at_end(F.lit(0)))
    each = F.transform("heads", lambda t, i: F.struct(t["rank"].alias("depth"), folded(1, i + 1).alias("k1"), folded(2, i + 1).alias("k2"), _mixed(1, t["rank"], t["digest"]).alias("x1"), _mixed(2, t["rank"], t["digest"]).alias("x2"), t["bytes"].alias("bytes")))
    lent = heads.select("conv_id", "total", F.explode(each).alias("p")).select("conv_id", "p.*", at_end(F.col("p.depth")))
    own = ranked.join(small(heads.select("conv_id", "h", "nb", "b1", "b2", "total")), "conv_id").where("rank > h").withColumn("depth", F.col("rank") - F.col("h") + F.col("nb"))
    own = own.withColumns({f"x{s}": _mixed(s, F.col("depth"), F.col("digest")) for s in (1, 2)}).drop("digest", "rank", "h", "nb")
    own = running(own, ["conv_id"], o1=Running(F.col("x1"), "xor"), o2=Running(F.col("x2"), "xor"))
    own = own.select("conv_id", "depth", F.col("o1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("o2").bitwiseXOR(F.col("b2")).alias("k2"), "x1", "x2", "bytes", at_end(F.col("depth")))
    out = materialize(root.unionByName(lent).unionByName(own), "prefixes")
    release(heads)
    return out


# Screening


@dataclasses.dataclass
class Sketch:
    counts: np.ndarray  # ROWS x width, saturating at two

    @staticmethod
    def places(k1: np.ndarray, k2: np.ndarray, width: int) -> np.ndarray:
        a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
        return np.stack([(a + np.uint64(r) * b) & np.uint64(width - 1) for r in range(ROWS)]).astype(np.int64)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for row, at in zip(self.counts, self.places(k1, k2, self.counts.shape[1]), strict=True):
            places, n = np.unique(at, return_counts=True)
            row[places] = np.minimum(row[places] + np.minimum(n, 2), 2)

    def estimate(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.counts, self.places(k1, k2, self.counts.shape[1]), 1).min(axis=0) if len(k1) else np.zeros(0, np.uint8)


def width_for(prefixes: int) -> int:
    return min(MAX_WIDTH, max(MIN_WIDTH, 1 << (2 * prefixes - 1).bit_length()))


def sketch(prefixes: DataFrame) -> Sketch:
    """A count-min sketch over k1 and k2. Each task counts its rows in a sketch of its own and gives it by chunks; chunks of
    one place are added up as they stream by, and the whole, MAX_WIDTH * ROWS bytes at most, comes to the driver."""
    keys = prefixes.where("depth > 0").select("k1", "k2")
    total = keys.count()
    width = width_for(total)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(np.zeros((ROWS, width), np.uint8))
        for batch in batches:
            own.add(*(batch.column(i).to_numpy() for i in (0, 1)))
        flat = own.counts.reshape(-1)
        for start in range(0, len(flat), CHUNK):
            part = flat[start : start + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([start], pa.int64()), "counts": pa.array([part.tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        out = lambda: pa.RecordBatch.from_pydict({"chunk": pa.array([last], pa.int64()), "counts": pa.array([held.tobytes()], pa.binary())})
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(part, np.uint8)
                if chunk != last:
                    if last is not None:
                        yield out()
                    last, held = chunk, one
                else:
                    held = np.minimum(held + one, 2)
        if last is not None:
            yield out()

    # tasks' sketches together stay about as large as the names that they count
    parts = keys.coalesce(max(8, 16 * total // (ROWS * width))).mapInArrow(counted, "chunk long, counts binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk long, counts binary")
    flat = np.zeros(ROWS * width, np.uint8)
    for row in merged.toLocalIterator():
        flat[row["chunk"] : row["chunk"] + len(row["counts"])] = np.frombuffer(row["counts"], np.uint8)
    return Sketch(flat.reshape(ROWS, width))


def screened(prefixes: DataFrame) -> DataFrame:
    """prefixes with p1 and p2, the parent's name, and one and parent_one: proven to be of one conversation. Stored."""
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes))

    @F.arrow_udf("boolean")
    def one(k1: pa.Array, k2: pa.Array) -> pa.Array:
        return pa.array(shared.value.estimate(k1.to_numpy(), k2.to_numpy()) == 1)

    parent = {f"p{s}": F.col(f"k{s}").bitwiseXOR(F.col(f"x{s}")) for s in (1, 2)}
    own = prefixes.withColumns(parent).select("conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "is_end", (one("k1", "k2") & (F.col("depth") > 0)).alias("one"), (one("p1", "p2") & (F.col("depth") > 1)).alias("parent_one"))
    out = materialize(own, "screened")
    shared.destroy()
    return out


# Nodes


def nodes(prefixes: DataFrame) -> DataFrame:
    """Every node of the trie over prefixes (see rebuilt_prefixes), with counts over its members, children and subtree."""
    p = screened(prefixes)
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    wide = p.where("NOT one")
    groups = materialize(wide.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "groups")
    alone = p.where("one")
    below = groups.where("depth > 0").select(*up).unionByName(alone.where("NOT parent_one").select(*up))
    families = materialize(groups.join(below.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")), NODE, "left").fillna(0, ["n_children"]), "families")
    release(groups)

    ends = ordered_digests(chunked(wide.where("is_end").select(*NODE, "conv_id", F.col("conv_id").cast("string").alias("id")), NODE, "conv_id", "id", ","), NODE, ["conv_id"], "id", ",")
    leaves = alone.where("is_end").select("conv_id").unionByName(families.where("n_children = 0").select("conv_id")).withColumn("leaf", F.lit(1).cast("long"))
    sums = _subtrees(wide.select("conv_id", *NODE), families, leaves)
    root = families.where("depth = 0").select("conv_id").first()
    one_up = F.lit(root["conv_id"] if root else None).cast("long")
    parents = small(materialize(families.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")).where("depth > 1"), "parents"))
    nothing = F.sha2(F.lit(""), 256)

    grouped = families.join(parents, ["depth", "p1", "p2"], "left").join(ends, NODE, "left").join(sums, NODE, "left")
    # a parent that isn't grouped is one conversation's, and so is the node
    above = F.when(F.col("depth") == 1, one_up).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
    counts = [F.col("n_convs"), F.col("n_children"), F.coalesce("leaves", F.lit(0).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens")]
    shared = grouped.select("conv_id", "depth", above.alias("parent_conv_id"), *counts, F.coalesce("sha256", nothing).alias("ends_sha256"))
    lone = alone.where("NOT parent_one").join(parents, ["depth", "p1", "p2"], "left").select("conv_id", "depth", "is_end", above.alias("parent_conv_id"))
    lone = lone.unionByName(alone.where("parent_one").select("conv_id", "depth", "is_end", F.col("conv_id").alias("parent_conv_id")))
    long = lambda x: F.lit(x).cast("long")
    tails = lone.select("conv_id", "depth", "parent_conv_id", long(1).alias("n_convs"), F.when(F.col("is_end"), long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return shared.unionByName(tails)


def _subtrees(members: DataFrame, families: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, leaves, saved) of nodes with members (conv_id, node)."""
    weights = families.where("n_convs > 1 AND bytes > 0").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"))
    own = members.join(weights, ["conv_id", "depth"], "left").join(leaves, "conv_id", "left")
    own = own.withColumns({"w": F.coalesce("w", F.lit(0).cast("long")), "leaf": F.coalesce("leaf", F.lit(0).cast("long")), "block": F.floor(F.col("depth") / BLOCK)})
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("conv_id", "block").agg(F.sum("w").alias("all")).select("conv_id", "block", F.sum("all").over(later).alias("more")).where("more > 0")
    met = own.withColumn("s", F.sum("w").over(within)).join(carried, ["conv_id", "block"], "left")
    return met.groupBy(*NODE).agg(F.sum("leaf").alias("leaves"), F.sum(F.col("s") + F.coalesce("more", F.lit(0).cast("long"))).alias("saved"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of a table (conv_id, turn, role, text)."""
    ranked = turns(conversations)
    prefixes = rebuilt_prefixes(ranked)
    release(ranked)
    return nodes(prefixes)
