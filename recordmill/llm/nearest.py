"""Approximate nearest neighbours by collision-counting hashing with virtual rehashing.

Every vector is projected on each of PROJECTIONS random directions. In a shard of the table, each projection's values
are kept as one sorted array, with the place of every vector in it. A query opens a window around its own value in every
array, a range of places; a vector whose places fall into the windows of at least a threshold of projections (a collision
count) is a candidate. Windows grow by a factor (virtual rehashing: no array is built again) to the first that gives
enough candidates, ENOUGH and SHARE of the shard's rows, or holds all. Candidates are verified by their exact distance.
Each shard returns its nearest verified candidates, and the nearest of those over all shards are the answer.

Vectors that are null, all zeros, or hold a null or a component that isn't finite, or whose length isn't the most
common one, take no part, nor do rows whose id is null or no integer. Rows that repeat an id and its vector are dropped
first. Shards come from a hash of id and vector, so copies of one vector under many ids spread evenly. Queries meet shards
in blocks of bounded size; a shard's arrays are sorted once for each block, a small part of what a full block costs. Ties
go to the smaller id; an id that stands in several rows counts once, by its smallest distance, and so does a query id: its
neighbours are the nearest to any of its vectors. Empty tables give no rows.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTIONS = 128
#: Share of the projections that must collide.
THRESHOLD = 0.7
#: Half the first window, in standard deviations of a projection, and the factor by which windows grow.
START = 0.7
GROWTH = 1.1
STEPS = 32
#: Candidates that a shard gathers before it verifies them: this many, and this share of its rows.
ENOUGH = 200
SHARE = 0.02
SHARD_ROWS = 16384
QUERY_BLOCK = 2048
SEED = 7


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zeros."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(x) > 0) & sound & F.exists(x, lambda v: v != 0)


def directions(dimensions: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, projections))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, projections: int = PROJECTIONS) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the nearest verified candidates in one shard, at most k ids for each query; an
    id that stands in several rows counts once, by its smallest distance."""
    a = directions(vectors.shape[1], projections)
    values = vectors @ a
    n, distinct = len(ids), len(np.unique(ids))
    arrays = np.sort(values, axis=0).T.copy()  # one sorted array for each projection
    # where each vector stands in each array; a window is a range of places
    places = np.empty((projections, n), np.uint16 if n < 1 << 16 else np.uint32)
    for own, at in zip(places, np.argsort(values, axis=0, kind="stable").T, strict=True):
        own[at] = np.arange(n)
    enough = min(distinct, max(ENOUGH, k) + int(SHARE * n))
    need = math.ceil(THRESHOLD * projections)
    spread = float(np.median(np.std(values, axis=0))) or 1.0
    centres = (queries @ a).T
    radii = spread * START * GROWTH ** np.arange(STEPS)
    radii[-1] = np.inf  # the last window holds everything
    lows = np.stack([[own.searchsorted(c - r, "left") for own, c in zip(arrays, centres, strict=True)] for r in radii])
    sizes = np.stack([[own.searchsorted(c + r, "right") for own, c in zip(arrays, centres, strict=True)] for r in radii]) - lows
    lows, sizes = lows.astype(places.dtype), sizes.astype(places.dtype)

    def colliding(q: int, step: int) -> np.ndarray:
        """The vectors that fall into the windows of enough projections."""
        inside = places - lows[step, :, q, None] < sizes[step, :, q, None]  # places before a window wrap round to large ones
        return np.flatnonzero(sum(np.add.reduce(inside[i : i + 255].view(np.uint8), axis=0, dtype=np.uint8).astype(np.int32) for i in range(0, projections, 255)) >= need)

    def suffices(candidates: np.ndarray) -> bool:
        return len(candidates) >= enough and (distinct == n or len(np.unique(ids[candidates])) >= enough)

    found, step = [], 0
    for q, (qid, query) in enumerate(zip(query_ids, queries, strict=True)):
        # the first window that suffices; the search for it starts where the last query's ended
        candidates = colliding(q, step)
        if suffices(candidates):
            while step and suffices(less := colliding(q, step - 1)):
                candidates, step = less, step - 1
        else:
            while step < STEPS - 1 and not suffices(candidates):
                step += 1
                candidates = colliding(q, step)
        candidates = candidates[ids[candidates] != qid]
        distances = np.sqrt(((vectors[candidates] - query) ** 2).sum(axis=1))
        near = np.lexsort((ids[candidates], distances))
        for i in near[np.sort(np.unique(ids[candidates][near], return_index=True)[1])[:k]]:
            found.append((int(qid), int(ids[candidates[i]]), float(distances[i])))
    return found


def search(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col and score (Euclidean distance, in double precision) of the k nearest rows of table to each
    query, the query's own id left out."""
    clean = lambda df: df.select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))
    rows, asked = clean(table), clean(queries).dropDuplicates(["id", "v"])
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dimensions, count = sizes["d"], sizes["count"]
    shards, blocks = -(-count // SHARD_ROWS), max(1, -(-asked.count() // QUERY_BLOCK))
    rows, asked = rows.where(F.size("v") == dimensions).dropDuplicates(["id", "v"]), asked.where(F.size("v") == dimensions)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    left = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def matched(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        found = search_shard(b["id"].to_numpy(), np.stack(b["v"].to_numpy()), a["id"].to_numpy(), np.stack(a["v"].to_numpy()), k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(matched, "query_id long, id long, score double")
    near = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    # the k nearest of each query: a bounded list from every shard, merged
    ranked = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"))
