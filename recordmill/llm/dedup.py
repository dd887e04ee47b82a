"""One document of each group of near copies.

Exact copies of a text are one text; a text goes only if its five-word shingles have a Jaccard similarity of SIMILARITY
or more with a text that stays, and no two texts that stay are that similar.

First, large groups shrink at a cost that grows with their texts only: texts whose fingerprints (SimHash over distinct
words, multi-index hashing) link within RADIUS bits are in one group, and groups of at least LARGE texts take part in
ROUNDS rounds. In each, every group names one leader, the text nearest to the group's majority fingerprint; those similar
to it go for now. From the third round on, a group's rest is cut further by a MinHash of the shingles, so that many
leaders work side by side. The rounds only save work: what they leave uncompared is compared in the join that follows.

Then all that is left, near in fingerprints or not, is joined exactly: two sets that are similar share a shingle among
the first n - ceil(0.8 n) + 1 of each in any common order, and its places bound what else they can share. The order puts
shingles that are frequent in a sample last; the sample changes the cost, not the pairs. Shingles that stand in one
prefix only leave after one shuffle. Pairs are verified by their whole sets, then settled: leaders before others, smaller
ids first, a text stays if no similar one before it does. What a leader took that itself goes is opened again and
settled against all that stay.

Texts are shuffled only where the list of those wanted is too long to be broadcast; both ways give the same rows. Tables
that nothing reads any more are deleted at once.

Documents with null texts are exact copies of each other and of empty texts; the smallest id stays, a null id only if
all are null. Rows that repeat an id with the same text are copies as well: of them the row whose columns come first as
JSON stays. Columns stay as they are, whatever their names and types. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm import simhash
from recordmill.llm.common import keep_free, quoted
from recordmill.session import materialize, release, small

RADIUS = 5
SIMILARITY = 0.8
SHINGLE = 5
MEDOID_ROUNDS = 2
ROUNDS = 6
#: Groups under this size go to the exact join at once. Members of a group that one task compares with their leader.
LARGE = 16
SHARE_ROWS = 256
#: Texts (about) whose shingles give the order of the exact join, the shingles that are put last, and the least count of these.
SAMPLE = 20_000
FREQUENT = 50_000
SEEN = 3


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text without words has the empty one."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in simhash.shingles(text, size) or [""]], np.uint64).view(np.int64))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    @F.arrow_udf("array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(x, size) for x in batch.to_pylist()], pa.list_(pa.int64()))

    return hashed(text)


def frequent_shingles(texts: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles of about SAMPLE texts, rare before frequent."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64(text_col, F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = sample.select(F.explode(shingle_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.array([r["h"] for r in most.collect()][::-1], np.int64)


def prefix_of(own: np.ndarray, frequent: np.ndarray, places: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the common order; frequent is sorted, places are the ranks of its items."""
    late = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = np.where(frequent[at] == own, places[at] + 1, 0)
    return own[np.lexsort((own, late))][: len(own) - math.ceil(least * len(own) - 1e-9) + 1]


def prefixes(text: Column, order: np.ndarray) -> Column:
    """The size of a text's shingle set, and after it the set's prefix."""
    places = np.argsort(order)
    frequent = order[places]

    @F.arrow_udf("array<long>")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(x) for x in batch.to_pylist()]
            yield pa.array([np.concatenate([[len(own)], prefix_of(own, frequent, places)]) for own in sets], pa.list_(pa.int64()))

    return first(text)


def _centre(fp: str) -> Column:
    """The majority fingerprint of a group."""
    bits = [F.when(F.sum(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(1))) * 2 > F.count(F.lit(1)), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def similar(a: Column, b: Column, least: float = SIMILARITY) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= least * (F.size(a) + F.size(b) - shared)


def dropped(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """texts(tid, part, fp, sh), a stored table that is deleted in the end: (tid, leader) of texts that are similar to a
    leader that doesn't go."""
    gone = texts.select("tid", F.col("tid").alias("leader")).limit(0)
    rest, done = texts, texts
    for k in range(rounds):
        if rest.isEmpty():
            break
        if k < MEDOID_ROUNDS:
            keyed = rest.withColumn("key", F.col("part"))
        else:  # the smallest shingle under another hash in each round
            least = F.array_min(F.transform("sh", lambda x, k=k: F.xxhash64(x, F.lit(k))))
            keyed = rest.withColumn("key", F.xxhash64("part", least))
        centres = materialize(keyed.groupBy("key").agg(_centre("fp").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centres")
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
        nearest = keyed.select("key", "tid", "fp").join(small(centres), "key").groupBy("key").agg(F.min(F.struct(far.alias("far"), "tid"))["tid"].alias("leader"), F.first("n").alias("n"))
        leaders = materialize(nearest, "leaders")
        if leaders.isEmpty():
            break
        # a leader meets its group in as many tasks as the group's size asks for
        shares = F.ceil(F.col("n") / SHARE_ROWS)
        own = keyed.select("tid", F.col("sh").alias("head")).join(small(leaders.select("key", F.col("leader").alias("tid"), "n")), "tid")
        heads = own.select("key", "head", F.explode(F.sequence(F.lit(0), shares.cast("int") - 1)).alias("share"))
        members = keyed.join(small(leaders), "key", "left").withColumn("share", F.pmod(F.xxhash64("tid"), shares).cast("int"))
        state = F.when(F.col("leader").isNull(), 0).when(F.col("leader") == F.col("tid"), 1).when(similar(F.col("sh"), F.col("head")), 2).otherwise(0)
        before, done = done, materialize(members.join(heads, ["key", "share"], "left").select("tid", "part", "fp", "sh", "leader", state.alias("state")), "round")
        gone = gone.unionByName(materialize(done.where("state = 2").select("tid", "leader"), "taken"))
        release(before, centres, leaders)
        rest = done.where("state = 0").drop("state", "leader")
    release(done)
    return gone


def _placed(sets: DataFrame) -> DataFrame:
    """sets(tid, rank, prefix): a row for each shingle of the prefixes. size, place and rank are packed in one number."""
    each = sets.select("tid", "rank", F.element_at("prefix", 1).alias("n"), F.posexplode("prefix").alias("at", "h")).where("at > 0")
    return each.select("h", "tid", F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 2)).bitwiseOR(F.col("rank").cast("long")).alias("info"))


def pairs(sets: DataFrame, others: DataFrame | None = None, least: float = SIMILARITY) -> DataFrame:
    """sets(tid, rank, prefix): (a, b) candidates, a before b by rank and tid. With others (the same columns), pairs
    among sets and between sets and others, not among others."""
    rows = _placed(sets)
    if others is None:
        # counted where the rows lie, so that a shingle of very many texts is no task of its own
        often = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "often")
        left = materialize(rows.join(small(often), "h", "left_semi"), "shared")
        right = left
        release(often)
    else:
        left = materialize(rows, "shared")
        right = left.unionByName(_placed(others).join(small(materialize(left.select("h").distinct(), "wanted")), "h", "left_semi"))
    x, y = (df.select("h", F.col("tid").alias(f"tid_{e}"), F.shiftright("info", 32).alias(f"n_{e}"), F.shiftright("info", 2).bitwiseAND(F.lit((1 << 30) - 1)).alias(f"at_{e}"), F.col("info").bitwiseAND(F.lit(3)).alias(f"rank_{e}")) for df, e in ((left, "a"), (right, "b")))
    near = (F.col("n_a") >= least * F.col("n_b") - 1e-6) & (F.col("n_b") >= least * F.col("n_a") - 1e-6)
    sides = [("a", "b"), ("n_a", "n_b"), ("at_a", "at_b")]
    x, y = x.withColumnRenamed("tid_a", "a"), y.withColumnRenamed("tid_b", "b")
    before = (F.col("rank_a") < F.col("rank_b")) | ((F.col("rank_a") == F.col("rank_b")) & (F.col("a") < F.col("b")))
    if others is None:
        met = x.join(y, "h").where(before & near).select("h", "a", "b", "n_a", "n_b", "at_a", "at_b")
    else:  # two of sets meet in both orders
        turned = [F.when(before, F.col(c)).otherwise(F.col(d)).alias(e) for c, d in sides for e, c, d in ((c, c, d), (d, d, c))]
        met = x.join(y, "h").where((F.col("a") != F.col("b")) & near).select("h", *turned).distinct()
    # the first shared shingle and all behind it must be enough; what isn't shared in both prefixes stands behind the one that ends first
    enough = (F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - 1e-6
    first = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    behind = F.greatest(*[F.ceil(F.lit(least) * F.col(n) - 1e-9) - 1 for n in ("n_a", "n_b")])
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("k"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    counted = met.where((F.col("k") + behind >= enough) & (first >= enough))
    found = materialize(counted.select("a", "b"), "pairs")
    release(left)
    return found


def settled(edges: DataFrame) -> DataFrame:
    """edges(a, b), a stored table that is deleted on the way, a before b: the b that go because a similar text before them
    stays."""
    gone = edges.select(F.col("b").alias("tid")).limit(0)
    while not edges.isEmpty():
        stay = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = materialize(edges.join(stay, "a", "left_semi").select(F.col("b").alias("tid")).distinct(), "out")
        gone = gone.unionByName(out)
        last, edges = edges, materialize(edges.join(out.withColumnRenamed("tid", "a"), "a", "left_anti").join(out.withColumnRenamed("tid", "b"), "b", "left_anti").select("a", "b"), "edges")
        release(last)
    return gone


def resolved(sets: DataFrame, stars: DataFrame, shingled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sets(tid, prefix), stars(tid, leader) and a function that gives (tid, sh) of given tids: the tids that go."""
    gone = materialize(stars.select("tid").distinct(), "gone")
    leaders = materialize(stars.select(F.col("leader").alias("tid")).distinct(), "leaders")
    ranked = sets.join(small(gone), "tid", "left_anti").join(small(leaders.withColumn("first", F.lit(True))), "tid", "left")
    found = pairs(ranked.select("tid", "prefix", F.when(F.col("first"), 1).otherwise(2).alias("rank")))
    while True:
        sh = shingled(materialize(found.select(F.col("a").alias("tid")).unionByName(found.select(F.col("b").alias("tid"))).distinct(), "members"))
        both = found.join(sh.select(F.col("tid").alias("a"), F.col("sh").alias("sh_a")), "a").join(sh.select(F.col("tid").alias("b"), F.col("sh").alias("sh_b")), "b")
        edges = materialize(both.where(similar(F.col("sh_a"), F.col("sh_b"))).select("a", "b"), "edges")
        release(sh, found)
        out = materialize(settled(edges), "out")
        # leaders that go open what they took
        opened = materialize(stars.join(out.select(F.col("tid").alias("leader")), "leader", "left_semi").select("tid"), "opened")
        gone = materialize(gone.join(opened, "tid", "left_anti").unionByName(out), "gone")
        if opened.isEmpty():
            return gone
        stars = stars.limit(0)
        stay = sets.join(small(gone), "tid", "left_anti").join(small(opened.withColumn("open", F.lit(True))), "tid", "left")
        found = pairs(stay.where("open").select("tid", "prefix", F.lit(2).alias("rank")), stay.where("open IS NULL").select("tid", "prefix", F.lit(0).alias("rank")))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that are near copies of a row that stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = F.xxhash64(text, F.lit(1)), F.xxhash64(F.lit(2), text)
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), digests[0].alias("d1"), digests[1].alias("d2"))
    order = frequent_shingles(docs, text_col)
    marked = materialize(named.select("id", "d1", "d2", simhash.fingerprint(F.col("text"), 1, True).alias("fp"), prefixes(F.col("text"), order).alias("prefix")), "marked")
    rows = marked.groupBy("d1", "d2", "id").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("copies"))
    # numbers, not hashes, name the distinct texts, in the order of their ids; the table is stored, so they don't change
    numbered = rows.groupBy("d1", "d2").agg(F.min("id").alias("keeper"), F.min("fp").alias("fp"), F.max("copies").alias("copies"))
    ordered = numbered.repartitionByRange("keeper", "d1", "d2").sortWithinPartitions("keeper", "d1", "d2")
    texts = materialize(ordered.withColumn("tid", F.monotonically_increasing_id()), "texts")
    repeated = not texts.where("copies > 1").isEmpty()

    def at(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of left with the digests and the id of a text's keeper; right: d1, d2, keeper and others."""
        right = right.withColumnRenamed("d1", "_d1").withColumnRenamed("d2", "_d2")
        return left.join(right, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("id").eqNullSafe(F.col("keeper")), how)

    def shingled(tids: DataFrame) -> DataFrame:
        """tids, with columns of their own, and sh."""
        wanted = materialize(texts.select("tid", "d1", "d2", "keeper").join(small(tids), "tid"), "wanted")
        full = at(named, small(wanted)).select(*tids.columns, "text").select(*tids.columns, shingle_hashes(F.col("text")).alias("sh"))
        return materialize(full.dropDuplicates(["tid"]) if repeated else full, "shingles")

    grouped = simhash.groups(texts.select("tid", "fp"), "fp", RADIUS, "tid").withColumnRenamed("component_id", "part")
    sizes = materialize(grouped.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LARGE).drop("n"), "parts")
    stars = materialize(dropped(shingled(materialize(grouped.join(small(sizes), "part", "left_semi").select("tid", "part", "fp"), "candidates"))), "stars")
    sets = at(marked, texts.select("d1", "d2", "keeper", "tid").hint("shuffle_hash")).select("tid", "prefix")
    sets = materialize(sets.dropDuplicates(["tid"]) if repeated else sets, "sets")
    names = materialize(marked.select("id", "d1", "d2"), "names")
    again = materialize(rows.where("copies > 1").select("d1", "d2", F.col("id").alias("keeper")), "again") if repeated else None
    release(marked)
    gone = resolved(sets, stars, shingled)
    release(sets)
    # what goes: copies of a keeper, and all rows of a text that goes
    left = texts.join(small(gone.withColumn("goes", F.lit(True))), "tid", "left").select("d1", "d2", "keeper", F.coalesce("goes", F.lit(False)).alias("goes"))
    out = (names.distinct() if repeated else names).join(left.hint("shuffle_hash"), ["d1", "d2"]).where(F.col("goes") | ~F.col("id").eqNullSafe(F.col("keeper")))
    out = materialize(out.select("d1", "d2", F.col("id").alias("keeper")), "out")
    one, two = keep_free(docs.columns, "_one"), keep_free(docs.columns, "_two")
    keyed = docs.withColumn(one, digests[0]).withColumn(two, digests[1])

    def matching(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """The rows of df whose digests and id stand in keys (d1, d2, keeper), or don't."""
        keys = small(keys)
        return df.join(keys, (df[one] == keys["d1"]) & (df[two] == keys["d2"]) & df[id_col].eqNullSafe(keys["keeper"]), how)

    stay = matching(keyed, out, "left_anti")
    if repeated:
        place = keep_free(stay.columns, "_place")
        listed = Window.partitionBy(one, two, id_col).orderBy(F.to_json(F.struct(*[F.col(quoted(c)) for c in docs.columns])))
        first = matching(stay, again, "left_semi").withColumn(place, F.row_number().over(listed)).where(F.col(place) == 1).drop(place)
        stay = matching(stay, again, "left_anti").unionByName(first)
    return stay.select(*[F.col(quoted(c)) for c in docs.columns])
