"""The review queue: filters, search, sort orders, pages, and the stores of checked and excepted keys."""

from __future__ import annotations

import dataclasses
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions.text import normalize
from recordmill.operators.risk import rank
from recordmill.operators.scan import PLACE, RANGE, Running, ranged, running
from recordmill.session import fresh_path, materialize, release

#: Rows on a page, and keys that a store keeps.
PAGE, KEPT = 30, 50_000


def filtered(records: DataFrame, status: str | None = None, issue_type: str | None = None, class_name: str | None = None, subject: str | None = None, term: str | None = None, checked: DataFrame | None = None) -> DataFrame:
    """records that meet all given conditions; checked: a table of check_key to hide."""
    out = records
    for column, value in (("status", status), ("class_name", class_name), ("subject", subject)):
        out = out if value is None else out.where(F.col(column) == value)
    if issue_type is not None:
        out = out.where(F.array_contains("issue_types", issue_type))
    if term:
        out = out.where(matches(term))
    return out if checked is None else unchecked(out, checked)


def matches(term: str) -> Column:
    """The normal form of a term stands in that of a record's name, class, subject, text or match name."""
    where = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "class_name", "subject", "text", "match_name")])
    return normalize(where).contains(normalize(F.lit(term)))


def sort_keys(mode: str) -> list[Column]:
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).try_cast("long")
    return {
        "priority": [rank(F.col("status")), F.desc("n_issues"), F.desc("similarity"), F.col("name")],
        "risk": [F.desc("similarity"), F.col("name")],
        "class": [number("class_name"), F.col("class_name"), number("number"), F.col("subject")],
        "name": [F.col("name")],
        "subject": [F.col("subject")],
    }[mode] + [F.col("record_order")]


@dataclasses.dataclass(frozen=True)
class Queue:
    """Records in a sort order, stored as ranges, and how many each range has."""

    rows: DataFrame
    counts: list[tuple[int, int]]

    def page(self, number: int = 1, size: int = PAGE) -> DataFrame:
        """Rows of one page, from 1; a number past the end gives the last page. Only the ranges that the page lies in are
        read."""
        total = sum(n for _, n in self.counts)
        first = (min(max(1, number), max(1, -(-total // size))) - 1) * size
        at, wanted = 0, F.lit(False)
        for block, n in self.counts:
            low, high = max(0, first - at), min(n, first + size - at)
            if low < high:
                wanted = wanted | ((F.col(RANGE) == block) & F.col(PLACE).between(low, high - 1))
            at += n
        return self.rows.where(wanted).orderBy(RANGE, PLACE).drop(RANGE, PLACE)


def queue(records: DataFrame, mode: str = "priority", ranges: int | None = None) -> Queue:
    """records in a sort order: whatever made them runs once, any number of pages are read from what is stored. A range is
    a folder, so a page opens no others; the driver holds a number for each range."""
    held = materialize(records, "reviewed")
    cut = ranged(held, [], sort_keys(mode), ranges=ranges, what="queue")
    path = fresh_path(records.sparkSession, "queue")
    cut.write.partitionBy(RANGE).parquet(path)
    counts = [(r[RANGE], r["n"]) for r in cut.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()]
    release(held, cut)
    if not counts:  # no folder, no schema to read
        return Queue(records.limit(0).withColumns({RANGE: F.lit(0), PLACE: F.lit(0).cast("long")}), [])
    return Queue(records.sparkSession.read.schema(cut.schema).parquet(path), counts)


def page(records: DataFrame, mode: str = "priority", number: int = 1, size: int = PAGE) -> DataFrame:
    return queue(records, mode).page(number, size)


def _by(keys: DataFrame) -> list[str]:
    """What records are known by: the digest of their content where the keys have it, for different records may share a
    check_key."""
    return ["content"] if "content" in keys.columns else ["check_key"]


def checked(records: DataFrame, keys: DataFrame) -> DataFrame:
    return records.join(keys.select(*_by(keys)).distinct(), _by(keys), "left_semi")


def unchecked(records: DataFrame, keys: DataFrame) -> DataFrame:
    return records.join(keys.select(*_by(keys)).distinct(), _by(keys), "left_anti")


def progress(records: DataFrame, keys: DataFrame) -> DataFrame:
    return checked(records, keys).agg(F.count(F.lit(1)).alias("n_checked"))


def excepted(issues: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excepted) issues by their issue_key."""
    own = keys.select("issue_key").distinct()
    return issues.join(own, "issue_key", "left_anti"), issues.join(own, "issue_key", "left_semi")


def toggled(store: DataFrame, keys: DataFrame, force: bool | None = None) -> DataFrame:
    """The store (key, marked_at) after each of keys (key, marked_at) is marked or unmarked; force: only one of these."""
    add = keys if force else keys.join(store, "key", "left_anti") if force is None else keys.limit(0)
    kept = store.join(keys.select("key"), "key", "left_anti")
    return kept.unionByName(add.dropDuplicates(["key"]))


def newest(store: DataFrame, limit: int | None = KEPT) -> DataFrame:
    """The newest keys of a store: what is written back. None: all keys."""
    last = store.groupBy("key").agg(F.max("marked_at").alias("marked_at"))
    return last if limit is None else last.orderBy(F.desc("marked_at"), "key").limit(limit)


def load_keys(rows: DataFrame, column: str = "value") -> DataFrame:
    """Keys of stored JSON arrays; what isn't an array of texts gives none."""
    items = F.from_json(column, "array<string>", {"mode": "PERMISSIVE"})
    return rows.select(F.explode(items).alias("key")).where("key IS NOT NULL")


# Saved stores: snapshots in folders of their own, and numbered pointers that name them. A snapshot is written whole before
# the pointer to it; a pointer's file is made once, by whoever comes first, and counts once its name is written in full. So
# a reader sees the old store or the new one, a save that dies changes nothing, and of two saves at once one fails.

STORE = "key string, marked_at timestamp"
_NAME = 32


class SavedMeanwhile(RuntimeError):
    """Another save has come first."""


def _pointers(spark: SparkSession, path: str) -> tuple:
    """(file system, folder, numbers of all pointers)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(int(n) for n in found if n.isdigit())


def _snapshot(spark: SparkSession, files, folder, version: int) -> str | None:
    """What a pointer names; nothing if its writer died."""
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)))
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return name if len(name) == _NAME else None


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(version, snapshot) of a saved store; (0, None) where nothing was saved yet."""
    files, folder, versions = _pointers(spark, path)
    return next(((v, name) for v in reversed(versions) if (name := _snapshot(spark, files, folder, v))), (0, None))


def save(store: DataFrame, path: str, limit: int | None = KEPT, since: int | None = None) -> int:
    """Writes the newest keys of store (key, marked_at) as the next snapshot and returns its version. since: the version
    that store was made from; the save fails if another one came after it. The snapshot before stays for its readers,
    older ones are deleted."""
    spark = store.sparkSession
    before, last = current(spark, path)
    if since is not None and before != since:
        raise SavedMeanwhile(f"version {before} came after {since}")
    snapshot = uuid.uuid4().hex
    newest(store, limit).write.parquet(f"{path}/snapshots/{snapshot}")
    version = _swing(spark, path, snapshot)
    of = spark._jvm.org.apache.hadoop.fs.Path
    files, folder, versions = _pointers(spark, path)
    for v in versions:
        if v < before and (old := _snapshot(spark, files, folder, v)) not in (None, last, snapshot):
            files.delete(of(f"{path}/snapshots/{old}"), True)
            files.delete(of(folder, str(v)), False)
    return version


def _swing(spark: SparkSession, path: str, snapshot: str) -> int:
    """Points to a snapshot by the next number."""
    files, folder, versions = _pointers(spark, path)
    version = (versions[-1] if versions else 0) + 1
    try:
        pointer = files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)), False)
    except Py4JJavaError as taken:
        raise SavedMeanwhile(f"version {version} is taken") from taken
    pointer.writeBytes(snapshot)
    pointer.close()
    return version


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a saved store; empty where nothing was saved yet."""
    _, snapshot = current(spark, path)
    return spark.createDataFrame([], STORE) if snapshot is None else spark.read.schema(STORE).parquet(f"{path}/snapshots/{snapshot}")


def in_group_rank(records: DataFrame, by: str, mode: str = "priority") -> DataFrame:
    """records with their place in their group: a running count over ranges of the sort order, so no group is one task."""
    cut = ranged(records, [by], sort_keys(mode))
    return running(cut, [by], place=Running(F.lit(1), "sum")).select(*records.columns, F.col("place").cast("int").alias("place"))
