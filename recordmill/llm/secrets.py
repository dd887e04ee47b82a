"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. A ledger in the shared folder holds which (blob, rule, rule
version) pairs have been scanned and what was found. A scan takes one row for each blob that has an unseen pair, scans
it for those rules only, appends to the ledger, and joins the findings of the current rule versions back to all rows
(paths) with that blob. A rule whose version, pattern or lengths change is scanned for again in every blob.

Null texts count as empty. Positions count code points, ends are exclusive. Matches of a rule are leftmost and don't
overlap; matches that fail its length conditions are dropped after they have consumed their text. Repeated rows each
get their blob's findings. An interrupted scan leaves findings without their scanned pairs: the next one finds them
again, and repeats are dropped on reading.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordmill import session
from recordmill.llm.common import keep_free, quoted
from recordmill.session import materialize


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A cheap condition that every text with a match meets; a literal to contain, or a pattern.
    hint: str = ""
    hint_is_pattern: bool = False
    group: int = 0
    at_least: int = 1
    version: int = 1

    @property
    def stamp(self) -> int:
        """What the ledger knows the rule's version by: it changes with the version and with all that decides a match."""
        told = repr((self.version, self.pattern, self.group, self.at_least)).encode()
        return int.from_bytes(hashlib.sha256(told).digest()[:8], "big", signed=True)

    def may_match(self, text: Column) -> Column:
        return text.rlike(self.hint or self.pattern) if self.hint_is_pattern or not self.hint else text.contains(self.hint)


#: The base kinds, in the order in which ties are listed, then those that the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", True, group=2, at_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA", at_least=20),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", True, at_least=24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh", at_least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}", "AIza"),
)
RULES = BASE + ADDED


def _stamp(rule: Rule) -> Column:
    return F.lit(rule.stamp).cast("long")


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _ledger(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A part of the ledger; empty where nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(f"{path}/{part}")
    return spark.createDataFrame([], schema)


SCANNED = "blob binary, kind string, version long"
FINDINGS = "blob binary, kind string, version long, start int, stop int"


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of blobs(blob, text, kinds): one row a match, for the rules named in kinds (null: all)."""
    text = F.col("text")
    wanted = [(F.col("kinds").isNull() | F.array_contains("kinds", r.kind)) & r.may_match(text) for r in rules]
    hits = F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(wanted)])
    some = blobs.withColumn("rule", F.filter(hits, lambda i: i.isNotNull())).where(F.size("rule") > 0)
    # rows that repeat a blob are told apart, so that each one's places are counted on their own
    some = some.select("blob", F.monotonically_increasing_id().alias("row"), "text", F.explode("rule").alias("rule"))
    matches, lengths, pieces = F.lit(None), F.lit(None), F.lit(None)
    for i, r in enumerate(rules):
        own, rx = F.col("rule") == i, F.lit(r.pattern)
        found = F.regexp_extract_all(text, rx, F.lit(0))
        matches = F.when(own, F.transform(found, F.length)).otherwise(matches)
        lengths = F.when(own, F.transform(found if r.group == 0 else F.regexp_extract_all(text, rx, F.lit(r.group)), F.length)).otherwise(lengths)
        pieces = F.when(own, F.transform(F.split(text, r.pattern, -1), F.length)).otherwise(pieces)
    zipped = some.select("blob", "row", "rule", F.posexplode(F.arrays_zip(matches.alias("own"), lengths.alias("part"), pieces.alias("gap"))).alias("at", "m")).where("m.own IS NOT NULL")
    before = Window.partitionBy("blob", "row", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = zipped.withColumn("stop", F.sum(F.col("m.own") + F.col("m.gap")).over(before).cast("int"))
    table = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.at_least)])
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.kind)])
    versions = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), _stamp(r))])
    kept = placed.where(F.col("m.part") >= F.element_at(table, F.col("rule")))
    return kept.select("blob", F.element_at(kinds, F.col("rule")).alias("kind"), F.element_at(versions, F.col("rule")).alias("version"), (F.col("stop") - F.col("m.own")).cast("int").alias("start"), "stop")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Brings the ledger up to date with docs. Returns paths(id, blob), one row a row of docs, and the findings of the
    current rule versions (blob, kind, version, start, stop)."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), blob_name(F.col(text_col)).alias("blob"))
    paths = materialize(named.select("id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("id").alias("keeper"))
    seen = _ledger(spark, ledger, "scanned", SCANNED)
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), _stamp(r).alias("version")) for r in rules])
    if seen.isEmpty():
        unseen = blobs.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = blobs.select("blob", "keeper", F.inline(current)).join(seen, ["blob", "kind", "version"], "left_anti")
        unseen = pairs.groupBy("blob").agg(F.first("keeper").alias("keeper"), F.collect_set("kind").alias("kinds"))
    unseen = materialize(unseen, "unseen")
    # the texts are streamed past a hash table of names; the id in the key deals out the rows of a blob with many copies
    key = lambda df, c: df.withColumn("k", F.coalesce(F.col(c).cast("string"), F.lit("")))
    texts = key(named, "id").join(key(unseen, "keeper").drop("keeper").hint("shuffle_hash"), ["blob", "k"]).select("blob", "text", "kinds")
    find(texts, rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), _stamp(r))])
    done = unseen.select("blob", F.explode("kinds").alias("kind")).withColumn("version", F.element_at(versions, F.col("kind")))
    done.write.mode("append").parquet(f"{ledger}/scanned")
    now = F.array(*[F.concat_ws("@", F.lit(r.kind), _stamp(r)) for r in rules])
    findings = _ledger(spark, ledger, "findings", FINDINGS).where(F.array_contains(now, F.concat_ws("@", "kind", "version")))
    return paths, findings.distinct()


def listed(findings: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "blob") -> DataFrame:
    """by, found: array<struct<start,rank,kind,stop>> by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    return findings.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", F.element_at(rank, F.col("kind")).alias("rank"), "kind", "stop"))).alias("found"))


def report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    paths, findings = scan(docs, ledger, rules, text_col, id_col)
    found = listed(findings, rules)
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    summary = found.select("blob", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
    joined = paths.join(summary, "blob", "left")
    return joined.select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: str, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every found span, overlapping ones merged, replaced by mark. Texts without a finding stay as they are,
    null ones too, and so do other columns, whatever their names. Texts are streamed past the list of spans if that is
    short enough to be broadcast; else they are dealt out by id and blob, so that copies of a text don't meet in one task."""
    paths, findings = scan(docs, ledger, rules, text_col, id_col)
    order = Window.partitionBy("blob").orderBy("start", "stop")
    merged = findings.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("part", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = materialize(spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")
    blob, at, own = (keep_free(docs.columns, name) for name in ("_blob", "_spans", "_id"))
    named = docs.withColumn(blob, blob_name(F.col(text_col)))
    listed = spans.select(F.col("blob").alias(blob), F.col("spans").alias(at))
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= session.BROADCAST_ROWS:
        joined = named.join(F.broadcast(listed), blob, "left")
    else:
        hits = paths.select(F.col("id").alias(own), F.col("blob").alias(blob)).distinct().join(listed, blob).withColumnRenamed(blob, "_" + blob)
        joined = named.join(hits.hint("shuffle_hash"), (named[blob] == hits["_" + blob]) & named[id_col].eqNullSafe(hits[own]), "left")
    text, at = F.col(text_col), F.col(at)
    stops = F.concat(F.array(F.lit(0)), F.transform(at, lambda s: s["stop"]))
    kept = F.zip_with(stops, F.concat(F.transform(at, lambda s: s["start"]), F.array(F.length(text))), lambda a, b: F.substring(text, a + 1, b - a))
    return joined.withColumn(text_col, F.when(at.isNull(), text).otherwise(F.array_join(kept, mark))).select(*[text_col if c == text_col else named[quoted(c)] for c in docs.columns])
