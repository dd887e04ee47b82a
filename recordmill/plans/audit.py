"""The whole audit: records to matches, issues, risk classes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.operators import inspect, risk, similarity, spelling


def with_issues(records: DataFrame, issues: DataFrame) -> DataFrame:
    """records with n_issues, issue_types and issue_labels (distinct, by first place) of their kept issues."""
    own = issues.groupBy("record_order").agg(F.count(F.lit(1)).alias("n_issues"), F.array_sort(F.collect_set("type")).alias("issue_types"), F.array_sort(F.collect_list(F.struct("start", "type", "label", "match", "reference"))).alias("_all"))
    listed = own.withColumn("issue_labels", F.array_distinct(F.transform("_all", lambda s: s["label"]))).withColumn("issue_matches", F.transform("_all", lambda s: s["match"])).withColumn("issue_references", F.array_distinct(F.transform("_all", lambda s: s["reference"]))).drop("_all")
    joined = records.join(listed, "record_order", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({"n_issues": F.coalesce("n_issues", F.lit(0)), **{c: F.coalesce(c, none) for c in ("issue_types", "issue_labels", "issue_matches", "issue_references")}})


def classify(records: DataFrame, issues: DataFrame, threshold: float = risk.THRESHOLD) -> DataFrame:
    """Matched records with issues and status. A new threshold needs this step only."""
    own = with_issues(records, issues)
    return own.withColumn("status", risk.status(F.col("group_size"), F.col("similarity"), F.col("issue_types"), threshold))


def audit(records: DataFrame, threshold: float = risk.THRESHOLD, floor: float = similarity.FLOOR, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(classified records, issues). With a dictionary(word) the spelling pass adds its issues."""
    issues = inspect.inspect(records)
    if dictionary is not None:
        issues = issues.unionByName(spelling.issues(records, dictionary))
    return classify(similarity.matched(records, floor), issues, threshold), issues
