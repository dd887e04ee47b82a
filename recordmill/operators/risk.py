"""Risk classes and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default threshold, the least review similarity, and what counts as equal.
THRESHOLD, REVIEW_FLOOR, REVIEW_STEP, EQUAL = 0.65, 0.45, 0.2, 0.9995
STATUSES = ("exact", "high", "review", "normal")
LABELS = {"exact": "완전 일치", "high": "높은 유사도", "review": "검토 필요", "normal": "정상"}
#: Subjects that stand first in a filter.
FIRST_SUBJECTS = ("자율활동", "자율·자치활동", "진로활동", "동아리활동", "봉사활동", "개인별 세특")
ISSUE_TYPES = ("typo", "symbol", "prohibited", "institution", "business")


def status(group_size: Column, similarity: Column, issue_types: Column, threshold: float = THRESHOLD) -> Column:
    """exact, high, review or normal. issue_types: array of a record's issue types; symbols alone raise no risk."""
    named = F.exists(F.coalesce(issue_types, F.array().cast("array<string>")), lambda t: t != "symbol")
    review = named | (similarity >= max(REVIEW_FLOOR, threshold - REVIEW_STEP))
    return F.when((group_size > 1) | (similarity >= EQUAL), "exact").when(similarity >= threshold, "high").when(review, "review").otherwise("normal")


def rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), c).cast("int") - 1


def label(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), c)


def counts(records: DataFrame) -> DataFrame:
    """One row: records, each status, flagged, and each status' share."""
    ones = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    row = records.agg(F.count(F.lit(1)).alias("total"), *ones)
    flagged = F.col("exact") + F.col("high") + F.col("review")
    return row.select("*", flagged.alias("flagged"), *[(F.col(s) / F.greatest("total", F.lit(1))).alias(f"{s}_share") for s in STATUSES])


def by_issue_type(issues: DataFrame) -> DataFrame:
    """(type, n_records) for all types, none left out; a record counts once a type."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(t,) for t in ISSUE_TYPES], "type string")
    found = issues.select("type", "record_order").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n_records"))


def subject_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("subject").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES[:3]])


def ordered_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc(F.col("exact") + F.col("high")), F.desc("total"), "subject")


def grade_crosstab(records: DataFrame, grades: list[str]) -> DataFrame:
    """A column for each grade, in order. The grades are given, so no pass is spent on finding them."""
    return records.groupBy("subject").pivot("grade", sorted(grades)).agg(F.count(F.lit(1))).na.fill(0)


def top_subjects(records: DataFrame, top: int = 5) -> DataFrame:
    flagged = F.count_if(F.col("status") != "normal")
    each = records.groupBy("subject").agg(flagged.alias("flagged"), F.count(F.lit(1)).alias("total"))
    return each.withColumn("share", F.col("flagged") / F.col("total")).orderBy(F.desc("flagged"), F.desc("total"), "subject").limit(top)


def record_mode(records: DataFrame) -> DataFrame:
    creative, subject = F.bool_and(F.col("record_type") == "creative"), F.bool_and(F.col("record_type") == "subject")
    return records.agg(F.when(creative, "creative").when(subject, "subject").otherwise("mixed").alias("mode"))


def filter_values(records: DataFrame, column: str, first: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct values of a column: those named first in that order, then the rest, digits in them by value; for subjects
    FIRST_SUBJECTS, if nothing else is asked for."""
    first = FIRST_SUBJECTS if first is None and column == "subject" else first
    place = F.array_position(F.array(*map(F.lit, first)), F.col(column)) if first else F.lit(0)
    number = F.regexp_extract(column, "([0-9]+)", 1)
    return records.select(column).distinct().orderBy(F.when(place > 0, place).otherwise(1 << 30), F.when(number != "", number.cast("long")), column)
