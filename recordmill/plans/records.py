"""Record tables over plain tables of documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions.text import content_digest, content_key, normalize, tokens


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record: its language is the subject, its source the class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select(
        F.col("doc_id").alias("record_order"),
        F.concat(F.lit("record-"), F.col("doc_id").cast("string")).alias("record_id"),
        F.lit("subject").alias("record_type"),
        F.coalesce("source", F.lit("")).alias("class_name"),
        F.concat(F.lit("g"), (F.col("doc_id") % 3 + 1).cast("string")).alias("grade"),
        F.coalesce("lang", F.lit("")).alias("subject"),
        F.col("doc_id").cast("string").alias("number"),
        F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string")).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return named.withColumn("normalized_text", normalize(F.col("text")))


def with_tokens(records: DataFrame) -> DataFrame:
    return records.withColumn("tokens", tokens(F.col("normalized_text")))


def with_key(records: DataFrame) -> DataFrame:
    """records with the short key of their content, and its digest, which tells apart what shares a short key."""
    parts = [F.col(c) for c in ("name", "class_name", "subject", "normalized_text")]
    return records.withColumns({"check_key": content_key(*parts), "content": content_digest(*parts)})


#: Letters a to z as Hangul syllables, so that rules for Hangul words meet the invented prose.
HANGUL = "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def hangul(records: DataFrame) -> DataFrame:
    """records whose text has a Hangul syllable for each letter."""
    return records.withColumn("text", F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", HANGUL))


def packed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one packed cell: 'role: text' of its turns in order; files hold conversations by number."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), said.alias("said")))).alias("t"))
    return listed.select(F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string")).alias("source_file"), F.col("conv_id").alias("source_row"), F.concat_ws(" ", F.transform("t", lambda s: s["said"])).alias("text"))


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of sheets in the class-wise layout, with the header that its file's number gives: number, name and
    grade stand in some rows only."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    file = F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string"))
    when = lambda test, value: F.when(test, value).otherwise("")
    rows = turns.select(
        file.alias("source_file"), F.lit("Sheet1").alias("sheet_name"), (F.col("conv_id") * 1000 + F.col("turn") + 10).alias("source_row"),
        F.array(when(F.col("turn") == 0, (F.col("conv_id") % 40).cast("string")), when(F.col("turn") % 2 == 0, F.concat(F.lit("n"), (F.col("conv_id") % 5).cast("string"))), when(F.col("turn") % 3 == 0, (F.col("conv_id") % 3 + 1).cast("string")), F.coalesce("text", F.lit("")), F.lit(""), F.lit("")).alias("cells"),
    )
    files = turns.select(file.alias("source_file"), (F.col("conv_id") % 7).alias("k")).distinct()
    heads = F.when(F.col("k") == 1, F.array(*map(F.lit, ["번호", "성명", "학년", "창의적 체험활동"]))).when(F.col("k") == 2, F.array(*map(F.lit, ["과목", "학년", "학기", "번호", "성명", "세부능력 및 특기사항"]))).when(F.col("k") == 3, F.array(F.lit("자유 양식"))).otherwise(F.array(*map(F.lit, ["번 호", "성 명", "학 년", "세부능력 및 특기사항"])))
    return rows.unionByName(files.select("source_file", F.lit("Sheet1").alias("sheet_name"), F.lit(2).cast("long").alias("source_row"), heads.alias("cells")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document; the fourth document of each file's lines are preceded by a table head."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = docs.select(F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("source_file"), F.col("doc_id").alias("person"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    heads = docs.select(F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("source_file"), F.col("doc_id").alias("person"), F.lit(-1).alias("line_no"), F.when(F.col("doc_id") % 4 == 0, "행동특성 및 종합의견").otherwise("과 목 세부능력 및 특기사항").alias("text"))
    return each.unionByName(heads).withColumn("page", F.lit(1))


def subject_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of sheets in the subject-wise layout, twenty conversations a file."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    file = F.concat(F.lit("f"), F.lpad(F.floor(F.col("conv_id") / 20).cast("string"), 9, "0"))
    row = lambda row, cells: turns.select(file.alias("source_file"), F.lit("Sheet1").alias("sheet_name"), row.cast("long").alias("source_row"), cells.alias("cells"))
    heads = row(F.lit(1), F.array(*map(F.lit, ["과목", "학년", "학기", "번호", "성명", "세부능력 및 특기사항"]))).distinct()
    name = F.concat(F.lit("n"), F.col("conv_id").cast("string"))
    return heads.unionByName(row(F.col("conv_id") * 1000 + F.col("turn") + 10, F.array("role", F.lit("2"), F.lit("1"), (F.col("conv_id") % 997).cast("string"), name, "text")))


def people_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a person with lines of a name and of enrolments in one to three grades."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("person"))
    file = F.when(F.col("person") % 2 == 0, "3학년 4반.pdf").otherwise("x.pdf")
    grades = F.transform(F.sequence(F.lit(1).cast("long"), F.col("person") % 3 + 1), lambda g: F.concat_ws(" ", g, F.col("person") % 9 + g, F.col("person") % 35 + g, F.lit("담임")))
    text = F.concat(F.array(F.concat(F.lit("성명 : n"), F.col("person").cast("string"), F.lit(" 반"))), grades)
    return docs.select(file.alias("source_file"), "person", F.lit(1).alias("page"), F.posexplode_outer(text).alias("line_no", "text"))


def replaced(records: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """records with words of their texts replaced, one pair after the other, so that rules meet them in invented prose."""
    text = F.col("text")
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return records.withColumn("text", text)
