"""Lines of extracted documents to record text: page furniture, sections, wrapped lines, and a person's class.

lines: source_file, person, page, line_no, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.functions.text import DEFAULTS, SPACE, clean, spaceless
from recordmill.operators import segment
from recordmill.operators.merge import long_enough

# Patterns of lines that aren't record text.
WATERMARK = r"/[0-9]{4}\.[0-9]{2}\.[0-9]{2} [0-9]{2}:[0-9]{2}/"
FOOTER = rf"[0-9]{{4}}년{SPACE}*[0-9]{{1,2}}월{SPACE}*[0-9]{{1,2}}일.*[0-9]+/[0-9]+.*반.*번호.*성명"
TABLE_HEAD = "^과목세부능력및특기사항$"
SECTION_END = "^(?:[0-9]+\\.)?(?:독서활동상황|행동특성및종합의견)"
GRADES_HEAD = "원점수|석차등급|성취도별|^원점수/과목평균성취도|^학점성취도"
PERSONAL_SECTION = "인적·학적사항"


def is_furniture(c: Column) -> Column:
    return c.rlike(WATERMARK) | c.rlike(FOOTER)


def is_grades_head(c: Column) -> Column:
    return spaceless(c).rlike(GRADES_HEAD) & ~c.rlike("[.!?]$")


def section_lines(lines: DataFrame) -> DataFrame:
    """The lines of the section's tables: on from a table head, off at a grades head or the section's end."""
    bare = spaceless(F.col("text"))
    marker = F.when(bare.rlike(TABLE_HEAD), "on").when(bare.rlike(SECTION_END), "off").when(is_grades_head(F.col("text")), "off")
    state = F.last(marker, ignorenulls=True).over(Window.partitionBy("source_file", "person").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.where(~is_furniture(F.col("text"))).withColumn("_m", marker).withColumn("_s", state)
    return kept.where((F.col("_s") == "on") & F.col("_m").isNull()).drop("_m", "_s")


def joined(lines: DataFrame) -> DataFrame:
    """One text a person: wrapped lines are glued, with a space after a sentence mark or a comma only."""
    listed = lines.groupBy("source_file", "person").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))).alias("l"))
    glue = lambda acc, s: F.when(acc == "", s["text"]).when(acc.rlike("[.!?,]$"), F.concat(acc, F.lit(" "), s["text"])).otherwise(F.concat(acc, s["text"]))
    return listed.select("source_file", "person", F.aggregate("l", F.lit(""), glue).alias("text"))


def names(lines: DataFrame) -> DataFrame:
    found = F.regexp_extract("text", rf"성명{SPACE}*:{SPACE}*([^{SPACE[1:-1]}]+)", 1)
    return lines.withColumn("name", found).where("name <> ''").groupBy("source_file", "person").agg(F.min_by("name", F.struct("page", "line_no")).alias("name"))


def enrolments(lines: DataFrame) -> DataFrame:
    """(source_file, person, grade, class_number, number) of every enrolment row."""
    rx = rf"^([1-3]){SPACE}+([0-9]{{1,2}}){SPACE}+([0-9]{{1,3}}){SPACE}+[^0-9]+$"
    part = lambda i: F.regexp_extract("text", rx, i)
    return lines.where(F.col("text").rlike(rx)).select("source_file", "person", part(1).cast("int").alias("grade"), part(2).cast("int").alias("class_number"), part(3).alias("number"))


def classes(people: DataFrame, rows: DataFrame) -> DataFrame:
    """people (source_file, person) with grade, class_name and number: the enrolment of the grade that the file's name
    gives; else the file's class with the latest number; else the latest enrolment; else blanks."""
    rx = rf"([0-9]){SPACE}*학년{SPACE}*([0-9]+){SPACE}*반"
    own = people.withColumn("fg", F.regexp_extract("source_file", rx, 1).try_cast("int")).withColumn("fc", F.regexp_extract("source_file", rx, 2).try_cast("int"))
    latest = rows.groupBy("source_file", "person").agg(F.max_by(F.struct("grade", "class_number", "number"), "grade").alias("r"))
    same = own.join(rows, ["source_file", "person"]).where("grade = fg").groupBy("source_file", "person").agg(F.max(F.struct("class_number", "number")).alias("s"))
    both = own.join(latest, ["source_file", "person"], "left").join(same, ["source_file", "person"], "left")
    grade = F.coalesce("fg", "r.grade")
    number = F.coalesce("s.number", "r.number", F.lit(""))
    room = F.coalesce("s.class_number", "fc", "r.class_number")
    label = lambda *c: F.coalesce(F.concat(*c), F.lit(""))
    return both.select("source_file", "person", label(grade.cast("string"), F.lit("학년")).alias("grade"), label(grade.cast("string"), F.lit("학년 "), room.cast("string"), F.lit("반")).alias("class_name"), number.alias("number"))


def records(lines: DataFrame) -> DataFrame:
    """(source_file, person, pos, subject, text) of the sections of every person's text; all lines of a file give its
    section names. A text without sections is one of an unknown subject; those of up to three characters are left out."""
    texts = joined(section_lines(lines)).select("source_file", "person", F.col("person").alias("source_row"), "text")
    parts = segment.split(texts, segment.names(texts))
    several = F.max("pos").over(Window.partitionBy("source_file", "person")) >= 0
    unknown = DEFAULTS["subject"]
    kept = parts.withColumn("_several", several).where(~F.col("_several") | (F.col("pos") >= 0)).withColumn("subject", F.coalesce("name", F.lit(unknown)))
    text = clean(F.when(F.col("subject") == unknown, F.col("part")).otherwise(F.concat("subject", F.lit(": "), "part")))
    return long_enough(kept.select("source_file", "person", F.greatest("pos", F.lit(0)).alias("pos"), "subject", text.alias("text")))
