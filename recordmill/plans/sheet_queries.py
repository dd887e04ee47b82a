"""Queries over whole sheets: all turns of all conversations as the rows of one file, in each layout, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions import text as T
from recordmill.plans import sql as S
from recordmill.plans.catalog import query
from recordmill.sources import layouts

FILE = "all.xlsx"


def _sheet(turns: DataFrame, row: str, cells: list[str]) -> DataFrame:
    """Rows of one file with twelve cells, given as SQL expressions."""
    wide = [F.expr(c) for c in cells] + [F.lit("")] * (12 - len(cells))
    return turns.select(F.lit(FILE).alias("source_file"), F.lit("Sheet1").alias("sheet_name"), F.expr(row).cast("long").alias("source_row"), F.array(*wide).alias("cells"))


def one_sheet(spark: SparkSession, sf_dir: str, head: list[str], cells: list[str]) -> DataFrame:
    """All turns as rows of one file; a head before every fiftieth conversation, a class title before every tenth."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    heads = _sheet(turns.where("conv_id % 50 = 0").select("conv_id").distinct(), "conv_id * 1000 + 1", [f"'{h}'" for h in head])
    titles = _sheet(turns.where("conv_id % 10 = 0").select("conv_id").distinct(), "conv_id * 1000 + 2", ["concat(conv_id % 3 + 1, '학년 ', conv_id % 9 + 1, '반')"])
    return heads.unionByName(titles).unionByName(_sheet(turns, "conv_id * 1000 + turn + 10", cells))


CLASS_HEAD = ["번호", "성명", "학년", "세부능력 및 특기사항"]
CLASS_CELLS = [
    "if(turn = 0, string(conv_id % 40), '')", "if(turn % 2 = 0, concat('n', conv_id div 2), '')", "if(turn % 3 = 1, string(conv_id % 3 + 1), '')",
    "concat(CASE turn % 4 WHEN 0 THEN '체육: ' WHEN 2 THEN '음악: ' ELSE '' END, coalesce(text, ''))",
]
_CLEAN = S.collapse("regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g')")
_TITLES = """titled AS (SELECT conv_id, turn, conv_id * 1000 + turn + 10 AS source_row, {clean} AS chunk, (SELECT max(t.conv_id) FROM conversations t WHERE t.conv_id % 10 = 0 AND t.conv_id <= c.conv_id) AS tc FROM conversations c),
 d AS (SELECT *, CASE WHEN tc IS NULL THEN '' ELSE (tc % 3 + 1) || '학년 ' || (tc % 9 + 1) || '반' END AS class_name FROM titled)""".replace("{clean}", _CLEAN)
_FOLD = f"list_reduce(chunks, lambda a, b: CASE WHEN contains(regexp_replace(a, '{S.SPACE}+', '', 'g'), regexp_replace(b, '{S.SPACE}+', '', 'g')) THEN a ELSE {S.trim("a || ' ' || b")} END)"
_CLASS = f"""WITH {_TITLES}, n AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'n' || (conv_id // 2) END AS own FROM d WHERE chunk <> '' OR turn % 2 = 0),
 p AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS name, coalesce(last_value(CASE WHEN turn = 0 THEN CAST(conv_id % 40 AS VARCHAR) END IGNORE NULLS) OVER w, '') AS number, last_value(own IGNORE NULLS) OVER (ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n WINDOW w AS (ORDER BY source_row ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT *, sum(CAST(own IS NOT NULL AND own IS DISTINCT FROM before AS INTEGER)) OVER (ORDER BY source_row ROWS UNBOUNDED PRECEDING) AS person FROM p),
 carried AS (SELECT *, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN (conv_id % 3 + 1) || '학년' END IGNORE NULLS) OVER w, '') AS grade, CASE turn % 4 WHEN 0 THEN '체육' WHEN 2 THEN '음악' END AS label, coalesce(last_value(CASE turn % 4 WHEN 0 THEN '체육' WHEN 2 THEN '음악' END IGNORE NULLS) OVER w, '과목 미상') AS subject FROM g WHERE name IS NOT NULL WINDOW w AS (PARTITION BY person ORDER BY source_row ROWS UNBOUNDED PRECEDING)) """


@query(_CLASS + "SELECT source_row, class_name, number, name, grade FROM carried")
def class_sheet_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is carried to the rows of one large file in the class-wise layout."""
    rows = one_sheet(spark, sf_dir, CLASS_HEAD, CLASS_CELLS)
    return layouts.class_rows(rows).select("source_row", "class_name", "number", "name", "grade")


@query(_CLASS + f""", merged AS (SELECT class_name, number, name, grade, subject, min(source_row) AS source_row, list(CASE WHEN k = 1 AND label IS NOT NULL THEN subject || ': ' || chunk ELSE chunk END ORDER BY source_row) AS chunks FROM (SELECT *, row_number() OVER (PARTITION BY class_name, number, name, grade, subject ORDER BY source_row) AS k FROM carried WHERE chunk <> '') GROUP BY ALL)
 SELECT source_row, coalesce(nullif(class_name, ''), '학급 미상') AS class_name, coalesce(nullif(grade, ''), nullif(regexp_extract(class_name, '([0-9]+학년)', 1), ''), '학년 미상') AS grade, subject, number, name, {_FOLD} AS text FROM merged WHERE length({_FOLD}) > 3""")
def class_sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one large file in the class-wise layout: packed cells split, their sections carried on, chunks merged."""
    rows = one_sheet(spark, sf_dir, CLASS_HEAD, CLASS_CELLS)
    return layouts.class_records(rows).select("source_row", "class_name", "grade", "subject", "number", "name", "text")


CREATIVE_HEAD = ["번호", "성명", "학년", "창의적 체험활동"]
CREATIVE_CELLS = [
    "if(turn = 0, string(conv_id % 40), '')", "if(turn % 4 = 0, concat('n', conv_id div 2), '')", "if(turn % 3 = 1, string(conv_id % 3 + 1), '')",
    "CASE turn % 4 WHEN 1 THEN '자율활동' WHEN 3 THEN '진로 활동' ELSE '' END", "''", "if(turn % 5 = 4, '희망분야', coalesce(text, ''))",
]
_CREATIVE = f"""WITH {_TITLES}, p AS (SELECT *, sum(CAST(turn % 4 = 0 AS INTEGER)) OVER w AS person, last_value(CASE WHEN turn % 4 = 0 THEN 'n' || (conv_id // 2) END IGNORE NULLS) OVER w AS name, coalesce(last_value(CASE WHEN turn = 0 THEN CAST(conv_id % 40 AS VARCHAR) END IGNORE NULLS) OVER w, '') AS number FROM d WINDOW w AS (ORDER BY source_row ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT *, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN (conv_id % 3 + 1) || '학년' END IGNORE NULLS) OVER w, '') AS grade, last_value(CASE turn % 4 WHEN 1 THEN '자율활동' WHEN 3 THEN '진로활동' END IGNORE NULLS) OVER w AS subject FROM p WINDOW w AS (PARTITION BY person ORDER BY source_row ROWS UNBOUNDED PRECEDING)),
 kept AS (SELECT * FROM g WHERE name IS NOT NULL AND subject IS NOT NULL AND turn % 5 <> 4 AND chunk NOT IN ('', '0', '희망분야') AND NOT regexp_matches(chunk, '^[0-9]+$')),
 merged AS (SELECT class_name, number, name, grade, subject, min(source_row) AS source_row, list(chunk ORDER BY source_row) AS chunks FROM kept GROUP BY ALL) """


@query(_CREATIVE + f"SELECT source_row, coalesce(nullif(class_name, ''), '학급 미상') AS class_name, coalesce(nullif(grade, ''), '학년 미상') AS grade, subject, number, name, {_FOLD} AS text FROM merged WHERE length({_FOLD}) > 3")
def creative_sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one large file in the activity layout, where every name starts a person anew."""
    rows = one_sheet(spark, sf_dir, CREATIVE_HEAD, CREATIVE_CELLS)
    return layouts.creative_records(rows).select("source_row", "class_name", "grade", "subject", "number", "name", "text")


SUBJECT_HEAD = ["과목", "학년", "학기", "번호", "성명", "세부능력 및 특기사항"]
SUBJECT_CELLS = [
    "CASE turn % 3 WHEN 0 THEN if(conv_id % 2 = 0, '체육', '음악') WHEN 1 THEN '계' ELSE '' END", "if(turn % 2 = 1, string(conv_id % 4 + 1), '')", "''",
    "if(turn = 0, string(conv_id % 1200), '')", "if(turn = 0, concat('n', conv_id), '')", "coalesce(text, '')",
]


@query(f"""WITH {_TITLES}, p AS (SELECT *, last_value(CASE WHEN turn % 3 = 0 THEN CASE conv_id % 2 WHEN 0 THEN '체육' ELSE '음악' END END IGNORE NULLS) OVER w AS subject, coalesce(last_value(CASE WHEN turn % 2 = 1 AND conv_id % 4 < 3 THEN (conv_id % 4 + 1) || '학년' END IGNORE NULLS) OVER w, '') AS grade,
   coalesce(last_value(CASE WHEN turn = 0 AND conv_id % 1200 < 1000 THEN CAST(conv_id % 1200 AS VARCHAR) END IGNORE NULLS) OVER w, '') AS number, last_value(CASE WHEN turn = 0 THEN 'n' || conv_id END IGNORE NULLS) OVER w AS name FROM d WHERE chunk <> '' WINDOW w AS (ORDER BY source_row ROWS UNBOUNDED PRECEDING)),
 merged AS (SELECT class_name, number, name, grade, subject, min(source_row) AS source_row, list(chunk ORDER BY source_row) AS chunks FROM p WHERE subject IS NOT NULL AND name IS NOT NULL GROUP BY ALL)
 SELECT source_row, coalesce(nullif(class_name, ''), '학급 미상') AS class_name, coalesce(nullif(grade, ''), '학년 미상') AS grade, subject, number, name, subject || ': ' || {_FOLD} AS text FROM merged WHERE length({_FOLD}) > 3""")
def subject_sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one large file in the subject-wise layout: four values carried on, with no reset."""
    rows = one_sheet(spark, sf_dir, SUBJECT_HEAD, SUBJECT_CELLS)
    return layouts.subject_records(rows).select("source_row", "class_name", "grade", "subject", "number", "name", "text")


#: In the generic layout: names broken into letters four rows apart, numbers, categories and names that stand in some rows.
GENERIC_CELLS = [
    "CASE WHEN conv_id % 3 = 0 AND turn % 4 <> 3 THEN '가' WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN concat('n', conv_id % 7) ELSE '' END", "if(turn % 3 = 0, string(conv_id % 5), '')",
    "if(turn % 2 = 0, string(conv_id % 11), '')", "if(turn % 4 = 1, '국어', '')", "if(turn % 5 = 0, concat('m', conv_id % 13), '')", "coalesce(text, '')",
]


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, conv_id * 1000 + turn + 10 AS source_row, CASE WHEN conv_id % 3 = 0 AND turn % 4 <> 3 THEN '가' WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN 'n' || (conv_id % 7) ELSE '' END AS own,
   CASE WHEN turn % 3 = 0 THEN CAST(conv_id % 5 AS VARCHAR) END AS b, CASE WHEN turn % 2 = 0 THEN CAST(conv_id % 11 AS VARCHAR) END AS no, CASE WHEN turn % 4 = 1 THEN '국어' END AS s, CASE WHEN turn % 5 = 0 THEN 'm' || (conv_id % 13) END AS m FROM conversations),
 v AS (SELECT CAST(0 AS BIGINT) AS i, '' AS v0, '' AS v1, '' AS v2, '' AS v3, '' AS own UNION ALL SELECT d.i, CASE WHEN length(d.own) = 1 AND v3 <> '' THEN v3 || d.own WHEN d.own <> '' THEN d.own ELSE v0 END, v0, v1, v2, d.own FROM v JOIN d ON d.i = v.i + 1),
 n AS (SELECT v.i, CASE WHEN length(f.own) = 1 AND v.v0 <> '' THEN f.v0 ELSE v.v0 END AS name FROM v LEFT JOIN v f ON f.i = v.i + 4),
 c AS (SELECT i, source_row, coalesce(last_value(b IGNORE NULLS) OVER w, '') AS c2, coalesce(last_value(CASE WHEN i > 1 THEN no END IGNORE NULLS) OVER w, no, '') AS c3, coalesce(last_value(s IGNORE NULLS) OVER w, '') AS c4, coalesce(last_value(m IGNORE NULLS) OVER w, '') AS c5 FROM d WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, i - lag(CASE WHEN c5 <> '' THEN i END) OVER (PARTITION BY c2, c3, c4 ORDER BY i) AS gap FROM c), h AS (SELECT *, sum(CAST(gap IS NULL OR gap > 5 AS INTEGER)) OVER (PARTITION BY c2, c3, c4 ORDER BY i) AS chain FROM k)
 SELECT h.source_row, n.name, c2, c3, c4, first_value(c5) OVER (PARTITION BY c2, c3, c4, chain ORDER BY h.i) AS c5 FROM h JOIN n ON n.i = h.i""")
def generic_sheet_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic layout's fills over one large file, names broken into letters among them."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = _sheet(turns, "conv_id * 1000 + turn + 10", GENERIC_CELLS)
    done = layouts.generic_rows(rows)
    return done.select("source_row", *[F.get("cells", F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "c2"), (3, "c3"), (4, "c4"), (5, "c5"))])


_CELL = "CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || (turn + 1) || '학년 ' || (conv_id % 9 + 1) || ' 반 ' WHEN 2 THEN '자율 활동' WHEN 3 THEN ' 진로활동' || chr(10) WHEN 4 THEN coalesce(text, '') ELSE role || '  ' || (turn + 1) || '학년' END"


@query(f"""WITH c AS (SELECT conv_id, turn, {S.trim(f"coalesce({_CELL}, '')")} AS cell, (turn % 8) / 7.0 AS share FROM conversations), p AS (SELECT *, {S.collapse("regexp_replace(cell, '[\x00-\x1f\x7f]', ' ', 'g')")} AS cleaned, regexp_extract(cell, '([0-9]+){S.SPACE}*학년', 1) AS g, regexp_extract(cell, '(?s)([0-9]+){S.SPACE}*학년.*?([0-9]+){S.SPACE}*반', 2) AS k, regexp_replace(cell, '{S.SPACE}+', '', 'g') AS bare FROM c)
 SELECT conv_id, turn, CASE WHEN k <> '' THEN g || '학년 ' || k || '반' ELSE cleaned END AS class_label, CASE WHEN g <> '' THEN g || '학년' ELSE '' END AS grade, CASE bare WHEN '자율활동' THEN '자율활동' WHEN '진로활동' THEN '진로활동' ELSE '' END AS activity,
   CASE WHEN contains(bare, '활동') THEN 1 WHEN contains(bare, '학년') THEN 1 ELSE -1 END AS header_at, coalesce(nullif(cleaned, ''), '이름 미상') AS name, CAST(floor(share * 100 + 0.5) AS BIGINT) || '%' AS percent FROM p""")
def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of cells: class, grade, activity, place among headers, defaults, and shares as per cent."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cell = T.cell_text(F.expr(_CELL))
    own = turns.select("conv_id", "turn", cell.alias("cell"), ((F.col("turn") % 8) / 7.0).alias("share"))
    c = F.col("cell")
    at = T.header_index(F.array(F.lit("번 호"), c, F.lit("")), ["활동", "학년"])
    return own.select("conv_id", "turn", T.class_label(c).alias("class_label"), T.grade_of_class(c).alias("grade"), T.activity_label(c).alias("activity"), at.alias("header_at"), T.or_default(T.clean(c), "name").alias("name"), T.percent(F.col("share")).alias("percent"))


@query(f"""WITH k AS (SELECT conv_id, turn % 2 AS f, turn, {_CLEAN} AS chunk FROM conversations), l AS (SELECT conv_id, f, min(turn) AS turn, list(chunk ORDER BY turn) AS chunks FROM k WHERE chunk <> '' GROUP BY ALL), e AS (SELECT conv_id, f, turn, '체육: ' || {_FOLD} AS text FROM l WHERE length({_FOLD}) > 3),
 j AS (SELECT conv_id, min(f) AS f, max(CASE WHEN f = 0 THEN text END) AS a, max(CASE WHEN f = 1 THEN text END) AS b FROM e GROUP BY 1), m AS (SELECT conv_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR contains(a, b) THEN a ELSE {S.trim("a || ' ' || b")} END AS text FROM j),
 c AS (SELECT conv_id, text, substr(text, 5) AS body, strlen(substr(text, 5)) > 1620 AND regexp_matches(substr(text, 5), '[.!?]{S.SPACE}*체육:') AS cut FROM m)
 SELECT conv_id % 997 AS number, 'n' || conv_id AS name, 0 AS piece, CASE WHEN cut THEN '체육: ' || {S.trim(f"regexp_extract(body, '(?s)^(.*?[.!?]{S.SPACE}*)체육:', 1)")} ELSE text END AS text FROM c
 UNION ALL SELECT conv_id % 997, 'n' || conv_id, 1, '체육: ' || {S.trim(f"regexp_extract(body, '(?s)^.*?[.!?]{S.SPACE}*체육:(.*)$', 1)")} FROM c WHERE cut""")
def merged_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one person and subject in two files, merged across them, and cut again where that made them too long."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cells = ["'체육'", "'2'", "'1'", "string(conv_id % 997)", "concat('n', conv_id)", "coalesce(text, '')"]
    rows = _sheet(turns, "conv_id * 1000 + turn + 10", cells).withColumn("source_file", F.when(F.col("source_row") % 2 == 0, "a.xlsx").otherwise("b.xlsx"))
    heads = turns.select((F.col("turn") % 2).alias("k")).distinct().select(F.when(F.col("k") == 0, "a.xlsx").otherwise("b.xlsx").alias("source_file"), F.lit("Sheet1").alias("sheet_name"), F.lit(1).cast("long").alias("source_row"), F.array(*map(F.lit, SUBJECT_HEAD)).alias("cells"))
    done = layouts.records(rows.unionByName(heads))
    return done.select(F.col("number").cast("long").alias("number"), "name", "piece", "text")
