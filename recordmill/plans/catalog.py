"""The registered queries over the record-audit operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions import rulebook
from recordmill.functions import text as T
from recordmill.operators import inspect, merge, review, risk, segment, sentences, similarity, spelling
from recordmill.operators import lines as lines_op
from recordmill.plans import audit
from recordmill.plans import sql as S
from recordmill.plans.records import HANGUL, cell_rows, from_documents, hangul, lines, packed_cells, people_lines, replaced, subject_sheets, with_key, with_tokens
from recordmill.sources import layouts, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


# Normal forms, keys and sizes


@query(f"WITH {S.RECORDS}, {S.TOKENS} SELECT r.record_order, normalized_text, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens, count(token) AS n_tokens FROM records r LEFT JOIN tokens t ON r.record_order = t.record_order GROUP BY ALL")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_tokens(from_documents(spark, sf_dir))
    return r.select("record_order", "normalized_text", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@query(f"""WITH {S.RECORDS} SELECT record_order, list_reduce([CAST(5381 AS BIGINT)] || list_transform(list_filter(string_split(name || '|' || class_name || '|' || subject || '|' || normalized_text, ''), lambda c: c <> ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS key_number FROM records""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_key(from_documents(spark, sf_dir))
    return r.select("record_order", F.conv(F.upper("check_key"), 36, 10).cast("long").alias("key_number"))


@query(f"""WITH {S.RECORDS}, b AS (SELECT record_order, strlen(regexp_replace(text, '^[^:]{{1,30}}:{S.SPACE}*', '')) AS body_bytes FROM records) SELECT record_order, CAST(body_bytes AS BIGINT) AS body_bytes, body_bytes > 1620 AS over_limit FROM b""")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_documents(spark, sf_dir)
    size = T.body_bytes(F.col("text"), F.col("record_type"))
    return r.select("record_order", size.alias("body_bytes"), (size > T.BYTE_LIMIT + T.BYTE_MARGIN).alias("over_limit"))


# Similarity


@query(f"WITH {S.RECORDS}, {S.GROUPS} SELECT record_order, group_size, partner AS exact_partner FROM groups")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(from_documents(spark, sf_dir)).select("record_order", "group_size", "exact_partner")


@query(f"WITH {S.RECORDS}, {S.TOKENS}, {S.GROUPS}, {S.BEST} SELECT record_order, match_order, round(similarity, 9) AS similarity FROM best")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.best_partners(with_tokens(from_documents(spark, sf_dir)))
    return best.select("record_order", "match_order", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {S.RECORDS}, {S.TOKENS}, {S.GROUPS}, {S.BEST.replace('WHERE similarity >= 0.45', '')} SELECT record_order, match_order, round(similarity, 9) AS similarity FROM best")
def best_match_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best partner of every record, near or not."""
    best = similarity.best_partners_of_all(with_tokens(from_documents(spark, sf_dir)))
    return best.select("record_order", "match_order", F.round("similarity", 9).alias("similarity"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.matched(with_tokens(from_documents(spark, sf_dir)))


MATCHED = f"""WITH {S.RECORDS}, {S.TOKENS}, {S.GROUPS}, {S.BEST}, matched AS (SELECT r.*, g.group_size, coalesce(g.partner, b.match_order) AS match_order, CASE WHEN g.partner IS NOT NULL THEN 1.0 ELSE coalesce(b.similarity, 0.0) END AS similarity
 FROM records r JOIN groups g ON r.record_order = g.record_order LEFT JOIN best b ON b.record_order = r.record_order)"""


@query(MATCHED + ", keys AS (SELECT m.record_order, t.token, t.pos FROM matched m JOIN tokens t ON t.record_order = m.record_order JOIN tokens o ON o.record_order = m.match_order AND o.token = t.token WHERE length(t.token) > 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY record_order ORDER BY pos) AS rn FROM keys) SELECT record_order, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (rn <= 18), '') AS keywords, count(*) AS n_keywords FROM ranked GROUP BY 1")
def shared_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(spark, sf_dir).where("match_order IS NOT NULL")
    first, count = similarity.shared_keywords(F.col("tokens"), T.tokens(T.normalize(F.col("match_text"))))
    return m.select("record_order", F.array_join(first, " ").alias("keywords"), count.cast("long").alias("n_keywords")).where("n_keywords > 0")


# Sentences


@query(f"WITH {S.RECORDS}, {S.SENTENCES} SELECT record_order, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM sentences GROUP BY 1")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences.exploded(from_documents(spark, sf_dir))
    return s.groupBy("record_order").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query(f"WITH {S.RECORDS}, {S.SENTENCES} SELECT norm, count(DISTINCT record_order) AS n_records FROM sentences WHERE length(norm) >= 8 GROUP BY 1 HAVING count(DISTINCT record_order) >= 2")
def sentence_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.reuse(from_documents(spark, sf_dir)).where("n_records >= 2")


@query(f"""WITH {S.RECORDS}, {S.SENTENCES}, used AS (SELECT norm, count(DISTINCT record_order) AS n_records FROM sentences WHERE length(norm) >= 8 GROUP BY 1 HAVING count(DISTINCT record_order) >= 2),
 own AS (SELECT record_order, norm, min("at") AS "at", arg_min(sentence, "at") AS sentence FROM sentences GROUP BY ALL), ranked AS (SELECT record_order, row_number() OVER (PARTITION BY record_order ORDER BY n_records DESC, "at") AS rank, sentence, n_records FROM own JOIN used USING (norm))
 SELECT record_order, CAST(rank AS INTEGER) AS rank, {S.trim("sentence")} AS sentence, n_records FROM ranked WHERE rank <= 8""")
def reused_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.reused_top(from_documents(spark, sf_dir))


ALIGNED = MATCHED + f""", {S.SENTENCES}, words AS (SELECT record_order, "at", list_distinct(list_filter(string_split(norm, ' '), lambda t: length(t) > 1)) AS w FROM sentences),
 pairs AS (SELECT a.record_order, a."at", a.sentence, b."at" AS bat, b.sentence AS bs, length(a.norm) >= 8 AND a.norm = b.norm AS exact, len(list_intersect(wa.w, wb.w)) AS k, len(wa.w) + len(wb.w) AS n
   FROM matched m JOIN sentences a ON a.record_order = m.record_order JOIN words wa ON wa.record_order = a.record_order AND wa."at" = a."at" JOIN sentences b ON b.record_order = m.match_order JOIN words wb ON wb.record_order = b.record_order AND wb."at" = b."at" WHERE m.match_order IS NOT NULL),
 scored2 AS (SELECT *, CASE WHEN exact THEN 1.0 WHEN n - k > 0 THEN k / (n - k) ELSE 0 END AS score FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY record_order, "at" ORDER BY exact DESC, score DESC, bat) AS rn FROM scored2)
 """


@query(ALIGNED + "SELECT record_order, CAST(\"at\" AS INTEGER) AS \"at\", CASE WHEN exact THEN 'exact' WHEN score >= 0.5 AND k >= 3 THEN 'similar' ELSE 'none' END AS level, round(score, 9) AS score, CAST(CASE WHEN score > 0 THEN bat ELSE -1 END AS INTEGER) AS match_at FROM ranked WHERE rn = 1")
def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sentences.align(matched(spark, sf_dir).where("match_order IS NOT NULL"))
    return a.select("record_order", "at", "level", F.round("score", 9).alias("score"), "match_at")


@query(ALIGNED + "SELECT record_order, count(*) FILTER (exact) AS exact_sentences FROM ranked WHERE rn = 1 GROUP BY 1")
def exact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.exact_count(sentences.align(matched(spark, sf_dir).where("match_order IS NOT NULL")))


_LCS = """list_reduce([[CAST(0 AS BIGINT)] || list_transform(b, lambda y: CAST(0 AS BIGINT))] || list_transform(a, lambda x: [CAST(list_position(ws, x) AS BIGINT)]),
   lambda row, x: list_reduce([[CAST(0 AS BIGINT)]] || list_transform(range(1, len(b) + 1), lambda j: [j]), lambda line, j: line || [CASE WHEN ws[x[1]] = b[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], line[j[1]]) END]))[len(b) + 1]"""
_FORM = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"


@query(ALIGNED + f""", alike AS (SELECT record_order, CAST("at" AS INTEGER) AS "at", {_FORM.format("sentence")} AS a, {_FORM.format("bs")} AS b FROM ranked WHERE rn = 1 AND NOT exact AND score >= 0.5 AND k >= 3),
 s AS (SELECT *, list_distinct(a) AS ws FROM alike) SELECT record_order, "at", len(a) AS n_words, len(a) - {_LCS} AS n_changed FROM s""")
def changed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each similar sentence are missing from the longest common subsequence with its match."""
    d = sentences.differences(sentences.align(matched(spark, sf_dir).where("match_order IS NOT NULL")))
    count = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.size(F.regexp_extract_all(r["text"], F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return d.select("record_order", "at", count(F.col("runs")).alias("n_words"), count(F.filter("runs", lambda r: r["changed"])).alias("n_changed"))


@query()
def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sentences.differences(sentences.align(matched(spark, sf_dir).where("match_order IS NOT NULL")))
    return d.select("record_order", "at", F.to_json("runs").alias("runs"))


# Rule audit. SQL has neither lookaround nor back-references: those conditions are spelled out there.


def found_sql(records: str, label: str, pattern: str, keep: str = "true", text: str = "text") -> str:
    """SQL for all matches of a pattern in a records table: (record_order, label, match, start)."""
    rx = pattern.replace("'", "''")
    return f"""(SELECT record_order, '{label}' AS label, hit AS match, CAST(start AS INTEGER) AS start FROM (SELECT record_order, text, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))) AS start
   FROM (SELECT record_order, {text} AS text, regexp_extract_all({text}, '{rx}') AS hits, string_split_regex({text}, '{rx}') AS gaps FROM {records} WHERE regexp_matches({text}, '{rx}'))) WHERE {keep})"""


@query(f"WITH {S.RECORDS} SELECT record_order, label, match, start FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}")
def issues_repeated_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    return inspect.scan(from_documents(spark, sf_dir), rules).select("record_order", "label", "match", "start")


@query(f"WITH {S.RECORDS} SELECT record_order, label, match, start FROM {found_sql('records', '문장 띄어쓰기', r'[.!?]', "regexp_matches(substr(text, CAST(start AS BIGINT) + 2, 1), '^[가-힣A-Za-z]')")}")
def issues_missing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장 띄어쓰기")
    return inspect.scan(from_documents(spark, sf_dir), rules).select("record_order", "label", "match", "start")


@query(f"WITH {S.RECORDS} SELECT record_order, label, match, start FROM {found_sql('records', '특수기호', rulebook.SYMBOLS)}")
def issues_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.scan(from_documents(spark, sf_dir), rulebook.SYMBOL).select("record_order", "label", "match", "start")


@query(f"WITH {S.RECORDS}, found AS (SELECT * FROM {found_sql('records', '따옴표 모양', '[‘’“”]')} UNION ALL SELECT * FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}), ranked AS (SELECT *, row_number() OVER (PARTITION BY record_order ORDER BY start, label, match) AS rn FROM (SELECT DISTINCT * FROM found)) SELECT record_order, label, match, start FROM ranked WHERE rn <= 10")
def issue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label in ("따옴표 모양", "문장부호 반복"))
    return inspect.capped(inspect.scan(from_documents(spark, sf_dir), rules)).select("record_order", "label", "match", "start")


@query(f"""WITH {S.RECORDS} SELECT record_order, '분량 초과' AS label, strlen(regexp_replace(text, '^[^:]{{1,30}}:{S.SPACE}*', '')) AS n_bytes FROM records WHERE strlen(regexp_replace(text, '^[^:]{{1,30}}:{S.SPACE}*', '')) > 1620""")
def length_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_documents(spark, sf_dir)
    over = inspect.overflows(r).select("record_order", "label")
    return over.join(r.select("record_order", T.body_bytes(F.col("text"), F.col("record_type")).alias("n_bytes")), "record_order")


#: Words of the invented prose, and what stands in their place where rules are to meet something.
SIGNS = ((" the ", " ★ "), (" and ", " → "), (" of ", " ① "))
NAMED = ((" the ", " 「구글」 "), (" in ", " 구글 "), (" and ", " 국세청 "), (" of ", " 국사편찬위원회 "))
BLOOD = ((" the ", " 헌혈 "), (" is ", " 대한적십자사 충북혈액원 "))
BRACKETS = (("q", "("), ("w", ")"), (" the ", " ( "), (" in ", " ) "))


@query(f"WITH {S.RECORDS}, changed AS (SELECT record_order, {S.replaced(SIGNS)} AS text FROM records), ranked AS (SELECT *, row_number() OVER (PARTITION BY record_order ORDER BY start) AS rn FROM {found_sql('changed', '특수기호', '[★→①]')}) SELECT record_order, match, start FROM ranked WHERE rn <= 10")
def issues_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspect.inspect(replaced(from_documents(spark, sf_dir), SIGNS))
    return found.where("type = 'symbol'").select("record_order", "match", "start")


@query(f"""WITH {S.RECORDS}, changed AS (SELECT record_order, {S.replaced(NAMED)} AS text FROM records), found AS (SELECT 'business' AS type, * FROM {found_sql('changed', '상호명', '구글', "substr(text, CAST(start AS BIGINT), 1) <> '「'")} UNION ALL SELECT 'institution' AS type, * FROM {found_sql('changed', '기관명', '국세청')}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY record_order, type ORDER BY start) AS rn FROM found) SELECT record_order, type, label, match, start FROM ranked WHERE rn <= 10""")
def issues_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of businesses outside titles, and of institutions that aren't allowed; the first ten of each type are those of
    the planted names."""
    found = inspect.inspect(replaced(from_documents(spark, sf_dir), NAMED), cap=1 << 30)
    return inspect.capped(found.where(F.col("match").isin("구글", "국세청", "국사편찬위원회"))).select("record_order", "type", "label", "match", "start")


@query(f"WITH {S.RECORDS}, changed AS (SELECT record_order, {S.replaced(BLOOD)} AS text FROM records) SELECT record_order, CAST(strpos(text, '헌혈') - 1 AS INTEGER) AS start FROM changed WHERE contains(text, '헌혈') AND NOT contains(text, '대한적십자사 충북혈액원')")
def issues_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mention of a donation in texts without the office's name, however many institutions stand before it."""
    return inspect.inspect(replaced(from_documents(spark, sf_dir), BLOOD), cap=1 << 30).where("label = '헌혈 기관명'").select("record_order", "start")


@query(f"""WITH {S.RECORDS}, changed AS (SELECT record_order, regexp_replace({S.replaced(BRACKETS)}, '[‘’“”''"\\[\\]「」『』〈〉《》]', ' ', 'g') AS text FROM records),
 marks AS (SELECT * FROM (SELECT record_order, unnest(range(0, length(text))) AS start, unnest(string_split(text, '')) AS c FROM changed WHERE length(text) > 0) WHERE c IN ('(', ')')),
 depths AS (SELECT *, sum(CASE WHEN c = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY record_order ORDER BY start) AS depth FROM marks),
 bounds AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY record_order ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low, min(depth) OVER (PARTITION BY record_order ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM depths)
 SELECT record_order, c AS match, CAST(start AS INTEGER) AS start FROM bounds WHERE (c = ')' AND depth < low) OR (c = '(' AND later >= depth)""")
def unmatched_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = replaced(from_documents(spark, sf_dir), BRACKETS)
    changed = changed.withColumn("text", F.regexp_replace("text", "[‘’“”'\"\\[\\]「」『』〈〉《》]", " "))
    found = inspect.inspect(changed, cap=1 << 30)
    return found.where("label = '짝 안 맞는 부호'").select("record_order", "match", "start")


@query(f"""WITH {S.RECORDS}, t AS (SELECT record_order, record_order % 4 + 2021 AS a, record_order % 3 + 2022 AS b, record_order // 3 % 2 + 2023 AS c, record_order % 40 AS d FROM records),
 terms AS (SELECT record_order, 1 AS k, 0 AS start, a - 1 AS o, '학급 임원(' AS lead, a || '.03.01.-' || a || '.08.' || lpad(CAST(d AS VARCHAR), 2, '0') || '.' AS match, CASE WHEN d = 0 OR d > 31 THEN 'danger' WHEN d <> 31 THEN 'warning' END AS severity FROM t
   UNION ALL SELECT record_order, 2, 0, b - 2, '', b || '.03.01.-' || b || '.08.31.', NULL FROM t UNION ALL SELECT record_order, 3, 0, c - 3, '', c || '.03.01.-' || c || '.08.31.', NULL FROM t),
 held AS (SELECT * FROM terms WHERE severity IS DISTINCT FROM 'danger'), votes AS (SELECT record_order, o, count(*) AS n, min(k) AS k FROM held GROUP BY ALL), usual AS (SELECT record_order, o FROM (SELECT *, row_number() OVER (PARTITION BY record_order ORDER BY n DESC, k) AS rn FROM votes) WHERE rn = 1)
 SELECT record_order, match, severity FROM terms WHERE severity IS NOT NULL UNION ALL SELECT h.record_order, match, 'danger' FROM held h JOIN usual u ON u.record_order = h.record_order AND u.o <> h.o WHERE severity IS NULL""")
def issues_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of office: days that don't exist, ends that aren't due, years that don't fit the grade."""
    n = F.col("record_order")
    term = lambda year, day: F.concat(year.cast("string"), F.lit(".03.01.-"), year.cast("string"), F.lit(".08."), day, F.lit("."))
    years = n % 4 + 2021, n % 3 + 2022, F.floor(n / 3) % 2 + 2023
    text = F.concat(F.lit("1학년 학급 임원("), term(years[0], F.lpad((n % 40).cast("string"), 2, "0")), F.lit(") 2학년 반장("), term(years[1], F.lit("31")), F.lit(") 3학년 반장("), term(years[2], F.lit("31")), F.lit(")"))
    found = inspect.inspect(from_documents(spark, sf_dir).withColumn("text", text))
    return found.where("label = '임원 기간'").select("record_order", "match", "severity")


@query()
def issues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.inspect(from_documents(spark, sf_dir))


@query()
def issues_hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.inspect(hangul(from_documents(spark, sf_dir)))


@query()
def issue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.spans(inspect.inspect(from_documents(spark, sf_dir)))


# Risk, review and export, over matches and the issues of one rule that SQL can find too


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    r = with_key(with_tokens(from_documents(spark, sf_dir)))
    return audit.classify(similarity.matched(r), inspect.scan(r, rules))


CLASSIFIED = MATCHED + f""", issues AS (SELECT * FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}), issue_counts AS (SELECT record_order, count(*) AS n_issues FROM issues GROUP BY 1),
 classified AS (SELECT m.*, coalesce(n_issues, 0) AS n_issues, CASE WHEN group_size > 1 OR similarity >= 0.9995 THEN 'exact' WHEN similarity >= 0.65 THEN 'high' WHEN n_issues > 0 OR similarity >= 0.45 THEN 'review' ELSE 'normal' END AS status
   FROM matched m LEFT JOIN issue_counts i ON i.record_order = m.record_order) """


@query(CLASSIFIED + "SELECT record_order, status, n_issues, match_order, round(similarity, 9) AS similarity FROM classified")
def risk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("record_order", "status", "n_issues", "match_order", F.round("similarity", 9).alias("similarity"))


@query(CLASSIFIED + "SELECT *, round(exact / greatest(total, 1), 9) AS exact_share, round(high / greatest(total, 1), 9) AS high_share, round(review / greatest(total, 1), 9) AS review_share, round(normal / greatest(total, 1), 9) AS normal_share FROM (SELECT count(*) AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'normal') AS normal, count(*) FILTER (status <> 'normal') AS flagged FROM classified)")
def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = risk.counts(classified(spark, sf_dir))
    return c.select(*[F.round(x, 9).alias(x) if x.endswith("_share") else x for x in c.columns])


@query(CLASSIFIED + "SELECT subject, count(*) AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'review') AS review FROM classified GROUP BY 1")
def subject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.ordered_summary(risk.subject_summary(classified(spark, sf_dir)))


@query(f"WITH {S.RECORDS} SELECT subject, count(*) FILTER (grade = 'g1') AS g1, count(*) FILTER (grade = 'g2') AS g2, count(*) FILTER (grade = 'g3') AS g3 FROM records GROUP BY 1")
def grade_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.grade_crosstab(from_documents(spark, sf_dir), ["g1", "g2", "g3"])


@query(CLASSIFIED + "SELECT subject, flagged, total, round(flagged / total, 9) AS share FROM (SELECT subject, count(*) FILTER (status <> 'normal') AS flagged, count(*) AS total FROM classified GROUP BY 1) ORDER BY flagged DESC, total DESC, subject LIMIT 5")
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.top_subjects(classified(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {S.RECORDS}, i AS (SELECT * FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}) SELECT t.type, CASE WHEN t.type = 'typo' THEN (SELECT count(DISTINCT record_order) FROM i) ELSE 0 END AS n_records FROM (VALUES ('typo'), ('symbol'), ('prohibited'), ('institution'), ('business')) t(type)")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    return risk.by_issue_type(inspect.scan(from_documents(spark, sf_dir), rules))


@query(f"WITH {S.RECORDS} SELECT CASE WHEN bool_and(record_type = 'creative') THEN 'creative' WHEN bool_and(record_type = 'subject') THEN 'subject' ELSE 'mixed' END AS mode FROM records")
def record_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.record_mode(from_documents(spark, sf_dir))


@query(f"WITH {S.RECORDS} SELECT DISTINCT class_name FROM records")
def class_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.filter_values(from_documents(spark, sf_dir), "class_name")


@query(f"WITH {S.RECORDS} SELECT DISTINCT subject FROM records")
def subject_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.filter_values(from_documents(spark, sf_dir), "subject")


ORDER = "CASE status WHEN 'exact' THEN 0 WHEN 'high' THEN 1 WHEN 'review' THEN 2 ELSE 3 END, n_issues DESC, similarity DESC, name, record_order"


@query(CLASSIFIED + f"SELECT record_order, status, n_issues FROM classified ORDER BY {ORDER} LIMIT 30 OFFSET 30")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page(classified(spark, sf_dir), "priority", 2).select("record_order", "status", "n_issues")


@query(CLASSIFIED + "SELECT record_order, round(similarity, 9) AS similarity FROM classified ORDER BY similarity DESC, name, record_order LIMIT 30")
def review_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page(classified(spark, sf_dir), "risk").select("record_order", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {S.RECORDS} SELECT record_order, name FROM records ORDER BY name, record_order LIMIT 30 OFFSET 60")
def review_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page(from_documents(spark, sf_dir), "name", 3).select("record_order", "name")


@query(f"WITH {S.RECORDS} SELECT record_order, subject FROM records ORDER BY subject, record_order LIMIT 30 OFFSET 60")
def review_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page(from_documents(spark, sf_dir), "subject", 3).select("record_order", "subject")


@query(CLASSIFIED + f"SELECT c.record_order, status FROM classified c LEFT JOIN records o ON o.record_order = c.match_order WHERE {S.normalize("concat_ws(' ', c.name, c.class_name, c.subject, c.text, o.name)")} LIKE '%the of%' AND status <> 'normal'")
def review_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.filtered(classified(spark, sf_dir), term="The, of").where("status <> 'normal'").select("record_order", "status")


def marked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked keys: the records whose number is that of a user with a purchase."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.col("user_id").alias("record_order")).distinct()
    return with_key(from_documents(spark, sf_dir)).join(users, "record_order", "left_semi").select("content")


CHECKED = f"WITH {S.RECORDS}, full_key AS (SELECT *, name || '|' || class_name || '|' || subject || '|' || normalized_text AS k FROM records), marked AS (SELECT DISTINCT k FROM full_key WHERE record_order IN (SELECT user_id FROM events WHERE event_type = 'purchase')) "


@query(CHECKED + "SELECT record_order FROM full_key WHERE k NOT IN (SELECT k FROM marked)")
def hide_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unchecked(with_key(from_documents(spark, sf_dir)), marked_keys(spark, sf_dir)).select("record_order")


@query(CHECKED + "SELECT count(*) AS n_checked FROM full_key WHERE k IN (SELECT k FROM marked)")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(with_key(from_documents(spark, sf_dir)), marked_keys(spark, sf_dir))


@query(f"WITH {S.RECORDS}, i AS (SELECT *, CAST(record_order AS VARCHAR) || '|typo|' || start || '|' || match AS issue_key FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}), e AS (SELECT DISTINCT issue_key FROM i WHERE start % 3 = 0) SELECT record_order, start, match, issue_key NOT IN (SELECT issue_key FROM e) AS kept FROM i")
def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    i = inspect.scan(from_documents(spark, sf_dir), rules)
    i = i.withColumn("issue_key", T.issue_key(F.col("record_order").cast("string"), F.col("type"), F.col("start"), F.col("match")))
    kept, out = review.excepted(i, i.where("start % 3 = 0"))
    return kept.withColumn("kept", F.lit(True)).unionByName(out.withColumn("kept", F.lit(False))).select("record_order", "start", "match", "kept")


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS marked_at FROM events GROUP BY 1 ORDER BY marked_at DESC, key LIMIT 50000")
def review_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return review.newest(e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("marked_at")))


@query(CLASSIFIED + f""", labels AS (SELECT record_order, string_agg(match, ', ' ORDER BY start) AS issue_matches FROM issues GROUP BY 1), sized AS (SELECT *, strlen(regexp_replace(text, '^[^:]{{1,30}}:{S.SPACE}*', '')) AS b FROM classified)
 SELECT c.record_order, c.name, CAST(c.b AS BIGINT) AS n_bytes, c.b > 1620 AS over_limit, round(c.similarity, 9) AS similarity, coalesce(o.name, '') AS match_name, c.status, CASE WHEN n_issues > 0 THEN '문장부호 반복' ELSE '' END AS issue_labels, coalesce(l.issue_matches, '') AS issue_matches
 FROM sized c LEFT JOIN records o ON o.record_order = c.match_order LEFT JOIN labels l ON l.record_order = c.record_order""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sinks.details(classified(spark, sf_dir))
    return d.select("record_order", "name", "n_bytes", "over_limit", F.round("similarity", 9).alias("similarity"), "match_name", "status", "issue_labels", "issue_matches")


@query()
def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_issues(inspect.inspect(from_documents(spark, sf_dir)))


@query(CLASSIFIED + "SELECT subject, count(*) FILTER (grade = 'g1') AS g1, count(*) FILTER (grade = 'g2') AS g2, count(*) FILTER (grade = 'g3') AS g3, count(*) AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'review') AS review FROM classified GROUP BY 1")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary(classified(spark, sf_dir), ["g1", "g2", "g3"])


@query(CHECKED + "SELECT record_order FROM full_key WHERE k IN (SELECT k FROM marked)")
def checked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.checked(with_key(from_documents(spark, sf_dir)), marked_keys(spark, sf_dir)).select("record_order")


@query(CLASSIFIED + "SELECT record_order, class_name FROM classified WHERE status = 'review' AND n_issues > 0 AND subject = 'en'")
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.filtered(classified(spark, sf_dir), status="review", issue_type="typo", subject="en").select("record_order", "class_name")


@query(f"WITH {S.RECORDS}, ranked AS (SELECT record_order, grade, row_number() OVER (PARTITION BY grade ORDER BY CAST(nullif(regexp_extract(class_name, '([0-9]+)', 1), '') AS BIGINT), class_name, CAST(number AS BIGINT), subject, record_order) AS place FROM records) SELECT record_order, grade, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 30")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_places(spark, sf_dir).where("place <= 30")


@query(f"WITH {S.RECORDS} SELECT record_order, grade, CAST(row_number() OVER (PARTITION BY grade ORDER BY CAST(nullif(regexp_extract(class_name, '([0-9]+)', 1), '') AS BIGINT), class_name, CAST(number AS BIGINT), subject, record_order) AS INTEGER) AS place FROM records")
def class_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_documents(spark, sf_dir).select("record_order", "grade", "class_name", "number", "subject")
    return review.in_group_rank(r, "grade", "class").select("record_order", "grade", "place")


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS marked_at FROM events WHERE event_type = 'purchase' GROUP BY 1), t AS (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS marked_at FROM events WHERE event_type <> 'purchase' AND user_id % 2 = 0 GROUP BY 1)
 SELECT * FROM s WHERE key NOT IN (SELECT key FROM t) UNION ALL SELECT * FROM t WHERE key NOT IN (SELECT key FROM s)""")
def toggled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id"), "event_type", F.col("ts").alias("marked_at"))
    newest = lambda df: df.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("marked_at").alias("marked_at"))
    return review.toggled(newest(e.where("event_type = 'purchase'")), newest(e.where("event_type <> 'purchase' AND user_id % 2 = 0")))


@query(f"WITH {S.RECORDS}, i AS (SELECT * FROM {found_sql('records', '문장부호 반복', r'\.\.+|,,+|!!+|\?\?+')}) SELECT 'typo' AS type, '문장부호 반복' AS label, 'typo' AS category, count(*) AS n_issues FROM i HAVING count(*) > 0")
def issue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    found = inspect.scan(from_documents(spark, sf_dir), rules)
    return found.groupBy("type", "label", T.issue_category(F.col("label"), F.col("type")).alias("category")).agg(F.count(F.lit(1)).alias("n_issues"))


@query(CLASSIFIED + "SELECT record_order, name, class_name, subject, text, status, round(similarity, 6) AS similarity, match_order FROM classified")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_records(classified(spark, sf_dir))


def _two_rules() -> tuple[rulebook.Rule, ...]:
    return tuple(r for r in rulebook.RULES if r.label in ("따옴표 모양", "문장부호 반복"))


def _rules_sql() -> str:
    """The rules of two labels, numbered by first use, and their issues."""
    found = " UNION ALL ".join(f"SELECT '{r.type}' AS type, label, '{r.reference}' AS reference, '{r.severity}' AS severity, '{r.guidance}' AS guidance, record_order, match, start FROM {found_sql('records', r.label, rx)}" for r, rx in zip(_two_rules(), (r"\.\.+|,,+|!!+|\?\?+", "[‘’“”]"), strict=True))
    return f"WITH {S.RECORDS}, found AS ({found}), firsts AS (SELECT type, label, reference, severity, guidance, min(record_order * 1000000000 + start) AS first FROM found GROUP BY ALL), rules AS (SELECT *, CAST(row_number() OVER (ORDER BY first, type, label) - 1 AS INTEGER) AS rule FROM firsts) "


@query(_rules_sql() + "SELECT type, label, reference, severity, guidance, rule FROM rules")
def report_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_rules(inspect.scan(from_documents(spark, sf_dir), _two_rules()))


@query(_rules_sql() + "SELECT record_order, rule, start, match FROM found JOIN rules USING (type, label)")
def report_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_issues(inspect.scan(from_documents(spark, sf_dir), _two_rules()))


@query()
def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_rules(inspect.inspect(from_documents(spark, sf_dir)))


# Spelling, over prose in Hangul letters; words of 20 uses or more make the dictionary


def _dictionary(words: DataFrame) -> DataFrame:
    return words.where("n >= 20").select("word")


HANGUL_SQL = f"h AS (SELECT record_order, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HANGUL}') AS text FROM records), words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[가-힣]+')) AS word FROM h) WHERE length(word) >= 2 GROUP BY 1), known AS (SELECT word FROM words WHERE n >= 20)"


@query(f"WITH {S.RECORDS}, {HANGUL_SQL} SELECT word, n FROM words")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.frequency(hangul(from_documents(spark, sf_dir)))


@query(f"""WITH {S.RECORDS}, {HANGUL_SQL}, rare AS (SELECT word, n FROM words WHERE length(word) >= 3 AND n <= 2 AND word NOT IN (SELECT word FROM known)),
 regular AS (SELECT DISTINCT r.word FROM rare r JOIN (SELECT unnest(string_split('{" ".join(spelling.STRIPPED)}', ' ')) AS e) x ON suffix(r.word, e) AND length(r.word) - length(e) >= 2 JOIN known k ON k.word = left(r.word, CAST(length(r.word) - length(e) AS BIGINT))),
 often AS (SELECT word, n FROM words WHERE n >= 10 AND length(word) >= 3 AND word IN (SELECT word FROM known)),
 a AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM rare WHERE word NOT IN (SELECT word FROM regular))),
 b AS (SELECT word AS near, n AS near_n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM often)),
 pairs AS (SELECT word, near, near_n, a.i, ord(substr(word, a.i, 1)) - 44032 AS x, ord(substr(near, a.i, 1)) - 44032 AS y FROM a JOIN b ON a.i = b.i AND a.rest = b.rest WHERE left(word, 1) = left(near, 1) AND word <> near),
 good AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, i, near) AS rn FROM pairs WHERE CAST(x // 588 <> y // 588 AS INTEGER) + CAST((x % 588) // 28 <> (y % 588) // 28 AS INTEGER) + CAST(x % 28 <> y % 28 AS INTEGER) = 1 AND NOT (i = length(word) AND contains('{spelling.PRODUCTIVE}', right(word, 1))))
 SELECT word, near AS suggestion FROM good WHERE rn = 1""")
def spelling_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.frequency(hangul(from_documents(spark, sf_dir)))
    return spelling.verdicts(words, _dictionary(words)).where("explanation = 'neighbour'").select("word", "suggestion")


#: The same letters with closed syllables and particles among them.
PARTICLES = "가나다이마바사아자차카발파간너더러는을은버서어저처커"


@query(f"""WITH {S.RECORDS}, h AS (SELECT record_order, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{PARTICLES}') AS text FROM records), words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[가-힣]+')) AS word FROM h) WHERE length(word) >= 2 GROUP BY 1), known AS (SELECT word AS k FROM words WHERE n >= 20),
 u AS (SELECT word, right(word, 1) AS last, left(word, length(word) - 1) AS stem FROM words WHERE length(word) >= 3 AND n <= 5), due AS (SELECT * FROM (VALUES ('을', '을', '를'), ('를', '을', '를'), ('은', '은', '는'), ('는', '은', '는'), ('이', '이', '가'), ('가', '이', '가'), ('과', '과', '와'), ('와', '과', '와')) d(last, closed, open)),
 r AS (SELECT word, stem, u.last, CASE WHEN (ord(right(stem, 1)) - 44032) % 28 <> 0 THEN closed ELSE open END AS fit FROM u JOIN due ON due.last = u.last JOIN known ON known.k = u.stem)
 SELECT word, stem || fit AS suggestion FROM r WHERE fit <> last""")
def spelling_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_documents(spark, sf_dir)
    words = spelling.frequency(r.withColumn("text", F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", PARTICLES)))
    return spelling.verdicts(words, _dictionary(words)).where("explanation = 'particle'").select("word", "suggestion")


@query()
def dictionary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit with a dictionary: records by status and issue type."""
    r = with_key(with_tokens(hangul(from_documents(spark, sf_dir))))
    records, _ = audit.audit(r, dictionary=_dictionary(spelling.frequency(r)))
    return records.groupBy("status", F.array_join("issue_types", " ").alias("types")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_issues").alias("n_issues"))


@query()
def spelling_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hangul(from_documents(spark, sf_dir))
    return spelling.suspects(r, _dictionary(spelling.frequency(r)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document audited: issues, best match, risk, and the summary by subject."""
    records, _ = audit.audit(with_key(with_tokens(from_documents(spark, sf_dir))))
    return risk.ordered_summary(risk.subject_summary(records))


@query()
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# Rows to records


@query(f"""WITH c AS (SELECT conv_id, role, turn, coalesce(text, '') AS chunk FROM conversations), l AS (SELECT conv_id, role, min(turn) AS turn, list(chunk ORDER BY turn, chunk) AS chunks FROM c GROUP BY ALL)
 SELECT conv_id, role, turn, list_reduce(chunks, lambda a, b: CASE WHEN contains(regexp_replace(a, '{S.SPACE}+', '', 'g'), regexp_replace(b, '{S.SPACE}+', '', 'g')) THEN a ELSE {S.trim("a || ' ' || b")} END) AS chunk FROM l""")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("chunk", F.coalesce("text", F.lit("")))
    return merge.merge(turns, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "chunk")


CELLS = """c AS (SELECT 'f' || (conv_id % 7) AS source_file, conv_id * 1000 + turn + 10 AS source_row, CASE WHEN turn = 0 THEN CAST(conv_id % 40 AS VARCHAR) END AS number, CASE WHEN turn % 2 = 0 THEN 'n' || (conv_id % 5) END AS name,
  CASE WHEN turn % 3 = 0 THEN (conv_id % 3 + 1) || '학년' END AS grade, coalesce(text, '') AS detail FROM conversations WHERE coalesce(text, '') <> '')"""


@query(f"""WITH {CELLS}, n AS (SELECT *, last_value(name IGNORE NULLS) OVER w AS who, last_value(number IGNORE NULLS) OVER w AS num FROM c WINDOW w AS (PARTITION BY source_file ORDER BY source_row ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, CASE WHEN who IS NOT NULL AND who IS DISTINCT FROM lag(who) OVER (PARTITION BY source_file ORDER BY source_row) THEN 1 ELSE 0 END AS changed FROM n), g AS (SELECT *, sum(changed) OVER (PARTITION BY source_file ORDER BY source_row ROWS UNBOUNDED PRECEDING) AS person FROM p)
 SELECT source_file, source_row, who AS name, coalesce(num, '') AS number, coalesce(last_value(grade IGNORE NULLS) OVER (PARTITION BY source_file, person ORDER BY source_row ROWS UNBOUNDED PRECEDING), '') AS grade FROM g WHERE who IS NOT NULL""")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cell_rows(spark, sf_dir).where("source_row > 9")
    return layouts.class_rows(rows).select("source_file", "source_row", "name", "number", "grade")


@query("SELECT DISTINCT 'f' || (conv_id % 7) AS source_file, CASE conv_id % 7 WHEN 1 THEN 'creative' WHEN 2 THEN 'subject' WHEN 3 THEN 'generic' ELSE 'class' END AS layout FROM conversations")
def layout_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.layouts(cell_rows(spark, sf_dir))


@query()
def layout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.records(cell_rows(spark, sf_dir)).select(*layouts.RECORD)


def sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.records(subject_sheets(spark, sf_dir))


@query(f"WITH {S.SHEETS} SELECT record_order, subject, number, name, text FROM records")
def sheets_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_records(spark, sf_dir).select("record_order", "subject", "number", "name", "text")


@query(CLASSIFIED.replace(S.RECORDS, S.SHEETS) + "SELECT record_order, group_size, status, n_issues, match_order, round(similarity, 9) AS similarity FROM classified")
def sheets_to_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells of sheets to classified records."""
    rules = tuple(r for r in rulebook.RULES if r.label == "문장부호 반복")
    r = with_key(sheet_records(spark, sf_dir))
    return audit.classify(similarity.matched(r), inspect.scan(r, rules)).select("record_order", "group_size", "status", "n_issues", "match_order", F.round("similarity", 9).alias("similarity"))


@query("""WITH p AS (SELECT doc_id AS person, doc_id % 2 = 0 AS named, doc_id % 3 + 1 AS last FROM documents), g AS (SELECT *, CASE WHEN named THEN 3 ELSE last END AS grade FROM p)
 SELECT CASE WHEN named THEN '3학년 4반.pdf' ELSE 'x.pdf' END AS source_file, person, 'n' || person AS name, grade || '학년' AS grade, grade || '학년 ' || CASE WHEN named AND last < 3 THEN 4 ELSE person % 9 + last END || '반' AS class_name, CAST(person % 35 + last AS VARCHAR) AS number FROM g""")
def line_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and classes of the persons of extracted lines."""
    rows = people_lines(spark, sf_dir)
    people = lines_op.names(rows)
    return people.join(lines_op.classes(people.select("source_file", "person"), lines_op.enrolments(rows)), ["source_file", "person"])


@query()
def lines_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_op.records(lines(spark, sf_dir))


@query()
def subject_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.names(packed_cells(spark, sf_dir))


@query()
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split(packed_cells(spark, sf_dir)).select("source_file", "source_row", "pos", "name", "part")


@query("WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id % 4 <> 0) SELECT 'f' || (doc_id % 7) AS source_file, doc_id AS person, list_reduce(ls, lambda a, b: CASE WHEN a = '' THEN b WHEN regexp_matches(a, '[.!?,]$') THEN a || ' ' || b ELSE a || b END) AS text FROM l")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_op.joined(lines_op.section_lines(lines(spark, sf_dir)))


@query()
def resplit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.resplit_records(from_documents(spark, sf_dir)).select("record_order", "piece", "subject", "text")
