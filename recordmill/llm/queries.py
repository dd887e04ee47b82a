"""The thin queries opN_<name> over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import bpe, decontaminate, htmltext, langid, nearest, ngram, pii, repair, secrets, simhash, toxicity, trie, warc
from recordmill.llm.common import bound_batches, fold
from recordmill.session import fresh_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the bytes they decode to, as digests."""
    return bpe.digests(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labelled rows outside fold 0 of 5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    path = fresh_path(spark, "archive")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.digest_report(spark, path)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, by a ledger that starts empty."""
    return secrets.report(read(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every hundredth."""
    table = read(spark, sf_dir, "embeddings")
    return nearest.search(table, table.where(F.col("vec_id") % 100 == 0), k=10)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights from the pages whose markup declares their content."""
    return htmltext.main_text(spark, read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from rows outside fold 0 of 5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = langid.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), langid.predict(F.col("text"), prototypes).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under an interpolated pair model, learned from rows outside fold 0 of 10."""
    return ngram.scores(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.components_of(read(spark, sf_dir, "documents"), size=4, radius=4)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base patterns, and what a tagger learned from them adds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bound_batches(spark, 2000)  # many windows of about one length are tagged at once
    found = docs.select("doc_id", pii.spans(F.col("text").cast("string"), pii.fit(docs), spark).alias("s"))
    base = F.filter("s", lambda x: x["source"] == "base")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lightest repair of every conversation after its rows are damaged."""
    table = read(spark, sf_dir, "conversations")
    found = repair.report(repair.damaged(table), repair.TIES)
    ids = table.select(F.col("conv_id").alias("id")).distinct()
    all_ids = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return all_ids.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in repair.COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over rebuilt conversations."""
    return trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_nearest": op6_nearest,
    "op7_html": op7_html,
    "op8_language": op8_language,
    "op9_lm": op9_lm,
    "op10_simhash": op10_simhash,
    "op11_pii": op11_pii,
    "op12_repair": op12_repair,
    "op13_trie": op13_trie,
}
_SPANS = """(SELECT doc_id, '{kind}' AS kind, {rank} AS rank, n, start, start + n AS stop FROM (
  SELECT doc_id, unnest(hits) AS hit, unnest(list_transform(hits, lambda x: len(x))) AS n, unnest(parts) AS part,
    unnest(list_transform(range(1, len(hits) + 1), lambda i: CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS BIGINT))) AS start
  FROM (SELECT doc_id, regexp_extract_all(text, {rx}, 0) AS hits, regexp_extract_all(text, {rx}, {group}) AS parts, string_split_regex(text, {rx}) AS gaps
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, {rx})))
 WHERE len(part) >= {least})"""


def _secret_sql() -> str:
    """Positions are the lengths of what stands before a match: the gaps between matches, and the matches."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        rx = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(_SPANS.format(kind=r.kind, rank=rank, rx=rx, group=r.group, least=r.at_least))
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    base = "rank < 3"
    return f"""WITH spans AS ({" UNION ALL ".join("SELECT * FROM " + p for p in parts)}),
 found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
   {text} FILTER ({base}) AS base, {text} AS spans FROM spans GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(h, c)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda h, c: {byte}), 4294967295)"


_TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
 parts AS (SELECT c.conv_id, 0 AS own, rank, role, text FROM c JOIN t ON t.conv_id = c.base AND rank <= h UNION ALL SELECT c.conv_id, 1, rank, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND rank > h),
 whole AS (SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY own, rank) FILTER (rank IS NOT NULL), []) AS seq FROM c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY 1),
 p AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS prefix, CASE WHEN d > 0 THEN seq[1:d - 1] END AS up, CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
 g AS (SELECT d, prefix, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM p GROUP BY d, prefix),
 k AS (SELECT d - 1 AS d, up AS prefix, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
 e AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.d = g.d AND k.prefix = g.prefix),
 s AS (SELECT p.d, p.prefix, count(*) FILTER (e.n_children = 0) AS n_leaves, sum((e.n_convs - 1) * e.bytes) AS saved FROM e JOIN p ON p.conv_id = e.conv_id AND p.d <= e.d GROUP BY p.d, p.prefix)
 SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
 FROM e JOIN s ON s.d = e.d AND s.prefix = e.prefix LEFT JOIN e u ON u.d = e.d - 1 AND u.prefix = e.up"""

def _repair_sql() -> str:
    """Weights are texts, nine digits of cost and the audit, whose order is that of the weights; a column for each state."""
    plus = lambda w, cost, edit: f"(lpad(CAST(CAST(left({w}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({w}, 10) || '{edit}')"
    stay = lambda w, more: f"CASE WHEN NOT must THEN {plus(w, more, 'R')} END"
    keep = lambda w, initial: f"CASE WHEN NOT must AND initial = '{initial}' THEN {plus(w, 'extra', 'K')} END"
    to_user = ", ".join(x for w in ("e", "s", "a") for x in (stay(w, "3 + extra"), keep(w, "u")))
    step = f"SELECT r.conv_id, r.i, {plus('e', 4, 'D')} AS e, least({plus('s', 4, 'D')}, {keep('e', 's')}) AS s, least({plus('u', 4, 'D')}, {to_user}) AS u, least({plus('a', 4, 'D')}, {stay('u', '3 + extra')}, {keep('u', 'a')}) AS a FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1"
    closed = f"SELECT conv_id, i, e, s, u, least(a, {plus('u', 3, 'I')}) AS a FROM (SELECT conv_id, i, e, s, least(u, {plus('e', 3, 'I')}, {plus('s', 3, 'I')}, {plus('a', 3, 'I')}) AS u, a FROM ({{}}))"
    start = "SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM sums"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, {crc32_sql(key)} % 20 AS code FROM conversations),
 x AS (SELECT conv_id, turn, role0, text0, CASE WHEN code = 4 THEN 'user' ELSE role0 END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE code <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS i FROM x),
 m AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM o),
 r AS (SELECT conv_id, i, turn, role, text, pair, initial, blank, again AND NOT blank AS duplicate, cut AND NOT again AND NOT blank AS truncated, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM m),
 sums AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
 w AS ({closed.format(start)} UNION ALL {closed.format(step)}),
 best AS (SELECT w.conv_id, CAST(left(least(e, a), 9) AS BIGINT) AS cost, substr(least(e, a), 10) AS audit FROM w JOIN sums ON sums.conv_id = w.conv_id AND sums.n = w.i),
 edits AS (SELECT *, sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY p) - sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY conv_id) % 2 AS place FROM (SELECT conv_id, p, audit[p] AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best))),
 said AS (SELECT e.conv_id, e.p, CASE WHEN edit = 'K' THEN r.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line FROM edits e LEFT JOIN r ON r.conv_id = e.conv_id AND r.i = e.i WHERE edit <> 'D'),
 whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS lines FROM said GROUP BY 1)
 SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id = c.conv_id LEFT JOIN best ON best.conv_id = c.conv_id LEFT JOIN whole ON whole.conv_id = c.conv_id"""


ORACLE: dict[str, str] = {
    "op12_repair": _repair_sql(),
    "op13_trie": _TRIE_SQL,
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
 k AS (SELECT body, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY body)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
   CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
   CASE WHEN keeper <> page_id THEN keeper END AS refers_to
 FROM p LEFT JOIN k ON p.body = k.body AND n >= 1000""",
    "op5_secrets": _secret_sql(),
}
