"""Parts of the SQL that states what the queries return."""

SPACE = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PUNCTUATION = r"[.,!?()\[\]/\-_&@#$%^]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def normalize(x: str) -> str:
    clean = collapse(f"regexp_replace(coalesce({x}, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g')")
    return collapse(f"regexp_replace(lower({clean}), '{PUNCTUATION}', ' ', 'g')")


#: Records over the documents table, as plans.records makes them.
RECORDS = f"""records AS (SELECT doc_id AS record_order, 'record-' || doc_id AS record_id, 'subject' AS record_type, coalesce(source, '') AS class_name, 'g' || (doc_id % 3 + 1) AS grade,
  coalesce(lang, '') AS subject, CAST(doc_id AS VARCHAR) AS number, 'n' || (doc_id % 97) AS name, coalesce(text, '') AS text, {normalize("text")} AS normalized_text FROM documents)"""
TOKENS = """tokens AS (SELECT record_order, token, min(pos) AS pos FROM (SELECT record_order, unnest(string_split(normalized_text, ' ')) AS token, unnest(range(1, len(string_split(normalized_text, ' ')) + 1)) AS pos FROM records) WHERE token <> '' GROUP BY ALL)"""
SENTENCES = f"""split AS (SELECT record_order, text, list_filter(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]?{SPACE}*'), lambda s: {trim("s")} <> '') AS ss FROM records),
 sentences AS (SELECT record_order, "at", sentence, {normalize("sentence")} AS norm FROM (SELECT record_order, unnest(CASE WHEN len(ss) > 0 THEN ss ELSE [text] END) AS sentence, unnest(range(0, CASE WHEN len(ss) > 0 THEN len(ss) ELSE 1 END)) AS "at" FROM split))"""
#: Size of the exact group and the lowest other order with the same normal form.
GROUPS = """groups AS (SELECT r.record_order, count(*) OVER w AS group_size, min(record_order) OVER w AS first, CASE WHEN count(*) OVER w > 1 THEN CASE WHEN min(record_order) OVER w = record_order
   THEN (SELECT min(o.record_order) FROM records o WHERE o.normalized_text = r.normalized_text AND o.record_order <> r.record_order) ELSE min(record_order) OVER w END END AS partner FROM records r WINDOW w AS (PARTITION BY normalized_text))"""
#: Best partner of records without an exact one, by the definition: every pair that shares a token.
BEST = """sizes AS (SELECT record_order, count(*) AS n FROM tokens GROUP BY 1),
 shared AS (SELECT a.record_order AS a, b.record_order AS b, count(*) AS k, min(a.pos) AS pos FROM tokens a JOIN tokens b ON a.token = b.token AND a.record_order <> b.record_order
   JOIN groups g ON g.record_order = a.record_order AND g.group_size = 1 JOIN groups h ON h.record_order = b.record_order AND h.first = b.record_order GROUP BY ALL),
 scored AS (SELECT a, b, pos, k / (x.n + y.n - k) AS similarity FROM shared JOIN sizes x ON x.record_order = a JOIN sizes y ON y.record_order = b),
 best AS (SELECT * FROM (SELECT a AS record_order, b AS match_order, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, pos, b) AS rn FROM scored WHERE similarity >= 0.45) WHERE rn = 1)"""


def replaced(pairs: tuple[tuple[str, str], ...], x: str = "text") -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


#: Records of sheets in the subject-wise layout, as plans.records.subject_sheets and sources.layouts make them.
SHEETS = f"""cleaned AS (SELECT *, {collapse("regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', ' ', 'g')")} AS chunk FROM conversations),
 listed AS (SELECT conv_id, role, min(turn) AS turn, list(chunk ORDER BY turn, chunk) AS chunks FROM cleaned WHERE chunk <> '' GROUP BY ALL),
 merged AS (SELECT *, list_reduce(chunks, lambda a, b: CASE WHEN contains(regexp_replace(a, '{SPACE}+', '', 'g'), regexp_replace(b, '{SPACE}+', '', 'g')) THEN a ELSE {trim("a || ' ' || b")} END) AS body FROM listed),
 records AS (SELECT row_number() OVER (ORDER BY conv_id // 20, conv_id * 1000 + turn, role) - 1 AS record_order, 'subject' AS record_type, '학급 미상' AS class_name, '2학년' AS grade, role AS subject, CAST(conv_id % 997 AS VARCHAR) AS number,
   'n' || conv_id AS name, role || ': ' || body AS text, {normalize("role || ': ' || body")} AS normalized_text FROM merged WHERE length(body) > 3)"""
