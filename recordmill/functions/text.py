"""Column functions on record text: cleaning, normal forms, labels, keys and sizes.

White space is the wide set that includes no-break and ideographic spaces. Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space class, and the punctuation that normal forms drop.
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
CONTROL = "[\\u0000-\\u001f\\u007f]"
PUNCTUATION = r"[.,!?()\[\]/\-_&@#$%^]"
#: Default labels of blank parts.
DEFAULTS = {"class_name": "학급 미상", "grade": "학년 미상", "subject": "과목 미상", "name": "이름 미상"}
#: Activity names by their spaceless form.
ACTIVITIES = {"자율활동": "자율활동", "자율자치활동": "자율·자치활동", "동아리활동": "동아리활동", "진로활동": "진로활동", "봉사활동": "봉사활동"}
#: Bytes a record may have, and the margin over which it counts as too long.
BYTE_LIMIT, BYTE_MARGIN = 1500, 120


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def cell_text(c: Column) -> Column:
    """A cell as text: null is empty, NUL characters go, ends are trimmed."""
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\u0000", ""))


def clean(c: Column) -> Column:
    """Control characters and runs of white space become one space."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, " "))


def normalize(c: Column) -> Column:
    """clean, lower case, PUNCTUATION as space: one pass, for white space that clean would leave collapses all the same."""
    dropped = f"[{CONTROL[1:-1]}{SPACE[1:-1]}{PUNCTUATION[1:-1]}]+"
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), dropped, " "))


def header(c: Column, creative: bool = False) -> Column:
    """A header without white space and brackets (creative: and without middle dots)."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", "")
    return F.regexp_replace(bare, "[()·･・]" if creative else "[()]", "")


def tokens(normalized: Column) -> Column:
    """Distinct words of a normal form, in order of first use."""
    return F.array_distinct(F.filter(F.split(normalized, " ", -1), lambda t: t != ""))


def spaceless(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def class_label(c: Column) -> Column:
    rx = rf"(?s)([0-9]+){SPACE}*학년.*?([0-9]+){SPACE}*반"
    return F.when(c.rlike(rx), F.concat(F.regexp_extract(c, rx, 1), F.lit("학년 "), F.regexp_extract(c, rx, 2), F.lit("반"))).otherwise(clean(c))


def grade_of_class(c: Column) -> Column:
    rx = rf"([0-9]+){SPACE}*학년"
    return F.when(c.rlike(rx), F.concat(F.regexp_extract(c, rx, 1), F.lit("학년"))).otherwise("")


def activity_label(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ACTIVITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, header(c, True)), F.lit(""))


def header_index(headers: Column, candidates: list[str]) -> Column:
    """0-based place of the first header whose normal form holds a candidate; -1 if none does."""
    hit = lambda h: F.exists(F.array(*map(F.lit, candidates)), lambda x: header(h).contains(x))
    return (F.array_position(F.transform(headers, hit), F.lit(True)) - 1).cast("int")


def or_default(c: Column, part: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULTS[part]))


def content_key(*parts: Column) -> Column:
    """djb2 over the parts joined by '|', in base 36. Characters outside the basic plane count as one here, by code."""
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    code = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % F.lit(4294967296))
    return F.lower(F.conv(code.cast("string"), 10, 36))


def content_digest(*parts: Column) -> Column:
    """SHA-256 of what content_key is made from: of a few hundred thousand records some share one of its 2**32 keys."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def issue_key(check_key: Column, kind: Column, start: Column, match: Column) -> Column:
    return F.concat_ws("|", check_key, kind, start.cast("string"), match)


def body(text: Column, record_type: Column) -> Column:
    """The text that counts against the byte limit: a subject record's without its 'name: ' prefix."""
    return F.when(record_type == "subject", F.regexp_replace(text, f"^[^:]{{1,30}}:{SPACE}*", "")).otherwise(text)


def body_bytes(text: Column, record_type: Column) -> Column:
    return F.octet_length(body(text, record_type)).cast("long")


def percent(c: Column) -> Column:
    """A share as whole per cent, halves up."""
    return F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))


def issue_category(label: Column, kind: Column) -> Column:
    """The finer class of a typo: quotes, spacing, format or spelling; other types stay."""
    fine = F.when(label.contains("따옴표") | label.contains("짝 안 맞는"), "quote").when(label.contains("띄어쓰기"), "spacing").when(label.isin("분량 초과", "임원 기간"), "format").otherwise("typo")
    return F.when(kind == "typo", fine).otherwise(kind)
