from pyspark.sql import functions as F

from recordmill.functions import text as T
from recordmill.operators import merge, review, risk


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_normal_forms(spark):
    rows = spark.createDataFrame([("A,B c!\x01 D  ",), (None,), ("x　y",)], "t string")
    got = [r["n"] for r in rows.select(T.normalize(F.col("t")).alias("n")).collect()]
    assert got == ["a b c d", "", "x y"]
    assert value(spark, T.tokens(F.lit("b a b  c"))) == ["b", "a", "c"]
    assert value(spark, T.cell_text(F.lit(" \x00a "))) == "a" and value(spark, T.cell_text(F.lit(None).cast("string"))) == ""


def test_labels_and_headers(spark):
    assert value(spark, T.class_label(F.lit("2 학년\n 11 반 명렬"))) == "2학년 11반"
    assert value(spark, T.grade_of_class(F.lit("3학년 2반"))) == "3학년" and value(spark, T.grade_of_class(F.lit("x"))) == ""
    assert value(spark, T.activity_label(F.lit("자율·자치 활동"))) == "자율·자치활동" and value(spark, T.activity_label(F.lit("기타"))) == ""
    heads = F.array(*map(F.lit, ["번 호", "과 목(명)", "성 명"]))
    assert value(spark, T.header_index(heads, ["성명", "이름"])) == 2 and value(spark, T.header_index(heads, ["없음"])) == -1
    assert value(spark, T.or_default(F.lit(""), "name")) == "이름 미상"


def test_content_key_is_djb2(spark):
    h = 5381
    for c in "김가|b":
        h = (h * 33 + ord(c)) % 2**32
    digits, key = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, d = divmod(h, 36)
        key = digits[d] + key
    assert value(spark, T.content_key(F.lit("김가"), F.lit("b"))) == key


def test_body_size_leaves_a_prefix_out_for_subjects_only(spark):
    row = {"t": "국어: 가나", "k": "subject"}
    assert value(spark, T.body_bytes(F.col("t"), F.col("k")), **row) == 6
    assert value(spark, T.body_bytes(F.col("t"), F.lit("creative")), **row) == 14


def test_merge_appends_once(spark):
    rows = [("a", 3, "끝 문장"), ("a", 1, "첫 문장. 둘째"), ("a", 2, "첫문장.둘째"), ("b", 1, "x")]
    got = {r["k"]: r["chunk"] for r in merge.merge(spark.createDataFrame(rows, "k string, o int, chunk string"), ["k"], "o").collect()}
    assert got == {"a": "첫 문장. 둘째 끝 문장", "b": "x"}
    exact = merge.merge(spark.createDataFrame(rows, "k string, o int, chunk string"), ["k"], "o", loose=False, prefix=F.concat("k", F.lit(": ")))
    assert {r["k"]: r["chunk"] for r in exact.collect()} == {"a": "a: 첫 문장. 둘째 첫문장.둘째 끝 문장", "b": "b: x"}


def test_risk_classes(spark):
    rows = [(2, 0.1, []), (1, 0.9996, []), (1, 0.65, []), (1, 0.44, ["symbol"]), (1, 0.44, ["typo"]), (1, 0.45, None), (1, 0.2, None)]
    df = spark.createDataFrame(rows, "g int, s double, t array<string>")
    assert [r["x"] for r in df.select(risk.status(F.col("g"), F.col("s"), F.col("t")).alias("x")).collect()] == ["exact", "exact", "high", "normal", "review", "review", "normal"]
    assert df.select(risk.status(F.col("g"), F.col("s"), F.col("t"), 0.9).alias("x")).collect()[2]["x"] == "normal"


def test_key_stores(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "key string, marked_at int")
    keys = spark.createDataFrame([("b", 5), ("c", 5)], "key string, marked_at int")
    assert {r["key"] for r in review.toggled(store, keys).collect()} == {"a", "c"}
    assert {r["key"] for r in review.toggled(store, keys, True).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in review.toggled(store, keys, False).collect()} == {"a"}
    assert [r["key"] for r in review.newest(store.unionByName(keys), 2).collect()] == ["b", "c"]
    raw = spark.createDataFrame([('["x", "y"]',), ("{}",), ("no",), (None,)], "value string")
    assert {r["key"] for r in review.load_keys(raw).collect()} == {"x", "y"}


def test_shares_are_whole_per_cent_halves_up(spark):
    assert [value(spark, T.percent(F.lit(x))) for x in (0.0, 0.125, 0.995, 1.0)] == ["0%", "13%", "100%", "100%"]
