"""Segmented scans against plain loops over each group."""

import random

from pyspark.sql import functions as F

from recordmill.operators.scan import RANGE, Running, ranged, running, state


def test_running_values_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, None, i]), rng.random() < 0.2, rng.choice([None, 1, 2])) for g in ["big", "b", None] for i in range(400 if g == "big" else 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int, reset boolean, n int")
    cut = ranged(df, ["g"], ["i"], ranges=16)
    assert cut.where("g = 'big'").select(RANGE).distinct().count() > 3  # one group, many tasks
    x = F.xxhash64("i")
    got = running(cut, ["g"], last=Running(F.col("v")), before=Running(F.col("v"), own=False), total=Running(F.col("n"), "sum"), ahead=Running(F.col("n"), "sum", own=False), x=Running(x, "xor"), kept=Running(state(F.col("v"), F.col("reset"))))
    found = {(r["g"], r["i"]): r for r in got.withColumn("h", x).collect()}
    assert len(found) == len(rows)
    for g in ("big", "b", None):
        last = total = kept = None
        bits = 0
        for _, i, v, reset, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            r = found[g, i]
            assert r["before"] == last and (r["ahead"] or 0) == (total or 0)
            last = v if v is not None else last
            kept = v if v is not None else None if reset else kept
            total = (total or 0) + (n or 0)
            bits ^= r["h"]
            assert (r["last"], r["total"] or 0, r["x"], r["kept"]["v"] if r["kept"] else None) == (last, total, bits, kept)


def test_scan_of_nothing_and_of_one_group_of_all(spark):
    df = spark.createDataFrame([], "g string, i int")
    assert running(ranged(df, ["g"], ["i"]), ["g"], n=Running(F.lit(1), "sum")).collect() == []
    some = spark.range(100).withColumnRenamed("id", "i")
    assert sorted(r["n"] for r in running(ranged(some, [], ["i"], ranges=5), [], n=Running(F.lit(1), "sum")).collect()) == list(range(1, 101))
