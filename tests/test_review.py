import datetime
import random

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordmill.operators import review
from recordmill.session import fresh_path
from recordmill.sources import sinks


def test_places_in_groups_cover_every_row_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["g1", "g1", "g2", None]), f"{rng.randint(1, 4)}-class", str(rng.randint(1, 9)), "s") for i in range(900)]
    table = spark.createDataFrame(rows, "record_order long, grade string, class_name string, number string, subject string")
    ranked = review.in_group_rank(table, "grade", "class")
    got = {r["record_order"]: r["place"] for r in ranked.collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (int(r[2][0]), r[2], int(r[3]), r[4], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    assert got == {i: at for own in groups.values() for at, i in enumerate(own, 1)}
    assert ranked.columns == [*table.columns, "place"] and ranked.where(F.col("place") > 30).count() > 0
    assert "class_places" in entry.queries()


def test_pages_of_a_stored_queue_are_those_of_a_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["exact", "high", "review", "normal"]), rng.randint(0, 3), rng.choice([0.0, 0.5, 0.7]), rng.choice("abc")) for i in range(205)]
    table = spark.createDataFrame(rows, "record_order long, status string, n_issues int, similarity double, name string")
    queue = review.queue(table.repartition(9), ranges=8)
    rank = {"exact": 0, "high": 1, "review": 2, "normal": 3}
    want = [r[0] for r in sorted(rows, key=lambda r: (rank[r[1]], -r[2], -r[3], r[4], r[0]))]
    assert len(queue.counts) > 1
    for number, at in ((1, 0), (2, 30), (7, 180), (99, 180), (0, 0)):
        page = queue.page(number)
        assert page.columns == table.columns and [r[0] for r in page.collect()] == want[at : at + 30]
    assert review.page(table.limit(0)).collect() == []


def test_saved_keys_outlive_a_job_that_dies(spark, monkeypatch):
    path = fresh_path(spark, "keys")
    at = lambda n: datetime.datetime(2026, 1, 1, 0, 0, n)
    store = lambda *keys: spark.createDataFrame([(k, at(n)) for n, k in enumerate(keys)], review.STORE)
    keys = lambda: sorted(r["key"] for r in review.load(spark, path).collect())
    assert keys() == [] and review.current(spark, path) == (0, None)
    assert review.save(store("a", "b", "a"), path) == 1 and keys() == ["a", "b"]
    reader = review.load(spark, path)

    swing = review._swing

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(review, "_swing", dies)
    with pytest.raises(KeyboardInterrupt):
        review.save(store("z"), path)
    assert keys() == ["a", "b"]  # the snapshot is there, nothing points to it
    monkeypatch.setattr(review, "_swing", swing)
    files, folder, _ = review._pointers(spark, path)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, "2"), False).close()  # died before the name was written
    assert keys() == ["a", "b"] and review.current(spark, path)[0] == 1
    assert review.save(review.toggled(review.load(spark, path), store("b", "c")), path, since=1) == 3 and keys() == ["a", "c"]
    assert sorted(r["key"] for r in reader.collect()) == ["a", "b"]  # the snapshot before stays for its readers
    with pytest.raises(review.SavedMeanwhile):
        review.save(store("q"), path, since=1)
    assert review.save(store(*"abcdef"), path, limit=3) == 4 and keys() == ["d", "e", "f"]
    review.save(store("g"), path)
    assert keys() == ["g"]


def test_report_numbers_rules_by_first_use(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(400), "typo", "l", f"m{k}", rng.randrange(90), "warning", None if k % 7 == 0 else "r", f"{k}: neighbour") for k in (rng.randrange(150) for _ in range(900))]
    issues = spark.createDataFrame(rows, "record_order long, type string, label string, match string, start int, severity string, reference string, guidance string").repartition(7)
    key = lambda r: (r[1], r[2], r[6], r[5], r[7])
    first = {}
    for r in rows:
        first[key(r)] = min(first.get(key(r), (1 << 30, 0)), (r[0], r[4]))
    order = sorted(first, key=lambda k: (first[k], k[0], k[1], k[2] is not None, k[2] or "", k[3], k[4]))
    rules = {tuple(r[c] for c in sinks.RULE): r["rule"] for r in sinks.report_rules(issues).collect()}
    assert rules == {k: i for i, k in enumerate(order)}
    got = sorted(tuple(r) for r in sinks.report_issues(issues).collect())
    assert got == sorted((r[0], rules[key(r)], r[4], r[3]) for r in rows)
