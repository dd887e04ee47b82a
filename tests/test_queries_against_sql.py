"""Queries against their SQL, over small tables made so that a short cut shows."""

import datetime
import itertools
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recordmill.operators import review

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def differences(spark, folder, name, **tables):
    """What a query returns and its SQL doesn't, and the other way round."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table, rows in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, TABLES[table]).repartition(3).write.parquet(path)
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    entry.queries()[name](spark, str(folder)).write.parquet(out := f"{folder}/out")
    assert any(f.endswith(".parquet") for f in os.listdir(out))
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = sorted(map(repr, db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM read_parquet('{out}/*.parquet')").fetchall()))
    assert want, "nothing to compare"
    return [x for x in got if x not in want], [x for x in want if x not in got]


def documents(*texts):
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["issues_places", "issues_names"])
def test_names_of_the_prose_take_no_place_of_planted_ones(spark, tmp_path, name):
    texts = documents("see the MIT text. " + "a in b the c and d of e " * 12, "MIT MIT EU " + "x and y of z " * 9)
    assert differences(spark, tmp_path, name, documents=texts) == ([], [])


def test_a_missing_office_is_found_behind_ten_institutions(spark, tmp_path):
    texts = documents("MIT " * 12 + "in the end", "MIT in the end", "MIT " * 12 + "the end is here")
    assert differences(spark, tmp_path, "issues_absence", documents=texts) == ([], [])


def test_a_store_is_cut_once_it_is_toggled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(review.newest, "__defaults__", (5,))
    monkeypatch.setattr(review.save, "__defaults__", (5, None))
    monkeypatch.setitem(entry.catalog.ORACLE, "saved_keys", entry.catalog.ORACLE["saved_keys"].replace("LIMIT 50000", "LIMIT 5"))
    at = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=n)
    rows = [(u, at(u), u, "purchase", 200.0, "") for u in range(12)] + [(100 + u, at(50 + u), u, "click", 200.0, "") for u in range(6, 11)]
    assert differences(spark, tmp_path, "saved_keys", events=rows) == ([], [])


def same_short_key():
    """Two texts of a few letters with one djb2 key behind a record's other parts."""
    seen = {}
    for letters in itertools.product("abcdefgh", "0123456789abcdefghijklmnopqrstuvwxyz~=;:<>", "0123456789abcdefghijklmnopqrstuvwxyz~=;:<>"):
        text = "".join(letters)
        h = 0
        for c in text:
            h = h * 33 + ord(c)
        if h in seen:
            return seen[h], text
        seen[h] = text
    raise AssertionError


@pytest.mark.parametrize("name", ["review_progress", "hide_checked", "checked_records"])
def test_records_that_share_a_short_key_are_told_apart(spark, tmp_path, name):
    a, b = same_short_key()
    docs = [(1, a, "en", "web", 3), (98, b, "en", "web", 3), (3, "other", "en", "web", 5)]  # 1 and 98 have one name
    events = [(1, datetime.datetime(2026, 1, 1), 1, "purchase", 1.0, "")]
    assert differences(spark, tmp_path, name, documents=docs, events=events) == ([], [])
