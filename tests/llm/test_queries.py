"""Every opN_ query over a small set of tables: its columns, its rows, and its folds."""

import random
import zlib

import pytest

import __spark_entry__ as entry
from recordmill.session import fresh_path

EN, DE = "the of and with ing tion er th en ou".split(), "der und ein sch keit lich ver ung".split()
COLUMNS = {
    "op1_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op5_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(16)
    prose = lambda parts, n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        toxic, lang = int(i % 4 == 0), "de" if i % 3 == 0 else "en"
        docs.append((i, prose(DE if lang == "de" else EN, 60) + (" you stupid moron " if toxic else " "), lang, "s", 1))
        labels.append((i, 1, toxic))
    item = prose(EN, 30)
    docs += [(300, None, "en", "s", 0), (301, "", None, None, 0), (302, f"x {item} y", "en", "s", 1), (303, "12 34", "en", "s", 1)]
    path = fresh_path(spark, "queries")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, "u", f"<article><p>{prose(EN, 20)}</p></article>" if i else None) for i in range(30)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, {d[0]: d for d in docs}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, name):
    path, docs = tables
    found = entry.queries()[name](spark, path)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = found.collect()
    if "doc_id" in types and name != "op4_decontaminate":
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if "held_out" in types:
        folds = 10 if name == "op9_lm" else 5
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == 0) for r in rows)
    if name == "op2_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
        assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    if name == "op8_language":
        right = [r["lang_pred"] == docs[r["doc_id"]][2] for r in rows if r["held_out"] and r["doc_id"] < 240]
        assert sum(right) >= 0.95 * len(right) and {r["lang_pred"] for r in rows if r["doc_id"] in (300, 301, 303)} == {"und"}
    if name == "op4_decontaminate":
        assert [(r["doc_id"], r["item_id"]) for r in rows] == [(302, 1)]
    if name == "op6_nearest":
        assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in (0, 100, 200) for k in range(1, 11)]
    if name in ("op3_warc", "op7_html"):
        assert sorted(r["page_id"] for r in rows) == list(range(30))
