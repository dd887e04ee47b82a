import base64
import hashlib

import public_tokenizers
import regex

from recordmill.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_ids_are_those_of_plain_merges_and_decode_gives_the_bytes(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = ["Hello world, it's   me\n\n  2024x!", "", None, "züberß ççé 東京 🙂 don't", " \t leading", "a" * 50 + "1" * 50, "<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token_ids", bpe.F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.digests(rows, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = [x for m in regex.findall(public_tokenizers.PATTERN, t or "") for x in merged(m.encode(), ranks)]
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_cutting_long_texts_changes_nothing():
    with open(RANKS, "rb") as f:
        encoding = bpe._encoding(f.read(), public_tokenizers.PATTERN)
    text = "It's a test,  of 12ab34 things\n\n\nthat don't stop... " * 400
    whole = encoding.encode_ordinary(text)
    for limit in (7, 50, 333, 4000):
        parts = list(bpe.pieces(text, limit))
        assert "".join(parts) == text and len(parts) > 1
        assert [i for p in parts for i in encoding.encode_ordinary(p)] == whole


def test_a_stretch_without_a_safe_place_stays_whole():
    with open(RANKS, "rb") as f:
        encoding = bpe._encoding(f.read(), public_tokenizers.PATTERN)
    for text in ("ab" * 300, "\u6771\u4eac" * 300, "!?" * 300):
        assert list(bpe.pieces(text, 50)) == [text]
        assert bpe.encode_text(text, encoding).tolist() == encoding.encode_ordinary(text)
    mixed = "ab" * 300 + "12" * 300
    assert list(bpe.pieces(mixed, 50)) == ["ab" * 300, "12" * 300]


def test_repeated_rows_are_encoded_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()) == [0, 2, 2]


def test_an_empty_table_gives_an_empty_result(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_task_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    done = bpe.digest_columns(bpe.tokenize(docs, RANKS, public_tokenizers.PATTERN), "token_ids")
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"]: len(r["token_ids"]) for r in done.collect()} == {1: 2, 2: 0}
