"""Byte-level BPE: whole texts to token ids by a local rank file, and ids back to the raw bytes.

Null texts count as empty and give no ids. Each match of the split pattern is merged on its own. Texts longer than
CHUNK_CHARS are cut first, only at places where no match of the pattern can reach across, so the ids are those of the
whole text; a stretch without such a place, as of letters only, stays whole. Ids outside the rank file make decode fail
rather than give wrong bytes. Repeated rows are encoded each, an empty table gives an empty one, and columns of docs with
the names of the results are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import keep_free

CHUNK_CHARS = 200_000
#: White space after a character that isn't: every match ends before it, and what follows it doesn't look back.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Where there is no white space: between an ASCII letter and a digit, either way round. Matches hold one kind only.
_SAFE_TIGHT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Cuts text at safe places after at least `limit` characters; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit, min(len(text), start + 2 * limit)) or _SAFE_TIGHT.search(text, start + limit) or _SAFE.search(text, start + limit)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=2)
def _encoding(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_bytes.splitlines() if line)}
    return tiktoken.Encoding("r" + hashlib.sha256(rank_bytes).hexdigest()[:16], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, encoding: tiktoken.Encoding) -> np.ndarray:
    parts = [encoding.encode_to_numpy(part, disallowed_special=()) for part in pieces(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _encoded(texts: pa.Array, encoding: tiktoken.Encoding) -> pa.ListArray:
    ids = [encode_text(x, encoding) for x in texts.to_pylist()]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _decoded(ids: pa.ListArray, encoding: tiktoken.Encoding) -> pa.Array:
    flat, offsets, present = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([encoding.decode_bytes(flat[a:b].tolist()) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], present, strict=True)], pa.binary())


def encode(text: Column, rank_bytes: bytes, pattern: str) -> Column:
    """array<int> of token ids. rank_bytes: the contents of a rank file, a vocabulary of fixed size."""

    @F.arrow_udf("array<int>")
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(rank_bytes, pattern)
        for batch in batches:
            yield _encoded(batch, encoding)

    return token_ids(text)


def decode(ids: Column, rank_bytes: bytes, pattern: str) -> Column:
    """The raw bytes of token ids; null for null."""

    @F.arrow_udf("binary")
    def raw_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(rank_bytes, pattern)
        for batch in batches:
            yield _decoded(batch, encoding)

    return raw_bytes(ids)


def there_and_back(text: Column, rank_bytes: bytes, pattern: str) -> Column:
    """struct<ids,decoded>: what encode gives, and what decode gives for these ids, by one Python worker a task. With a
    node each, a task has two workers with a vocabulary each, which stay in an executor's memory as long as it has work."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(rank_bytes, pattern)
        for batch in batches:
            ids = _encoded(batch, encoding)
            yield pa.StructArray.from_arrays([ids, _decoded(ids, encoding)], ["ids", "decoded"])

    return both(text)


def tokenize(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with ids_col and bytes_col (columns of these names are replaced)."""
    with open(rank_path, "rb") as file:
        rank_bytes = file.read()
    both = keep_free([*docs.columns, ids_col, bytes_col], "_both")
    done = docs.withColumn(both, there_and_back(F.col(text_col), rank_bytes, pattern))
    return done.withColumns({ids_col: F.col(both)["ids"], bytes_col: F.col(both)["decoded"]}).drop(both)


def digest_columns(done: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and more columns of what tokenize returns."""
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )


def digests(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The digest columns of every row of docs."""
    return digest_columns(tokenize(docs.select("doc_id", text_col), rank_path, pattern, text_col))
