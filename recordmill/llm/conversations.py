"""What the operators on conversations share: turns in order, their places, and ordered digests of many rows.

A conversation is the rows of one conv_id by turn, nulls first; rows of one turn go by role, then text, in byte order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.operators import scan

#: Characters of a role or text that may bound a range of the sort order.
_EDGE = 32


def placed(rows: DataFrame, keep: list[Column | str], role: str, text: str, then: list[Column | str] | None = None, what: str = "turns") -> DataFrame:
    """rows (conv_id, turn, role, text) in the order of their conversations, as ranges (see scan); keep names what is
    stored of them."""
    order = ["turn", F.substring(role, 1, _EDGE), F.substring(text, 1, _EDGE)]
    return scan.ranged(rows, ["conv_id"], order, [F.col(role), F.col(text), *(then or [])], keep, what=what)


def ordered_digests(rows: DataFrame, key: list[str], order: list[str], piece: str, separator: str) -> DataFrame:
    """(key, sha256): lower-case hex of the SHA-256 of a key's pieces, in order, joined by the separator. A task streams
    its keys' rows through one digest each and holds one batch. A digest of all pieces can't be computed in parts, so one
    task reads a key's pieces: give it few and long ones (see `chunked`) where a key has many."""
    schema = rows.select(*key).schema
    parted = rows.select(*key, *[c for c in order if c not in key], piece).repartition(*key).sortWithinPartitions(*key, *order)
    at = len(parted.columns) - 1

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], types[i]) for i in range(len(key))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string())], names=[*key, "sha256"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(len(key))]
            for *own, text in zip(*(batch.column(i).to_pylist() for i in [*range(len(key)), at]), strict=True):
                if own != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = own, hashlib.sha256()
                else:
                    state.update(separator.encode())
                state.update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield out()
                done.clear()
        if state is not None:
            done.append((last, state.hexdigest()))
            yield out()

    return parted.mapInArrow(digests, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, sha256 string")


def chunked(rows: DataFrame, key: list[str], order: str, piece: str, separator: str, length: int = 1 << 16) -> DataFrame:
    """(key, order, piece): neighbouring pieces of a key joined to texts of about length characters, the first one's
    order kept. Ranges of (key, order) are joined, so a key with many rows is spread over tasks."""
    keys = [*key, order]
    parted = rows.select(*keys, piece).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, held, size, done, schema = None, None, [], 0, [], None

        def close() -> None:
            if held:
                done.append((*last, head, separator.join(held)))
                held.clear()

        for batch in batches:
            schema = schema or batch.schema
            for *own, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != last or size >= length:
                    close()
                    last, head, size = own, at, 0
                held.append(text)
                size += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)

    return parted.mapInArrow(joined, parted.schema)
