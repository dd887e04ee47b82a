"""What several operators share: word and fold definitions, and whole-text helpers for Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text or ""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def keep_free(columns: list[str], name: str) -> str:
    """A working-column name that clashes with none of the given columns, compared as Spark does, without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name to look up by, whatever dots and quotes are in it."""
    return "`" + name.replace("`", "``") + "`"


def bound_batches(spark: SparkSession, records: int = 500, size: str = "16m") -> None:
    """Arrow batches of whole texts: few rows and few bytes each, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
