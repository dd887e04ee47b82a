"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, the first
rotated by two places, the second by one. A text's profile is the sum (bundle) of its trigrams' vectors, a language's
prototype that of all its learning texts; the nearest prototype by cosine is the prediction. Since bundling is linear,
tasks bundle the trigram counts of their rows, and Spark sums the bundles of each language.

Letters are those of Unicode's letter categories, with the marks that belong to them; they are lower-cased, and a run of
other characters counts as one space. The vectors of letters come from a hash of the code point, so any alphabet works
without a learned inventory. Texts that are null or hold no letter get UNKNOWN and score 0, and so do all where nothing
was learned from. A score is the cosine, negative ones as 0. Ties go to the first language in order.

Rows without a language aren't learned from; repeated rows are learned from and predicted each. Columns that an operator
doesn't name may have any names. Prototypes are a stored table; they are broadcast LANGUAGES at a time, and a text keeps
the best of all, so their number has no bound. Empty tables give empty results.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.session import materialize

DIMENSIONS = 1024
UNKNOWN = "und"
#: Languages whose prototypes are broadcast, or bundled in one task, at a time.
LANGUAGES = 2_000
_NOT_ASCII_LETTERS = re.compile("[^a-z]+")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1/-1 by code point, the same on every machine."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimensions // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(42)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(codes), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of bound vectors for trigrams packed as three 21-bit code points."""
    mask = np.uint64((1 << 21) - 1)
    parts = [(grams >> np.uint64(s)) & mask for s in (42, 21, 0)]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    vectors = letter_vectors(letters, dimensions)
    a, b, c = at.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a whole text and their counts; none if it has no letter."""
    lower = (text or "").lower()
    plain = (_NOT_ASCII_LETTERS if lower.isascii() else _NOT_LETTERS).sub(" ", lower).strip()
    if not plain or not (plain.isascii() or _LETTER.search(plain)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return np.unique(packed, return_counts=True)


@dataclasses.dataclass
class Profiles:
    langs: list[str]
    vectors: np.ndarray  # one normed row for each language


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes (lang, vector) from all rows with a language, stored. Each task sums the trigram counts of its rows
    before they are bundled, so what leaves it is one vector a language."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        packed = lambda: pa.RecordBatch.from_pydict({"lang": list(sums), "part": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("part", pa.list_(pa.float64()))]))
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                found = [trigrams(x) for x in texts]
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in found]), minlength=len(grams))
                for start in range(0, len(grams), 8192):
                    part = counts[start : start + 8192].astype(np.float32) @ gram_vectors(grams[start : start + 8192], dimensions)
                    sums[lang] = sums.get(lang, 0) + part.astype(np.float64)
            if len(sums) >= LANGUAGES:
                yield packed()
                sums.clear()
        if sums:
            yield packed()

    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(bundled, "lang string, part array<double>")
    summed = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    listed = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    return materialize(listed, "prototypes")


def predict_batch(texts: list[str | None], own: Profiles, group: int = 64) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    dimensions = own.vectors.shape[1]
    for start in range(0, len(texts), group):
        found = [trigrams(x) for x in texts[start : start + group]]
        grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        rows, counts = np.repeat(np.arange(len(found)), [len(g) for g, _ in found]), np.concatenate([n for _, n in found])
        order = np.argsort(at, kind="stable")
        rows, counts, at = rows[order], counts[order].astype(np.float32), at[order]
        profiles = np.zeros((len(found), dimensions), np.float32)
        for k in range(0, len(grams), 16384):  # a dense block of counts at a time, however many trigrams the texts have
            low, high = np.searchsorted(at, (k, k + 16384))
            block = np.zeros((len(found), min(16384, len(grams) - k)), np.float32)
            block[rows[low:high], at[low:high] - k] = counts[low:high]
            profiles += block @ gram_vectors(grams[k : k + 16384], dimensions)
        exact = profiles.astype(np.float64)  # whole numbers
        cosines = (exact @ own.vectors.T) / np.maximum(np.linalg.norm(exact, axis=1, keepdims=True), 1e-12)
        for (g, _), row in zip(found, cosines, strict=True):
            best = int(np.argmax(row)) if len(row) else -1
            known = len(g) > 0 and best >= 0
            langs.append(own.langs[best] if known else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, row[best]))) if known else 0.0)
    return langs, scores


def predict(text: Column, prototypes: DataFrame) -> Column:
    """struct<score,lang> of the nearest of the prototypes (lang, vector)."""
    best = F.struct(F.lit(0.0).alias("score"), F.lit(UNKNOWN).alias("lang"))
    rows = prototypes.orderBy("lang").toLocalIterator()
    while block := list(itertools.islice(rows, LANGUAGES)):
        vectors = np.array([r["vector"] for r in block], dtype=np.float64)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        found = _nearest(text, Profiles([r["lang"] for r in block], vectors), prototypes.sparkSession)
        best = F.when((found["lang"] != UNKNOWN) & ((best["lang"] == UNKNOWN) | (found["score"] > best["score"])), found).otherwise(best)
    return best


def _nearest(text: Column, profiles: Profiles, spark) -> Column:
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<score:double,lang:string>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = predict_batch(batch.to_pylist(), shared.value)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(langs, pa.string())], names=["score", "lang"])

    return predicted(text)
