"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (ORDERS) of the whole lower-cased text, white space made one space, each
counted once a text. Feature f has the value r_f = log of its smoothed rate in toxic texts over that in others;
features in too few fitted texts (MIN_TEXTS, MIN_SHARE) or with a ratio under MIN_RATIO either way are left out. A logistic
regression on these values, whose classes weigh alike, gives the score. Null and empty texts have no n-grams and get
the intercept's score.

The fit reads at most MAX_FIT_ROWS distinct labelled texts and MAX_FIT_CHARS of their characters (chosen by a hash of the
text, so the choice is the same in every run, toxic ones up to half of them; texts of over MAX_TEXT_CHARS are scored, but
not fitted): these bounds keep the training matrix, which one task holds, of fixed size. A table without labels of both
kinds gives a model that scores every text 0. Rows with a null id have no label. Repeated rows are scored each, and are
one text in the fit. Columns that an operator doesn't name may have any names. An empty table gives an empty one.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Documented bounds of the fit: labelled texts that one task sees, as feature ids only; the characters of all of them
#: together, and of one. A character gives at most four ids.
MAX_FIT_ROWS = 3_000
MAX_FIT_CHARS = 16_000_000
MAX_TEXT_CHARS = 1_000_000
#: A feature is used from so many fitted texts on: this many, or this share of them.
MIN_TEXTS, MIN_SHARE = 3, 0.005
MIN_RATIO = 1.5
SMOOTHING = 1.0
L2 = 3e-3
STEPS = 100
BLOCK_CHARS = 1 << 18
_SPACE = re.compile(r"\s+")


def hashed_grams(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """The feature ids of a whole text, repeats included, in blocks that overlap by the longest order."""
    padded = " " + _SPACE.sub(" ", (text or "").lower()).strip() + " "
    if len(padded) < min(orders):
        return
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(orders)
    for start in range(0, max(1, len(codes) - longest + 1), BLOCK_CHARS):
        part = codes[start : start + BLOCK_CHARS + longest - 1]
        h, grown = np.full(len(part), 0x9E3779B1, np.uint32), 0
        for order in orders:
            if order > len(part):
                break
            while grown < order:
                h = (h[: len(part) - grown] ^ part[grown:]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                grown += 1
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def feature_ids(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """The distinct feature ids of a whole text."""
    blocks = [np.unique(x) for x in hashed_grams(text, orders, bits)]
    return np.unique(np.concatenate(blocks)).astype(np.int32) if blocks else np.zeros(0, np.int32)


@dataclasses.dataclass
class Model:
    """The weights w * r of the features used, and the intercept."""

    ids: np.ndarray
    values: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    @functools.cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by feature id, and which are used; made where the model is used."""
        weights = np.zeros(1 << self.bits, np.float32)
        weights[self.ids] = self.values
        return weights, weights != 0

    def score(self, text: str | None) -> float:
        weights, used = self.dense
        hits = [x[used[x]] for x in hashed_grams(text, self.orders, self.bits)]
        ids = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint32)
        z = self.bias + float(weights[ids].sum(dtype=np.float64))
        return 0.0 if z == -np.inf else float(1 / (1 + np.exp(-np.clip(z, -700, 60))))


def train(rows: list[np.ndarray], labels: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Model:
    """Fits on feature ids and 0/1 labels."""
    width = 1 << bits
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -np.inf, orders, bits)
    y = labels.astype(np.float64)
    p, q = np.zeros(width, np.int32), np.zeros(width, np.int32)
    for ids, label in zip(rows, labels.tolist(), strict=True):  # ids are distinct within a row
        (p if label > 0 else q)[ids] += 1
    r = np.log((p + SMOOTHING) / (y.sum() + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / ((1 - y).sum() + 2 * SMOOTHING))
    kept = np.flatnonzero((p + q >= max(MIN_TEXTS, MIN_SHARE * len(rows))) & (np.abs(r) >= MIN_RATIO))
    at = np.full(width, -1, np.int32)
    at[kept] = np.arange(len(kept))
    used = [at[ids][at[ids] >= 0] for ids in rows]
    feature, row = np.concatenate(used), np.repeat(np.arange(len(rows)), [len(u) for u in used])
    value = r[kept][feature]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(len(kept) + 1)  # the last is the intercept
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):  # Adam on the full batch
        z = np.bincount(row, value * w[feature], minlength=len(rows)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(np.bincount(feature, value * g[row], minlength=len(kept)) + L2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(kept.astype(np.int32), (w[:-1] * r[kept]).astype(np.float32), float(w[-1]), orders, bits)


def fit_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS, max_chars: int = MAX_FIT_CHARS, max_text: int = MAX_TEXT_CHARS) -> DataFrame:
    """(id, y) of at most max_rows labelled texts of no more than max_chars characters together: toxic ones up to half of
    both, others for the rest, each by a hash of the text. Of equal texts one counts, for a text with many copies would
    outweigh the others' words. Labels other than 0 and 1 take no part; of several labels of a text the larger counts."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n")).where(F.col("n") <= max_text)
    one = texts.join(known, "id").groupBy("h").agg(F.max("y").alias("y"), F.min(F.struct("id", "n")).alias("s")).select("h", "y", "s.*")
    toxic = one.where("y = 1").orderBy("h").limit(max_rows // 2)
    rest = one.where("y = 0").orderBy("h").limit(max_rows - max_rows // 2)
    before = F.sum("n").over(Window.partitionBy("y").orderBy("h"))  # over max_rows rows at most
    return toxic.unionByName(rest).withColumn("sum", before).where(F.col("sum") <= max_chars // 2).select("id", "y")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learns from the texts of docs that labels marks 0 or 1."""
    sample = fit_sample(docs, labels, text_col, label_col, id_col, max_rows)  # bounded by max_rows, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([feature_ids(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["y", "x"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            flat, offsets = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            rows += [flat[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            labels += batch.column(0).to_pylist()
        model = train(rows, np.array(labels))
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.ids], pa.list_(pa.int32())), pa.array([model.values], pa.list_(pa.float32()))], names=["bias", "ids", "values"])

    # the bounded sample is fitted in one task; the driver sees the weights of the features used
    fitted = texts.mapInArrow(featured, "y int, x array<int>").repartition(1).mapInArrow(trained, "bias double, ids array<int>, values array<float>").first()
    if fitted is None:
        return train([], np.zeros(0))
    return Model(np.array(fitted["ids"], np.int32), np.array(fitted["values"], np.float32), fitted["bias"])


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """0 to 1, higher for toxic. The model has at most 2**bits weights and is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.score(x) for x in batch.to_pylist()], pa.float64())

    return scored(text)
