"""Language-model scores by deleted interpolation.

P(w | h) = l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V+1), where h is the word before (or the text's start) and the weights
l2, l1, l0, which add up to 1, depend on the bucket of the context's count c(h) (powers of two). They are learned by
expectation-maximisation on held-out counts: texts of one tenth of the learning texts are scored by counts from which
their own occurrences have been taken off (deleted). All counts are over all learning texts.

Texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, then one end, which counts as a token; null texts are empty, and an
empty text is its end alone. Words and pairs are named by 64-bit hashes. Repeated rows are learned and scored each.

How it runs: each task cuts its rows into chunks, and sends every distinct word and pair of a chunk with its count there
to the bucket that its hash falls in; buckets add up the counts and answer each chunk in the order it asked. Then each
chunk's token numbers meet its answers. Frequent words and pairs are so added up before they move, and no task holds
more than a chunk or a bucket, whose number grows with the input, as does the number of tasks. A chunk is named by where
it stands in the scan and by its contents; the rows are read twice, so they are stored first, that both cut them alike.

Ids may be of any type; a null id is in the fold of the empty text. Columns of docs may have any names. An empty table
gives an empty one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import fold
from recordmill.session import materialize

CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 8 << 20
HASH_BLOCK = 1 << 20
CONTEXT_BUCKETS = 40
ROUNDS = 40
BINS_A_DECADE = 10
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, start) of each word of bytes, in blocks that end at white space."""
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + HASH_BLOCK)
        block = data[at:end]
        space = (block == 32) | ((block >= 9) & (block <= 13))
        if end < n:
            last = np.flatnonzero(space)
            while not len(last):  # a word longer than a block
                end = min(n, end + HASH_BLOCK)
                block = data[at:end]
                space = (block == 32) | ((block >= 9) & (block <= 13))
                last = np.flatnonzero(space) if end < n else np.array([len(block) - 1])
            block, space = block[: last[-1] + 1], space[: last[-1] + 1]
        first = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)) == -1)
        if len(first):  # bytes.lower() and split() know the letters A-Z and the six white-space characters only
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, block.tobytes().lower().split()), np.uint64, len(first)))
            starts.append(first + at)
        at += len(block)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


@dataclasses.dataclass
class Chunk:
    """Texts as token numbers. The token before a text's first is START's number."""

    ids: list
    learned: np.ndarray  # by text
    lengths: np.ndarray  # tokens by text, ends included
    keys: np.ndarray  # sorted distinct hashes of the tokens, START among them
    tokens: np.ndarray  # numbers of the keys
    name: int

    @staticmethod
    def of(ids: list, texts: list[bytes], learned: list[bool], place: tuple[int, int, int]) -> Chunk:
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        hashes, starts = word_hashes(data)
        bounds = np.searchsorted(starts, offsets)
        lengths = np.diff(bounds) + 1
        all_hashes = np.insert(hashes, bounds[1:], END)
        keys, tokens = np.unique(np.append(all_hashes, START), return_inverse=True)
        digest = xxhash.xxh64(repr(place).encode())
        digest.update(all_hashes.tobytes())
        digest.update(lengths.tobytes())
        return Chunk(ids, np.array(learned, bool), lengths, keys, tokens[:-1].astype(np.int32), digest.intdigest() - (1 << 63))

    def previous(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = np.searchsorted(self.keys, START)
        return before

    def pair_hashes(self) -> np.ndarray:
        return mixed(self.keys[self.previous()] * U(3) + mixed(self.keys)[self.tokens])

    def learned_tokens(self) -> np.ndarray:
        return np.repeat(self.learned, self.lengths)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """(kind, chunk) for rows (id, text, tenth): kind 1 holds the tenth on which weights are learned, kind 0 the rest."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    held: dict[int, list] = {0: [[], [], [], 0], 1: [[], [], [], 0]}
    cut = {0: 0, 1: 0}

    def flush(kind: int) -> Chunk:
        ids, texts, learned, _ = held[kind]
        held[kind] = [[], [], [], 0]
        cut[kind] += 1
        return Chunk.of(ids, texts, learned, (part, kind, cut[kind]))

    for batch in batches:
        for doc, text, tenth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind = int(tenth == 1)
            own, data = held[kind], (text or "").encode("utf-8", "surrogatepass")
            own[0].append(doc)
            own[1].append(data)
            own[2].append(tenth != 0)
            own[3] += len(data)
            if own[3] >= CHUNK_BYTES:
                yield kind, flush(kind)
    for kind in (0, 1):
        if held[kind][0]:
            yield kind, flush(kind)


ASKED = pa.schema([("grams", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])


def _ask(buckets: int):
    """Rows of distinct words (grams 1) and pairs (grams 2) with their counts in learning texts, cut by bucket."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, chunk in _chunks(batches):
            learned = chunk.learned_tokens()
            counts = np.bincount(chunk.tokens[learned], minlength=len(chunk.keys))
            counts[np.searchsorted(chunk.keys, START)] = chunk.learned.sum()
            pairs, at = np.unique(chunk.pair_hashes(), return_inverse=True)
            for grams, keys, n in ((1, chunk.keys, counts), (2, pairs, np.bincount(at[learned], minlength=len(pairs)))):
                bucket = _bucket(keys, buckets)
                edges = np.flatnonzero(np.diff(bucket)) + 1
                rows = list(zip(np.concatenate([[0], edges]).tolist(), np.append(edges, len(keys)).tolist(), strict=True))
                lists = pa.array([a for a, _ in rows] + [len(keys)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grams] * len(rows), pa.int32()), pa.array(bucket[[a for a, _ in rows]].astype(np.int32)), pa.array([kind] * len(rows), pa.int32()), pa.array([chunk.name] * len(rows), pa.int64())]
                    + [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (keys.view(np.int64), n.astype(np.int32))], schema=ASKED)

    return asked


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the sorted hashes, so that answers laid end to end are in that order too."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


ANSWERED = "grams int, bucket int, kind int, chunk long, n array<long>"


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: totals for each key, sent back to each chunk; and a row (kind -1) of the distinct keys and their sum."""
    table = table.combine_chunks()
    keys, n = (table.column(c).combine_chunks() for c in ("keys", "n"))
    keys, n = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (keys, n))
    flat = keys.flatten().to_numpy().view(np.uint64)
    distinct, at = np.unique(flat, return_inverse=True)
    totals = np.bincount(at, n.flatten().to_numpy(), minlength=len(distinct)).astype(np.int64)
    lists = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())]).astype(np.int32)
    counted = (totals > 0) & (distinct != START)
    back = [table.column(c).combine_chunks() for c in ("grams", "bucket", "kind", "chunk")]
    back = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in back]
    sums = [back[0][:1], back[1][:1], pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([[int(counted.sum()), int(totals[counted].sum())]], pa.list_(pa.int64()))]
    names = ["grams", "bucket", "kind", "chunk", "n"]
    replies = pa.Table.from_arrays([*back, pa.ListArray.from_arrays(pa.array(lists), pa.array(totals[at]))], names=names)
    return pa.concat_tables([replies, pa.Table.from_arrays(sums, names=names)])


OWN = ["chunk", "ids", "learned", "lengths", "keys", "tokens"]


def _own(id_type: pa.DataType):
    types = id_type, pa.bool_(), pa.int32(), pa.int64(), pa.int32()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            columns = (chunk.ids, chunk.learned, chunk.lengths.astype(np.int32), chunk.keys.view(np.int64), chunk.tokens)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk.name], pa.int64()), *lists], names=OWN)

    return own


def _meet(own: pa.Table, answers: pa.Table) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, the totals of its words, the number of each token's pair, and the totals of its pairs."""
    if own.num_rows != 1:
        raise RuntimeError("a stored row was cut into another chunk when it was read again")
    row = [own.column(c)[0].values for c in own.column_names[1:]]
    chunk = Chunk(row[0].to_pylist(), row[1].to_numpy(zero_copy_only=False), row[2].to_numpy().astype(np.int64), row[3].to_numpy().view(np.uint64), row[4].to_numpy(), 0)
    pairs, at = np.unique(chunk.pair_hashes(), return_inverse=True)
    found = []
    for grams, size in ((1, len(chunk.keys)), (2, len(pairs))):
        rows = sorted((b.as_py(), i) for i, (g, b) in enumerate(zip(answers.column("grams"), answers.column("bucket"), strict=True)) if g.as_py() == grams)
        n = np.concatenate([answers.column("n")[i].values.to_numpy() for _, i in rows])
        if len(n) != size:
            raise RuntimeError("a chunk's answers don't fit its questions")
        found.append(n)
    return chunk, found[0], at, found[1]


def _context(counts: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXT_BUCKETS - 1, np.ceil(np.log2(counts + 1.0))).astype(np.int64)


def _held_out(total: int):
    """Histogram of a chunk's deleted estimates: by context bucket and by bins of both estimates."""

    def counted(own: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, words, pair, pairs = _meet(own, answers)
        text = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
        before, after = chunk.previous(), chunk.tokens

        def without(number: np.ndarray, totals: np.ndarray) -> np.ndarray:
            _, at, n = np.unique(text * (len(totals) + 1) + number, return_inverse=True, return_counts=True)
            return totals[number] - n[at]

        context = without(before, words)  # a word stands before another as often as it stands in the text
        bigram, unigram = without(pair, pairs), without(after, words)
        f2 = np.where(context > 0, bigram / np.maximum(context, 1), 0.0)
        f1 = unigram / np.maximum(1, total - chunk.lengths[text])
        bins = [np.where(f > 0, np.round(np.log10(np.maximum(f, 1e-12)) * BINS_A_DECADE) + 200, 0).astype(np.int64) for f in (f2, f1)]
        code, at = np.unique((_context(context) * 512 + bins[0]) * 512 + bins[1], return_inverse=True)
        return pa.table({"code": code, "n": np.bincount(at).astype(np.int64), "f2": np.bincount(at, f2), "f1": np.bincount(at, f1)})

    return counted


def learn_weights(context: np.ndarray, n: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) for each context bucket by expectation-maximisation. Buckets without held-out tokens
    take those of all tokens together; unseen contexts (bucket 0) have no pair estimate."""

    def em(rows: np.ndarray) -> np.ndarray:
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        f = np.stack([f2[rows], f1[rows], np.full(rows.sum(), f0)])
        for _ in range(rounds):
            share = w[:, None] * f
            w = (share / share.sum(axis=0) * n[rows]).sum(axis=1) / n[rows].sum()
        return w * 0.999 + 0.001 / 3  # no weight is ever nothing

    every = em(np.ones(len(n), bool)) if len(n) else np.array([0.3, 0.4, 0.3])
    found = np.stack([em(context == b) if (context == b).any() else every for b in range(CONTEXT_BUCKETS)])
    found[0] = [0, *(found[0][1:] / found[0][1:].sum())]
    return found


def _scored(weights: np.ndarray, total: int, vocabulary: int, id_type: pa.DataType):
    def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, words, pair, pairs = _meet(own, answers)
        c, h = words[chunk.tokens], words[chunk.previous()]
        w = weights[_context(h)]
        p = w[:, 0] * (pairs[pair] / np.maximum(h, 1)) + w[:, 1] * (c / max(1, total)) + w[:, 2] / (vocabulary + 1)
        at = np.concatenate([[0], np.cumsum(chunk.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, at)
        base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
        return pa.table({"id": pa.array(chunk.ids, id_type), "learned": chunk.learned, "n_tokens": chunk.lengths, "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))})

    return scored


def scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; rows whose id falls
    in fold 0 of 10 aren't learned from."""
    tenth = fold(F.col(id_col), 10).cast("int")
    kind, id_type = docs.schema[id_col].dataType.simpleString(), docs.select(id_col).limit(0).toArrow().schema.field(0).type
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tenth.alias("tenth")), "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, chunks = max(4, -(-size // BUCKET_BYTES)), max(4, -(-size // CHUNK_BYTES))
    asked = rows.mapInArrow(_ask(buckets), "grams int, bucket int, kind int, chunk long, keys array<long>, n array<int>")
    answers = materialize(asked.repartition(buckets, "grams", "bucket").groupBy("grams", "bucket").applyInArrow(_answer, ANSWERED), "answers")
    sums = answers.where("kind = -1 AND grams = 1").agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first()
    vocabulary, total = int(sums[0] or 0), int(sums[1] or 0)
    own = f"chunk long, ids array<{kind}>, learned array<boolean>, lengths array<int>, keys array<long>, tokens array<int>"
    grouped = lambda df: df.repartition(chunks, "chunk").groupBy("chunk")
    meet = lambda rows, answers: grouped(rows.mapInArrow(_own(id_type), own)).cogroup(grouped(answers.where("kind >= 0")))
    held = meet(rows.where("tenth = 1"), answers.where("kind = 1")).applyInArrow(_held_out(total), "code long, n long, f2 double, f1 double")
    held = held.groupBy("code").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1")).toPandas()  # bounded by the number of bins
    n = held["n"].to_numpy(np.float64)
    weights = learn_weights(held["code"].to_numpy() // (512 * 512), n, held["f2"].to_numpy() / n, held["f1"].to_numpy() / n, 1 / (vocabulary + 1))
    found = meet(rows, answers).applyInArrow(_scored(weights, total, vocabulary, id_type), f"id {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
