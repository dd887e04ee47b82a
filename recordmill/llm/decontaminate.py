"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Items are cut into entries of at most ENTRY_WORDS words. Every document is cut into overlapping passages of twice that
length, so that any entry that stands in a document stands whole in one of its passages. Each passage is a query (its
distinct words) and retrieves every entry whose BM25 score reaches THRESHOLD of the entry's score against itself; there
is no top-k. Document frequencies, the number of entries and their average length are those of the whole benchmark.

Search is block-max WAND, for many passages at once. A passage whose words can't reach a threshold with their largest
impacts is done. The pivot of another parts its common words, which stand in many blocks of entries, from its rare ones:
where the common ones can't reach a threshold together, only blocks that hold a rare one are looked at. In each of these,
the words' maxima in the block bound the score, and only blocks whose bound reaches the threshold are opened and scored.
Block maxima are lists for rare words and rows for common ones, which take no more than COMMON times the lists' room.

What is retrieved is verified: at least OVERLAP of the item's five-word shingles, and at least HALF of those of its
question and of its answer, must stand in the document around the passage. Without an answer column, shingles that begin
in an item's first half count as its question's, the others as its answer's.

Words are runs of letters, digits and underscores, lower-cased. Items without words are left out; null texts have no
passages. Questions and answers with fewer than five words are one shingle. Rows that repeat an item count once; other
rows that share an id are items of their own, reported once a document, by the better score. Items with a null id are
reported each, with a null id. Ids may be of any type. Repeated documents give repeated rows. Empty tables give empty
results, and no item means that all documents stay.

An index holds the items of about INDEX_WORDS words and is broadcast; items that share an id stand in one index. A larger
benchmark makes several, and each is one more pass over the documents; the statistics are shared, so results don't depend
on how items fall into indexes.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.session import materialize

ENTRY_WORDS = 48
THRESHOLD = 0.75
OVERLAP = 0.8
HALF = 0.5
SHINGLE = 5
K1, B = 1.2, 0.75
#: Entries in a block of the index, by number.
ENTRY_BLOCK = 8
#: A word is common if it stands in one of so many blocks.
COMMON = 4
#: Passages, and pairs of a passage and a block, that are searched at once; what rounding may take from a score of 1, and
#: from a bound.
PASSAGES = 4_000
CELLS = 400_000
SLACK, BOUND_SLACK = 1e-9, 1e-5
#: Words of the items in one broadcast index, about. An item isn't cut over indexes.
INDEX_WORDS = 2_000_000
_WORD = re.compile(r"\w+")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_set(words: list, size: int = SHINGLE) -> set[tuple]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def halves(words: list, question: int, answered: bool) -> list[tuple[set[tuple], int]]:
    """The shingles of a question and of an answer, each with their size. words: both, question: how many are its."""
    if answered:
        parts = words[:question], words[question:]
        return [(shingle_set(w, min(SHINGLE, len(w))), min(SHINGLE, len(w))) for w in parts]
    size = min(SHINGLE, len(words))
    starts = range(len(words) - size + 1)
    return [({tuple(words[i : i + size]) for i in starts if (2 * i < len(starts)) == first}, size) for first in (True, False)]


def cut(words: list, entry_words: int = ENTRY_WORDS) -> list[list]:
    """An item's entries, of about the same length."""
    n = -(-len(words) // entry_words)
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


@dataclasses.dataclass
class Statistics:
    """Of all entries of a benchmark."""

    entries: int
    average: float
    df: dict[str, int]

    @staticmethod
    def of(rows: list[tuple], entry_words: int = ENTRY_WORDS) -> Statistics:
        bags = [e for _, q, a in rows if item_words(q) + item_words(a) for e in cut(item_words(q) + item_words(a), entry_words)]
        return Statistics(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(t for bag in bags for t in set(bag)))


@dataclasses.dataclass
class Index:
    """Postings hold normed impacts: an entry's BM25 contribution over what its score must reach. So every threshold is 1."""

    terms: dict[str, int]
    largest: np.ndarray  # by term: its largest impact
    blocks: int
    lists: np.ndarray  # by term: where its blocks begin; one more for the end
    keys: np.ndarray  # term * blocks + block of each list entry, ascending
    block: np.ndarray  # the block of each list entry
    row: np.ndarray  # by term: its row, -1 for rare words
    rows: np.ndarray  # by common word and block: the largest impact
    maxima: np.ndarray  # the largest impact of the term in the block
    starts: np.ndarray  # where the postings of the term in the block begin; one more for the end
    entry: np.ndarray
    impact: np.ndarray
    owner: np.ndarray  # the item of each entry
    items: list[tuple[object, np.ndarray, int, bool]]  # id, words as terms, words of the question, whether there is an answer


def build(rows: list[tuple], statistics: Statistics | None = None, entry_words: int = ENTRY_WORDS, threshold: float = THRESHOLD) -> Index:
    """rows: item id, question, answer (null: halves of the question)."""
    statistics = statistics or Statistics.of(rows, entry_words)
    terms: dict[str, int] = {}
    items, owner, postings = [], [], []
    for item, question, answer in rows:
        q, a = item_words(question), item_words(answer)
        if not q and not a:
            continue
        for words in cut(q + a, entry_words):
            bag = Counter(words)
            norm = K1 * (1 - B + B * len(words) / statistics.average)
            impact = {}
            for t, tf in bag.items():
                n = statistics.df[t]
                impact[t] = math.log(1 + (statistics.entries - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + norm)
            least = threshold * sum(impact.values())
            postings += [(terms.setdefault(t, len(terms)), len(owner), x / least) for t, x in impact.items()]
            owner.append(len(items))
        items.append((item, np.array([terms[t] for t in q + a], np.int32), len(q), answer is not None))
    blocks = max(1, -(-len(owner) // ENTRY_BLOCK))
    term, entry, impact = (np.array([p[i] for p in postings], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    order = np.lexsort((entry, term))
    term, entry, impact = term[order], entry[order], impact[order]
    keys, starts = np.unique(term * blocks + entry // ENTRY_BLOCK, return_index=True)
    maxima = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    lists = np.searchsorted(keys, np.arange(len(terms) + 1) * blocks)
    largest = np.maximum.reduceat(maxima, lists[:-1]) if len(terms) else np.zeros(0)
    common = np.diff(lists) * COMMON >= blocks
    row = np.where(common, np.cumsum(common) - 1, -1)
    rows_ = np.zeros((int(common.sum()), blocks), np.float32)
    of = row[keys // blocks]
    rows_[of[of >= 0], (keys % blocks)[of >= 0]] = maxima[of >= 0]
    return Index(terms, largest, blocks, lists, keys, keys % blocks, row, rows_, maxima, np.append(starts, len(entry)), entry, impact, np.array(owner, np.int64), items)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every place of ranges that begin at first and have these sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, entry, normed score) of every score of at least 1. passage, term: the distinct terms of each passage,
    sorted by passage."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(term))))
    alive = np.add.reduceat(index.largest[term], begin) >= 1 - BOUND_SLACK
    passage, term, number = passage[alive[number]], term[alive[number]], number[alive[number]]
    if not len(term):
        return empty
    number = (np.cumsum(alive) - 1)[number]
    begin = np.searchsorted(number, np.arange(number[-1] + 1))
    # what rare words may add, by passage and block, and common ones at most
    common = index.row[term] >= 0
    own, pos = _ranges(index.lists[term[~common]], np.diff(index.lists)[term[~common]])
    bound = np.bincount(number[~common][own] * index.blocks + index.block[pos], index.maxima[pos], minlength=len(begin) * index.blocks).astype(np.float64).reshape(len(begin), index.blocks)
    most = np.bincount(number[common], index.largest[term[common]], minlength=len(begin))
    looked = bound >= 1 - BOUND_SLACK - most[:, None]
    some = looked.any(axis=1)
    picked = common & some[number]
    if picked.any():  # the maxima of the common words in the blocks
        at = number[picked]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bound[at[first]] += np.add.reduceat(index.rows[index.row[term[picked]]], first, axis=0)
    who, block = np.nonzero(looked & (bound >= 1 - BOUND_SLACK))
    if not len(who):
        return empty
    # where the words of the passages stand in those blocks
    ends = np.append(begin[1:], len(term))
    pair, pos = _ranges(begin[who], (ends - begin)[who])
    wanted = term[pos] * index.blocks + block[pair]
    slot = np.minimum(np.searchsorted(index.keys, wanted), len(index.keys) - 1)
    there = index.keys[slot] == wanted
    pair, slot = pair[there], slot[there]
    # opened blocks are scored
    own, pos = _ranges(index.starts[slot], np.diff(index.starts)[slot])
    found, at = np.unique(who[pair][own] * len(index.owner) + index.entry[pos], return_inverse=True)
    score = np.bincount(at, index.impact[pos])
    good = score >= 1 - SLACK
    which, entry = np.divmod(found[good], len(index.owner))
    return passage[begin[which]], entry, score[good]


def hits(index: Index, docs: list[np.ndarray], entry_words: int = ENTRY_WORDS) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word of the passage, entry, normed score) for documents given as the term of every word (-1: a
    word of no item). A passage is two neighbouring cuts of entry_words words."""
    cuts = np.array([max(1, -(-len(d) // entry_words) - 1) for d in docs], np.int64)
    offsets = np.concatenate([[0], np.cumsum(cuts)])
    at_once = max(1, min(PASSAGES, CELLS // index.blocks))  # so that a long document takes bounded memory
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def search() -> Iterator[tuple[int, int, int, float]]:
        passage, term = np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held])
        if not len(term):
            return
        keys = np.unique(passage * len(index.terms) + term)
        for p, e, s in zip(*(x.tolist() for x in retrieve(index, *np.divmod(keys, len(index.terms)))), strict=True):
            d = int(np.searchsorted(offsets, p, "right")) - 1
            yield d, (p - int(offsets[d])) * entry_words, e, s

    for d, ids in enumerate(docs):
        begin = 0
        while begin < cuts[d]:
            end = min(int(cuts[d]), begin + at_once - count)
            part = ids[begin * entry_words : (end + 1) * entry_words]
            known = np.flatnonzero(part >= 0)
            at = known // entry_words
            both = np.concatenate([np.minimum(at, end - begin - 1), np.maximum(at - 1, 0)]) + offsets[d] + begin
            held.append((both, np.tile(part[known], 2).astype(np.int64)))
            count, begin = count + end - begin, end
            if count == at_once:
                yield from search()
                held, count = [], 0
    if held:
        yield from search()


def matches(index: Index, texts: list[str | None], entry_words: int = ENTRY_WORDS) -> list[dict[int, tuple[float, float, float]]]:
    """For each text, by item: the best score over passages, and the shares of question and answer shingles found."""
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    if not index.items:
        return found
    docs = []
    for text in texts:
        words = item_words(text)
        docs.append(np.fromiter(map(index.terms.get, words, (-1,) * len(words)), np.int32, len(words)))
    parts: dict[int, list[tuple[set[tuple], int]]] = {}
    for d, start, entry, score in hits(index, docs, entry_words):
        item = int(index.owner[entry])
        _, own, n_question, answered = index.items[item]
        if item not in parts:
            parts = parts if len(parts) < 1000 else {}
            parts[item] = halves(own.tolist(), n_question, answered)
        (question, size), (answer, other) = parts[item]
        around = docs[d][max(0, start - len(own)) : start + 2 * entry_words + len(own)].tolist()
        q, a = len(question & shingle_set(around, size)), len(answer & shingle_set(around, other))
        share = (q + a) / max(1, len(question) + len(answer))
        both = (q / len(question) if question else 1.0, a / len(answer) if answer else 1.0)
        if share >= OVERLAP and min(both) >= HALF:
            before = found[d].get(item, (0.0, 0.0, 0.0))
            found[d][item] = (max(before[0], score * THRESHOLD), *max(before[1:], both))
    return found


def _indexes(benchmark: DataFrame, question_col: str, answer_col: str | None, item_col: str, index_words: int) -> Iterator[Broadcast]:
    """Broadcast indexes over all items, with the statistics of all."""
    spark = benchmark.sparkSession
    answer = (F.col(answer_col) if answer_col else F.lit(None)).cast("string")
    items = materialize(benchmark.select(F.col(item_col).alias("item"), F.col(question_col).alias("q"), answer.alias("a")).distinct(), "items")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [e for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (w := item_words(q) + item_words(a)) for e in cut(w)]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, own), pa.int64()), pa.array([sorted(set(e)) for e in own], pa.list_(pa.string()))], names=["n", "words"])

    every = materialize(items.select("q", "a").mapInArrow(entries, "n long, words array<string>"), "entries")
    count, total = every.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    shards = max(1, -(-total // index_words))
    df = materialize(df, "frequencies") if shards > 1 else df
    name = F.xxhash64(F.coalesce(F.xxhash64(F.col("item").cast("string")), F.lit(0)), F.when(F.col("item").isNull(), F.xxhash64("q", "a")))
    for k in range(shards):
        rows, known = items, df
        if shards > 1:
            rows = items.where(F.pmod(name, F.lit(shards)) == k)
            words = rows.select("q", "a").mapInArrow(entries, "n long, words array<string>").select(F.explode("words").alias("word")).distinct()
            known = df.join(words, "word")
        frequencies = {r["word"]: r["n"] for r in known.collect()}
        listed = sorted((tuple(r) for r in rows.collect()), key=repr)
        yield spark.sparkContext.broadcast(build(listed, Statistics(count, total / max(1, count), frequencies)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", question_col: str = "text", answer_col: str | None = None, item_col: str = "item_id", index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and item that match. score is the
    best passage's BM25 over the item entry's own."""
    numbers = ["score", "question_overlap", "answer_overlap"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), *[T.StructField(c, T.DoubleType()) for c in numbers]])
    item_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    result = None
    for shared in _indexes(benchmark, question_col, answer_col, item_col, index_words):

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = []
                for i, found in enumerate(matches(index, batch.column(1).to_pylist())):
                    best: dict[object, tuple] = {}
                    for item, row in found.items():
                        name = index.items[item][0]
                        key = ("null", item) if name is None else name
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0, name)), (*row, name), key=lambda r: r[:3])
                    out += [(i, row[3], *row[:3]) for row in best.values()]
                ids = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in out], item_type), *[pa.array([r[k] for r in out], pa.float64()) for k in (2, 3, 4)]], names=["doc_id", "item_id", *numbers])

        found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(searched, schema)
        result = found if result is None else result.unionByName(found)
    return result


def holds_item(text: Column, index: Broadcast) -> Column:
    """Whether a text holds an item of a broadcast index."""

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([bool(m) for m in matches(index.value, batch.to_pylist())], pa.bool_())

    return holds(text)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", question_col: str = "text", answer_col: str | None = None, item_col: str = "item_id", index_words: int = INDEX_WORDS) -> DataFrame:
    """docs without the rows whose text holds an item."""
    for index in _indexes(benchmark, question_col, answer_col, item_col, index_words):
        docs = docs.where(~holds_item(F.col(text_col), index))
    return docs
