"""Ranked lexical search over bit-sliced Bloom signatures.

The documents of a block have one Bloom filter each, over their terms; the filters are stored sliced: one bitmap
over the documents for each place of the filter. The slices of a term's places, intersected, hold every
document with that term and a few others, so the sum of term weights over such bitmaps is never below what the
documents can score. Frequencies go the same way: a term that occurs twice, four times ... is also entered as
that level, so a document without the mark of a level has fewer occurrences. Document lengths are kept exactly.

A block of queries meets a block of documents: upper bounds for all documents come from the slices alone; the most
promising are scored exactly, which gives a score that results must reach, and then every document whose bound
reaches it. Exact scores come from the forward index that a block keeps next to its slices. The
best of each block are merged at the end; no text is shuffled.

Blocks hold documents of about the same number of distinct terms, so that one filter size suits all of them. A filter
has at most ``MOST_BITS`` places: beyond that its bounds are looser, not wrong.

Defined cases: a null text has no term; a document without terms takes no part; texts are read whole; a document
without id takes part and comes after all others of its score; rows with one id are documents of their own. Rows of
queries that share an id are one query over the terms of all of them, and so are those without id. A query without a term that
any document has gives no rows, nor does an empty table. Only id and text are read.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from leadweave.llm.common import whole_text
from leadweave.session import settle

# Fixed value of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 4  # frequencies 1, 2, 4, 8 and more have marks of their own
BITS_PER_MARK, LEAST_BITS, MOST_BITS = 8, 64, 1 << 20
_MOST_CELLS, _MOST_DOCUMENTS = 1 << 23, 2048
_SEGMENT_BYTES, _TERMS_AT_ONCE = 16 << 20, 1024
QUERIES_PER_BLOCK, _BROADCAST_BYTES = 256, 32 << 20

_NO_TERM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_NO_TERM).split()


# --- the index ------------------------------------------------------------------------------------


def _places(hashes: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of *bits* (a power of two) for a term at a level."""
    h = (hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    last = np.uint64(bits - 1)
    return (h & last).astype(np.int64), ((h >> np.uint64(31)) & last).astype(np.int64)


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, terms), np.uint64, len(terms))


_BLOCK = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.int32()), ("slices", pa.binary()),
    ("terms", pa.list_(pa.string())), ("term_docs", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("numbers", pa.binary()), ("counts", pa.binary()),
])
_BLOCK_COLUMNS = (
    "doc_ids array<long>, sizes array<long>, bits int, slices binary, terms array<string>, term_docs array<int>, "
    "ends array<int>, numbers binary, counts binary"
)


def _block(ids: list, sizes: np.ndarray, bits: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    """One block from its entries (row, term, tf), sorted by row, then term; *words* spells all terms of the segment."""
    used, term = np.unique(term, return_inverse=True)
    words = [words[t] for t in used.tolist()]
    hashes = _hashes(words)
    cells = np.zeros((bits, -(-len(ids) // 8) * 8), bool)
    for level in range(LEVELS):
        marked = tf >= 1 << level
        for place in _places(hashes[term[marked]], level, bits):
            cells[place, row[marked]] = True
    ends = np.cumsum(np.bincount(row, minlength=len(ids)))
    values = [
        ids, sizes, bits, np.packbits(cells, axis=1).tobytes(), pa.array(words, pa.binary()).cast(pa.string()),
        np.bincount(term, minlength=len(words)).astype(np.int32), ends.astype(np.int32),
        term.astype("<i4").tobytes(), tf.astype("<i4").tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)


def _blocks(segment: list[tuple]) -> Iterator[pa.RecordBatch]:
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids, lists = [], []
    for doc_id, text in segment:
        terms = _terms(text)
        if terms:
            ids.append(doc_id)
            lists.append(np.fromiter(map(known.__getitem__, terms), np.int64, len(terms)))
    if not ids:
        return
    words = list(known)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    pairs, tf = np.unique(np.repeat(np.arange(len(ids)), sizes) * len(words) + np.concatenate(lists), return_counts=True)
    row, term = np.divmod(pairs, len(words))
    marks = np.bincount(row, np.minimum(np.log2(tf).astype(np.int64) + 1, LEVELS), minlength=len(ids))
    bits = 2 ** np.ceil(np.log2(np.clip(marks * BITS_PER_MARK, LEAST_BITS, MOST_BITS))).astype(np.int64)
    starts = np.searchsorted(row, np.arange(len(ids) + 1))
    order = np.argsort(bits, kind="stable")
    for size in np.unique(bits).tolist():
        of_size = order[bits[order] == size]
        step = min(_MOST_DOCUMENTS, max(8, _MOST_CELLS // size))
        for at in range(0, len(of_size), step):
            some = of_size[at:at + step]
            entries = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in some.tolist()])
            rows = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            yield _block([ids[r] for r in some.tolist()], sizes[some], size, rows, term[entries], tf[entries], words)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            segment.append((doc_id, text))
            size += len(text)
            if size >= _SEGMENT_BYTES:
                yield from _blocks(segment)
                segment, size = [], 0
    if segment:
        yield from _blocks(segment)


def indexed(documents: DataFrame) -> DataFrame:
    """The index of ``doc_id, text``: one row per block of documents. Settle it before it is searched."""
    told = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return told.mapInArrow(_index_rows, _BLOCK_COLUMNS)


# --- the queries ----------------------------------------------------------------------------------


def query_terms(queries: DataFrame, item: str = "item_id") -> DataFrame:
    """``item_id, term``: the distinct terms of each query."""
    lower = F.translate(whole_text(), string.ascii_uppercase, string.ascii_lowercase)
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))
    return queries.select(F.col(item).alias("item_id"), F.explode(terms).alias("term")).distinct()


def _weighted(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``item_id, term, weight`` of the terms that any document has."""
    told = index.select(F.explode(F.arrays_zip("terms", "term_docs")).alias("t")).select("t.terms", "t.term_docs")
    wanted = asked.select(F.col("term").alias("terms")).distinct()
    df = told.join(wanted, "terms", "left_semi").groupBy(F.col("terms").alias("term")).agg(F.sum("term_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(df, "term").select("item_id", "term", weight.alias("weight"))


def _query_blocks(weighted: DataFrame, per_block: int) -> DataFrame:
    """``number, items, bytes``: blocks of queries, dealt by hash."""
    single = weighted.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"), F.sum(F.octet_length("term") + 12).alias("bytes")
    )
    single = settle(single)
    blocks = max(1, -(-single.count() // per_block))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    return settle(single.groupBy(number.alias("number")).agg(
        F.collect_list(F.struct("item_id", F.col("terms.term").alias("term"), F.col("terms.weight").alias("weight"))).alias("items"), F.sum("bytes").alias("bytes")
    ))


# --- the search -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Query:
    """A query's id, the places of its terms among those of its block of queries, and their weights."""

    item: int | None
    terms: np.ndarray
    weights: np.ndarray


def _queries(items: list[dict]) -> tuple[pa.Array, np.ndarray, list[Query]]:
    """The distinct terms of a block of queries, their hashes, and the queries."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    queries = [
        Query(i["item_id"], np.array([known[t] for t in i["term"]], np.int64), np.array(i["weight"], np.int64)) for i in items
    ]
    return pa.array(list(known), pa.string()), _hashes([t.encode() for t in known]), queries


class Block:
    """The documents of a block, as :func:`indexed` has stored them, for one corpus of *n* documents and *length* terms."""

    def __init__(self, row: dict, n: int, length: int):
        self.row, self.ids = row, row["doc_ids"]
        sizes = row["sizes"].to_numpy()
        self.m = 10 + 90 * sizes * n // length
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)
        # What a term of each level can add at most for one unit of weight, less what the level before could.
        most = [self.part(np.int64(2 * (1 << level) - 1)) for level in range(LEVELS - 1)] + [np.int64(10**6)]
        self.steps = [most[0], *[b - a for a, b in zip(most, most[1:])]]

    def part(self, tf: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        m = self.m[rows]
        return 10**9 * tf // (1000 * tf + 8 * (m[:, None] if np.ndim(tf) == 2 else m))

    def bounds(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of each document's score, from the slices."""
        total = np.zeros(len(self.m), np.int64)
        for at in range(0, len(hashes), _TERMS_AT_ONCE):
            some, seen = slice(at, at + _TERMS_AT_ONCE), None
            for level, step in enumerate(self.steps):
                one, two = _places(hashes[some], level, self.row["bits"])
                now = self.slices[one] & self.slices[two]
                seen = now if seen is None else now & seen
                present = np.unpackbits(seen, axis=1, count=len(self.m))
                total += (weights[some].astype(np.float64) @ present).astype(np.int64) * step
        return total

    def search(self, terms: pa.Array, hashes: np.ndarray, queries: list[Query], k: int, floors: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and scores of its *k* best documents above zero.

        Those below the query's floor, a score that k documents elsewhere reach, may be left out.
        """
        words = self.row["terms"]
        ends = self.row["ends"].to_numpy()
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self._keys = of * len(words) + np.frombuffer(self.row["numbers"], "<i4")
        self._counts = np.frombuffer(self.row["counts"], "<i4").astype(np.int64)
        self._numbers = pc.index_in(terms, value_set=words).fill_null(-1).to_numpy()
        return [self._best(q, hashes[q.terms], k, floors.get(q.item, 0)) for q in queries]

    def _scores(self, rows: np.ndarray, query: Query) -> np.ndarray:
        """The exact scores of *rows*, from the forward index."""
        numbers = self._numbers[query.terms]
        there = numbers >= 0
        numbers, weights, scores = numbers[there], query.weights[there], np.zeros(len(rows), np.int64)
        for at in range(0, len(numbers), _TERMS_AT_ONCE):
            some = slice(at, at + _TERMS_AT_ONCE)
            wanted = rows[:, None] * len(self.row["terms"]) + numbers[some]
            found = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
            tf = np.where(self._keys[found] == wanted, self._counts[found], 0)
            scores += (self.part(tf, rows) * weights[some]).sum(axis=1)
        return scores

    def _best(self, query: Query, hashes: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.bounds(hashes, query.weights)
        if len(bounds) > k:
            promising = np.argpartition(-bounds, k - 1)[:k]
            if bounds[promising].min() >= floor:
                floor = max(floor, int(self._scores(promising, query).min()))
        rows = np.flatnonzero(bounds >= max(floor, 1))
        if not len(rows):
            return rows, np.empty(0, np.int64)
        scores = self._scores(rows, query)
        # Documents without id come after all others of their score.
        ids = self.ids.take(pa.array(rows))
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), absent, -scores))
        order = order[scores[order] > 0][:k]
        return rows[order], scores[order]


def _search(n: int, length: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int | None, int] = {}  # per query the k-th best score in a block of this task so far
        ready: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                named = {c: row[c].values for c in ("doc_ids", "sizes", "terms", "ends")}
                named |= {c: row[c].as_buffer() for c in ("slices", "numbers", "counts")}
                block = Block(named | {"bits": row["bits"].as_py()}, n, length)
                number = row["number"].as_py()
                if number not in ready:
                    ready = {number: _queries(row["items"].as_py())}
                terms, hashes, queries = ready[number]
                found = block.search(terms, hashes, queries, k, floors)
                for query, (at, scores) in zip(queries, found):
                    if len(at) == k:
                        floors[query.item] = max(floors.get(query.item, 0), int(scores[-1]))
                at = np.concatenate([a for a, _ in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array([q.item for q in queries], pa.int64()).take(pa.array(np.repeat(np.arange(len(queries)), [len(a) for a, _ in found]))),
                    block.ids.take(pa.array(at)), pa.array(np.concatenate([s for _, s in found])),
                ], ["item_id", "doc_id", "score"])

    return rows


def ranked(documents: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id", per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the *k* best documents above zero for each query, by score, then id.

    Queries are sent to the blocks of documents in portions of ``_BROADCAST_BYTES`` at most (or one block of
    queries); each portion is one pass over the index.
    """
    index = settle(indexed(documents))
    sizes = index.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, length = sizes[0] or 0, sizes[1] or 0
    asked = settle(query_terms(queries, item).withColumn("item_id", F.col("item_id").cast("long")))
    blocks = _query_blocks(_weighted(index, asked, n), per_block)
    portions: list[list[int]] = []
    room = 0
    # One number and one size per block of queries.
    for number, size in blocks.select("number", "bytes").orderBy("number").collect():
        if not portions or size > room:
            portions.append([])
            room = _BROADCAST_BYTES
        portions[-1].append(number)
        room -= size

    def searched(numbers: list[int]) -> DataFrame:
        some = blocks.where(F.col("number").isin(numbers)).select("number", "items")
        meet = index.withColumn("number", F.explode(F.array(*map(F.lit, numbers))))
        return meet.join(F.broadcast(some), "number").mapInArrow(_search(n, length, k), "item_id long, doc_id long, score long")

    if not portions:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.col("item_id").alias("doc_id"), F.col("item_id").alias("score"))
    found = reduce(DataFrame.unionByName, map(searched, portions))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
