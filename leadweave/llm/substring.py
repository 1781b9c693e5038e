"""Substring dedup: Rabin-Karp hashes of all windows of words, counted in Spark.

A window is *width* consecutive words. Words covered by a window that also starts in a document with a
smaller id are removed. All windows are hashed where their text is read; to spare the shuffle, two steps
decide which hashes have to be counted across the cluster:

1. Each window names its anchor, the least hash among the word runs (``ANCHOR`` words) within it. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so a text has several
   times fewer anchors than windows. An anchor that only one document has rules out its windows.
2. The windows under the other anchors are counted by two independent hashes of 96 bits in all.

In either step a task tells of each hash once: repeats within a segment (a bounded run of rows) are decided
there, and an anchor that several documents of a segment have is theirs without further question. So a passage
that a third of all documents hold sends one short row per segment, without a list of those documents. Removed
windows then merge into maximal intervals of words.

Documents whose whole word sequence equals that of a smaller id are settled by a digest beforehand: all
of their windows are repeated.

Defined cases: a null text has no words; texts are read whole; repeated ids are one document each time
they occur, whatever their texts (rows go by id and a digest of the text), and as their ids are equal, none is
smaller, so they do not shorten each other; a row without id is never shortened and shortens none. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from leadweave.session import settle

WIDTH, ANCHOR = 13, 7
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_SEGMENT_BYTES = 4 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of polynomial hashes, so that their order is as good as random."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _rolled(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of every run of *width* words."""
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        h = h * base + words[k:k + n]
    return h


class _Segment:
    """Word hashes of several texts, and where each text's windows are."""

    def __init__(self, rows: list[tuple], width: int):
        known: dict[bytes, int] = {}
        lists = [text.encode("utf-8", "replace").split() for _, text, *_ in rows]
        for word in {w for words in lists for w in words}:
            known[word] = xxh64_intdigest(word)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.words = np.fromiter((known[w] for words in lists for w in words), np.uint64, sizes.sum())
        self.starts = np.cumsum(sizes) - sizes
        self.width = width
        n = max(len(self.words) - width + 1, 0)
        self.row = np.repeat(np.arange(len(lists)), sizes)[:n]
        self.place = np.arange(n) - self.starts[self.row]
        self.whole = self.place + width <= sizes[self.row]  # windows within one text

    def windows(self, base: np.uint64) -> np.ndarray:
        return _rolled(self.words, self.width, base)

    def anchors(self, run: int) -> np.ndarray:
        runs = _mixed(_rolled(self.words, run, _BASES[0]))
        n = len(self.row)
        least = runs[:n].copy()
        for k in range(1, self.width - run + 1):
            np.minimum(least, runs[k:k + n], out=least)
        return least


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in runs of about the same size in text."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            rows.append(row)
            size += len(row[1])
            if size >= _SEGMENT_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted arrays."""
    n = len(keys[0])
    starts = np.flatnonzero(np.logical_or.reduce([np.r_[True, k[1:] != k[:-1]] for k in keys])) if n else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, n])


def _rest(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray | None]:
    """The values of each run after its first one, None if there are none."""
    return [values[s + 1:s + n] if n > 1 else None for s, n in zip(starts.tolist(), counts.tolist())]


def _places(ids: np.ndarray, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """By row: its first place and the other ones."""
    order = np.lexsort((place, keys, ids))
    ids, keys, place = ids[order], keys[order], place[order]
    starts, counts = _groups(ids, keys)
    return ids[starts], keys[starts], place[starts], _rest(place, starts, counts)


_PIECES = "one long, two int, doc_id long, key long, place int, places array<int>"


def _pieces(
    one: np.ndarray | None, two: np.ndarray | None, ids: np.ndarray, keys: np.ndarray, place: np.ndarray, rest: list
) -> pa.RecordBatch:
    """Windows of one row: those of one hash, or (no hash) those that are decided."""
    hashes = [
        pa.nulls(len(ids), kind) if h is None else pa.array(h.view(np.int64).astype(t))
        for h, kind, t in ((one, pa.int64(), np.int64), (two, pa.int32(), np.int32))
    ]
    return pa.RecordBatch.from_arrays(
        [*hashes, pa.array(ids), pa.array(keys), pa.array(place.astype(np.int32)), pa.array(rest, pa.list_(pa.int32()))],
        ["one", "two", "doc_id", "key", "place", "places"],
    )


def _ids(segment: list[tuple], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text digests of the rows of a segment, at *row*."""
    return tuple(np.fromiter((r[c] for r in segment), np.int64, len(segment))[row] for c in (0, 2))


_ANCHORS = "slot long, doc_id long, key long, anchors array<long>"


def _anchor_rows(width: int, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Three kinds of rows, see ``_ANCHORS``.

    An anchor that one document of the segment has: the anchor as slot, and the document, which asks whether others
    have it too. An anchor that several have: the slot alone. Of each document all of the latter, in ``anchors``.
    """

    def batch(slot: np.ndarray, ids: np.ndarray | None, keys: np.ndarray | None, anchors: list | None) -> pa.RecordBatch:
        n = len(slot)
        columns = [pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in (ids, keys)]
        lists = pa.nulls(n, pa.list_(pa.int64())) if anchors is None else pa.array(anchors, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(slot), *columns, lists], ["slot", "doc_id", "key", "anchors"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            texts = _Segment(segment, width)
            ids, keys = _ids(segment, texts.row[texts.whole])
            anchor = texts.anchors(run)[texts.whole].view(np.int64)
            order = np.lexsort((keys, ids, anchor))
            anchor, ids, keys = anchor[order], ids[order], keys[order]
            starts, _ = _groups(anchor, ids, keys)
            anchor, ids, keys = anchor[starts], ids[starts], keys[starts]
            starts, counts = _groups(anchor)
            alone = starts[counts == 1]
            yield batch(anchor[alone], ids[alone], keys[alone], None)
            yield batch(anchor[starts[counts > 1]], None, None, None)
            several = np.repeat(counts > 1, counts)
            anchor, ids, keys = anchor[several], ids[several], keys[several]
            order = np.lexsort((keys, ids))
            anchor, ids, keys = anchor[order], ids[order], keys[order]
            starts, counts = _groups(ids, keys)
            lists = [anchor[s:s + n] for s, n in zip(starts.tolist(), counts.tolist())]
            yield batch(_mixed((ids ^ keys).view(np.uint64))[starts].view(np.int64), ids[starts], keys[starts], lists)

    return rows


def shared_anchors(documents: DataFrame, width: int, run: int) -> DataFrame:
    """``doc_id, key, anchors``: of each of ``doc_id, text, key`` those of its anchors that other documents have too."""
    told = documents.mapInArrow(_anchor_rows(width, run), _ANCHORS)
    # A segment sends an anchor once, so even the commonest one has only as many short rows as there are segments.
    # Rows that are settled lie in slots of their own; one shuffle takes all kinds. A slot that happens to
    # equal an anchor only means that windows are counted in vain.
    asked = F.col("anchors").isNull()
    segments, told_of = (f.over(Window.partitionBy("slot")) for f in (F.count_if(asked), F.count_if(asked & F.col("doc_id").isNull())))
    shared = told.withColumn("shared", ~asked | (segments > 1) | (told_of > 0)).where(F.col("shared") & F.col("doc_id").isNotNull())
    lists = shared.select("doc_id", "key", F.coalesce("anchors", F.array("slot")).alias("anchors"))
    return lists.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))


def _window_rows(width: int, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            texts = _Segment(segment, width)
            owned = [np.isin(a, np.asarray(s, np.int64)) for a, s in _by_row(texts, run, segment)]
            at = np.flatnonzero(np.concatenate(owned)) if owned else np.empty(0, np.int64)
            at = np.flatnonzero(texts.whole)[at]
            ids, keys = _ids(segment, texts.row[at])
            one, two = (texts.windows(b)[at] for b in _BASES)
            two = _mixed(two) >> np.uint64(32)
            place = texts.place[at]
            order = np.lexsort((place, keys, ids, two, one))
            one, two, ids, keys, place = one[order], two[order], ids[order], keys[order], place[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
            least = ids[new][np.cumsum(new) - 1]
            # A larger id than the least one here is decided; the least one asks the other segments.
            decided = ids > least
            yield _pieces(None, None, *_places(ids[decided], keys[decided], place[decided]))
            one, two, ids, keys, place = (v[~decided] for v in (one, two, ids, keys, place))
            starts, counts = _groups(one, two, keys)
            yield _pieces(one[starts], two[starts], ids[starts], keys[starts], place[starts], _rest(place, starts, counts))

    return rows


def _by_row(texts: _Segment, run: int, segment: list[tuple]) -> Iterator[tuple[np.ndarray, list]]:
    anchor, row = texts.anchors(run)[texts.whole].view(np.int64), texts.row[texts.whole]
    bounds = np.searchsorted(row, np.arange(len(segment) + 1))
    for i, (*_, shared) in enumerate(segment):
        yield anchor[bounds[i]:bounds[i + 1]], shared


def _merged(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals of words, end exclusive, that windows with these starts cover."""
    starts = np.unique(starts)
    first = np.flatnonzero(np.r_[True, np.diff(starts) > width])
    last = np.r_[first[1:], len(starts)] - 1
    return list(zip(starts[first].tolist(), (starts[last] + width).tolist()))


def _cut_rows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = (batch.column(c).to_pylist() for c in ("text", "starts"))
            spans = [_merged(np.asarray(s), width) for s in starts]
            kept, removed = [], []
            for text, cut in zip(texts, spans):
                words = text.encode("utf-8", "replace").split()
                removed.append(sum(b - a for a, b in cut))
                for a, b in reversed(cut):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            interval = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            intervals = pa.array([[{"start": a, "end": b} for a, b in cut] for cut in spans], interval)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), intervals, pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "key", "intervals", "n_removed", "kept"],
            )

    return rows


def joined_words(text: Column) -> Column:
    """The words of a text, one space apart."""

    @F.arrow_udf("struct<n:long,sha256:string>")
    def digest(batch: pa.Array) -> pa.Array:
        lists = [(t or "").encode("utf-8", "replace").split() for t in batch.to_pylist()]
        return pa.array([{"n": len(w), "sha256": sha256(b" ".join(w)).hexdigest()} for w in lists],
                        pa.struct([("n", pa.int64()), ("sha256", pa.string())]))

    return digest(text)


ROW = ["doc_id", "key"]


def removed_windows(documents: DataFrame, copies: DataFrame, width: int = WIDTH, run: int = ANCHOR) -> DataFrame:
    """``doc_id, key, starts``: the rows of ``doc_id, text, key`` with removed windows, and where those start (in words).

    *copies* are the rows (id and key) that need no look, as all of their windows are in a smaller id.
    """
    told = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "key")
    owned = shared_anchors(told, width, run).join(copies, ROW, "left_anti")
    asked = told.join(owned, ROW).select("doc_id", "text", "key", "anchors")
    pieces = settle(asked.mapInArrow(_window_rows(width, run), _PIECES))
    least = F.min("doc_id").over(Window.partitionBy("one", "two"))
    open_ = pieces.where("one is not null").withColumn("least", least).where("doc_id > least")
    removed = pieces.where("one is null").unionByName(open_.drop("least"))
    every = F.array_union(F.array("place"), F.coalesce("places", F.array().cast("array<int>")))
    return removed.groupBy(*ROW).agg(F.flatten(F.collect_list(every)).alias("starts"))


def deduplicated(documents: DataFrame, width: int = WIDTH, run: int = ANCHOR) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, intervals, kept, kept_sha256``.

    ``intervals`` are the maximal removed runs of words and ``kept`` the words that are left, null where
    nothing was removed; ``kept_sha256`` is always the digest of what is left.
    """
    digests = documents.select("doc_id", F.xxhash64("text").alias("digest"), joined_words(F.col("text")).alias("all"))
    digests = settle(digests.select("doc_id", "digest", "all.*"))
    # Only rows whose id has several texts need the digest of theirs; for all others it would be moved for nothing.
    ends = digests.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = settle(ends.where("low <> high").select("doc_id", F.lit(True).alias("several")))
    key = lambda digest: F.when(F.col("several"), digest).otherwise(F.lit(0).cast("long")).alias("key")
    keyed = documents.select("doc_id", "text").join(several, "doc_id", "left").select("doc_id", "text", key(F.xxhash64("text")))
    digests = digests.join(several, "doc_id", "left").select("doc_id", key(F.col("digest")), "n", "sha256")
    firsts = digests.where(F.col("n") >= width).groupBy("sha256").agg(F.min("doc_id").alias("first"))
    marked = digests.join(firsts, "sha256", "left")
    copies = settle(marked.where("doc_id > first").select(*ROW).distinct())
    removed = removed_windows(keyed, copies, width, run)
    cut = keyed.where("text is not null").join(removed, ROW).select(*ROW, "text", "starts").mapInArrow(
        _cut_rows(width),
        "doc_id long, key long, intervals array<struct<start:int,end:int>>, n_removed long, kept string",
    )
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256)).dropDuplicates(ROW)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marked.join(cut, ROW, "left").select(
        "doc_id", F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.col("intervals")).alias("intervals"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
