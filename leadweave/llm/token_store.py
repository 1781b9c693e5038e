"""Token ids in training order, as binary shards of fixed stride.

The documents of an input split, each followed by an end mark, form one stream of ids, which is
cut into sequences of equal length (the split's last one is filled up with end marks). A keyed Feistel network permutes the numbers of the
sequences: it permutes the next power of four, and walks on along its cycle while it lands outside
the range, so the slots 0 to n - 1 are a permutation without any table. Slots are dealt by
range, so that each shard holds consecutive slots, and every record has the same number of bytes: record
r of shard s starts at byte ``r * stride`` and is slot ``s * per_shard + r``. Reading in training order is
sequential, and can start anywhere.

Shards are written by Spark's own text writer (a record's bytes and one line feed), so failed tasks
leave no half-written shard, and any file system that Spark knows will do.

Defined cases: an id that does not fit two bytes is an error; a null text is empty and gives only its end mark; texts are encoded whole; repeated
rows are documents of their own; an empty table writes nothing. Only ``text`` is read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leadweave.llm.common import spread
from leadweave.session import settle, shared_path

_WIDTH = np.dtype("<u2").itemsize
_IDS_AT_ONCE = 1 << 20
_MOST_IDS = 1 << 8 * _WIDTH


@dataclass(frozen=True)
class Layout:
    """Sequence length in ids, and records per shard."""

    length: int = 2048
    per_shard: int = 2048

    @property
    def stride(self) -> int:
        return self.length * _WIDTH + 1


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    if max(ranks.values(), default=0) >= _MOST_IDS:
        raise ValueError(f"{path} has ids of {_MOST_IDS} and more, which do not fit a record's {_WIDTH} bytes")
    return tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# --- the permutation ------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of ``0 .. n - 1`` at *numbers*."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [_mixed(np.array([(key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64)) for r in range(rounds)]
    out = numbers.astype(np.uint64)
    outside = np.ones(len(out), bool)
    while outside.any():
        left, right = out[outside] >> shift, out[outside] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[outside] = left << shift | right
        outside[outside] = out[outside] >= n
    return out.astype(np.int64)


# --- the sequences and their shards -----------------------------------------------------------------


def _sequences(path: str, pattern: str, end_id: int, length: int):
    """The ids of a split's documents as one stream, cut into sequences of two bytes per id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = _encoder(path, pattern), TaskContext.get().partitionId()
        left, number, size = np.empty(0, "<u2"), 0, length * _WIDTH

        def batch(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            data, n = ids.tobytes(), len(ids) // length
            numbers = np.arange(number, number + n)
            number += n
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, split), pa.int64()), pa.array(numbers, pa.int64()),
                pa.array([data[i * size:(i + 1) * size] for i in range(n)], pa.binary()),
            ], ["split", "number", "tokens"])

        end, parts, pending = np.array([end_id], "<u2"), [], 0
        for texts in batches:
            for text in texts.column(0):
                text = (text.as_py() or "").encode("utf-8", "replace").decode()
                parts += [encoder.encode_to_numpy(text, disallowed_special=()).astype("<u2"), end]
                pending += len(parts[-2]) + 1
                if pending >= _IDS_AT_ONCE:
                    stream = np.concatenate([left, *parts])
                    whole = len(stream) // length * length
                    yield batch(stream[:whole])
                    left, parts, pending = stream[whole:], [], 0
        stream = np.concatenate([left, *parts])
        if len(stream):
            yield batch(np.r_[stream, np.full(-len(stream) % length, end_id, "<u2")])

    return rows


def _placed(n: int, key: int, per_shard: int):
    """Slot and shard of each sequence; its ids are compressed for the way to the shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slots = permuted(batch.column(0).to_numpy(zero_copy_only=False), n, key)
            packed = pa.array([press.compress(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), packed], ["shard", "slot", "packed"])

    return rows


def _unpacked(column: Column) -> Column:
    @F.arrow_udf("binary")
    def tokens(batch: pa.Array) -> pa.Array:
        press = zstandard.ZstdDecompressor()
        return pa.array([press.decompress(p) for p in batch.to_pylist()], pa.binary())

    return tokens(column)


def write_shards(
    documents: DataFrame, folder: str, path: str, pattern: str, end_id: int, layout: Layout = Layout(), key: int = 17
) -> int:
    """Writes all shards below *folder* (one file in ``shard=N`` each) and returns the number of sequences."""
    if not 0 <= end_id < _MOST_IDS:
        raise ValueError(f"end_id must lie between 0 and {_MOST_IDS - 1}")
    spark = documents.sparkSession
    stored = shared_path(spark, "sequences")
    documents.select("text").mapInArrow(
        _sequences(path, pattern, end_id, layout.length), "split long, number long, tokens binary"
    ).write.option("compression", "zstd").parquet(stored)
    sequences = spark.read.parquet(stored)
    # One row per input split, to number the sequences through.
    counts = sequences.groupBy("split").agg(F.count("*").alias("n"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("split", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    n = starts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0
    numbered = sequences.join(starts.select("split", "start"), "split")
    placed = numbered.select(F.col("start") + F.col("number"), "tokens").mapInArrow(
        _placed(n, key, layout.per_shard), "shard long, slot long, packed binary"
    )
    shards = -(-n // layout.per_shard)
    # A shard is a range of slots, and a task writes a range of shards. Slots are dense, so the bounds are known
    # without sampling. Tasks are bounded by the session's partitions, however many shards there are.
    tasks = min(shards, spread(spark))
    dealt = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")
    # The cast keeps the bytes as they are.
    dealt.select("shard", _unpacked(F.col("packed")).cast("string").alias("value")).write.partitionBy("shard").text(folder)
    return n


def _cut_shards(layout: Layout):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                n = data.size // layout.stride
                records = [data.slice(r * layout.stride, layout.stride - 1).to_pybytes() for r in range(n)]
                slots = np.arange(n) + shard * layout.per_shard
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(np.full(n, shard)), pa.array(records, pa.binary())], ["slot", "shard", "tokens"]
                )

    return rows


def read_slots(spark: SparkSession, folder: str, layout: Layout = Layout(), start: int = 0) -> DataFrame:
    """``slot, shard, tokens`` (binary) from slot *start* on; shards before it are not opened."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("shard") >= start // layout.per_shard)
    rows = files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(
        _cut_shards(layout), "slot long, shard long, tokens binary"
    )
    return rows.where(F.col("slot") >= start)
