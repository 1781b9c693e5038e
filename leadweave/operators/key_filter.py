"""A Bloom filter over keys, built by Spark and tested in the scan of another table.

The filter drops rows before their wide columns are looked at, without a join and so without moving them. It lets a
few rows through that have no key among those asked for (about one in fifty until the filter is full); whoever
needs exact rows joins what is left, in narrow form.

A key has its marks in one word of 64 bits, so a test is one look-up and one comparison. Words are set by an aggregate that
combines before the shuffle, then gathered in two steps, so no task holds more than one chunk of single words. The
filter's size is bounded by ``MOST_BITS``: beyond the keys that fit it lets more rows through, never fewer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY, MARKS = 16, 4
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 28
_CHUNK = 12  # a chunk has so many words, as a power of two


def _marks(key: Column) -> Column:
    """Bits of a word, as a number; each is named by six bits of the hash."""
    h = F.xxhash64(F.lit(1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(MARKS)]
    return reduce(Column.bitwiseOR, bits)


class KeyFilter:
    """Which values may be among the keys; build it with :func:`key_filter`."""

    def __init__(self, chunks: DataFrame, words: int):
        self.chunks, self.words = chunks, words

    def may_hold(self, key: Column) -> Column:
        """True for every key, and for few other values; false for null."""
        word = F.pmod(F.xxhash64(key), F.lit(self.words)).cast("int")
        chunk = F.get(self.chunks.scalar(), F.shiftright(word, _CHUNK))
        marks = _marks(key)
        held = F.get(chunk, word.bitwiseAND(F.lit((1 << _CHUNK) - 1))).bitwiseAND(marks) == marks
        return F.coalesce(held & key.isNotNull(), F.lit(False))


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of the only column of *keys*, which is read twice."""
    key = F.col(keys.columns[0])
    keys = keys.where(key.isNotNull())
    bits = min(max(LEAST_BITS, 1 << (keys.count() * BITS_PER_KEY - 1).bit_length()), MOST_BITS)
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(bits // 64)).alias("word"), _marks(key).alias("marks"))
    # Words without a key must be there too, so that a word's number is its place.
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("marks"))
    words = marked.unionByName(blank).groupBy("word").agg(F.bit_or("marks").alias("marks"))
    in_order = lambda rows, value: F.transform(F.sort_array(F.collect_list(rows)), lambda r: r[value])
    chunks = words.groupBy(F.shiftright("word", _CHUNK).alias("chunk")).agg(in_order(F.struct("word", "marks"), "marks").alias("words"))
    return KeyFilter(chunks.agg(in_order(F.struct("chunk", "words"), "words").alias("chunks")), bits // 64)
