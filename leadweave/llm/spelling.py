"""Spelling variants: words one edit apart, found through pivotal bigrams.

Bigrams are ordered by the number of words that hold them, rare ones first. The prefix of a word is its three
rarest bigrams, and whatever ties with the third. Its pivots are two of these that share no character, chosen by
dynamic programming so that together they are held by the fewest words. One edit can destroy one pivot only, so of
two words one edit apart, the one whose prefix ends first has a pivot that is in the other's prefix. Pivots are
posted against the prefixes of the other words.

Position limits: a pivot that survives has the edit on one side of it, so the word agrees from the pivot to
its other end. An edit right of the first pivot leaves all up to that pivot in place, any other one leaves all from
the second pivot on. So the first pivot is posted with the text before it and the second with the text after it. Of
what is left, half is in place too, and that half and the length of the shorter word join the key. This holds for a bigram
that a third of all words have, too: words meet only if they agree in all but half of what lies on one
side of a pivot. Keys are 64-bit hashes; every pair that meets is verified on its characters.

There are few distinct bigrams, at most the square of the alphabet's size, so their order is sent to all tasks.

Defined cases: a null text has no words, texts are read whole, repeated rows count each, a row without id counts
with an empty id in the checksum; an empty table gives no words. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.llm.common import whole_text
from leadweave.session import discard, settle

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, DAMAGE = 5, 3, 97
_WORDS_AT_ONCE = 4096


# --- words ----------------------------------------------------------------------------------------


def damaged(run: Column, doc_id: Column, every: int = DAMAGE) -> Column:
    """The run, less one character where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def counted_words(
    documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DAMAGE
) -> DataFrame:
    """``word, n``: the words long and frequent enough. Counts combine before the shuffle."""
    lower = F.translate(whole_text(), string.ascii_uppercase, string.ascii_lowercase)
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), 0)).alias("run"))
    # A run is at most one character longer than its word.
    runs = runs.where(F.length("run") >= least_length)
    words = runs.select(damaged(F.col("run"), F.col("doc_id"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- pivots and prefixes --------------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each word starts (one more at the end)."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]


def pivots(places: np.ndarray, costs: np.ndarray) -> tuple[int, int]:
    """Two of the rising *places* that are two or more apart, of least total cost.

    One pass: at each place the cheapest earlier one that does not touch it is known.
    """
    best, chosen, cheapest, ready = None, (0, 0), -1, 0
    for j in range(len(places)):
        while places[ready] <= places[j] - 2:
            if cheapest < 0 or costs[ready] < costs[cheapest]:
                cheapest = ready
            ready += 1
        if cheapest >= 0 and (best is None or costs[cheapest] + costs[j] < best):
            best, chosen = costs[cheapest] + costs[j], (cheapest, j)
    return chosen


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class _Hashes:
    """Polynomial hashes, modulo 2^64, of any stretch of a row of characters, wherever it lies."""

    def __init__(self, data: np.ndarray):
        spread = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.r_[np.uint64(0), np.cumsum((spread ^ spread >> np.uint64(31)) * _powers(_BASE, len(data))[:-1])]
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(data))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _keys(hashes: _Hashes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, left: bool) -> np.ndarray:
    """Four keys for each bigram at *at* of the word ``starts .. ends``; see the module's text.

    *left*: the text up to the bigram is in place and the rest is what was edited; else the other way round.
    """
    same = hashes(starts, at + 2) if left else hashes(at, ends)
    rest = ends - at - 2 if left else at - starts
    first = at + 2 if left else starts
    out = []
    for shorter in (rest - 1, rest):  # of the two rests, the other one's may be shorter
        half = np.maximum(shorter, 0) // 2
        out.append(_mixed(same, np.full(len(at), 2 + left), shorter, hashes(first, first + half)))
        back = np.maximum(shorter, 0) - half
        out.append(_mixed(same, np.full(len(at), 4 + left), shorter, hashes(first + rest - back, first + rest)))
    return np.stack(out, axis=1)


def _postings(order: np.ndarray, alphabet: np.ndarray):
    """The postings of ``word, n``: of its pivots (``pivot``) and of its whole prefix.

    ``order[i, j]`` is the number of words that hold the bigram of the characters i and j of *alphabet*.
    """

    def of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, bounds = _codes(words)
        letters = np.searchsorted(alphabet, data)
        gram = letters[:-1] * len(alphabet) + letters[1:]
        # Ties in frequency are broken by the bigram itself.
        rank = order[letters[:-1], letters[1:]] * len(alphabet) ** 2 + gram
        prefixes, chosen = [], []
        for i, start in enumerate(bounds[:-1].tolist()):
            own = rank[start:bounds[i + 1] - 1]
            places = np.flatnonzero(own <= np.partition(own, 2)[2])
            pair = pivots(places.tolist(), own[places].tolist())
            prefixes.append(places + start)
            chosen.append((prefixes[-1][pair[0]], prefixes[-1][pair[1]]))
        hashes = _Hashes(data)
        starts, ends = bounds[:-1], bounds[1:]
        sizes = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        row, at = np.repeat(np.arange(len(words)), sizes), np.concatenate(prefixes)
        first, second = np.array(chosen).T
        keys = [
            _keys(hashes, starts, ends, first, True), _keys(hashes, starts, ends, second, False),
            _keys(hashes, starts[row], ends[row], at, True), _keys(hashes, starts[row], ends[row], at, False),
        ]
        every = np.arange(len(words))
        rows = np.concatenate([np.repeat(r, 4) for r in (every, every, row, row)])
        return np.concatenate([k.ravel() for k in keys]), rows, np.arange(len(rows)) < 8 * len(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _WORDS_AT_ONCE):
                part = batch.slice(at, _WORDS_AT_ONCE)
                key, row, pivot = of(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(pivot), *[c.take(pa.array(row)) for c in part.columns]], ["key", "pivot", "word", "n"]
                )

    return rows


def bigram_counts(words: DataFrame) -> DataFrame:
    """``gram, held``: by how many words each bigram is held; as many rows as the alphabet has pairs."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.substring("word", i, F.lit(2))))
    return words.where(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of words exactly one edit apart, both ways round.

    *words* are ``word, n``, each word once and of five characters or more; it is read twice.
    """
    held = {row["gram"]: row["held"] for row in bigram_counts(words).collect()}
    alphabet = np.array(sorted({ord(c) for gram in held for c in gram}), np.uint32)
    order = np.zeros((len(alphabet),) * 2, np.int64)
    for gram, n in held.items():
        i, j = np.searchsorted(alphabet, [ord(c) for c in gram])
        order[i, j] = n
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = words.select("word", "n").repartition(parts, "word").mapInArrow(
        _postings(order, alphabet), "key long, pivot boolean, word string, n long"
    )
    posted = settle(posted)
    mine = posted.where("pivot").select("key", "word", "n")
    other = posted.where("not pivot").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = mine.join(other, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    turned = met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # One shuffle by word serves the distinct pairs and whatever is summed up by word.
    return met.drop("key").unionByName(turned).repartition("word").distinct()


# --- groups ---------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, doubling the step each round; a form has twice the count, so chains are short."""
    far = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not far.where("moved").isEmpty():
        step = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root, moved = F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        before, far = far, settle(far.select("word", "root").join(step, "root", "left").select("word", root, moved))
        discard(before)
    return far.select("word", "root")


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word, n``.

    The form is the near word of the largest count (ties: the smallest word), if that is *ratio* times the
    word's own or more; the root is the last of the forms of forms.
    """
    words = settle(words)
    near = near_pairs(words).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    near = settle(near.select("word", "n_near", form.alias("to")).select("word", "n_near", "to.form", "to.form_n"))
    roots = _roots(near.where("form is not null"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def variants(documents: DataFrame) -> DataFrame:
    """The words of ``doc_id, text`` and their groups, see :func:`counted_words` and :func:`grouped`."""
    return grouped(counted_words(documents))
