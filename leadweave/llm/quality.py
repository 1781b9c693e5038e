"""Quality classifier: ridge regression on random Fourier features of document statistics.

A document becomes a short list of statistics of its whole text. Random cosines of their standardised
values approximate a Gaussian kernel, in which ridge regression is a linear problem: the normal equations
are sums over rows, so every partition adds up its own and Spark sums those, kept apart by fold. The
equations without a fold give scores for that fold's rows that have not seen their labels; pooled into
adjacent bins until they rise, these calibrate the score to a share of good documents (isotonic
regression).

The fit uses labelled rows that are not held out, ``most_rows`` of them at most (by hash of the id); all
else covers all rows. Nothing but the text is an input of a score.

Defined cases: a null text is empty, and empty texts are scored like any other; texts are read whole; null
labels and labels of unknown documents are left out; a document with several labels counts for each; a
row without id is not held out and learns nothing; with no usable label all scores are 0.5. Repeated rows
each get a score. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.session import settle

STATISTICS = (
    "words", "word_length", "upper", "digit", "mark", "symbol", "shout", "beyond_ascii", "distinct", "echo", "commonest",
    "letterless", "upper_word", "symbol_end", "line_length", "repeated_line", "sentence_length", "poorest_stretch",
)
FEATURES, FOLDS, BINS, SEED = 256, 4, 400, 11
_BATCHES = 8  # partitions of the fit, whose rows are bounded

_KIND = np.zeros(256, np.int64)  # 0 other, then one class for each entry
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()?-", b"$%&*#|<>{}[]~^_=+\\@/", b"!", bytes(range(128, 256))), 1):
    _KIND[list(_set)] = _i
_STRETCH = 64


def _statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8) if data else np.zeros(8)
    n = max(len(data), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = [line for line in text.split("\n") if line]
    counts = Counter(words)
    echo = sum(map(str.__eq__, words, words[1:]))
    letterless = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    ends = sum(c for w, c in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    stretches = [len(set(words[i:i + _STRETCH])) / _STRETCH for i in range(0, len(words) - _STRETCH + 1, _STRETCH)]
    share = lambda part, whole: float(np.sqrt(part / max(whole, 1)))  # noqa: E731  small shares matter
    return [
        float(np.log1p(len(words))), float(np.log1p(len(data) / m)),
        share(kinds[1], kinds[1] + kinds[2]), share(kinds[3], n), share(kinds[4], n), share(kinds[5], n), share(kinds[6], n),
        share(kinds[7], n), len(counts) / m, share(echo, m), share(max(counts.values(), default=0), m), share(letterless, m),
        share(upper, m), share(ends, m), float(np.log1p(m / max(len(lines), 1))),
        share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(m / (text.count(". ") + text.count(".\n") + 1))),
        min(stretches, default=len(counts) / m),
    ]


def statistics(text: Column) -> Column:
    """The values of ``STATISTICS`` for each text."""

    @F.arrow_udf("array<double>")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([_statistics(t.as_py() or "") for t in batch], pa.list_(pa.float64()))

    return of(text)


@dataclass(frozen=True)
class Cosines:
    """Random cosines of standardised statistics, and a constant."""

    centre: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray

    @classmethod
    def drawn(cls, centre: np.ndarray, scale: np.ndarray, features: int, seed: int) -> Cosines:
        drawn = np.random.default_rng(seed)
        width = len(centre)
        return cls(centre, scale, drawn.standard_normal((width, features)) / np.sqrt(width), drawn.uniform(0, 2 * np.pi, features))

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.centre) / self.scale, -6, 6)
        waves = np.cos(x @ self.turns + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.hstack([waves, np.ones((len(x), 1))])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equations(cosines: Cosines, folds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums ``[Z'Z | Z'y]`` of each fold of a partition's rows ``x, y, fold``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(cosines.shifts) + 1
        sums = np.zeros((folds, size, size + 1))
        for batch in batches:
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(fold):
                z = cosines(_rows(batch.column(0).filter(pa.array(fold == k))))
                sums[k] += z.T @ np.column_stack([z, y[fold == k]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(folds), pa.int32()), pa.array([s.ravel() for s in sums], pa.list_(pa.float64()))], ["fold", "sums"]
        )

    return rows


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for fold, sums in zip(batch.column(0).to_pylist(), _rows(batch.column(1)) if batch.num_rows else []):
            total[fold] = total.get(fold, 0) + sums
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["fold", "sums"]
    )


def _solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    left, right = sums[:, :-1], sums[:, -1]
    penalty = ridge * np.eye(len(left))
    penalty[-1, -1] = 1e-9  # the constant is free
    return np.linalg.solve(left + penalty, right)


def isotonic(score: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours (sorted by *score*) until shares rise; returns the centres and shares of the pools."""
    pools: list[list[float]] = []
    for s, y, w in zip(score, share, weight):
        pools.append([s * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


@dataclass(frozen=True)
class Model:
    cosines: Cosines
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def score(self, statistics: Column) -> Column:
        @F.arrow_udf("double")
        def scored(batch: pa.Array) -> pa.Array:
            if not len(batch):
                return pa.array([], pa.float64())
            raw = self.cosines(_rows(batch)) @ self.weights
            return pa.array(np.clip(np.interp(raw, self.knots, self.shares), 0, 1))

        return scored(statistics)


def fit(labelled: DataFrame, most_rows: int = 200_000, features: int = FEATURES, ridge: float = 1.0, seed: int = SEED) -> Model | None:
    """A model of ``doc_id, x (statistics), y (0 or 1)`` rows, or None without rows."""
    known = labelled.count()
    if not known:
        return None
    # A keyed hash of the id picks the rows and the folds; copies of an id stay together.
    drawn = F.xxhash64(F.lit(seed), "doc_id")
    share = min(1.0, most_rows / known)
    kept = labelled.where(F.pmod(drawn, F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else labelled
    rows = settle(kept.select("x", F.col("y").cast("double").alias("y"), F.pmod(F.shiftright(drawn, 20), F.lit(FOLDS)).cast("int").alias("fold")).repartition(_BATCHES))
    moments = rows.select(*[f(F.get("x", F.lit(i))) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return None
    centre, scale = np.array(moments[::2]), np.array(moments[1::2])
    cosines = Cosines.drawn(centre, np.where(scale > 1e-9, scale, 1.0), features, seed)
    parts = rows.mapInArrow(_equations(cosines, FOLDS), "fold int, sums array<double>")
    summed = parts.repartition(1).mapInArrow(_added, "fold int, sums array<double>").collect()
    size = features + 1
    sums = {row["fold"]: np.array(row["sums"]).reshape(size, size + 1) for row in summed}
    whole = sum(sums.values())
    blind = np.stack([_solved(whole - sums[k], ridge) for k in range(FOLDS)])

    @F.arrow_udf("double")
    def unseen(x: pa.Array, fold: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(np.einsum("nd,nd->n", cosines(_rows(x)), blind[fold.to_numpy()]))

    raw = rows.select("y", unseen("x", "fold").alias("raw"))
    binned = raw.groupBy(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).alias("bin")).agg(
        F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")
    ).orderBy("bin").collect()
    knots, shares = isotonic(*(np.array([float(row[c]) for row in binned]) for c in ("raw", "y", "n")))
    return Model(cosines, _solved(whole, ridge), knots, shares)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for checking: one in five, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame, **settings: object) -> DataFrame:
    """``doc_id, held_out, score``: one row per document."""
    known = settle(documents.select("doc_id", statistics(F.col("text")).alias("x")))
    marks = labels.select("doc_id", F.col("quality").alias("y")).where("y in (0, 1)")
    model = fit(known.where(~held_out(F.col("doc_id"))).join(marks, "doc_id"), **settings)
    score = F.lit(0.5) if model is None else model.score(F.col("x"))
    return known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))


def trained(documents: DataFrame, labels: DataFrame, **settings: object) -> Model | None:
    """The model alone, to be applied with ``model.score(statistics(text))``."""
    marks = labels.select("doc_id", F.col("quality").alias("y")).where("y in (0, 1)")
    # Statistics are taken where the text is read, so only they are shuffled.
    known = documents.where(~held_out(F.col("doc_id"))).select("doc_id", statistics(F.col("text")).alias("x"))
    return fit(settle(known.join(marks, "doc_id")), **settings)
