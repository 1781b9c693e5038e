"""Embedding near-duplicates by tiles of vectors whose dimensions are in PCA order.

Vectors are only compared if their labels are equal. Equal vectors are folded first. The rest are
sorted by their leading principal coordinate over all partitions and cut into tiles of bounded size; two
tiles meet only if their ranges of that coordinate are close enough for the cosine to be reached. For a
pair of tiles, products are summed over leading dimensions first. What the other dimensions can
still add is at most the product of the norms of the two suffixes, so pairs drop out as soon as even that
is not enough; what is left is checked by the exact cosine of the given vectors in double precision.

A pair of tiles hands on, for each vector, its number of links and one link of a spanning forest, not all
pairs: at most one row per vector of the two tiles, however many links there are.

Defined cases: vectors that are null, zero, without label or id, or that hold null or non-finite
components link with nothing (no links, a component of their own, kept; without id: component null, not kept). Vectors of different lengths never link. Repeated
rows are vectors of their own that link with each other; the smallest id of a component is kept. An empty
table gives no rows. Only ``vec_id, embedding, label`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadweave.llm.graph import components, least_reachable
from leadweave.session import settle

TILE = 1024
# Rounding of products of unit vectors is far below this; the exact check follows.
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64, copy=False)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(0), dim))
                total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["moments"])

    return rows


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The axes (columns) of all ``vector`` rows of length *dim*, by falling variance.

    Second moments are summed in Spark; the driver gets ``dim * dim`` numbers.
    """
    partial = vectors.where(F.size("vector") == dim).select("vector").mapInArrow(_moments(dim), "moments array<double>")
    summed = partial.select(F.posexplode("moments").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros(dim * dim)
    for row in summed:
        moments[row["at"]] = row["x"]
    _, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return axes[:, ::-1].copy()


def _cut_tiles(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["label", "dim", "lo", "hi", "ids", "counts", "vectors"]

    def tile(label: int, dim: int, rows: list[tuple]) -> pa.RecordBatch:
        _, _, lead, ids, counts, vectors = zip(*rows)
        blob = lambda values, kind: pa.array([np.asarray(values, kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array([label], pa.int64()), pa.array([dim], pa.int32()), pa.array([lead[0]]), pa.array([lead[-1]]),
            blob(ids, "<i8"), blob(counts, "<i8"), blob(vectors, "<f8"),
        ], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if rows and (len(rows) == size or rows[0][:2] != row[:2]):
                    yield tile(*rows[0][:2], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield tile(*rows[0][:2], rows)

    return cut


def _close(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors in PCA order whose product may reach *least*."""
    dim = a.shape[1]
    cuts = sorted({min(c, dim) for c in (8, 16, 32, 64, 128, 256, 512)} | {dim})
    suffix = lambda x, c: np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0))
    done, first = 0, cuts[0]
    products = a[:, :first] @ b[:, :first].T
    i, j = np.nonzero(products + np.outer(suffix(a, first), suffix(b, first)) >= least - _SLACK)
    part, done = products[i, j], first
    for cut in cuts[1:]:
        if not len(i):
            break
        part = part + np.einsum("nd,nd->n", a[i, done:cut], b[j, done:cut])
        stay = part + suffix(a, cut)[i] * suffix(b, cut)[j] >= least - _SLACK
        i, j, part, done = i[stay], j[stay], part[stay], cut
    return i, j


def _compare(threshold: float, axes: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(ids: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        linked = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
        mate = least_reachable(len(ids), i, j)
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(linked[some].astype(np.int64)), pa.array(ids[mate[some]])], ["a", "links", "b"]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for row in range(batch.num_rows):
                dim, same = columns["dim"][row].as_py(), columns["same"][row].as_py()
                read = lambda c, kind: np.frombuffer(columns[c][row].as_buffer(), kind)  # noqa: B023, E731
                x, y = read("x_vectors", "<f8").reshape(-1, dim), read("y_vectors", "<f8").reshape(-1, dim)
                extreme = any(not 1e-100 < m < 1e100 for v in (x, y) for m in (np.abs(v).max(axis=1).min(), np.abs(v).max()))
                turn = axes.get(dim)
                a, b = _unit(x), _unit(y)
                a, b = (a, b) if turn is None else (a @ turn, b @ turn)
                i, j = _close(a, b, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                keep = [np.empty(0, bool)]
                for s in range(0, len(i), 1 << 14):
                    p, q = x[i[s:s + (1 << 14)]], y[j[s:s + (1 << 14)]]
                    p, q = (v / np.abs(v).max(axis=1, keepdims=True) for v in (p, q)) if extreme else (p, q)
                    cosine = np.einsum("nd,nd->n", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
                    keep.append(cosine >= threshold)
                near = np.concatenate(keep)
                i, j = i[near], j[near]
                ids, counts = read("x_ids", "<i8"), read("x_counts", "<i8")
                if not same:
                    ids, counts = np.r_[ids, read("y_ids", "<i8")], np.r_[counts, read("y_counts", "<i8")]
                    j = j + len(x)
                yield links(ids, counts, i, j)

    return rows


def _leading(axes: dict[int, np.ndarray]) -> Callable[[Column], Column]:
    """The coordinate of unit vectors along the first axis of their length, or the first one without axes."""

    @F.arrow_udf("double")
    def lead(batch: pa.Array) -> pa.Array:
        found = np.zeros(len(batch))
        sizes = batch.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            unit = _unit(_matrix(batch.take(pa.array(rows)), dim))
            found[rows] = unit @ axes[dim][:, 0] if dim in axes else unit[:, 0]
        return pa.array(found)

    return lead


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    vectors = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    takes_part = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = vectors.where(takes_part)
    folded = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = settle(folded.withColumn("id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    dims = classes.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    axes = {dims["dim"]: principal_axes(classes, dims["dim"])} if dims else {}

    placed = classes.select(
        F.col("label").cast("long").alias("label"), F.size("vector").alias("dim"), _leading(axes)("vector").alias("lead"),
        "id", "n", "vector",
    )
    ordered = placed.repartitionByRange("label", "dim", "lead", "id").sortWithinPartitions("label", "dim", "lead", "id")
    tiles = settle(ordered.mapInArrow(
        _cut_tiles(tile),
        "label long, dim int, lo double, hi double, ids binary, counts binary, vectors binary",
    ).withColumn("tile", F.monotonically_increasing_id()))

    # Unit vectors of that cosine differ by at most this in any one coordinate.
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + _SLACK
    ranges = tiles.select("label", "dim", "tile", "lo", "hi")
    other = ranges.select("label", "dim", F.col("tile").alias("y_tile"), F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"))
    met = ranges.join(other, ["label", "dim"]).where(
        (F.col("tile") <= F.col("y_tile")) & (F.col("y_lo") <= F.col("hi") + reach) & (F.col("lo") <= F.col("y_hi") + reach)
    ).select(F.col("tile").alias("x_tile"), "y_tile")
    side = lambda s: tiles.select(
        F.col("tile").alias(f"{s}_tile"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "counts", "vectors")]
    )
    pairs = met.join(side("x"), "x_tile").join(side("y").join(tiles.select(F.col("tile").alias("y_tile"), "dim"), "y_tile"), "y_tile")
    pairs = pairs.withColumn("same", F.col("x_tile") == F.col("y_tile")).drop("x_tile", "y_tile")
    links = settle(pairs.mapInArrow(_compare(threshold, axes), "a long, links long, b long"))

    counted = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "id")
    placed = classes.select("id", "label", "vector", "first", "n").join(counted, "id", "left").join(roots, "id", "left")
    placed = settle(placed.withColumn("root", F.coalesce("root", "id")))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    named = placed.join(least, "root").select(
        "label", "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    found = good.join(named, ["label", "vector"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = vectors.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
