"""Exact top-k search by integer inner product, with MaxScore over shards.

Vectors are rounded to integers and cut into shards by hash; queries go in blocks. A term is a dimension with
a sign. What a query's term can add is bounded by the shard's extreme component. Terms are sorted by that
bound. Given the k-th best score known so far, the weakest terms whose bounds together stay below it are
non-essential: a vector that has no other term cannot get there. There are no posting lists: one dense
product scores every vector of the shard on the essential terms of a block of queries (half of the
dimensions while no floor is known), so the essential terms select no candidates; the bounds filter afterwards. Of
the vectors found the other terms are probed as long as the bounds that are left keep them competitive. The
best of each shard are merged at the end.

Defined cases: vectors that are null, have no id, or hold null or non-finite components take no part; of
rows with the same id the least vector counts; components beyond the length of the shorter vector count as
zero; an empty vector scores zero; ties go to the smaller id. Where scores could leave the range of doubles' whole
numbers they are computed in integers, and beyond that in integers of any length; a component or a result that does
not fit a long is an error, never a wrong number. Only ``vec_id, embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadweave.session import settle

SHARD, BLOCK = 8192, 256
_SEEDS_PER_RESULT, _PROBES = 4, 8


def integers(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component, or null if the vector takes no part."""
    double = vector.cast("array<double>")
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: x * F.lit(float(scale))
    fits = lambda x: F.abs(scaled(x)) < float(1 << 63)
    error = F.raise_error(F.lit("a component times the scale does not fit a long")).cast("long")
    return F.when(~bad, F.transform(double, lambda x: F.when(fits(x), F.floor(scaled(x)).cast("long")).otherwise(error)))


def _pack(dim: int) -> Callable[[pa.Table], pa.Table]:
    """One row per group: ids in rising order and the matrix, one row per vector."""

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        matrix = np.zeros((len(ids), dim), np.int64)
        for i, row in enumerate(table["ints"].to_pylist()):
            matrix[i, :len(row)] = row
        order = np.argsort(ids, kind="stable")
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not matrix.size or (
            np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max))
        return pa.table({
            "part": table["part"][:1], "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "kind": [kind], "matrix": pa.array([matrix[order].astype(kind).tobytes()], pa.binary()),
        })

    return packed


class Shard:
    """The vectors of a shard, and per term what it can add at most; :meth:`best` answers a block of queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.most, self.least = matrix.max(axis=0, initial=0), matrix.min(axis=0, initial=0)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the *k* best vectors but its *own*, ties to the smaller id.

        Those below *known*, a score that k vectors elsewhere reach, may be left out.
        """
        dim, n = queries.shape[1], len(self.ids)
        vectors, exact = self.matrix, queries
        largest = dim * max(-float(self.least.min()), float(self.most.max())) * float(np.abs(queries.astype(np.float64)).max(initial=0))
        if largest >= 1 << 62:
            return [self._best_of_any_length(q, i, k) for q, i in zip(queries, own)]
        if largest < 1 << 53:  # doubles are exact then, and faster
            vectors, exact = vectors.astype(np.float64), queries.astype(np.float64)
        bounds = np.maximum(exact * self.most, exact * self.least)
        order = np.argsort(-bounds, axis=1, kind="stable")
        # What the terms from each place on can add; the essential ones are those before it falls below the floor.
        rest = np.take_along_axis(bounds, order, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1]
        rest = np.hstack([rest, np.zeros((len(queries), 1), rest.dtype)])
        essential = np.where(known > 0, (rest >= known[:, None]).sum(axis=1), max(dim // 2, 1))
        essential = np.minimum(essential, dim)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(dim), order.shape), axis=1)
        # One dense product over the essential terms of all queries; a vector that has none of them gets at most zero.
        scores = np.where(rank < essential[:, None], exact, 0) @ vectors.T
        found = []
        for i in range(len(queries)):
            score, floor, done = scores[i], known[i], int(essential[i])
            if floor == -np.inf and n > _SEEDS_PER_RESULT * k:
                # The k-th best of some promising vectors is a score that results must reach.
                seeds = np.argpartition(-score, _SEEDS_PER_RESULT * k)[:_SEEDS_PER_RESULT * k]
                seeds = seeds[self.ids[seeds] != own[i]]
                floor = np.partition(vectors[seeds] @ exact[i], -k)[-k]
            at = np.flatnonzero((score + rest[i, done] >= floor) & (self.ids != own[i]))
            score = score[at]
            while done < dim and len(at):
                terms = order[i, done:done + _PROBES]
                score = score + vectors[at[:, None], terms] @ exact[i, terms]
                done += len(terms)
                stay = score + rest[i, done] >= floor
                at, score = at[stay], score[stay]
            top = np.lexsort((self.ids[at], -score))[:k]
            found.append((self.ids[at[top]], score[top].astype(np.int64)))
        return found


    def _best_of_any_length(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = (self.matrix.astype(object) @ query.astype(object)).tolist()
        at = sorted((i for i in range(len(self.ids)) if self.ids[i] != own), key=lambda i: (-scores[i], self.ids[i]))[:k]
        if any(abs(scores[i]) >= 1 << 63 for i in at):
            raise OverflowError("a score does not fit a long")
        return self.ids[at], np.array([scores[i] for i in at], np.int64)


def _search(dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"{side}_ids"], "<i8")
        return ids, np.frombuffer(row[f"{side}_matrix"], row[f"{side}_kind"]).astype(np.int64).reshape(len(ids), dim)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}  # per query the k-th best score of the shards so far
        for batch in batches:
            for row in batch.to_pylist():
                shard, (queries, wanted) = Shard(*unpack(row, "shard")), unpack(row, "block")
                floors = np.array([known.get(own, -np.inf) for own in queries.tolist()])
                found = shard.best(wanted, queries, k, floors)
                for own, (_, scores) in zip(queries.tolist(), found):
                    if len(scores) == k:
                        known[own] = max(known.get(own, -np.inf), float(scores[-1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(queries, [len(ids) for ids, _ in found])),
                    pa.array(np.concatenate([ids for ids, _ in found])),
                    pa.array(np.concatenate([scores for _, scores in found])),
                ], ["query_id", "vec_id", "score"])

    return rows


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the *k* best of all other vectors for each row that *is_query*.

    *is_query* is a condition on ``vec_id``. Queries and vectors meet block by shard, so what one task holds
    is bounded by the two sizes.
    """
    ints = embeddings.select("vec_id", integers(F.col("embedding"), scale).alias("ints")).where("vec_id is not null and ints is not null")
    vectors = settle(ints.groupBy("vec_id").agg(F.min("ints").alias("ints")).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    sizes = vectors.agg(F.count("*"), F.count_if("asks"), F.max(F.size("ints"))).first()
    dim = max(sizes[2] or 0, 1)

    def parts(rows: DataFrame, n: int, size: int, side: str) -> DataFrame:
        count = max(1, -(-n // size))
        cut = rows.select("vec_id", "ints", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("part"))
        packed = cut.groupBy("part").applyInArrow(_pack(dim), "part long, ids binary, kind string, matrix binary")
        return settle(packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]))

    shards = parts(vectors, sizes[0], shard, "shard")
    blocks = parts(vectors.where("asks"), sizes[1], block, "block")
    # Every block meets every shard once; the pairs are made of numbers only and then get their contents.
    last = max(1, -(-sizes[0] // shard)) - 1
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    meet = blocks.select("block_part", F.explode(numbers).alias("shard_part"))
    pairs = meet.join(shards, "shard_part").join(blocks, "block_part")
    found = pairs.mapInArrow(_search(dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
