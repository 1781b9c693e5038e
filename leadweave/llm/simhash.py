"""SimHash near-duplicates: pigeonhole blocks find all fingerprints that differ in a few bits.

A fingerprint is cut into blocks. Two that differ in at most ``distance`` bits differ in at most that many
blocks, so they agree on some choice of the other blocks. Each fingerprint is posted under every such
choice, equal postings meet in a bucket, and the Hamming distance of all pairs in it is checked. Equal
fingerprints are folded first, so a group of copies of any size is one posting. A bucket hands on links
that connect what is close in it, not all of its pairs.

Defined cases: a null text is empty; a text without words has the fingerprint zero and is linked like any
other; fewer words than a shingle has are one shingle; texts are read whole. A row without id takes part,
but names no component unless all rows of it lack one (then null). Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from leadweave.llm.graph import components, least_reachable
from leadweave.session import settle

_SEED = 42
_SHINGLES_AT_ONCE = 1 << 16
TILE = 1024


def _hashes(text: str, width: int) -> Iterator[int]:
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if len(words) <= width:
        return iter([xxh64_intdigest(b" ".join(words), _SEED)] if words else [])
    shingles = zip(*[words[i:] for i in range(width)])
    return (xxh64_intdigest(b" ".join(s), _SEED) for s in shingles)


def _fingerprint(text: str, width: int) -> int:
    """The bits set in over half of the shingles' hashes, repeats counted."""
    hashes = np.fromiter(_hashes(text, width), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = hashes[start:start + _SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64 bits as a long, bit 63 being its sign."""

    @F.arrow_udf("long")
    def bits(batch: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(t.as_py() or "", width) for t in batch], pa.int64())

    return bits(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _masks(blocks: int, distance: int) -> list[int]:
    """One mask of 64 bits for every choice of ``blocks - distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(choice) - (1 << 64) * (sum(choice) >> 63) for choice in combinations(parts, blocks - distance)]


def _tile_links(distance: int):
    """Links that connect all fingerprints of two tiles that are close; one tree per component, not all pairs."""

    def links(mine: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        both = mine if other is None else np.r_[mine, other]
        i, j = [], []
        for start in range(0, len(mine), 256):
            apart = np.bitwise_count(mine[start:start + 256, None] ^ both[None, :])
            near = np.nonzero(apart <= distance)
            i.append(near[0] + start)
            j.append(near[1])
        root = least_reachable(len(both), np.concatenate(i), np.concatenate(j))
        some = np.flatnonzero(root != np.arange(len(both)))
        return both[some], both[root[some]]

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def linked(mine: pa.Array, other: pa.Array) -> pa.Array:
        # Row by row and as plain arrays: a batch may hold many tiles.
        read = lambda v: v.values.to_numpy() if v.is_valid else None
        rows = [links(read(m), read(o)) for m, o in zip(mine, other)]
        offsets = np.cumsum([0, *[len(a) for a, _ in rows]]).astype(np.int32)
        ends = [pa.array(np.concatenate([r[i] for r in rows] or [np.empty(0, np.int64)])) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(ends, ["a", "b"]))

    return linked


def close_links(fingerprints: DataFrame, distance: int = 2, blocks: int = 5, tile: int = TILE) -> DataFrame:
    """``a, b``: links that connect the distinct longs ``fingerprint`` that differ in at most *distance* bits.

    A bucket (the fingerprints that agree on one choice of blocks) of more than *tile* members is cut into
    tiles that are compared pair by pair, so no task holds more than two tiles, whatever the bucket's size.
    """
    masks = _masks(blocks, distance)
    # A table of numbers is few splits; as many tasks as a shuffle has write the postings.
    dealt = fingerprints.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    posted = dealt.select(
        "fingerprint", F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseAND(F.col("fingerprint")))).alias("choice", "key")
    )
    bucket = ["choice", "key"]
    # Most buckets have one member only; they are gone before any list is made.
    shared = settle(posted.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"))
    large = F.col("n") > tile
    cut = F.when(large, F.pmod(F.xxhash64("fingerprint"), F.ceil(2 * F.col("n") / tile))).otherwise(F.lit(0).cast("long"))
    tiled = posted.join(shared, bucket).select(*bucket, cut.alias("tile"), large.alias("large"), "fingerprint")
    tiles = tiled.groupBy(*bucket, "tile", "large").agg(F.collect_list("fingerprint").alias("members"))
    tiles = settle(tiles)
    link, none = _tile_links(distance), F.lit(None).cast("array<long>")
    inside = tiles.select(F.explode(link("members", none)).alias("link"))
    some = tiles.where("large").select(*bucket, "tile", "members")
    other = some.withColumnsRenamed({"tile": "other_tile", "members": "other"})
    across = some.join(other, bucket).where("tile < other_tile").select(F.explode(link("members", "other")).alias("link"))
    return inside.unionByName(across).select("link.*")


def classes(documents: DataFrame, width: int = 3, distance: int = 2, blocks: int = 5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns *keys* of every row, its ``fingerprint`` and ``root``, a fingerprint that names its component."""
    marked = settle(documents.select(*keys, fingerprint(F.col("text"), width).alias("fingerprint")))
    links = close_links(marked.select("fingerprint").distinct(), distance, blocks)
    roots = components(links).withColumnRenamed("node", "fingerprint")
    return marked.join(roots, "fingerprint", "left").select(*keys, "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(documents: DataFrame, width: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document.

    *fingerprint* is a long; ``component_id`` the least ``doc_id`` reachable over links.
    """
    marked = settle(documents.select("doc_id", fingerprint(F.col("text"), width).alias("fingerprint")))
    folded = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(close_links(folded.select("fingerprint"), distance, blocks)).withColumnRenamed("node", "fingerprint")
    placed = settle(folded.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(documents: DataFrame, columns: tuple[str, ...], width: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """The *columns* of the rows that stay if one row of each component does.

    That is the row with the least ``doc_id``; of different rows with that id the one with the least hash, of
    equal ones any. Rows with one id and different texts are decided each for itself. Rows without id all
    stay, and no other row goes for their sake.
    """
    rows = documents.select(*columns, F.xxhash64(*columns).alias("row"))
    named = rows.where("doc_id is not null")
    found = classes(named, width, distance, blocks, ("doc_id", "row"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.*")
    stay = named.join(first, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return stay.unionByName(rows.where("doc_id is null")).select(*columns)
