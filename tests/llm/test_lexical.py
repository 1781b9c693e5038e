import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leadweave.llm import lexical
from leadweave.llm.queries import QUERIES

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(scored[:k], 1)]
    return Counter(out)


def _found(df):
    return Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect())


def _rows(seed, docs=300, items=20):
    drawn = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "été", "日本", "x_y", "a-b", "naïve", "ÀB"]
    weights = [1 / (1 + i) for i in range(len(words))]
    made = [(i, " ".join(drawn.choices(words, weights, k=drawn.choice((1, 3, 20, 90, 400))))) for i in range(docs)]
    asked = [(i, " ".join(drawn.choices(words, k=drawn.choice((1, 4, 12))))) for i in range(items)]
    return made, asked


def test_ranks_equal_plain_scoring(spark):
    docs, items = _rows(1)
    docs += [(400, None), (401, ""), (402, "... --- \x7f"), (None, "w3 w3 w70"), (None, "w3 w3 w70"), (403, "w1 W2 " * 60_000)]
    docs += [(404 + i, "w60 w61 tie") for i in range(14)] + [(404, "w60 w61 tie"), (500, "tie")]  # ties, a repeated row
    items += [(90, None), (91, ""), (92, "absent words"), (93, "TIE w60"), (94, "w5"), (94, "w6 w5"), (None, "w7"), (None, "w8"), (95, "w1 " * 3000)]
    clash = {c: F.lit("x") for c in ("item_id", "number", "terms", "term", "score", "rank", "items", "bits")}
    left = spark.createDataFrame(docs, DOCS).repartition(3).withColumns(clash)
    right = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("doc_id", "term", "score", "weight", "number")})
    want = _brute(docs, items)
    assert _found(lexical.ranked(left, right)) == want
    assert _found(lexical.ranked(left, right, per_block=4)) == want
    assert _found(lexical.ranked(left, right, k=2)) == _brute(docs, items, 2)


def test_portions_of_queries(spark, monkeypatch):
    docs, items = _rows(2)
    monkeypatch.setattr(lexical, "_BROADCAST_BYTES", 100)
    found = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), per_block=3)
    assert _found(found) == _brute(docs, items)


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    none_docs, none_items = docs.limit(0), items.limit(0)
    for left, right in ((none_docs, items), (docs, none_items), (none_docs, none_items), (docs, items.withColumn("text", F.lit("z")))):
        out = lexical.ranked(left, right)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    # The only document has every term: its weight is floor(1000 ln(4/3)), and the score is above zero.
    assert _found(lexical.ranked(docs, items)) == _brute([(1, "a b")], [(1, "a")])


def _block_rows(docs):
    for batch in lexical._blocks(docs):
        row = {c: batch.column(c)[0] for c in batch.schema.names}
        named = {c: row[c].values for c in ("doc_ids", "sizes", "terms", "ends")}
        yield named | {c: row[c].as_buffer() for c in ("slices", "numbers", "counts")} | {"bits": row["bits"].as_py()}


def test_bounds_are_never_below_scores_and_rule_most_documents_out(monkeypatch):
    docs, items = _rows(3, docs=1500)
    rescored, seen = 0, 0
    plain = lexical.Block._scores

    def counted(self, rows, query):
        nonlocal rescored
        rescored += len(rows)
        return plain(self, rows, query)

    monkeypatch.setattr(lexical.Block, "_scores", counted)
    asked = [{"item_id": i, "term": sorted(set(_terms(t))), "weight": [100 + 7 * len(x) for x in sorted(set(_terms(t)))]} for i, t in items]
    terms, hashes, queries = lexical._queries(asked)
    floors = {}
    for row in _block_rows(docs):
        block = lexical.Block(row, 1500, 100_000)
        found = block.search(terms, hashes, queries, 10, floors)
        seen += len(queries) * len(row["doc_ids"])
        for query, (_, scores) in zip(queries, found):
            if len(scores) == 10:
                floors[query.item] = max(floors.get(query.item, 0), int(scores[-1]))
    assert 0 < rescored < seen / 2
    monkeypatch.undo()
    for row in _block_rows(docs):
        block = lexical.Block(row, 1500, 100_000)
        block.search(terms, hashes, queries, 10, {})
        for query in queries:
            exact = block._scores(np.arange(len(row["doc_ids"])), query)
            assert (block.bounds(hashes[query.terms], query.weights) >= exact).all()


def test_filters_of_limited_size_stay_correct(monkeypatch):
    docs, items = _rows(4, docs=200)
    monkeypatch.setattr(lexical, "MOST_BITS", 64)
    asked = [{"item_id": i, "term": sorted(set(_terms(t))), "weight": [50] * len(set(_terms(t)))} for i, t in items]
    terms, hashes, queries = lexical._queries(asked)
    for row in _block_rows(docs):
        assert row["bits"] == 64
        block = lexical.Block(row, 200, 9000)
        found = block.search(terms, hashes, queries, 10, {})
        for query, (rows, scores) in zip(queries, found):
            exact = block._scores(np.arange(len(row["doc_ids"])), query)
            assert scores.tolist() == sorted(exact[exact > 0].tolist(), reverse=True)[:10]
            assert exact[rows].tolist() == scores.tolist()


def test_the_query_against_plain_scoring(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()]
        for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    assert _found(QUERIES["op13_lexical_search"](spark, folder)) == _brute(docs, items)
