import itertools
import random
import zlib
from collections import Counter

import numpy as np
import re
from pyspark.sql import functions as F

from leadweave.llm import spelling
from leadweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def _grouped(n):
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _found(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_pairs_of_one_edit(spark):
    drawn = random.Random(3)
    for letters in ("ab", "abcÿ"):
        words = {"".join(drawn.choices(letters, k=drawn.randint(5, 8))) for _ in range(150)}
        words |= {"aaaaa", "aaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "b" * 400, "b" * 401, "b" * 200 + "a" + "b" * 200}
        df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
        pairs = spelling.near_pairs(df).collect()
        found = [(r["word"], r["other"]) for r in pairs]
        assert len(found) == len(set(found))
        assert set(found) == {p for p in itertools.permutations(words, 2) if _near(*p)}


def test_pivots_are_disjoint_and_cheapest():
    drawn = random.Random(5)
    for _ in range(300):
        places = sorted(drawn.sample(range(9), drawn.randint(3, 7)))
        costs = [drawn.randint(0, 9) for _ in places]
        i, j = spelling.pivots(np.array(places), np.array(costs))
        assert places[j] - places[i] >= 2
        assert costs[i] + costs[j] == min(a + b for (p, a), (q, b) in itertools.combinations(zip(places, costs), 2) if q - p >= 2)


def test_stretches_hash_alike_wherever_they_lie():
    one, _ = spelling._codes(["xxabcdyy"])
    two, _ = spelling._codes(["q" * 50, "abcd"])
    a, b = spelling._Hashes(one), spelling._Hashes(two)
    assert a(np.array([2]), np.array([6])) == b(np.array([50]), np.array([54]))
    assert a(np.array([2]), np.array([6])) != a(np.array([3]), np.array([7]))


def test_groups_on_documents(spark):
    drawn = random.Random(7)
    base = ["".join(drawn.choices("aebéÀn", k=drawn.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = drawn.choices(base, weights=[1 + k * k for k in range(60)], k=40)
        words += [w[:1] + "x" + w[2:] for w in drawn.choices(base, k=8)]
        rows.append((i, " ".join(words)))
    rows += [(None, "Hotel hotel HOTEL motel motel motel"), (7, None), (8, ""), (9, "12 34"), (9, "hotel," * 20_000 + "X" * 300_000), (9, "hotel")]
    # Repeated rows count each; a chain of forms and a tie between two of them.
    rows += [(10, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "abcxf " * 40)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "run", "key", "other", "lang")})
    assert _found(spelling.variants(df)) == _grouped(_words(rows))


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a bc def")]):
        assert spelling.variants(spark.createDataFrame(rows, SCHEMA)).count() == 0
    # One word alone has no near word and is its own root.
    alone = _found(spelling.grouped(spark.createDataFrame([("lonely", 4)], "word string, n long")))
    assert alone == {("lonely", None, "lonely", 4, 0, None)}


def test_the_query_against_counting(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    n = _words(rows)
    found = _found(QUERIES["op12_spelling_variants"](spark, folder))
    assert {(r[0], r[3]) for r in found} == set(n.items())
    some = dict(random.Random(1).sample(sorted(n.items()), 60))
    near = {w: [v for v in n if _near(w, v)] for w in some}
    assert {r[0]: r[4] for r in found if r[0] in some} == {w: len(v) for w, v in near.items()}
