"""Mixing, embedding dedup, top-k, the classifier and URL rules on small awkward inputs."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.llm import embed_dedup, mixing, quality, topk, url_rules
from leadweave.llm.queries import URL_RULES
from tests.llm import brute

# --- mixing ---------------------------------------------------------------------------------------


def corpus(spark, rows):
    rows = [(i, t, s, 1, 2, 3) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies int, key int")


def _mix_rows(seed=1, n=400):
    drawn = random.Random(seed)
    rows = [(i, "w " * drawn.randint(0, 60), drawn.choice(["a", "b", "c", "a", "a", "é", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (None, "x y z", "b"), (None, "x y z", "b"), (5, "x y", "a"), (5, "x y", "a")]


@pytest.mark.parametrize("budget,most", [(1.5, 2.0), (0.3, 2.0), (2.0, 2.0), (2.4, 3.0)])
def test_targets_and_taken_words(spark, budget, most):
    rows = _mix_rows()
    mixed = mixing.curriculum(corpus(spark, rows), budget=budget, most=most).collect()
    assert len(mixed) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = brute.targets(sizes, [mixing.integral(k) for k in mixing.SCHEDULES], budget, most)
    taken: dict = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        words = sum(c["words"] for c in r["copies"])
        assert words <= math.ceil(most) * r["size"]
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[r["source"]] += words
    for source, words in taken.items():
        assert words == round(want[source]) or abs(words - want[source]) <= 0.5


def test_weights_are_the_integrals():
    assert [mixing.integral(k) for k in mixing.SCHEDULES] == pytest.approx([3, 1, 2])


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 5, "a") for i in range(4000)]
    mixed = mixing.curriculum(corpus(spark, rows), schedules=[((0.0, 0.0), (0.5, 2.0), (1.0, 2.0))], budget=1.0)
    at = np.sort([c["position"] for r in mixed.collect() for c in r["copies"]])
    for t in (0.25, 0.5, 0.75):
        due = (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5)) / 1.5
        assert (at <= t).mean() == pytest.approx(due, abs=0.005)


def test_training_order_and_reruns(spark):
    docs = corpus(spark, _mix_rows())
    order = [(r["doc_id"], r["pass"], r["position"], r["words"]) for r in mixing.training_order(mixing.curriculum(docs)).collect()]
    assert [o[2] for o in order] == sorted(o[2] for o in order)
    again = mixing.training_order(mixing.curriculum(docs.repartition(7))).collect()
    assert sorted(map(str, order)) == sorted(str((r["doc_id"], r["pass"], r["position"], r["words"])) for r in again)


def test_mixed_documents_come_whole_and_as_often_as_taken(spark):
    rows = _mix_rows()
    docs = corpus(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts: dict = {}
    for r in out.collect():
        assert (r["doc_id"], r["text"], r["source"]) in rows
        key = r["doc_id"], r["text"], r["source"]
        counts[key] = counts.get(key, 0) + 1
    want: dict = {}
    texts = {(i, s, len(brute.words(t)), t) for i, t, s in rows}
    for r in mixing.curriculum(docs).collect():
        n = sum(2 * c["words"] >= r["size"] for c in r["copies"])
        keys = [(i, t, s) for i, s, size, t in texts if (i, s, size) == (r["doc_id"], r["source"], r["size"])]
        if n and len(keys) == 1:
            want[keys[0]] = want.get(keys[0], 0) + n
    assert want and all(counts[k] == n for k, n in want.items())


def test_nothing_to_mix(spark):
    assert mixing.curriculum(corpus(spark, [])).count() == 0
    assert mixing.mixed_documents(corpus(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.curriculum(corpus(spark, [(1, "", "a"), (2, None, None)])).collect()] == [[], []]


# --- embeddings -----------------------------------------------------------------------------------

BAD = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7]


def vectors(spark, rows):
    rows = [(i, e, y, "x", 0) for i, e, y in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, n int")


def _cloud(seed, n, dim=8):
    drawn = np.random.default_rng(seed)
    centres = drawn.standard_normal((6, dim))
    return [(i, (centres[i % 6] + drawn.standard_normal(dim) * drawn.choice([0.02, 0.2, 0.6])).tolist(), [1, 2, None][i % 3]) for i in range(n)]


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_and_components_equal_brute_force(spark, tile):
    rows = _cloud(3, 90)
    rows += [(100 + i, rows[0][1], 1) for i in range(5)] + [(200 + i, e, 1) for i, e in enumerate(BAD)]
    rows += [(300, [1.0, 2.0], 1), (301, [2.0, 4.0], 1), (302, [1e-200] * 8, 2), (303, [3e-200] * 8, 2), (304, [1e200] * 8, 2)]
    found = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, rows), 0.93, tile).collect()}
    good = {i: (e, y) for i, e, y in rows if y is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}

    def linked(a, b):
        if not (a in good and b in good and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])):
            return False
        scaled = [np.array(good[i][0]) / max(map(abs, good[i][0])) for i in (a, b)]
        return brute.cosine(*scaled) >= 0.93

    ids = [i for i, *_ in rows]
    want = brute.components(ids, linked)
    assert len(found) == len(ids)
    for i in ids:
        assert found[i]["component_id"] == want[i]
        assert found[i]["n_links"] == sum(linked(i, j) for j in ids if j != i)
        assert found[i]["kept"] == (want[i] == i)
    assert sum(r["n_links"] for r in found.values()) > 50


def test_embedding_rows_without_id(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(0, 0, None, False), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("shard,block", [(16, 4), (4096, 256)])
def test_top_k_equals_brute_force(spark, shard, block):
    rows = [(i, e, y) for i, e, y in _cloud(4, 150)]
    rows += [(200 + i, rows[20][1], 1) for i in range(25)] + [(300 + i, e, 1) for i, e in enumerate(BAD)]
    rows += [(340, [-1.0] * 8, 1), (360, [0.5, 0.25], 1), (380, [], 1), (None, [1.0] * 8, 1)]
    good = {i: e for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    padded = {i: [*e, *[0.0] * (8 - len(e))] for i, e in good.items()}
    got: dict = {}
    for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, 64, shard, block).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == {q: brute.best(padded, q, 20) for q in padded if q % 20 == 0}


def test_top_k_of_few_and_none(spark):
    few = [(i, [float(i), 1.0], 1) for i in range(5)] + [(0, [9.0, 9.0], 1)]
    assert topk.top_k(vectors(spark, few), F.col("vec_id") % 20 == 0).count() == 4
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


# --- classifier -----------------------------------------------------------------------------------


def _judged(seed, n):
    drawn = random.Random(seed)
    prose = lambda: " ".join("".join(drawn.choice("abcdefghij") for _ in range(drawn.randint(2, 9))) for _ in range(drawn.randint(30, 90))).capitalize() + "."
    junk = [lambda: " ".join([drawn.choice(["buy", "now", "win"])] * drawn.randint(20, 60)), lambda: prose().upper().replace(" ", "!! "),
            lambda: prose().replace(" ", " | "), lambda: prose().replace(" ", "$$$ ")]
    return [(i, drawn.choice(junk)() if i % 4 == 0 else prose(), int(i % 4 != 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = _judged(1, 800)
    docs = spark.createDataFrame([(i, t, 9.0, "z") for i, t, _ in rows], "doc_id long, text string, score double, x string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    right = [(found[i]["score"] >= 0.5) == bool(y) for i, _, y in rows if i in set(held)]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.scored(docs, turned).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in found.items()})


def test_awkward_documents_get_a_score(spark):
    rows = _judged(2, 200)
    texts = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "x" * 50_000), (903, "\n\n"), (None, "a b"), (1, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, None), (5, 0), (7777, 1)], "doc_id long, quality int")
    found = quality.scored(docs, labels).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.scored(docs, labels.where("false")).collect()} == {0.5}
    assert quality.scored(docs.where("false"), labels).count() == 0
    assert quality.scored(docs, labels, most_rows=60).count() == len(texts)


def test_pools_rise():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.array([1, 1, 3, 2, 2.0]))
    assert y.tolist() == pytest.approx([0.1, 0.35, 0.85]) and (np.diff(x) > 0).all()


def test_normal_equations_equal_a_direct_fit():
    drawn = np.random.default_rng(3)
    x, y = drawn.standard_normal((200, len(quality.STATISTICS))), drawn.integers(0, 2, 200).astype(float)
    cosines = quality.Cosines.drawn(x.mean(0), x.std(0), 32, 1)
    z = cosines(x)
    sums = z.T @ np.column_stack([z, y])
    penalty = np.diag([2.0] * 32 + [1e-9])
    assert quality._solved(sums, 2.0) == pytest.approx(np.linalg.inv(z.T @ z + penalty) @ z.T @ y)
    # The cosines approximate the kernel.
    many = quality.Cosines.drawn(np.zeros(3), np.ones(3), 20_000, 1)(np.array([[0.0, 0, 0], [1, 0, 1]]))[:, :-1]
    assert many[0] @ many[1] == pytest.approx(math.exp(-2 / 6), abs=0.03)


# --- URL rules ------------------------------------------------------------------------------------

URLS = [
    ("http://A.Org/", "a.org", "/", "org/", "allow"), ("http://org", "org", "", None, None), ("http://xorg/", "xorg", "/", None, None),
    ("https://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/17?x=/es/", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("http://shop.com/fr/#/de/", "shop.com", "/fr/", "com/fr/", "allow"), ("http://shop.com/de/x", "shop.com", "/de/x", "com/de/", "block"),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("x://É.COM?q://b.org/", "É.com", "", None, None), ("a://b\nc.org/d\ne?f", "b\nc.org", "/d\ne", "org/", "allow"),
]


def test_host_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_rules.judge(pages, labels, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def _labelled(seed, n):
    drawn = random.Random(seed)
    rows = []
    for i in range(n):
        host = drawn.choice(["good.net", "bad.net", "mixed.net", "www.bad.net"])
        kind = drawn.choice(["en", "ad"])
        bad = host.endswith("bad.net") or (host == "mixed.net" and kind == "ad")
        rows.append((i, f"http://{host}/{kind}/{i}{drawn.choice(['', '?ref=1', '#top'])}", int(bad != (drawn.random() < 0.05))))
    return rows


def test_mined_rules_equal_counting_all_subsets(spark):
    rows = _labelled(1, 300)
    pages = spark.createDataFrame([(1000 + i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    told = url_rules.labelled_urls(pages, labels)
    rules = url_rules.mine_rules(told, support=0.05, confidence=0.7, least_pages=5)
    got = {(frozenset(r["tokens"]), r["label"]): (r["confidence"], r["support"]) for r in rules.collect()}
    want = brute.frequent_rules([(frozenset(r["tokens"]), r["label"]) for r in told.collect()], 0.05, 0.7)
    assert got.keys() == want.keys() and len(got) > 3
    for k, (c, s) in want.items():
        assert got[k] == pytest.approx((c, s))
    judged = {r["page_id"] - 1000: r["verdict"] for r in url_rules.judge(pages, labels, URL_RULES, 0.05, 0.7, 5).collect()}
    agree = np.mean([(judged[i] == "block") == bool(b) for i, _, b in rows])
    assert agree > 0.9


def test_index_meets_the_same_rules_as_a_scan(spark):
    rows = _labelled(2, 200)
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(url_rules.labelled_urls(pages, labels), 0.05, 0.6, 5)
    urls = pages.select(F.col("page_id").alias("key"), url_rules.url_tokens(F.col("url")).alias("tokens"))
    listed = [(frozenset(r["tokens"]), r) for r in rules.collect()]
    found = {r["key"]: (r["label"], r["mined"]) for r in url_rules.matched(urls, rules).collect()}
    for row in urls.collect():
        fits = [r for t, r in listed if t <= set(row["tokens"])]
        top = max(fits, key=lambda r: (r["confidence"], r["support"], len(r["tokens"]), -r["rule_id"]), default=None)
        assert found.get(row["key"]) == (top and (top["label"], " ".join(top["tokens"])))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, labels, URL_RULES).count() == 0


def test_rare_bad_hosts_are_found_in_a_large_table(spark):
    """A few bad hosts, each on a share of the labelled pages far below a thousandth of them, decide verdicts."""
    n = 120_000
    pages = spark.range(n).select(
        F.col("id").alias("page_id"),
        F.concat(
            F.lit("http://"), F.when(F.col("id") % 2400 == 7, F.concat(F.lit("bad"), F.col("id") % 4800, F.lit(".net")))
            .otherwise(F.concat(F.lit("host"), F.col("id") % 500, F.lit(".net"))), F.lit("/en/"), F.col("id"),
        ).alias("url"),
    )
    bad = F.col("id") % 2400 == 7
    labels = spark.range(0, n, 1).select(
        F.col("id").alias("doc_id"), F.when(bad, 0).when(F.col("id") % 7 == 1, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")
    ).where("doc_id % 4 != 2")
    judged = url_rules.judge(pages, labels, URL_RULES, least_pages=10)
    verdicts = {tuple(r) for r in judged.select(F.startswith("host", F.lit("bad")), "verdict").distinct().collect()}
    assert verdicts == {(True, "block"), (False, "allow")}
    mined = judged.where(F.startswith("host", F.lit("bad"))).select("mined").distinct().collect()
    assert all("host:bad" in r["mined"] for r in mined)


def test_awkward_urls(spark):
    urls = ["http://a.net/x\ny", "http://a.net/x/y", "http://a.net/" + "p/" * 50_000 + "q" * 100_000, "http://" + "s." * 2_000 + "net/", None, ""]
    rows = [(i % 5, u) for i, u in enumerate(urls * 3)]  # ids repeat, with other URLs
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("key", "tokens", "label", "mined", "fixed")})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for rules in (URL_RULES, ()):
        found = url_rules.judge(pages, labels, rules).collect()
        assert len(found) == len(rows) and {(r["rule"], r["verdict"]) for r in found} == {(None, "allow")}
    # Tokens with line feeds: sets that would look alike in one string have rules of their own.
    told = [(k, t, "label:block" if len(t) == 2 else "label:allow") for k in range(40) for t in (["path:x\npath:y", "b"], ["path:x", "path:y", "b"])]
    labelled = spark.createDataFrame([(t, y) for _, t, y in told], "tokens array<string>, label string")
    mined = url_rules.mine_rules(labelled, 0.01, 0.9, 5)
    asked = spark.createDataFrame([(t, t) for t in (["b", "path:x\npath:y"], ["b", "path:x", "path:y"])], "key array<string>, tokens array<string>")
    found = {len(r["key"]): r["label"] for r in url_rules.matched(asked, mined).collect()}
    assert found == {2: "label:block", 3: "label:allow"}


def test_scores_beyond_doubles_are_exact_or_an_error(spark):
    drawn = random.Random(4)
    rows = [(i, [float(drawn.randint(-3, 3) * 10**6 + drawn.randint(-9, 9)) for _ in range(6)]) for i in range(40)]
    found = topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, 5, 64).collect()
    for query in (0, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert got == brute.best(dict(rows), query, 5)
    # Whole numbers up to 6.4e8: sums of products of over 2^53 and below 2^62.
    big = [(i, [x * 100 for x in v]) for i, v in rows]
    found = topk.top_k(vectors_of(spark, big), F.col("vec_id") == 0, 5, 1).collect()
    want = sorted((-sum(int(a) * int(b) for a, b in zip(big[0][1], v)), i) for i, v in big[1:])[:5]
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    # Bounds above 2^62, results below: integers of any length.
    wide = [(0, [3e9, 1.0]), (1, [2e9, 5.0]), (2, [-3e9, 3e9]), (3, [1.0, 7.0]), (4, [0.0, -3e9])]
    found = topk.top_k(vectors_of(spark, wide), F.col("vec_id") == 3, 2, 1).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 18 * 10**9), (0, 3 * 10**9 + 7)]
    for huge in ([(0, [1e12]), (1, [1e12])], [(0, [1e20]), (1, [1.0])]):
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(vectors_of(spark, huge), F.col("vec_id") == 0, 2, 64).collect()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")
