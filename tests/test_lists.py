"""Long phrase lists, other junk lists, other score weights and strict spelled-out addresses."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leadweave import Settings, run
from leadweave.config import ScoreWeights
from leadweave.functions import email as E
from leadweave.functions.phrases import holds_any, phrase_pattern, phrase_udf
from leadweave.operators import filters, score
from leadweave.schema import LEAD
from leadweave.sinks import export
from tests.test_leads import lead
from tests.test_run import small_tables

ODD = ["", "a", "ab", "abc", "b.c", "a|b", r"\E", r"\Qa", "[x]", "é", "éa", "日本", "\n", "a b", "😀", "😀x", "(", "^a$", "-", "]"]


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_plain_search(apply, seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abcdefgh é日.|\\]-^😀\n") for _ in range(draw.randint(0 if n > 5 else 1, n)))
    phrases = [word(5) for _ in range(draw.choice([1, 3, 30, 400]))]
    texts = [word(12) for _ in range(200)] + ODD + [None, "x" * 10_000 + phrases[0]]
    got = apply(lambda c: holds_any(c, phrases), texts)
    if all(phrases):
        assert apply(lambda c: phrase_udf(phrases)(c), texts) == got == apply(lambda c: c.rlike(phrase_pattern(phrases)), texts)
    assert got == [None if t is None else any(p in t for p in phrases) for t in texts]


def test_odd_phrase_lists(apply):
    assert apply(lambda c: holds_any(c, ODD[1:]), ["zzz", "xéx", r"x\Ex", "\n"]) == [False, True, True, True]
    assert apply(lambda c: holds_any(c, []), ["a", "", None]) == [False, False, None]
    assert apply(lambda c: holds_any(c, ["a", ""]), ["b", "", None]) == [True, True, None]
    # Each begins like the others but for its end: as deep as a list can be.
    nested = ["a" * n + "b" for n in range(1, 400)]
    assert apply(lambda c: holds_any(c, nested), ["a" * 500, "a" * 500 + "b", "b", "ab"]) == [False, True, False, True]
    assert phrase_pattern(["abc", "ab", "abd", "ab"]) == "ab"


def test_a_long_list_costs_little_more_than_a_short_one(spark):
    """Ten thousand phrases against ten, over texts that hold none of them."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(7, 14))) for _ in range(10_000)]
    texts = spark.range(4000, numPartitions=1).select(F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(20)]).alias("t"))
    texts = texts.select(F.translate("t", "0123456789", "ghijklmnop").alias("t")).cache()
    texts.count()

    def seconds(phrases):
        found = texts.where(holds_any(F.col("t"), phrases))
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert found.count() == 0
            best.append(time.perf_counter() - start)
        return min(best)

    few, many = seconds(words[:10]), seconds(words)
    texts.unpersist()
    print(f"10 phrases {few:.2f} s, 10,000 phrases {many:.2f} s")
    assert many <= 2 * few + 1  # a second for starting the workers


def test_junk_lists(spark):
    leads = spark.createDataFrame([
        lead(1, "Top x", "https://sub.malt.fr/"), lead(2, "good", "https://a.bad.fr"), lead(3, "Spammy", "https://c.fr"),
        lead(4, "fine", "https://d.fr"), lead(5, "spam", "https://listed.fr"), lead(7),
    ], LEAD)
    listed = F.coalesce(F.contains("website", F.lit("listed")), F.lit(False))
    reason = filters.drop_reason(sites=["bad.fr"], name_parts=["spam"], listed=listed)
    got = {r["lead_id"]: r["reason"] for r in leads.select("lead_id", reason.alias("reason")).collect()}
    assert got == {1: None, 2: "domain", 3: "name", 4: None, 5: "domain", 7: "empty"}
    none = filters.drop_reason(filter_empty=False, sites=[], name_parts=[])
    assert leads.where(none.isNotNull()).count() == 0


def test_weights(spark):
    weights = ScoreWeights(fields={"website": 5, "description": -1}, business_email=1, free_email=4, several_sources=-3)
    assert (weights.most, weights.least) == (9, -4)
    leads = spark.createDataFrame([
        lead(1, website="w", email="a@gmail.com", address="a"), lead(2, email="a@x.fr", description="d"),
        lead(3, description="d", sources=("maps", "pj")), lead(4),
    ], LEAD)
    scored = score.scored(leads, weights)
    assert {r["lead_id"]: r["score"] for r in scored.collect()} == {1: 9, 2: 0, 3: -4, 4: 0}
    assert score.with_min_score(scored, -3, weights).count() == 3
    assert score.with_min_score(scored, -4, weights).count() == 4
    assert export.summary(scored, weights.most).first()["score_tag"] == "[9/9]"
    assert (ScoreWeights().most, ScoreWeights().least) == (11, -2)
    none = ScoreWeights(fields={}, business_email=0, free_email=0, several_sources=0)
    assert {r["score"] for r in score.scored(leads, none).collect()} == {0}
    with pytest.raises(ValueError):
        ScoreWeights(fields={"phone": 1})


def test_strict_spelled_out(apply):
    cases = {
        "datapointing": [], "john [at] foo [dot] com": ["john@foo.com"], "x(at)y(dot)de": ["x@y.de"],
        "john AT foo DOT co DOT uk": ["john@foo.co.uk"], "format foodotfr": [], "mail x at y{ point }fr now": ["x@y.fr"],
        "a(at b)dot c": [], "x at\xa0y\ndot\tfr": ["x@y.fr"], "x at y.dot fr": [], "": [], None: [],
    }
    assert apply(lambda c: E.spelled_out(c, strict=True), list(cases)) == list(cases.values())


def test_strict_runs_are_not_quadratic(apply):
    run_, strict = "abcdefgh" * 100_000, lambda c: E.spelled_out(c, strict=True)
    assert apply(strict, [run_ + " dot a at x dot fr " + run_]) == [["a@x.fr"]]
    assert apply(strict, ["dot " + "a at " * 100_000, "dot " + "at (" * 100_000]) == [[], []]


def test_a_run_with_other_lists(spark):
    settings = Settings(query="q", location="Lyon", limit=2, sources=["maps", "google", "pj"], junk_sites=[], junk_name_parts=["bet"],
                        weights=ScoreWeights(fields={"website": 7}, several_sources=0), strict_spelled_out=True)
    outcome = run(small_tables(spark), settings)
    assert {(r["company_name"], r["score"]) for r in outcome.ranked().collect()} == {("Société Alpha", 10), ("Top 10", 7), ("Gone", 7)}
    counts = outcome.counts()
    assert (counts["dropped_domain"], counts["dropped_name"], counts["selected"]) == (0, 1, 3)


def test_a_run_with_a_table_of_domains(spark):
    settings = Settings(query="q", location="Lyon", limit=2, sources=["maps", "google", "pj"])
    domains = spark.createDataFrame([("ALPHA.fr ",), ("alpha.fr",), (None,), ("",), ("com",)], "domain string")
    outcome = run(small_tables(spark, junk_domains=domains), settings)
    assert [r["company_name"] for r in outcome.ranked().collect()] == ["Beta"]
    assert "listed" not in outcome.kept.columns
    counts = outcome.counts()
    assert (counts["scored"], counts["dropped_domain"], counts["dropped_name"], counts["selected"]) == (4, 2, 1, 1)
    empty = run(small_tables(spark, junk_domains=domains.limit(0)), settings)
    assert {r["company_name"] for r in empty.ranked().collect()} == {"Société Alpha", "Beta"}
