"""Merge, score, filters, order, relevance, settings."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadweave.config import Settings, output_base, parse_only, parse_sources
from leadweave.operators import filters, relevance, score, skew
from leadweave.operators.merge import merge_records
from leadweave.schema import LEAD, VERDICTS
from leadweave.sinks.export import summary


def lead(lead_id, name="n", website=None, email=None, description=None, contact_page=None, address=None,
         sources=("maps",), score=0, seq=None):
    return (lead_id, name, website, email, description, contact_page, address, list(sources), score,
            lead_id if seq is None else seq)


@pytest.fixture(scope="module")
def leads_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LEAD)


def ids(df):
    return sorted(r["lead_id"] for r in df.collect())


# --- merge -------------------------------------------------------------------------------------------


def fold(records):
    """Left fold of the records in order, field by field."""
    out = dict(records[0])
    for r in records[1:]:
        for c in ("company_name", "website", "email", "contact_page", "address"):
            out[c] = out[c] or r[c]
        a, b = out["description"], r["description"]
        out["description"] = (a if len(a) >= len(b) else b) if a and b else a or b
        out["sources"] = sorted(set(out["sources"]) | set(r["sources"]))
    return out


def test_merge_equals_the_fold(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [
        lead(i, f"n{i}", pick(None, "", f"w{i}"), pick(None, "", f"e{i}"), pick(None, "", "d" * rng.randint(1, 4) + str(i % 10)),
             None, pick(None, "", f"a{i}"), pick(("pj",), ("maps",), ("pj", "google"), ()), 3, i)
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, LEAD).withColumn("slot", F.col("lead_id") % 40).repartition(5)
    merged = {r["slot"]: r.asDict() for r in merge_records(df, "slot").collect()}
    for slot in range(40):
        members = [dict(zip(LEAD.fieldNames(), r)) for r in rows if r[0] % 40 == slot]
        expected = fold(members)
        got = merged[slot]
        for c in ("company_name", "website", "email", "description", "contact_page", "address", "sources"):
            assert got[c] == expected[c], (slot, c)
        assert got["score"] == 0 and got["seq"] == slot


def test_single_record_keeps_its_source_order(leads_of):
    df = leads_of(lead(1, sources=("pj", "google"))).withColumn("slot", F.lit(1))
    assert merge_records(df, "slot").first()["sources"] == ["pj", "google"]


# --- score and filters -------------------------------------------------------------------------------


def test_score(leads_of):
    df = leads_of(
        lead(1, website="w", email="a@x.fr", description="d", contact_page="c", address="a", sources=("maps", "pj")),
        lead(2, email="a@gmail.com"), lead(3, sources=("maps", "maps")), lead(4, website="", address=" "),
        lead(5, email="a@GMAIL.com", contact_page="c"), lead(6, sources=()),
    )
    got = {r["lead_id"]: r["score"] for r in score.scored(df).collect()}
    assert got == {1: 11, 2: -2, 3: 0, 4: 2, 5: -1, 6: 0}
    assert (score.MAX_SCORE, score.MIN_SCORE) == (11, -2)


def test_min_score(leads_of):
    df = leads_of(*[lead(i, score=s) for i, s in enumerate([-2, -1, 0, 5, 11])])
    kept = {n: ids(score.with_min_score(df, n)) for n in (-2, -1, 0, 11)}
    assert kept == {-2: [0, 1, 2, 3, 4], -1: [1, 2, 3, 4], 0: [2, 3, 4], 11: [4]}


def test_rank_keeps_arrival_order_of_equals(leads_of):
    df = leads_of(*[lead(i, score=i % 3, seq=100 - i) for i in range(30)]).repartition(4)
    got = [(r["score"], r["seq"]) for r in score.ranked(df).collect()]
    assert got == sorted(got, key=lambda p: (-p[0], p[1]))


def test_drop_reasons(leads_of):
    df = leads_of(
        lead(1, "Top x", "https://sub.malt.fr/"), lead(2, "laptop repair", "https://a.fr"), lead(3), lead(4, "annuaire", "https://netflix.com"),
        lead(5, "x annuaire", "https://b.fr"), lead(6, "Agence", address="a"), lead(7, "MEILLEUR", ""), lead(8, "e", "https://www.wikipedia.org"),
    )
    got = {r["lead_id"]: r["reason"] for r in df.withColumn("reason", filters.drop_reason()).collect()}
    assert got == {1: "domain", 2: "name", 3: "empty", 4: None, 5: "name", 6: None, 7: "name", 8: "domain"}
    assert ids(filters.without_junk(df)) == [4, 6]
    assert ids(filters.without_junk(df, filter_empty=False)) == [3, 4, 6]
    report = {r["reason"]: r["n_leads"] for r in filters.drop_report(df).collect()}
    assert report == {"domain": 2, "name": 3, "empty": 1, "kept": 2}


def test_required_fields_and_validity(leads_of):
    df = leads_of(lead(1, email="e", contact_page="c"), lead(2, email="e", contact_page=""), lead(3, " \t"), lead(4, ""))
    assert ids(filters.with_fields(df, ["email", "contact"])) == [1]
    assert ids(filters.with_fields(df, [])) == [1, 2, 3, 4]
    assert ids(filters.valid_leads(df)) == [1, 2]


# --- relevance -----------------------------------------------------------------------------------------


def test_verdicts(spark, leads_of):
    answers = [(1, "Oui.", None), (2, "yes", None), (3, "", None), (4, None, None), (5, "non", "timeout"), (7, " oui", None)]
    df = leads_of(*[lead(i) for i in range(1, 8)])
    judged = relevance.judged(df, spark.createDataFrame(answers, VERDICTS))
    assert {r["lead_id"]: r["kept"] for r in judged.collect()} == {
        1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_request_text(leads_of):
    rows = relevance.relevance_requests(leads_of(lead(1, "Co", "w", description="")), "agence").collect()
    assert "Co" in rows[0]["request"] and "Non disponible" in rows[0]["request"] and rows[0]["request"].count("agence") == 2


# --- settings ------------------------------------------------------------------------------------------


def test_parsing():
    assert parse_sources(" Maps,pj,,maps ") == ["maps", "pj", "maps"]
    assert parse_only("email, Contact") == ["email", "contact"]
    with pytest.raises(ValueError, match="yahoo"):
        parse_sources("yahoo,maps,bing")
    with pytest.raises(ValueError, match="phone"):
        parse_only("phone")
    assert Settings(sources=[]).sources == ["maps"]
    with pytest.raises(ValueError):
        Settings(output_format="xml")


def test_output_name():
    settings = Settings(query="Agence Web", location="Lyon", sources=["maps", "pj"])
    assert output_base(settings, datetime(2024, 5, 6, 7, 8, 9), refused=True) == "maps_pj_agence_web_lyon_20240506_070809_refused"


# --- numbering and skew --------------------------------------------------------------------------------


def test_numbered_within_and_across_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 5)}", seq) for seq in rng.sample(range(100_000), 500)]
    df = spark.createDataFrame(rows, "g string, seq long")
    got = {(r["g"], r["seq"]): r["n"] for r in skew.numbered(df, ["g"], "seq", "n").collect()}
    for group in {g for g, _ in rows}:
        for n, seq in enumerate(sorted(s for g, s in rows if g == group), 1):
            assert got[group, seq] == n
    across = skew.numbered(df, ["g"], "seq", "n", across=[F.desc("g")]).orderBy("n").collect()
    assert [r["n"] for r in across] == list(range(1, 501))
    assert [(r["g"], r["seq"]) for r in across] == sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)


@pytest.mark.parametrize("n", [3, 5000])
def test_first_per_group(spark, n):
    df = spark.range(12_000).withColumn("g", F.col("id") % 2)
    got = skew.first_per_group(df, ["g"], "id", n).groupBy("g").agg(F.max("id").alias("last"), F.count("*").alias("c"), F.max("rank").alias("r"))
    assert sorted(map(tuple, got.collect())) == [(0, 2 * n - 2, n, n), (1, 2 * n - 1, n, n)]


@pytest.mark.parametrize("n", [1, 5, 49, 50, 2000])
def test_limits_go_one_way_whatever_their_size(spark, n):
    df = skew.first_per_group(spark.range(100).withColumn("g", F.col("id") % 2), ["g"], "id", n)
    assert sorted((r["g"], r["rank"], r["id"]) for r in df.collect()) == [
        (g, i + 1, 2 * i + g) for g in (0, 1) for i in range(min(n, 50))
    ]


def test_skew_join_spreads_hot_and_missing_keys(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")))
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("unused", 3)], "k string, v int")
    spark.conf.set("leadweave.skew.hotRows", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.skew_join(left, right, "k", "id")
        parts = joined.where("k = 'hot' or k is null").groupBy(F.spark_partition_id()).count().count()
        counts = {(r["k"], r["v"]): r["count"] for r in joined.where("v is not null").groupBy("k", "v").count().collect()}
        total = joined.count()
    finally:
        for key in ("leadweave.skew.hotRows", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert counts == {("hot", 1): 334, ("4", 2): 1}
    assert total == 1000 and parts > 1


def test_summary(leads_of):
    df = leads_of(lead(1, score=3, description="x" * 99 + " y", sources=("maps", "pj")), lead(2, score=5), lead(3, score=3, sources=()))
    rows = summary(df).collect()
    assert [(r["number"], r["score_tag"], r["sources_tag"], r["snippet"]) for r in rows] == [
        (1, "[5/11]", "maps", None), (2, "[3/11]", "maps, pj", "x" * 99 + "…"), (3, "[3/11]", "", None)]
