"""Host degrees, ignored hosts, listed domains, key filters, page numbers and the JSON array."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadweave.config import Settings
from leadweave.functions.name import name_key
from leadweave.operators import dedup, hosts, key_filter as K, skew
from leadweave.schema import EXPORT_COLUMNS
from leadweave.sinks import export
from leadweave.sources import registry

SIGHTING = "seq long, company_name string, website string"


def _sightings(spark):
    rows = [(i, f"Company {i}", f"https://www.facebook.com/p{i}") for i in range(40)]
    rows += [(100 + i, "One firm", "https://one.fr/") for i in range(30)]
    rows += [(200 + i, f"Own {i}", f"https://own{i}.fr") for i in range(50)]
    rows += [(300, "No site", None), (301, "", "https://one.fr/x"), (302, None, "https://one.fr"), (303, "Sub", "http://fr.facebook.com/z")]
    return spark.createDataFrame(rows, SIGHTING).repartition(7)


def test_degrees_are_exact_for_what_the_sketch_proposes(spark):
    found = {r["host"]: (r["n_links"], r["n_names"]) for r in hosts.host_degrees(_sightings(spark), 0.2).collect()}
    assert found == {"facebook.com": (40, 40), "one.fr": (32, 1)}
    every = hosts.host_degrees(_sightings(spark), 0.0).collect()
    assert len(every) == 53 and sum(r["n_links"] for r in every) == 123
    assert hosts.host_degrees(_sightings(spark).limit(0)).count() == 0
    assert hosts.shared_hosts(_sightings(spark), 3, 0.05) == ["facebook.com"]


def test_a_small_sketch_still_finds_the_heavy_hosts(spark):
    rows = [(i, f"C{i}", f"https://h{i}.fr" if i % 4 else f"https://big{i % 8}.fr") for i in range(8000)]
    found = hosts.host_degrees(spark.createDataFrame(rows, SIGHTING), 0.1, tracked=64).collect()
    assert {(r["host"], r["n_links"]) for r in found} == {("big0.fr", 1000), ("big4.fr", 1000)}


@pytest.mark.parametrize("mode", ["exact", "closure"])
def test_ignored_hosts_join_nothing(spark, mode):
    df = _sightings(spark)
    slots = lambda **s: {r["seq"]: r["slot"] for r in dedup.duplicate_slots(df, mode, **s).collect()}
    joined, apart = slots(), slots(ignore_hosts=["facebook.com"])
    assert {joined[i] for i in range(40)} == {0}
    assert [apart[i] for i in range(40)] == list(range(40)) and apart[303] == 303  # subdomains too
    assert {apart[100 + i] for i in range(30)} == {100}
    assert Settings(ignore_hosts=["facebook.com"]).ignore_hosts == ["facebook.com"]


def test_longest_listed_domain_above_a_site(spark):
    drawn = random.Random(2)
    labels = ["a", "b", "fr", "com", "co"]
    sites = sorted({".".join(drawn.choices(labels, k=drawn.randint(1, 5))) for _ in range(200)})
    listed = sorted({".".join(drawn.choices(labels, k=drawn.randint(1, 3))) for _ in range(25)})
    leads = [(i, f"https://{s}/x") for i, s in enumerate(sites)] + [(900, None), (901, ""), (902, "https://WWW.A.fr")]
    table = spark.createDataFrame([(f" {d.upper()} ",) for d in listed] * 2 + [("",), (None,)], "domain string")
    df = spark.createDataFrame(leads, "lead_id long, website string").withColumns({c: F.lit("z") for c in ("domain", "site_key", "n")})
    found = {r["lead_id"]: r["listed"] for r in hosts.with_listed_domain(df, table).collect()}
    def want(site):
        above = [d for d in listed if site == d or site.endswith("." + d)]
        return max(above, key=len, default=None)
    assert found == {i: want(s) for i, s in enumerate(sites)} | {900: None, 901: None, 902: want("a.fr")}
    assert {r["listed"] for r in hosts.with_listed_domain(df, table.limit(0)).collect()} == {None}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_a_key_filter_holds_all_keys_and_few_others(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    wanted = K.key_filter(keys)
    probe = spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("v"))
    found = {r["id"] for r in probe.where(wanted.may_hold(F.col("v"))).select("id").collect()}
    assert set(range(n)) <= found and len(found) - n < 0.05 * 20_000
    assert keys.where("key is null").where(wanted.may_hold(F.col("key"))).count() == 0


def test_a_full_key_filter_loses_no_key(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_BITS", 1 << 12)
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    assert keys.where(K.key_filter(keys).may_hold(F.col("key"))).count() == 3000


def test_page_numbers_of_any_size(spark):
    card = '<ul><li><h3><a href="#">Shop {0}</a></h3><div class="x-address">{0} rue</div></li><li><h3>Also {0}</h3></li></ul>'
    numbers = [2**40, 3, 2**20, 2**62, 0]
    pages = spark.createDataFrame([("q l", n, card.format(n)) for n in numbers], "search_term string, page_no long, html string")
    hits = spark.createDataFrame([], "search_term string, page_no long, url string, html string")
    from leadweave.plans.lead_run import LandedTables

    tables = LandedTables(crawl=hits, directory_pages=pages, lookup_pages=hits)
    for limit, n in ((None, 10), (3, 3)):
        settings = Settings(query="q", location="l", sources=["pj"], limit=limit)
        rows = registry.discover(tables, settings).orderBy("seq").collect()
        assert [r["company_name"] for r in rows] == [f"{k} {p}" for p in sorted(numbers) for k in ("Shop", "Also")][:n]
        assert [r["source_rank"] for r in rows] == list(range(1, n + 1))


def test_ranks_by_page(spark):
    drawn = random.Random(4)
    rows = [(g, p, k) for g in "ab" for p in drawn.sample(range(10**12), 60) for k in range(drawn.randint(1, 5))]
    df = spark.createDataFrame(rows, "g string, page long, k long")
    found = skew.ranked_by_page(df, ["g"], "page", "k", "rank").collect()
    for g in "ab":
        own = sorted((r["page"], r["k"], r["rank"]) for r in found if r["g"] == g)
        assert [r[2] for r in own] == list(range(1, len(own) + 1)) and len(own) == sum(r[0] == g for r in rows)


def test_the_first_of_each_group_takes_no_quantiles(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot"))
    for n in (1, 7, 3000):
        got = skew.first_per_group(df, ["g"], "id", n)
        assert "percentile" not in got._jdf.queryExecution().toString()
        for g, size in (("rare", 500), ("hot", 4500)):
            ranks = [r["rank"] for r in got.where(F.col("g") == g).orderBy("id").collect()]
            assert ranks == list(range(1, min(n, size) + 1))


def _read_array(path):
    return json.loads("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))))


def test_part_files_form_one_json_array(spark, tmp_path):
    names = [f'Agence "{i}"\n[x], é' for i in range(300)]
    rows = [(i, n, f"https://a{i}.fr" if i % 2 else None, i % 7) for i, n in enumerate(names)]
    leads = spark.createDataFrame(rows, "seq long, company_name string, website string, score int").repartition(6)
    for c in EXPORT_COLUMNS:
        if c not in leads.columns:
            leads = leads.withColumn(c, F.array(F.lit("maps")) if c == "sources" else F.lit(None).cast("string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_json_array(leads, f"{tmp_path}/many")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = _read_array(f"{tmp_path}/many")
    want = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert [(r["company_name"], r.get("website"), r["score"]) for r in read] == [(n, w, s) for _, n, w, s in want]
    assert len(list(Path(f"{tmp_path}/many").glob("part-*"))) > 1 and read[0]["sources"] == ["maps"] and "email" not in read[0]
    export.write_json_array(leads.where("seq = 5"), f"{tmp_path}/one")
    assert [r["score"] for r in _read_array(f"{tmp_path}/one")] == [5]
    export.write_json_array(leads.where("seq < 0"), f"{tmp_path}/none")
    assert _read_array(f"{tmp_path}/none") == []
    assert export.export(leads, f"{tmp_path}/run", "json_array") == [f"{tmp_path}/run.json"]
    assert len(_read_array(f"{tmp_path}/run.json")) == 300


def test_names_are_compared_by_key(spark):
    rows = [(1, "Été SARL", "https://h.fr/1"), (2, "ete", "https://h.fr/2"), (3, " ", "https://h.fr/3")]
    df = spark.createDataFrame(rows, SIGHTING)
    n = len({r[0] for r in df.select(name_key(F.col("company_name"))).collect()} - {""})
    assert [tuple(r) for r in hosts.host_degrees(df, 0.5).collect()] == [("h.fr", 3, n)]
