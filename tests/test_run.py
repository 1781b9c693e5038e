"""Exports and whole runs, from landed sightings and from result pages."""

import json
from datetime import datetime
from glob import glob

from pyspark.sql import functions as F

from leadweave import LandedTables, Settings, run
from leadweave.plans.lead_run import run_and_export
from leadweave.schema import CRAWL, LEAD, PLACES, RAW_LEAD, VERDICTS
from leadweave.sinks import export
from leadweave.sources import registry
from tests.test_leads import lead
from tests.test_pages import hit


def lines(pattern):
    out = []
    for path in sorted(glob(pattern)):
        with open(path, encoding="utf-8") as file:
            out += file.read().splitlines()
    return out


def odd_leads(spark):
    return spark.createDataFrame([
        lead(1, 'Le "Café", é', website="", description="two\nlines", address=" padded ", sources=("maps", "pj"), score=3),
        lead(2, "plain", email="a@x.fr", sources=(), score=0),
    ], LEAD).coalesce(1)


def test_json(spark, tmp_path):
    export.write_json(odd_leads(spark), str(tmp_path / "j"))
    records = [json.loads(line) for line in lines(f"{tmp_path}/j/part-*.json")]
    assert records == [
        {"company_name": 'Le "Café", é', "website": "", "description": "two\nlines", "address": " padded ", "sources": ["maps", "pj"], "score": 3},
        {"company_name": "plain", "email": "a@x.fr", "score": 0},
    ]
    assert list(records[0]) == ["company_name", "website", "description", "address", "sources", "score"]
    assert "é" in lines(f"{tmp_path}/j/part-*.json")[0]
    assert [json.loads(r["record"]) for r in export.json_record(odd_leads(spark)).collect()] == records


def test_csv(spark, tmp_path):
    import pandas as pd

    export.write_csv(odd_leads(spark), str(tmp_path / "c"))
    path, = glob(f"{tmp_path}/c/part-*.csv")
    with open(path, "rb") as file:
        assert file.read(3) == b"\xef\xbb\xbf"
    got = pd.read_csv(path, encoding="utf-8-sig", keep_default_na=False)
    assert list(got.columns) == ["company_name", "website", "email", "description", "contact_page", "address", "sources", "score"]
    assert got.loc[0].tolist() == ['Le "Café", é', "", "", "two\nlines", "", " padded ", "['maps', 'pj']", 3]
    assert got.loc[1].tolist() == ["plain", "", "a@x.fr", "", "", "", "[]", 0]


def test_nothing_is_written_for_no_leads(spark, tmp_path):
    assert export.export(odd_leads(spark).where("false"), str(tmp_path / "x")) == []
    assert not list(tmp_path.iterdir())


RAW = [
    (1, "maps", 1, "Société Alpha", "https://www.alpha.fr", None, None),
    (2, "maps", 2, "Beta", None, None, "2 rue"),
    (3, "maps", 3, "Over the limit", None, None, None),
    (4, "google", 1, "ALPHA societe-alpha", "http://alpha.fr/x", "Alpha text", None),
    (5, "google", 2, "Top 10", "https://top.fr", "t", None),
    (6, "pj", 1, "beta SARL", None, None, "3 rue"),
    (7, "pj", 2, "Gone", "https://x.malt.fr", None, "a"),
]


def small_tables(spark, **more):
    crawl = [("https://www.alpha.fr", 200, "text/html", '<a href="mailto:hello@alpha.fr">x</a>'),
             ("https://www.alpha.fr/contact", 200, "text/html", "hi")]
    return LandedTables(
        crawl=spark.createDataFrame(crawl, CRAWL), raw_leads=spark.createDataFrame(RAW, RAW_LEAD),
        places=spark.createDataFrame([("Société Alpha Lyon", "1 quai", None, None)], PLACES), **more)


def test_run(spark):
    settings = Settings(query="q", location="Lyon", limit=2, sources=["maps", "google", "pj"])
    outcome = run(small_tables(spark), settings)
    rows = [r.asDict() for r in outcome.ranked().drop("lead_id", "seq").collect()]
    assert rows == [
        {"company_name": "Société Alpha", "website": "https://www.alpha.fr", "email": "hello@alpha.fr", "description": "x",
         "contact_page": "https://www.alpha.fr/contact", "address": "1 quai", "sources": ["google", "maps"], "score": 11},
        {"company_name": "Beta", "website": None, "email": None, "description": None, "contact_page": None,
         "address": "2 rue", "sources": ["maps", "pj"], "score": 4},
    ]
    assert outcome.counts() == {
        "discovered": 6, "merged": 4, "valid": 4, "addresses_filled": 1, "scored": 4, "dropped_domain": 1,
        "dropped_name": 1, "dropped_empty": 0, "selected": 2, "pages_unread": 0,
    }


def test_kept_and_refused_cover_all(spark, tmp_path):
    settings = Settings(query="q", location="Lyon", limit=2, sources=["maps", "google", "pj"], output_dir=str(tmp_path))
    both = run(small_tables(spark), settings).kept
    refuse = both.where("company_name = 'Beta'").select(F.col("lead_id").alias("lead_key"), F.lit("non").alias("answer"), F.lit(None).cast("string").alias("error"))
    outcome = run(small_tables(spark, verdicts=refuse), settings)
    assert [r["company_name"] for r in outcome.kept.collect()] == ["Société Alpha"]
    assert [r["company_name"] for r in outcome.refused.collect()] == ["Beta"]
    paths = run_and_export(small_tables(spark, verdicts=refuse), settings, datetime(2024, 1, 2, 3, 4, 5))
    assert [p.rsplit("/", 1)[1] for p in paths] == [
        f"maps_google_pj_q_lyon_20240102_030405{end}" for end in (".json", ".csv", "_refused.json", "_refused.csv")]


def test_options(spark):
    settings = Settings(query="q", location="Lyon", limit=None, sources=["google", "google"], only=["website"], filter_junk=False,
                        address_backfill=False, min_score=-2, dedup_mode="closure")
    rows = run(small_tables(spark), settings).ranked().collect()
    assert {(r["company_name"], r["score"]) for r in rows} == {("ALPHA societe-alpha", 3), ("Top 10", 3)}


def test_repeated_source_runs_twice(spark):
    raw = spark.createDataFrame(RAW, RAW_LEAD)
    got = registry.arrived(registry.landed(raw, ["pj", "maps", "pj"], 1)).orderBy("seq").collect()
    assert [(r["source"], r["company_name"], r["sources"]) for r in got] == [
        ("pj", "beta SARL", ["pj"]), ("maps", "Société Alpha", ["maps"]), ("pj", "beta SARL", ["pj"])]


def test_run_from_result_pages(spark):
    term = "web Lyon"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    link = '<a href="https://m/maps/place/{}">x</a>'
    place = '<h1>{}</h1><button data-item-id="address"><i class="fontBodyMedium">{}</i></button><a data-item-id="authority" href="{}">w</a>'
    tables = LandedTables(
        crawl=frame([("https://one.fr", 200, "text/html", "<p>me@one.fr</p>")], CRAWL),
        feed_pages=frame([(term, 0, link.format(1) + link.format(2) + link.format(3)), ("other", 0, link.format(9))], "search_term string, page_no int, html string"),
        place_pages=frame([("https://m/maps/place/1", place.format("One", "1 rue", "https://one.fr")), ("https://m/maps/place/2", "<p>"),
                           ("https://m/maps/place/3", place.format("Three", "3 rue", ""))], "url string, html string"),
        directory_pages=frame([(term, 1, "<li><h3>One SARL</h3></li><li><h3>Four</h3><address>4 rue</address></li>")], "search_term string, page_no int, html string"),
        lookup_pages=frame([("Four Lyon", 0, "https://www.google.fr/", hit("https://four.fr", "4"))], "search_term string, page_no int, url string, html string"),
        search_pages=frame([(term, 0, "https://www.google.fr/", hit("https://four.fr/home", "Four | Accueil", "text") + hit("https://x.com", "X"))],
                           "search_term string, page_no int, url string, html string"),
    )
    settings = Settings(query="web", location="Lyon", limit=2, sources=["maps", "pj", "google"])
    rows = {r["company_name"]: r.asDict() for r in run(tables, settings).kept.collect()}
    assert {n: (r["website"], r["email"], r["address"], r["sources"]) for n, r in rows.items()} == {
        "One": ("https://one.fr", "me@one.fr", "1 rue", ["maps", "pj"]),
        "Four": ("https://four.fr", None, "4 rue", ["google", "pj"]),
    }
