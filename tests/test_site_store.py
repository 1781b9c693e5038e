"""Leads and pages kept by site."""

import uuid

import pytest
from pyspark.sql import functions as F

from leadweave.operators import enrich
from leadweave.plans.site_store import SiteStore
from leadweave.schema import CRAWL, LEAD
from tests.test_leads import lead
from tests.test_pages import page


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    before = {}

    def set_(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def store(spark):
    made = SiteStore.create(spark, f"store_{uuid.uuid4().hex}", buckets=8)
    yield made
    made.drop()


HOT_HOME, PLATFORM = "https://hot.fr", "https://platform.fr"
WEBSITES = [
    None, " ", "a.fr", "https://a.fr/x", "http://a.fr", "HTTP://Caps.fr", "ftp://no.fr", "https://none.fr", "https://b.fr?x=1",
]
CRAWLED = [
    page("https://a.fr", "<p>one@a.fr</p>"), page("https://a.fr/x", "<p>x@a.fr</p>"), page("https://a.fr/contact", "<p>c@a.fr</p>"),
    page("http://a.fr/about", "<p>plain@a.fr</p>"), page("HTTP://Caps.fr", "<p>caps@c.fr</p>"), page("https://b.fr?x=1", "<p>b@b.fr</p>"),
    page(HOT_HOME, "<p>hot@hot.fr</p>"), page(f"{HOT_HOME}/other", "<p>other@hot.fr</p>"), page(f"{HOT_HOME}/contact", "nothing"),
    page(f"{PLATFORM}/contact", "<p>desk@platform.fr</p>"), *[page(f"{PLATFORM}/p{i}", f"<p>p{i}@shop.fr</p>") for i in range(0, 300, 2)],
]


def leads_of(spark):
    rows = [lead(i, website=w, email="old@x.fr") for i, w in enumerate(WEBSITES)]
    rows += [lead(100 + i, website=HOT_HOME) for i in range(300)] + [lead(500, website=f"{HOT_HOME}/other")]
    rows += [lead(1000 + i, website=f"{PLATFORM}/p{i}") for i in range(300)]
    rows += [lead(2000 + i, website=f"s{i}.fr") for i in range(50)] + [lead(2, website="a.fr", email="old@x.fr")]
    return spark.createDataFrame(rows, LEAD)


def rows(df):
    return sorted(map(repr, df.collect()))


def filled(store, spark, crawled=CRAWLED):
    leads = leads_of(spark)
    store.write_leads(leads)
    store.write_crawl(spark.createDataFrame(crawled, CRAWL))
    return leads


@pytest.mark.parametrize("hot_rows", ["20", "100000"])
def test_as_the_join_by_shuffle(spark, store, settings, hot_rows):
    settings("leadweave.skew.hotRows", hot_rows)
    leads = filled(store, spark)
    want = enrich.enriched(leads, spark.createDataFrame(CRAWLED, CRAWL))
    got = store.enriched().select(*want.columns)
    assert rows(got) == rows(want) and got.where("email = 'hot@hot.fr'").count() == 300


def test_no_shuffle_below_the_joins(spark, store, settings):
    filled(store, spark)
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = store.enriched()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan
    assert plan.count("Bucketed: true") == 2


def test_hot_homepages_lie_in_many_buckets(spark, store, settings):
    settings("leadweave.skew.hotRows", "20")
    filled(store, spark)
    kept = lambda part, key: store.table(part).where(key).groupBy("salt").count().toPandas()["count"]
    counts = kept("leads", F.col("fetch") == HOT_HOME)
    assert len(counts) == 8 and counts.max() < 80
    assert kept("findings", F.col("fetch") == HOT_HOME).tolist() == [1] * 8
    # A platform's homepages are keys of their own, each with the platform's contacts.
    platform = store.table("findings").where(F.startswith("fetch", F.lit(PLATFORM)))
    assert platform.count() == 300 == platform.where("site_email = 'desk@platform.fr' and salt = 0").count()
    assert kept("leads", "fetch is null").sum() == 2


def test_a_new_crawl_replaces_the_pages(spark, store):
    filled(store, spark)
    store.write_crawl(spark.createDataFrame([page("https://a.fr/x", "<p>new@a.fr</p>")], CRAWL))
    got = {r["lead_id"]: r["email"] for r in store.enriched().collect()}
    assert got[3] == "new@a.fr" and got[4] == "old@x.fr" and got[100] is None


def test_empty_tables(spark, store):
    store.write_leads(spark.createDataFrame([], LEAD))
    store.write_crawl(spark.createDataFrame([], CRAWL))
    assert store.enriched().count() == 0
    store.write_leads(leads_of(spark))
    store.write_crawl(spark.createDataFrame([], CRAWL))
    assert store.enriched().count() == leads_of(spark).count()
