"""Each distinct content of a crawl is parsed once."""

import re

import pytest
from pyspark.sql import Observation, functions as F

from leadweave.operators import enrich, parse_once
from leadweave.schema import CRAWL
from tests.test_pages import page

PARKED = "<p>sales@parked.fr</p><main>" + "This domain is parked. " * 20 + "</main>"


@pytest.fixture
def landed(spark, tmp_path):
    """Rows as Parquet files, several of them."""

    def land(rows, files=5):
        spark.createDataFrame(rows, CRAWL).repartition(files).write.parquet(f"{tmp_path}/crawl")
        return spark.read.parquet(f"{tmp_path}/crawl")

    return land


def rows(df):
    return sorted(map(repr, df.select("url", "email", "strategy", "description", "has_html", "unread").collect()))


def crawled():
    recrawled = [page(f"https://s{i}.fr", f"<p>m{i}@s{i}.fr</p>") for i in range(40) for _ in range(5)]
    changed = [page(f"https://s{i}.fr", f'<a href="mailto:new{i}@s{i}.fr">x</a>') for i in range(0, 40, 4)]
    parked = [page(f"https://parked{i}.fr", PARKED) for i in range(200)]
    none = [page("https://s1.fr", ""), page("https://e.fr", None), page("https://e.fr", " "), page("https://e.fr", "")]
    refused = [page("https://no.fr", PARKED, status=404), page("ftp://no.fr", PARKED), page("https://no.fr/x", PARKED, kind="image/png")]
    return recrawled + changed + parked + none + refused


@pytest.mark.parametrize("hot_rows", ["20", "100000"])
def test_equal_pages_are_parsed_once(spark, landed, hot_rows):
    spark.conf.set("leadweave.skew.hotRows", hot_rows)
    try:
        crawl, parsed = landed(crawled()), Observation("parsed")
        got = rows(parse_once.page_features(crawl, parsed=parsed))
    finally:
        spark.conf.unset("leadweave.skew.hotRows")
    assert got == rows(enrich.page_features(crawl)) and len(got) == 40 + 200 + 1
    # 40 first pages, 10 changed ones, the parked one, two without text; of the 450 others the filter may let some through.
    assert 53 <= parsed.get["pages_parsed"] <= 53 + 450 // 10


def test_html_is_not_moved(landed):
    _, first = parse_once.first_copies(landed(crawled()))
    read = enrich.with_description(enrich.page_contacts(first), 100).select("digest", "email", "description")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"FileScan parquet \[[^\]]*html#(\d+)", plan))) == 1
    assert "Exchange" not in plan.split("Subquery")[0] and "Join" not in plan.split("Subquery")[0]


def test_empty_and_filtered_crawls(landed):
    crawl = landed(crawled())
    assert parse_once.page_features(crawl.where("url = 'none'")).count() == 0
    some = crawl.where(F.startswith("url", F.lit("https://s1"))).withColumn("more", F.lit(1))
    assert rows(parse_once.page_features(some)) == rows(enrich.page_features(some))


def test_a_crawl_that_is_no_scan_is_an_error(spark):
    with pytest.raises(Exception, match="_metadata"):
        parse_once.page_features(spark.createDataFrame([], CRAWL))
