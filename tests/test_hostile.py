"""Text functions take time in proportion to the page, also for pages made to be slow."""

import time

import pytest
from pyspark.sql import functions as F

from leadweave.functions import dom, email as E, html as H

CASES = {
    "spelled_out": (E.spelled_out, lambda n: "at dot word" + " " * n),
    "spelled_out_tabs": (E.spelled_out, lambda n: "at dot " + "a \t" * n),
    "in_code": (E.in_code, lambda n: "mailto:" + " " * n + "x"),
    "flat_element": (lambda c: H.flat_element(c, "section"), lambda n: "<section>" * n),
    "flat_element_open": (lambda c: H.flat_element(c, "section"), lambda n: "<section " * n),
    "link_targets": (H.link_targets, lambda n: "<a x " * n),
    "text_of": (H.text_of, lambda n: "<b " * n),
    "text_of_quotes": (H.text_of, lambda n: '<b " ' * n + "'"),
    "markup": (H.markup, lambda n: "<script x " * n),
    "meta": (H.meta_description, lambda n: "<meta x " * n),
    "body_of_head": (H.body_of, lambda n: "<head>" * n),
    "body_of_body": (H.body_of, lambda n: "<body " * n),
    "references": (H.decode_entities, lambda n: "&#" + "9" * n + ";"),
}


def _seconds(spark, fn, text):
    df = spark.createDataFrame([(text,)], "html string").select(fn(F.col("html")).alias("r"))
    start = time.perf_counter()
    df.collect()
    return time.perf_counter() - start


@pytest.mark.parametrize("name", CASES)
def test_patterns_are_linear(spark, name):
    fn, page = CASES[name]
    _seconds(spark, fn, page(10))
    small, large = (min(_seconds(spark, fn, page(n)) for _ in range(2)) for n in (20_000, 80_000))
    assert large < 1.0 + 8 * small and large < 8


TREES = {
    "unmatched_ends": lambda n: "<b>" * n + "</i>" * n,
    "nested_items": lambda n: "<ul><li>" * n,
    "headings_below_one_link": lambda n: '<div data-hveid="x"><a href="http://x.fr">' + "<h3>t</h3>" * n,
    "deep_headings": lambda n: "<div>" * n + "<h3></h3>" * n,
    "deep_buttons": lambda n: "<div>" * n + '<i class="fontBodyMedium"></i>' * n,
}


@pytest.mark.parametrize("name", TREES)
def test_trees_are_linear(name):
    def seconds(n):
        page = TREES[name](n)
        start = time.perf_counter()
        dom._blocks(page), dom._headings(page, "http://x.fr"), dom._items(page), dom._place(page)
        return time.perf_counter() - start

    small, large = seconds(4_000), seconds(16_000)
    assert large < 0.5 + 8 * small


def test_results_stay(spark):
    def one(fn, text):
        return spark.createDataFrame([(text,)], "html string").select(fn(F.col("html")).alias("r")).first()["r"]

    assert one(E.spelled_out, "info  \t [at]   host \n [dot]  fr") == ["info@host.fr"]
    assert one(E.in_code, "mailto:  ' a@b.fr") == ["a@b.fr"]
    assert one(H.decode_entities, "&#0000000000065;&#x00000000000041;&#999999999999;&#65 &amp;") == "AA" + "A &"
    assert one(lambda c: H.flat_element(c, "main"), "<main>a</main><main>b</main>") == "<main>a</main>"
    assert one(lambda c: H.flat_element(c, "main"), "<main>a") is None
    assert one(lambda c: H.flat_element(c, "main"), "none") == ""
    assert one(H.body_of, "<head><title>t</title></head>text") == "\x01text"
    assert one(H.body_of, "<head>text") == "<head>text"
