"""URL filters: host rules, and association rules mined from labelled URLs.

A URL becomes a set of tokens (host labels, path parts with digits folded, query keys, fragment).
FP-growth mines the token sets that go with a label; rules are kept by support, by confidence, and
only if no rule with one token less is as good. Every rule is posted in an inverted index under its
rarest token, so a URL meets only the rules of its own tokens, and the rest of the rule is then
checked on the token set.

Only DataFrame functions and the ML library's FP-growth are used; no Python runs on executors.

Defined cases: a URL that is null or has no ``://`` has empty host, path and token set; a
null label is no label; a page with several labels counts once for each; a URL that no
rule matches is allowed; without labelled pages there are no rules. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.operators.skew import skew_join
from leadweave.session import settle

BLOCK, ALLOW = "label:block", "label:allow"
LEAST_PAGES = 30


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``(host, path, verdict)`` that fits, as ``struct(rule, verdict)``, else null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = F.coalesce(none, *[
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ])
    return fits


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; digits in path parts are folded to ``#``."""
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"(?s)://[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(whole, r"(?s)://[^#]*#(.+)", 1)
    some = lambda parts: F.filter(parts, lambda p: p != "")
    tagged = lambda tag, parts: F.transform(some(parts), lambda p: F.concat(F.lit(tag), p))
    folded = F.transform(F.split(path_of(url), "/"), lambda p: F.regexp_replace(p, "[0-9]+", "#"))
    keys = F.transform(F.split(query, "[&;]"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.concat(
        tagged("host:", F.split(host_of(url), r"\.")), tagged("path:", folded),
        tagged("query:", keys), tagged("part:", F.array(fragment)),
    ))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``tokens, label`` of the pages whose document has a label.

    The number in a page's path is the id of the document it shows. A document of low quality or with
    toxic text is to be blocked.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?![0-9])", 1)
    told = pages.select(F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("doc_id"), url_tokens(F.col("url")).alias("tokens"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    verdict = F.when(bad, BLOCK).when(bad.isNotNull(), ALLOW)
    marks = labels.select("doc_id", verdict.alias("label")).where("label is not null")
    return told.join(marks, "doc_id").select("tokens", "label")


def mine_rules(
    labelled: DataFrame, support: float = 0.0, confidence: float = 0.6, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``rule_id, tokens, label, confidence, support, rarest`` from ``tokens, label``.

    Kept are rules of at least that confidence that hold on *least_pages* labelled pages, and of those only the ones
    that no rule with one token less for the same label equals in confidence. The number of pages is absolute: a
    host with enough bad pages is found in a table of any size. *support* may ask for a share of all labelled pages
    besides, where a table has so many kinds of pages that fewer rules are wanted.
    """
    spark = labelled.sparkSession
    baskets = settle(labelled.select(F.concat("tokens", F.array("label")).alias("items")))
    empty = "rule_id long, tokens array<string>, label string, confidence double, support double, rarest string"
    known = baskets.count()
    if known < max(least_pages, 1):
        return spark.createDataFrame([], empty)
    share = max(support, least_pages / known)
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    told = model.associationRules.select(
        F.array_sort("antecedent").alias("tokens"), F.element_at("consequent", 1).alias("label"), "confidence", "support"
    ).where(F.col("label").isin(BLOCK, ALLOW))
    told = settle(told)
    best = told.select(F.col("tokens").alias("part"), F.col("label").alias("part_label"), F.col("confidence").alias("least"))
    parts = told.select(
        "tokens", "label", "confidence", "support",
        F.explode_outer(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("part"),
    )
    beaten = parts.join(
        best, (parts["part"] == best["part"]) & (parts["label"] == best["part_label"]), "left"
    ).groupBy("tokens", "label", "confidence", "support").agg(F.max("least").alias("least"))
    kept = beaten.where(F.col("least").isNull() | (F.col("confidence") > F.col("least")))
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = kept.select("*", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens", "label").agg(
        F.min_by("token", F.struct("freq", "token")).alias("rarest")
    )
    return settle(kept.join(rarest, ["tokens", "label"]).select(
        F.xxhash64("tokens", "label").alias("rule_id"), "tokens", "label", "confidence", "support", "rarest"
    ))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, label, mined``: for each *key* (unique) with *tokens*, the best rule that matches.

    The most confident rule wins; then more support, more tokens, and the smaller rule id.
    """
    posted = rules.withColumnRenamed("tokens", "needed").withColumnRenamed("rarest", "token")
    met = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(posted, "token")
    met = met.where(F.size(F.array_except("needed", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("needed"), -F.col("rule_id"))
    best = met.groupBy("key").agg(F.max_by(F.struct("label", "needed"), order).alias("best"))
    return best.select("key", "best.label", F.array_join("best.needed", " ").alias("mined"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    support: float = 0.0,
    confidence: float = 0.6,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, mined``.

    A host rule decides; where none fits, the best mined rule; else the page is allowed. The match goes
    by distinct token set, so pages with the same tokens are matched once, and the verdict of a token set that very
    many pages have is salted on its way back to them (:func:`skew_join`). Rows with one ``page_id`` are judged each.
    """
    mined = mine_rules(labelled_urls(pages, labels), support, confidence, least_pages)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = settle(pages.select("page_id", host.alias("host"), path.alias("path"), F.array_sort(url_tokens(F.col("url"))).alias("tokens")))
    seen = seen.withColumn("fixed", longest_rule(F.col("host"), F.col("path"), rules))
    # The token set itself is the key: joined to one string, two sets could look alike. A page with a host rule has none.
    seen = seen.select("page_id", "host", "path", "fixed", F.when(F.col("fixed").isNull(), F.col("tokens")).alias("key"))
    urls = seen.where("key is not null").select("key", F.col("key").alias("tokens")).distinct()
    found = settle(matched(urls, mined))
    answered = skew_join(seen, found, "key", "page_id")
    by_method = F.when(F.col("label") == BLOCK, "block").otherwise("allow")
    return answered.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), by_method).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"),
    )
