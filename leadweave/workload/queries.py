"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.config import ScoreWeights, Settings
from leadweave.functions import email as E, html as H, name as N, text as T, url as U
from leadweave.operators import dedup, enrich, filters, hosts, parse_once, relevance, score
from leadweave.operators.merge import merge_records
from leadweave.plans.lead_run import LandedTables, merged_leads, run, run_and_export
from leadweave.plans.site_store import SiteStore
from leadweave.schema import EXPORT_COLUMNS
from leadweave.session import settle, shared_path
from leadweave.sinks import export
from leadweave.sources import registry, requests, result_pages as R
from leadweave.workload.fixtures import LOCATION, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(c) -> F.Column:
    """A list as one text, so that both engines compare it alike."""
    return F.array_join(c, " ")


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", _joined("sources")) if "sources" in df.columns else df


# --- inputs in lead form -------------------------------------------------------------------------


def _tagged(spark, sf_dir, name) -> DataFrame:
    return table(spark, sf_dir, name).withColumn("sources", F.array("source"))


def _plain_leads(spark, sf_dir, name) -> DataFrame:
    """Every sighting as a lead of its own."""
    leads = _tagged(spark, sf_dir, name).withColumn("lead_id", F.col("seq"))
    for c in ("email", "contact_page"):
        if c not in leads.columns:
            leads = leads.withColumn(c, F.lit(None).cast("string"))
    return leads.withColumn("score", F.lit(0))


def _by_name(spark, sf_dir) -> DataFrame:
    """Sightings merged by name key."""
    records = _plain_leads(spark, sf_dir, "sightings").withColumn("name_key", N.name_key(F.col("company_name")))
    return merge_records(records, "name_key").withColumn("lead_id", F.col("seq"))


def _scored(spark, sf_dir) -> DataFrame:
    return score.scored(_by_name(spark, sf_dir))


# --- scalar columns ------------------------------------------------------------------------------


@_register
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "spellings").select("page_id", U.with_scheme(F.col("website")).alias("url"))


@_register
def site_key(spark, sf_dir):
    c = F.col("website")
    return table(spark, sf_dir, "spellings").select(
        "page_id", U.host(c).alias("host"), U.site_key(c).alias("site"),
        U.site_key(c, legacy=True).alias("legacy_site"), U.is_http_url(c).alias("absolute"), U.site_base(c).alias("base"),
    )


@_register
def norm_name(spark, sf_dir):
    return table(spark, sf_dir, "raw_leads").select("seq", N.name_key(F.col("company_name")).alias("name_key"))


@_register
def location_slug(spark, sf_dir):
    return table(spark, sf_dir, "raw_leads").select("seq", N.location_slug(F.col("company_name")).alias("slug"))


@_register
def email_valid(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("c_custkey", "email", E.is_valid_email(F.col("email")).alias("valid"))


@_register
def email_free(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("c_custkey", "email", E.is_free_email(F.col("email")).alias("free"))


@_register
def email_text(spark, sf_dir):
    found = E.accepted(E.in_text(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "email"))


@_register
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_boilerplate(F.col("text")).alias("cleaned"))


@_register
def truncate(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.cut(c).alias("short"), T.cut_snippet(c).alias("snippet"))


@_register
def valid_leads(spark, sf_dir):
    named = _plain_leads(spark, sf_dir, "sightings").withColumn(
        "company_name", F.when(F.col("seq") % 10 == 0, "").when(F.col("seq") % 10 == 1, " \t").otherwise(F.col("company_name"))
    )
    return filters.valid_leads(named).select("lead_id", "company_name")


# --- sources -------------------------------------------------------------------------------------

_RUN = ["maps", "pj", "google", "maps"]


@_register
def request_table(spark, sf_dir):
    cards = table(spark, sf_dir, "cards").select(F.col("name2").alias("query"), F.concat(F.lit("Île ~*"), "search_term").alias("location"))
    return requests.search_requests(cards)


@_register
def lead_requests(spark, sf_dir):
    return requests.lead_requests(_plain_leads(spark, sf_dir, "raw_leads"), LOCATION)


@_register
def source_select(spark, sf_dir):
    return registry.landed(table(spark, sf_dir, "raw_leads"), _RUN).select("run_pos", "source", "source_rank")


@_register
def union_sources(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_leads").drop("seq")
    frames = [(name, raw.where(F.col("source") == name).drop("source")) for name in _RUN]
    return _text(registry.union_sources(frames)).select("seq", "sources", "company_name", "website")


@_register
def per_source_limit(spark, sf_dir):
    return registry.landed(table(spark, sf_dir, "raw_leads"), _RUN, limit=20).select("run_pos", "source", "source_rank")


@_register
def per_source_limit_large(spark, sf_dir):
    """A limit too large for pruned windows."""
    sightings = table(spark, sf_dir, "sightings").withColumn("source_rank", F.col("seq"))
    return registry.landed(sightings, _RUN, limit=4000).select("run_pos", "source", "source_rank")


@_register
def source_counts(spark, sf_dir):
    tables = LandedTables(crawl=table(spark, sf_dir, "crawl"), raw_leads=table(spark, sf_dir, "raw_leads"))
    return registry.source_counts(registry.discover(tables, Settings(sources=_RUN, limit=None)))


@_register
def source_run(spark, sf_dir):
    """All three sources from landed pages, as one search."""
    one = lambda name: table(spark, sf_dir, name).withColumn("search_term", F.lit(f"agency {LOCATION}"))
    tables = LandedTables(
        crawl=table(spark, sf_dir, "crawl"), feed_pages=one("feed_pages"), place_pages=table(spark, sf_dir, "place_pages"),
        directory_pages=one("directory_pages"), lookup_pages=table(spark, sf_dir, "lookup_pages"), search_pages=one("search_pages"),
    )
    settings = Settings(query="agency", location=LOCATION, sources=["maps", "pj", "google"], limit=None)
    return _text(registry.discover(tables, settings)).select("sources", "company_name", "website", "description", "address")


@_register
def place_urls(spark, sf_dir):
    found = R.place_urls(table(spark, sf_dir, "feed_pages"))
    return found.withColumn("place_order", F.col("place_order.page_no") * (1 << 32) + F.col("place_order.pos"))


@_register
def place_rows(spark, sf_dir):
    return R.place_rows(table(spark, sf_dir, "place_pages"))


@_register
def place_addresses(spark, sf_dir):
    return R.place_addresses(table(spark, sf_dir, "address_pages"), table(spark, sf_dir, "place_pages")).select(
        "search_term", "direct_address", "address"
    )


@_register
def directory_cards(spark, sf_dir):
    return R.directory_cards(table(spark, sf_dir, "directory_pages"))


@_register
def serp_hits(spark, sf_dir):
    return R.search_hits(table(spark, sf_dir, "search_pages"))


@_register
def serp_leads(spark, sf_dir):
    return R.search_leads(table(spark, sf_dir, "search_pages"))


# --- duplicates ----------------------------------------------------------------------------------


@_register
def merge_fields(spark, sf_dir):
    return _text(_by_name(spark, sf_dir)).drop("name_key", "score", "seq")


@_register
def dedup_exact(spark, sf_dir):
    return dedup.duplicate_slots(table(spark, sf_dir, "raw_leads"))


@_register
def dedup_closure(spark, sf_dir):
    return dedup.duplicate_slots(table(spark, sf_dir, "raw_leads"), "closure")


@_register
def host_degrees(spark, sf_dir):
    """Hosts with one in 250 of the websites."""
    return hosts.host_degrees(table(spark, sf_dir, "raw_leads"), least_share=0.004)


@_register
def dedup_ignore_hosts(spark, sf_dir):
    """Hosts of several company names join nothing."""
    sightings = table(spark, sf_dir, "raw_leads")
    ignored = hosts.shared_hosts(sightings, least_names=3, least_share=0.004)
    return dedup.duplicate_slots(sightings, ignore_hosts=ignored)


@_register
def dedup_merge(spark, sf_dir):
    return _text(merged_leads(_tagged(spark, sf_dir, "raw_leads"))).drop("score", "seq")


@_register
def dedup_merge_closure(spark, sf_dir):
    return _text(merged_leads(_tagged(spark, sf_dir, "raw_leads"), "closure")).drop("score", "seq")


# --- score, filters, order -----------------------------------------------------------------------


QUERIES["score"] = lambda spark, sf_dir: _scored(spark, sf_dir).select("lead_id", "score")


# Other points than the usual ones, some below zero.
OTHER_WEIGHTS = ScoreWeights(fields={"website": 5, "description": -1, "address": 3}, business_email=4, free_email=1, several_sources=-2)


@_register
def score_weights(spark, sf_dir):
    """Other points; leads from the given score on, with the highest possible one."""
    leads = score.scored(_by_name(spark, sf_dir), OTHER_WEIGHTS)
    return score.with_min_score(leads, 3, OTHER_WEIGHTS).select("lead_id", "score", F.lit(OTHER_WEIGHTS.most).alias("most"))


@_register
def min_score(spark, sf_dir):
    return score.with_min_score(_scored(spark, sf_dir), 8).select("lead_id", "score")


@_register
def rank_leads(spark, sf_dir):
    return score.ranked(_scored(spark, sf_dir)).select("lead_id", "company_name", "score")


@_register
def only_fields(spark, sf_dir):
    return filters.with_fields(_plain_leads(spark, sf_dir, "sightings"), ["email", "website", "address"]).select("lead_id")


@_register
def junk_domain(spark, sf_dir):
    return _plain_leads(spark, sf_dir, "sightings").select("lead_id", filters.is_junk_site().alias("junk"))


@_register
def junk_domain_table(spark, sf_dir):
    """Sites against a long table of domains, subdomains included."""
    leads = _plain_leads(spark, sf_dir, "sightings")
    return hosts.with_listed_domain(leads, table(spark, sf_dir, "domains")).select("lead_id", "listed")


JUNK_PHRASES = 10_000
OTHER_SITES, OTHER_PARTS = ["lead13.fr", "malt.fr"], ["top soci", "sarl"]


@_register
def junk_phrases(spark, sf_dir):
    """Names against a long list of phrases, all in one pattern."""
    phrases = [f"é {3 * n} s" for n in range(JUNK_PHRASES)]
    return _plain_leads(spark, sf_dir, "sightings").select("lead_id", filters.is_junk_name(phrases).alias("junk"))


@_register
def drop_report_lists(spark, sf_dir):
    """Other lists of junk sites and names, and a table of domains besides."""
    leads = hosts.with_listed_domain(_plain_leads(spark, sf_dir, "sightings"), table(spark, sf_dir, "domains"))
    reason = filters.drop_reason(sites=OTHER_SITES, name_parts=OTHER_PARTS, listed=F.col("listed").isNotNull())
    return filters.drop_report(leads, reason=reason)


@_register
def junk_name(spark, sf_dir):
    return _plain_leads(spark, sf_dir, "sightings").select("lead_id", filters.is_junk_name().alias("junk"))


@_register
def empty_records(spark, sf_dir):
    return _plain_leads(spark, sf_dir, "sightings").where(filters.is_empty_record()).select("lead_id")


@_register
def junk_filter(spark, sf_dir):
    return filters.without_junk(_plain_leads(spark, sf_dir, "sightings")).select("lead_id", "company_name", "website")


@_register
def drop_report(spark, sf_dir):
    return filters.drop_report(_plain_leads(spark, sf_dir, "sightings"))


@_register
def summary_view(spark, sf_dir):
    return export.summary(_scored(spark, sf_dir))


# --- pages ---------------------------------------------------------------------------------------


@_register
def usable_pages(spark, sf_dir):
    return enrich.usable_pages(table(spark, sf_dir, "crawl")).select("url", "status", "content_type")


def _page_text(spark, sf_dir):
    return enrich.with_page_text(table(spark, sf_dir, "crawl"))


@_register
def visible_text(spark, sf_dir):
    return _page_text(spark, sf_dir).select("url", "visible")


def _strategy(name: str):
    def query(spark, sf_dir):
        found = E.accepted(enrich.email_strategies()[name])
        return _page_text(spark, sf_dir).select("url", F.posexplode(found).alias("pos", "email"))

    return query


for _key, _name in [
    ("email_mailto", "link"), ("email_script", "script"), ("email_obfuscated", "spelled_out"),
    ("email_raw_mailto", "raw_link"), ("email_plain", "plain"),
]:
    QUERIES[_key] = _strategy(_name)


@_register
def email_strict(spark, sf_dir):
    """Spelled-out addresses whose marks stand apart; one page in two has one, or a word that looks like one."""
    pages = enrich.with_page_text(table(spark, sf_dir, "spelled_pages"))
    found = E.accepted(E.spelled_out(F.col("visible"), strict=True))
    return pages.select("page_id", F.posexplode(found).alias("pos", "email"))


@_register
def email_all(spark, sf_dir):
    return enrich.page_emails(table(spark, sf_dir, "crawl")).select("url", _joined("emails").alias("emails"))


def _dressed(spark, sf_dir):
    pages = enrich.with_page_text(table(spark, sf_dir, "dressed")).drop("plain_html")
    return pages.drop("scripts", "visible")


@_register
def meta_description(spark, sf_dir):
    return _dressed(spark, sf_dir).select("page_id", H.meta_description(F.col("markup")).alias("meta"))


@_register
def content_block(spark, sf_dir):
    return enrich.with_blocks(_dressed(spark, sf_dir)).select("page_id", "block")


@_register
def description(spark, sf_dir):
    return enrich.with_description(_dressed(spark, sf_dir)).select("page_id", "description")


@_register
def page_features(spark, sf_dir):
    features = enrich.page_features(table(spark, sf_dir, "crawl")).drop("unread")
    return features.withColumn("strategy", F.coalesce("strategy", F.lit(-1)))


@_register
def page_features_once(spark, sf_dir):
    """The same from a landed crawl, each distinct content parsed once."""
    features = parse_once.page_features(settle(table(spark, sf_dir, "crawl"))).drop("unread")
    return features.withColumn("strategy", F.coalesce("strategy", F.lit(-1)))


# --- joins ---------------------------------------------------------------------------------------


@_register
def contact_frontier(spark, sf_dir):
    return enrich.contact_frontier(_plain_leads(spark, sf_dir, "raw_leads"))


@_register
def site_pages(spark, sf_dir):
    return enrich.site_contacts(settle(enrich.page_features(table(spark, sf_dir, "crawl"))))


@_register
def email_best(spark, sf_dir):
    found = _enriched(spark, sf_dir)
    return found.where(T.present(F.col("email"))).select("lead_id", "email")


@_register
def enrich_homepage(spark, sf_dir):
    features = settle(enrich.page_features(table(spark, sf_dir, "crawl")))
    return enrich.lead_pages(_plain_leads(spark, sf_dir, "raw_leads"), features, features).select(
        "lead_id", "url", "home_email", "home_description"
    )


def _old_leads(spark, sf_dir) -> DataFrame:
    old = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("old"), "seq", F.lit("@x.fr")))
    return _plain_leads(spark, sf_dir, "raw_leads").withColumn("email", old).withColumn("contact_page", F.lit("old"))


def _enriched(spark, sf_dir, **settings):
    return enrich.enriched(_old_leads(spark, sf_dir), table(spark, sf_dir, "crawl"), **settings)


ENRICHED = ("lead_id", "website", "email", "description", "contact_page", "address")
QUERIES["enrich"] = lambda spark, sf_dir: _enriched(spark, sf_dir).select(*ENRICHED)


@_register
def enrich_by_site(spark, sf_dir):
    """The same from tables laid out by site."""
    store = SiteStore.create(spark, f"by_site_{uuid.uuid4().hex}")
    store.write_leads(settle(_old_leads(spark, sf_dir)))
    store.write_crawl(table(spark, sf_dir, "crawl"))
    return store.enriched().select(*ENRICHED)


FEW_PATHS, SHORT = ["/team", "/about", "/infos"], 60


@_register
def enrich_settings(spark, sf_dir):
    """Other contact paths and a shorter description."""
    found = _enriched(spark, sf_dir, paths=FEW_PATHS, length=SHORT)
    return found.select("lead_id", "email", "description", "contact_page")


@_register
def website_lookup(spark, sf_dir):
    leads = _plain_leads(spark, sf_dir, "raw_leads")
    return enrich.with_looked_up_site(leads, table(spark, sf_dir, "lookup_hits"), LOCATION).select("lead_id", "website")


@_register
def address_backfill(spark, sf_dir):
    leads = _plain_leads(spark, sf_dir, "raw_leads")
    return enrich.with_backfilled_address(leads, table(spark, sf_dir, "places"), LOCATION).select(
        "lead_id", "address", "address_filled"
    )


# --- relevance and sinks -------------------------------------------------------------------------


@_register
def relevance_requests(spark, sf_dir):
    return relevance.relevance_requests(_by_name(spark, sf_dir), "agence web")


@_register
def relevance_split(spark, sf_dir):
    return relevance.judged(_plain_leads(spark, sf_dir, "sightings"), table(spark, sf_dir, "verdicts")).select("lead_id", "kept")


LEAD_JSON = (
    "company_name string, website string, email string, description string, "
    "contact_page string, address string, sources array<string>, score int"
)


@_register
def export_json(spark, sf_dir):
    path = shared_path(spark, "export-json")
    export.write_json(_scored(spark, sf_dir), path)
    return _text(spark.read.schema(LEAD_JSON).json(path))


@_register
def export_json_array(spark, sf_dir):
    """The lines of the array as written: their marks and the records between them."""
    path = shared_path(spark, "export-json-array")
    export.write_json_array(settle(_scored(spark, sf_dir)), path)
    lines = spark.read.text(path)
    return lines.select(
        F.substring("value", 1, 1).alias("mark"), F.endswith("value", F.lit("}]")).alias("closes"),
        F.regexp_extract("value", r"^.(\{.*\})\]?$", 1).alias("record"),
    )


@_register
def json_records(spark, sf_dir):
    return export.json_record(_scored(spark, sf_dir))


@_register
def export_csv(spark, sf_dir):
    path = shared_path(spark, "export-csv")
    export.write_csv(_scored(spark, sf_dir), path)
    schema = ", ".join(f"{c} string" for c in EXPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


# --- whole runs ----------------------------------------------------------------------------------


def _run_inputs(spark, sf_dir, **settings):
    tables = LandedTables(
        crawl=table(spark, sf_dir, "crawl"), raw_leads=table(spark, sf_dir, "raw_leads"),
        places=table(spark, sf_dir, "places"),
    )
    chosen = Settings(query="agence", location=LOCATION, limit=None, sources=["maps", "pj", "google"], min_score=2, **settings)
    return tables, chosen


def report(spark, sf_dir, mode: str):
    tables, settings = _run_inputs(spark, sf_dir, dedup_mode=mode)
    return _text(run(tables, settings).ranked().select(*EXPORT_COLUMNS))


@_register
def export_run(spark, sf_dir):
    """A run with verdicts, exported by the dispatcher and read back: kept and refused, both formats."""
    tables, settings = _run_inputs(spark, sf_dir, output_dir=shared_path(spark, "export-run"), output_format="both")
    tables.verdicts = table(spark, sf_dir, "lead_verdicts")
    parts = []
    for path in run_and_export(tables, settings):
        kind, refused = path.rsplit(".", 1)[-1], F.lit("_refused" in path)
        if kind == "json":
            rows = spark.read.schema(LEAD_JSON).json(path)
        else:
            rows = spark.read.schema(", ".join(f"{c} string" for c in EXPORT_COLUMNS)).option("header", True).option("escape", '"').csv(path)
        named = rows.select(F.lit(kind).alias("format"), refused.alias("refused"), "company_name", "website", F.col("score").cast("int").alias("score"))
        parts.append(named)
    return reduce(DataFrame.unionByName, parts)


@_register
def lead_report(spark, sf_dir):
    return report(spark, sf_dir, "exact")


@_register
def lead_report_closure(spark, sf_dir):
    return report(spark, sf_dir, "closure")


def best_merged(spark, sf_dir):
    """Merged sightings, scored, best first."""
    return _text(score.ranked(score.scored(merged_leads(_tagged(spark, sf_dir, "sightings"))))).drop("seq")
