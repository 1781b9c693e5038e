"""Joining leads to their crawled pages, looked-up sites and looked-up addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from leadweave.fixed_values import (
    CONTACT_PATHS, DESCRIPTION_LENGTH, LOOKUP_SKIP_PARTS, MAX_CONTACT_PAGES, MIN_BLOCK_LENGTH, MIN_META_LENGTH,
)
from leadweave.functions import email as E, html as H
from leadweave.functions.dom import content_blocks
from leadweave.functions.text import cut, drop_boilerplate, matches_any, present, strip
from leadweave.functions.url import is_http_url, site_base, with_scheme
from leadweave.operators.key_filter import key_filter
from leadweave.operators.skew import hot_keys, hot_keys_of, skew_join
from leadweave.session import settle


# --- what one page holds; all map-only, so HTML is never shuffled --------------------------------


def is_usable() -> Column:
    kind = F.coalesce("content_type", F.lit(""))
    return (F.col("status") == 200) & (F.contains(kind, F.lit("text/html")) | (kind == ""))


def usable_pages(crawl: DataFrame) -> DataFrame:
    return crawl.where(is_usable() & is_http_url(F.col("url")))


def with_page_text(pages: DataFrame, mail_only: bool = False) -> DataFrame:
    """Add ``markup``, ``visible``, ``scripts`` and ``has_link``; each is computed once and used several times.

    ``has_link`` is false for pages that cannot have a mail link; their scripts are left out. With *mail_only* the visible text
    is null where it cannot have an address, so pages without any mark of one are not looked through.
    """
    html = F.coalesce("html", F.lit(""))
    marked = pages.withColumns({"has_link": E.may_hold_link(html), "has_address": E.may_hold_address(html) if mail_only else F.lit(True)})
    texts = marked.withColumns({"markup": H.markup(html), "scripts": F.when(F.col("has_link"), H.script_text(html)).otherwise("")})
    return texts.withColumn("visible", F.when(F.col("has_address"), H.text_of(F.col("markup")))).drop("has_address")


def email_strategies(strict: bool = False) -> dict[str, Column]:
    """Raw candidates by strategy, best strategy first; over :func:`with_page_text`."""
    linked = lambda found: F.when(F.col("has_link"), found).otherwise(F.array().cast("array<string>"))
    return {
        # A link without references is a mail link as it stands or never.
        "link": linked(E.in_links(H.link_targets(F.col("markup"), "(?i)^[\"']?mailto:|&#"))),
        "script": linked(E.in_code(F.col("scripts"))),
        "spelled_out": E.spelled_out(F.col("visible"), strict),
        "raw_link": linked(E.in_code(F.coalesce("html", F.lit("")))),
        "plain": E.in_text(F.col("visible")),
    }


def page_emails(pages: DataFrame, strict: bool = False) -> DataFrame:
    """All accepted addresses of each page in ``emails``, by strategy, then place."""
    found = with_page_text(pages, mail_only=True).withColumn("candidates", F.concat(*email_strategies(strict).values()))
    return found.withColumn("emails", E.accepted(F.col("candidates"))).drop("candidates", "has_link")


def with_blocks(pages: DataFrame) -> DataFrame:
    """Add ``block``: the first content block long enough, else null.

    Elements that patterns can tell are cut out of the markup; the page goes to the tree parser
    only if an earlier element is nested or unclosed, or a role, id or class may name a block.
    """
    tags = ("main", "article", "section")
    flat = pages.withColumns({f"flat_{t}": H.flat_element(F.col("markup"), t) for t in tags})
    flat = flat.withColumns({f"flat_{t}": drop_boilerplate(H.text_of(F.col(f"flat_{t}"))) for t in tags})
    main, article, section = (F.col(f"flat_{t}") for t in tags)
    long = lambda c: F.length(c) > MIN_BLOCK_LENGTH
    clear = main.isNotNull() & (
        long(main)
        | (article.isNotNull() & (
            long(article)
            | (section.isNotNull() & ~H.may_match_attribute_selectors(F.col("markup")))
        ))
    )
    by_pattern = F.when(long(main), main).when(long(article), article).when(long(section), section)
    parsed = flat.withColumn("clear", F.coalesce(clear, F.lit(False))).withColumn(
        "blocks", content_blocks(F.when(~F.col("clear"), H.parsable(F.col("markup"))))
    )
    by_tree = F.get(F.filter(F.transform("blocks", drop_boilerplate), long), F.lit(0))
    unread = ~F.col("clear") & F.col("markup").isNotNull() & F.col("blocks").isNull()
    parsed = parsed.withColumn("unread", F.coalesce(unread, F.lit(False)))
    return parsed.withColumn("block", F.when(F.col("clear"), by_pattern).otherwise(by_tree)).drop(
        "blocks", "clear", "flat_main", "flat_article", "flat_section"
    )


def with_description(pages: DataFrame, length: int = DESCRIPTION_LENGTH) -> DataFrame:
    """Add ``description``: meta text, else content block, else body text, cut to *length*.

    Only pages whose meta text is too short are looked through for blocks; ``unread`` marks those that
    the tree parser gave up on.
    """
    meta = strip(H.meta_description(F.col("markup")))
    told = F.length("meta") > MIN_META_LENGTH
    searched = pages.withColumn("meta", meta).withColumn("whole", F.col("markup")).withColumn(
        "markup", F.when(~told, F.col("markup"))
    )
    described = with_blocks(searched)
    body = F.nullif(drop_boilerplate(H.text_of(H.body_of(F.col("markup")))), F.lit(""))
    text = F.when(told, F.col("meta")).otherwise(F.coalesce("block", body))
    return described.withColumn("description", cut(text, length)).withColumn("markup", F.col("whole")).drop("meta", "block", "whole")


def _candidates(strategy: int, found: Column) -> Column:
    return F.transform(found, lambda c: F.struct(F.lit(strategy).alias("strategy"), E.clean_email(c).alias("email")))


def page_contacts(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Add the best address of each usable page, its strategy (0 is best), and whether the page has HTML."""
    texts = with_page_text(usable_pages(pages).withColumn("has_html", present(F.col("html"))), mail_only=True)
    # One pass of cleaning and judging over the candidates of all strategies.
    tagged = F.concat(*[_candidates(i, found) for i, found in enumerate(email_strategies(strict).values())])
    best = F.get(F.filter(tagged, lambda c: E.is_valid_email(c["email"])), F.lit(0))
    found = texts.withColumn("best", best).drop("html", "visible", "scripts", "has_link")
    return found.withColumns({"email": F.col("best.email"), "strategy": F.col("best.strategy")}).drop("best")


_FEATURES = ("url", "email", "strategy", "description", "has_html", "unread")


def page_features(crawl: DataFrame, length: int = DESCRIPTION_LENGTH, strict: bool = False) -> DataFrame:
    """Per usable URL: best address, its strategy, description, and whether it has HTML."""
    found = with_description(page_contacts(crawl, strict), length)
    return one_per_url(found.select(*_FEATURES))


def one_per_url(features: DataFrame) -> DataFrame:
    """Of a URL crawled several times one page counts: with HTML first, then by best strategy, address and description."""
    order = F.struct(
        ~F.col("has_html"), F.coalesce("strategy", F.lit(99)), F.coalesce("email", F.lit("")), F.coalesce("description", F.lit(""))
    )
    columns = [c for c in features.columns if c != "url"]
    best = features.groupBy("url").agg(F.min_by(F.struct(*columns), order).alias("best"))
    return best.select("url", *[F.col(f"best.{c}").alias(c) for c in columns])


# --- contact pages of a site ---------------------------------------------------------------------


def contact_frontier(leads: DataFrame, paths: Sequence[str] = CONTACT_PATHS) -> DataFrame:
    """The contact-like URLs to request, in order: every lead's site with every path."""
    return (
        leads.where(present(F.col("website")))
        .select("lead_id", site_base(with_scheme(F.col("website"))).alias("base"))
        .where(F.col("base").isNotNull())
        .select("lead_id", "base", F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path"))
        .select("lead_id", "pos", F.concat("base", "path").alias("url"))
    )


def contact_place(url: Column, paths: Sequence[str] = CONTACT_PATHS) -> Column:
    """The place of a URL's path among *paths*, below zero if it is none of them."""
    path = F.substring(url, F.length(site_base(url)) + 1, F.length(url))
    return F.coalesce(F.array_position(F.array(*map(F.lit, paths)), path) - 1, F.lit(-1).cast("long"))


def _contact_pages(features: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The first contact pages of each site, ranked.

    The site and the path are read off the crawled URL, so sites need not be multiplied by paths.
    Features are unique by URL, hence a site has at most one page per path and groups stay small.
    """
    placed = features.where("has_html").select(
        "*", site_base(F.col("url")).alias("base"), contact_place(F.col("url"), paths).alias("pos")
    ).where("pos >= 0")
    rank = F.row_number().over(Window.partitionBy("base").orderBy("pos"))
    return placed.withColumn("rank", rank).where(F.col("rank") <= MAX_CONTACT_PAGES)


def site_contacts(features: DataFrame, paths: Sequence[str] = CONTACT_PATHS) -> DataFrame:
    """Per site: its contact page, how many pages were kept, and the best address on them.

    The contact page comes first; among the others the strategy counts before the page.
    """
    order = F.struct(F.col("rank") > 1, "strategy", "rank")
    return _contact_pages(features, paths).groupBy("base").agg(
        F.min_by("url", "rank").alias("found_page"),
        F.count("*").alias("n_pages"),
        F.min_by("email", F.when(F.col("email").isNotNull(), order)).alias("site_email"),
    )


def with_urls(leads: DataFrame) -> DataFrame:
    """Add ``url`` (the website with scheme), ``base`` (its site) and ``fetch`` (the homepage to read)."""
    url = F.when(present(F.col("website")), with_scheme(F.col("website")))
    return leads.withColumn("url", url).withColumns({
        "base": site_base(F.col("url")), "fetch": F.when(is_http_url(F.col("url")), F.col("url")),
    })


def lead_pages(leads: DataFrame, homes: DataFrame, contacts: DataFrame, paths: Sequence[str] = CONTACT_PATHS) -> DataFrame:
    """Leads with the address and description of their homepage and the contacts of their site.

    *homes* and *contacts* are features of pages, unique by URL. All are read several times: settle
    them first if they are costly.
    """
    keyed = with_urls(leads)
    home = homes.select(
        F.col("url").alias("fetch"), F.col("email").alias("home_email"), F.col("description").alias("home_description")
    )
    hot = hot_keys_of(keyed, ["fetch", "base"])
    joined = skew_join(keyed, home, "fetch", "lead_id", hot=hot["fetch"])
    found = site_contacts(contacts, paths)
    return skew_join(joined, found, "base", "lead_id", hot=hot["base"]).drop("base", "fetch")


def role_pages(leads: DataFrame, crawl: DataFrame, paths: Sequence[str] = CONTACT_PATHS) -> tuple[DataFrame, DataFrame]:
    """The crawled pages that *leads* may use, in one scan, and the list of what they ask for.

    A page's URL alone decides, before any HTML is looked at: ``is_home`` and ``is_contact`` tell whether it may be the
    homepage of a lead, or a contact-like page of a lead's site. The keys are tested by a filter that lets
    a few other pages through, so HTML is neither joined nor moved. The list has ``key`` and
    whether it is a ``home`` (else a site).
    """
    keyed = with_urls(leads).where("url is not null")
    keys = F.array(F.struct(F.col("fetch").alias("key"), F.lit(True).alias("home")), F.struct(F.col("base").alias("key"), F.lit(False).alias("home")))
    asked = settle(keyed.select(F.inline(keys)).where("key is not null").distinct())
    wanted = key_filter(asked.select(_role_key(F.col("home"), F.col("key")).alias("key")))
    contact = contact_place(F.col("url"), paths) >= 0
    tagged = crawl.withColumns({
        "is_home": wanted.may_hold(_role_key(F.lit(True), F.col("url"))),
        "is_contact": F.when(contact, wanted.may_hold(_role_key(F.lit(False), site_base(F.col("url"))))).otherwise(False),
    })
    return tagged.where("is_home or is_contact"), asked


def _role_key(home: Column, key: Column) -> Column:
    """One filter for both kinds of keys."""
    return F.concat(F.when(home, F.lit("h ")).otherwise(F.lit("s ")), key)


def asked_features(
    leads: DataFrame, crawl: DataFrame, paths: Sequence[str] = CONTACT_PATHS, length: int = DESCRIPTION_LENGTH,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Features of the homepages and of the contact-like pages that *leads* use, each unique by URL; from one scan.

    Contact pages are read for addresses only, homepages also for a description.
    """
    pages, asked = role_pages(leads, crawl, paths)
    found = page_contacts(pages, strict)
    # A page that is no homepage has no markup from here on, so nothing looks for its description.
    found = with_description(found.withColumn("markup", F.when(F.col("is_home"), F.col("markup"))), length)
    found = settle(found.select(*_FEATURES, "is_home", "is_contact"))
    homes = asked.where("home").select(F.col("key").alias("url"))
    sites = asked.where("not home").select(F.col("key").alias("base"))
    # What is left has no HTML; now the keys are compared themselves.
    home = found.where("is_home").select(*_FEATURES).join(homes, "url", "left_semi")
    contact = found.where("is_contact").select(*_FEATURES).join(sites, site_base(F.col("url")) == F.col("base"), "left_semi")
    return one_per_url(home), one_per_url(contact.withColumn("description", F.lit(None).cast("string")))


def enriched(
    leads: DataFrame, crawl: DataFrame, paths: Sequence[str] = CONTACT_PATHS, length: int = DESCRIPTION_LENGTH,
    unread: Observation | None = None, strict: bool = False,
) -> DataFrame:
    """Leads with e-mail, description and contact page from their site.

    A lead without website stays as it is; the others get the full URL even if no page was found,
    and lose an earlier contact page. *unread* counts the homepages that could not be parsed.
    """
    homes, contacts = asked_features(leads, crawl, paths, length, strict)
    if unread is not None:
        homes = homes.observe(unread, F.count_if("unread").alias("pages_unread"))
    return with_findings(lead_pages(leads, settle(homes), settle(contacts), paths))


def with_findings(found: DataFrame) -> DataFrame:
    """Put what :func:`lead_pages` found into the leads' own columns."""
    has_site = F.col("url").isNotNull()
    return found.select(
        "lead_id", "company_name",
        F.when(has_site, F.col("url")).otherwise(F.col("website")).alias("website"),
        F.when(has_site, F.coalesce("site_email", "home_email", "email")).otherwise(F.col("email")).alias("email"),
        F.coalesce("home_description", "description").alias("description"),
        F.when(has_site, F.col("found_page")).otherwise(F.col("contact_page")).alias("contact_page"),
        "address", "sources",
        F.when(has_site, F.lit(0)).otherwise(F.col("score")).alias("score"),
        "seq",
    )


# --- look-ups ------------------------------------------------------------------------------------


def lookup_term(location: str) -> Column:
    return F.concat("company_name", F.lit(f" {location}"))


def own_site_hits(hits: DataFrame) -> DataFrame:
    """Per search term, the first hit that is no directory."""
    good = hits.where(~matches_any(F.col("href"), LOOKUP_SKIP_PARTS))
    return good.groupBy("search_term").agg(F.min_by("href", F.struct("page_no", "pos", "href")).alias("found_site"))


def with_looked_up_site(leads: DataFrame, hits: DataFrame, location: str, spread: str = "seq") -> DataFrame:
    """Fill missing websites from search hits."""
    missing = ~present(F.col("website"))
    asked = leads.withColumn("search_term", F.when(missing, lookup_term(location)))
    found = skew_join(asked, own_site_hits(hits), "search_term", spread)
    return found.withColumn("website", F.when(missing, F.col("found_site")).otherwise(F.col("website"))).drop(
        "search_term", "found_site"
    )


def found_addresses(places: DataFrame) -> DataFrame:
    """Per search term, the address shown directly, else that of the first place, if any."""
    direct, listed = strip(F.col("direct_address")), F.nullif(strip(F.col("address")), F.lit(""))
    shown = present(direct)
    return places.groupBy("search_term").agg(
        F.coalesce(
            F.min_by(direct, F.when(shown, F.struct("pos", direct))),
            F.min_by(listed, F.struct("pos", listed)),
        ).alias("found_address")
    )


def needs_address() -> Column:
    return ~present(F.col("address")) & present(strip(F.col("company_name")))


def _asking(leads: DataFrame, location: str) -> DataFrame:
    return leads.withColumn("search_term", F.when(needs_address(), lookup_term(location)))


def with_backfilled_address(
    leads: DataFrame, places: DataFrame, location: str, earlier: DataFrame | None = None
) -> DataFrame:
    """Fill missing addresses; ``address_filled`` tells where.

    *earlier* is a settled frame of the same leads with the same names and addresses, to count on
    when *leads* is costly to read twice.
    """
    asked = _asking(leads, location)
    hot = hot_keys(_asking(leads if earlier is None else earlier, location), "search_term")
    found = skew_join(asked, found_addresses(places), "search_term", "lead_id", hot=hot)
    filled = needs_address() & F.col("found_address").isNotNull()
    return (
        found.withColumn("address_filled", filled)
        .withColumn("address", F.when(F.col("address_filled"), F.col("found_address")).otherwise(F.col("address")))
        .drop("search_term", "found_address")
    )
