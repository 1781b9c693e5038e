"""Page features, joins to pages, result pages, look-ups."""

import re

import pytest
from pyspark.sql import functions as F

from leadweave.functions import email as E, html as H
from leadweave.operators import enrich
from leadweave.schema import CRAWL, LEAD, PLACES
from leadweave.sources import result_pages as R
from leadweave.sources.requests import lead_requests, search_requests
from tests.test_leads import lead

HTML = "text/html; charset=utf-8"


@pytest.fixture(scope="module")
def crawl_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), CRAWL)


def page(url, html, status=200, kind=HTML):
    return (url, status, kind, html)


def test_pages_without_marks_are_skipped_and_no_others(crawl_of):
    """Every way to hide an address: what is skipped has none."""
    pages = [
        '<a href="&#109;ailto:a@x.fr">m</a>', '<a href=MailTo:b@x.fr?subject=s>m</a>', "<a href='mailto:c&#64;x.fr'>m</a>", "<p>d&#64;x.fr</p>",
        "<p>e &#97;t x d&#111;t fr</p>", "<p>f at x dot fr</p>", "<p>datapointing</p>", "<script>'mailto:g@x.fr'</script>", "<!-- mailto:h@x.fr -->",
        "<p>i<b>@</b>x.fr</p>", "<p>no address</p>", "", None, '<a href="/m&#97;il">x</a>', '<a title="j@x.fr" href="mailto:">x</a>', "<p>k&#x40;x.fr &amp; l</p>",
        '<a href="x mailto:l@x.fr">m</a>', "<p>format dots</p>",
    ]
    crawl = crawl_of(*[(f"https://s{i}.fr", 200, "text/html", html) for i, html in enumerate(pages)])
    found = {r["url"]: r["emails"] for r in enrich.page_emails(crawl).collect()}
    everything = F.concat(*[
        E.in_links(H.link_targets(F.col("markup"))), E.in_code(H.script_text(F.coalesce("html", F.lit("")))), E.spelled_out(F.col("visible")),
        E.in_code(F.coalesce("html", F.lit(""))), E.in_text(F.col("visible")),
    ])
    plain = {r["url"]: r["emails"] for r in enrich.with_page_text(crawl).select("url", E.accepted(everything).alias("emails")).collect()}
    assert found == plain
    assert found["https://s0.fr"] == ["a@x.fr"] and found["https://s2.fr"] == ["c@x.fr"] and found["https://s4.fr"] == ["e@x.fr"]
    skipped = enrich.with_page_text(crawl, mail_only=True).where("visible is null and not has_link").collect()
    assert {r["url"] for r in skipped} == {"https://s10.fr", "https://s11.fr", "https://s12.fr"}


def test_usable_pages(crawl_of):
    df = crawl_of(page("http://a.fr", "x"), page("http://b.fr", "x", 404), page("http://c.fr", "x", kind="application/pdf"),
                  page("http://d.fr", "x", kind=""), page("http://e.fr", "x", kind=None), page("http://f.fr", "x", kind="TEXT/HTML"),
                  page("e.fr", "x"))
    assert sorted(r["url"] for r in enrich.usable_pages(df).collect()) == ["http://a.fr", "http://d.fr", "http://e.fr"]


def test_strategy_order(crawl_of):
    html = ('plain@x.fr <i title="mailto:raw@x.fr"></i> spelled [at] x [dot] fr <script>"mailto:code@x.fr"</script>'
            '<a href="mailto:link@x.fr">.</a> PLAIN@x.fr')
    row = enrich.page_emails(crawl_of(page("http://a.fr", html))).first()
    assert row["emails"] == ["link@x.fr", "code@x.fr", "spelled@x.fr", "raw@x.fr", "plain@x.fr"]


BLOCK = "Long enough text of a block that has more than fifty characters in it"


@pytest.mark.parametrize("html,expected", [
    (f"<main>{BLOCK}</main>", BLOCK),
    (f"<main>short</main><article>{BLOCK}</article>", BLOCK),
    (f"<article>{BLOCK}</article><main><main>{BLOCK} A</main> and B</main>", BLOCK + " A and B"),
    (f"<section>no</section><div role=main><div>{BLOCK}</div> end</div>", BLOCK + " end"),
    (f'<div class="a content b"><div class="content">in</div>{BLOCK}</div>', "in " + BLOCK),
    (f'<section>{BLOCK} S</section><p id="content">{BLOCK} P</p>', BLOCK + " P"),
    (f"<section>{BLOCK}", BLOCK),
    ("<main>" + "x" * 50 + "</main>", None), ("<main>" + "x" * 51 + "</main>", "x" * 51),
    (f"<main>{BLOCK}. Accept all. More</main>", BLOCK + ". More"),
    (f"<main>{BLOCK}<script>no</script><style>no</style><!-- no --></main>", BLOCK),
    (f"<div id=main>{BLOCK}<script>no</script>one<!-- no -->two</div>", BLOCK + " one two"),
    ("<p>nothing", None),
])
def test_content_block(spark, html, expected):
    df = enrich.with_page_text(spark.createDataFrame([(html,)], "html string"))
    assert enrich.with_blocks(df).first()["block"] == expected


@pytest.mark.parametrize("html,expected", [
    (f'<meta name="description" content="{"m" * 20}"><main>{BLOCK}</main>', BLOCK),
    (f'<meta name="description" content="{"m" * 21}"><main>{BLOCK}</main>', "m" * 21),
    (f'<meta name="description" content="short"><meta property="og:description" content="{"o" * 30}"><body>rest</body>', "rest"),
    ("<body><p>Only. Cookie. Text</p></body>", "Only. Text"), ("", None), ("<body> </body>", None),
    ('<meta name="description" content="' + "w" * 301 + '">', "w" * 300 + "…"),
])
def test_description(spark, html, expected):
    df = enrich.with_page_text(spark.createDataFrame([(html,)], "html string"))
    assert enrich.with_description(df).first()["description"] == expected


def enrich_rows(spark, crawl, *leads):
    out = enrich.enriched(spark.createDataFrame(list(leads), LEAD), crawl)
    return {r["lead_id"]: r for r in out.collect()}


def test_enrich(spark, crawl_of):
    mail = lambda who: f"<p>{who}@site.fr</p>"
    link = lambda who: f'<a href="mailto:{who}@site.fr">x</a>'
    crawl = crawl_of(
        # a: contact page without address, extra pages: the later page has the better strategy
        page("https://a.fr", mail("home")), page("https://a.fr/contact", "nothing"), page("https://a.fr/about", mail("about")),
        page("https://a.fr/team", link("team")),
        # b: six contact pages, only four count; the homepage is missing
        *[page(f"https://b.fr{p}", "none") for p in ("/contact-us", "/about", "/a-propos", "/equipe")],
        page("https://b.fr/impressum", mail("late")), page("https://b.fr/infos", mail("later")),
        # c: contact page beats homepage; unusable pages do not count
        page("https://c.fr/x", link("home") + f"<main>{BLOCK}</main>"), page("https://c.fr/contact", mail("no"), 404),
        page("https://c.fr/about", mail("about")), page("https://c.fr/legal", ""),
        page("https://d.fr", link("d")),
    )
    got = enrich_rows(
        spark, crawl,
        lead(1, website=" a.fr ", email="old@x.fr", contact_page="old"), lead(2, website="https://b.fr", email="old@x.fr", description="old"),
        lead(3, website="https://c.fr/x", description="old"), lead(4, website=None, contact_page="old", score=4, description=""),
        lead(5, website="ftp://d.fr"), lead(6, website="https://d.fr"), lead(7, website="  ", email="e@x.fr"),
    )
    brief = {i: (r["website"], r["email"], r["contact_page"], r["description"]) for i, r in got.items()}
    assert brief == {
        1: ("https://a.fr", "team@site.fr", "https://a.fr/contact", "home@site. fr"),
        2: ("https://b.fr", "old@x.fr", "https://b.fr/contact-us", "old"),
        3: ("https://c.fr/x", "about@site.fr", "https://c.fr/about", BLOCK),
        4: (None, None, "old", ""),
        5: ("https://ftp://d.fr", None, None, None),
        6: ("https://d.fr", "d@site.fr", None, "x"),
        7: ("", "e@x.fr", None, None),
    }
    assert got[4]["score"] == 4 and got[1]["score"] == 0


def test_only_usable_pages_of_leads_are_read(spark, crawl_of):
    """A site's other pages are left alone, however many they are."""
    crawl = crawl_of(page("https://a.fr/x", "1"), page("https://a.fr/contact", "2"), page("https://b.fr", "3"),
                     page("https://b.fr/contact", "4"), *[page(f"https://a.fr/blog/{i}", "no") for i in range(50)])
    leads = spark.createDataFrame([lead(1, website="a.fr/x"), lead(2), lead(3, website="c.fr")], LEAD)
    pages, asked = enrich.role_pages(leads, crawl)
    assert {(r["key"], r["home"]) for r in asked.collect()} == {
        ("https://a.fr/x", True), ("https://a.fr", False), ("https://c.fr", True), ("https://c.fr", False)}
    assert {(r["html"], r["is_home"], r["is_contact"]) for r in pages.collect()} == {("1", True, False), ("2", False, True)}
    assert enrich.role_pages(leads.where("lead_id = 2"), crawl)[0].count() == 0
    some = enrich.role_pages(leads, crawl, ["/blog/7"])[0]
    assert [r["html"] for r in some.where("is_contact").collect()] == ["no"]
    homes, contacts = enrich.asked_features(leads, crawl)
    assert [r["url"] for r in homes.collect()] == ["https://a.fr/x"] and [r["url"] for r in contacts.collect()] == ["https://a.fr/contact"]


def test_html_is_read_by_one_scan_and_never_moved(spark, crawl_of, tmp_path):
    crawl_of(*[page(f"https://s{i}.fr{p}", f"<p>m{i}@s{i}.fr</p>") for i in range(30) for p in ("", "/contact", "/x")]).write.parquet(f"{tmp_path}/crawl")
    leads = spark.createDataFrame([lead(i, website=f"s{i}.fr") for i in range(30)], LEAD)
    pages, _ = enrich.role_pages(leads, spark.read.parquet(f"{tmp_path}/crawl"))
    read = enrich.with_description(enrich.page_contacts(pages), 100).select("url", "email", "description")
    plan = read._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Subquery")[0]
    assert len(set(re.findall(r"FileScan parquet \[[^\]]*html#(\d+)", plan))) == 1 and plan.count("html#") > 0
    assert "Exchange" not in above and "Join" not in above
    assert read.count() == 60


def test_repeated_pages_do_not_multiply(spark, crawl_of):
    crawl = crawl_of(
        page("https://a.fr", "<p>one@a.fr</p>"), page("https://a.fr", '<a href="mailto:two@a.fr">x</a>'), page("https://a.fr", ""),
        *[page("https://a.fr/contact", "nothing")] * 5, page("https://a.fr/about", "<p>about@a.fr</p>"),
    )
    row = enrich_rows(spark, crawl, lead(1, website="https://a.fr"))
    assert len(row) == 1 and row[1]["email"] == "about@a.fr" and row[1]["contact_page"] == "https://a.fr/contact"
    features = enrich.page_features(crawl).where("url = 'https://a.fr'").collect()
    assert [f["email"] for f in features] == ["two@a.fr"]


BROKEN = "<![foo[ x ]]>"


def test_broken_pages_do_not_fail(spark, crawl_of):
    from pyspark.sql import Observation

    crawl = crawl_of(page("https://a.fr", BROKEN + f"<div role=main><div>{BLOCK}</div> end</div>"))
    seen = Observation("pages")
    out = enrich.enriched(spark.createDataFrame([lead(1, website="https://a.fr")], LEAD), crawl, unread=seen)
    assert out.first()["description"] == BLOCK + " end"
    assert seen.get["pages_unread"] == 0
    html = '<a href="http://[x"><h3>t</h3></a><a href="https://b.fr"><h3>B</h3></a>' + BROKEN
    pages = spark.createDataFrame([("s", 0, "https://g.fr", html), ("s", 1, "http://[", html), ("s", 2, None, None)],
                                  "search_term string, page_no int, url string, html string")
    assert [r["website"] for r in R.search_leads(pages).collect()] == ["https://b.fr", "https://b.fr"]


def test_a_page_that_the_parser_gives_up_on_is_null():
    from leadweave.functions import dom

    class Odd(str):
        def __len__(self):
            raise RuntimeError

    assert dom._blocks(Odd("<p>")) is None and dom._blocks(None) is None and dom._items("<li><h2>a</h2>") != []


def test_place_addresses(spark):
    feed = spark.createDataFrame([
        ("a", 0, "https://m.fr/search/x", '<button data-item-id="address"><i class="fontBodyMedium"> 1 rue </i></button>'),
        ("b", 0, "https://m.fr/search/x", '<a href="/maps/place/1">x</a><a href="/maps/place/2">y</a>'),
        ("c", 0, "https://m.fr/search/x", '<a href="https://m.fr/maps/place/3">x</a>'), ("d", 0, None, "<p>nothing"),
    ], "search_term string, page_no int, url string, html string")
    places = spark.createDataFrame([
        ("https://m.fr/maps/place/1", "<h1>one</h1>"), ("https://m.fr/maps/place/2", '<b data-item-id="address">no</b>'),
        ("https://m.fr/maps/place/3", "<h1>z</h1>"), ("https://m.fr/maps/place/3", '<b data-item-id="address">3 rue</b>'),
    ], "url string, html string")
    got = {r["search_term"]: (r["direct_address"], r["address"]) for r in R.place_addresses(feed, places).collect()}
    assert got == {"a": ("1 rue", None), "b": (None, None), "c": (None, "3 rue"), "d": (None, None)}



def test_contact_frontier_order(spark):
    df = spark.createDataFrame([lead(1, website="a.fr/x"), lead(2), lead(3, website=" ")], LEAD)
    rows = enrich.contact_frontier(df).orderBy("pos").collect()
    assert len(rows) == 18 and rows[0]["url"] == "https://a.fr/contact" and rows[17]["url"] == "https://a.fr/infos"


def test_backfill(spark):
    leads = spark.createDataFrame([lead(1, "A"), lead(2, "B", address="kept"), lead(3, "C", address=""), lead(4, "D"), lead(5, " "), lead(6, "E")], LEAD)
    places = spark.createDataFrame([
        ("A Lyon", None, 1, "first"), ("A Lyon", None, 2, "second"), ("B Lyon", None, 1, "no"), ("C Lyon", None, 1, None),
        ("C Lyon", None, 2, "second"), ("D Lyon", " direct ", None, None), ("D Lyon", None, 1, "feed"), ("  Lyon", None, 1, "no"),
    ], PLACES)
    got = {r["lead_id"]: (r["address"], r["address_filled"]) for r in enrich.with_backfilled_address(leads, places, "Lyon").collect()}
    assert got == {1: ("first", True), 2: ("kept", False), 3: ("", False), 4: ("direct", True), 5: (None, False), 6: (None, False)}


def test_website_lookup(spark):
    leads = spark.createDataFrame([lead(1, "A"), lead(2, "B", website="https://own.fr"), lead(3, "C")], LEAD)
    hits = spark.createDataFrame([
        ("A Lyon", 0, 0, "https://www.yelp.fr/a"), ("A Lyon", 0, 2, "https://late.fr"), ("A Lyon", 0, 1, "https://a.fr/annuaire"),
        ("A Lyon", 1, 0, "https://later.fr"), ("B Lyon", 0, 0, "https://b.fr"), ("C Lyon", 0, 0, "https://www.google.fr"),
    ], "search_term string, page_no int, pos int, href string")
    got = {r["lead_id"]: r["website"] for r in enrich.with_looked_up_site(leads, hits, "Lyon").collect()}
    assert got == {1: "https://late.fr", 2: "https://own.fr", 3: None}


# --- result pages ------------------------------------------------------------------------------------


def test_place_urls(spark):
    feed = '<a href="https://m/maps/place/{0}">a</a><a href="https://m/maps/place/{1}">b</a><a href="https://other">c</a>'
    pages = spark.createDataFrame([("s", 1, feed.format("B", "C")), ("s", 0, feed.format("A", "B"))], "search_term string, page_no int, html string")
    rows = R.place_urls(pages).orderBy("place_order").collect()
    assert [r["url"][-1] for r in rows] == ["A", "B", "C"]


def test_place_rows(spark):
    rows = [
        ("u1", '<h1>Second</h1><h1 class="DUwDvf"> First </h1><div data-item-id="address"> </div><button aria-label="Adresse : x">'
               '<i class="fontBodyMedium">1 rue</i></button><a data-item-id="authority" href="/x">w</a><a aria-label="Open website" href="http://w.fr">w</a>'),
        ("u2", "<h1> </h1><h2>x</h2>"), ("u3", '<h1 data-attrid="title">T</h1><button data-item-id="address">icon <b class="fontBodyMedium">2 rue</b></button>'),
    ]
    got = {r["url"]: (r["company_name"], r["address"], r["website"]) for r in R.place_rows(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"u1": ("First", "1 rue", "http://w.fr"), "u3": ("T", "2 rue", None)}


def test_directory_cards(spark):
    html = ("<ul><li><h3><a href=x>Alpha</a></h3><p class='my-adresse-x'>1  rue <a>Voir</a>\n Lyon</p><address>no</address></li>"
            "<li><h2>Alpha</h2></li><li><h2>B</h2></li><li><h3>Beta</h3><div class=address> </div></li><li>none</li></ul>")
    pages = spark.createDataFrame([("s", 1, html), ("s", 2, html)], "search_term string, page_no int, html string")
    rows = R.directory_cards(pages).orderBy("page_no", "pos").collect()
    assert [(r["page_no"], r["pos"], r["name"], r["address"]) for r in rows] == [
        (p, i, n, a) for p in (1, 2) for i, (n, a) in enumerate([("Alpha", "1 rue Lyon"), ("Beta", None)])]


def hit(href, title, snippet=""):
    return f'<div class="g"><a href="{href}"><div><h3>{title}</h3></div></a><span class="VwiC3b">{snippet}</span></div>'


def serp(spark, *pages):
    rows = [("s", n, "https://www.google.fr/search?q=x", "".join(hits)) for n, hits in enumerate(pages)]
    return spark.createDataFrame(rows, "search_term string, page_no int, url string, html string")


def test_search_hits(spark):
    pages = serp(spark, [hit("https://a.fr", "A &amp; <b>b</b>", "note"), "<h3>none</h3>", hit("https://maps.google.com/x", "G"),
                         hit("/url?q=https://b.fr", "Q"), hit("/x?url=https://b.fr", "R"), hit("mailto:x@y.fr", "M")])
    rows = [(r["pos"], r["href"], r["title"], r["snippet"]) for r in R.search_hits(pages).orderBy("pos").collect()]
    assert rows == [(0, "https://a.fr", "A & b", "note"), (1, "https://www.google.fr/x?url=https://b.fr", "R", "")]


def test_search_leads(spark):
    long = "word, " * 60
    pages = serp(
        spark,
        [hit("https://www.a.fr/1", "A - Site Officiel", long), hit("https://a.fr/2", "A2"), hit("https://fr.linkedin.com/x", "L"),
         hit("https://netflix.com", "N | ACCUEIL"), hit("https://b.fr", " "), hit("https://c.fr", "C - accueil | bienvenue")],
        [hit("https://a.fr/3", "A3 – site officiel"), hit("https://d.fr", "D | Bienvenue | Accueil")],
    )
    got = [(r["page_no"], r["pos"], r["company_name"], r["website"]) for r in R.search_leads(pages).orderBy("page_no", "pos").collect()]
    assert got == [
        (0, 0, "A", "https://www.a.fr/1"), (0, 1, "N", "https://netflix.com"), (0, 2, "C - accueil", "https://c.fr"),
        (1, 0, "A3", "https://a.fr/3"), (1, 1, "D", "https://d.fr"),
    ]
    first = R.search_leads(pages).where("company_name = 'A'").first()["description"]
    assert len(first) <= 301 and first.endswith("word,…")
    legacy = {r["company_name"] for r in R.search_leads(pages, legacy_hosts=True).collect()}
    assert "N" not in legacy


def test_requests(spark):
    rows = search_requests(spark.createDataFrame([("agence web", "Île de Ré")], "query string, location string")).collect()
    urls = {r["source"]: r["url"] for r in rows}
    assert urls["maps"] == "https://www.google.com/maps/search/agence+web+%C3%8Ele+de+R%C3%A9"
    assert "quoiqui=agence+web&ou=ile-de-re&" in urls["pj"] and urls["google"].startswith("https://www.google.fr/search?q=agence+web+")
    lookup = lead_requests(spark.createDataFrame([lead(1, "A b")], LEAD), "Lyon").first()
    assert lookup["lookup_url"] == "https://www.google.fr/search?q=A+b+Lyon&num=5&hl=fr"
