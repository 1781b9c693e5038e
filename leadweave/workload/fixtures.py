"""Inputs of the registered queries, derived from the given tables.

Each recipe is SQL that Spark and the checking engine both run, over whole tables. ``{name}`` stands
for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadweave.fixed_values import CONTACT_PATHS
from leadweave.session import fan_out

LOCATION = "Bordeaux"

# Sightings of three sources. Accents, dashes and legal forms must fold for maps and pj to meet;
# every seventh supplier borrows its neighbour's name.
RAW_LEADS = """
SELECT CAST(s_suppkey AS BIGINT) AS seq, 'maps' AS source, CAST(s_suppkey + 1 AS BIGINT) AS source_rank,
       'Agence ' || (s_suppkey - CASE WHEN s_suppkey % 7 = 0 AND s_suppkey > 0 THEN 1 ELSE 0 END) || ' SARL' AS company_name,
       url AS website, CAST(NULL AS STRING) AS description,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name || ', ' || n_name END AS address
FROM {supplier} LEFT JOIN {pages} ON page_id = s_suppkey JOIN {nation} ON n_nationkey = s_nationkey
UNION ALL
SELECT CAST(1000000 + c_custkey AS BIGINT), 'pj', CAST(c_custkey + 1 AS BIGINT), 'AGÉNCE-' || c_custkey, NULL, NULL,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
UNION ALL
SELECT CAST(2000000 + page_id AS BIGINT), 'google', CAST(page_id + 1 AS BIGINT), regexp_extract(html, '<title>(.*?)</title>', 1), url,
       'Page ' || page_id || ' ' || regexp_extract(html, '<title>(.*?)</title>', 1), NULL
FROM {pages}
"""

# Crawled pages: homepages, some missing or of another type, and contact-like pages with one form
# of e-mail each.
CRAWL = """
SELECT url, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status,
       CASE WHEN page_id % 19 = 0 THEN 'application/pdf' WHEN page_id % 23 = 0 THEN '' ELSE 'text/html; charset=utf-8' END AS content_type, html
FROM {pages}
UNION ALL
SELECT c.url, 200, 'text/html',
       CASE p.page_id % 5
         WHEN 0 THEN '<a href="mailto:Contact@site' || p.page_id || '.fr?subject=x">mail</a>'
         WHEN 1 THEN '<script>var m="mailto:js@site' || p.page_id || '.fr";</script>'
         WHEN 2 THEN '<p>info [at] site' || p.page_id || ' [dot] fr</p>'
         WHEN 3 THEN '<p>lead' || p.page_id || '@gmail.com</p>'
         ELSE '<p>votre.email@example.com</p>' END || p.html
FROM (
  SELECT url, min(page_id) AS page_id FROM (
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1)
           || split_part('""" + ",".join(CONTACT_PATHS) + """', ',', CAST((page_id * 5) % 18 + 1 AS INT)) AS url
    FROM {pages}) a
  GROUP BY url) c
JOIN {pages} p ON p.page_id = c.page_id
UNION ALL
SELECT url, 200, 'text/html', '<![foo[ x ]]><p>second@copy' || page_id || '.fr</p>' || html FROM {pages} WHERE page_id % 29 < 2
UNION ALL
SELECT url || '/blog/' || page_id, 200, 'text/html', html FROM {pages}
"""

# Sightings by order; all sightings of a customer are one company.
SIGHTINGS = """
SELECT o_orderkey AS seq,
       CASE o_orderkey % 3 WHEN 0 THEN 'maps' WHEN 1 THEN 'pj' ELSE 'google' END AS source,
       CASE WHEN o_custkey % 13 = 0 THEN 'Top ' ELSE '' END ||
       CASE o_orderkey % 4 WHEN 0 THEN 'Société ' || o_custkey || ' SARL' WHEN 1 THEN 'SOCIETE ' || o_custkey
                           WHEN 2 THEN 'société-' || o_custkey ELSE 'Societe  ' || o_custkey || ', Ltd' END AS company_name,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'https://lead' || o_custkey || '.malt.fr/'
            ELSE 'https://www.lead' || o_custkey || '.fr/' END AS website,
       CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 5 < 4 THEN 'contact@lead' || o_custkey || '.fr'
            ELSE 'lead' || o_custkey || '@gmail.com' END AS email,
       repeat(o_orderstatus, CAST(o_orderkey % 40 AS INT)) AS description,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Rue ' || (o_orderkey % 50) END AS address,
       o_custkey AS owner
FROM {orders}
"""

# Candidate e-mail addresses, good and bad.
CANDIDATES = """
SELECT c_custkey, CASE c_custkey % 10
    WHEN 0 THEN 'contact@lead' || c_custkey || '.fr' WHEN 1 THEN 'INFO@Lead' || c_custkey || '.COM'
    WHEN 2 THEN 'votre.email@lead' || c_custkey || '.fr' WHEN 3 THEN 'x' || c_custkey || '@example.com'
    WHEN 4 THEN 'logo' || c_custkey || '@2x.png' WHEN 5 THEN 'yourcompanyteam@lead' || c_custkey || '.fr'
    WHEN 6 THEN 'bad@host' || c_custkey WHEN 7 THEN 'lead' || c_custkey || '@Gmail.com'
    WHEN 8 THEN 'a@b@free.fr' ELSE 'x' || c_custkey || '@mail1.example.com' END AS email
FROM {customer}
"""

# Website spellings.
SPELLINGS = """
SELECT page_id, CASE page_id % 6
    WHEN 0 THEN '  ' || regexp_replace(url, '^https?://', '') || ' ' WHEN 1 THEN 'HTTP' || regexp_replace(url, '^https?', '')
    WHEN 2 THEN '' WHEN 3 THEN regexp_replace(url, '://', '://USER@WWW.') ELSE url END AS website
FROM {pages}
"""

# Pages with meta descriptions and with the main content under several elements.
DRESSED = """
SELECT page_id, url, page_id % 5 AS meta_kind, page_id % 9 AS block_kind, replace(replace(replace(html, '</head>',
    CASE page_id % 5
      WHEN 0 THEN '<meta name="description" content="About &eacute;tudes and more, number ' || page_id || '">'
      WHEN 1 THEN '<META content=''Preview text for page number ' || page_id || ''' property=''og:description''>'
      WHEN 2 THEN '<meta name="description" content="short"><meta property="og:description" content="long enough to be used here">'
      ELSE '' END || '</head>'),
    '<article>',
    CASE page_id % 9
      WHEN 0 THEN '<main>' WHEN 1 THEN '<div role="main"><div>' WHEN 2 THEN '<div id=content><div>'
      WHEN 3 THEN '<div class="box content"><div>' WHEN 4 THEN '<div class="main-content"><div>'
      WHEN 5 THEN '<div id="main"><div>' WHEN 6 THEN '<section>' WHEN 7 THEN '<article><article>' ELSE '<article>' END),
    '</article>',
    CASE page_id % 9 WHEN 0 THEN '</main>' WHEN 6 THEN '</section>' WHEN 7 THEN '</article></article>' WHEN 8 THEN '</article>'
      ELSE '</div></div>' END) AS html, html AS plain_html
FROM {pages}
"""

# Landed result pages. The hits and cards in them are plain columns of HITS, CARDS and PLACES_SEEN.
HITS = """
SELECT page_id, 'search ' || (page_id % 7) AS search_term, page_id AS page_no, url AS href1,
       regexp_extract(html, '<title>(.*?)</title>', 1) || CASE page_id % 4 WHEN 0 THEN ' - Site Officiel' WHEN 1 THEN ' | ACCUEIL' ELSE '' END AS title1,
       'Page ' || page_id || ' ' || substring(regexp_replace(regexp_extract(html, '<footer>(.*?)</footer>', 1), '&[a-z]+;', ''), 1, 20) || ' '
         || CASE WHEN page_id % 3 = 0 THEN repeat('mot, ', 70) ELSE '' END || 'fin.' AS snippet1,
       CASE page_id % 3 WHEN 0 THEN 'https://fr.linkedin.com/company/' || page_id WHEN 1 THEN url || '#again' ELSE 'https://netflix.com/' || page_id END AS href2,
       'https://www.google.fr/maps/' || page_id AS href3
FROM {pages}
"""
SEARCH_PAGES = """
SELECT page_id, search_term, page_no, 'https://www.google.fr/search?q=x' AS url,
  '<html><body><div class="g"><div><a href="' || href1 || '"><h3>' || title1 || '</h3></a></div><div class="VwiC3b"><span>' || snippet1 || '</span></div></div>'
  || '<div data-hveid="x"><a href=''' || href2 || '''><br><h3> Second <b>' || page_id || '</b></h3></a></div>'
  || '<div><a href="' || href3 || '"><h3>Maps</h3></a></div><h3>No link</h3><div><a href="/settings"><h3>Own</h3></a></div><a href="http://[x"><h3>Bad</h3></a></body></html>' AS html
FROM {hits}
"""
CARDS = """
SELECT c_custkey AS page_no, 'plumber ' || n_name AS search_term, c_name AS name1,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey || ' rue ' || n_name END AS address1,
       'Shop & Son ' || c_custkey AS name2
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
"""
DIRECTORY_PAGES = """
SELECT search_term, page_no,
  '<ul><li><h3><a href="#">' || name1 || '</a></h3>' || coalesce('<div class="x-address">' || address1 || '<a href="#">Voir le plan</a></div>', '<div></div>')
  || '</li><li><h2>  ' || replace(name2, '&', '&amp;') || ' </h2><address>at  <b>home</b>' || chr(10) || '</address></li>'
  || '<li><h3>' || name1 || '</h3><address>again</address></li><li>no heading</li><li><h3>x</h3></li></ul>' AS html
FROM {cards}
"""
PLACES_SEEN = """
SELECT s_suppkey AS place_no, 'agency ' || n_name AS search_term, 'https://www.google.com/maps/place/' || s_suppkey AS url, s_name AS name,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey || ' avenue ' || n_name END AS address,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'https://supplier' || s_suppkey || '.fr/' END AS website
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
"""
FEED_PAGES = """
SELECT search_term, place_no AS page_no,
  '<div role="feed"><a href="' || url || '">one</a><a href="https://other.fr/">no</a><a href="' || url || '">again</a>'
  || '<a href="/maps/place/' || (place_no - 1) || '">two</a></div>' AS html, 'https://www.google.com/maps/search/x' AS url
FROM {places_seen}
"""
PLACE_PAGES = """
SELECT url,
  '<h1> </h1>' || CASE WHEN place_no % 6 = 0 THEN '<h2>nameless</h2>' ELSE '<h1 class="DUwDvf x">' || name || '</h1>' END
  || CASE place_no % 2 WHEN 0 THEN coalesce('<button aria-label="Adresse: x"><div><span class="fontBodyMedium"> ' || address || ' </span></div></button>', '')
       ELSE coalesce('<button data-item-id="address"><i>pin</i><div class="fontBodyMedium">' || address || '</div></button>', '') END
  || CASE place_no % 3 WHEN 0 THEN coalesce('<a data-item-id="authority" href="' || website || '">s</a>', '')
       ELSE '<a data-item-id="authority" href="/local">l</a>' || coalesce('<a aria-label="Visiter le site web" href="' || website || '">s</a>', '') END AS html
FROM {places_seen}
UNION ALL
SELECT url, '<h1>Another page</h1>' FROM {places_seen} WHERE place_no % 8 = 0
"""

# Map searches for single places: some show the place itself, the others a list.
ADDRESS_PAGES = """
SELECT name || ' {location}' AS search_term, 0 AS page_no, 'https://www.google.com/maps/search/x' AS url,
  CASE WHEN place_no % 3 = 0 THEN '<h1>x</h1><button data-item-id="address"><b class="fontBodyMedium"> direct ' || place_no || ' </b></button>'
       ELSE '<div role="feed"><a href="/maps/place/' || place_no || '">one</a><a href="/maps/place/' || (place_no + 1) || '">two</a></div>' END AS html
FROM {places_seen}
"""

# Look-up results: own sites behind directory hits, and addresses of first places.
LOOKUP_HITS = """
SELECT company_name || ' {location}' AS search_term, 0 AS page_no, 0 AS pos, 'https://www.pagesjaunes.fr/pros/' || source_rank AS href
FROM {raw_leads} WHERE source = 'pj'
UNION ALL
SELECT company_name || ' {location}', 0, 1, CASE WHEN source_rank % 3 = 0 THEN 'https://www.yelp.fr/biz/' ELSE 'https://www.agence' END || source_rank || '.fr/'
FROM {raw_leads} WHERE source = 'pj'
UNION ALL
SELECT company_name || ' {location}', 1, 0, CASE WHEN source_rank % 2 = 0 THEN 'https://www.societe.com/' ELSE 'https://late' END || source_rank || '.fr/'
FROM {raw_leads} WHERE source = 'pj'
"""
PLACES = """
SELECT company_name || ' {location}' AS search_term, CAST(NULL AS STRING) AS direct_address, 1 AS pos,
       CASE WHEN source_rank % 5 = 0 THEN NULL ELSE source_rank || ' quai ' || source END AS address
FROM {raw_leads} WHERE source <> 'google'
UNION ALL
SELECT company_name || ' {location}', NULL, 2, 'second ' || source_rank FROM {raw_leads} WHERE source <> 'google'
UNION ALL
SELECT company_name || ' {location}', CASE WHEN source_rank % 7 = 0 THEN ' direct ' || source_rank || ' ' END, 3, NULL
FROM {raw_leads} WHERE source <> 'google'
"""

VERDICTS = """
SELECT seq AS lead_key, CASE seq % 6 WHEN 0 THEN ' Oui.' WHEN 1 THEN 'yes' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'OUI, tout à fait' ELSE 'non' END AS answer,
       CASE WHEN seq % 9 = 0 THEN 'timeout' END AS error
FROM {sightings} WHERE email IS NOT NULL
UNION ALL
SELECT seq, 'non', NULL FROM {sightings} WHERE email IS NOT NULL AND seq % 8 = 0
"""
# Keyed by the arrival order of a run over maps, pj and google.
LEAD_VERDICTS = """
SELECT CASE source WHEN 'maps' THEN 0 WHEN 'pj' THEN 1 ELSE 2 END * 4503599627370496 + source_rank AS lead_key, seq AS first_seq, CASE seq % 3 WHEN 0 THEN 'Oui' WHEN 1 THEN 'non' END AS answer, CASE WHEN seq % 3 = 2 THEN 'timeout' END AS error
FROM {raw_leads}
"""

# Look-up result pages for the names on directory cards.
LOOKUP_PAGES = """
SELECT c.name1 || ' {location}' AS search_term, s.page_no, s.url, s.html
FROM {cards} c JOIN {search_pages} s ON s.page_id = c.page_no
"""

# Listed domains: some are sites of sightings, some lie above them, most are neither.
DOMAINS = """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'lead' || o_orderkey || '.fr' WHEN 1 THEN ' Lead' || o_orderkey || '.MALT.fr' ELSE 'x.y' || o_orderkey || '.com' END AS domain
FROM {orders} UNION ALL SELECT 'malt.fr' UNION ALL SELECT '' UNION ALL SELECT CAST(NULL AS STRING)
"""

# Spelled-out addresses: set off by brackets or white space, or read out of plain words.
SPELLED_PAGES = """
SELECT page_id, CASE page_id % 6
    WHEN 0 THEN '<p>info' || page_id || ' [at] site' || page_id || '[dot]fr</p>' WHEN 1 THEN '<p>some datapointing words</p>'
    WHEN 2 THEN '<p>sales' || page_id || ' at site dot co dot uk</p>' WHEN 3 THEN '<p>call(arobase) site (point) fr</p>'
    WHEN 4 THEN '<p>format site' || page_id || 'dotfr</p>' ELSE '' END || html AS html
FROM {pages}
"""

RECIPES = {
    "raw_leads": RAW_LEADS, "crawl": CRAWL, "sightings": SIGHTINGS, "candidates": CANDIDATES,
    "spellings": SPELLINGS, "dressed": DRESSED, "hits": HITS, "search_pages": SEARCH_PAGES, "cards": CARDS,
    "directory_pages": DIRECTORY_PAGES, "places_seen": PLACES_SEEN, "feed_pages": FEED_PAGES,
    "place_pages": PLACE_PAGES, "lookup_hits": LOOKUP_HITS, "places": PLACES, "verdicts": VERDICTS,
    "lead_verdicts": LEAD_VERDICTS, "address_pages": ADDRESS_PAGES, "lookup_pages": LOOKUP_PAGES, "domains": DOMAINS,
    "spelled_pages": SPELLED_PAGES,
}
GIVEN = ["supplier", "customer", "nation", "orders", "pages", "documents"]
# Landed pages are built from each row of these. The rows are short, so a scan has one split for millions of pages.
DEALT = {"cards": "customer", "places_seen": "supplier"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    recipe = RECIPES[name].replace("{location}", LOCATION)
    inputs = {n: table(spark, sf_dir, n) for n in [*GIVEN, *RECIPES] if "{%s}" % n in recipe}
    if name in DEALT:
        inputs[DEALT[name]] = inputs[DEALT[name]].repartition(fan_out(spark))
    return spark.sql(recipe, **inputs)


def recipe_sql(name: str) -> str:
    """A derived table as SQL over plain table names."""
    recipe = RECIPES[name].replace("{location}", LOCATION)
    for other in [*GIVEN, *RECIPES]:
        recipe = recipe.replace("{%s}" % other, other)
    return recipe.strip()


def inputs_of(name: str) -> list[str]:
    return [n for n in RECIPES if "{%s}" % n in RECIPES[name]]
