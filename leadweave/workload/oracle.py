"""The registered queries as SQL for the checking engine. Plain rules, small tables, no scale."""

from __future__ import annotations

from leadweave import fixed_values as V
from leadweave.workload.fixtures import LOCATION, RECIPES, inputs_of, recipe_sql
from leadweave.workload.queries import FEW_PATHS, JUNK_PHRASES, OTHER_PARTS, OTHER_SITES, OTHER_WEIGHTS, SHORT


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(p)})" for p in parts) + ")"


# --- scalar rules ----------------------------------------------------------------------------------


def name_key(c):
    tokens = rf"string_split_regex(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}_]+')"
    return (f"trim(regexp_replace(array_to_string(list_filter({tokens}, lambda t: t NOT IN {_list(V.LEGAL_FORMS)}), ' '), "
            f"'[ _]+', ' ', 'g'))")


def host(c):
    return rf"nullif(regexp_extract({c}, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '')"


def site_key(c):
    return rf"nullif(regexp_replace(lower({host(c)}), '^www\.', ''), '')"


def with_scheme(c):
    return f"CASE WHEN trim({c}) = '' OR regexp_matches(trim({c}), '^https?://') THEN trim({c}) ELSE 'https://' || trim({c}) END"


def site_base(c):
    return f"nullif(regexp_extract({c}, '^(https?://[^/?#]+)', 1), '')"


def email_valid(c):
    local, domain = f"split_part(lower({c}), '@', 1)", f"split_part(lower({c}), '@', 2)"
    image = "|".join(e.replace(".", r"\.") for e in V.IMAGE_ENDINGS)
    return (rf"(regexp_full_match({c}, {_q(V.ADDRESS)}) AND {domain} NOT IN {_list(V.PLACEHOLDER_EMAIL_DOMAINS + V.BARE_EMAIL_DOMAINS)} "
            rf"AND {local} NOT IN {_list(V.PLACEHOLDER_LOCALS)} AND NOT {_any(local, V.PLACEHOLDER_LOCAL_PARTS)} "
            rf"AND NOT regexp_matches(lower({c}), '({image})$'))")


def email_free(c):
    return f"(coalesce({c}, '') <> '' AND contains({c}, '@') AND lower(string_split({c}, '@')[-1]) IN {_list(V.FREE_EMAIL_DOMAINS)})"


def accepted(raw):
    """Cleaned, valid, first of each, in order."""
    cleaned = f"list_transform({raw}, lambda x: rtrim(trim(lower(x)), {_q('.,;:)]}>' + chr(34) + chr(39))}))"
    valid = f"list_filter({cleaned}, lambda x: {email_valid('x')})"
    return f"list_filter({valid}, lambda x, i: list_position({valid}, x) = i)"


def cleaned(c):
    return (rf"array_to_string(list_filter(list_transform(string_split(trim(regexp_replace({c}, '[\s\x{{a0}}\x0b]+', ' ', 'g')), '.'), "
            f"lambda s: trim(s)), lambda s: s <> '' AND NOT {_any('lower(s)', V.BOILERPLATE)}), '. ')")


def squeezed(c):
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def cut(c, tail=".,;:", length=300):
    head = f"regexp_replace(substring({c}, 1, {length}), ' [^ ]*$', '')"
    head = f"rtrim({head}, '{tail}')" if tail else head
    return f"CASE WHEN length({c}) <= {length} THEN {c} ELSE {head} || '…' END"


def listed(site, sites):
    ends = " OR ".join(f"ends_with({site}, {_q('.' + s)})" for s in sites)
    return f"(coalesce({site} IN {_list(sites)} OR {ends}, false))"


def present(c):
    return f"(coalesce({c}, '') <> '')"


_TAG = r"""<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


def markup(c):
    return rf"regexp_replace({c}, '(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>', chr(1), 'g')"


def decoded(c):
    for name, ch in [("copy", "©"), ("middot", "·"), ("eacute", "é"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")]:
        c = f"replace({c}, '&{name};', {_q(ch)})"
    return c


def text_of(c):
    return decoded(f"regexp_replace(trim(regexp_replace({c}, '{_TAG}', chr(1), 'g'), chr(1)), chr(1) || '+', ' ', 'g')")


_WS = r"[\s\x0b]*"
_AT = rf"{_WS}(?:\[|\(|\{{)?{_WS}(?:at|AT|At|arobase){_WS}(?:\]|\)|\}})?{_WS}"
_DOT = rf"{_WS}(?:\[|\(|\{{)?{_WS}(?:dot|DOT|Dot|point){_WS}(?:\]|\)|\}})?{_WS}"
_SPELLED = rf"([a-zA-Z0-9._%+\-]+){_AT}([a-zA-Z0-9\-]+(?:{_DOT}[a-zA-Z0-9\-]+)+)"
_MAIL = rf"""(?i)mailto:{_WS}["'']?{_WS}({V.ADDRESS})"""

STRATEGIES = {
    "email_mailto": r"""list_transform(regexp_extract_all(markup, '(?i)<a\s[^>]*?href="mailto:([^"?]*)', 1), lambda x: x)""",
    "email_script": rf"""flatten(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script', 1), lambda b: regexp_extract_all(b, '{_MAIL}', 1)))""",
    "email_obfuscated": rf"""list_transform(regexp_extract_all(visible, '{_SPELLED}'), lambda m: regexp_extract(m, '{_SPELLED}', 1) || '@' || trim(regexp_replace(regexp_extract(m, '{_SPELLED}', 2), '{_DOT}', '.', 'g'), '.'))""",
    "email_raw_mailto": rf"""regexp_extract_all(html, '{_MAIL}', 1)""",
    "email_plain": f"""regexp_extract_all(visible, '{V.ADDRESS}')""",
}
_ALL_EMAILS = "list_concat(" + ", ".join(STRATEGIES.values()) + ")"


def _score(fields, business, free, several):
    points = " + ".join(f"CASE WHEN {present(c)} THEN {p} ELSE 0 END" for c, p in fields.items())
    return (f"CAST({points} + CASE WHEN NOT {present('email')} THEN 0 WHEN {email_free('email')} THEN {free} "
            f"ELSE {business} END + CASE WHEN len(string_split(sources, ' ')) >= 2 THEN {several} ELSE 0 END AS INT)")


_SCORE = _score(V.FIELD_POINTS, V.BUSINESS_EMAIL_POINTS, V.FREE_EMAIL_POINTS, V.MULTI_SOURCE_POINTS)
_OTHER_SCORE = _score(OTHER_WEIGHTS.fields, OTHER_WEIGHTS.business_email, OTHER_WEIGHTS.free_email, OTHER_WEIGHTS.several_sources)
# Marks in brackets, or between white space.
_APART_AT, _APART_DOT = (
    rf"(?:{_WS}[\[({{]{_WS}(?:{words}){_WS}[\])}}]{_WS}|[\s\x0b]+(?:{words})[\s\x0b]+)" for words in ("at|AT|At|arobase", "dot|DOT|Dot|point")
)
_APART = rf"([a-zA-Z0-9._%+\-]+){_APART_AT}([a-zA-Z0-9\-]+(?:{_APART_DOT}[a-zA-Z0-9\-]+)+)"
_STRICT_EMAILS = rf"""list_transform(regexp_extract_all(visible, '{_APART}'), lambda m: regexp_extract(m, '{_APART}', 1) || '@' || trim(regexp_replace(regexp_extract(m, '{_APART}', 2), '{_APART_DOT}', '.', 'g'), '.'))"""

_JUNK_SITE = listed(site_key("website"), V.JUNK_SITES)
_JUNK_NAME = _any("lower(company_name)", V.JUNK_NAME_PARTS)
_EMPTY = " AND ".join(f"NOT {present(c)}" for c in V.REQUIRED_FIELDS.values())
_REASON = f"CASE WHEN {_JUNK_SITE} THEN 'domain' WHEN {_JUNK_NAME} THEN 'name' WHEN {_EMPTY} THEN 'empty' END"
_SNIPPET = "rtrim(substring(description, 1, 100)) || CASE WHEN length(description) > 100 THEN '…' ELSE '' END"
_CONTACT_PATHS = "[" + ", ".join(_q(p) for p in V.CONTACT_PATHS) + "]"


def _merged(source: str, group: str) -> str:
    """Earliest present values, longest description, sorted distinct sources."""
    first = ", ".join(f"arg_min({c}, seq) FILTER (WHERE {c} <> '') AS {c}" for c in ("company_name", "website", "email", "contact_page", "address"))
    return f"""SELECT min(seq) AS lead_id, {first},
  coalesce(arg_max(description, (length(description), -seq)) FILTER (WHERE description <> ''), arg_max(description, seq)) AS description,
  array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources
FROM {source} GROUP BY {group}"""


def _ordered_pass(keys: str) -> str:
    """Steps through the rows; lists of keys and their slots are prepended, so a look-up finds the latest."""
    return f"""SELECT 0::BIGINT AS rn, NULL::BIGINT AS slot, []::VARCHAR[] AS ks, []::BIGINT[] AS vs
UNION ALL
SELECT k.rn, x.slot,
  list_concat(CASE WHEN k.name IS NULL THEN [] ELSE ['n' || k.name] END, list_concat(CASE WHEN k.site IS NULL THEN [] ELSE ['d' || k.site] END, p.ks)),
  list_concat(CASE WHEN k.name IS NULL THEN [] ELSE [x.slot] END, list_concat(CASE WHEN k.site IS NULL THEN [] ELSE [x.slot] END, p.vs))
FROM ordered_pass p JOIN {keys} k ON k.rn = p.rn + 1,
LATERAL (SELECT coalesce(p.vs[list_position(p.ks, 'd' || k.site)], p.vs[list_position(p.ks, 'n' || k.name)], k.seq) AS slot) x"""


_LOOKUP = _any("href", V.LOOKUP_SKIP_PARTS)

_BLOCK_TEXT = cleaned(text_of(markup("regexp_extract(plain_html, '(?s)<article>(.*)</article>', 1)")))
_BODY_TEXT = cleaned(text_of(markup("regexp_extract(plain_html, '(?s)<body>(.*)', 1)")))


def long_enough(block, body="NULL"):
    return f"CASE WHEN length({block}) > 50 THEN {block} ELSE {body} END"


_META = """CASE meta_kind WHEN 0 THEN 'About études and more, number ' || page_id WHEN 1 THEN 'Preview text for page number ' || page_id
  WHEN 2 THEN 'short' ELSE '' END"""


def _contacts(name: str, rows: str, features: str, paths: str) -> dict[str, str]:
    return {
        rows: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS rank FROM (
  SELECT *, {site_base('url')} AS base, list_position({paths}, substring(url, length({site_base('url')}) + 1)) AS pos FROM {features}) p
  WHERE pos > 0) r WHERE rank <= 4""",
        name: f"""SELECT base, arg_min(url, rank) AS found_page, count(*) AS n_pages,
  arg_min(email, (rank > 1, strategy, rank)) FILTER (WHERE email IS NOT NULL) AS site_email FROM {rows} GROUP BY base""",
    }


def _enriched(leads: str, features: str = "features", contacts: str = "contacts") -> str:
    return f"""SELECT l.lead_id, l.company_name, CASE WHEN l.url IS NULL THEN l.website ELSE l.url END AS website,
  CASE WHEN l.url IS NULL THEN l.email ELSE coalesce(s.site_email, h.email, l.email) END AS email,
  coalesce(h.description, l.description) AS description,
  CASE WHEN l.url IS NULL THEN l.contact_page ELSE s.found_page END AS contact_page, l.address, l.sources,
  h.email AS home_email, h.description AS home_description, l.url
FROM (SELECT *, CASE WHEN {present('website')} THEN {with_scheme('website')} END AS url FROM {leads}) l
LEFT JOIN {features} h ON h.url = l.url LEFT JOIN {contacts} s ON s.base = {site_base('l.url')}"""


def _report(slots: str) -> dict[str, str]:
    return {
        "report_leads": _merged(
            f"(SELECT r.*, s.slot, CAST(NULL AS STRING) AS email, CAST(NULL AS STRING) AS contact_page FROM raw_leads r JOIN {slots} s USING (seq))", "slot"),
        "report_enriched": _enriched("report_leads"),
        "report_filled": f"""SELECT e.* REPLACE (CASE WHEN {present('e.address')} THEN e.address ELSE coalesce(f.found_address, e.address) END AS address)
FROM report_enriched e LEFT JOIN found_addresses f ON f.search_term = e.company_name || ' {LOCATION}'""",
        "report": f"""SELECT lead_id, {', '.join(c for c in EXPORT if c != 'score')}, {_SCORE} AS score FROM report_filled
WHERE {_REASON} IS NULL AND {_SCORE} >= 2""",
    }


EXPORT = ["company_name", "website", "email", "description", "contact_page", "address", "sources", "score"]

def _clean_title(c: str) -> str:
    for suffix in V.TITLE_SUFFIXES:
        c = f"regexp_replace({c}, '(?i){suffix.replace('|', chr(92) + '|')}$', '')"
    return f"trim({c})"


SEARCH_FOUND = f"""SELECT search_term, page_no, CAST(row_number() OVER (PARTITION BY search_term, page_no ORDER BY pos) - 1 AS INT) AS pos, {_clean_title('title')} AS company_name, href AS website, {cut('snippet', '')} AS description
FROM (SELECT search_term, page_no, pos, href, title, nullif(snippet, '') AS snippet, row_number() OVER (PARTITION BY search_term, page_no, {site_key('href')} ORDER BY pos) AS rn
  FROM serp WHERE NOT {listed(site_key('href'), V.SEARCH_SKIP_SITES)}) h WHERE rn = 1"""

# Named steps, each with the steps it reads.
_STEPS: dict[str, str] = {
    "raw_plain": "SELECT *, seq AS lead_id, CASE WHEN seq % 2 = 0 THEN 'old' || seq || '@x.fr' END AS email, 'old' AS contact_page, source AS sources FROM raw_leads",
    "plain": "SELECT *, seq AS lead_id, CAST(NULL AS STRING) AS contact_page, source AS sources FROM sightings",
    "by_name": _merged("plain", name_key("company_name")),
    "scored": f"SELECT *, {_SCORE} AS score FROM by_name",
    "keys": f"SELECT seq, row_number() OVER (ORDER BY seq) AS rn, {site_key('website')} AS site, nullif({name_key('company_name')}, '') AS name FROM raw_leads",
    "key_pairs": "SELECT seq, 'd' || site AS k FROM keys WHERE site IS NOT NULL UNION ALL SELECT seq, 'n' || name FROM keys WHERE name IS NOT NULL",
    "key_firsts": "SELECT k, min(seq) AS first FROM key_pairs GROUP BY k",
    "links": "SELECT DISTINCT seq AS a, first AS b FROM key_pairs JOIN key_firsts USING (k)",
    "both_ways": "SELECT a, b FROM links UNION SELECT b, a FROM links",
    "reach": "SELECT seq AS a, seq AS b FROM keys UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b",
    "closure_slots": "SELECT a AS seq, min(b) AS slot FROM reach GROUP BY a",
    "ordered_pass": _ordered_pass("keys"),
    "exact_slots": "SELECT k.seq, o.slot FROM keys k JOIN ordered_pass o ON o.rn = k.rn",
    "degrees": """SELECT site AS host, count(*) AS n_links, count(DISTINCT name) AS n_names FROM keys WHERE site IS NOT NULL
GROUP BY site HAVING count(*) >= 0.004 * (SELECT count(site) FROM keys)""",
    "open_keys": """SELECT seq, rn, CASE WHEN NOT EXISTS (SELECT 1 FROM degrees d WHERE d.n_names >= 3 AND (d.host = k.site OR ends_with(k.site, '.' || d.host))) THEN site END AS site, name
FROM keys k""",
    "open_pass": _ordered_pass("open_keys").replace("ordered_pass", "open_pass"),
    "listed_suffixes": f"""SELECT DISTINCT site, array_to_string(labels[i:], '.') AS listed FROM (
  SELECT site, labels, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT DISTINCT {site_key('website')} AS site, string_split({site_key('website')}, '.') AS labels FROM plain) s) p
WHERE listed IN (SELECT lower(trim(domain)) FROM domains WHERE domain <> '')""",
    "usable": r"SELECT * FROM crawl WHERE status = 200 AND (contains(content_type, 'text/html') OR content_type = '')",
    "texts": f"""SELECT *, {long_enough(cleaned(text_of("regexp_extract(markup, '(?s)<article>(.*)</article>', 1)")), cleaned(text_of("regexp_extract(markup, '(?s)<body>(.*)', 1)")))} AS block, {text_of('markup')} AS visible FROM (SELECT *, {markup('html')} AS markup FROM crawl) t""",
    "page_rows": f"""SELECT url, coalesce({', '.join(f'({accepted(s)})[1]' for s in STRATEGIES.values())}) AS email,
  CASE {' '.join(f'WHEN len({accepted(s)}) > 0 THEN {i}' for i, s in enumerate(STRATEGIES.values()))} END AS strategy,
  {cut('block')} AS description, {cut('block', length=SHORT)} AS short, html <> '' AS has_html
FROM texts WHERE status = 200 AND (contains(content_type, 'text/html') OR content_type = '')""",
    "features": """SELECT url, email, strategy, description, has_html FROM (SELECT *, row_number() OVER (PARTITION BY url
  ORDER BY NOT has_html, coalesce(strategy, 99), coalesce(email, ''), coalesce(description, '')) AS copy FROM page_rows) p WHERE copy = 1""",
    "short_features": """SELECT url, email, strategy, short AS description, has_html FROM (SELECT *, row_number() OVER (PARTITION BY url
  ORDER BY NOT has_html, coalesce(strategy, 99), coalesce(email, ''), coalesce(short, '')) AS copy FROM page_rows) p WHERE copy = 1""",
    **_contacts("contacts", "contact_rows", "features", _CONTACT_PATHS),
    **_contacts("few_contacts", "few_contact_rows", "short_features", "[" + ", ".join(_q(p) for p in FEW_PATHS) + "]"),
    "few_enriched": _enriched("raw_plain", "short_features", "few_contacts"),
    "raw_enriched": _enriched("raw_plain"),
    "found_sites": f"SELECT search_term, arg_min(href, (page_no, pos, href)) AS site FROM lookup_hits WHERE NOT {_LOOKUP} GROUP BY search_term",
    "found_addresses": """SELECT search_term, coalesce(arg_min(trim(direct_address), (pos, direct_address)) FILTER (WHERE trim(direct_address) <> ''),
  (list(address ORDER BY pos, address NULLS FIRST))[1]) AS found_address FROM places GROUP BY search_term""",
    "place_found": """SELECT url, company_name, address, website FROM (SELECT *, row_number() OVER (PARTITION BY url
  ORDER BY address IS NULL, company_name, coalesce(address, ''), coalesce(website, '')) AS copy FROM (
    SELECT url, name AS company_name, address, website FROM places_seen WHERE place_no % 6 <> 0
    UNION ALL SELECT url, 'Another page', NULL, NULL FROM places_seen WHERE place_no % 8 = 0) p) q WHERE copy = 1""",
    "cards_found": """SELECT search_term, page_no, 0 AS pos, name1 AS name, address1 AS address FROM cards
UNION ALL SELECT search_term, page_no, 1, name2, 'at home' FROM cards""",
    "looked_up": "SELECT c.name1 AS name, h.href1 AS href FROM cards c JOIN hits h ON h.page_id = c.page_no",
    "search_found": SEARCH_FOUND,
    "serp": f"""SELECT search_term, page_no, 0 AS pos, href1 AS href, {squeezed(decoded('title1'))} AS title, {squeezed(decoded('snippet1'))} AS snippet FROM hits
UNION ALL SELECT search_term, page_no, 1, href2, 'Second ' || page_id, '' FROM hits
UNION ALL SELECT search_term, page_no, 2, 'x', '', '' FROM hits WHERE false""",
}


def _sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the steps a query needs, and theirs, in front of it."""
    steps = {**{n: None for n in RECIPES}, **_STEPS, **(extra or {})}
    order: list[str] = []

    def add(text: str, me: str | None = None):
        for name in steps:
            if name != me and name not in order and _mentions(text, name):
                if steps[name] is None:
                    for below in inputs_of(name):
                        if below not in order:
                            add(below)
                else:
                    add(steps[name], name)
                if name not in order:
                    order.append(name)

    add(body)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({steps[n] or recipe_sql(n)})" if n not in ("reach", "ordered_pass", "open_pass")
                     else f"{n} AS ({steps[n]})" for n in order)
    return f"WITH RECURSIVE {ctes} {body}" if order else body


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?:FROM|JOIN) \(?{name}\b", text) is not None or text == name


def _kept(verdicts: str, key: str = "lead_key") -> str:
    return f"SELECT {key} AS lead_key, bool_or(error IS NOT NULL OR starts_with(lower(trim(coalesce(answer, ''))), 'oui')) AS kept FROM {verdicts} GROUP BY {key}"


_URL_ENC = lambda c: f"replace(url_encode({c}), '%20', '+')"
_DIRECTORY = V.DIRECTORY_URL.split("{what}")[0], V.DIRECTORY_URL.split("{what}")[1].split("{where}")[0], V.DIRECTORY_URL.split("{where}")[1].replace("{page}", "1")
_RUN_ROWS = "(VALUES ('maps', 0), ('pj', 1), ('google', 2), ('maps', 3)) v(source, run_pos)"
_SUFFIXED = "lower(title)"


BODIES: dict[str, str] = {
    "normalize_url": f"SELECT page_id, {with_scheme('website')} AS url FROM spellings",
    "site_key": rf"""SELECT page_id, {host('website')} AS host, {site_key('website')} AS site,
  nullif(lower(ltrim({host('website')}, 'w.')), '') AS legacy_site, regexp_matches(website, '^\s*(?i:https?)://[^/?#]') AS absolute,
  {site_base('website')} AS base FROM spellings""",
    "norm_name": f"SELECT seq, {name_key('company_name')} AS name_key FROM raw_leads",
    "location_slug": "SELECT seq, replace(trim(lower(strip_accents(company_name))), ' ', '-') AS slug FROM raw_leads",
    "email_valid": f"SELECT c_custkey, email, {email_valid('email')} AS valid FROM candidates",
    "email_free": f"SELECT c_custkey, email, {email_free('email')} AS free FROM candidates",
    "email_text": f"""SELECT doc_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, unnest(e) AS email
FROM (SELECT doc_id, {accepted(f"regexp_extract_all(text, '{V.ADDRESS}')")} AS e FROM documents) d""",
    "clean_text": f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents",
    "truncate": f"SELECT doc_id, {cut('text')} AS short, {cut('text', '')} AS snippet FROM documents",
    "valid_leads": r"""SELECT lead_id, company_name FROM (SELECT lead_id, CASE lead_id % 10 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) ELSE company_name END AS company_name FROM plain) p
WHERE trim(company_name, ' ' || chr(9)) <> ''""",
    "request_table": f"""SELECT query, location, query || ' ' || location AS search_term, unnest(['maps', 'pj', 'google']) AS source,
  unnest(['{V.MAPS_URL}' || {_URL_ENC("query || ' ' || location")},
    '{_DIRECTORY[0]}' || {_URL_ENC('query')} || '{_DIRECTORY[1]}' || {_URL_ENC("replace(trim(lower(strip_accents(location))), ' ', '-')")} || '{_DIRECTORY[2]}',
    replace('{V.SEARCH_URL}', '{{term}}', {_URL_ENC("query || ' ' || location")})]) AS url
FROM (SELECT name2 AS query, 'Île ~*' || search_term AS location FROM cards) s""",
    "lead_requests": f"""SELECT lead_id, company_name || ' {LOCATION}' AS search_term, '{V.MAPS_URL}' || {_URL_ENC(f"company_name || ' {LOCATION}'")} AS place_url,
  replace('{V.LOOKUP_URL}', '{{term}}', {_URL_ENC(f"company_name || ' {LOCATION}'")}) AS lookup_url FROM raw_plain""",
    "source_select": f"SELECT run_pos, source, source_rank FROM raw_leads JOIN {_RUN_ROWS} USING (source)",
    "union_sources": f"SELECT run_pos * {1 << 52} + source_rank AS seq, source AS sources, company_name, website FROM raw_leads JOIN {_RUN_ROWS} USING (source)",
    "per_source_limit": f"SELECT run_pos, source, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY source_rank) AS rn FROM raw_leads) r JOIN {_RUN_ROWS} USING (source) WHERE rn <= 20",
    "per_source_limit_large": f"SELECT run_pos, source, seq AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM sightings) r JOIN {_RUN_ROWS} USING (source) WHERE rn <= 4000",
    "source_counts": f"SELECT source, count(*) AS n_leads FROM raw_leads JOIN {_RUN_ROWS} USING (source) GROUP BY source",
    "place_urls": """SELECT search_term, url, min(place_order) AS place_order FROM (
  SELECT search_term, url, place_no * 4294967296 AS place_order FROM places_seen
  UNION ALL SELECT search_term, 'https://www.google.com/maps/place/' || (place_no - 1), place_no * 4294967296 + 2 FROM places_seen) p GROUP BY search_term, url""",
    "place_rows": "SELECT * FROM place_found",
    "place_addresses": """SELECT s.name || ' """ + LOCATION + """' AS search_term, CASE WHEN s.place_no % 3 = 0 THEN 'direct ' || s.place_no END AS direct_address,
  CASE WHEN s.place_no % 3 <> 0 THEN p.address END AS address FROM places_seen s LEFT JOIN places_seen p ON p.place_no = s.place_no""",
    "source_run": f"""SELECT 'maps' AS sources, company_name, website, CAST(NULL AS STRING) AS description, address FROM place_found
UNION ALL SELECT 'pj', c.name, l.href, NULL, c.address FROM cards_found c LEFT JOIN looked_up l ON l.name = c.name
UNION ALL SELECT 'google', company_name, website, description, NULL FROM search_found""",
    "directory_cards": "SELECT * FROM cards_found",
    "serp_hits": "SELECT * FROM serp",
    "serp_leads": "SELECT * FROM search_found",
    "merge_fields": "SELECT * FROM by_name",
    "dedup_exact": "SELECT seq, slot FROM exact_slots",
    "host_degrees": "SELECT * FROM degrees",
    "dedup_ignore_hosts": "SELECT k.seq, o.slot FROM open_keys k JOIN open_pass o ON o.rn = k.rn",
    "dedup_closure": "SELECT seq, slot FROM closure_slots",
    "dedup_merge": ("SELECT * FROM report_leads", "exact_slots"),
    "dedup_merge_closure": ("SELECT * FROM report_leads", "closure_slots"),
    "score": "SELECT lead_id, score FROM scored",
    "score_weights": f"SELECT lead_id, s AS score, {OTHER_WEIGHTS.most} AS most FROM (SELECT lead_id, {_OTHER_SCORE} AS s FROM by_name) b WHERE s >= 3",
    "junk_phrases": f"""SELECT lead_id, EXISTS (SELECT 1 FROM range({JUNK_PHRASES}) r(n) WHERE contains(lower(company_name), 'é ' || (3 * n) || ' s')) AS junk FROM plain""",
    "drop_report_lists": f"""SELECT reason, count(*) AS n_leads FROM (
  SELECT CASE WHEN l.site IS NOT NULL OR {listed(site_key('website'), OTHER_SITES)} THEN 'domain' WHEN {_any('lower(company_name)', OTHER_PARTS)} THEN 'name'
    WHEN {_EMPTY} THEN 'empty' ELSE 'kept' END AS reason
  FROM plain LEFT JOIN (SELECT DISTINCT site FROM listed_suffixes) l ON l.site = {site_key('website')}) r GROUP BY reason""",
    "email_strict": f"""SELECT page_id, CAST(unnest(range(len(found))) AS INT) AS pos, unnest(found) AS email FROM (
  SELECT page_id, {accepted(_STRICT_EMAILS)} AS found FROM (SELECT page_id, {text_of(markup('html'))} AS visible FROM spelled_pages) t) f""",
    "min_score": "SELECT lead_id, score FROM scored WHERE score >= 8",
    "rank_leads": "SELECT lead_id, company_name, score FROM scored ORDER BY score DESC, lead_id",
    "only_fields": f"SELECT lead_id FROM plain WHERE {present('email')} AND {present('website')} AND {present('address')}",
    "junk_domain": f"SELECT lead_id, {_JUNK_SITE} AS junk FROM plain",
    "junk_domain_table": f"""SELECT lead_id, listed FROM plain LEFT JOIN (SELECT site, arg_max(listed, length(listed)) AS listed FROM listed_suffixes GROUP BY site) s ON s.site = {site_key('website')}""",
    "junk_name": f"SELECT lead_id, {_JUNK_NAME} AS junk FROM plain",
    "empty_records": f"SELECT lead_id FROM plain WHERE {_EMPTY}",
    "junk_filter": f"SELECT lead_id, company_name, website FROM plain WHERE {_REASON} IS NULL",
    "drop_report": f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n_leads FROM plain GROUP BY 1",
    "summary_view": f"""SELECT row_number() OVER (ORDER BY score DESC, lead_id) AS number, company_name, '[' || score || '/11]' AS score_tag,
  replace(sources, ' ', ', ') AS sources_tag, website, email, address, contact_page, {_SNIPPET} AS snippet FROM scored""",
    "usable_pages": "SELECT url, status, content_type FROM usable",
    "visible_text": "SELECT url, visible FROM texts",
    **{
        key: f"SELECT url, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, unnest(e) AS email FROM (SELECT url, {accepted(s)} AS e FROM texts) t"
        for key, s in STRATEGIES.items()
    },
    "email_all": f"SELECT url, array_to_string({accepted(_ALL_EMAILS)}, ' ') AS emails FROM texts",
    "meta_description": f"SELECT page_id, {_META} AS meta FROM dressed",
    "content_block": f"SELECT page_id, {long_enough(_BLOCK_TEXT)} AS block FROM dressed",
    "description": f"SELECT page_id, CASE WHEN length({_META}) > 20 THEN {_META} ELSE {cut('block')} END AS description FROM (SELECT *, {long_enough(_BLOCK_TEXT, _BODY_TEXT)} AS block FROM dressed) d",
    "page_features": "SELECT * REPLACE (coalesce(strategy, -1) AS strategy) FROM features",
    "contact_frontier": f"""SELECT lead_id, CAST(p - 1 AS INT) AS pos, base || ({_CONTACT_PATHS})[p] AS url FROM (
  SELECT lead_id, {site_base(with_scheme('website'))} AS base, unnest(range(1, 19)) AS p FROM raw_plain WHERE {present('website')}) f WHERE base IS NOT NULL""",
    "site_pages": "SELECT * FROM contacts",
    "email_best": f"SELECT lead_id, email FROM raw_enriched WHERE {present('email')}",
    "enrich_homepage": "SELECT lead_id, url, home_email, home_description FROM raw_enriched",
    "enrich": "SELECT lead_id, website, email, description, contact_page, address FROM raw_enriched",
    "website_lookup": f"SELECT lead_id, CASE WHEN {present('website')} THEN website ELSE site END AS website FROM raw_plain LEFT JOIN found_sites ON search_term = company_name || ' {LOCATION}'",
    "address_backfill": f"""SELECT lead_id, CASE WHEN {present('address')} THEN address ELSE coalesce(found_address, address) END AS address,
  NOT {present('address')} AND found_address IS NOT NULL AS address_filled FROM raw_plain LEFT JOIN found_addresses ON search_term = company_name || ' {LOCATION}'""",
    "relevance_requests": f"""SELECT lead_id AS lead_key, 'Query: agence web' || chr(10) || 'Company: ' || company_name || chr(10) || 'Website: ' || coalesce(website, '') || chr(10)
  || 'Description: ' || coalesce(nullif(description, ''), 'Non disponible') || chr(10) || 'Does the company''s main activity match ''agence web''? Answer ''oui'' or ''non''.' AS request FROM by_name""",
    "relevance_split": f"SELECT lead_id, coalesce(kept, true) AS kept FROM plain LEFT JOIN ({_kept('verdicts')}) v ON v.lead_key = lead_id",
    "export_run": (f"""SELECT f.format, NOT coalesce(kept, true) AS refused, company_name, website, score
FROM report LEFT JOIN ({_kept('lead_verdicts', 'first_seq')}) v ON v.lead_key = lead_id CROSS JOIN (VALUES ('json'), ('csv')) f(format)""", "exact_slots"),
    "enrich_settings": "SELECT lead_id, email, description, contact_page FROM few_enriched",
    "export_json": f"SELECT {', '.join(EXPORT)} FROM scored",
    "json_records": None,
    "export_csv": f"""SELECT company_name, website, email, nullif(description, '') AS description, contact_page, address, '[''' || replace(sources, ' ', ''', ''') || ''']' AS sources, CAST(score AS STRING) AS score FROM scored""",
    "lead_report": ("SELECT * EXCLUDE (lead_id) FROM report", "exact_slots"),
    "lead_report_closure": ("SELECT * EXCLUDE (lead_id) FROM report", "closure_slots"),
}


def _json_record() -> str:
    """Keys in column order, null ones left out."""
    quoted = lambda c: f"coalesce('\"{c}\":' || to_json({c})::VARCHAR || ',', '')"
    parts = " || ".join(quoted(c) for c in EXPORT[:6])
    return f"""SELECT '{{' || {parts} || '"sources":["' || replace(sources, ' ', '","') || '"],"score":' || score || '}}' AS record FROM scored"""


BODIES["json_records"] = _json_record()
BODIES["page_features_once"] = BODIES["page_features"]
BODIES["enrich_by_site"] = BODIES["enrich"]
BODIES["export_json_array"] = f"""SELECT CASE WHEN row_number() OVER best = 1 THEN '[' ELSE ',' END AS mark, row_number() OVER best = count(*) OVER () AS closes, record
FROM ({_json_record().replace(' AS record FROM', ' AS record, score, lead_id FROM')}) r WINDOW best AS (ORDER BY score DESC, lead_id)"""


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, body in BODIES.items():
        out[key] = _sql(body) if isinstance(body, str) else _sql(body[0], _report(body[1]))
    return out
