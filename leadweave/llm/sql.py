"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from leadweave.llm.common import WORD
from leadweave.llm.lexical import TERM
from leadweave.llm.secrets import BASE, RULES
from leadweave.llm.spelling import RUN

_FINITE = "len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

EMBEDDING_DEDUP = f"""
WITH RECURSIVE given AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM given WHERE e IS NOT NULL AND label IS NOT NULL AND {_FINITE} AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM given UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""

TOP_K = f"""
WITH given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(x * 64) AS BIGINT)) AS v FROM given WHERE e IS NOT NULL AND {_FINITE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split WHERE len(words) >= 13),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS window_ FROM starts),
firsts AS (SELECT window_, min(doc_id) AS first FROM windows GROUP BY window_),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN firsts USING (window_) WHERE doc_id > first),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


def _secret_scan() -> str:
    found = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        # There is no look-behind here: the character before is matched too and its length taken off.
        before = f"(^|[^{rule.not_after}])" if rule.not_after else "()"
        pattern = f"{'(?i)' if rule.any_case else ''}{before}({pattern})"
        found.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least, "
            f"regexp_extract_all(t, '{pattern}', 1) AS lead, regexp_extract_all(t, '{pattern}', 0) AS whole, "
            f"regexp_extract_all(t, '{pattern}', {rule.group + 2}) AS part, "
            f"regexp_split_to_array(t, '{pattern}') AS rest FROM texts"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    written = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(found)}),
single AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM matches),
spans AS (SELECT doc_id, kind, place, length(whole[i]) - length(lead[i]) AS n,
    CAST(length(lead[i]) + list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM single WHERE length(part[i]) >= least),
listed AS (SELECT doc_id, {counts}, {written} AS spans, {written} FILTER (kind IN ({base})) AS base FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEXICAL_SEARCH = f"""
WITH parts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms FROM documents),
docs AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM parts WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
held AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM held, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
long AS (SELECT r, doc_id, 100 - 90 + ((90 * n * all_docs) // all_terms) AS m FROM docs, totals),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN long USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


# The checksum's table follows from its polynomial; a byte at a time is folded in.
_FOLD = "list_reduce(list_prepend(c::BIGINT, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen(s)::BIGINT),
    lambda i: ('0x' || hex(encode(s))[2 * i - 1:2 * i])::BIGINT)), lambda h, b: xor(h >> 8, fold[1 + (xor(h, b) & 255)])), 4294967295)"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE table_ AS (SELECT list({_FOLD} ORDER BY c) AS fold FROM (SELECT unnest(range(256)) AS c)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{RUN}')) AS run FROM documents),
counted AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
marked AS (SELECT run, c, {_CRC32} AS h FROM counted, table_),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[2 + h % length(run):] ELSE run END AS word, c FROM marked),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(a := -o.n, b := other)) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


ORACLE_SQL = {
    "op4_embedding_dedup": EMBEDDING_DEDUP,
    "op5_secret_scan": _secret_scan(),
    "op7_topk": TOP_K,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_lexical_search": LEXICAL_SEARCH,
}
