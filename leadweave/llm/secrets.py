"""Secret scans: a trigram inverted index picks the texts that a rule's pattern can match at all.

From each pattern a Boolean query over trigrams is derived: what every match must contain, folded to
lower case. The texts of a segment (a bounded run of rows within a task) are indexed by the trigrams
that any query names; the query intersects and unites their postings, and only the texts that are
left are searched with the pattern. A pattern without any mandatory trigram reads all texts. The index
of a segment lives next to its texts, so no text is ever shuffled, and a lost executor costs one task.

Spans are code points, end exclusive. Defined cases: a null text is empty and has no spans; texts are
searched whole, whatever their length; equal rows get equal spans. Only the text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
# The standard library's own parse of a pattern; it has no public name since Python 3.11.
from re import _constants as op, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# A class of more characters, or more strings at one place, is not spelled out.
_MOST_CHARACTERS, _MOST_STRINGS = 4, 64
_SEGMENT_BYTES = 4 << 20
_SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of *pattern*, leftmost and non-overlapping; kept if *group* has *least* characters.

    A match never starts behind a character of the class *not_after*: where a pattern's first part is a run of a
    class that also holds its start, it would otherwise be tried again from each place within the run.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    not_after: str = ""

    def compiled(self) -> re.Pattern:
        behind = f"(?<![{self.not_after}])" if self.not_after else ""
        return re.compile(behind + self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# Fixed values of the contract. A run of hex digits that is too short is dropped, so asking for 24 at once
# finds the same runs.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# What the method adds: kinds with long mandatory parts, which the index answers without a scan.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", not_after="A-Za-z0-9_-"),
    Rule("bearer", r"Bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, True),
    Rule("login_url", r"://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 6),
)
RULES = BASE + ADDED


# --- the Boolean query of a pattern ---------------------------------------------------------------
# A query is a list of clauses that must all hold; a clause is a set of alternatives; an alternative is a
# set of trigrams that must all occur. No clause at all: every text may match.


def _spelled(item: tuple) -> set[str] | None:
    """All strings that a parsed item can match, or None if they are too many."""
    code, arg = item
    if code is op.LITERAL:
        return {chr(arg).lower()}
    if code is op.AT:
        return {""}
    if code is op.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is op.LITERAL:
                found.add(chr(value).lower())
            elif kind is op.RANGE and value[1] - value[0] < _MOST_CHARACTERS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= _MOST_CHARACTERS + 2 else None
    if code is op.SUBPATTERN:
        return _spelled_all(arg[-1])
    if code is op.BRANCH:
        parts = [_spelled_all(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if code is op.MAX_REPEAT and arg[1] <= 2:
        one = _spelled_all(arg[2])
        if one is None:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=n)}
    return None


def _spelled_all(items: Sequence[tuple]) -> set[str] | None:
    whole = {""}
    for item in items:
        part = _spelled(item)
        if part is None or len(whole) * len(part) > _MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def _clause(strings: set[str]) -> list[frozenset]:
    """At least one of *strings* occurs; empty if one of them is too short to say so."""
    ways = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in ways or not all(s.isascii() for s in strings):
        return []
    return [frozenset(w for w in ways if not any(v < w for v in ways))]


def _query(items: Sequence[tuple]) -> list[frozenset]:
    clauses: list[frozenset] = []
    run = {""}
    for item in [*items, None]:
        part = _spelled(item) if item else None
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        clauses += _clause(run)
        run = part or {""}
        if item and part is None:
            code, arg = item
            if code is op.SUBPATTERN:
                clauses += _query(arg[-1])
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                clauses += _query(arg[2])
    return clauses + (_clause(run) if run != {""} else [])


def trigram_query(pattern: str) -> list[frozenset]:
    """What every match of *pattern* contains, see above; empty if there is no mandatory trigram."""
    return list(dict.fromkeys(_query(parser.parse(pattern))))


# --- the index of a segment -----------------------------------------------------------------------


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


def postings(texts: Sequence[bytes], trigrams: Sequence[str]) -> dict[str, np.ndarray]:
    """For each of *trigrams* the rising positions of the texts that contain it, in any case."""
    none = {t: np.empty(0, np.int64) for t in trigrams}
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
    if len(data) < 3 or not trigrams:
        return none
    named = np.array(sorted({_code(t) for t in trigrams}))
    wanted = np.zeros(1 << 24, bool)
    wanted[named] = True
    codes = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    at = np.flatnonzero(wanted[codes])
    rows = np.searchsorted(np.cumsum(sizes), at, "right")
    pairs = np.unique(np.searchsorted(named, codes[at]) * len(texts) + rows)
    bounds = np.searchsorted(pairs, np.arange(len(named) + 1) * len(texts))
    lists = {int(c): pairs[bounds[i]:bounds[i + 1]] - i * len(texts) for i, c in enumerate(named)}
    return none | {t: lists[_code(t)] for t in trigrams}


def candidates(query: list[frozenset], lists: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Positions of the texts of a segment of *n* that satisfy *query*."""
    left = np.arange(n)
    for clause in query:
        some = np.empty(0, np.int64)
        for way in clause:
            both = None
            for trigram in sorted(way, key=lambda t: len(lists[t])):
                both = lists[trigram] if both is None else np.intersect1d(both, lists[trigram], assume_unique=True)
            some = np.union1d(some, both)
        left = np.intersect1d(left, some, assume_unique=True)
    return left


def _scan_segment(texts: list[str], rules: Sequence[tuple[int, Rule, re.Pattern, list]]) -> list[list[tuple]]:
    found: list[list[tuple]] = [[] for _ in texts]
    named = sorted({t for *_, query in rules for clause in query for way in clause for t in way})
    lists = postings([t.encode("utf-8", "replace") for t in texts], named)
    for place, rule, pattern, query in rules:
        for row in candidates(query, lists, len(texts)):
            for m in pattern.finditer(texts[row]):
                if len(m[rule.group]) >= rule.least:
                    found[row].append((m.start(), place, rule.kind, m.end()))
    return [sorted(spans) for spans in found]


def _segments(texts: list[str]) -> Iterator[list[str]]:
    segment, size = [], 0
    for text in texts:
        segment.append(text)
        size += len(text)
        if size >= _SEGMENT_BYTES:
            yield segment
            segment, size = [], 0
    if segment:
        yield segment


def secret_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``array<struct<kind,start,end>>`` of all rules, by start, then in the order of the rules."""

    @F.arrow_udf(_SPAN)
    def spans(batch: pa.Array) -> pa.Array:
        ready = [(i, r, r.compiled(), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        rows = []
        for segment in _segments([t or "" for t in batch.to_pylist()]):
            for found in _scan_segment(segment, ready):
                rows.append([{"kind": kind, "start": start, "end": end} for start, _, kind, end in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, kind)

    return spans(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in square brackets; overlapping spans as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("string").alias("out"))

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        kept = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        mark = F.concat(F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], kept, mark)).otherwise(done["out"]).alias("out"),
        )

    joined = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
