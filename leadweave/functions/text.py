"""Presence tests, white space, sentence clean-up and cutting."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from leadweave.fixed_values import BOILERPLATE, DESCRIPTION_LENGTH, SPACE, SPACE_CHARS
from leadweave.functions.phrases import holds_any


def let(value: Column, fn) -> Column:
    """``fn(value)``, with *value* computed once however often *fn* uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def present(c: Column) -> Column:
    """Neither null nor empty. Never null itself."""
    return c.isNotNull() & (c != "")


def first_present(*cols: Column) -> Column:
    """The first non-empty value; the last one as it is when all others are missing."""
    *heads, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in heads], last)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # Lone spaces, by far the most, need no replacement; the first class rules letters out fast.
    other = rf"[[^\x20-\x7e]&&[{SPACE}]]"
    return F.trim(F.regexp_replace(c, f" [{SPACE}]+|{other}[{SPACE}]*", " "))


def contains_any(c: Column, parts) -> Column:
    """For a column that is there already: the fastest test, but it names *c* once per part."""
    return reduce(or_, [F.contains(c, F.lit(p)) for p in parts])


def matches_any(c: Column, parts) -> Column:
    """The same for an expression and for lists of any length: one pattern, so *c* is computed once."""
    return holds_any(c, parts)


def drop_boilerplate(c: Column) -> Column:
    """Squeeze, split at full stops, drop boilerplate sentences, join again."""

    def kept(text):
        sentences = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != "")
        genuine = F.filter(sentences, lambda s: ~contains_any(F.lower(s), BOILERPLATE))
        # Most texts have no such phrase at all; one look tells.
        suspect = let(F.lower(text), lambda t: contains_any(t, BOILERPLATE))
        return F.array_join(F.when(suspect, genuine).otherwise(sentences), ". ")

    return let(squeeze(c), kept)


def _head(c: Column, length: int) -> Column:
    """The first characters, cut back to the last space if there is one."""
    return F.regexp_replace(F.substring(c, 1, length), r" [^ ]*\z", "")


def _cut(c: Column, length: int, head: Column) -> Column:
    return F.when(F.length(c) <= length, c).otherwise(F.concat(head, F.lit("…")))


def cut(c: Column, length: int = DESCRIPTION_LENGTH) -> Column:
    """At most *length* characters, cut at a word, without trailing punctuation, plus an ellipsis."""
    return let(c, lambda t: _cut(t, length, F.rtrim(_head(t, length), F.lit(".,;:"))))


def cut_snippet(c: Column, length: int = DESCRIPTION_LENGTH) -> Column:
    """As :func:`cut`, but keeps trailing punctuation."""
    return let(c, lambda t: _cut(t, length, _head(t, length)))
