"""Company-name keys and location slugs."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from leadweave.fixed_values import LEGAL_FORMS
from leadweave.functions.text import strip

_WORD = r"\p{L}\p{N}_"


@cache
def _accent_table() -> tuple[str, str]:
    """Arguments for ``translate``: accented letters to their base, then marks to drop.

    Covers the basic plane, where each letter decomposes into one base and marks.
    """
    accented, bases, marks = [], [], []
    for code in range(0x80, 0xFFFF):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        kept = [p for p in parts if not unicodedata.combining(p)]
        if parts != ch and len(kept) == 1:
            accented.append(ch)
            bases.append(kept[0])
    return "".join(accented + marks), "".join(bases)


def strip_accents(text: Column) -> Column:
    source, target = _accent_table()
    return F.translate(text, source, target)


def name_key(name: Column) -> Column:
    """Lower case, no accents, no legal forms, words separated by one space. May be empty."""
    plain = strip_accents(F.lower(name))
    forms = "|".join(LEGAL_FORMS)
    named = F.regexp_replace(plain, f"(?<![{_WORD}])(?:{forms})(?![{_WORD}])", "")
    return F.trim(F.regexp_replace(named, r"[^\p{L}\p{N}]+", " "))


def location_slug(location: Column) -> Column:
    return F.replace(strip(F.lower(strip_accents(location))), F.lit(" "), F.lit("-"))
