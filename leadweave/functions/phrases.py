"""Whether a text holds any of many phrases, at a cost per character that hardly grows with the list.

Short lists are one pattern: phrases that share a beginning share it there, and a choice between many next characters is
made by halves. Long lists are an automaton in an Arrow UDF, which reads every character once. Both give the same answers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from itertools import groupby
from os.path import commonprefix

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The UDF travels with its code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Choices of so many characters are tried one after the other.
_FEW = 4
# Groups nested deeper than this become plain lists, so that no list of phrases can exhaust the stack.
_DEEPEST = 100
# Patterns longer than this cost more than the way to Python and back. (Spark also writes them into generated code, where a
# string has 65,535 bytes at most.)
LONGEST_PATTERN = 2_000
_NEVER = "(?!)"


def _exactly(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}" for c in text)


def _choice(groups: list[tuple[str, list[str]]], depth: int) -> str:
    """Groups of phrases by first character, in order."""
    if len(groups) <= _FEW:
        return "(?:" + "|".join(_any_of(phrases, depth + 1) for _, phrases in groups) + ")"
    half = len(groups) // 2
    halves = (
        rf"(?=[\x{{{ord(part[0][0]):x}}}-\x{{{ord(part[-1][0]):x}}}])" + _choice(part, depth + 1)
        for part in (groups[:half], groups[half:])
    )
    return "(?:" + "|".join(halves) + ")"


def _any_of(phrases: list[str], depth: int = 0) -> str:
    """Sorted phrases, none of which begins another."""
    if len(phrases) == 1:
        return _exactly(phrases[0])
    if depth > _DEEPEST:
        return "(?:" + "|".join(map(_exactly, phrases)) + ")"
    shared = commonprefix([phrases[0], phrases[-1]])
    rests = [p[len(shared):] for p in phrases]
    return _exactly(shared) + _choice([(c, list(g)) for c, g in groupby(rests, lambda r: r[0])], depth)


def shortest_phrases(phrases: Iterable[str]) -> list[str]:
    """In order, without those that begin with another: a text with the longer one has the shorter one too."""
    shortest: list[str] = []
    for phrase in sorted(set(phrases)):
        if not (shortest and phrase.startswith(shortest[-1])):
            shortest.append(phrase)
    return shortest


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A pattern found in a text exactly if the text holds one of *phrases*; an empty phrase is in every text."""
    shortest = shortest_phrases(phrases)
    return _any_of(shortest) if shortest else _NEVER


def phrase_udf(phrases: Iterable[str]):
    """The same as an Arrow UDF over an automaton, which each task builds from the phrases; for not empty phrases."""
    words = shortest_phrases(phrases)
    built = []

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if not built:
            from ahocorasick import Automaton

            automaton = Automaton()
            for word in words:
                automaton.add_word(word, True)
            automaton.make_automaton()
            built.append(automaton)
        found = [None if t is None else next(built[0].iter(t), None) is not None for t in texts]
        return pd.Series(found, dtype="object")

    return holds


def holds_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether *c* holds one of *phrases*; null for null. *c* is computed once.

    A long list makes it a Python UDF, which cannot stand inside ``transform`` and the like.
    """
    phrases = list(phrases)
    pattern = phrase_pattern(phrases)
    return c.rlike(pattern) if len(pattern) <= LONGEST_PATTERN else phrase_udf(phrases)(c)
