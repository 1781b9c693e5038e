"""E-mail addresses: finding, cleaning, judging."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadweave.fixed_values import (
    ADDRESS, BARE_EMAIL_DOMAINS, FREE_EMAIL_DOMAINS, IMAGE_ENDINGS, PLACEHOLDER_EMAIL_DOMAINS,
    PLACEHOLDER_LOCALS, PLACEHOLDER_LOCAL_PARTS, SPACE,
)
from leadweave.functions.html import find_all
from leadweave.functions.text import contains_any, matches_any, present, strip

_S = f"[{SPACE}]*+"

# Spelled-out "at" and "dot", with or without brackets.
_AT = rf"{_S}(?:\[|\(|\{{)?{_S}(?:at|AT|At|arobase){_S}(?:\]|\)|\}})?{_S}"
_DOT = rf"{_S}(?:\[|\(|\{{)?{_S}(?:dot|DOT|Dot|point){_S}(?:\]|\)|\}})?{_S}"
_LOCAL = r"[a-zA-Z0-9._%+\-]+"
_LABEL = r"[a-zA-Z0-9\-]+"
# Fixed value: a spelled-out address.
SPELLED_OUT = rf"({_LOCAL}){_AT}({_LABEL}(?:{_DOT}{_LABEL})+)"
# The marks of strict mode: in brackets, or between white space, never inside a word.
_STRICT_AT, _STRICT_DOT = (
    rf"(?:{_S}[\[({{]{_S}(?:{words}){_S}[\])}}]{_S}|[{SPACE}]++(?:{words})[{SPACE}]++)"
    for words in ("at|AT|At|arobase", "dot|DOT|Dot|point")
)
STRICTLY_SPELLED_OUT = rf"({_LOCAL}){_STRICT_AT}({_LABEL}(?:{_STRICT_DOT}{_LABEL})+)"
# Where a run of local-part characters begins, or where the last match ended. A match that fails
# there fails at every later character of the run, so long runs cost one try instead of one each.
_RUN_START = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)"
# A mail link anywhere in text or code.
MAIL_LINK = rf"""(?i)mailto:{_S}["']?{_S}({ADDRESS})"""
# Characters cut from the end of a candidate.
_TAIL = ".,;:)]}>\"'"


def is_valid_email(email: Column) -> Column:
    """Well-formed and no obvious placeholder."""
    e = F.lower(email)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    image = "|".join(ending.replace(".", r"\.") for ending in IMAGE_ENDINGS)
    return (
        email.rlike(rf"^(?:{ADDRESS})\z")
        & ~domain.isin(PLACEHOLDER_EMAIL_DOMAINS + BARE_EMAIL_DOMAINS)
        & ~local.isin(PLACEHOLDER_LOCALS)
        & ~matches_any(local, PLACEHOLDER_LOCAL_PARTS)
        & ~e.rlike(rf"(?:{image})\z")
    )


def is_free_email(email: Column) -> Column:
    """Whether the address belongs to a consumer provider."""
    domain = F.substring_index(F.lower(email), "@", -1)
    listed = F.contains(email, F.lit("@")) & domain.isin(FREE_EMAIL_DOMAINS)
    return F.coalesce(present(email) & listed, F.lit(False))


def clean_email(candidate: Column) -> Column:
    return F.rtrim(strip(F.lower(candidate)), F.lit(_TAIL))


def accepted(candidates: Column) -> Column:
    """Cleaned, valid, each once, in order."""
    cleaned = F.transform(candidates, clean_email)
    return F.array_distinct(F.filter(cleaned, is_valid_email))


_AT_WORDS, _DOT_WORDS = ["at", "AT", "At", "arobase"], ["dot", "DOT", "Dot", "point"]


def may_hold_link(html: Column) -> Column:
    """False only for pages without any mail link: they neither have its mark nor numeric references to spell it by."""
    return F.contains(F.lower(html), F.lit("mailto:")) | F.contains(html, F.lit("&#"))


def may_hold_address(html: Column) -> Column:
    """False only for pages whose visible text has no address, plain or spelled out.

    No named reference gives one of the characters looked for, and a removed tag never joins two texts.
    """
    spelled = contains_any(html, _DOT_WORDS) & contains_any(html, _AT_WORDS)
    return F.contains(html, F.lit("@")) | F.contains(html, F.lit("&#")) | spelled


def in_text(text: Column) -> Column:
    return find_all(text, _RUN_START + ADDRESS, needs="@")


def in_links(targets: Column) -> Column:
    """Addresses of mail links among link targets."""
    mail = F.filter(targets, lambda t: F.startswith(F.lower(t), F.lit("mailto:")))
    return F.transform(mail, lambda t: strip(F.substring_index(F.substring(t, 8, 2**31 - 1), "?", 1)))


def in_code(text: Column) -> Column:
    """Addresses after ``mailto:`` in script bodies or raw HTML."""
    return find_all(text, MAIL_LINK, 1)


def spelled_out(text: Column, strict: bool = False) -> Column:
    """``name [at] host [dot] tld`` and its variants, as addresses.

    The marks may stand inside words, so ``datapointing`` is read as one too; not so if *strict*.
    """
    pattern, dot = (STRICTLY_SPELLED_OUT, _STRICT_DOT) if strict else (SPELLED_OUT, _DOT)
    # Without these words there is no match; the first test is the rarer one to pass.
    possible = contains_any(text, _DOT_WORDS) & contains_any(text, _AT_WORDS)
    matches = F.coalesce(F.when(possible, find_all(text, _RUN_START + pattern)), find_all(F.lit(""), "x"))

    def restore(match):
        local = F.regexp_extract(match, pattern, 1)
        domain = F.regexp_extract(match, pattern, 2)
        return F.concat(strip(local), F.lit("@"), F.btrim(F.regexp_replace(domain, dot, "."), F.lit(".")))

    return F.filter(
        F.transform(matches, restore), lambda a: F.contains(F.substring_index(a, "@", -1), F.lit("."))
    )
