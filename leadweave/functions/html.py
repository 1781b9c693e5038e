"""Flat HTML features as JVM regular expressions.

A removed tag, comment or script leaves one ``_GAP`` character, so neighbouring texts stay apart
without nested repetition in the patterns (which would need stack in proportion to the page).
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from leadweave.functions.text import let

_GAP = "\x01"
# Entity names and characters as the text of one map, so that plans hold one literal; the most
# frequent first.
_ENTITIES = "\x02".join(
    f"{name};\x03{chr(code)}"
    for name, code in {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "nbsp": 160, "apos": 39, **name2codepoint}.items()
)
_REFERENCE = r"^(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+(?=;));?"
# What never ends runs to the end of the page, so that a pattern is not tried again behind it.
_TAG = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
_COMMENT = r"<!--.*?(?:-->|\z)"


def _element(tag: str, body: str = ".*?") -> str:
    return rf"<{tag}(?=[\s/>])[^>]*+(?:>|\z){body}(?:</{tag}\s*+>|\z)"


def _none() -> Column:
    return F.array().cast("array<string>")


def find_all(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """All matches; skipped at once where the text lacks the substring *needs*."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if needs is not None:
        found = F.when(F.contains(text, F.lit(needs)), found)
    return F.coalesce(found, _none())


def _character(reference: Column) -> Column:
    """The character of a numeric reference; empty for a number that is none."""
    digits = F.regexp_extract(reference, "^#[xX]?0*+([0-9a-fA-F]*+)", 1)
    number = F.when(F.length(digits) > 8, "0").when(
        reference.rlike("^#[xX]"), F.conv(digits, 16, 10)
    ).otherwise(F.conv(digits, 10, 10))
    valid = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    return let(F.coalesce(number.cast("long"), F.lit(0)), lambda n: F.when(
        valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    ).otherwise(""))


def _entity(piece: Column) -> Column:
    """Decode the text after one ``&``."""
    names = F.str_to_map(F.lit(_ENTITIES), F.lit("\x02"), F.lit("\x03"))

    def decoded(reference):
        character = F.when(F.startswith(reference, F.lit("#")), _character(reference)).otherwise(
            F.try_element_at(names, reference)
        )
        rest = F.substring(piece, F.length(reference) + 1, F.length(piece))
        return F.concat(F.coalesce(character, F.concat(F.lit("&"), reference)), rest)

    return let(F.regexp_extract(piece, _REFERENCE, 0), decoded)


def decode_entities(text: Column) -> Column:
    """Named and numeric references, once each (``&amp;lt;`` gives ``&lt;``)."""

    def joined(pieces):
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_entity(p))), "")

    return joined(F.split(text, "&"))


def markup(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    pattern = f"(?is){_COMMENT}|{_element('script')}|{_element('style')}"
    return F.regexp_replace(html, pattern, _GAP)


def parsable(markup_: Column) -> Column:
    """Markup for the tree parser, which keeps texts apart at an empty tag."""
    return F.replace(markup_, F.lit(_GAP), F.lit("<wbr>"))


def script_text(html: Column) -> Column:
    """All script bodies outside comments, kept apart."""
    pattern = f"(?is){_COMMENT}|{_element('script', '(.*?)')}"
    bodies = F.filter(find_all(html, pattern, 1), lambda b: b != "")
    return F.array_join(bodies, _GAP)


def text_of(markup_: Column) -> Column:
    """The text pieces of markup, joined by one space."""
    pattern = f"(?is){_element('template')}|{_TAG}"
    gapped = F.btrim(F.regexp_replace(markup_, pattern, _GAP), F.lit(_GAP))
    return decode_entities(F.regexp_replace(gapped, _GAP + "+", " "))


def visible_text(html: Column) -> Column:
    return text_of(markup(html))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2")


_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def link_targets(markup_: Column, like: str | None = None) -> Column:
    """Decoded ``href`` values of all links, in page order; with *like*, of those whose raw value, in quotes or not, has this pattern."""
    # Up to the next link at most, so that links without target are not read to the end each.
    values = find_all(markup_, rf"(?is)<a(?=\s)(?:(?!<a\s)[^>])*?\shref\s*+=\s*+{_VALUE}", 1)
    if like is not None:
        values = F.filter(values, lambda v: v.rlike(like))
    return F.transform(values, lambda v: decode_entities(_unquote(v)))


def _attribute(tag: Column, name: str) -> Column:
    return decode_entities(_unquote(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{_VALUE}", 1)))


def _meta_content(markup_: Column, attribute: str, value: str) -> Column:
    """Content of the first meta tag whose attribute has exactly this value; empty if none."""
    tags = find_all(markup_, r"""(?is)<meta(?=[\s/])(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)""")
    wanted = rf"""\s(?i:{attribute})\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s/>]))"""
    first = F.get(F.filter(tags, lambda t: t.rlike(wanted)), F.lit(0))
    return F.coalesce(_attribute(first, "content"), F.lit(""))


def meta_description(markup_: Column) -> Column:
    """The page's own description, else the one for link previews, else empty. Not stripped."""
    own = _meta_content(markup_, "name", "description")
    shared = _meta_content(markup_, "property", "og:description")
    return let(own, lambda o: F.when(o != "", o).otherwise(shared))


def flat_element(markup_: Column, tag: str) -> Column:
    """The first element of this tag, with its tags; empty if there is none.

    Null where a pattern cannot tell: elements nested in themselves, or never closed.
    """
    opening = rf"<{tag}(?=[\s/>])"
    pattern = rf"(?is){opening}[^>]*+(?:>|\z).*?(?:</{tag}\s*+>|\z)"
    found = F.regexp_extract(markup_, pattern, 0)
    return let(found, lambda e: (
        F.when(e == "", "").when(e.rlike(rf"(?i)</{tag}\s*+>\z") & ~e.rlike(f"(?is).{opening}"), e)
    ))


def body_of(markup_: Column) -> Column:
    """What follows the body tag; without one, everything but the head."""
    after = F.regexp_extract(markup_, r"(?is)<body(?=[\s/>])[^>]*+(?:>|\z)(.*)\z", 1)
    # Up to the next such tag at most, so that unclosed ones are not read to the end each.
    inside = lambda tag: rf"<{tag}(?=[\s>])(?:(?!<{tag}[\s>]).)*?</{tag}\s*+>"
    headless = F.regexp_replace(markup_, rf"(?is){inside('head')}|{inside('title')}", _GAP)
    return F.when(markup_.rlike(r"(?is)<body(?=[\s/>])"), after).otherwise(headless)


def may_match_attribute_selectors(markup_: Column) -> Column:
    """Whether any tag may be a content block by role, id or class."""
    return markup_.rlike(
        r"""(?is)\s(?:role|id|class)\s*=\s*(?:"[^"]*|'[^']*)?(?:main|content)"""
    )
