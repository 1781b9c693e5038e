"""URLs and hosts as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from leadweave.functions.text import strip

_AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def with_scheme(url: Column) -> Column:
    """Strip; a non-empty URL without ``http(s)://`` gets ``https://``."""
    u = strip(url)
    bare = (u != "") & ~u.rlike("^https?://")
    return F.when(bare, F.concat(F.lit("https://"), u)).otherwise(u)


def _authority(url: Column) -> Column:
    return F.regexp_extract(F.translate(url, "\t\r\n", ""), _AUTHORITY, 1)


def host(url: Column) -> Column:
    """The part between ``//`` and the path, or null."""
    return F.nullif(_authority(url), F.lit(""))


def site(url: Column, legacy: bool = False) -> Column:
    """As :func:`site_key`, but empty where there is none. Names *url* once, which suits filters."""
    if legacy:
        return F.lower(F.regexp_replace(_authority(url), "^[w.]+", ""))
    return F.regexp_replace(F.lower(_authority(url)), r"^www\.", "")


def site_key(url: Column, legacy: bool = False) -> Column:
    """The host in lower case without ``www.``; null if there is none.

    With *legacy*, every leading ``w`` or ``.`` character goes, before lower-casing.
    """
    return F.nullif(site(url, legacy), F.lit(""))


def resolved(link: Column, page: Column) -> Column:
    """A link as an absolute URL, by the address of its page; as it is without one."""
    origin = site_base(page)
    folder = F.regexp_extract(page, r"^(https?://[^?#]*/)", 1)
    below = F.when(folder.rlike("^https?://[^/]+/"), folder).otherwise(F.concat(origin, F.lit("/")))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | origin.isNull(), link).when(
        F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(page, "^(https?:)", 1), link)
    ).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(below, link))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[\x00-\x20]*(?i:https?)://[^/?#]"), F.lit(False))


def site_base(url: Column) -> Column:
    """``scheme://host`` of a URL that has both, else null."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def on_listed_site(key: Column, sites) -> Column:
    """Whether a site key is one of *sites* or below one of them.

    Compares whole label suffixes with a set, so the cost does not depend on the list's length.
    """
    by_labels: dict[int, list[str]] = {}
    for site in sites:
        by_labels.setdefault(site.count(".") + 1, []).append(site)
    if not by_labels:
        return F.lit(False)
    tests = [F.substring_index(key, ".", -n).isin(group) for n, group in by_labels.items()]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def form_encoded(text: Column) -> Column:
    """Form encoding: space to ``+``, ``~`` kept, ``*`` encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
