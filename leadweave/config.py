"""Run settings and the checks on their text forms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from leadweave.fixed_values import (
    ACCEPTED_ANSWERS, BUSINESS_EMAIL_POINTS, CONTACT_PATHS, DESCRIPTION_LENGTH, FIELD_POINTS, FREE_EMAIL_POINTS,
    JUNK_NAME_PARTS, JUNK_SITES, MULTI_SOURCE_POINTS, REQUIRED_FIELDS, SOURCE_NAMES,
)


def _listed(text: str, allowed: Iterable[str], what: str) -> list[str]:
    """The names in a comma-separated text, each checked as it is met."""
    names = []
    for entry in text.split(","):
        name = entry.strip().lower()
        if not name:
            continue
        if name not in allowed:
            raise ValueError(f"no {what} is called {name!r}; choose from {', '.join(sorted(allowed))}")
        names.append(name)
    return names


def parse_sources(raw: str) -> list[str]:
    """Source names in run order; a name given twice runs twice."""
    return _listed(raw, SOURCE_NAMES, "source")


def parse_only(raw: str) -> list[str]:
    """Keywords of the fields a lead must have."""
    return _listed(raw, REQUIRED_FIELDS, "field")


@dataclass(frozen=True)
class ScoreWeights:
    """Points of a lead; the bounds of the score follow from them."""

    fields: dict[str, int] = field(default_factory=lambda: dict(FIELD_POINTS))
    business_email: int = BUSINESS_EMAIL_POINTS
    free_email: int = FREE_EMAIL_POINTS
    several_sources: int = MULTI_SOURCE_POINTS

    def __post_init__(self):
        unknown = set(self.fields) - (set(REQUIRED_FIELDS.values()) - {"email"})
        if unknown:
            raise ValueError(f"no points can be given for: {', '.join(sorted(unknown))}")

    @property
    def most(self) -> int:
        return self._bound(max)

    @property
    def least(self) -> int:
        return self._bound(min)

    def _bound(self, pick) -> int:
        email = pick(self.business_email, self.free_email, 0)
        return sum(pick(p, 0) for p in self.fields.values()) + email + pick(self.several_sources, 0)


@dataclass(frozen=True)
class Settings:
    query: str = ""
    location: str = ""
    limit: int | None = 20  # per source; None for no limit
    sources: list[str] = field(default_factory=lambda: ["maps"])
    only: list[str] = field(default_factory=list)
    min_score: int = 0
    filter_junk: bool = True
    filter_empty: bool = True
    address_backfill: bool = True
    dedup_mode: str = "exact"  # or "closure"
    # Hosts that many companies share (directories, social networks): they do not make two sightings one company.
    ignore_hosts: list[str] = field(default_factory=list)
    output_format: str = "both"  # "json" (one record a line), "json_array", "csv" or "both" (json and csv)
    output_dir: str = "results"
    # Reproduce the character-wise strip of leading "w" and "." in host names.
    legacy_hosts: bool = False
    contact_paths: list[str] = field(default_factory=lambda: list(CONTACT_PATHS))
    max_description_length: int = DESCRIPTION_LENGTH
    accepted_answers: list[str] = field(default_factory=lambda: list(ACCEPTED_ANSWERS))
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    # What the junk filter drops, besides the domains of a landed table. Any length.
    junk_sites: list[str] = field(default_factory=lambda: list(JUNK_SITES))
    junk_name_parts: list[str] = field(default_factory=lambda: list(JUNK_NAME_PARTS))
    # Spelled-out addresses count only if "at" and "dot" stand in brackets or between white space.
    strict_spelled_out: bool = False

    def __post_init__(self):
        if self.dedup_mode not in ("exact", "closure"):
            raise ValueError(f"unknown dedup mode: {self.dedup_mode}")
        if self.output_format.lower() not in ("json", "json_array", "csv", "both"):
            raise ValueError(f"unknown output format: {self.output_format}")
        object.__setattr__(self, "sources", self.sources or ["maps"])

    @property
    def search_term(self) -> str:
        return f"{self.query} {self.location}"


def output_base(settings: Settings, at: datetime, refused: bool = False) -> str:
    """Name of one export, without ending; both exports of a run share the time."""
    words = "_".join([*settings.sources, settings.query, settings.location])
    stamp = at.strftime("%Y%m%d_%H%M%S")
    return f"{words.lower().replace(' ', '_')}_{stamp}" + ("_refused" if refused else "")
