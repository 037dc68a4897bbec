"""Helpers on column names and identifiers."""

from __future__ import annotations

import json
import re

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_FILLER = frozenset("field value record data the of".split())


class DataQualityError(ValueError):
    """A request that can't be carried out as it stands."""


def identifier(name: str, what: str = "identifier") -> str:
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise DataQualityError(f"Invalid {what}: {name!r}")
    return name


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", str(name).lower()).strip("_")


def words(name: str) -> list[str]:
    return [w for w in plain(name).split("_") if w and w not in _FILLER]


def generalized(name: str) -> str:
    """The name with its numbered parts taken as one: owner_2_city is owner_{n}_city."""
    return re.sub(r"(^|_)\d+(?=_|$)", r"\1{n}", plain(name))


def find_column(columns, *wanted: str | None) -> str | None:
    """The first of ``wanted`` that ``columns`` has in any case, as it is written there."""
    by = {c.lower(): c for c in columns}
    return next((by[w.lower()] for w in wanted if w and w.lower() in by), None)


def canonical(value) -> str:
    """JSON with sorted keys, the same for equal values."""
    return json.dumps(value, sort_keys=True, default=str)


def first_object(text: str) -> dict:
    """The first JSON object in a reply, whose fences and surrounding words are skipped."""
    body = re.sub(r"```(?:json)?", "", text or "")
    at = body.find("{")
    if at < 0:
        raise DataQualityError("The reply has no JSON object.")
    try:
        found, _ = json.JSONDecoder(strict=False).raw_decode(body[at:])
    except json.JSONDecodeError as problem:
        raise DataQualityError(f"The reply isn't valid JSON: {problem.msg}") from None
    return found
