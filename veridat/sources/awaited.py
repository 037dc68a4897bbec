"""How versions of several tables become visible together."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Awaited:
    """A version of a table that isn't there yet: what waits for it is seen once it is."""

    table: str
    number: int
    token: str
