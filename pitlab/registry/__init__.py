"""Named queries over the stand-in tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pitlab.standins.frames import Standins


@dataclass(frozen=True)
class Query:
    """``covers`` names the SURVEY operators that the query exercises."""

    build: Callable[[Standins], DataFrame]
    sql: str | None
    covers: str


def all_queries() -> dict[str, Query]:
    from pitlab.registry import audits, bars, execution, files, identities, signals, universes, vendors

    merged: dict[str, Query] = {}
    for module in (bars, universes, signals, identities, execution, audits, vendors, files):
        clash = merged.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(module.QUERIES)
    return merged
