"""Named queries over the supplied tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import campaign, events, experiment, model

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in (campaign, experiment, events, model):
        out.update(part.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (campaign, experiment, events, model):
        out.update(part.SQL)
    return out
