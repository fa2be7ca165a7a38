"""The registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembled, documents, publication, publication_sql, scalars, streams

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return publication.QUERIES | scalars.QUERIES | documents.QUERIES | assembled.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return publication_sql.SQL | scalars.SQL | documents.SQL | assembled.SQL | streams.SQL
