"""Where the modules of this folder put their queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: `clean` of functions/text.py in DuckDB, for texts in Latin script.
CLEAN_SQL = "trim(regexp_replace(regexp_replace(replace(replace(replace(lower(strip_accents(coalesce({0}, ''))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '[&+]', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
