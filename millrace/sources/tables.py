"""Table sources: Parquet folders, JDBC with pushed-down predicates, and run-state tables."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, predicates: list[str] | None = None, fetch: int = 10_000, **properties: str) -> DataFrame:
    """A relational table, one Spark partition for each predicate (a chunk plan's ranges)."""
    settings = {"fetchsize": str(fetch), **properties}
    if predicates:
        return spark.read.jdbc(url, name, predicates=predicates, properties=settings)
    return spark.read.jdbc(url, name, properties=settings)


def quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value: object) -> str:
    """A value as a typed SQL literal."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE PRECISION)"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def range_predicates(column: str, bounds: list) -> list[str]:
    """Half-open SQL predicates from consecutive bounds, open at both ends."""
    lows, highs = [None, *bounds], [*bounds, None]
    name, out = quoted_name(column), []
    for low, high in zip(lows, highs, strict=True):
        parts = ([f"{name} > {literal(low)}"] if low is not None else []) + ([f"{name} <= {literal(high)}"] if high is not None else [])
        out.append(" AND ".join(parts) or "1 = 1")
    return out
