"""Table access: parquet scans with column projection, and schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """A source lacks columns that an operator needs."""


def table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One parquet table of a data folder, narrowed to the columns asked for."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return require(df, columns).select(*columns) if columns else df


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same frame, or MissingColumns naming every column that is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumns(f"missing columns: {', '.join(absent)}; present: {', '.join(df.columns)}")
    return df


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp; the session's zone is UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def stamp(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of microseconds since 1970."""
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
