"""Small probes that work on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timefn import moment


def probe_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def probe_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by a stated order, so the sample is the same each run."""
    return df.orderBy(*order).limit(n)


def probe_count_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def filtered(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def count_between(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    day = F.to_date(F.col(column))
    return df.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).agg(
        F.count(F.lit(1)).alias("n"))


def rows_since(df: DataFrame, column: str, since: str) -> DataFrame:
    return df.filter(F.col(column) >= moment(since))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys side by side."""
    return df.agg(F.count(key).alias("rows_counted"), F.count_distinct(key).alias("distinct_keys"))
