"""Readers for tables, CSV files and parameterised query text."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Tables:
    """The tables of one folder; each is read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        return self._read[name]


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> DataFrame:
    """A CSV with a header, read with a stated schema so no inference pass is needed."""
    return (spark.read.option("header", True).option("timestampNTZFormat", timestamp_format)
            .option("mode", "FAILFAST").schema(schema).csv(path))


def run_text(spark: SparkSession, text: str, args: dict | None = None,
             **frames: DataFrame) -> DataFrame:
    """Run query text with named parameters; frames are bound by ``{name}``."""
    return spark.sql(text, args=args or {}, **frames)


def fill_template(text: str, **values: str) -> str:
    """Replace ``$name`` marks of a stored query by identifiers (values go in as parameters)."""
    for name, value in values.items():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", value):
            raise ValueError(f"not an identifier: {value}")
        text = text.replace(f"${name}", value)
    return text
