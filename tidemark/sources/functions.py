"""Operators that stored query text can call: SQL table functions over their results, and session variables.

An operator's frame becomes a temporary view and a table function over it, whose parameters stand in a predicate on the
operator's columns; nothing runs until a query calls it, and the predicate is part of that query's plan. Values that
many stored texts share, an as-of date or a threshold, are session variables, set in one place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _checked(*names: str) -> None:
    for name in names:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not an identifier: {name}")


def publish(frame: DataFrame, name: str, parameters: Mapping[str, str] | None = None, where: str = "true") -> None:
    """Let query text say `name(...)` for the rows of `frame` where the predicate holds.

    `parameters` is {name: SQL type}; `where` is a SQL predicate over them and the frame's columns, written by
    whoever publishes the operator, not by its callers, whose arguments are values. A function published again is
    replaced. Columns win over parameters of the same name.
    """
    spark, parameters = frame.sparkSession, dict(parameters or {})
    _checked(name, *parameters)
    frame.createOrReplaceTempView(f"{name}_rows")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    takes = ", ".join(f"{n} {kind}" for n, kind in parameters.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({columns}) "
              f"RETURN SELECT * FROM {name}_rows WHERE {where}")


def set_variable(spark: SparkSession, name: str, kind: str, value) -> None:
    """A session variable of that SQL type; the value is bound, never written into text."""
    _checked(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = (SELECT CAST(:value AS {kind}))", args={"value": value})
