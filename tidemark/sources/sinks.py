"""Written tables: append, upsert, CSV reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.session import shared_dir


#: the partition column of tables kept by key range
PART = "key_range"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    """Append rows to a Parquet table; a stated schema is enforced by name and type."""
    out = df if schema is None else df.select(
        *[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    out.write.mode("append").parquet(path)


def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target with every key of the batch replaced by the batch rows."""
    kept = target.join(batch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(batch)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key: str,
                 new_path: str) -> DataFrame:
    """Upsert into a written table, into a new folder: the folder being read is never overwritten."""
    upsert(spark.read.parquet(path), batch, key).write.mode("errorifexists").parquet(new_path)
    return spark.read.parquet(new_path)


def gathered(df: DataFrame) -> DataFrame:
    """Rows of a range in one task, ranges over all tasks: adaptive execution would put a small table's many folders
    into one task, which writes them one after the other."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PART)


def create_partitioned(df: DataFrame, path: str, part: Column) -> None:
    """A new table kept by ranges (or buckets) of its key: one folder for each value of `part`, which is a column of
    the table named `PART`. Rows of a range come together before they are written, so a range is few files."""
    gathered(df.withColumn(PART, part)).write.partitionBy(PART).mode("errorifexists").parquet(path)


def partitioned_schema(spark: SparkSession, path: str, like: DataFrame) -> StructType:
    """The schema of a partitioned table, its range of the type that it has in `like`: folder names alone don't tell."""
    fields = spark.read.parquet(path).schema.fields
    return StructType([like.schema[PART] if f.name == PART else f for f in fields])


def ranges_of(keys: DataFrame, part: Column) -> list:
    """The ranges in which keys lie: as many as the table has ranges at most."""
    return [r[0] for r in keys.select(part.alias(PART)).distinct().collect()]


def read_partitioned(spark: SparkSession, path: str, schema: StructType, parts: Sequence | None = None) -> DataFrame:
    """The rows of a partitioned table; with `parts`, only the folders of these ranges are read."""
    table = spark.read.schema(schema).parquet(path)
    if parts is None:
        return table
    wanted = F.col(PART).isin([p for p in parts if p is not None])
    return table.filter(wanted | F.col(PART).isNull() if None in parts else wanted)


def upsert_partitions(spark: SparkSession, path: str, batch: DataFrame, key: str, part: Column,
                      replaced: DataFrame | None = None) -> list:
    """Replace every key of the batch (or of `replaced`) in a partitioned table by the batch rows; the ranges rewritten.

    Only ranges that hold such a key are read and written, the files of all others stay. The new ranges are
    written apart first and then moved in whole (dynamic partition overwrite), so nothing is read while it is
    overwritten, an executor lost on the way loses nothing, and a run that dies can be run again. `part` must give a
    key the same range always. How many ranges there are is chosen with the table; only their values come here.
    """
    placed = batch.withColumn(PART, part)
    schema = partitioned_schema(spark, path, placed)
    keys = (placed if replaced is None else replaced).select(key).distinct()
    touched = ranges_of(keys, part)
    if not touched:
        return []
    names = [f.name for f in schema.fields]
    staged = fresh_path(spark, "staged")
    kept = read_partitioned(spark, path, schema, touched).join(keys, key, "left_anti")
    gathered(kept.select(*names).unionByName(placed.select(*names))).write.partitionBy(PART).parquet(staged)
    (read_partitioned(spark, staged, schema).select(*names).write.partitionBy(PART).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))
    return touched


def write_clustered(df: DataFrame, path: str, key: str, sort: list[str], files: int) -> None:
    """Co-locate a key and sort inside files so that row-group statistics skip data."""
    (df.repartition(files, key).sortWithinPartitions(*sort)
     .write.mode("errorifexists").parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A report as CSV; in one file where the caller knows its rows to be few."""
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").option("header", True).csv(path)
