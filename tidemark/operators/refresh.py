"""Facts kept up to date: what changed is recomputed, everything else is neither read nor written.

Logs and facts are tables kept by ranges of one key (`sinks.create_partitioned`). A refresh takes the keys that new log
rows touch, reads only the ranges of the log in which these keys lie, keeps their rows, builds the fact of these keys
alone, and replaces them in the ranges of the fact that hold them. Bytes read and written follow the change, not the
log's or the fact's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.ordered import id_lane
from tidemark.sources import sinks

#: ranges of a table, at most: a folder each, which the driver lists and a refresh writes one by one
RANGES = 512


def key_ranges(rows: DataFrame, key: str, least: int) -> Column:
    """The range of a whole-number key: `least` keys wide, or wider where the keys of `rows` would need over `RANGES`."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    return id_lane(key, least if low is None else max(least, -(-(high - low + 1) // RANGES)))


def append_log(rows: DataFrame, path: str, part: Column) -> None:
    """New rows beside the old ones, in the folders of their key ranges."""
    sinks.gathered(rows.withColumn(sinks.PART, part)).write.partitionBy(sinks.PART).mode("append").parquet(path)


def rows_of(spark: SparkSession, path: str, changed: DataFrame, key: str, part: Column) -> DataFrame:
    """The rows of a table kept by key range whose key is among `changed`; other ranges' files are not opened."""
    schema = sinks.partitioned_schema(spark, path, changed.select(part.alias(sinks.PART)))
    ranges = sinks.ranges_of(changed, part)
    return (sinks.read_partitioned(spark, path, schema, ranges).drop(sinks.PART)
            .join(changed.select(key).distinct(), key, "left_semi"))


def refresh(spark: SparkSession, log_path: str, fact_path: str, changed: DataFrame, key: str, part: Column,
            build: Callable[[DataFrame], DataFrame]) -> list:
    """Rebuild the fact rows of the changed keys; the ranges of the fact that were rewritten.

    `build` makes fact rows from log rows and must need no row of another key. A changed key of which `build` makes
    no row leaves the fact. The keys are read several times: hand in a checkpointed or written frame.
    """
    batch = build(rows_of(spark, log_path, changed, key, part))
    return sinks.upsert_partitions(spark, fact_path, batch, key, part, replaced=changed)


def touched_groups(changed: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """All keys of the groups in which a key changed, for facts that compare a key with others of its group."""
    groups = members.join(changed.select(key).distinct(), key, "left_semi").select(group).distinct()
    return members.join(groups, group, "left_semi").select(key).distinct()
