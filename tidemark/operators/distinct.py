"""Exact distinct counts over many groupings at once, from bitmaps that merge.

Counting distinct ids for a detail and its totals each from the rows takes a shuffle of the ids for each grouping. Here
the ids of a detail group become bitmaps (one for each 32,768 ids) where the rows are, and every coarser grouping is
the union of its details' bitmaps, so the rows are read and sent once.

Distinct members of unions of items meet block by block: a block of members is a bit matrix of items by members, a union
an or of its rows, so 64 members cost one operation and no pair of a set and a member is formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def distinct_rollup(df: DataFrame, dims: Sequence[str], ids: Mapping[str, str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """For each grouping set of `dims`: the dims (null where totalled), `level`, and the distinct ids of each column.

    `ids` is {new: column} of whole numbers; nulls don't count. `level` has a bit for each dim that is totalled, the
    first dim in the highest. Ids should be dense, as sequence numbers are: a bitmap is 4 KB however few ids it has, so
    for hashed ids count_distinct is the better way. Groups of any size are spread over the bitmaps' numbers.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("_k"), F.bitmap_bucket_number(F.col(c).cast("long")).alias("_b"),
                               F.bitmap_bit_position(F.col(c).cast("long")).alias("_p")) for k, c in enumerate(ids.values())])
    detail = (df.select(*dims, F.inline(kinds)).groupBy(*dims, "_k", "_b")
              .agg(F.bitmap_construct_agg("_p").alias("_bits")))
    totalled = sum((F.grouping(d).cast("int") * (1 << k) for k, d in enumerate(reversed(list(dims)))), F.lit(0))
    merged = (detail.groupingSets([[*s, "_k", "_b"] for s in sets], *dims, "_k", "_b")
              .agg(totalled.alias("level"), F.bitmap_or_agg("_bits").alias("_bits")))
    return merged.groupBy(*dims, "level").agg(
        *[F.coalesce(F.sum(F.when((F.col("_k") == k) & F.col("_b").isNotNull(), F.bitmap_count("_bits"))), F.lit(0)).alias(new)
          for k, new in enumerate(ids)])


#: rows of members, and sets, that meet in one group, on average; bits of a matrix, or of the rows of it that are laid together
BLOCK_ROWS, BLOCK_SETS, MATRIX_BITS = 1 << 18, 1 << 14, 1 << 27


def _union_bits(item: np.ndarray, member: np.ndarray, kinds: int, members: int, wanted: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each set of items, `wanted[start:next start]`, how many members hold any of them."""
    out = np.zeros(len(starts), np.int64)
    lengths = np.diff(starts, append=len(wanted))
    step = max(64, min(members, MATRIX_BITS // kinds))
    words = -(-step // 64)
    most = max(1, MATRIX_BITS // 64 // words)  # items whose rows are laid together
    cuts = [0]  # sets that are worked at once
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts + lengths, starts[cuts[-1]] + most, side="right"))))
    for low in range(0, members, step):
        here = (member >= low) & (member < low + step)
        m = member[here] - low
        bits = np.zeros((kinds, words), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), item[here] * words + (m >> 6), np.uint64(1) << (m & 63).astype(np.uint64))
        for a, b in zip(cuts, cuts[1:]):
            rows = bits[wanted[starts[a]:starts[b - 1] + lengths[b - 1]]]
            met = np.bitwise_or.reduceat(rows, starts[a:b] - starts[a], axis=0)
            out[a:b] += np.bitwise_count(met).sum(axis=1, dtype=np.int64)
    return out


def _count_unions(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The sets that a block of members meets, with the members of each and those that hold a marked item of it."""
    sets = asked.column("_items").combine_chunks()
    kinds, people = pc.unique(held.column("_item")), pc.unique(held.column("_member"))
    item = pc.index_in(held.column("_item"), value_set=kinds).to_numpy().astype(np.int64)
    member = pc.index_in(held.column("_member"), value_set=people).to_numpy().astype(np.int64)
    wanted = pc.index_in(sets.flatten(), value_set=kinds)
    known = wanted.is_valid().to_numpy(zero_copy_only=False)
    of_set = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy())[known]
    met, starts = np.unique(of_set, return_index=True)
    wanted = wanted.drop_null().to_numpy().astype(np.int64)
    marked = held.column("_marked").to_numpy()
    counts = [_union_bits(item[s], member[s], len(kinds), len(people), wanted, starts) if len(met) else np.zeros(0, np.int64)
              for s in (slice(None), marked)]
    return pa.table([sets.take(pa.array(met)), *map(pa.array, counts)], names=["_items", "_n", "_marked"])


def distinct_in_unions(asked: DataFrame, held: DataFrame, items: str, item: str, member: str, marked: str,
                       counts: tuple[str, str]) -> DataFrame:
    """For each distinct set of items: its distinct members, and those who hold a marked item of it.

    `asked` has arrays of items, `held` rows of an item, a member and a mark (true or false); both are read more than
    once: hand in written frames. Rows without an item or a member count nowhere, and a set that nobody holds has no row.
    Members and sets are dealt to blocks by hash and every block of members meets every block of sets, so what a task
    holds does not grow with the tables. The work is that of members times sets, by 64 members at a time.
    """
    sets = asked.select(F.col(items).alias("_items")).distinct()
    wanted = asked.select(F.explode(items).alias("_item")).distinct()
    rows = held.select(F.col(item).alias("_item"), F.col(member).alias("_member"), F.col(marked).alias("_marked")).filter(
        "_item is not null and _member is not null").join(wanted, "_item", "left_semi")
    blocks, chunks = held.count() // BLOCK_ROWS + 1, asked.count() // BLOCK_SETS + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = sets.withColumn("_chunk", deal("_items", chunks)).withColumn("_block", each(blocks)).groupBy("_chunk", "_block")
    right = rows.withColumn("_block", deal("_member", blocks)).withColumn("_chunk", each(chunks)).groupBy("_chunk", "_block")
    schema = StructType([sets.schema["_items"], StructField("_n", LongType()), StructField("_marked", LongType())])
    return (left.cogroup(right).applyInArrow(_count_unions, schema).groupBy(F.col("_items").alias(items))
            .agg(F.sum("_n").alias(counts[0]), F.sum("_marked").alias(counts[1])))
