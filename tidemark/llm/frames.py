"""Spark helpers of this subpackage: written tables, membership bitmaps, connected components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, df: DataFrame) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Arrow batches between Spark and its Python workers stay this small, whatever the texts' length.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark application, as --py-files would.

    Where the session doesn't say otherwise, bounds the bytes of an Arrow batch.
    """
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    if getattr(context, "_tidemark_shipped", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "tidemark"), "zip", top, "tidemark"))
        context._tidemark_shipped = True
    return spark


def buckets_for(spark: SparkSession, each: int = 2) -> int:
    """Buckets of a hash-partitioned table: `each` for a shuffle partition."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, divisor: int, remainder: int):
    """True for rows whose crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % divisor == remainder, F.lit(False))


class Bitmap:
    """A fixed-size set of 64-bit hashes that may hold strangers but misses no member (two bits a hash)."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _bits(h: np.ndarray, bits: int):
        mask = np.uint64((1 << bits) - 1)
        return h & mask, (h >> np.uint64(64 - bits)) & mask

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 24) -> Bitmap:
        """From a long column; at most 2^bits bits ever reach the driver, whatever the rows."""
        h, mask = F.col(column), (1 << bits) - 1
        spots = df.where(h.isNotNull()).select(F.explode(F.array(
            h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 64 - bits))).alias("b"))
        one = F.expr("shiftleft(1L, cast(b & 63 as int))")
        rows = spots.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
        words = np.zeros(max(1, 1 << (bits - 6)), np.int64)
        words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
        return cls(words.view(np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = int(len(self.words)).bit_length() + 5
        found = np.arange(len(h))
        for b in self._bits(h, bits):  # the second bit is looked at only where the first is set
            b = b[found]
            found = found[(self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(h), bool)
        out[found] = True
        return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its part) of a small edge list, by label passing with jumps."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[:len(a)], inverse[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(before, root):
            return nodes, nodes[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable over undirected edges of long ids; nodes without edges are absent.

    Edges are contracted within partitions, then large and small stars alternate until nothing changes. Each
    step is a shuffle by node whose groups are split by a partial minimum, and is written to the shared folder.
    """

    def contract(batches: Iterator[pa.RecordBatch]):
        left, right = [], []
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(x):
                node, root = _forest(x, y)
                left.append(node), right.append(root)
        if left:
            node, root = _forest(np.concatenate(left), np.concatenate(right))
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])

    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(pairs.mapInArrow(contract, "u long, v long"), "edges")
    while True:
        # large star: every larger neighbour of a node is tied to its least neighbour (or itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour, and the node itself, is tied to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        after = written(small.where("u <> v").distinct(), "edges")
        if _same(now, after):
            roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        now = after


def _same(a: DataFrame, b: DataFrame) -> bool:
    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return mark(a) == mark(b)


def array_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def record(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema)], schema=schema)
