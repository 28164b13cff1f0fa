"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (dimension, integer weight). Queries and candidates are dealt to blocks by a hash of
their ids and each pair of blocks is one task's group: the candidates' postings are gathered dimension by
dimension, each query's weight of a dimension is scattered over that dimension's postings into dense score arrays,
and each query's best `k` of the block are selected by partition. The best of all blocks are then merged.

A stated query set meets all rows, so work is queries times rows; every group is bounded by the two block sizes.
Vectors that are null, or hold a null or non-finite component, take no part; an empty one scores 0 everywhere.
Missing dimensions count 0. Null ids take no part. Rows that share an id are candidates each, to all ids but theirs;
ties go to the smaller id. Repeated rows of a query are answered once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK = 2048
ROW_BLOCK = 16384
_PART = 256  # queries whose score arrays are held at once


def weights(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component, or null where one is null or not finite."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _sparse(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of all components that are not 0."""
    rows = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    n = np.diff(rows.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    dim = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    w = rows.flatten().to_numpy()
    some = w != 0
    return row[some], dim[some], w[some]


def _block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by([("vec_id", "ascending")])
            ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            row, dim, w = _sparse(rows.column("w"))
            order = np.argsort(dim, kind="stable")
            row, dim, w = row[order], dim[order], w[order]
            begin = np.flatnonzero(np.diff(dim, prepend=-1))
            postings = {int(dim[a]): (row[a:b], w[a:b]) for a, b in zip(begin, np.append(begin[1:], len(dim)))}
            qrow, qdim, qw = _sparse(queries.column("w"))
            for part in range(0, len(query_ids), _PART):
                names = query_ids[part:part + _PART]
                score = np.zeros((len(names), len(ids)), np.int64)
                here = (qrow >= part) & (qrow < part + len(names))
                r, d, v = qrow[here] - part, qdim[here], qw[here]
                for term in np.unique(d):
                    if int(term) not in postings:
                        continue
                    at, weight = postings[int(term)]
                    own = d == term
                    add = np.multiply.outer(v[own], weight)
                    if len(at) == len(ids) and own.sum() == len(names):
                        score += add
                    else:
                        score[np.ix_(r[own], at)] += add
                for q, name in enumerate(names):
                    others = np.flatnonzero(ids != name)
                    s = score[q][others]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        over, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
                        best = np.concatenate([over, ties[:k - len(over)]])
                    else:
                        best = np.arange(len(s))
                    out[0].append(np.full(len(best), name)), out[1].append(ids[others[best]]), out[2].append(s[best])
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out],
                        names=["query_id", "vec_id", "score"])
    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` greatest inner products of each query with other rows."""
    known = (rows.withColumn("_query", is_query).select(
        F.col(vec_id).cast("long").alias("vec_id"), weights(F.col(vector), scale).alias("w"), "_query")
        .where("vec_id is not null and w is not null"))
    count = known.agg(F.count("*"), F.count(F.when(F.col("_query"), 1))).first()
    row_blocks, query_blocks = max(1, -(-count[0] // ROW_BLOCK)), max(1, -(-count[1] // QUERY_BLOCK))
    spread = F.xxhash64("vec_id", "w")
    queries = (known.where("_query").select("vec_id", "w").distinct()
               .withColumn("qb", F.pmod(spread, F.lit(query_blocks)))
               .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))))
    others = (known.select("vec_id", "w").withColumn("rb", F.pmod(F.shiftright(spread, 20), F.lit(row_blocks)))
              .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))))
    met = queries.groupBy("qb", "rb").cogroup(others.groupBy("qb", "rb")).applyInArrow(
        _block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
