"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame functions alone.

Each source's documents, in the order of a hash of their ids, make a stream of words that starts again at its end.
A mix holds `percent` % of all words. Slot i lies at the point frac((i + 1/2) * golden ratio) of the unit interval, on
which each source owns a piece as long as its target, or as `SLOTS_A_SOURCE` blocks of the mix if that is longer; the
j-th slot of a source takes the j-th block of its stream. The words of a source's target, to the word, go in equal
blocks to all slots it owns (or, where it has fewer words than slots, one by one to evenly chosen ones). Golden-ratio
points leave every piece within a few slots of its share at any time, so sources alternate evenly, blocks of large
sources are of about one size, and every source ends at its target, whatever its size.

Targets: weights repeat over the sources in code point order, a null source last. No source gives more than
`most` times its size; what it can't give is shared by weight among the others until none is above. No document
is taken more than `most` times. A null or empty text is of size 0 and is never taken. Rows that repeat are
separate documents. Sums along a stream run in hash lanes of the source, and documents meet their source's figures by lane,
so a source of any size spreads over tasks; what stands in one task is a row per source, or a source's slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import frames

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
SLOTS = 1 << 16
SLOTS_A_SOURCE = 256
LANE_DIGITS = 3  # of the hash that orders a stream: 4096 lanes
GOLDEN = 0.6180339887498949


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """One row for each source of (source, source_size): its number, weight, target and piece [low, high) of the
    unit interval. Sources whose limit per weight lies under the common level give their limit, the others their
    weight times the level; the level follows from running sums over the sources in the order of those limits."""
    one = F.lit(0)  # one row per source
    named = sizes.withColumn("number", F.row_number().over(
        Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("long")
    named = named.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.partitionBy(one).orderBy(F.col("limit") / F.col("weight"), "number")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(one)
    named = (named.withColumn("total", F.sum("source_size").over(whole))
             .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0)))
             .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the level if this source and those after it stay under their limits, in 100ths
    left = percent * F.col("total") - 100 * F.col("spent")
    level = F.struct(left.alias("left"), "open")
    under = left * F.col("weight") <= 100 * F.col("open") * F.col("limit")
    named = named.withColumn("level", F.min(F.when(under, F.struct(
        (F.col("limit") / F.col("weight")).alias("r"), "number", level.alias("l")))).over(whole))
    got = F.col("level.l.left") * F.col("weight") / (100 * F.col("level.l.open"))
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(
        F.least(got, F.col("limit").cast("double")))
    run = Window.partitionBy(one).orderBy("number")
    return (named.withColumn("target", target)
            .withColumn("high", F.sum("target").over(run.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("all", F.sum("target").over(whole))
            .select("source", "source_size", "number", "weight", "target",
                    ((F.col("high") - F.col("target")) / F.col("all")).alias("low"),
                    (F.col("high") / F.col("all")).alias("high"), "all"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, number, rank): the source of each slot and its place among that source's slots, from 0."""
    spark = sources.sparkSession
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    cells = 4096  # a point meets only the sources whose piece reaches into its cell of the interval
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    pieces = sources.where("target > 0").select(
        "number", "low", F.when(F.col("high") >= 1 - 1e-12, 2.0).otherwise(F.col("high")).alias("high"))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    owned = points.join(pieces, "cell").where("u >= low and u < high")
    return owned.select("slot", "number", (F.row_number().over(
        Window.partitionBy("number").orderBy("slot")) - 1).cast("long").alias("rank"))


def pieces(goals: DataFrame, block: int) -> DataFrame:
    """`goals` with pieces [low, high) of the unit interval that hold a point for each block of `block` words of a
    source's target, and for `SLOTS_A_SOURCE` blocks at least; `slots` points fill the interval."""
    least = F.lit(SLOTS_A_SOURCE * block).cast("double")
    wide = goals.withColumn("piece", F.when(F.col("target") > 0, F.greatest("target", least)).otherwise(0.0))
    whole = Window.partitionBy(F.lit(0))  # one row per source
    run = whole.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumn("high", F.sum("piece").over(run)).withColumn("length", F.sum("piece").over(whole))
    return wide.select("source", "number", "target", "source_size",
                       ((F.col("high") - F.col("piece")) / F.col("length")).alias("low"),
                       (F.col("high") / F.col("length")).alias("high"), F.floor(F.col("length") / block).alias("slots"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST,
        slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed, parts).

    placed: a row per input row with row (a hash of all its columns), doc_id, size, source_size, target, number and
    start, its place in the source's stream. parts: slot, number, rank of the block, start of the document, doc_id,
    row, turn (which time round the stream), offset and length of the words taken from it.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.xxhash64(*[F.col(c) for c in docs.columns]).alias("row"), word_count(F.col(text)).alias("size"))
    sized = sized.withColumn("at", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = frames.written(sized.withColumn("lane", F.substring("at", 1, LANE_DIGITS)), "sized")
    lanes = frames.written(sized.groupBy("source", "lane").agg(F.sum("size").alias("words")), "lanes")
    sizes = lanes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = frames.written(targets(sizes, weights, percent, most), "targets")
    count, total = goals.agg(F.count("*"), F.max("all")).first()
    block = max(1, int((total or 0) / max(slots, SLOTS_A_SOURCE * count)))
    owned = frames.written(pieces(goals, block), "pieces")
    wanted = frames.written(schedule(owned, owned.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]), "schedule")

    # a source's words go in as many blocks as it has slots, or words if these are fewer
    given = F.round("target").cast("long")
    dealt = (owned.join(wanted.groupBy("number").agg(F.count("*").alias("owns")), "number", "left")
             .select("source", "number", "target", "source_size", given.alias("given"), F.coalesce("owns", F.lit(0)).alias("owns"))
             .withColumn("blocks", F.least("owns", "given")))
    ahead = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = (lanes.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
             .join(dealt.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    inner = Window.partitionBy("source", "lane").orderBy("at", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    lanes = lanes.withColumnsRenamed({"source": "s2", "lane": "l2"})
    placed = placed.join(lanes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("lane") == F.col("l2"))).select(
        "row", "doc_id", "source", "size", "source_size", "target", "number", "given", "owns", "blocks",
        (F.col("ahead") + F.col("before")).alias("start"))
    placed = frames.written(placed, "placed")

    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    begin = F.col("turn") * F.col("source_size") + F.col("start")
    parts = (placed.where("size > 0").withColumn("turn", turns)
             .withColumn("a", begin).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("given"))).where("a < b")
             # block j holds the words from floor(j * given / blocks) on and takes every (owns / blocks)-th slot
             .withColumn("block", F.expr("explode(sequence(((a + 1) * blocks - 1) div given, (b * blocks - 1) div given))"))
             .withColumn("from", F.expr("greatest(a, block * given div blocks)"))
             .withColumn("to", F.expr("least(b, (block + 1) * given div blocks)"))
             .withColumn("rank", F.expr("(block * owns + blocks - 1) div blocks")))
    parts = parts.join(wanted, ["number", "rank"]).select(
        "slot", "number", F.col("block").alias("rank"), "start", "doc_id", "row", "turn",
        (F.col("from") - F.col("a")).alias("offset"), (F.col("to") - F.col("from")).alias("length"))
    return placed, parts


def taken(docs: DataFrame, **names) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every row."""
    placed, parts = mix(docs, **names)
    # a document with words is known by its stream and its place there
    got = parts.groupBy("number", "start").agg(F.sum("length").alias("taken"))
    full = placed.where("size > 0").join(got, ["number", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target",
                                         F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` as the mix takes them, with its columns: a row for each time a document is taken; a document that
    the mix takes in part holds those of its words, with single blanks."""
    placed, parts = mix(docs, doc_id, text, source)
    row, begin, length, cut = (frames.free(x, docs) for x in ("_row", "_from", "_length", "_cut"))
    pieces = parts.groupBy("number", "start", "turn", "row").agg(
        F.min("offset").alias(begin), F.sum("length").alias(length)).withColumnRenamed("row", row)
    whole = docs.withColumn(row, F.xxhash64(*[F.col(c) for c in docs.columns])).dropDuplicates([row])
    met = whole.join(pieces.select(row, begin, length), row)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.array_join(F.slice(words, (F.col(begin) + 1).cast("int"), F.col(length).cast("int")), " ")
    out = met.withColumn(cut, F.when(F.col(length) == word_count(F.col(text)), F.col(text)).otherwise(some))
    columns = {c: F.col(c) for c in docs.columns} | {text: F.col(cut)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(cut).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])
