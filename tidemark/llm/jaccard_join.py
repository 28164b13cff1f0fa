"""N-gram Jaccard join of documents: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct word n-grams, told apart by 64-bit hashes; documents with one and the same
set form one class. Two classes link when their sets' Jaccard similarity reaches `percent`/100. Steps:

1. *Shared n-grams.* Batches send each distinct n-gram once to its hash bucket, with its only owner or a mark that
   the batch holds it more than once. A class of which fewer than `percent` % of the n-grams occur in another
   class can link with nothing and leaves; the survivors' sets are written.
2. *Prefix index.* N-grams are ordered from rare to frequent; by the prefix principle only the first
   n - ceil(t n) + 1 of a set are posted, each with the set's size and its place (length, positional filter).
3. *Pairs.* The classes of a posting list are first paired with the list's least class alone. The links found
   join them to components; then the pairs of a list whose two classes are in different components follow, and
   none else: a pair already joined through others changes no component. So a group of copies costs pairs in
   proportion to its size and loses no link. Each pair is verified once, after a suffix filter.

Rows with a null id, and rows without words, link with nothing. Rows that repeat an id are separate documents
under that id. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import frames, words as W

ORDERED = 1 << 18  # most frequent n-grams whose exact counts order the prefixes; 4 MB to each task
PARTS = 64  # hash ranges of the suffix filter
_STATS = "doc_id long, n long, class long, key long, shared long"
_ROWS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()),
                   ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def gram_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending within each text, their count per text): the distinct n-grams of each text.

    A text of fewer than n words, but one at least, is one n-gram.
    """
    h, counts = W.words(column, W.blank_words())
    places, text = W.gram_places(counts, n)
    g = W.grams(h, n)[places]
    first = np.cumsum(counts) - counts
    for short in range(1, n):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            g = np.concatenate([g, W.grams(h, short)[first[rows]]])
            text = np.concatenate([text, rows])
    order = np.argsort(g)
    order = order[W.by_text(text[order], len(counts))]
    g, text = g[order], text[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[keep], text[keep]
    return g, np.bincount(text, minlength=len(counts))


def class_of(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, 0 for the empty one."""
    total = np.concatenate([np.zeros(1, W.U), np.cumsum(W.mix(g ^ W.U(0x5851F42D4C957F2D)), dtype=W.U)])
    ends = np.cumsum(sizes)
    out = W.mix((total[ends] - total[ends - sizes]) + sizes.astype(W.U))
    return np.where(sizes > 0, out, W.U(0))


def _need(percent: int, size):
    """Least overlap of a set of that size with any set it links with."""
    return -(-percent * size // 100)


def _emit(n: int, buckets: int, text: str, doc_id: str):
    """Rows of kind 1: a batch's documents; of kind 0: its n-grams of one bucket with their only owners."""
    def run(batches: Iterator[pa.RecordBatch]):
        part, number = TaskContext.get().partitionId(), 0
        for batch in W.text_batches(batches, text, 4 << 20):
            name, number = (part << 32) + number, number + 1
            g, sizes = gram_sets(batch.column(text), n)
            classes = class_of(g, sizes)
            ids = batch.column(doc_id)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            # one text of each class in the batch speaks for it; texts without an id never link
            row = np.flatnonzero(valid & (sizes > 0))
            row = row[np.unique(classes[row], return_index=True)[1]]
            speaks = np.zeros(len(sizes), bool)
            speaks[row] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            chosen = speaks[owner]
            gs, owner = g[chosen], owner[chosen]
            order = np.argsort(gs)
            gs, owner = gs[order], owner[order]
            begin = W.run_starts(gs)
            times = np.diff(np.append(begin, len(gs)))
            shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sizes))
            yield frames.record(_ROWS, [
                [name % buckets], [name], [1], [ids.fill_null(0).to_numpy().astype("<i8").tobytes()],
                [valid.tobytes()], [sizes.astype("<i8").tobytes() + shared.astype("<i8").tobytes()],
                [classes.tobytes()]])
            once, who = gs[begin], np.where(times > 1, 0, owner[begin] + 1)  # 0: the batch holds it more than once
            cuts = W.bucket_cuts(once, buckets)
            full = np.flatnonzero(np.diff(cuts))
            a, b, c, d = [], [], [], []
            for k in full:
                part_of = slice(cuts[k], cuts[k + 1])
                here, at = np.unique(who[part_of], return_inverse=True)
                a.append(W.pack_sorted(once[part_of]))
                b.append(W.pack_small(at))
                c.append(np.where(here > 0, classes[here - 1], W.U(0)).tobytes())
                d.append(W.pack_sorted(here.astype(W.U)))
            yield frames.record(_ROWS, [full, [name] * len(full), [0] * len(full), a, b, c, d])
    return run


def _share(table: pa.Table) -> pa.Table:
    """One bucket: for each batch, how many n-grams of each of its classes occur in another class."""
    kinds, names = table.column("kind").to_numpy(), table.column("batch")
    documents = table.filter(pa.array(kinds == 1)).drop_columns(["bucket"])
    rows = table.filter(pa.array(kinds == 0))
    if not rows.num_rows:
        return documents
    grams = [W.unpack_sorted(x.as_py()) for x in rows.column("a")]
    places = [W.unpack_small(x.as_py()) for x in rows.column("b")]
    classes = [np.frombuffer(x.as_py(), W.U) for x in rows.column("c")]
    local = [W.unpack_sorted(x.as_py()).astype(np.int64) for x in rows.column("d")]
    ends = np.cumsum([len(g) for g in grams])
    g = np.concatenate(grams)
    del grams
    order = np.argsort(g)
    begin = W.run_starts(g[order])
    del g
    who = np.concatenate([c[p] for c, p in zip(classes, places)])[order]
    low = np.minimum.reduceat(who, begin)
    mixed = (low != np.maximum.reduceat(who, begin)) | (low == 0)
    del who
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(mixed, np.diff(np.append(begin, len(order))))
    del order
    counts = [np.bincount(p[s], minlength=len(m)) for p, s, m in zip(places, np.split(shared, ends[:-1]), local)]
    return pa.concat_tables([documents, pa.table([
        rows.column("batch"), pa.array(np.zeros(len(ends), np.int8)),
        pa.array([m[c > 0].tobytes() for m, c in zip(local, counts)], pa.binary()),
        pa.array([c[c > 0].astype("<i8").tobytes() for c in counts], pa.binary()),
        pa.nulls(len(ends), pa.binary()), pa.nulls(len(ends), pa.binary())], schema=documents.schema)])


def _total(table: pa.Table) -> pa.Table:
    """One batch: its documents, each class's shared n-grams beside the row that speaks for it."""
    out = {x: [] for x in ("doc_id", "n", "class", "key", "shared")}
    kinds = table.column("kind").to_numpy()
    a, b, c, d = (table.column(x) for x in "abcd")
    at = [k for k in range(len(kinds)) if kinds[k] == 1]
    for k in at:
        ids, valid = np.frombuffer(a[k].as_py(), "<i8"), np.frombuffer(b[k].as_py(), bool)
        sizes, shared = np.frombuffer(c[k].as_py(), "<i8").reshape(2, -1)
        shared = shared.copy()
        for j in np.flatnonzero(kinds == 0):
            rows, count = np.frombuffer(a[int(j)].as_py(), "<i8"), np.frombuffer(b[int(j)].as_py(), "<i8")
            some = rows > 0
            shared[rows[some] - 1] += count[some]
        for name, column in zip(out, (pa.array(ids, mask=~valid), pa.array(sizes), pa.array(
                np.frombuffer(d[k].as_py(), np.int64)), pa.array(id_key(ids), mask=~valid), pa.array(shared))):
            out[name].append(column)
    return pa.table({x: pa.chunked_array(v, pa.int64()) for x, v in out.items()})


def id_key(ids: np.ndarray) -> np.ndarray:
    return W.mix(ids.astype(np.int64).view(W.U) + W.U(1)).view(np.int64)


def _sets(n: int, text: str, doc_id: str, wanted):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, text, 4 << 20):
            ids = batch.column(doc_id)
            key = id_key(ids.fill_null(0).to_numpy()).view(W.U)
            take = ids.is_valid().to_numpy(zero_copy_only=False) & wanted.value.has(key)
            batch = batch.filter(pa.array(take))
            if not batch.num_rows:
                continue
            g, sizes = gram_sets(batch.column(text), n)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(doc_id).cast(pa.int64()), pa.array(class_of(g, sizes).view(np.int64)), pa.array(sizes),
                pa.array([W.pack_sorted(g[e - s:e]) for s, e in zip(sizes, ends)], pa.binary())],
                names=["doc_id", "class", "n", "grams"])
    return run


def _each_gram(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.sort(np.concatenate([W.unpack_sorted(x) for x in batch.column("grams").to_pylist()]))
        at = W.run_starts(g)
        yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(np.diff(np.append(at, len(g))))],
                                         names=["gram", "df"])


def _postings(percent: int, often):
    def run(batches: Iterator[pa.RecordBatch]):
        known, count = often.value
        for batch in batches:
            out = [[], [], [], [], []]
            for c, blob in zip(batch.column("class").to_numpy(), batch.column("grams").to_pylist()):
                g = W.unpack_sorted(blob)
                at = np.searchsorted(known, g)
                at[at == len(known)] = 0
                df = np.where(known[at] == g, count[at], 0) if len(known) else np.zeros(len(g), np.int64)
                g = g[np.lexsort((g, df))][:len(g) - _need(percent, len(g)) + 1]
                out[0].append(g.view(np.int64)), out[1].append(np.full(len(g), c))
                out[2].append(np.full(len(g), len(at))), out[3].append(np.arange(len(g)))
                # how much of the set others hold too: an original before its altered copies
                out[4].append(np.full(len(g), int(1000 * np.log2(1 + df).mean())))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out],
                                                 names=["gram", "class", "n", "place", "weight"])
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist()):
                x, y = W.unpack_sorted(x), W.unpack_sorted(y)
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                # suffix filter: sets that differ in their counts over hash ranges can't overlap enough
                apart = np.abs(np.bincount((x >> W.U(58)).astype(np.int64), minlength=PARTS)
                               - np.bincount((y >> W.U(58)).astype(np.int64), minlength=PARTS)).sum()
                if len(x) + len(y) - apart < 2 * least:
                    keep.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            picked = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(picked), batch.column("b").filter(picked)],
                                             names=["a", "b"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(
        _verify(percent), "a long, b long")


def _passes(percent: int, n1: str, p1: str, n2: str, p2: str):
    """Length and positional filter: both sizes, and what can still be common from the shared n-gram on."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    least = F.ceil(F.lit(percent) * (F.col(n1) + F.col(n2)) / F.lit(100 + percent))
    rest = 1 + F.least(F.col(n1) - F.col(p1) - 1, F.col(n2) - F.col(p2) - 1)
    return (100 * small >= percent * large) & (rest >= least)


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 5,
                 percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: a row per input row with doc_id, n (size of its set) and class; links: (a, b) of classes, a < b,
    whose components are those of all links.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = frames.buckets_for(spark, 1)  # a bucket names each class it has n-grams of
    blobs = "kind tinyint, a binary, b binary, c binary, d binary"
    sent = docs.mapInArrow(_emit(words_each, buckets, "text", "doc_id"), f"bucket int, batch long, {blobs}")
    stats = sent.groupBy("bucket").applyInArrow(_share, f"batch long, {blobs}").groupBy("batch").applyInArrow(
        _total, _STATS)
    stats = frames.written(stats, "shingle-stats")
    members = stats.select("doc_id", "n", "class", "key")
    # an over-count at worst (a class sent by several batches), so no class that links is lost
    shared = stats.where("doc_id is not null and n > 0").groupBy("class").agg(
        F.sum("shared").alias("shared"), F.max("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("r"))
    alive = frames.written(shared.where(100 * F.col("shared") >= percent * F.col("n")).select(
        "class", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.key").alias("key")), "alive")
    wanted = spark.sparkContext.broadcast(frames.Bitmap.of(alive, "key"))
    sets = docs.mapInArrow(_sets(words_each, "text", "doc_id", wanted),
                           "doc_id long, class long, n long, grams binary")
    sets = frames.written(sets.join(alive.select("doc_id", "class"), ["doc_id", "class"], "left_semi")
                          .dropDuplicates(["class"]).select("class", "n", "grams"), "sets")
    counted = (sets.mapInArrow(_each_gram, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
               .where("df > 1").orderBy(F.desc("df"), "gram").limit(ORDERED).toArrow())
    gram, df = counted.column("gram").to_numpy().view(W.U), counted.column("df").to_numpy()
    order = np.argsort(gram)
    often = spark.sparkContext.broadcast((gram[order], df[order]))
    posts = sets.mapInArrow(_postings(percent, often), "gram long, class long, n long, place long, weight long")
    lists = posts.groupBy("gram").agg(F.max(F.struct("weight", "class", "n", "place")).alias("r"),
                                      F.count("*").alias("c"))
    posts = frames.written(
        posts.join(lists.where("c > 1").drop("c"), "gram").select("gram", "class", "n", "place", "weight", "r"),
        "postings")
    lead = posts.where((F.col("class") != F.col("r.class")) & _passes(percent, "n", "place", "r.n", "r.place"))
    # of the leaders of its lists a class first meets the weightiest alone
    star = lead.groupBy("class").agg(F.max(F.struct("r.weight", "r.class")).alias("r"))
    star = frames.written(star.select(F.least("class", "r.class").alias("a"),
                                      F.greatest("class", "r.class").alias("b")).distinct(), "pairs")
    links = frames.written(_verified(star, sets, percent), "links")
    root = frames.components(links)
    placed = (posts.select("gram", "class", "n", "place").join(
        root.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("root", F.coalesce("root", "class")))
    placed = frames.written(placed, "placed")
    torn = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    left = placed.join(torn.select("gram"), "gram", "left_semi")
    right = left.select("gram", *[F.col(c).alias(c + "2") for c in ("class", "n", "place", "root")])
    rest = (left.join(right, "gram").where((F.col("class") < F.col("class2")) & (F.col("root") != F.col("root2"))
                                           & _passes(percent, "n", "place", "n2", "place2"))
            .select(F.col("class").alias("a"), F.col("class2").alias("b")).distinct()
            .join(star, ["a", "b"], "left_anti"))
    more = _verified(frames.written(rest, "pairs"), sets, percent)
    return members, frames.written(links.unionByName(more), "links")


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 5,
                     percent: int = 75) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (null without an id), class_id (null without words)."""
    members, links = link_classes(docs, doc_id, text, words_each, percent)
    root = frames.components(links)
    placed = members.join(root.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "class")))
    first = placed.where("root is not null and doc_id is not null").groupBy("root").agg(
        F.min("doc_id").alias("component_id"))
    first = frames.written(first, "first")  # read apart from `placed`, so that a large component's rows can be split
    return placed.join(first, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class")).alias("class_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 5,
                percent: int = 75) -> DataFrame:
    """The rows of `docs`, with its columns, without those linked to a document of a smaller id.

    Of rows that share the smallest id of their component all stay; so do rows without an id or words.
    """
    found = linked_documents(docs, doc_id, text, words_each, percent)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
