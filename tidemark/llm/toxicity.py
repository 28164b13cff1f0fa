"""Convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, in numpy.

A word's vector is two halves, each looked up by its own hash of the word, so a stranger that shares one slot of a
telling word shares half its vector at most. Filters over one, two and three neighbouring words are pooled by
their maximum over the whole text and a dense layer gives the logit. Training takes every labelled text whole,
encoded in 5 bytes a word. The texts are dealt by a hash of their ids into lanes of about `LANE_BYTES`; their number
grows with the corpus. In a round each lane takes its own steps from the same network, in a task of its own, and the
network moves by the mean of the lanes' changes: a vector by the lanes that changed it, all else by all lanes, by
their rows. Changes are added up as whole numbers, so their order doesn't matter. One lane needs one round. Few texts
are passed over more often, `STEPS` steps at least. The first vector component starts from the words' log-odds over
all texts of the fit. The logit is shifted so that scores follow the label shares among all training labels. Scoring
runs where the documents are. The driver holds the network and its changes, whose size is fixed.

Every fifth text of a lane is kept out of the fit. Thresholds by language are calibrated on all of these: the least
score at which precision there reaches `PRECISION`. They decide the extra column `flagged` alone; the score never
sees a language.

A null or empty text, or one without words, gets the score of a text of no words. Labels other than 0 and 1 and
labels of unknown documents are left out; of several labels of one id the largest counts. Rows that repeat are
scored each. Without labels of both kinds every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import frames, words as W

LANE_BYTES = 16 << 20  # of text a lane, on average
FIXED = 1 << 30  # changes of the network count in such parts
SLOTS = 1 << 18
HALF = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
STEPS = 150
BATCH = 64
PRECISION = 0.9
PAD = len(WIDTHS) - 1
PART = 1 << 17  # words scored at once
FIT_PART = 1 << 15  # words passed through the filters at once in the fit, one text at least


def slots(hashes: np.ndarray) -> np.ndarray:
    """(words, 2): the two slots of each word, from 1; slot 0 is the padding."""
    low = (hashes % W.U(SLOTS - 1)).astype(np.int32) + 1
    high = ((hashes >> W.U(32)) % W.U(SLOTS - 1)).astype(np.int32) + 1
    return np.stack([low, high], axis=1)


def packed(ids: np.ndarray) -> bytes:
    """Slots of words in 5 bytes each: two of 18 bits and padding."""
    both = ids[:, 0].astype("<u8") | (ids[:, 1].astype("<u8") << W.U(20))
    return both.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: np.ndarray) -> np.ndarray:
    both = np.zeros((len(blob) // 5, 8), np.uint8)
    both[:, :5] = blob.reshape(-1, 5)
    both = both.view("<u8").ravel()
    return np.stack([both & W.U((1 << 20) - 1), both >> W.U(20)], axis=1).astype(np.int32)


class Network:
    """Embedding halves `e` (2, SLOTS, HALF), filters `w[width]` (width * 2 * HALF, FILTERS), dense `v`, `c`."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = 2 * HALF
        self.e = (rng.standard_normal((2, SLOTS, HALF)) * 0.01).astype(np.float32)
        self.e[:, 0] = 0
        self.w = {k: (rng.standard_normal((k * d, FILTERS)) * 0.2).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            for o in range(k):  # filters start out listening to the telling component of both halves
                self.w[k][[o * d, o * d + HALF]] = np.abs(self.w[k][[o * d, o * d + HALF]]) + 0.3
        self.b = {k: np.full(FILTERS, -0.5, np.float32) for k in WIDTHS}
        self.v = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.c = np.float32(-1.0)

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max over each text of every filter; `ids` holds PAD padding rows before each text."""
        x = np.concatenate([self.e[0][ids[:, 0]], self.e[1][ids[:, 1]]], axis=1)
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for j, k in enumerate(WIDTHS):
            part = out[:, j * FILTERS:(j + 1) * FILTERS]
            part[:] = self.b[k]
            for o in range(k):
                part[:len(x) - o] += x[o:] @ self.w[k][o * 2 * HALF:(o + 1) * 2 * HALF]
        return np.maximum.reduceat(out, starts, axis=0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.v + self.c

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        padded, starts = pad(ids, counts)
        return self.logits(self.pooled(padded, starts))


def pad(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with PAD padding rows before each, and where each begins.

    A filter that starts at a text's last words reaches the padding before the next text, never its words.
    """
    starts = np.cumsum(counts + PAD) - (counts + PAD)
    out = np.zeros((len(ids) + PAD * len(counts), 2), np.int32)
    inner = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[np.repeat(starts, counts) + PAD + inner] = ids
    return out, starts


def _count_slots(seen: np.ndarray, text: np.ndarray, label: int) -> None:
    """Adds one text to `seen` (half, label, slot), the number of texts of each label that hold a slot."""
    ids = unpacked(text)
    for half in range(2):
        seen[half, label, np.unique(ids[:, half])] += 1


def started(seen: np.ndarray, rows: np.ndarray) -> Network:
    """A network whose first vector components are the log-odds of the slots; `rows` counts the texts of each label."""
    net = Network()
    for half in range(2):
        rate = (seen[half].astype(np.float32) + 0.5) / (rows[:, None] + 1)
        odds = np.log(rate[1] / rate[0]) * (seen[half].sum(0) >= 3)
        odds[0] = 0
        net.e[half, :, 0] = np.clip(odds, -3, 6) / 3
    return net


def epochs_for(rows: int) -> int:
    return max(EPOCHS, -(-STEPS // max(1, -(-rows // BATCH))))


def _won(net: Network, texts: list[np.ndarray]):
    """(pooled, slots and vectors of the words under each filter's maximum) of each text, some texts at a time.

    Slots and vectors: by width, (texts, filters, place in the filter); padding and places beyond the text are slot 0.
    """
    pooled = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32)
    slot = {k: np.zeros((len(texts), FILTERS, k, 2), np.int32) for k in WIDTHS}
    d = 2 * HALF
    size = np.cumsum([len(t) // 5 for t in texts])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + FIT_PART, side="right")))
        words = [unpacked(t) for t in texts[a:b]]
        counts = np.array([len(w) for w in words])
        ids, starts = pad(np.concatenate(words).reshape(-1, 2), counts)
        ends = np.append(starts[1:], len(ids))
        ids = np.concatenate([ids, np.zeros((PAD, 2), np.int32)])  # what the last filters reach
        x = np.concatenate([net.e[0][ids[:, 0]], net.e[1][ids[:, 1]]], axis=1)
        n = len(x) - PAD
        for j, k in enumerate(WIDTHS):
            out = np.tile(net.b[k], (n, 1))
            for o in range(k):
                out += x[o:o + n] @ net.w[k][o * d:(o + 1) * d]
            win = np.stack([s + out[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
            pooled[a:b, j * FILTERS:(j + 1) * FILTERS] = np.take_along_axis(out, win, axis=0)
            slot[k][a:b] = ids[win[:, :, None] + np.arange(k)]
        a = b
    return pooled, slot


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int | None = None, rate: float = 0.01,
        net: Network | None = None, seed: int = 11) -> Network:
    """Adam on the filters and the dense layer, plain steps on the vectors of the words that won a maximum.

    `texts` are packed slots. Memory goes with `FIT_PART` words or the longest text, not with the batch. `net` is
    trained further, in place; without one, a network starts from the log-odds in `texts`.
    """
    if net is None:
        seen = np.zeros((2, 2, SLOTS), np.int64)
        for text, label in zip(texts, y):
            _count_slots(seen, text, label)
        net = started(seen, np.bincount(y, minlength=2))
    if epochs is None:
        epochs = epochs_for(len(texts))
    rng = np.random.default_rng(seed)
    d = 2 * HALF
    state: dict = {}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            pooled, slots_won = _won(net, [texts[r] for r in rows])
            act = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(act @ net.v + net.c)))
            err = ((p - y[rows]) / len(rows)).astype(np.float32)
            grads = {"v": act.T @ err + 1e-4 * net.v, "c": err.sum()}
            back = np.outer(err, net.v) * (pooled > 0)
            steps: dict = {}
            for j, k in enumerate(WIDTHS):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                grads["b", k] = g.sum(0)
                gw = np.zeros_like(net.w[k])
                moves = []
                for o in range(k):
                    slot = slots_won[k][:, :, o]  # texts, filters, half
                    got = np.concatenate([net.e[0][slot[..., 0]], net.e[1][slot[..., 1]]], axis=2)
                    gw[o * d:(o + 1) * d] = np.einsum("tf,tfd->df", g, got)
                    moves.append((slot, g[:, :, None] * net.w[k][o * d:(o + 1) * d].T[None]))
                steps[k] = moves
                grads["w", k] = gw + 1e-4 * net.w[k]
            for slot, gx in (m for k in WIDTHS for m in steps[k]):
                for half in range(2):
                    s = slot[..., half].ravel()
                    np.add.at(net.e[half], s[s > 0], -rate * 20 *
                              gx[:, :, half * HALF:(half + 1) * HALF].reshape(-1, HALF)[s > 0])
            step += 1
            for name, g in grads.items():
                m, s = state.get(name, (0, 0))
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                state[name] = (m, s)
                change = (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8))
                if name in ("v", "c"):
                    setattr(net, name, (getattr(net, name) - change).astype(np.float32))
                else:
                    getattr(net, name[0])[name[1]] -= change.astype(np.float32)
    return net


def encoded(column) -> tuple[np.ndarray, np.ndarray]:
    h, counts = W.words(column, W.letter_words())
    return slots(h), counts


def _encode(known: frames.Bitmap):
    """The packed words of the rows whose hash `h` may be in `known`."""
    def run(batches: Iterator[pa.RecordBatch]):
        some = (batch.filter(pa.array(known.has(batch.column("h").to_numpy().view(np.uint64)))) for batch in batches)
        for batch in W.text_batches(some, "text", 4 << 20):
            ids, counts = encoded(batch.column("text"))
            ends = np.cumsum(counts)
            blobs = [packed(ids[e - c:e]) for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays([*W.kept_columns(batch, "id", "lang"), pa.array(blobs, pa.binary())],
                                             names=["id", "lang", "ids"])
    return run


def _views(chunk: pa.BinaryArray) -> list[np.ndarray]:
    """The packed slots of each text of a chunk, laid over the chunk's own memory."""
    _, offsets, data = chunk.buffers()
    wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
    off = np.frombuffer(offsets, wide)[chunk.offset:chunk.offset + len(chunk) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[a:b] for a, b in zip(off[:-1], off[1:])]


def _within(sizes: pa.Table, most: int) -> pa.Table:
    """The ids whose texts, in the order of a hash, hold `most` words of their label together, one at least.

    For a bounded sample; `train` takes all texts.
    """
    sizes = sizes.sort_by([("y", "ascending"), ("h", "ascending"), ("id", "ascending")])
    y, n = sizes.column("y").to_numpy(), sizes.column("n").to_numpy()
    total = np.cumsum(n)
    before = total - n
    first = np.searchsorted(y, y)
    return sizes.filter(pa.array((total - before[first] <= most) | (np.arange(len(y)) == first))).select(["id", "y"])


class Model:
    """A network, the shift of its logits to the label shares, and a threshold for each language seen."""

    def __init__(self, net: Network | None, shift: float, thresholds: dict[str, float], share: float):
        self.net, self.shift, self.thresholds, self.share = net, shift, thresholds, share

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.net is None or not len(counts):
            return np.full(len(counts), self.share)
        ends = np.cumsum(counts)
        logits, a = [], 0
        while a < len(counts):  # a part of the texts at a time: the filters' outputs are large
            begin = ends[a] - counts[a]
            b = max(a + 1, int(np.searchsorted(ends, begin + PART, side="right")))
            logits.append(self.net.score(ids[begin:ends[b - 1]], counts[a:b]))
            a = b
        logit = np.concatenate(logits).astype(float) + self.shift
        return np.round(1 / (1 + np.exp(-logit)), 6)  # the last digits of 32-bit sums depend on the batch


def lanes_of(docs: DataFrame, known: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(lane, id, y, lang, ids, aside) of every row of `docs` with a label, written lane by lane in the order of ids.

    Only the packed words of texts that may have a label are shuffled, once, with the labels among them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    known = known.select(F.col("id").cast(kind).alias("id"), "y")
    bitmap = frames.Bitmap.of(known.select(F.xxhash64("id").alias("h")), "h")
    texts = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = (texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
             .join(known, "id", "left_semi").agg(F.sum("n")).first()[0])
    lanes = 1 + int(sizes or 0) // LANE_BYTES
    found = texts.withColumn("h", F.xxhash64("id")).mapInArrow(_encode(bitmap), f"id {kind}, lang string, ids binary")
    rows = found.withColumn("y", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True)
    one = Window.partitionBy("lane", "id")
    order = Window.partitionBy("lane").orderBy("id", "lang", "ids")
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes))).repartition(2 * lanes, "lane")
    labelled = dealt.withColumn("y", F.max("y").over(one)).where("y is not null and ids is not null")
    return frames.written(labelled.select("lane", "id", "y", "lang", "ids",
                                          (F.row_number().over(order) % 5 == 0).alias("aside")), "lanes")


def _by_lane(batches: Iterator[pa.RecordBatch]):
    """(texts, labels) of each lane; a lane's rows follow one another."""
    now, texts, y = None, [], []
    for batch in batches:
        lane = batch.column("lane").to_numpy()
        label = batch.column("y").to_numpy()
        views = _views(batch.column("ids"))
        for k in range(len(lane)):
            if lane[k] != now and texts:
                yield texts, np.array(y, np.int64)
                texts, y = [], []
            now = lane[k]
            texts.append(views[k])
            y.append(label[k])
    if texts:
        yield texts, np.array(y, np.int64)


def _flat(net: Network) -> np.ndarray:
    """All numbers but the vectors, in rows of HALF."""
    every = np.concatenate([*[net.w[k].ravel() for k in WIDTHS], *[net.b[k] for k in WIDTHS], net.v, [net.c]])
    return np.append(every, np.zeros(-len(every) % HALF)).reshape(-1, HALF).astype(float)


def _put(net: Network, flat: np.ndarray) -> None:
    flat, at = flat.ravel().astype(np.float32), 0
    for part in (*[net.w[k] for k in WIDTHS], *[net.b[k] for k in WIDTHS], net.v):
        part[...] = flat[at:at + part.size].reshape(part.shape)
        at += part.size
    net.c = np.float32(flat[at])


def _seen(lanes: DataFrame) -> np.ndarray:
    """(half, label, slot): how many texts of the fit hold a slot."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen = np.zeros((2, 2, SLOTS), np.int64)
        for batch in batches:
            for text, label in zip(_views(batch.column("ids")), batch.column("y").to_numpy()):
                _count_slots(seen, text, label)
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["k", "n"])

    rows = lanes.select("ids", "y").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(4 * SLOTS, np.int64)
    seen[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return seen.reshape(2, 2, SLOTS)


def _moved(lanes: DataFrame, net: Network, epochs: int, seed: int) -> Network:
    """The network after one round: every lane trains from `net`, and the mean of the changes is applied."""
    context = lanes.sparkSession.sparkContext
    shared = context.broadcast(net)
    cols = [f"d{i}" for i in range(HALF)]

    def run(batches: Iterator[pa.RecordBatch]):
        total = weight = None
        for texts, y in _by_lane(batches):
            old = shared.value
            new = Network.__new__(Network)
            new.e, new.v, new.c = old.e.copy(), old.v.copy(), old.c
            new.w, new.b = ({k: x.copy() for k, x in part.items()} for part in (old.w, old.b))
            fit(texts, y, epochs, net=new, seed=seed)
            change = np.concatenate([(new.e.astype(float) - old.e).reshape(-1, HALF), _flat(new) - _flat(old)])
            if total is None:
                total, weight = np.zeros(change.shape, np.int64), np.zeros(len(change), np.int64)
            at = np.flatnonzero(change.any(axis=1) | (np.arange(len(change)) >= 2 * SLOTS))
            total[at] += np.rint(change[at] * (FIXED * len(texts))).astype(np.int64)
            weight[at] += len(texts)
        if total is not None:
            at = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at]), *[pa.array(total[at, i])
                                              for i in range(HALF)]], names=["k", "n", *cols])

    rows = (lanes.select("lane", "ids", "y").mapInArrow(run, ", ".join(f"{c} long" for c in ["k", "n", *cols]))
            .groupBy("k").agg(*[F.sum(c).alias(c) for c in ["n", *cols]]).toArrow())
    change = np.zeros((2 * SLOTS + len(_flat(net)), HALF))
    at = rows.column("k").to_numpy()
    change[at] = np.stack([rows.column(c).to_numpy() for c in cols], axis=1) / (
        FIXED * rows.column("n").to_numpy().astype(float)[:, None])
    net.e = (net.e + change[:2 * SLOTS].reshape(net.e.shape)).astype(np.float32)
    _put(net, _flat(net) + change[2 * SLOTS:])
    shared.destroy()
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", label: str = "toxic") -> Model:
    """Fit on all texts with a label among those of `labels` where `learn` holds."""
    known = (labels.where(learn & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    base = share.get(1, 0) / total if total else 0.0
    if not total:
        return Model(None, 0.0, {}, base)
    lanes = lanes_of(docs, known, doc_id, text, lang)
    fitting = lanes.where("not aside")
    counts = fitting.groupBy("y").agg(F.count("*").alias("n"), F.max("lane").alias("lane")).collect()
    rows = np.array([sum(r["n"] for r in counts if r["y"] == y) for y in (0, 1)])
    if not rows.all():
        return Model(None, 0.0, {}, base)
    net = started(_seen(fitting), rows)
    dealt = 1 + max(r["lane"] for r in counts)
    epochs, rounds = epochs_for(int(rows.sum()) // dealt), 1 if dealt == 1 else EPOCHS
    for k in range(rounds):
        net = _moved(fitting, net, -(-epochs // rounds), 11 + k)
    odds = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / np.clip(1 - q, 1e-6, 1))
    model = Model(net, float(odds(base) - odds(rows[1] / rows.sum())), {}, base)
    model.thresholds = calibrated(_judged(lanes.where("aside"), model))
    W.release()
    return model


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    """(y, lang, score) of texts kept out of the fit."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = [shared.value.scores(ids := unpacked(text), np.array([len(ids)]))[0]
                      for text in _views(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("lang"), pa.array(scores, pa.float64())],
                                             names=["y", "lang", "score"])

    return rows.select("y", "lang", "ids").mapInArrow(run, "y int, lang string, score double")


def calibrated(rows: DataFrame) -> dict:
    """Per language the least score from which on the precision reaches PRECISION; "" holds for all others.

    Rows of one score count together. Scores have six digits: a running total reads at most a thousand rows of a
    thousandth, and the thousandths.
    """
    names = F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))
    scores = (rows.select(F.explode(names).alias("name"), "score", "y").groupBy("name", "score")
              .agg(F.sum("y").alias("t"), F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") * 1000)))
    above = Window.partitionBy("name").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("name", "bin").orderBy(F.desc("score"))
    bins = scores.groupBy("name", "bin").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).select(
        "name", "bin", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "tn"])
    good = (F.sum("t").over(inside) + F.col("t_above")) >= PRECISION * (F.sum("n").over(inside) + F.col("n_above"))
    least = (scores.join(bins, ["name", "bin"]).withColumn("good", good).groupBy("name")
             .agg(F.min(F.when(F.col("good"), F.col("score"))).alias("least")).collect())
    out = {r["name"]: 1.0 if r["least"] is None else r["least"] for r in least}
    return dict(sorted((k, v) for k, v in out.items() if k)) | ({"": out[""]} if out else {})


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
           lang: str = "lang") -> DataFrame:
    """doc_id, score, language threshold and whether the score reaches it, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 2 << 20):
            scores = shared.value.scores(*encoded(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores)],
                                             names=["doc_id", "lang", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    out = rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang string, score double")
    limit = F.lit(float(model.thresholds.get("", 1.0)))
    for name, value in model.thresholds.items():
        limit = F.when(F.col("lang") == name, value).otherwise(limit) if name else limit
    return out.select("doc_id", "score", limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores under `threshold`, with the columns of `docs`; decided by the text alone.

    Rows are judged in place: the text goes through the classifier beside all other columns, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, text, 2 << 20):
            scores = shared.value.scores(*encoded(batch.column(text)))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, schema)
