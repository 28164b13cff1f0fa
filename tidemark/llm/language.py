"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its words, runs of ASCII letters and of other scripts; each character of a word, and the word's end, is
predicted from up to `ORDER` - 1 characters before it in the word. Models are counted by Spark over a sample of
about `ROWS_A_LANGUAGE` rows of each language (chosen by a hash of the id; whole texts) and kept as sorted hash
arrays: the n-grams that any language has, with each language's log probability, and the contexts, with each
language's weight of the shorter model. A text's language is that of the lowest cross-entropy per character.

The score is the language's share of exp(-sharpness * cross-entropy), the sharpness fitted on a fifth of the sample
that no model was counted on; so is, for each language, the cross-entropy that 99.5 % of its own texts stay under.
A text above it, or of no known language, is `rejected`, an extra column beside the prediction. A language of fewer
than `ROWS_TO_SPARE` learnable rows is counted on all of them and rejects none.

A null text or one without a letter is `und`, with score 0, rejected; so are all when nothing can be learned. Rows
that repeat are predicted each; ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words as W

ORDER = 4
ROWS_A_LANGUAGE = 3000
ASIDE = 5  # every fifth row of the sample calibrates
ROWS_TO_SPARE = 100  # languages of fewer rows give none of them to calibration
KEEP = 0.995
EDGE = 32  # before a word and after it


def _alphabet() -> W.Alphabet:
    sep = np.ones(256, bool)
    sep[128:] = False
    for a, b in ("az", "AZ"):
        sep[ord(a):ord(b) + 1] = False
    return W.Alphabet(sep, W._lower())


def distinct_words(column):
    """(words as one string between blanks, which distinct word each word is, words per text, characters per word)."""
    raw, offsets = W.utf8(column)
    alphabet = _alphabet()
    starts, ends, counts = W.word_spans(raw, offsets, alphabet)
    h = W.hash_spans(raw, starts, ends, alphabet)
    order = np.argsort(h)
    begin = W.run_starts(h[order])
    example = order[begin]
    which = np.empty(len(h), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    a, n = starts[example], (ends - starts)[example]
    out = np.full(int(n.sum()) + len(n) + 1, EDGE, np.uint8)
    inner = np.arange(int(n.sum()))
    word = np.repeat(np.arange(len(n)), n)
    out[inner + word + 1] = raw[inner - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
    return out.tobytes().decode("utf-8", "replace").lower(), which, counts


def letters(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(for each character to predict, the ORDER - 1 before it and itself; the word it belongs to)."""
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = cp == EDGE
    word = np.cumsum(edge) - 1
    last = np.maximum.accumulate(np.where(edge, np.arange(len(cp)), 0))  # the blank at or before each place
    to = np.arange(1, len(cp))
    rows = np.full((len(to), ORDER), EDGE, np.uint64)
    rows[:, -1] = cp[to]
    for k in range(1, ORDER):  # places before the word's own blank stay blanks
        at = to - k
        ok = at > last[to - 1]
        rows[ok, ORDER - 1 - k] = cp[at[ok]]
    return rows, word[to - 1]


def key(rows: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of the last n columns."""
    out = np.full(len(rows), (n * 2 + salt) * 0x9E3779B97F4A7C15 % (1 << 64), W.U)
    factor = 1
    for k in range(n):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        out += (rows[:, rows.shape[1] - 1 - k] + W.U(1)) * W.U(factor)
    return W.mix(out)


class Models:
    """For each n-gram length: sorted hashes, log probabilities per language; and the same of contexts."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang: np.ndarray, count: np.ndarray):
        """`grams`: rows of ORDER characters, `lang` their language's number, `count` how often it has them."""
        self.langs, size = langs, len(langs)
        self.grams, self.contexts = {}, {}
        floor = np.full(size, -np.log(len(np.unique(grams[:, -1])) + 1.0))
        self.floor = floor
        levels = {ORDER: (grams, lang, count)}
        for n in range(ORDER - 1, 0, -1):  # lower models count the distinct characters before, save at a word's begin
            above, al, ac = levels[n + 1]
            order = np.lexsort((*above[:, ORDER - n:].T, al))
            g, gl, gc = above[order], al[order], ac[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:, ORDER - n:] != g[:-1, ORDER - n:]).any(axis=1) | (gl[1:] != gl[:-1])
            at = np.flatnonzero(new)
            starts_word = (g[:, ORDER - n] == EDGE) & (n > 1)
            part = np.where(starts_word, gc, 1)
            levels[n] = (g[at], gl[at], np.add.reduceat(part, at))
        known, lower = None, None
        for n in range(1, ORDER + 1):
            g, gl, gc = levels[n]
            names = key(g, n, 0)
            order = np.argsort(names)
            distinct = names[order][W.run_starts(names[order])]
            first = order[W.run_starts(names[order])]
            table = np.zeros((len(distinct), size))
            table[np.searchsorted(distinct, names), gl] = gc
            once, twice = ((gc == c) for c in (1, 2))
            d = np.array([(x := (once & (gl == k)).sum()) / max(1, x + 2 * (twice & (gl == k)).sum())
                          for k in range(size)])
            d = np.clip(d, 0.1, 0.95)
            context = key(g[:, :-1], n - 1, 1)
            where = np.unique(context)
            total, kinds = np.zeros((len(where), size)), np.zeros((len(where), size))
            at = np.searchsorted(where, context)
            np.add.at(total, (at, gl), gc)
            np.add.at(kinds, (at, gl), 1)
            rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)  # weight of the shorter model
            own = np.searchsorted(where, key(g[first][:, :-1], n - 1, 1))
            base = np.exp(floor)[None] if n == 1 else lower[np.searchsorted(known, key(g[first], n - 1, 0))]
            p = np.maximum(table - d, 0) / np.maximum(total[own], 1) + rest[own] * base
            self.grams[n] = (distinct, np.log(p).astype(np.float32))
            self.contexts[n] = (where, np.log(rest).astype(np.float32))
            known, lower = distinct, p

    def log_probability(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.langs)), np.float32)
        open_rows = np.arange(len(rows))
        for n in range(ORDER, 0, -1):
            table, value = self.grams[n]
            h = key(rows[open_rows], n, 0)
            at = np.searchsorted(table, h)
            at[at == len(table)] = 0
            hit = table[at] == h
            out[open_rows[hit]] += value[at[hit]]
            open_rows = open_rows[~hit]
            where, rest = self.contexts[n]
            h = key(rows[open_rows][:, :-1], n - 1, 1)
            at = np.searchsorted(where, h)
            at[at == len(where)] = 0
            seen = where[at] == h
            out[open_rows[seen]] += rest[at[seen]]
        out[open_rows] += self.floor
        return out

    def cross_entropy(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, characters predicted per text); texts without words have no characters."""
        joined, which, counts = distinct_words(column)
        texts = len(counts)
        if not len(which):
            return np.zeros((texts, len(self.langs))), np.zeros(texts, np.int64)
        total = np.zeros((int(which.max()) + 1, len(self.langs)))
        size = np.zeros(len(total), np.int64)
        # by parts, so that the tables of characters stay small
        for begin in range(0, len(joined) - 1, 1 << 19):
            a = joined.find(" ", max(0, begin - 1)) if begin else 0
            b = joined.find(" ", min(len(joined) - 1, begin + (1 << 19) - 1))
            if a < 0 or a >= b:
                continue
            rows, word = letters(joined[a:b + 1])
            word += joined.count(" ", 0, a)
            p = self.log_probability(rows)
            at = W.run_starts(word)
            total[word[at]] += np.add.reduceat(p, at, axis=0)
            size[word[at]] += np.diff(np.append(at, len(word)))
        text = np.repeat(np.arange(texts), counts)
        n = np.bincount(text, weights=size[which], minlength=texts).astype(np.int64)
        out = np.stack([np.bincount(text, weights=total[which, k], minlength=texts)
                        for k in range(len(self.langs))], axis=1)
        return -out / np.maximum(n, 1)[:, None], n


class Classifier:
    def __init__(self, models: Models | None, sharpness: float = 1.0, limits: np.ndarray | None = None):
        self.models, self.sharpness, self.limits = models, sharpness, limits

    def predict(self, column) -> tuple[list, np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        texts = len(column)
        if self.models is None:
            return ["und"] * texts, np.zeros(texts), np.ones(texts, bool)
        entropy, n = self.models.cross_entropy(column)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(texts), best]
        share = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        rejected = (low > self.limits[best]) if self.limits is not None else np.zeros(texts, bool)
        names = np.array(self.models.langs, object)[best]
        none = n == 0
        raw, offsets = W.utf8(column)
        plain = np.concatenate([[0], np.cumsum(~_alphabet().separator[raw] & (raw < 128))])
        for k in np.flatnonzero(~none & (plain[offsets[1:]] == plain[offsets[:-1]])):  # other scripts, or signs alone
            none[k] = not any(c.isalpha() for c in column[k].as_py())
        names[none] = "und"
        return names.tolist(), np.where(none, 0.0, share), rejected | none


def _count(batches: Iterator[pa.RecordBatch]):
    for batch in W.text_batches(batches, "text", 4 << 20):
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            part = batch.filter(pa.compute.equal(langs, lang))
            joined, which, _ = distinct_words(part.column("text"))
            if not len(which):
                continue
            rows, word = letters(joined)
            times = np.bincount(which)[word]
            order = np.lexsort(rows.T)
            rows, times = rows[order], times[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), *[pa.array(rows[at, k].astype(np.int32)) for k in range(ORDER)],
                 pa.array(np.add.reduceat(times, at))],
                names=["lang", *[f"c{k}" for k in range(ORDER)], "n"])


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows_a_language: int = ROWS_A_LANGUAGE) -> Classifier:
    """Models of the languages of the rows where `learn` holds; lang and id choose and name the sample alone."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.lit(3), F.col(doc_id)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier(None)
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, int((1 << 20) * min(1.0, rows_a_language / n))).otherwise(share)
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < share)
    spare = [name for name, n in sizes.items() if n >= ROWS_TO_SPARE]
    aside = (F.pmod(F.shiftright("h", 24), F.lit(ASIDE)) == 0) & F.col("lang").isin(spare) if spare else F.lit(False)
    columns = [f"c{k}" for k in range(ORDER)]
    counted = (some.where(~aside).select("lang", "text")
               .mapInArrow(_count, "lang string, " + ", ".join(f"{c} int" for c in columns) + ", n long")
               .groupBy("lang", *columns).agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counted.column("lang").to_pylist()))
    if not langs:
        return Classifier(None)
    number = {x: k for k, x in enumerate(langs)}
    grams = np.stack([counted.column(c).to_numpy() for c in columns], axis=1).astype(np.uint64)
    models = Models(langs, grams, np.array([number[x] for x in counted.column("lang").to_pylist()]),
                    counted.column("n").to_numpy())
    shared = spark.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            entropy, n = shared.value.cross_entropy(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(list(entropy), pa.list_(
                pa.float64()))], names=["lang", "n", "entropy"])

    held = some.where(aside).select("lang", "text").mapInArrow(
        measure, "lang string, n long, entropy array<double>").where("n > 0").toArrow()
    true = np.array([number.get(x, -1) for x in held.column("lang").to_pylist()], np.int64)
    entropy = np.array(held.column("entropy").to_pylist(), float).reshape(-1, len(langs))[true >= 0]
    true = true[true >= 0]
    if not len(true):
        return Classifier(models, 5.0)
    own = entropy[np.arange(len(true)), true]

    def loss(s):
        shifted = -s * (entropy - own[:, None])
        top = shifted.max(axis=1)
        return float((np.log(np.exp(shifted - top[:, None]).sum(axis=1)) + top).mean())

    sharpness = min((0.5 * 2 ** k for k in range(9)), key=loss)
    limits = np.array([np.quantile(own[true == k], KEEP) if (true == k).any() else np.inf
                       for k in range(len(langs))])
    return Classifier(models, sharpness, limits)


def identified(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in W.text_batches(batches, "text", 4 << 20):
            names, scores, rejected = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()),
                                              pa.array(scores), pa.array(rejected)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
