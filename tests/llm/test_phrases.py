import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.llm import phrases
from tidemark.llm.quotient import CountingFilter, Permutation, pack_ids, ranges, unpack_ids

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=10, longest=3, share=50, top=2000):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, longest + 1):
                for i in range(len(ws) - n + 1):
                    count[lang, tuple(ws[i:i + n])] += 1
    out = []
    some = {key: a for key, a in count.items() if a >= least and len(key[1]) > 1}
    for lang in total:
        mine = {p: a for (x, p), a in some.items() if x == lang}
        kept = []
        for p, a in mine.items():
            inside = [b for q, b in mine.items() if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, _, l, r = min((1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]],
                                  count[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -score)
                for k, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in rows_of(df))


def corpus(size, seed=4):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "e", "É", "f'", "New", "york", "日本", "x" * 40]
    rows = []
    for _ in range(size):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", "-"])
                       for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text.replace("c d", "New york city")))
    return rows + [("en", None), (None, ""), ("de", "one two"), ("en", "  .,; ")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit("7") for c in ("phrase", "rank", "batch", "word", "id", "x", "n", "doc_id", "tokens", "place")})


@pytest.mark.parametrize("sizes", [None, (200, 40, 60, 4)])
def test_against_plain_counting(spark, monkeypatch, sizes):
    if sizes:  # many batches, filters and two rounds of merging
        for name, value in zip(("TEXT", "ENTRIES", "SENT", "FAN"), sizes):
            monkeypatch.setattr(phrases, name, value)
    rows = corpus(150)
    assert got(phrases.collocations(frame(spark, rows))) == brute(rows)


def test_longer_phrases_other_bounds(spark):
    rows = corpus(60, 9) + [("en", "one two three four five six. " * 12)]
    assert got(phrases.collocations(frame(spark, rows), least=5, longest=5, share=80, top=7)) == brute(rows, 5, 5, 80, 7)


def test_ties_and_repeats(spark):
    rows = [("en", "b c. a b. c d! c d")] * 10 + [("fr", "b c")] * 9
    assert got(phrases.collocations(frame(spark, rows))) == brute(rows)
    assert got(phrases.collocations(frame(spark, rows), top=1)) == brute(rows, top=1)


def test_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [("en", None), (None, "one two three")])).count() == 0


def test_exact_where_products_pass_64_bits(spark):
    score = spark.sql("select (cast(9000000000000000 as decimal(19,0)) * cast(9000000000000000 as decimal(19,0)) * 1000000bd)"
                      " div (cast(9000000000000001 as decimal(19,0)) * cast(9000000000000000 as decimal(19,0))) as s").first()
    assert score["s"] == 1000000 * 9000000000000000 // 9000000000000001


@pytest.mark.parametrize("bits", [1, 2, 7, 33, 60, 63, 64, 65, 96, 127, 128])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    keys = [int.from_bytes(rng.bytes(16), "little") & ((1 << bits) - 1) for _ in range(400)]
    keys += keys[:100] * 3 + [0, (1 << bits) - 1] * 300
    high = np.array([k >> 64 for k in keys], np.uint64) if bits > 64 else None
    low = np.array([k & (2 ** 64 - 1) for k in keys], np.uint64)
    truth = collections.Counter(keys)
    whole = CountingFilter.of(bits, high, low)

    def content(f):
        h, l = f.keys()
        return {(int(h[i]) << 64 if h is not None else 0) | int(l[i]): int(f.counts[i]) for i in range(len(l))}

    assert content(CountingFilter.from_bytes(whole.to_bytes())) == truth
    half = [CountingFilter.of(bits, None if high is None else high[k::2], low[k::2]) for k in range(2)]
    edges = ranges(min(bits, 64), 5)
    merged = {}
    for part in range(5):
        same = [f for h in half for k, f in h.split(edges) if k == part]
        if same:
            merged |= content(CountingFilter.from_bytes(CountingFilter.merged(
                [CountingFilter.from_bytes(f.to_bytes()) for f in same]).to_bytes()))
    assert merged == truth
    assert whole.count_of(high, low).tolist() == [truth[k] for k in keys]
    back = Permutation(bits).inverse(*Permutation(bits).forward(high, low))
    assert (back[1] == low).all() and (high is None or (back[0] == high).all())


def test_packed_ids_come_back():
    rng = np.random.default_rng(0)
    for id_bits, n in ((1, 2), (20, 3), (21, 3), (22, 3), (32, 2), (32, 3), (32, 4), (25, 5)):
        ids = [rng.integers(0, 1 << id_bits, 50) for _ in range(n)]
        assert [x.tolist() for x in unpack_ids(*pack_ids(ids, id_bits), id_bits, n)] == [x.tolist() for x in ids]
