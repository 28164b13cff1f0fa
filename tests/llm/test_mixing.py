import random
from collections import defaultdict

from conftest import rows_of, sentence
from test_words import plain_words
from tidemark.llm import mixing


def level_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Share by weight, fix what is above its limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = percent * sum(sizes.values()) / 100, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        source = rng.choice(["big"] * 6 + ["é", "a", "b", "tiny"][k % 4:k % 4 + 1] + [None])
        rows.append((k, sentence(rng, rng.randrange(60)), source))
    return spark.createDataFrame(rows + [(900, None, "only null"), (901, "", "only null")],
                                 "doc_id long, text string, source string").repartition(3)


def test_targets_and_taken(spark):
    docs = corpus(spark)
    rows = rows_of(mixing.taken(docs))
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes, took = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(plain_words(text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        took[source[r["doc_id"]]] += r["taken"]
    want = level_targets(dict(sizes))
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    for s, n in took.items():
        assert abs(n - want[s]) <= 0.5
    again = rows_of(mixing.taken(docs.repartition(7)))
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_slots_alternate(spark):
    goals = mixing.targets(spark.createDataFrame([("a", 1000), ("b", 900), ("c", 800)], "source string, source_size long"))
    plan = sorted((r["slot"], r["number"], r["rank"]) for r in rows_of(mixing.schedule(goals, 2000)))
    share = {r["number"]: r["high"] - r["low"] for r in rows_of(goals)}
    assert [p[0] for p in plan] == list(range(2000))
    seen = defaultdict(int)
    for slot, number, rank in plan:
        assert rank == seen[number]
        seen[number] += 1
        assert all(abs(seen[n] - share[n] * (slot + 1)) < 6 for n in share)


def test_mixed_documents_hold_the_taken_words(spark):
    docs = corpus(spark, 2)
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mixing.taken(docs))}
    got, text = defaultdict(list), {r.doc_id: r.text for r in docs.collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in rows_of(mixed):
        got[r["doc_id"]].append(r["text"])
    for i, n in taken.items():
        assert sum(len(plain_words(t)) for t in got[i]) == n
        for t in got[i]:
            assert t == text[i] or " ".join(plain_words(t)) in " ".join(plain_words(text[i]))


def test_sources_far_below_a_block(spark):
    """A block of the large sources is over 60 words here: sources of 3 to 700 words still meet their targets."""
    rng = random.Random(9)
    text = "w " * 20_000
    rows = [(k, text, f"big{k % 20:02}") for k in range(200)]
    rows += [(1000 + 10 * s + j, sentence(rng, n), f"small{s:02}") for s, n in enumerate([1, 3, 7, 20, 70] * 8)
             for j in range(3 + 7 * (s % 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    source = {r[0]: r[2] for r in rows}
    took, target = defaultdict(int), {}
    for r in rows_of(mixing.taken(docs)):
        took[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert sum(target.values()) > 65536 * 60
    for s, n in target.items():
        assert abs(took[s] - n) <= 0.5, s
    placed, parts = mixing.mix(docs)
    spread = defaultdict(set)
    number = {r["doc_id"]: r["number"] for r in rows_of(placed)}
    every = parts.agg({"slot": "max"}).first()[0] + 1
    for r in rows_of(parts.where("doc_id >= 1000")):
        spread[r["number"]].add(r["rank"]), spread[-r["number"]].add(r["slot"])
    for i in (1000 + 10 * s for s in range(40)):
        ranks, slots = spread[number[i]], sorted(spread[-number[i]])
        assert ranks == set(range(len(ranks))) and len(slots) == len(ranks) >= min(128, target[source[i]])
        # golden-ratio points in a piece have three distances, the longest under 3 times the mean
        assert all(b - a <= 3 * every / len(slots) + 2 for a, b in zip(slots, slots[1:]))
    got = defaultdict(int)
    for r in rows_of(mixing.mixed_documents(docs).where("doc_id >= 1000")):
        got[r["source"]] += len(plain_words(r["text"]))
    assert all(got[s] == took[s] for s in got) and len(got) == 40


def test_odd_rows_and_none(odd, none):
    rows = rows_of(mixing.taken(odd))
    assert len(rows) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) < 0.01 * total
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    assert sum(len(plain_words(r["text"])) for r in rows_of(mixed)) == sum(r["taken"] for r in rows)
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_main_path_has_no_python(odd):
    for df in (mixing.taken(odd), mixing.mixed_documents(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString() if hasattr(df, "_jdf") else ""
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
