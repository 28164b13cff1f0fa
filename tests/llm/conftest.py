import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, class string, n int, row int, "
          "batch string, size double, _row int, _gone int")
WORDS = ("the of river stone and light in over green to by was hill that cloud near from wide old moss "
         "quiet road birch lake under").split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tidemark.llm import frames

    return frames.ship(spark)


def sentence(rng, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "ed", "a", "o"]) for _ in range(n))


def odd_texts(rng) -> list:
    """Nulls, empties, blanks, one word, few words, a very long word, repeats, a very long text."""
    long = sentence(rng, 6000)
    base = sentence(rng, 60)
    return [None, "", " \n\t ", "one", "One two THREE", "one two three", "x" * 30000, "ab " * 500, "é" * 200,
            "\x01 a \x01b \x00", "日本語 テキスト", "12 34 ... !!", base, base, base + " tail", long, long[:-400],
            "a　b don't 'sure <|endoftext|> it's 99's", "İstanbul Straße ÉTÉ"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with each column null somewhere, repeated rows and ids, and columns whose names clash with ours."""
    import random

    rng = random.Random(5)
    rows = []
    for k, text in enumerate(odd_texts(rng)):
        rows.append((k * 3 - 4, text, ["en", None, "fr"][k % 3], [None, "s1", "s2", "é"][k % 4], k, "c", k, k, "b",
                     0.5, k, k))
    rows.append((None, rows[12][1], "en", "s1", 1, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    rows += [rows[12], rows[12], (rows[0][0], sentence(rng, 40), "en", "s1", 3, "c", 1, 1, "b", 0.1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
