import html as html_module
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows_of, sentence
from tidemark.llm import boost, dom, main_text
from tidemark.llm import queries

A = "The river rose overnight, and by the morning the lower road was under water for most of its length."
B = "People who live near the old mill carried what they could up the hill; the school stayed open as a shelter."
C = "Water levels are expected to fall by the end of the week, the council said, if there is no more rain."
D = "Short one."
PROSE = [A, B, C, "Nobody was hurt, and the trains ran again after two hours of careful checks along the line."]

#: (page, main text) in several kinds of markup, none of them from the training pages
PAGES = [
    (f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><!-- x --><div class='ad'>Buy "
     f"new boots today, they are cheap.</div><article><h1>Flood</h1><p><b>{D}<br><p>{A}</p><p>{B}</p></article><footer>&copy; "
     f"site.example &middot; All rights reserved here.</footer></body></html>", ["Flood", D, A, B]),
    (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><div id='header'><h2>The Daily Paper</h2>"
     f"<ul class='main-menu'><li><a href=/a>Sport</a><li><a href=/b>Weather</a></ul></div><div class='container'><div "
     f"class='post-content'><h1>Flood &amp; mud</h1><p>{A}</p><div class='share-buttons'><a href=x>Tweet</a> <a href=y>Like</a>"
     f"</div><p>{B}</p><p>{C}</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href=1>Ten ways to dry a carpet</a></li>"
     f"<li><a href=2>Mud season is here</a></li></ul></div></div><div id='comments'><h3>2 comments</h3><div class='comment'><p>"
     f"I saw it from my window and it was a frightening sight, really.</p></div><div class='comment'><p>{C} Stay safe.</p>"
     f"</div></div><div id='footer'><p>© 2024 The Daily Paper</p></div></body></html>", ["Flood & mud", A, B, C]),
    (f"<body><header><h1>Site name</h1><form action=/s><label>Search the site</label><input name=q><button>Go</button></form>"
     f"</header><div class='cookie-notice'><p>We use cookies to make this site work. By going on you agree to it.</p><button>OK"
     f"</button></div><main><section><h2>Flood</h2><p>{A} <em>{D}</em></p><ul><li>{D}</li><li>{B}</li></ul><blockquote><p>{C}"
     f"</p></blockquote></section><aside class='related'><h4>Related</h4><p><a href=q>Another story about rain</a></p></aside>"
     f"</main><form class='newsletter'><p>Get our stories by mail each week, free of charge.</p><input type=email></form>"
     f"<footer><p>Imprint</p></footer>", ["Flood", f"{A} {D}", D, B, C]),
    (f"<table><tr><td class='nav'><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td class='content'><h1>"
     f"Flood</h1><p>{A}<p>{B}<p>{C}</td></tr><tr><td class='copyright'>Copyright 2024 some site</td></tr></table>",
     ["Flood", A, B, C]),
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return main_text.fit(PROSE * 5, [sentence(rng, 2) for _ in range(60)])


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("text", "n_chars", "k0", "k1", "block")})


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_of_other_kinds(model, k):
    assert model.texts([PAGES[k][0]]) == ["\n\n".join(PAGES[k][1])]


def test_rebuilt_pages_kept_out_of_the_fit(model):
    rng = random.Random(77)
    pages = [main_text.rebuilt_page(rng, PROSE, ["one", "two words", "three more words"]) for _ in range(150)]
    trees = [dom.parse(p) for p in pages]
    label, d = main_text._labels(trees), main_text._pages(trees)
    x = main_text.features(d, [a for t in trees for a in t.attributes], model.weights)
    choice = main_text.decoded(d, model.trees.scores(x))
    main, kept = label[d["run_node"]] == main_text.MAIN, choice[d["run_node"]] == main_text.MAIN
    assert kept[main].mean() > 0.97 and kept[~main].mean() < 0.02
    below = choice[np.maximum(d["parent"], 0)]
    inner = d["parent"] >= 0
    assert not ((below == main_text.OTHER) & (choice != main_text.OTHER) & inner).any()
    assert not ((below == main_text.MAIN) & (choice == main_text.OPEN) & inner).any()


def test_decoding_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(30):
        parent = np.array([-1, *[rng.integers(0, k) for k in range(1, 6)]])
        depth = np.zeros(6, int)
        for k in range(1, 6):
            depth[k] = depth[parent[k]] + 1
        d = {"parent": parent, "levels": [np.flatnonzero(depth == k) for k in range(depth.max() + 1)]}
        evidence = rng.normal(size=(6, 3)) * 3

        def value(choice):
            total = 0.0
            for k, c in enumerate(choice):
                up = main_text.OPEN if k == 0 else choice[parent[k]]
                if up == main_text.OTHER and c != up or up == main_text.MAIN and c == main_text.OPEN:
                    return -1e9
                total += evidence[k, c] - (1.5 if up == main_text.MAIN and c == main_text.OTHER else 0)
            return total

        best = max(value(c) for c in np.ndindex(*[3] * 6))
        assert value(main_text.decoded(d, evidence, 1.5)) == pytest.approx(best)


def test_trees_learn_what_columns_tell():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 3000)).astype(np.float32)
    y = np.where(x[0] * x[1] > 0, 0, np.where(x[2] > 0.3, 1, 2))
    model = boost.fit(x[:, :2000], y[:2000], 3)
    scores = model.scores(x[:, 2000:])
    assert (scores.argmax(1) == y[2000:]).mean() > 0.9
    assert np.allclose(np.exp(scores).sum(1), 1, atol=1e-4)
    assert boost.fit(np.zeros((2, 5)), np.array([0, 0, 1, 1, 1]), 2).scores(np.zeros((2, 3))).shape == (3, 2)


def test_markup_is_read_as_browsers_do():
    def runs(page):
        t = dom.parse(page)
        return [(t.tag[n], dom.squeezed(r)) for n, r in zip(t.run_node, t.runs)]

    assert runs("<p>a<p>b<div>c</p>d</div>e") == [("p", "a"), ("p", "b"), ("div", "c"), ("div", "d"), ("body", "e")]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("body", "x")]
    assert runs("a < b <b>c</b>d &amp &lt;&am e<!-- f > -->g<a href='x") == [("body", "a < b cd & <&am eg")]
    assert runs("<script>a<b</script>t<style>x</style>u<title>v</title>w<br>q<select><option>1</select>r") == [("body", "tuw qr")]
    assert runs("<b><p>x</b>y</p>z") == [("p", "xy"), ("body", "z")]
    assert runs("<a title='1>2' x=\"<p>\">t</a><a b=\"open>u</a>") == [("body", "tu")]
    assert runs("<table><tr><td>1<td>2</div>3<tr><td>4</table>5") == [("td", "1"), ("td", "23"), ("td", "4"), ("body", "5")]
    assert runs("<script>never closed <p>x") == [] == runs("") == runs("<!-- never closed")
    assert dom.attribute_tokens(" class='entryContent side-bar2' ID=Top role=main style='display: none'") == (
        "entry", "content", "side", "bar", "top", "main", "hidden")


def test_odd_rows(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = PAGES[0][0].replace(A, A + " word" * 200000)
    rows = [(1, None, None), (None, "u", ""), (2, "u", " \n "), (3, None, "<p></p>"), (4, "u", deep), (5, "u", long),
            (6, "u", PAGES[0][0]), (6, "u", PAGES[0][0]), (7, "u", "<" * 2000 + "a" * 10), (8, "u", "<a<" * 500)]
    got = rows_of(main_text.extracted(frame(spark, rows), model))
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert by_id[1]["text"] == by_id[None]["text"] == by_id[2]["text"] == by_id[3]["text"] == ""
    assert by_id[5]["text"] == "\n\n".join(["Flood", D, A + " word" * 200000, B])
    assert by_id[6]["text"] == "\n\n".join(PAGES[0][1])
    assert main_text.extracted(frame(spark, []), main_text.train(frame(spark, []))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_query_against_article_elements(spark):
    def brute(page):  # these tables' articles hold h1 and p alone
        inner = page[page.index("<article>"):page.index("</article>")]
        parts = re.split(r"<(?:/?p|/?h1|article)>", inner)
        texts = [" ".join(html_module.unescape(re.sub(r"<(?:br|/?b)>", " ", p)).split()) for p in parts]
        return "\n\n".join(t for t in texts if t)

    pages = {r["page_id"]: r for r in rows_of(spark.read.parquet(f"{SMALL}/pages.parquet"))}
    got = rows_of(queries.QUERIES["op13_main_text"](spark, SMALL))
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    assert all(r["text"] == brute(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"]
               and r["n_chars"] == len(r["text"]) for r in got)
