"""Main text of HTML pages by gradient-boosted trees over DOM-node features.

A page becomes a tree of its block elements (`dom`). Each node gets features: text, link and element density of its
subtree, learned weights of its attribute words and tag and of those above and below it, depth, place, and statistics
of its siblings. Boosted trees (`boost`) give the log-probability that the node is an open frame (it holds both kinds),
main text, or boilerplate. Decoding is by the whole tree: a frame may hold anything, below main text only main text or
a boilerplate part that the evidence pays `SWITCH` for, below boilerplate only boilerplate; the likeliest such choice
of all nodes is taken, so no ancestor contradicts a descendant. Text of main nodes is kept.

Pages carry no labels, so the model learns from pages that are rebuilt (`rebuilt_page`) from the text blocks of a
bounded sample of the pages at hand (`SAMPLE` pages of at most `SAMPLE_BYTES`, by hash order): the same blocks as
articles, menus, headers, footers, sidebars, notices, adverts, forms and comments under many ways of markup.

A null, empty or textless page gives the empty string. White space within a block becomes one space; blocks are joined
by two line ends. Broken markup is read as browsers read it, a page that ends within a tag ends before it. A page is
judged by itself alone, so repeated rows get equal texts; every row of an input gives one row.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import boost, words
from tidemark.llm.dom import HEADINGS, Tree, attribute_tokens, parse, squeezed

SAMPLE = 200
SAMPLE_BYTES = 1 << 16
REBUILT = 500
SWITCH = 3.0
PART = 4 << 20  # bytes of markup judged at once
OPEN, MAIN, OTHER = range(3)

#: Feature groups of block tags.
GROUPS = {name: k for k, group in enumerate((
    "p pre blockquote", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu dir", "li dd dt", "div center body", "section", "article main",
    "nav header footer aside address", "form fieldset legend dialog details summary", "table tbody thead tfoot tr td th caption",
    "figure figcaption")) for name in group.split()}


def _pages(trees: list[Tree]) -> dict:
    """The trees' arrays laid one behind the other; parents and ends count over all pages."""
    sizes = np.array([len(t.tag) for t in trees])
    first = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(trees)), sizes)
    shift = first[page]
    out = {"sizes": sizes, "first": first, "page": page}
    out["parent"] = np.fromiter((p for t in trees for p in t.parent), np.int64, len(page)) + shift
    out["parent"][first] = -1
    out["end"] = np.fromiter((e for t in trees for e in t.end), np.int64, len(page)) + shift
    for name in ("depth", "inline", "controls", "images"):
        out[name] = np.fromiter((d for t in trees for d in getattr(t, name)), np.int64, len(page))
    out["group"] = np.fromiter((GROUPS.get(x, 11) for t in trees for x in t.tag), np.int64, len(page))
    out["tag"] = [x for t in trees for x in t.tag]
    runs = np.array([len(t.runs) for t in trees])
    out["run_node"] = (np.fromiter((n for t in trees for n in t.run_node), np.int64, runs.sum())
                       + np.repeat(first, runs))
    out["run_page"] = np.repeat(np.arange(len(trees)), runs)
    out["text"] = [squeezed(r) for t in trees for r in t.runs]
    out["link"] = np.fromiter((sum(map(len, r)) for t in trees for r in t.links), np.int64, len(out["text"]))
    order = np.argsort(out["depth"], kind="stable")
    cuts = np.searchsorted(out["depth"][order], np.arange(out["depth"].max() + 2))
    out["levels"] = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def _measures(text: str) -> tuple[int, int, int, int, int]:
    count = text.count
    return len(text), count(" ") + 1, sum(map(count, ".,;:!?。、")), sum(map(count, "0123456789")), count("©")


class TokenWeights:
    """Smoothed log-odds of main text for tags and attribute words; an unknown word weighs 0."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight

    @classmethod
    def learned(cls, tags: list[str], attributes: list[str], label: np.ndarray, page: np.ndarray) -> TokenWeights:
        seen: Counter = Counter()  # pages, not nodes: a long list counts once
        for key in {(token, int(c), int(k)) for tag, a, c, k in zip(tags, attributes, label, page) if c != OPEN
                    for token in (f"<{tag}>", *attribute_tokens(a))}:
            seen[key[:2]] += 1
        total = [sum(n for (_, c), n in seen.items() if c == k) + 1 for k in (MAIN, OTHER)]
        return cls({token: float(np.clip(np.log((seen[token, MAIN] + 1) / total[0] * total[1] / (seen[token, OTHER] + 1)),
                                         -4, 4)) for token in {t for t, _ in seen}})

    def of(self, tags: list[str], attributes: list[str]) -> np.ndarray:
        """(4, nodes): sum, least and greatest weight of the attribute words, and the tag's weight."""
        memo: dict[str, tuple] = {}
        out = np.zeros((4, len(tags)), np.float32)
        for k, a in enumerate(attributes):
            if a:
                got = memo.get(a)
                if got is None:
                    found = [self.weight.get(t, 0.0) for t in attribute_tokens(a)] or [0.0]
                    got = memo[a] = (sum(found), min(found), max(found))
                out[0, k], out[1, k], out[2, k] = got
        out[3] = [self.weight.get(f"<{t}>", 0.0) for t in tags]
        return out


def features(d: dict, attributes: list[str], weights: TokenWeights) -> np.ndarray:
    """A row for each feature, a column for each node."""
    n = len(d["page"])
    parent, end, page, depth = d["parent"], d["end"], d["page"], d["depth"]
    up = np.maximum(parent, 0)
    top = parent < 0

    own = np.zeros((6, n))
    if d["text"]:
        per_run = np.array([_measures(t) for t in d["text"]], float).T
        for k, values in enumerate((*per_run, np.minimum(d["link"], per_run[0]))):
            own[k] = np.bincount(d["run_node"], values, n)
    runs = np.bincount(d["run_node"], minlength=n)

    def below(values) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[end + 1] - total[:n]

    chars, spaces, signs, digits, rights, linked = (below(v) for v in own)
    page_chars = np.maximum(chars[d["first"]], 1)[page]
    nodes = end - np.arange(n)
    inline, group = below(d["inline"]), d["group"]
    before = (np.cumsum(own[0]) - own[0])
    before = before - before[d["first"]][page]

    following = np.where((end + 1 < n), np.minimum(end + 1, n - 1), -1)
    following = np.where((following >= 0) & (parent[following] == parent) & ~top, following, -1)
    previous = np.full(n, -1)
    previous[following[following >= 0]] = np.flatnonzero(following >= 0)
    by_parent = np.argsort(parent, kind="stable")
    runs_of = words.run_starts(parent[by_parent])
    count = np.diff(np.append(runs_of, n))
    rank, siblings = np.zeros(n), np.zeros(n)
    rank[by_parent] = np.arange(n) - np.repeat(runs_of, count)
    siblings[by_parent] = np.repeat(count, count)
    rank[top], siblings[top] = 0, 1
    same = np.zeros(n)
    key = up * 16 + group
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    same[:] = times[inverse]
    child_chars = np.bincount(up[~top], chars[~top], n)
    sibling_mean = (child_chars[up] - chars) / np.maximum(siblings - 1, 1)
    greatest = np.zeros(n)
    np.maximum.at(greatest, up[~top], chars[~top])

    ratio = linked / np.maximum(chars, 1)
    token = weights.of(d["tag"], attributes)
    whole = token[0] + token[3]
    above = np.zeros((4, n), np.float32)  # sum, least, greatest over ancestors; nearest with a weight
    for level in d["levels"][1:]:
        p = parent[level]
        above[0, level] = above[0, p] + whole[p]
        above[1, level] = np.minimum(above[1, p], np.minimum(token[1, p], token[3, p]))
        above[2, level] = np.maximum(above[2, p], np.maximum(token[2, p], token[3, p]))
        above[3, level] = np.where(whole[p] != 0, whole[p], above[3, p])

    def beside(values, which, default=0.0):
        return np.where(which >= 0, values[np.maximum(which, 0)], default)

    heading = (group == 1).astype(float)
    paragraph = (group == 0).astype(float)
    own_text = np.log1p(own[0])
    columns = [
        own_text, np.log1p(chars), chars / page_chars, ratio, own[5] / np.maximum(own[0], 1), np.log1p(nodes),
        chars / (1 + nodes + inline), signs / np.maximum(chars, 1), chars / np.maximum(spaces, 1), np.log1p(spaces),
        np.log1p(chars / np.maximum(below(runs), 1)), depth, rank, siblings, before / page_chars, (before + chars) / page_chars,
        *token, *above, below(whole) / (1 + nodes), beside(whole, previous), beside(whole, following),
        np.log1p(beside(chars, previous)), np.log1p(beside(chars, following)), beside(ratio, previous), beside(ratio, following),
        same / siblings, np.log1p(np.maximum(sibling_mean, 0)), chars / np.maximum(chars[up], 1), chars >= greatest[up],
        np.log1p(below(paragraph)), below(paragraph * own[0]) / np.maximum(chars, 1), np.log1p(below(d["controls"])),
        np.log1p(below(d["images"])), below(group == 3) / (1 + nodes), digits / np.maximum(chars, 1), rights > 0,
        beside(heading, previous), below(heading), ratio[up], np.log1p(page_chars), np.log1p(below(paragraph)[up]),
        *(group == k for k in range(12))]
    return np.stack([np.asarray(c, np.float32) for c in columns])


def decoded(d: dict, evidence: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The likeliest choice for all nodes: OPEN below OPEN only, MAIN below OPEN and MAIN, OTHER anywhere."""
    parent, total = d["parent"], evidence.astype(float).copy()
    choice = np.zeros((3, len(total)), np.int8)  # by the parent's choice, the node's own
    for level in reversed(d["levels"]):
        value = total[level]
        kept = value[:, MAIN] >= value[:, OTHER] - switch
        choice[OPEN, level] = np.argmax(value, axis=1)
        choice[MAIN, level] = np.where(kept, MAIN, OTHER)
        choice[OTHER, level] = OTHER
        p = parent[level]
        inner = p >= 0
        gain = np.stack([value.max(1), np.maximum(value[:, MAIN], value[:, OTHER] - switch), value[:, OTHER]], 1)
        for k in range(3):
            total[:, k] += np.bincount(p[inner], gain[inner, k], len(total)) if inner.any() else 0
    out = np.zeros(len(total), np.int8)
    for level in d["levels"]:
        p = parent[level]
        out[level] = choice[np.where(p >= 0, out[np.maximum(p, 0)], OPEN), level]
    return out


class Model:
    """Weights of attribute words and the boosted trees over the features."""

    def __init__(self, weights: TokenWeights, trees: boost.Boosted):
        self.weights, self.trees = weights, trees

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        trees = [parse(html) for html in pages]
        d = _pages(trees)
        if not d["text"]:
            return [""] * len(pages)
        x = features(d, [a for t in trees for a in t.attributes], self.weights)
        choice = decoded(d, self.trees.scores(x))
        out: list[list[str]] = [[] for _ in pages]
        kept = choice[d["run_node"]] == MAIN
        for page, text, keep in zip(d["run_page"].tolist(), d["text"], kept.tolist()):
            if keep and text:
                out[page].append(text)
        return ["\n\n".join(blocks) for blocks in out]


# ---- training pages

#: Words of class and id values by what they name. Fixed values, by sense.
NAMES = {
    "article": "article content post entry story text page body main blog news single detail copy prose markdown reading",
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs tabs links submenu toc pagination pager skip dropdown",
    "header": "header masthead top branding logo site title tagline topbar hero banner strip",
    "footer": "footer bottom copyright legal colophon credits foot imprint sitemap",
    "sidebar": "sidebar side widget related recommended popular more aside rail trending tags categories archive latest teaser",
    "notice": "notice cookie consent gdpr alert warning message popup modal overlay paywall disclaimer announcement toast info",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense dfp partner commercial adslot outbrain",
    "form": "form search newsletter signup login subscribe contact register poll survey feedback field",
    "comments": "comments comment replies reply discussion responses disqus commentlist respond thread reader opinions user",
    "share": "share social sharing follow tools toolbar buttons like tweet print",
    "frame": "wrapper container row col inner outer layout grid box section site wrap block clearfix holder primary region"}
_SUFFIX = ("", "", "", "list", "box", "wrapper", "area", "section", "block", "inner", "1", "item")
_TAGS = {"article": ["article", "article", "main", "div", "div", "div", "section", "td"],
         "menu": ["nav", "nav", "ul", "div", "ol"], "header": ["header", "header", "div"],
         "footer": ["footer", "footer", "div", "section"], "sidebar": ["aside", "aside", "div", "section", "ul"],
         "notice": ["div", "div", "section", "p", "aside", "dialog"], "advert": ["div", "div", "div", "aside", "section"],
         "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol", "ul"], "share": ["div", "ul"],
         "frame": ["div", "div", "div", "section", "center"]}
_BY_TAG = {"nav", "header", "footer", "aside", "form", "article", "main"}  # tags that may stand without a name
_MARK = "mark-role="


class _Writer:
    """Writes one page from blocks of text; elements that decide a role carry the mark that labels them."""

    def __init__(self, rng: random.Random, prose: list[str], short: list[str], escape):
        self.rng, self.prose, self.short, self.escape = rng, prose, short, escape
        self.semantic = rng.random() < 0.6
        self.optional_ends = rng.random() < 0.25
        self.named = rng.random() < 0.9
        self.table = rng.random() < 0.08  # the page is laid out as one table

    def named_as(self, role: str) -> str:
        rng = self.rng
        stem = rng.choice(NAMES[role].split())
        if rng.random() < 0.35:
            stem += rng.choice("-_ ") + rng.choice(rng.choice([NAMES[role], NAMES["frame"]]).split())
        suffix = rng.choice(_SUFFIX)
        stem += (rng.choice("-_") + suffix) if suffix else ""
        return f' {rng.choice(["class", "class", "class", "id"])}="{stem}"'

    def element(self, role: str, body: str, label: int | None, tag: str | None = None) -> str:
        tag = tag or self.rng.choice(["td"] if self.table and label is not None else [t for t in _TAGS[role] if self.semantic or t not in _BY_TAG or t == "form"]
                                     or ["div"])
        named = (tag in _BY_TAG and self.rng.random() < 0.45) or (role in ("article", "frame") and not self.named)
        attributes = "" if named or tag == "td" and self.rng.random() < 0.5 else self.named_as(role)
        mark = "" if label is None else f" {_MARK}{label}"
        inside = f"<{tag}{attributes}{mark}>{body}</{tag}>"
        return f"<table><tr>{inside}</tr></table>" if tag == "td" and not self.table else inside

    def sentence(self) -> str:
        text = self.rng.choice(self.prose).split(" ")
        at = self.rng.randrange(len(text))
        return self.escape(" ".join(text[at:at + self.rng.randrange(4, 18)]).capitalize())

    def paragraph_text(self) -> str:
        r = self.rng.random()
        if r < 0.12:
            return self.escape(self.rng.choice(self.short).capitalize() + self.rng.choice([".", "", "!"]))
        if r < 0.3:
            return self.sentence() + "."
        return self.escape(self.rng.choice(self.prose))

    def link(self) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.escape(self.rng.choice(self.short).capitalize())}</a>'

    def links(self, least: int, most: int) -> str:
        n = self.rng.randrange(least, most)
        style = self.rng.randrange(4)
        if style < 2:
            end = "" if self.optional_ends else "</li>"
            items = "".join(f"<li>{self.link()}{end}" for _ in range(n))
            return f"<ul>{items}</ul>" if style == 0 else items
        return self.rng.choice([" | ", " ", "<br>", " &middot; "]).join(self.link() for _ in range(n))

    def paragraph(self) -> str:
        rng, text = self.rng, self.paragraph_text()
        r = rng.random()
        if r < 0.12:
            text = f"<b>{text}<br>" if rng.random() < 0.5 else f"<b>{text}</b>"
        elif r < 0.3:
            ws = text.split(" ")
            at = rng.randrange(len(ws))
            ws[at] = f'<{rng.choice(["em", "strong", "i", "span"])}>{ws[at]}</em>' if rng.random() < 0.5 else self.link()
            text = " ".join(ws)
        elif r < 0.36:
            text += "<br>" + self.paragraph_text()
        return f"<p>{text}" if self.optional_ends or "<b>" in text and rng.random() < 0.5 else f"<p>{text}</p>"

    def article(self) -> str:
        rng, parts = self.rng, []
        table, self.table = self.table, False
        if rng.random() < 0.85:
            title = f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{self.sentence()}</{h}>"
            parts.append(f'<header {_MARK}{MAIN}>{title}</header>' if rng.random() < 0.15 else title)
        style = rng.random()
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            r = rng.random()
            if r < 0.06:
                parts.append(f"<{(h := rng.choice(['h2', 'h3']))}>{self.sentence()}</{h}>")
            elif r < 0.1:
                parts.append("<ul>" + "".join(f"<li>{self.paragraph_text()}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif r < 0.13:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif r < 0.15:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif r < 0.17:
                parts.append("<table>" + "".join(f"<tr><td>{self.sentence()}<td>{self.sentence()}" for _ in range(3)) + "</table>")
            elif r < 0.18:
                parts.append(f"<pre>{self.sentence()}</pre>")
            elif style < 0.1:
                parts.append(f"<div>{self.paragraph_text()}</div>")
            elif style < 0.16:
                parts.append(self.paragraph_text() + "<br><br>")
            else:
                parts.append(self.paragraph())
        for role in ("advert", "share", "sidebar", "notice", "form"):  # boilerplate within the article
            if rng.random() < 0.1:
                parts.insert(rng.randrange(1, len(parts) + 1), self.boilerplate(role))
        if rng.random() < 0.15:
            parts.append(self.boilerplate("comments"))
        body = "".join(parts)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            body = self.element(rng.choice(["article", "frame"]), body, None, "div")
        self.table = table
        return self.element("article", body, MAIN)

    def boilerplate(self, role: str) -> str:
        rng = self.rng
        if role in ("menu", "share"):
            body = self.links(2, 12)
        elif role == "header":
            h = rng.choice(["h1", "h2", "p", "div", "span"])
            body = f"<{h}>{self.escape(rng.choice(self.short).capitalize())}</{h}>"
            body += f"<p>{self.sentence()}</p>" * (rng.random() < 0.4) + self.links(1, 6) * (rng.random() < 0.4)
        elif role == "footer":
            body = rng.choice(["&copy; ", "&copy; 2024 ", "", "© "]) + self.sentence() + rng.choice(["", ".", " &middot; " + self.sentence()])
            body = (f"<p>{body}</p>" if rng.random() < 0.5 else body) + self.links(1, 7) * (rng.random() < 0.5)
        elif role == "sidebar":
            body = f"<h3>{self.sentence()}</h3>" * (rng.random() < 0.7)
            body += self.links(2, 9) if rng.random() < 0.6 else "".join(
                f"<div><h4>{self.link()}</h4><p>{self.sentence()}</p></div>" for _ in range(rng.randrange(1, 5)))
            body += self.paragraph() * (rng.random() < 0.3)
        elif role == "notice":
            body = rng.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.sentence() + ". " + self.sentence() + ".")
            body += rng.choice(["", "<button>OK</button>", self.link()])
        elif role == "advert":
            body = rng.choice(["<p>{}</p>", "{}", "{}", "<a href=x>{}</a>"]).format(rng.choice([self.sentence(), self.paragraph_text()]))
        elif role == "form":
            body = f"<label>{self.sentence()}</label><input name=q>" * rng.randrange(1, 4) + "<button>Go</button>"
            body = f"<p>{self.sentence()}</p>" * (rng.random() < 0.5) + body
        else:
            item = rng.choice(["li", "div", "article", "p", "dd"])
            named = self.named_as("comments") if rng.random() < 0.6 else ""
            body = f"<h3>{self.sentence()}</h3>" * (rng.random() < 0.6) + "".join(
                f"<{item}{named}>" + (f"<b>{self.sentence()}</b> " if rng.random() < 0.5 else "") +
                (self.paragraph() if rng.random() < 0.6 and item != "p" else self.paragraph_text()) + f"</{item}>"
                for _ in range(rng.randrange(1, 7)))
        return self.element(role, body, OTHER)

    def laid_out(self) -> str:
        rng = self.rng
        sides = [self.boilerplate(r) for r in rng.sample(["menu", "sidebar", "advert"], rng.randrange(0, 3))]
        middle = [*sides, self.article()]
        rng.shuffle(middle)
        rows = [self.boilerplate(r) for r in rng.sample(["header", "menu", "notice"], rng.randrange(0, 3))]
        rows += ["".join(middle), *(self.boilerplate(r) for r in rng.sample(["footer", "comments"], rng.randrange(0, 3)))]
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    def page(self) -> str:
        rng = self.rng
        if self.table:
            return f"<html><body>{self.laid_out()}</body></html>"
        def some(roles):
            return "".join(self.boilerplate(r) for r in rng.sample(roles, rng.randrange(0, len(roles) + 1)))
        before = some(["menu", "header", "advert", "notice", "form", "share"])
        beside = some(["sidebar", "advert", "menu"]) if rng.random() < 0.5 else ""
        after = some(["comments", "sidebar", "share", "form", "advert"]) if rng.random() < 0.6 else ""
        body = self.article()
        if rng.random() < 0.5:
            body = self.element("frame", rng.choice([body + beside, beside + body]) + after, None)
        else:
            body = beside + body + after
        footer = (self.boilerplate("footer") if rng.random() < 0.85 else "") + (self.boilerplate("notice") if rng.random() < 0.15 else "")
        body = before + body + footer
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = self.element("frame", body, None)
        return f"<html><body>{body}</body></html>"


def rebuilt_page(rng: random.Random, prose: list[str], short: list[str]) -> str:
    """A page whose elements tell in a mark which is main text and which is boilerplate."""
    from html import escape

    return _Writer(rng, prose, short, lambda s: escape(s, quote=False)).page()


def _labels(trees: list[Tree]) -> np.ndarray:
    out: list[int] = []
    for t in trees:
        first = len(out)
        for parent, a in zip(t.parent, t.attributes):
            at = a.find(_MARK)
            out.append(int(a[at + len(_MARK)]) if at >= 0 else out[first + parent] if parent >= 0 else OPEN)
    return np.array(out)


def fit(prose: list[str], short: list[str], pages: int = REBUILT, seed: int = 3) -> Model:
    """Learn from `pages` pages rebuilt of the given blocks; words are added so that no stock is empty."""
    rng = random.Random(seed)
    letters = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randrange(2, 10))) for _ in range(400)]
    filler = [" ".join(rng.choices(letters, k=rng.randrange(8, 80))).capitalize() + "." for _ in range(60)]
    prose, short = prose + filler[len(prose):], short + letters[:max(0, 100 - len(short))]
    trees = [parse(rebuilt_page(rng, prose, short)) for _ in range(pages)]
    d = _pages(trees)
    attributes = [a for t in trees for a in t.attributes]
    label = _labels(trees)
    half = d["page"] % 2
    x = None
    for k in range(2):  # weights of words come from the other half: else their own pages would vouch for them
        others = np.flatnonzero(half != k)
        weights = TokenWeights.learned([d["tag"][i] for i in others], [attributes[i] for i in others], label[others],
                                       d["page"][others])
        got = features(d, attributes, weights)
        x = got if x is None else np.where(half == k, got, x)
    return Model(TokenWeights.learned(d["tag"], attributes, label, d["page"]), boost.fit(x, label, 3))


def _stock(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = [squeezed(r) for html in batch.column("html").to_pylist() for r in parse(html or "").runs]
        yield pa.RecordBatch.from_arrays([pa.array([t[:1000] for t in texts if t], pa.string())], names=["block"])


def train(pages: DataFrame, html: str = "html") -> Model:
    """A model from the text blocks of `SAMPLE` pages."""
    sample = (pages.select(F.col(html).cast("string").alias("html"))
              .where(F.octet_length("html").between(1, SAMPLE_BYTES)).orderBy(F.xxhash64("html"), "html").limit(SAMPLE))
    blocks = sorted(set(sample.mapInArrow(_stock, "block string").toArrow().column("block").to_pylist()))
    prose = [b for b in blocks if b.count(" ") >= 7]
    return fit(prose, [b for b in blocks if b.count(" ") <= 3 and len(b) < 60])


def extracted(pages: DataFrame, model: Model, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars (its code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [f"k{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in words.text_batches(batches, "html", PART):
            texts = shared.value.texts([h or "" for h in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([*words.kept_columns(batch, *names), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    out = rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "text", "n_chars")
