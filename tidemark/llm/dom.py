"""Element trees of HTML pages as flat arrays, for features and decoding by numpy.

Block elements are nodes in page order; inline elements are folded into the block around them. A text run is the text
between two block boundaries and belongs to the innermost open block. Omitted end tags, stray end tags, unclosed
elements, comments and raw-text elements are read as browsers do; text of scripts, styles, titles and form controls is
no text. The tree is built without recursion, so depth is not bounded.
"""

from __future__ import annotations

import re
from html import unescape

# fixed values: element names of HTML by how they are read
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SKIPPED = frozenset("audio button canvas datalist map math menuitem noscript object option optgroup progress select svg "
                    "template video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("caption colgroup table tbody td tfoot th thead tr".split())
CELLS = frozenset("caption td th table".split())
#: element: (open elements that its start tag ends, elements that shield them)
ENDS = {"li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
        "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})), "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
        "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
        "tr": (frozenset({"tr"}), frozenset({"table"})),
        **{k: (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})) for k in ("tbody", "thead", "tfoot")}}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|style)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|"""
                        r"""(?:^|[\s"'])(hidden)(?=[\s=/]|$)""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and itemprop; `hidden` where an element says that it isn't shown."""
    out = []
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        if hidden or name.lower() == "style":
            if hidden or _HIDDEN.search(value):
                out.append("hidden")
        else:
            out += _WORD.findall(_HUMP.sub(r"\1 \2", value).lower())
    return tuple(dict.fromkeys(out))


class Tree:
    """Nodes in page order (`tag`, `parent`, `depth`, `end`: last node below, `attributes`) and text runs (`run_node`, `runs`)."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.end, self.attributes = ["body"], [-1], [0], [0], [""]
        self.inline, self.controls, self.images = [0], [0], [0]  # tags folded into the node
        self.run_node: list[int] = []
        self.runs: list[list[str]] = []
        self.links: list[list[str]] = []  # the parts of a run that stand in links


def parse(html: str) -> Tree:
    t = Tree()
    names, nodes = ["body"], [0]  # open elements; -1 for inline ones
    blocks = [0]
    opened: dict[str, int] = {"body": 1}
    skipped = anchors = 0
    fresh = True  # a block boundary lies before the next text

    def text(raw: str) -> None:
        nonlocal fresh
        if skipped or not raw:
            return
        if fresh:
            if raw.isspace():
                return
            t.run_node.append(blocks[-1])
            t.runs.append([])
            t.links.append([])
            fresh = False
        raw = unescape(raw) if "&" in raw else raw
        t.runs[-1].append(raw)
        if anchors:
            t.links[-1].append(raw)

    def pop(upto: int) -> None:
        nonlocal skipped, anchors, fresh
        while len(names) > upto:
            name, node = names.pop(), nodes.pop()
            opened[name] -= 1
            if name == "a":
                anchors -= 1
            if name in SKIPPED:
                skipped -= 1
            if node >= 0:
                t.end[node] = len(t.tag) - 1
                blocks.pop()
                fresh = True

    def ends(targets: frozenset, shields: frozenset) -> None:
        if any(opened.get(x) for x in targets):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in targets:
                    return pop(k)
                if names[k] in shields:
                    return None

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        while lt >= 0 and not (html[lt + 1:lt + 2].isalpha() or html[lt + 1:lt + 2] in ("!", "?", "/")):
            lt = html.find("<", lt + 1)  # a plain sign
        if lt < 0 or lt + 1 == size:
            text(html[at:])
            break
        text(html[at:lt])
        m = _TAG.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
                at = stop + 3 if stop >= 0 else size
            elif html[lt + 1].isascii() and html[lt + 1].isalpha() or html[lt + 1] == "/" and html[lt + 2:lt + 3].isalpha():
                break  # the page ends within a tag
            elif html[lt + 1] in "!?/":
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else size
            else:
                text("<")
                at = lt + 1
            continue
        at = m.end()
        closing, name, attributes = m.groups()
        name = name.lower()
        if closing:
            if name == "br":
                text("\n")
            elif not opened.get(name):
                fresh = fresh or name == "p"
            elif name not in ("body", "html"):
                k = len(names) - 1
                while names[k] != name and (name in TABLE or name in INLINE or names[k] not in CELLS):
                    k -= 1
                if names[k] == name:
                    if nodes[k] < 0 and any(n >= 0 for n in nodes[k + 1:]):  # blocks stand in an inline element
                        del names[k], nodes[k]
                        opened[name] -= 1
                        anchors -= name == "a"
                    else:
                        pop(k)
            continue
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            if stop is None:
                break
            close = html.find(">", stop.end())
            at = close + 1 if close >= 0 else size
            t.controls[blocks[-1]] += name == "textarea"
        elif name in VOID:
            if name == "br":
                text("\n")
            elif name == "hr":
                ends(frozenset({"p"}), CELLS)
                fresh = True
            elif name == "input":
                t.controls[blocks[-1]] += 1
            elif name == "img":
                t.images[blocks[-1]] += 1
        elif name in ("html", "head", "body"):
            t.attributes[0] += " " + attributes if name == "body" else ""
        elif name in INLINE or name in SKIPPED:
            if name == "a" and anchors:
                k = len(names) - 1 - names[::-1].index("a")
                if any(n >= 0 for n in nodes[k + 1:]):
                    del names[k], nodes[k]
                    opened["a"] -= 1
                    anchors -= 1
                else:
                    pop(k)
            names.append(name)
            nodes.append(-1)
            opened[name] = opened.get(name, 0) + 1
            anchors += name == "a"
            skipped += name in SKIPPED
            t.inline[blocks[-1]] += 1
            t.controls[blocks[-1]] += name in ("button", "select")
        else:
            if name in ENDS_P and opened.get("p"):
                ends(frozenset({"p"}), CELLS)
            if name in HEADINGS and names[-1] in HEADINGS:
                pop(len(names) - 1)
            if name in ENDS:
                ends(*ENDS[name])
            node = len(t.tag)
            t.tag.append(name)
            t.parent.append(blocks[-1])
            t.depth.append(len(blocks))
            t.end.append(node)
            t.attributes.append(attributes)
            t.inline.append(0)
            t.controls.append(0)
            t.images.append(0)
            names.append(name)
            nodes.append(node)
            blocks.append(node)
            opened[name] = opened.get(name, 0) + 1
            fresh = True
    pop(0)
    return t


def squeezed(parts: list[str]) -> str:
    """The text of a run: white space as one space, trimmed."""
    return " ".join("".join(parts).split())
