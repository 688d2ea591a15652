"""Main text of web pages: a tree-structured model of the DOM decides which blocks belong to the article.

Every block element is a node that is content or not. Its own features give it a score, and a table for its
kind of element ties it to its parent; messages up and down the tree (sum-product) yield each node's marginal.
Scores and tables are fitted to labelled pages by the gradient of the likelihood. The text of a page is that of
its nodes with a marginal of at least a half, block by block.

Null and empty pages, and pages without article, give an empty text; damaged markup is closed where HTML
would close it. Equal pages give equal texts. Very long and very deep pages are read whole, in time in proportion to their nodes. Null ids and addresses are
kept, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import pages as labelled_pages

#: Elements of formulas; they stay in the line. What an annotation holds is the formula's source, not its text.
MATH = set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
#: Parts of forms and things that are shown in the line; they have no text of the page.
SHOWN = set("button select option optgroup object audio video canvas iframe svg textarea datalist map".split())
#: Elements that stay inside the block around them.
INLINE = MATH | SHOWN | set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br label input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
SILENT = SHOWN | set("script style noscript template head title annotation annotation-xml".split())
#: Elements that may stand in the head; any other one closes it.
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes, and the elements that keep it from reaching further up.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KINDS = {t: 0 for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figcaption")} | {t: 1 for t in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead")} | {t: 2 for t in ("nav", "footer", "aside", "form", "header")}
N_KINDS = 4
SPACES = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
#: Ends of sentences, and what the line at the foot of a page says.
STOPS = re.compile(r"[.!?。！？](?=\s|$)")
RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "chars", "linked", "stops", "rights", "mark")

    def __init__(self, tag: str, parent: int, depth: int, words: list[str], mark: bool):
        self.tag, self.parent, self.depth, self.words, self.mark = tag, parent, depth, words, mark
        self.chars = self.linked = self.stops = self.rights = 0


class Dom(HTMLParser):
    """Block nodes in page order and the runs of text between block tags, each with its node."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, 0, [], True)]
        self.open: list[tuple[str, int]] = []  # tag, node; -1 for inline elements
        self.often: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[tuple[int, str]] = []
        self.run: list[str] = []
        self.block, self.links, self.silent = 0, 0, 0

    def end_run(self) -> None:
        if self.run:
            text = SPACES.sub(" ", "".join(self.run)).strip()
            if text:
                self.blocks.append((self.block, text))
            self.run = []

    def close_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.close(("head",), set())
        elif tag not in IN_HEAD:
            self.close_head()
        if tag in CLOSES_P:
            self.close(("p",), {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            self.close(*SIBLINGS[tag], every=True)
        if tag in INLINE or (self.silent and tag not in SILENT):
            if tag == "br":
                self.run.append(" ")
            if tag not in VOID:
                self.open.append((tag, -1))
                self.often[tag] += 1
                self.links += tag == "a"
                self.silent += tag in SILENT
            return
        self.end_run()
        names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in NAME.findall(v.lower())]
        self.nodes.append(Node(tag, self.block, self.nodes[self.block].depth + 1, names, any(k == "y" for k, _ in attrs)))
        if tag not in VOID:
            self.open.append((tag, len(self.nodes) - 1))
            self.often[tag] += 1
            self.block = len(self.nodes) - 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML, but it does in formulas
        if tag in MATH:
            self.pop()

    def pop(self) -> None:
        tag, node = self.open.pop()
        self.often[tag] -= 1
        if node >= 0:
            self.end_run()
            self.block = self.nodes[node].parent
        else:
            self.links -= tag == "a"
        self.silent -= tag in SILENT

    def close(self, tags: tuple[str, ...] | set[str], stop: set[str], every: bool = False) -> None:
        if not any(self.often[t] for t in tags):
            return  # so a deep page is not walked up at every tag
        at, k = -1, len(self.open) - 1
        while k >= 0 and self.open[k][0] not in stop:
            if self.open[k][0] in tags:
                at = k
                if not every:
                    break
            k -= 1
        while 0 <= at < len(self.open):
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if re.fullmatch("h[1-6]", tag):  # any heading's end closes the open one
            tags = {f"h{i}" for i in range(1, 7)}
        else:
            tags = {tag}
        self.close(tags, set() if tag not in INLINE else {t for t in CLOSES_P if t not in tags} | {"td", "th", "li"})

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.close_head()
        if self.silent:
            return
        self.run.append(data)
        n = len(data) - data.count(" ")
        node = self.nodes[self.block]
        node.chars += n
        node.stops += len(STOPS.findall(data))
        node.rights |= bool(RIGHTS.search(data))
        if self.links:
            node.linked += n

    def finish(self) -> Dom:
        self.close_all()
        return self

    def close_all(self) -> None:
        super().close()
        self.end_run()


def parse(html: str | None) -> Dom:
    dom = Dom()
    dom.feed(html or "")
    return dom.finish()


@cache
def bucket(n: int) -> str:
    return str(min(n.bit_length(), 10))


def node_features(dom: Dom) -> list[list[str]]:
    """Names of the features that each node has."""
    chars, linked, stops = [n.chars for n in dom.nodes], [n.linked for n in dom.nodes], [n.stops for n in dom.nodes]
    for i in range(len(dom.nodes) - 1, 0, -1):
        p = dom.nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    whole = max(chars[0], 1)
    # First, last or between among the children of its parent that have text.
    order, last = ["between"] * len(dom.nodes), {}
    for i, n in enumerate(dom.nodes):
        if chars[i] and n.parent >= 0:
            order[i] = "between" if n.parent in last else "first"
            last[n.parent] = i
    for i in last.values():
        order[i] = "last" if order[i] == "between" else "only"
    out = []
    for i, n in enumerate(dom.nodes):
        p = dom.nodes[n.parent] if n.parent >= 0 else n
        share = str(linked[i] * 4 // chars[i]) if chars[i] else "none"
        row = ["all", f"tag {n.tag}", f"tag {n.tag} in {p.tag}", f"links {share}", f"chars {bucket(chars[i])}", f"kind {KINDS.get(n.tag, 3)} links {share}"]
        row += [f"name {w}" for w in n.words] or ["unnamed"]
        row += [f"parent name {w}" for w in p.words] if p is not n else []
        # Elements without a name, or with one that was never seen, are told by how they read and by their share of the page.
        row += [f"sentences {bucket(n.stops)} links {share}", f"own {bucket(n.chars)}", f"part {min(8 * chars[i] // whole, 7)} kind {KINDS.get(n.tag, 3)}"] + ["rights"] * n.rights + ["in line"] * (n.linked < n.chars < 24)
        if p is not n:
            row += [f"in sentences {bucket(stops[n.parent] - stops[i])}", f"place {order[i]} part {min(8 * chars[i] // whole, 7)}"] + ["under rights"] * p.rights
        out.append(row)
    return out


@dataclass
class Forest:
    """The nodes of many pages; features in rows of different length."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    row: np.ndarray


def forest(doms: list[Dom], number: dict[str, int], grow: bool = False) -> Forest:
    parent, depth, kind, features, row = [], [], [], [], []
    for dom in doms:
        base = len(parent)
        for n, names in zip(dom.nodes, node_features(dom), strict=True):
            here = len(parent)
            for name in names:
                f = number.setdefault(name, len(number)) if grow else number.get(name)
                if f is not None:
                    features.append(f)
                    row.append(here)
            parent.append(base + n.parent if n.parent >= 0 else -1)
            depth.append(n.depth)
            kind.append(KINDS.get(n.tag, 3))
    return Forest(*(np.array(x, dtype=np.int64) for x in (parent, depth, kind, features, row)))


@dataclass
class Model:
    number: dict[str, int]
    weight: np.ndarray
    edge: np.ndarray  # [kind of the child, parent's state, child's state]

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the nodes, [node, state], and of the edges to their parents, [node, parent's state, state]."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        np.add.at(own[:, 1], f.row, self.weight[f.features])
        pair = self.edge[f.kind]
        by = np.argsort(f.depth, kind="stable")
        levels = np.split(by, np.searchsorted(f.depth[by], np.arange(1, int(f.depth.max(initial=0)) + 1)))
        up, message = own.copy(), np.zeros((n, 2))
        for at in reversed(levels[1:]):
            message[at] = np.logaddexp.reduce(pair[at] + up[at][:, None, :], axis=2)
            np.add.at(up, f.parent[at], message[at])
        total = up.copy()  # with the message from above
        joint = np.zeros((n, 2, 2))
        for at in levels[1:]:
            p = f.parent[at]
            rest = total[p] - message[at]
            joint[at] = pair[at] + rest[:, :, None] + up[at][:, None, :]
            total[at] += np.logaddexp.reduce(pair[at] + rest[:, :, None], axis=1)
        node = np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
        flat = joint.reshape(n, 4)
        joint = np.exp(flat - np.logaddexp.reduce(flat, axis=1)[:, None]).reshape(n, 2, 2)
        joint[f.parent < 0] = 0
        return node, joint


def fit(html: list[str], rounds: int = 120, rate: float = 0.15, ridge: float = 0.002) -> Model:
    """The likelihood's gradient, observed minus expected counts, with steps scaled by past gradients."""
    doms = [parse(h) for h in html]
    number: dict[str, int] = {}
    f = forest(doms, number, grow=True)
    y = np.array([n.mark for d in doms for n in d.nodes], dtype=np.int64)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    model = Model(number, np.zeros(len(number)), np.zeros((N_KINDS, 2, 2)))
    squares = [np.full(len(number), 1e-8), np.full((N_KINDS, 2, 2), 1e-8)]
    n = len(y)
    for _ in range(rounds):
        node, joint = model.beliefs(f)
        g = np.bincount(f.features, weights=(y - node[:, 1])[f.row], minlength=len(number)) / n - ridge * model.weight / 100
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        e = (seen - expected) / n - ridge * model.edge / 100
        for s, grad, value in ((squares[0], g, model.weight), (squares[1], e, model.edge)):
            s += grad**2
            value += rate * grad / np.sqrt(s)
    return model


@cache
def trained(n: int = 700, seed: int = 1) -> Model:
    """The model of so many labelled pages, fitted once a session."""
    return fit(labelled_pages(n, seed))


def extract(doms: list[Dom], model: Model) -> list[str]:
    f = forest(doms, model.number)
    content = model.beliefs(f)[0][:, 1] >= 0.5 if len(f.parent) else []
    out, base = [], 0
    for dom in doms:
        out.append("\n".join(text for node, text in dom.blocks if content[base + node]))
        base += len(dom.nodes)
    return out


def html_extraction(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page its id, url, main text and the text's number of code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                texts = extract([parse(h) for h in part.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
