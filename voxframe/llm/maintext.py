"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two borders of block elements. Its features are the tags and the words of class, id
and role of its ancestors, and traits of its text (words, links, punctuation, place). The field has two labels, main
and other; it is trained by maximum likelihood on the labelled pages that training_pages() makes from many layouts, and decoded by Viterbi.

Defined cases: null and empty html give the empty text; html without a main block gives the empty text; broken html is read
leniently (open elements end with their parent, a paragraph ends at the next block, a drawing too, an open comment or script ends
with the page, a tag whose end or closing quote is missing ends at the next < or >); any page is read in linear time; formulas, the text of drawings and what stands in object and canvas are inline text, a template is never shown; equal pages give equal texts; repeated rows are read each; an empty table gives an empty table; columns kept pass through, whatever their names are, but for _vx_main.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.batches import map_batches
from voxframe.workspace import small_batches

# Fixed sets of HTML elements.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe".split())
#: In a drawing only these show text; of a formula all is shown but its annotations.
DRAWN, NOTES = frozenset("text foreignobject".split()), frozenset("annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag on the left ends an open element on the right that stands in the same parent.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A tag to its >, quotes kept; a tag that never ends so goes to the next < or >; then comments and declarations. Nothing is read twice for long, so a page is read in linear time.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|([^<>]*+)>?)|<!--|<[!?][^>]*+>?""")
_ENDING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I | re.A) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MAIN, OTHER = 0, 1


class Node:
    """A kind of element: its parent's kind and its own names. One object for equal ones of a page."""

    __slots__ = ("parent", "names", "new", "size", "inside")

    def __init__(self, parent: Node | None, names: tuple[str, ...], new: tuple[str, ...]):
        self.parent, self.names, self.new = parent, names, new  # new: names that no ancestor has
        self.size = len(names) + (parent.size if parent else 0)
        self.inside: float | None = None

    @property
    def own(self) -> str:
        return self.names[0] if self.names else "none"


@dataclass
class Block:
    node: Node
    text: str
    linked: int = 0  # characters of the text inside links
    main: bool = False  # in training pages

    @property
    def path(self) -> tuple[str, ...]:
        """Names of ancestors, then of the element itself."""
        out, node = [], self.node
        while node:
            out += reversed(node.names)
            node = node.parent
        return tuple(reversed(out))


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and tag-free words of class, id and role."""
    out = [tag]
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            out += (f".{w.lower()}" for w in _WORD.findall(m[1] or m[2] or m[3] or ""))
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    kinds: dict[tuple[Node, tuple[str, ...]], Node] = {}
    stack: list[Node] = [Node(None, (), ())]
    names_open: dict[str, int] = {}
    held: list[tuple[str, bool]] = []
    drawn: list[bool] = []  # for each open svg, whether text about it is hidden
    links = at = 0
    hidden = False

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(references.unescape("".join(t for t, _ in held)).split())
            if text:
                linked = sum(len(t) for t, in_link in held if in_link)
                out.append(Block(stack[-1], text, min(len(text), linked)))
            held = []

    def push(names: tuple[str, ...]) -> None:
        key = stack[-1], names
        node = kinds.get(key)
        if node is None:
            node = kinds[key] = Node(*key, tuple(n for n in dict.fromkeys(names) if not names_open.get(n)))
        stack.append(node)
        for n in names:
            names_open[n] = names_open.get(n, 0) + 1

    def pop() -> str:
        node = stack.pop()
        for n in node.names:
            names_open[n] -= 1
        return node.own

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            if not hidden:
                held.append((page[at:], links > 0))
            break
        if m.start() > at and not hidden:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        slash, tag, inner, loose = m.groups()
        if tag is None:
            if m.group() == "<!--":
                end = page.find("-->", at - 2)
                at = n if end < 0 else end + 3
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if slash else 1
            continue
        inner = loose if inner is None else inner
        if tag not in BLOCKS and tag not in RAW:
            if tag == "br":
                held.append((" ", False))
            elif tag == "svg":
                held.append((" ", False))
                if slash:
                    hidden = drawn.pop() if drawn else False
                elif not inner.rstrip().endswith("/"):
                    drawn.append(hidden)
                    hidden = True
            elif drawn and tag in DRAWN or tag in NOTES:
                if not inner.rstrip().endswith("/"):
                    held.append((" ", False))
                    hidden = (tag in NOTES) != bool(slash)
            elif tag == "math" and slash and not drawn:
                hidden = False
            continue
        if hidden and tag in BLOCKS:
            if drawn and tag == "title":
                continue
            # a block ends what is open of drawings and formulas
            drawn.clear()
            hidden = False
        if slash:
            if tag in RAW:
                continue
            flush()
            if names_open.get(tag):
                while pop() != tag:
                    pass
            links = 0
            continue
        if tag in RAW:
            if inner.rstrip().endswith("/"):
                continue
            end = _ENDING[tag].search(page, at)
            at = end.end() if end else n
            held.append((" ", False))
            continue
        flush()
        links = 0
        if stack[-1].own in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        while stack[-1].own in _ENDS.get(tag, ()):
            pop()
        if tag not in VOID and not inner.endswith("/"):
            push(_names(tag, inner))
    flush()
    return out


def _bucket(x: int) -> int:
    return min(9, x.bit_length())


def traits(b: Block, place: int, of: int) -> tuple:
    """What the text's features are made of; few values, so scores are looked up."""
    t = b.text
    words = t.count(" ") + 1
    first = place == 0 or place == of - 1
    return _bucket(words), int(4 * b.linked / len(t)), t[-1] in ".!?…\"”»:;", min(4, t.count(". ") + t.count(", ")), "©" in t or "(c)" in t[:60], first


def path_features(path: tuple[str, ...]) -> list[str]:
    last = [n for n in path if not n.startswith(".")][-1:] or ["none"]
    return [f"in {n}" for n in dict.fromkeys(path)] + [f"own {last[0]}", f"depth {min(8, len(path))}"]


def text_features(tr: tuple, own: str) -> list[str]:
    words, links, stop, joints, mark, edge = tr
    return [f"words {words}", f"links {links}", f"stop {stop}", f"joints {joints}", f"mark {mark}", f"edge {edge}", f"{own} words {words}", f"{own} links {links}", "bias"]


@dataclass
class Model:
    """Score of main less score of other for each feature; scores of label pairs, other elements and like elements apart."""

    weight: dict[str, float]
    pairs: np.ndarray  # [same path or not, label before, label]
    _texts: dict = field(default_factory=dict)

    def _inside(self, node: Node) -> float:
        """Weights of the names of the element and its ancestors, each name once."""
        way = []
        while node and node.inside is None:
            way.append(node)
            node = node.parent
        total = node.inside if node else 0.0
        for node in reversed(way):
            total += sum(self.weight.get(f"in {n}", 0.0) for n in node.new)
            node.inside = total
        return total

    def scores(self, found: list[Block]) -> list[float]:
        """What path_features and text_features of each block weigh."""
        out, get = [], self.weight.get
        for i, b in enumerate(found):
            key = (traits(b, i, len(found)), b.node.own)
            e = self._texts.get(key)
            if e is None:
                if len(self._texts) > 200_000:
                    self._texts.clear()
                e = self._texts[key] = sum(get(f, 0.0) for f in text_features(*key))
            out.append(self._inside(b.node) + get(f"own {b.node.own}", 0.0) + get(f"depth {min(8, b.node.size)}", 0.0) + e)
        return out

    def labels(self, found: list[Block]) -> list[int]:
        """The best labels; ties go to main."""
        if not found:
            return []
        pairs = self.pairs.tolist()
        scores, back = self.scores(found), []
        m, o = scores[0], 0.0
        for i in range(1, len(found)):
            (mm, mo), (om, oo) = pairs[found[i].node is found[i - 1].node]
            from_m, from_o = m + mm >= o + om, m + mo >= o + oo
            back.append((from_m, from_o))
            m, o = scores[i] + (m + mm if from_m else o + om), (m + mo if from_o else o + oo)
        label = MAIN if m >= o else OTHER
        out = [label]
        for pair in reversed(back):
            label = MAIN if pair[label] else OTHER
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n\n".join(b.text for b, k in zip(found, self.labels(found)) if k == MAIN)


def training_pages(n: int = 500, seed: int = 9) -> list[tuple[str, list[str]]]:
    """Made-up pages of many layouts with the texts of their main blocks, in order."""
    r = random.Random(seed)

    def words(a: int, b: int, stop: str = ".") -> str:
        ws = ["".join(r.choice("aeiouéèlnrstdmkpäñ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b))]
        text = " ".join(w + ("," if r.random() < 0.06 else "." if r.random() < 0.06 else "") for w in ws)
        return text[:1].upper() + text[1:] + stop

    def links(tag: str, k: int) -> str:
        return "".join(f"<{tag}><a href='/{i}'>{words(1, 3, '')}</a></{tag}>" for i in range(k))

    def el(tag: str, names: list[str], inner: str) -> str:
        name = r.choice([*names, ""]) if names else ""
        return f"<{tag}{f' {r.choice(("class", "id"))}="{name}"' if name else ''}>{inner}</{tag}>"

    def always(tag: str, names: list[str], inner: str) -> str:
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{inner}</{tag}>'

    def para() -> str:
        return words(1, 12) if r.random() < 0.2 else words(12, 160, r.choice([".", ".", "!", "", "…"]))

    def furniture() -> list[str]:
        return [
            f"<nav>{el('ul', ['menu'], links('li', r.randint(2, 8)))}</nav>",
            always("div", ["nav", "main-menu", "navbar", "site-nav", "topbar", "breadcrumbs", "toc"], links("span", r.randint(2, 6)) if r.random() < 0.5 else f"<ul>{links('li', r.randint(2, 6))}</ul>"),
            el("header", ["site-header", "masthead", "banner"], f"<h1>{words(1, 5, '')}</h1><p>{words(3, 9)}</p>" if r.random() < 0.4 else f"<p>{words(2, 9, '')}</p>"),
            always("div", ["header", "page-header", "site-title", "logo"], words(2, 8, "")),
            always("div", ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "adbox"], r.choice([words(3, 25), f"<p>{words(3, 30)}</p>", f"<a href='x'>{words(3, 9)}</a>"])),
            el("aside", ["sidebar", "related", "widget"], r.choice([f"<h3>{words(1, 3, '')}</h3><ul>{links('li', 4)}</ul>", f"<p>{words(5, 60)}</p>"])),
            always("div", ["sidebar", "side-bar", "right-col", "widget", "related-posts", "recommended", "popular"], r.choice([f"<h3>{words(1, 3, '')}</h3><ul>{links('li', 4)}</ul>", f"<p>{words(5, 60)}</p>", words(5, 40)])),
            always("div", ["cookie-notice", "notice", "gdpr-consent", "alert", "cookies", "popup", "modal", "paywall", "disclaimer"], r.choice([f"<p>{words(5, 40)}</p><button>{words(1, 2, '')}</button>", words(5, 40)])),
            f"<form action='/s'><label>{words(1, 4, '')}</label><input name=q><select><option>{words(1, 2, '')}<option>{words(1, 2, '')}</select><button>{words(1, 2, '')}</button>{f'<p>{words(3, 20)}</p>' if r.random() < 0.5 else ''}</form>",
            always("div", ["newsletter", "subscribe", "signup", "search-box", "login", "social", "share", "share-buttons", "tags", "meta", "pagination"], r.choice([words(2, 25), links("span", 4)])),
            always("section", ["comments", "comment-list", "reader-comments", "responses", "discussion"], "".join(always("div", ["comment", "comment-body", "reply"], f"<p>{words(4, 60)}</p>") for _ in range(r.randint(1, 4)))),
            always("div", ["comments", "disqus", "user-comments"], f"<h2>{words(1, 3, '')}</h2><ol>{''.join(f'<li>{words(4, 60)}</li>' for _ in range(r.randint(1, 4)))}</ol>"),
            f"<footer>{r.choice(['&copy; ' + words(2, 12), f'<p>&copy; {words(3, 20)}</p>', words(4, 20), links('span', 4)])}</footer>",
            always("div", ["footer", "site-footer", "copyright", "legal", "colophon"], r.choice(["&copy; " + words(2, 12), f"<p>{words(4, 30)}</p>"])),
            f"<script>var a = '<p>{words(3, 9)}</p>';</script>",
            f"<style>p {{ color: red }}</style><!-- {words(3, 9)} <p>x -->",
        ]

    def article() -> tuple[str, list[str]]:
        parts, texts = [], []
        if r.random() < 0.85:
            head = words(2, 12, "")
            parts.append(r.choice([f"<h1>{head}</h1>", f"<h1>{head}</h1>", f"<header><h1>{head}</h1></header>", f"<h2>{head}</h2>"]))
            texts.append(head)
        for _ in range(r.randint(1, 14)):
            kind, text = r.random(), para()
            if kind < 0.78:
                parts.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div><p>{text}</p></div>"]))
            elif kind < 0.84:
                text = words(1, 8, "")
                parts.append(f"<h{(k := r.choice('234'))}>{text}</h{k}>")
            elif kind < 0.88:
                items = [words(2, 25, r.choice(["", "."])) for _ in range(r.randint(1, 5))]
                parts.append(f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>")
                texts += items
                continue
            elif kind < 0.92:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<pre>{text}</pre>")
            else:
                parts.append(f"<table><tr><td>{text}</td></tr></table>")
            texts.append(text)
            if r.random() < 0.06:
                parts.append(r.choice(furniture()[4:11]))
        return "".join(parts), texts

    def page() -> tuple[str, list[str]]:
        body, texts = article()
        wrap = r.random()
        if wrap < 0.55:
            body = el("article", ["post", "entry", "story", "article"], body)
        elif wrap < 0.7:
            body = el("main", ["content", "main"], body)
        elif wrap < 0.95:
            body = always("div", ["content", "post-body", "entry-content", "article-body", "story", "main-content", "post", "text"], body)
        if r.random() < 0.3:
            body = el(r.choice(["main", "div", "section"]), ["wrapper", "container", "page", "main", "content"], body)
        before, after = (r.sample(furniture(), r.randint(0, 5)) for _ in range(2))
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{words(2, 8, '')}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", texts

    return [page() for _ in range(n)]


def _labelled(page: str, texts: list[str]) -> list[Block]:
    left, found = [" ".join(t.split()) for t in texts], blocks(page)
    for b in found:
        if left and b.text == left[0]:
            b.main = True
            left.pop(0)
    return found


def fit(pages: list[tuple[str, list[str]]] | None = None, steps: int = 120, l2: float = 2e-4) -> Model:
    """Weights by full-batch gradient ascent on the likelihood of the labels, all pages advancing together; runs in the driver, the pages are few."""
    data = [b for b in (_labelled(*p) for p in (training_pages() if pages is None else pages)) if b]
    seen: dict[str, int] = {}
    for found in data:  # a name of one page teaches nothing
        for f in {f for b in found for f in path_features(b.path)}:
            seen[f] = seen.get(f, 0) + 1
    names: dict[str, int] = {}
    longest, z = max(map(len, data)), len(data)
    live, gold, same = np.zeros((longest, z), bool), np.zeros((longest, z)), np.zeros((longest, z), int)
    col, row = [], []
    for k, found in enumerate(data):
        for i, b in enumerate(found):
            live[i, k], gold[i, k], same[i, k] = True, b.main, i > 0 and b.node is found[i - 1].node
            fs = [f for f in path_features(b.path) if seen[f] > 2] + text_features(traits(b, i, len(found)), b.node.own)
            ids = [names.setdefault(f, len(names)) for f in fs]
            col += ids
            row += [i * z + k] * len(ids)
    col, row = np.array(col), np.array(row)
    theta = np.zeros(len(names) + 8)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    steps_in = live[1:] & live[:-1]
    y = np.where(gold > 0, MAIN, OTHER)
    for t in range(1, steps + 1):
        s = np.bincount(row, theta[:-8][col], longest * z).reshape(longest, z)
        pairs = theta[-8:].reshape(2, 2, 2)
        node, edge = _marginals(s, pairs, same, live)
        g = np.append(np.bincount(col, ((gold - node) * live).reshape(-1)[row], len(names)), np.zeros(8))
        for c in range(2):
            at = steps_in & (same[1:] == c)
            for a in range(2):
                for b in range(2):
                    g[len(names) + 4 * c + 2 * a + b] = (at & (y[:-1] == a) & (y[1:] == b)).sum() - edge[a, b][at].sum()
        g = g / z - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, theta[-8:].reshape(2, 2, 2))


@cache
def fitted() -> Model:
    """The model of the made-up pages, fitted once in a process."""
    return fit()


def _marginals(s: np.ndarray, pairs: np.ndarray, same: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main for each block, and of each label pair for each neighbours; pages stand side by side."""
    n, z = s.shape
    e = np.stack([s, np.zeros_like(s)])
    alpha, beta = np.zeros((n, 2, z)), np.zeros((n, 2, z))
    alpha[0] = e[:, 0]
    for i in range(1, n):
        p = pairs[same[i]].transpose(1, 2, 0)
        new = e[:, i] + np.logaddexp(alpha[i - 1][0] + p[0], alpha[i - 1][1] + p[1])
        alpha[i] = np.where(live[i], new, alpha[i - 1])
    for i in range(n - 2, -1, -1):
        p = pairs[same[i + 1]].transpose(1, 2, 0)
        ahead = e[:, i + 1] + beta[i + 1]
        new = np.logaddexp(p[:, 0] + ahead[0], p[:, 1] + ahead[1])
        beta[i] = np.where(live[i + 1], new, beta[i + 1])
    total = np.logaddexp(alpha[-1][0], alpha[-1][1])
    node = np.exp(alpha[:, MAIN] + beta[:, MAIN] - total)
    p = pairs[same[1:]].transpose(2, 3, 0, 1)
    edge = np.exp(alpha[:-1].transpose(1, 0, 2)[:, None] + p + (e[:, 1:] + beta[1:].transpose(1, 0, 2))[None] - total)
    return node, edge


def extract(pages: DataFrame, model: Model, *, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """The columns in keep (default: all) and _vx_main, the main text."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    keep = pages.columns if keep is None else keep
    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.text(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "_vx_main"])

    return map_batches(pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias("_vx_html")), run, T.StructType([*kept.schema.fields, T.StructField("_vx_main", T.StringType())]))
