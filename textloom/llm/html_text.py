"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page is read into blocks: runs of text between block-level tags, each with its
ancestors (tags, words of class, id and role).  Unclosed tags are closed as
browsers do; scripts, styles, comments and other things that show no text are left
out.  A block's features are its ancestors, and of its text the length, the share
inside links, closing punctuation, digits and signs; adjacent blocks are tied by
learned transitions.  Weights are fitted on labelled pages (:func:`labelled_pages`
makes a set from layouts with known main text, or give your own) and the label
sequence of a page is decoded by Viterbi.

In a kept block character references are decoded, white space becomes one space
and the ends are trimmed; blocks are joined in page order by a line feed.

Defined results: a null or empty page, or one without a main block, has the empty
text; plain text without tags is one block; pages are read whole; repeated rows
stay; an empty table gives an empty result; columns named as the operator's own are
replaced.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices
from .langid import marginals

BITS = 16
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = {"title", "script", "style", "template", "noscript", "svg", "iframe", "object", "math", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "xmp", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody"
    " td textarea tfoot th thead title tr ul".split()
)
#: An opening tag ends an open one of these, unless one of the bounds lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
BOUND = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "li", "blockquote", "figure"}


class Node:
    """An open element: its parent, and the features that no element around it has."""

    __slots__ = ("fresh", "inside", "parent")

    def __init__(self, parent: Node | None, fresh: tuple[str, ...], inside: bool):
        self.parent, self.fresh, self.inside = parent, fresh, inside

    def features(self) -> list[str]:
        """The features of the element and of all around it, each once."""
        out, at = [], self
        while at:
            out += at.fresh
            at = at.parent
        return out


@dataclass
class Block:
    path: Node | None  # the innermost element around it
    tag: str
    text: str
    linked: int


def _names(tag: str, attrs: str) -> list[str]:
    out = [f"a:{tag}"]
    if "=" in attrs:
        for _, *values in ATTRIBUTE.findall(attrs):
            for word in WORD.findall(next((v for v in values if v), "")):
                out.append(f"c:{word.lower()}")
    return out


class _Open:
    """The elements that are open, with the places of each kind, so that no tag makes a walk through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Node, list[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.held: dict[str, int] = {}
        self.blocks: list[str] = []
        self.hidden = 0

    def __len__(self) -> int:
        return len(self.stack)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these, or -1."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    @property
    def node(self) -> Node | None:
        return self.stack[-1][1] if self.stack else None

    def push(self, tag: str, attrs: str) -> None:
        names = _names(tag, attrs)
        fresh = tuple(dict.fromkeys(f for f in names if not self.held.get(f)))
        for f in names:
            self.held[f] = self.held.get(f, 0) + 1
        parent = self.node
        inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, Node(parent, fresh, inside), names))
        if tag in BLOCK:
            self.blocks.append(tag)
        self.hidden += tag in HIDDEN

    def pop(self) -> None:
        tag, _, names = self.stack.pop()
        self.places[tag].pop()
        for f in names:
            self.held[f] -= 1
        if tag in BLOCK:
            self.blocks.pop()
        self.hidden -= tag in HIDDEN


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; the time is in proportion to its length, however broken it is."""
    opened = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not opened.hidden:
                out.append(Block(opened.node, opened.blocks[-1] if opened.blocks else "", text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        if any(t in BLOCK or t in HIDDEN for t, _, _ in opened.stack[depth:]):
            flush()
        while len(opened) > depth:
            opened.pop()

    def show(text: str) -> None:
        nonlocal linked
        if not opened.hidden:
            text = html.unescape(text)
            parts.append(text)
            if opened.places.get("a"):
                linked += len(text.strip())

    at, end, last_close = 0, len(page), max(page.rfind(">"), page.rfind("<!"), page.rfind("<?"))
    while at < end:
        if at > last_close:  # nothing more can be a tag
            show(page[at:])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                show(token)
            continue
        tag = tag.lower()
        if m["close"]:
            depth = opened.last((tag,))
            if depth >= 0:
                close_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        attrs = m["attrs"]
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            # A paragraph ends where a block begins, and inline tags left open end with it.
            paragraph = opened.last(("p",))
            if paragraph > opened.last(BOUND):
                close_to(paragraph)
            ends, bounds = ENDS.get(tag, ((), ()))
            while (depth := opened.last(ends)) > opened.last(bounds):
                close_to(depth)
                if tag != "tr":
                    break
            flush()
        if tag in HIDDEN:
            flush()
        if tag in RAW:
            stop = _closing(tag).search(page, at)
            inner = page[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            opened.push(tag, attrs)
            if not opened.hidden:
                parts.append(html.unescape(inner))
            close_to(len(opened) - 1)
            continue
        if not attrs.endswith("/") or tag in BLOCK:
            opened.push(tag, attrs)
            if tag in HIDDEN and attrs.endswith("/"):
                close_to(len(opened) - 1)
    close_to(0)
    flush()
    return out


@lru_cache(maxsize=16)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def own_features(b: Block) -> list[str]:
    """The features of a block but for those of the elements around it."""
    n = len(b.text)
    link = b.linked / n
    size = 0 if n < 20 else 1 if n < 60 else 2 if n < 160 else 3
    inside = b.path is not None and b.path.inside
    linked = 0 if link == 0 else 1 if link < 0.5 else 2
    ends = b.text[-1] in ".!?…:;»”\"'"
    return [
        f"t:{b.tag}",
        f"size:{size}",
        f"link:{linked}",
        f"tag+size:{b.tag}:{size}",
        f"tag+link:{b.tag}:{linked}",
        f"end:{ends}",
        f"size+end:{size}:{ends}:{linked}",
        f"sign:{any(c in '©®™|›»·' for c in b.text)}",
        f"digits:{sum(c.isdigit() for c in b.text) * 5 > n}",
        f"inside:{inside}:{b.tag}",
    ]


def features(b: Block) -> list[str]:
    return [*(b.path.features() if b.path else ()), *own_features(b)]


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


@dataclass
class Model:
    """Weights for the labels 0 (other) and 1 (main text)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 2)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def main_blocks(self, blocks: list[Block]) -> list[Block]:
        """The blocks that the best label sequence marks as main text (Viterbi); ties go to main text."""
        if not blocks:
            return []
        margin = self.weights[:, 1] - self.weights[:, 0]
        known: dict[str, float] = {}
        around: dict[Node, float] = {}

        def of(name: str) -> float:
            if name not in known:
                known[name] = float(margin[hashed([name])[0]])
            return known[name]

        emit = []
        for b in blocks:
            # What the elements around it add is summed up once for each element.
            chain, at = [], b.path
            while at is not None and at not in around:
                chain.append(at)
                at = at.parent
            total = around[at] if at is not None else 0.0
            for node in reversed(chain):
                total += sum(map(of, node.fresh))
                around[node] = total
            emit.append(total + sum(map(of, own_features(b))))
        (t00, t01), (t10, t11) = self.transitions.tolist()
        off, on, back = 0.0, emit[0], []
        for e in emit[1:]:
            from_off = (off + t00, off + t01)
            from_on = (on + t10, on + t11)
            back.append((from_on[0] > from_off[0], from_on[1] >= from_off[1]))
            off, on = max(from_off[0], from_on[0]), max(from_off[1], from_on[1]) + e
        label, labels = on >= off, []
        labels.append(label)
        for b in reversed(back):
            label = b[1] if label else b[0]
            labels.append(label)
        return [b for b, y in zip(blocks, reversed(labels), strict=True) if y]


def fit(pages: list[tuple[str, set[str]]], epochs: int = 12) -> Model:
    """Fits on pages given with the texts of their main blocks."""
    model = Model()
    sequences = []
    for page, main in pages:
        blocks = blocks_of(page)
        if blocks:
            sequences.append(([hashed(features(b)) for b in blocks], [int(b.text in main) for b in blocks]))
    squares, t_squares = np.full_like(model.weights, 1e-2), np.full((2, 2), 1e-1)
    rng = random.Random(5)
    for _ in range(epochs):
        rng.shuffle(sequences)
        for at in range(0, len(sequences), 40):
            own = sequences[at : at + 40]
            rows = [f for fs, _ in own for f in fs]
            gold = np.array([y for _, ys in own for y in ys])
            lengths = np.array([len(ys) for _, ys in own])
            emit = np.array([model.weights[f].sum(axis=0) for f in rows])
            post, forward, backward, local = marginals(emit, lengths, model.transitions, np.zeros(2))
            wrong = -post
            wrong[np.arange(len(gold)), gold] += 1
            gradient = -2e-3 * model.weights
            for f, w in zip(rows, wrong, strict=True):
                gradient[f] += w
            squares += gradient**2
            model.weights += 0.2 * gradient / np.sqrt(squares)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths)[:-1]] = False
            inner[0] = False
            to = np.flatnonzero(inner)
            joint = forward[to - 1][:, :, None] * np.exp(model.transitions)[None] * (local[to] * backward[to])[:, None, :]
            expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[to - 1], gold[to]), 1)
            t_gradient = seen - expected - 0.05 * model.transitions
            t_squares += t_gradient**2
            model.transitions += 0.2 * t_gradient / np.sqrt(t_squares)
    return model


#: Words that mark parts of a page other than its main text, by kind.
MARKS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager",
    "header": "header masthead topbar branding logo",
    "footer": "footer foot copyright legal colophon bottom",
    "sidebar": "sidebar aside related widget rail trending popular recommended",
    "notice": "notice cookie cookies consent gdpr alert banner popup modal newsletter subscribe paywall",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion",
    "comments": "comments comment commentlist replies reply responses response discussion disqus respond thread feedback reactions",
    "form": "form search login signup contact",
    "share": "share sharing social follow tags meta byline",
}
#: Words that name the place of the main text, or say nothing.
PLACES = "content body article post entry story text page main wrap container row column inner layout primary"


def labelled_pages(count: int = 1000, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages of made-up words in varied layouts, with the texts of their main blocks."""
    rng = random.Random(seed)
    syllables = "ba de ki lo mu na pe ri so tu va ze lin mor tas ent ing ous".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "", "?", "!"])

    def mark(kind: str) -> str:
        names = MARKS[kind].split()
        name = rng.choice(names)
        if rng.random() < 0.4:
            name = f"{rng.choice(['site', 'page', 'main', 'block', 'x', 'top', 'box'])}-{name}"
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} c{rng.randint(1, 9)}"', f' class="{name}-box"'])

    def links() -> str:
        item = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"

    def bare(kind: str) -> str:
        """A part that neither tag nor names tell from the main text."""
        if kind == "menu":
            return f"<div>{links()}</div>" if rng.random() < 0.5 else "<div>" + " | ".join(f'<a href="/x">{words(1, 2)}</a>' for _ in range(rng.randint(3, 8))) + "</div>"
        if kind == "footer":
            return f"<div>{rng.choice(['&copy; ', '© '])}{rng.randint(1990, 2030)} {words(1, 4)}{rng.choice(['', ' | ' + words(1, 3)])}</div>"
        return f"<div><a href='/'>{words(1, 3)}</a></div>"

    def other(kind: str) -> str:
        if plain_page and kind in ("menu", "footer", "header"):
            return bare(kind)
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        plain = tag and rng.random() < 0.6
        tag = tag if tag and rng.random() < 0.7 else rng.choice(["div", "div", "section"])
        attrs = "" if plain and tag not in ("div", "section") else mark(kind)
        text = lambda: rng.choice([f"<p>{sentence()}</p>", sentence(), f"<div>{sentence(2, 40)}</div>", f"<span>{words(1, 5)}</span>"])
        inner = {
            "menu": links,
            "header": lambda: rng.choice([f"<h1>{words(1, 4)}</h1>", f"<a href='/'>{words(1, 3)}</a>", text()]) + rng.choice(["", links()]),
            "footer": lambda: rng.choice([f"&copy; {words(1, 4)} &middot; {sentence()}", links(), text(), f"<p>© {words(2, 6)}</p>"]),
            "sidebar": lambda: f"<h3>{words(1, 4)}</h3>" + rng.choice([links(), text() + text()]),
            "notice": lambda: text() + rng.choice(["", f"<button>{words(1, 2)}</button>"]),
            "advert": lambda: rng.choice([text(), f'<a href="#">{sentence()}</a>', text() + text()]),
            "comments": lambda: rng.choice([f"<h2>{words(1, 2)}</h2>", ""])
            + "".join(
                rng.choice([f"<div{mark('comments')}><b>{words(1, 2)}</b><p>{sentence(4, 60)}</p></div>", f"<li><p>{sentence(4, 60)}</p></li>", f"<p>{sentence(4, 40)}</p>"])
                for _ in range(rng.randint(1, 4))
            ),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{sentence()}</p>"]),
            "share": lambda: rng.choice([links(), text()]),
        }[kind]()
        return f"<{tag}{attrs}>{inner}</{tag}>"

    pages = []
    plain_page = False
    for _ in range(count):
        main: set[str] = set()
        plain_page = rng.random() < 0.25

        def keep(text: str, main: set[str] = main) -> str:
            main.add(" ".join(text.split()))
            return text

        body = []
        title = words(2, 9)
        if rng.random() < 0.8:
            heading = rng.choice(["h1", "h1", "h1", "h2"])
            body.append(f"<{heading}>{keep(title)}</{heading}>")
        for _ in range(rng.randint(1, 9)):
            text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 9])))
            if rng.random() < 0.1:  # a row of a table written as text
                text = " | ".join(words(1, 2) for _ in range(rng.randint(2, 12))) + rng.choice(["", " |", "."])
            keep(text)
            body.append(
                rng.choice(
                    [f"<p>{text}</p>"] * 6
                    + [f"<p><b>{text}<br>", f"<p>{text}", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li></ul>", f"<div>{text}</div>"]
                    + [f"<pre>{text}</pre>", f"<h2>{text}</h2>", f"<table><tr><td>{text}</td></tr></table>", f"<section><h3>{text}</h3></section>"]
                )
            )
            if rng.random() < 0.25:
                body.append(other(rng.choice(["advert", "advert", "sidebar", "share", "notice", "form"])))
        if rng.random() < 0.25:
            body.append(other("comments"))
        name = lambda: rng.choice([rng.choice(PLACES.split()), f"{rng.choice(PLACES.split())}-{rng.choice(PLACES.split())}"])
        # The main text's own element may bear a name that elsewhere marks another part.
        odd = lambda: f"{rng.choice([rng.choice(v.split()) for v in MARKS.values()])}-{rng.choice(['layout', 'page', 'column', 'wide'])}"
        wrap = rng.choice(
            ["article"] * 6
            + [f'article class="{name()}"', "main", "main", f'main id="{name()}"', 'div role="main"', 'div role="main"', f'main class="{odd()}"', f'div class="{odd()}"']
            + [f'div class="{name()}"', f'div id="{name()}"', f'section class="{name()}"', f'div id="{name()}" class="{name()}"', "section"]
        )
        if plain_page:
            wrap = rng.choice(["div", "div", "section", "td", "center"])
        inner = f"<{wrap}>{''.join(body)}</{wrap.split()[0]}>"
        if wrap == "td":
            inner = f"<table><tr>{inner}</tr></table>"
        if rng.random() < 0.3:
            outer = rng.choice(["main", "main", "div"])
            inner = f"<{outer}><div class='{rng.choice(['wrap', 'container', 'row', 'page', odd()])}'>{inner}</div></{outer}>"
        before = [other(k) for k in ("menu", "header", "notice", "advert", "share", "form") if rng.random() < 0.4]
        after = [other(k) for k in ("sidebar", "comments", "advert", "notice", "menu", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        head = f"<head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{inner}{''.join(after)}</body></html>", main))
    return pages


def extract(pages: DataFrame, model: Model, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in place of the page."""
    rest = [f for f in pages.schema.fields if f.name.lower() not in (out.lower(), html_col.lower())]
    schema = T.StructType([*rest, T.StructField(out, T.StringType(), False)])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, len(names)):
                texts = ["\n".join(b.text for b in model.main_blocks(blocks_of(x))) if x else "" for x in batch.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, out])

    return pages.select(*names, html_col).mapInArrow(run, schema)
