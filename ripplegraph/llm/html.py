"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier scores each block from its place in the document and its
shape; the log-odds are the capacities of its edges to the two terminals, content and boilerplate. Blocks that follow
each other, and blocks that follow each other within one element, are joined by smoothness edges, weaker the further
apart they are in the tree. The minimum cut, found as a maximum flow, is the labelling with the least sum of
classifier costs and separated neighbours. The blocks on the content side, in page order, are the main text.

The classifier is a logistic regression learned from made-up pages by a seeded generator.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

SEED, EPS = 5, 1e-9
ADJACENT, SIBLING = 0.5, 0.5  #: capacities of smoothness edges between blocks side by side in the tree

# Elements by their role, and words of class or id attributes by what they say.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select button datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {  # an opening tag ends these open elements
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",),
}
ROLES = ("nav", "header", "footer", "aside", "form", "advert", "notice", "comment", "article", "main", "content", "hidden")
ROLE_OF_TAG = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "main", "dialog": "notice"}
ROLE_OF_WORD = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "header": "header masthead banner logo",
    "footer": "footer foot copyright colophon legal",
    "aside": "aside sidebar side widget widgets related recommended recommendations trending popular share social rail",
    "form": "form login signup subscribe newsletter search",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay paywall disclaimer toast",
    "comment": "comment comments disqus replies reply respond discussion reader readers",
    "article": "article post entry story hentry",
    "main": "main",
    "content": "content body text copy prose",
    "hidden": "hidden invisible",
}
_BIT = {r: 1 << i for i, r in enumerate(ROLES)}
_WORDS = {w: _BIT[r] for r, words in ROLE_OF_WORD.items() for w in words.split()}

# An unquoted < ends a tag that was not closed, so no search runs over the same text again and again.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|[!?][^<>]*+>|/[^<>]*+>)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*+>", re.I) for t in SKIPPED}


class Element:
    """An open or closed element: its tag, the roles of it and of those above, its parent and how deep it is."""

    __slots__ = ("depth", "mask", "parent", "tag")

    def __init__(self, tag: str, mask: int, parent: Element | None):
        self.tag, self.mask, self.parent, self.depth = tag, mask, parent, parent.depth + 1 if parent else 1


class Block:
    __slots__ = ("element", "links", "text")

    def __init__(self, text: str, element: Element, links: float):
        self.text, self.element, self.links = text, element, links


def _role(tag: str, attributes: str) -> int:
    mask = _BIT[ROLE_OF_TAG[tag]] if tag in ROLE_OF_TAG else 0
    if attributes and tag not in ("body", "html"):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for w in re.split(r"[^a-z]+", value):
                    mask |= _WORDS.get(w, 0)
            elif name == "role":
                mask |= {"navigation": _BIT["nav"], "banner": _BIT["header"], "contentinfo": _BIT["footer"], "complementary": _BIT["aside"], "search": _BIT["form"], "main": _BIT["main"], "article": _BIT["article"], "alert": _BIT["notice"], "dialog": _BIT["notice"]}.get(value, 0)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                mask |= _BIT["hidden"]
    return mask


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed and misplaced tags are taken as browsers mostly take them; whatever is no tag is text."""
    out: list[Block] = []
    stack = [Element("", 0, None)]
    opened: Counter[str] = Counter()  # how many elements of a tag are open
    held: list[str] = []
    links, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack[-1], min(1.0, links / len(text))))
            held.clear()
            links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            held.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                links += len(held[-1])

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1] and tag in SKIPPED and not m[3].endswith("/"):
            if tag == "head":
                continue  # its own elements are skipped one by one
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCKS:
                flush()
            continue
        if tag == "a":
            in_link = not m[1]
        elif tag == "br":
            say(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            if m[1]:
                while opened[tag] and close() != tag:
                    pass
            elif tag not in VOID:
                if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                    close()
                for _ in range(2):
                    if stack[-1].tag in CLOSES.get(tag, ()):
                        close()
                stack.append(Element(tag, stack[-1].mask | _role(tag, m[3]), stack[-1]))
                opened[tag] += 1
    say(page[at:])
    flush()
    return out


def features(b: Block) -> tuple:
    """What the classifier sees of a block: roles, element, and coarse measures of its text."""
    words = b.text.count(" ") + 1
    e = b.element
    return e.mask, e.tag if e.tag in ("p", "li", "td", "h1", "h2", "h3") else "other", min(int(words).bit_length(), 7), round(3 * b.links), b.text[-1] in ".!?…\"”»", e.depth > 6


def _vector(f: tuple) -> np.ndarray:
    mask, tag, size, links, stops, deep = f
    v = np.zeros(len(ROLES) + 6 + 8 + 4 + 3, np.float64)
    for i in range(len(ROLES)):
        v[i] = mask >> i & 1
    v[len(ROLES) + ("p", "li", "td", "h1", "h2", "h3").index(tag) if tag != "other" else -1] = 1
    v[len(ROLES) + 6 + size] = 1
    v[len(ROLES) + 14 + links] = 1
    v[len(ROLES) + 18] = stops
    v[len(ROLES) + 19] = deep
    return v


def made_up(rng: random.Random) -> str:
    """A page whose content words all hold the letter þ, which nothing else does."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
    plain = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "", "!"])
    good = lambda n: " ".join("þ" + word() for _ in range(n)) + rng.choice([".", ".", "", "?"])
    link = lambda s: f'<a href="/{word()}">{s}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link(plain(rng.randint(1, 3)))}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"

    def named(role: str, inner: str, tags: tuple = ("div", "section")) -> str:
        own = [t for t, r in ROLE_OF_TAG.items() if r == role]
        w = rng.choice(ROLE_OF_WORD[role].split())
        tag, attr = (rng.choice(own), "") if own and rng.random() < 0.6 else (rng.choice(tags), f' {rng.choice(["class", "id"])}="{rng.choice([w, w + "-" + word(), word() + " " + w])}"')
        return f"<{tag}{attr}>{inner}</{tag}>"

    def bad() -> str:
        role = rng.choice(["nav", "header", "footer", "aside", "form", "advert", "notice", "comment"])
        inner = {"nav": menu, "header": lambda: f"<h1>{plain(3)}</h1>" + (menu() if rng.random() < 0.5 else ""), "footer": lambda: f"&copy; {plain(rng.randint(3, 12))}", "comment": lambda: "".join(f"<p>{plain(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 4)))}.get(role, lambda: rng.choice([plain(rng.randint(2, 40)), f"<p>{plain(rng.randint(2, 40))}</p>", menu(), f"<h3>{plain(2)}</h3>{menu()}"]))()
        return named(role, inner) if rng.random() < 0.93 else f"<div>{menu()}</div>"

    parts = [f"<h1>{good(rng.randint(2, 12))}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        parts.append(f"<p>{good(rng.randint(1, 90))}</p>" if kind < 0.75 else f"<h2>{good(rng.randint(1, 8))}</h2>" if kind < 0.85 else "<ul>" + "".join(f"<li>{good(rng.randint(2, 20))}</li>" for _ in range(3)) + "</ul>" if kind < 0.93 else f"<p>{good(5)} {link(good(2))} {good(4)}</p>")
        if rng.random() < 0.12:
            parts.append(bad())
    body = "".join(parts)
    body = rng.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", named("article", body), named("content", body), f"<div>{body}</div>", body, f"<div>{good(rng.randint(3, 90))}</div>", good(rng.randint(3, 90)), good(5) + "<br>" + good(30), f"<table><tr><td>{body}</td></tr></table>", f"<div><div><div><div><article>{body}</article></div></div></div></div>"])
    return "<html><body>" + "".join(bad() for _ in range(rng.randint(0, 4))) + body + "".join(bad() for _ in range(rng.randint(0, 4))) + "</body></html>"


@cache
def trained(seed: int = SEED, pages: int = 500, rounds: int = 1200) -> np.ndarray:
    """Weights of the logistic regression, the last one for the constant."""
    rng = random.Random(seed)
    found = [b for _ in range(pages) for b in blocks(made_up(rng))]
    x = np.array([np.append(_vector(features(b)), 1.0) for b in found])
    y = np.array(["þ" in b.text for b in found], np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return w


class MinimumCut:
    """Maximum flow between blocks with a surplus towards the source and blocks with one towards the sink."""

    def __init__(self, surplus: list[float]):
        self.surplus = surplus
        self.edges: list[list[int]] = [[] for _ in surplus]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, i: int, j: int, capacity: float) -> None:
        """An undirected edge: its two directions are each other's reverse."""
        for a, b in ((i, j), (j, i)):
            self.edges[a].append(len(self.to))
            self.to.append(b)
            self.room.append(capacity)

    def _levels(self, rest: list[float]) -> tuple[list[int], bool]:
        """Steps from the nearest node with a surplus (-1: out of reach), and whether any deficit is in reach."""
        level = [0 if r > EPS else -1 for r in rest]
        queue, met = deque(i for i, x in enumerate(level) if x == 0), False
        while queue:
            i = queue.popleft()
            met = met or rest[i] < -EPS
            for e in self.edges[i]:
                j = self.to[e]
                if level[j] < 0 and self.room[e] > EPS:
                    level[j] = level[i] + 1
                    queue.append(j)
        return level, met

    def source_side(self) -> list[bool]:
        """Blocking flows along shortest paths from surplus to deficit; what surplus reaches at the end is the source side."""
        rest = self.surplus[:]
        while True:
            level, met = self._levels(rest)
            if not met:
                return [x >= 0 for x in level]
            following = [0] * len(rest)
            for start in [i for i, r in enumerate(rest) if r > EPS]:
                path: list[int] = []
                i = start
                while rest[start] > EPS:
                    if rest[i] < -EPS:
                        flow = min(rest[start], -rest[i], *(self.room[e] for e in path))
                        rest[start] -= flow
                        rest[i] += flow
                        for e in path:
                            self.room[e] -= flow
                            self.room[e ^ 1] += flow
                        path, i = [], start
                        continue
                    own = self.edges[i]
                    while following[i] < len(own):
                        e = own[following[i]]
                        if self.room[e] > EPS and level[self.to[e]] == level[i] + 1:
                            break
                        following[i] += 1
                    if following[i] < len(own):
                        path.append(e)
                        i = self.to[e]
                    elif path:
                        i = self.to[path.pop() ^ 1]
                        following[i] += 1
                    else:
                        break


def _apart(a: Element, b: Element) -> int:
    """Elements between two elements in the tree. Of neighbouring blocks these were opened or closed between them, so all
    distances of a page take time in proportion to its tags."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Extractor:
    def __init__(self, weights: np.ndarray, adjacent: float = ADJACENT, sibling: float = SIBLING):
        self.weights, self.adjacent, self.sibling = weights, adjacent, sibling
        self.known: dict[tuple, float] = {}

    def odds(self, b: Block) -> float:
        f = features(b)
        got = self.known.get(f)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[f] = float(np.append(_vector(f), 1.0) @ self.weights)
        return got

    def labels(self, found: list[Block]) -> list[bool]:
        cut = MinimumCut([self.odds(b) for b in found])
        last: dict[Element, int] = {}  # of each element, the last block in one of its children or itself
        for i, b in enumerate(found):
            if i:
                cut.join(i - 1, i, self.adjacent / (1 + 0.5 * _apart(found[i - 1].element, b.element)))
            element = b.element.parent or b.element
            if element in last:
                cut.join(last[element], i, self.sibling)
            last[element] = i
        return cut.source_side()

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, keep in zip(found, self.labels(found)) if keep)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of each as a column; empty for a null page or one without content."""
    weights = trained()

    @F.arrow_udf("string")
    def run(source: pa.Array) -> pa.Array:
        e = Extractor(weights)
        return pa.array([e.text(s.as_py() or "") for s in source], pa.string())

    return pages.withColumn(out_col, run(text_or_empty(html_col)))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
