"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements and text runs; inline elements only colour their text. For each node the
forest gives the log probabilities of *in* (all of it main text), *out* (none) and *mixed*, from its tag,
attribute tokens (its own and its ancestors'), depth, the density of text, links and punctuation in its
subtree, its share of the page, and its place among its siblings. Decoding takes the most probable consistent choice:
below an *in* node all is in, below an *out* node all is out, and only below a *mixed* node do children decide.

The forest is trained on ``TRAIN_PAGES`` generated pages (see ``html_training``), with a fixed seed.

A null page or one without main text gives an empty text. Broken markup is read leniently: unclosed elements end
with their parents, a new block ends an open paragraph; unclosed comments, scripts and styles reach to the end. Of form controls, graphics and script
fallbacks nothing is taken; one that is not closed within its parent ends before the next block or at its parent's end, so no later text is lost with it.
Formulas and fallback text of media count as text.
Character references are decoded; white space in a block becomes one blank. Nothing is capped.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, train
from .common import ship
from .sentencepiece_codec import parts

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = frozenset("button select datalist svg noscript template".split())
INLINE = frozenset("math mi mn mo mrow mfrac msup msub msqrt mtext semantics object canvas audio video a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPE = frozenset("ul ol dl table article aside main section nav body html div blockquote".split())
TAGS = ("#text", "p", "h", "li", "ul", "div", "section", "article", "main", "nav", "footer", "header", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body")
SAME = {"ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "th": "td", "tr": "table", "tbody": "table", "thead": "table", "menu": "nav", "fieldset": "form", "figcaption": "figure", "html": "body"} | {f"h{k}": "h" for k in range(1, 7)}
WORDS = {
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager masthead topbar".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more teaser tags".split(),
    "notice": "cookie cookies consent notice notification alert gdpr popup modal overlay message".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comment": "comment comments commentlist discussion disqus replies reply respond reader responses feedback".split(),
    "foot": "footer foot copyright legal imprint colophon header head logo".split(),
    "share": "share sharing social byline meta author follow print".split(),
    "main": "content article post entry story main text body maincontent storybody prose".split(),
}
GROUP = {w: k for k, words in enumerate(WORDS.values()) for w in words}
BUCKETS = 8
MOST_UNCLOSED = 20
NODE = 12  # figures of a node that are filled while parsing
TRAIN_PAGES, ROUNDS, DEPTH = 400, 20, 5

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")


class Page:
    """Nodes of one page in document order: tags, parents, figures, and the text of text runs."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.text: list[str] = [""]
        self.links: list[int] = [0]
        self.unclosed = 0
        self._read(source)

    def _node(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", links: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.links.append(links)
        return len(self.tag) - 1

    def _skipped(self, source: str, at: int, name: str, around: set[str]) -> int:
        """Where an element without text of its own ends: at its end tag, or else before the first block or the end of its parent.

        After ``MOST_UNCLOSED`` unclosed ones in a page, further ones end before the first block without a look ahead.
        """
        block, inner = None, []
        look = self.unclosed < MOST_UNCLOSED
        for found in _TAG.finditer(source, at):
            if (tag := found[2]) is None:
                continue
            tag = tag.lower()
            if not found[1]:
                if block is None and (tag in ENDS_P or tag in SIBLINGS and tag != "option"):
                    block = found.start()
                    if not look:
                        return block
                if tag not in VOID:
                    inner.append(tag)
            elif tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
            elif tag == name:
                return found.end()
            elif tag in around:
                self.unclosed += 1
                return found.start() if block is None else block
        self.unclosed += 1
        return len(source) if block is None else block

    def _read(self, source: str) -> None:
        stack, run, link_run, links = [0], [], [], 0

        def flush() -> None:
            if run:
                if text := " ".join(html.unescape("".join(run)).split()):
                    self._node("#text", stack[-1], (), text, len(html.unescape("".join(link_run))))
                run.clear()
                link_run.clear()

        at, size, search = 0, len(source), _TAG.search
        while at < size:
            found = search(source, at)
            end = found.start() if found else size
            if end > at:
                run.append(source[at:end])
                if links:
                    link_run.append(source[at:end])
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name, closing = name.lower(), found[1]
            if name in RAW:
                if not closing:
                    close = _CLOSE[name].search(source, at)
                    at = close.end() if close else size if name in ("script", "style") else at
                continue
            if name in SKIPPED:
                if not closing and not found[3].endswith("/"):
                    at = self._skipped(source, at, name, {self.tag[k] for k in stack} | {"html", "body"})
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if closing else 1
                elif name == "br":
                    run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            flush()
            if name in ("html", "body"):
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if name in ("p", "li") and self.tag[stack[k]] in SCOPE:
                        break
                continue
            if name == "head":
                close = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(source, at)
                if close:
                    at = close.start()
                continue
            ends = ("p",) if name in ENDS_P else SIBLINGS.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in ends:
                    del stack[k:]
                    break
                if self.tag[stack[k]] in SCOPE:
                    break
            tokens = tuple(t.lower() for a in _ATTRIBUTE.findall(found[3]) for t in _TOKEN.findall(a)) if found[3] else ()
            stack.append(self._node(name, stack[-1], tokens))
        flush()


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, page) of all nodes of the pages; parents count from the first node of all."""
    starts = np.cumsum([0, *(len(p.tag) for p in pages)])
    total = int(starts[-1])
    page = np.repeat(np.arange(len(pages)), np.diff(starts))
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)])
    names = [SAME.get(t, t) for p in pages for t in p.tag]
    index = {t: k for k, t in enumerate(TAGS)}
    kind = np.array([index.get(t, index["div"]) for t in names])
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts], float)
    sums = np.zeros((total, 5))
    sums[:, 0], sums[:, 1] = chars, np.minimum(np.array([k for p in pages for k in p.links], float), chars)
    sums[:, 2] = [t.count(" ") + 1 if t else 0 for t in texts]
    sums[:, 3] = [t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in texts]
    sums[:, 4] = kind != 0
    own = np.zeros((total, len(WORDS) + BUCKETS))
    for i, tokens in enumerate(t for p in pages for t in p.tokens):
        for t in tokens:
            own[i, GROUP[t] if t in GROUP else len(WORDS) + sum(t.encode()) % BUCKETS] = 1.0
    above, depth = own[:, : len(WORDS)].copy(), np.zeros(total)
    tag_above = np.zeros((total, len(TAGS)))
    tag_above[np.arange(total), kind] = 1.0
    plist = parent.tolist()
    order = np.zeros(total)
    count = np.zeros(total)
    for i, p in enumerate(plist):
        if p >= 0:
            depth[i] = depth[p] + 1
            order[i] = count[p]
            count[p] += 1
    # Parents stand before their children: level by level downwards for what is inherited, upwards for sums.
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 1)))
    for at in levels[1:]:
        above[at] = np.maximum(above[at], above[parent[at]])
        tag_above[at] = np.maximum(tag_above[at], tag_above[parent[at]])
    for at in reversed(levels[1:]):
        np.add.at(sums, parent[at], sums[at])
    whole = np.maximum(sums[starts[:-1], 0], 1)[page]
    up = np.maximum(parent, 0)
    text, link = sums[:, 0], sums[:, 1] / np.maximum(sums[:, 0], 1)
    previous, following = np.full(total, -1.0), np.full(total, -1.0)
    last: dict[int, int] = {}
    for i, p in enumerate(plist):
        if p in last:
            previous[i], following[last[p]] = link[last[p]], link[i]
        last[p] = i
    figures = np.stack(
        [
            depth, np.log1p(text), link, sums[:, 2] / np.maximum(text, 1), sums[:, 3] / np.maximum(sums[:, 2], 1), np.log1p(sums[:, 4]), sums[:, 4] / np.maximum(sums[:, 2], 1), text / whole,
            count, order, order / np.maximum(count[up], 1), count[up], np.log1p(sums[up, 0] / np.maximum(count[up], 1)), link[up], sums[up, 0] / whole, previous, following,
        ],
        axis=1,
    )
    one = np.zeros((total, len(TAGS)))
    one[np.arange(total), kind] = 1.0
    return np.concatenate([figures, one, tag_above[:, 7:15], own, above], axis=1).astype(np.float32), parent, page


IN, OUT, MIXED = 0, 1, 2


def decode(logs: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The consistent choice of most probable classes: IN, OUT or MIXED for each node."""
    leaf = np.ones(len(parent), bool)
    leaf[parent[parent >= 0]] = False
    ins, outs, mix = (logs[:, k].tolist() for k in (IN, OUT, MIXED))
    leaves, up = leaf.tolist(), parent.tolist()
    choice = [0] * len(up)
    for i in range(len(up) - 1, -1, -1):
        a, b, c = ins[i], outs[i], float("-inf") if leaves[i] else mix[i]
        best = max(a, b, c)
        choice[i] = MIXED if c == best else OUT if b == best else IN
        if (p := up[i]) >= 0:
            ins[p] += a
            outs[p] += b
            mix[p] += best
    for i, p in enumerate(up):
        if p >= 0 and choice[p] != MIXED:
            choice[i] = choice[p]
    return np.array(choice)


@functools.lru_cache(maxsize=4)
def model(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 7) -> Forest:
    """The forest, trained once for each process of the driver."""
    from .html_training import labelled_pages

    made = [labelled_pages(seed * 1_000_003 + k) for k in range(pages)]
    read = [Page(source) for source, _ in made]
    x, parent, page = features(read)
    flat = [t for p in read for t in p.text]
    marks = [m for _, m in made]
    yes, no = np.zeros(len(parent), bool), np.zeros(len(parent), bool)
    for i in range(len(parent) - 1, -1, -1):
        if flat[i]:
            (yes if flat[i] in marks[page[i]] else no)[i] = True
        if parent[i] >= 0:
            yes[parent[i]] |= yes[i]
            no[parent[i]] |= no[i]
    y = np.where(yes & no, MIXED, np.where(yes, IN, OUT))
    return train(x.astype(float), y, 3, rounds, depth)


def extract_texts(sources: list[str | None], forest: Forest) -> list[str]:
    pages = [Page(s or "") for s in sources]
    x, parent, page = features(pages)
    choice = decode(forest.log_probabilities(x), parent)
    texts: list[list[str]] = [[] for _ in sources]
    flat = [t for p in pages for t in p.text]
    for i in np.flatnonzero(choice == IN):
        if flat[i]:
            texts[page[i]].append(flat[i])
    return ["\n\n".join(t) for t in texts]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), forest: Forest | None = None) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points)."""
    forest = forest or model()
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in parts(batch, len(keep), 1_500_000):
                texts = extract_texts(sources, forest)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    picked = pages.select(*keep, F.col(html_col))
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[: len(keep)]), "text string, n_chars long"]))
