"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes its blocks in order, each with the tags and class names above it and its text. The
field weighs features of a block (own tag, tags and names above it, length, links, marks, place, and on pages that
nowhere say where their text is, links and length of the blocks around it as well) and
of neighbouring labels; it is trained in numpy on generated pages whose main text is known, and the
best labelling is found by Viterbi. Blocks labelled main are the text: character references decoded,
white space made single spaces, joined by an empty line. Null and empty pages, and pages without any
main block, give the empty text; unclosed and stray tags are taken as browsers do for block structure;
repeated rows are handled each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .html_pages import AWAY, MAIN, page

#: Tags by their part in a page; fixed values of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math head textarea select datalist".split())
FOREIGN = frozenset(("svg", "math"))
#: Open tags that a new tag of the second kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P = BLOCKS - {"button", "option", "select", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "title", "legend"}
PARTS = frozenset("nav header footer aside form article main body".split())  # a section says nothing by itself
#: Further tags that features ask for.
TOLD = PARTS | frozenset("title li button label".split())
NAMES = {w: kind for kind, words in {**AWAY, "main": MAIN}.items() for w in words}
SPLIT = re.compile(r"[^a-z0-9]+")
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
#: Of generated pages and passes over them.
PAGES, PASSES, SEED = 900, 150, 11


class Above(NamedTuple):
    """What an open tag and those above it tell of a block: the tag, told tags and kinds of names, the nearest block's tag and the innermost part."""

    tag: str
    told: frozenset[str]
    names: frozenset[str]
    own: str
    inner: str


ROOT = Above("", frozenset(), frozenset(), "", "none")
#: Above, text and characters in links of a block.
Block = tuple[Above, str, int]


class Blocks(HTMLParser):
    """Collects the blocks of a page. Each open tag holds what is known of all above it, and open tags are counted by kind,
    so that neither deep nor unclosed tags are gone through again and again."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Above] = []
        self.count: Counter[str] = Counter()
        self.unseen = 0
        self.found: list[Block] = []
        self.text: list[str] = []
        self.in_links = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.found.append((self.open[-1] if self.open else ROOT, text, self.in_links))
            self.text, self.in_links = [], 0

    def _close(self, i: int) -> None:
        for above in self.open[i:]:
            self.unseen -= above.tag in UNSEEN
            self.count[above.tag] -= 1
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            if tag == "body" and self.unseen:  # an unclosed head
                self._close(next(i for i, above in enumerate(self.open) if above.tag in UNSEEN))
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in NO_P else set())
            stop = {"ul", "ol", "dl", "table", "select"}
            for i in range(len(self.open) - 1, -1, -1) if any(self.count[t] for t in shut) else ():
                if self.open[i].tag in shut:
                    self._close(i)
                    break
                if self.open[i].tag in stop or self.open[i].tag in ("div", "article", "section", "body", "td"):
                    break
        names = frozenset(NAMES[w] for k, v in attrs if k in ("class", "id", "role") and v for w in {v.lower(), *v.lower().split(), *SPLIT.split(v.lower())} if w in NAMES)
        above = self.open[-1] if self.open else ROOT
        told = above.told | {tag} if tag in TOLD and tag not in above.told else above.told
        inner = tag if tag in PARTS and tag != "body" else above.inner
        self.open.append(Above(tag, told, above.names | names if names - above.names else above.names, tag if tag in BLOCKS else above.own, inner))
        self.count[tag] += 1
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash closes only drawings and formulas and what is inside them
        if tag not in FOREIGN and not any(self.count[t] for t in FOREIGN):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self._close(i)
                break
            if tag not in BLOCKS and self.open[i].tag in BLOCKS:
                break  # an inline end tag does not reach out of its block

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            self.in_links += bool(self.count["a"]) * len(data.strip())


def blocks_of(html: str) -> list[Block]:
    parser = Blocks()
    # a tag that the page doesn't finish is no text; parsers look for its end from each of its starts
    end = html.rfind(">") + 1
    tail = UNFINISHED.search(html, end)
    parser.feed(html[: tail.start()] if tail else html)
    parser.close()
    parser.flush()
    return parser.found


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block."""
    out = []
    shares = [linked / len(text) for _, text, linked in blocks]
    long = [len(text) >= 80 and share < 0.4 for (_, text, _), share in zip(blocks, shares, strict=True)]
    is_main = [bool(above.told & {"article", "main"} or "main" in above.names) for above, _, _ in blocks]
    anywhere = any(is_main)
    for i, (above, text, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        f = ["bias", f"own={above.own}", f"words={min(words.bit_length(), 6)}", f"links={round(4 * min(1, linked / len(text)))}"]
        parts, names = above.told & PARTS, above.names
        f += [f"above={t}" for t in parts] + [f"name={n}" for n in names]
        # the innermost part decides: an aside in an article, an article in a form's page
        away = bool(names - {"main"} or parts & {"nav", "header", "footer", "aside", "form"})
        f += [f"inner={above.inner}", "away" if away else "not away"]
        f += ["ends" if text[-1] in ".!?" else "open end", "first" if i == 0 else "later"]
        f += [k for k, on in (("copyright", "©" in text), ("title", "title" in above.told), ("list", "li" in above.told), ("button", above.told & {"button", "label"})) if on]
        if anywhere:
            f += ["main above" if is_main[i] else "no main above"]
        else:  # the page says nowhere where its text is: what a block is like, and its neighbours
            f += ["bare", f"bare {'away' if away else 'free'} own={above.own}", f"bare links={round(4 * min(1, shares[i]))} {'away' if away else 'free'}", f"bare words={min(words.bit_length(), 6)}"]
            f += [f"bare long={long[i]} around={int(any(long[max(0, i - 2) : i])) + int(any(long[i + 1 : i + 3]))}", f"bare linked around={round(2 * sum(shares[max(0, i - 1) : i + 2]) / len(shares[max(0, i - 1) : i + 2]))}"]
        out.append(f)
    return out


class ChainField:
    """Two labels; weights of features by label and of pairs of neighbouring labels."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.index, self.weight, self.pair = index, weight, pair

    @classmethod
    def fit(cls, pages: list[list[list[str]]], labels: list[list[int]], passes: int = PASSES, rate: float = 0.1, l2: float = 1e-4) -> ChainField:
        """Likelihood by forward and backward sums over all pages side by side, ascended by Adam."""
        count = Counter(f for p in pages for b in p for f in b)
        index = {f: i for i, f in enumerate(sorted(count))}
        n, length = len(pages), max(map(len, pages))
        there = np.array([[t < len(p) for t in range(length)] for p in pages])
        y = np.array([[*l, *[0] * (length - len(l))] for l in labels])
        rows, cols = np.array([(i * length + t, index[f]) for i, p in enumerate(pages) for t, b in enumerate(p) for f in b]).T
        weight, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
        moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(pair), np.zeros_like(pair)]
        gold = np.zeros((n, length, 2))
        gold[np.arange(n)[:, None], np.arange(length), y] = 1
        gold *= there[..., None]
        both = there[:, 1:] & there[:, :-1]
        gold_pair = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        for step in range(1, passes + 1):
            local = np.column_stack([np.bincount(rows, weight[cols, k], n * length) for k in (0, 1)]).reshape(n, length, 2)
            fore, back = np.zeros_like(local), np.zeros_like(local)
            fore[:, 0] = local[:, 0]
            for t in range(1, length):
                step_in = np.logaddexp.reduce(fore[:, t - 1, :, None] + pair, axis=1) + local[:, t]
                fore[:, t] = np.where(there[:, t, None], step_in, fore[:, t - 1])
            for t in range(length - 2, -1, -1):
                step_out = np.logaddexp.reduce(pair + (local[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
                back[:, t] = np.where(there[:, t + 1, None], step_out, 0)
            whole = np.logaddexp.reduce(fore[:, -1], axis=1)
            single = np.exp(fore + back - whole[:, None, None]) * there[..., None]
            joint = np.exp(fore[:, :-1, :, None] + pair + (local + back)[:, 1:, None, :] - whole[:, None, None, None]) * both[..., None, None]
            off = (gold - single).reshape(-1, 2)
            gw = np.column_stack([np.bincount(cols, off[rows, k], len(index)) for k in (0, 1)]) / n - l2 * weight
            gp = (gold_pair - joint.sum((0, 1))) / n - l2 * pair
            for param, g, m, v in ((weight, gw, *moments[:2]), (pair, gp, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(index, weight, pair)

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best labelling, by Viterbi."""
        if not page:
            return []
        gain = (self.weight[:, 1] - self.weight[:, 0]).tolist()
        local = [sum(gain[self.index[f]] for f in b if f in self.index) for b in page]
        (p00, p01), (p10, p11) = self.pair.tolist()
        zero, one, steps = 0.0, local[0], []
        for x in local[1:]:
            from_one0, from_one1 = one + p10 > zero + p00, one + p11 > zero + p01
            steps.append((from_one0, from_one1))
            zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + x
        out = [int(one > zero)]
        for s in reversed(steps):
            out.append(int(s[out[-1]]))
        return out[::-1]


def labelled(seed: int) -> tuple[list, list[int]]:
    """Blocks of a generated page and whether each is main text."""
    blocks, labels = [], []
    for above, text, linked in blocks_of(page(seed)):
        labels.append(int("\x01" in text))
        blocks.append((above, text.replace("\x01", "").replace("\x02", "") or "-", linked))
    return blocks, labels


@cache
def trained(pages: int = PAGES) -> ChainField:
    """The field from generated pages; the same on every call."""
    made = [labelled(SEED + i) for i in range(pages)]
    return ChainField.fit([features_of(b) for b, _ in made], [l for _, l in made])


def main_text(html: str, field: ChainField) -> str:
    blocks = blocks_of(html)
    return "\n\n".join(b[1] for b, main in zip(blocks, field.decode(features_of(blocks)), strict=True) if main)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ready(pages.sparkSession)
    field = field or trained()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, field) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(go, "page_id long, url string, text string, n_chars long")
