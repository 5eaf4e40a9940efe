"""Main-content extraction by a linear-chain conditional random field.

A page's leaf blocks (stretches of text that no block-level tag interrupts) form
a chain; each is content or boilerplate. A block's features are its ancestors'
tags and class names and what its text looks like: length, share of links,
punctuation, case. Weights and transitions are trained by maximum likelihood on
labelled pages made here in many layouts; Viterbi decoding picks the labels.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import col, fresh, map_arrow, only

#: Attributes up to a tag's end: a quoted value may hold any sign, "<" within its
#: first thousand; a quote that nothing closes is a sign like any other.
_ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"(?:[^"<]*+"|[^"]{0,1000}+")|'(?:[^'<]*+'|[^']{0,1000}+'))?+)*+"""
_TOKEN = re.compile(rf"<!--|<(/?)([a-z][\w:-]*)({_ATTRIBUTES})>?|<[!?][^<>]*>?", re.I)
#: What is no text up to the closing tag. Scripts and styles that nothing closes
#: go on to the page's end, of the others the opening tag alone is skipped.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg textarea".split()} | {"!--": re.compile("-->")}
_TO_THE_END = frozenset(["script", "style", "!--"])
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if it is open inside the nearest of the second set.
_IMPLIED = {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
}
_P = (frozenset(["p"]), frozenset("div td th li article section main body blockquote aside nav header footer".split()))
#: Text features come first, then hashed features of ancestors.
TEXT_FEATURES, PATH_FEATURES = 64, 4096


def _hashed(kind: str, name: str) -> int:
    return TEXT_FEATURES + zlib.crc32(f"{kind}:{name}".encode()) % PATH_FEATURES


class Paths:
    """Interned chains of ancestors with their features, at any depth. A feature
    counts once in a chain, so that levels of wrappers don't add up."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights, self.known = weights, {}
        self.features: list[frozenset[int]] = [frozenset()]
        self.scores: list[float] = [0.0]

    def enter(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes if "=" in attributes else "")
        found = self.known.get(key)
        if found is None:
            own = {_hashed("tag", tag)}
            if key[2]:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
                own.update(_hashed("name", w) for w in _WORD.findall(names))
            before = self.features[parent]
            new = sorted(own - before)
            found = self.known[key] = len(self.scores)
            self.features.append(before.union(new) if new else before)
            self.scores.append(self.scores[parent] + (sum(float(self.weights[x]) for x in new) if self.weights is not None else 0.0))
        return found


def blocks(page: str, paths: Paths) -> list[tuple[str, int, float]]:
    """(text, path, share of linked characters) of each leaf block."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    linked = links = 0

    def leaf() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, stack[-1][1], min(1.0, linked / len(text))))
            linked = 0

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = stack[at][0]
            if tag in names:
                del stack[at:]
                return
            if tag in until:
                return

    ahead: dict[str, int] = {}

    def closed(tag: str, at: int) -> int:
        """Where the next closing tag ends, or -1; every stretch is searched once."""
        found = ahead.get(tag, 0)
        if 0 <= found <= at:
            m = _RAW[tag].search(page, at)
            found = ahead[tag] = m.end() if m else -1
        return found

    end = 0
    while m := _TOKEN.search(page, end):
        if m.start() > end:
            pieces.append(page[end : m.start()])
            if links:
                linked += m.start() - end
        end = m.end()
        name = m[2]
        if not name:
            if m[0] == "<!--":
                after = closed("!--", end)
                end = after if after >= 0 else len(page)
            continue
        tag = name.lower()
        if tag in _RAW:
            if not m[1] and (tag in _TO_THE_END or not m[3].endswith("/")):
                after = closed(tag, end)
                end = after if after >= 0 else len(page) if tag in _TO_THE_END else end
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        leaf()
        links = 0
        if m[1]:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    del stack[at:]
                    break
        elif tag not in _VOID:
            close(*_IMPLIED.get(tag, _P))
            stack.append((tag, paths.enter(stack[-1][1], tag, m[3])))
    pieces.append(page[end:])
    leaf()
    return out


def text_features(text: str, link_share: float, first: bool) -> list[int]:
    n = len(text)
    words = text.count(" ") + 1
    marks = text.count(",") + text.count(".") + text.count(";")
    return [
        0,
        1 + min(12, n.bit_length()),
        14 + min(9, words.bit_length()),
        24 + (0 if link_share == 0 else 1 if link_share < 0.3 else 2 if link_share < 0.8 else 3),
        28 + (text[-1] in ".!?…:\"”"),
        30 + min(4, marks * 10 // words),
        35 + ("©" in text or "|" in text or "»" in text),
        37 + (text.isupper()),
        39 + min(3, n // words // 3),
        43 + first,
        45 + (text[0].isdigit()),
    ]


class Model:
    """``weights`` of features for content (against boilerplate), ``moves``
    [from, to] of transitions, ``start``."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: float) -> None:
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, scores: list[float]) -> list[bool]:
        """The likeliest labels (Viterbi); equal ones go to boilerplate."""
        (a, b), (c, d) = self.moves.tolist()
        bad, good, back = 0.0, self.start, []
        for k, s in enumerate(scores):
            if k:
                from_good = (good + c > bad + a, good + d > bad + b)
                back.append(from_good)
                bad, good = max(bad + a, good + c), max(bad + b, good + d) + s
            else:
                good += s
        out = [good > bad]
        for from_good in reversed(back):
            out.append(from_good[1] if out[-1] else from_good[0])
        return out[::-1] if scores else []


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """From pages as lists of feature lists and labels; Adam on the whole set."""
    n, longest = len(pages), max(len(y) for _, y in pages)
    row = np.concatenate([np.full(len(f), p * longest + t) for p, (page, _) in enumerate(pages) for t, f in enumerate(page)])
    feature = np.concatenate([f for page, _ in pages for f in page])
    size = TEXT_FEATURES + PATH_FEATURES
    y = np.zeros((n, longest))
    live = np.zeros((n, longest), bool)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)], live[p, : len(labels)] = labels, True
    both = live[:, 1:]
    real = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    x, m, v = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    for step in range(1, rounds + 1):
        emission = np.bincount(row, x[feature], minlength=n * longest).reshape(n, longest)
        moves, start = x[size : size + 4].reshape(2, 2), x[-1]
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        forward[0, :, 1] = start + emission[:, 0]
        for t in range(1, longest):
            now = np.logaddexp.reduce(forward[t - 1][:, :, None] + moves, axis=1)
            now[:, 1] += emission[:, t]
            forward[t] = np.where(live[:, t, None], now, forward[t - 1])
        whole = np.logaddexp.reduce(forward[-1], axis=1)
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = backward[t + 1] + np.stack([np.zeros(n), emission[:, t + 1]], 1)
            pair = np.exp(forward[t][:, :, None] + moves + ahead[:, None, :] - whole[:, None, None])
            expected += pair[live[:, t + 1]].sum(0)
            backward[t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(moves + ahead[:, None, :], axis=2), 0)
        good = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole).T * live
        miss = good - y * live
        gradient = np.concatenate([np.bincount(feature, miss.ravel()[row], minlength=size), (expected - real).ravel(), [miss[:, 0].sum()]]) / n + decay * x
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(x[:size], x[size : size + 4].reshape(2, 2), float(x[-1]))


#: Stands before the text of a content block in the labelled pages.
_MARK = "\x02"


def labelled_pages(n: int = 400, seed: int = 5, without: str = "") -> list[str]:
    """Pages of eight kinds of sites, in which every content block begins with a
    mark; none of the kind ``without``."""
    r = random.Random(seed)
    syllables = "ta re mi no su la ber ing ous tion est qua der ich und le aux ció ñe ö ß eau".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def some(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def prose(low: int, high: int) -> str:
        sentences = []
        loud = r.random() < 0.1
        for _ in range(r.randint(low, high)):
            s = [word() for _ in range(r.randint(4, 18))]
            s[0] = s[0].capitalize()
            if r.random() < 0.5:
                s[len(s) // 2] += ","
            if loud:
                s = [w.upper() + r.choice(["", "", "!"]) for w in s]
            if r.random() < 0.15:
                s[0] = f"<b>{s[0]}</b>"
            if r.random() < 0.1:
                s[-1] = f'<a href="/{word()}">{s[-1]}</a>'
            sentences.append(" ".join(s) + r.choice("...?"))
        return " ".join(sentences)

    def links(low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}?a=1&b=2" title="{word()} &gt; {word()}">{some(1, 3)}</a></{tag}>' for _ in range(r.randint(low, high)))

    def menu(tag: str, name: str = "") -> str:
        return f"<{tag}{name}><ul>{links(3, 9)}</ul></{tag}>"

    def legal() -> str:
        return f"&copy; {r.randint(1999, 2025)} {some(1, 3)} {r.choice(['|', '&middot;', '-', ''])} {some(0, 8)}"

    def maybe(p: float, make) -> str:
        return make() if r.random() < p else ""

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{_MARK}{prose(1, 7) if r.random() < 0.85 else some(1, 5)}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"]) for _ in range(r.randint(low, high)))

    def body(*kinds: str) -> str:
        """Runs of content: paragraphs, and what ``kinds`` names."""
        make = {
            "head": lambda: f"<h2>{_MARK}{some(1, 6)}</h2>",
            "list": lambda: "<ul>" + "".join(f"<li>{_MARK}{prose(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
            "quote": lambda: f"<blockquote>{_MARK}{prose(1, 3)}</blockquote>",
            "table": lambda: "<table>" + "".join(f"<tr><td>{_MARK}{some(1, 4)}</td><td>{_MARK}{r.randint(1, 9999)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>",
            "div": lambda: f"<div>{_MARK}{prose(1, 4)}</div>",
        }
        return "".join(paragraphs(1, 3) if r.random() < 0.7 else make[r.choice(kinds)]() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))

    def ad() -> str:
        name = r.choice(["ad", "ads", "advert", "promo", "banner", "sponsored"])
        inside = r.choice([lambda: prose(1, 2), lambda: some(2, 9), lambda: links(1, 3, "span"), lambda: f"<p>{prose(1, 2)}</p>"])()
        return f'<{r.choice(["div", "div", "aside"])} class="{name}">{inside}</div></aside>'

    def title() -> str:
        return f"<h1>{_MARK}{some(1, 8)}</h1>"

    def blog() -> str:
        return f'<div id="wrapper"><div class="header"><a href="/">{some(1, 3)}</a></div>{menu("div", r.choice([" class=menu", " id=navigation"]))}<div class="post">{title()}{maybe(0.5, lambda: f"<div class=meta>{some(2, 5)}</div>")}{body("head", "quote", "list")}{maybe(0.4, ad)}{maybe(0.4, lambda: paragraphs(1, 3))}</div>{maybe(0.5, lambda: f"<div class=comments><h3>{some(1, 2)}</h3>" + "".join(f"<p>{prose(1, 2)}</p>" for _ in range(r.randint(1, 4))) + "</div>")}<div class="sidebar"><h3>{some(1, 2)}</h3><ul>{links(2, 7)}</ul></div><div class="footer">{legal()}</div></div>'

    def news() -> str:
        return f'{menu("nav")}{maybe(0.5, ad)}<main><article>{maybe(0.8, title)}{maybe(0.4, lambda: f"<p class=byline>{some(2, 5)}</p>")}{body("head", "quote")}{maybe(0.4, lambda: f"<aside class=related><h3>{some(1, 2)}</h3><ul>{links(2, 5)}</ul></aside>")}{maybe(0.4, lambda: paragraphs(1, 4))}</article></main>{maybe(0.4, lambda: f"<div class=newsletter><p>{prose(1, 1)}</p></div>")}<footer>{legal()}</footer>'

    def manual() -> str:
        return f'<div class="toc"><ul>{links(4, 12)}</ul></div><div class="section">{title()}{body("head", "list", "table")}{maybe(0.5, lambda: f"<pre>{_MARK}{some(3, 20)}</pre>")}{maybe(0.5, lambda: paragraphs(1, 3))}</div><div class="pager"><a href="/p">{some(1, 2)}</a> <a href="/n">{some(1, 2)}</a></div><div role="contentinfo">{legal()}</div>'

    def forum() -> str:
        posts = "".join(f'<tr><td class="author">{word()}<br>{some(1, 2)}</td><td class="postbody">{_MARK}{prose(1, 5)}</td></tr>' for _ in range(r.randint(1, 6)))
        return f'<div class="breadcrumbs">{links(2, 4, "span")}</div><h1>{_MARK}{some(2, 7)}</h1><table class="posts">{posts}</table>{maybe(0.3, ad)}<div class="pagination">{links(2, 6, "span")}</div><p class="small">{legal()}</p>'

    def shop() -> str:
        return f'<header>{links(3, 8, "div")}</header>{maybe(0.4, lambda: f"<div class=cookie><p>{prose(1, 2)}</p><button>{word()}</button></div>")}<section class="product">{title()}<div class="description">{body("list", "table", "div")}</div></section><div class="cart">{some(1, 4)}</div><section class="recommend"><h3>{some(1, 3)}</h3>{links(3, 6, "div")}</section><footer><div>{links(3, 8, "div")}</div><p>{legal()}</p></footer>'

    def wiki() -> str:
        return f'<div id="content"><h1>{_MARK}{some(1, 4)}</h1><div class="body">{body("head", "list", "table", "quote")}{maybe(0.6, lambda: body("head", "list"))}</div></div><div class="categories">{links(2, 6)}</div>{menu("div", " id=tools")}<div id="footer"><ul><li>{legal()}</li><li>{some(3, 9)}.</li></ul></div>'

    def tables() -> str:
        return f'<center><img src=x.gif></center><table width=100%><tr><td width=120>{"<br>".join(f"<a href={k}>{some(1, 2)}</a>" for k in range(r.randint(3, 8)))}</td><td>{maybe(0.6, title)}{body("div", "head")}</td></tr></table><hr><center>{legal()}</center>'

    def plain() -> str:
        return f'{maybe(0.7, title)}{body("head", "quote", "list", "div")}{maybe(0.6, lambda: f"<p>{links(1, 3, 'span')}</p>")}{maybe(0.5, lambda: f"<footer><p>{legal()}</p></footer>")}'

    kinds = {f.__name__: f for f in (blog, news, manual, forum, shop, wiki, tables, plain) if f.__name__ != without}
    out = []
    for k in range(n):
        page = kinds[list(kinds)[k % len(kinds)]]()
        head = f"<title>{some(1, 6)}</title>" + maybe(0.5, lambda: '<script src="a.js">if (a > b) { c("<div>") }</script>') + maybe(0.3, lambda: "<style>p > b { top: 0 }</style>")
        out.append(f"<html><head>{head}</head><body>{page}</body></html>")
    return out


def deepened(page: str, r: random.Random, most: int = 40) -> str:
    """``page`` in wrappers, and with divs among its blocks that nothing closes."""

    def wrappers(n: int) -> str:
        return "".join("<div>" if r.random() < 0.6 else f'<div class="{r.choice(["wrap", "row", "col", "inner", "layout", "container", "box", "grid"])}">' for _ in range(n))

    head, body = page.split("<body>", 1)
    pieces = re.split(r"(?=<(?:p|h2|nav|aside|footer|header|article|main|section)\b)", body)
    return f"{head}<body>" + wrappers(r.randint(0, most)) + "".join((wrappers(r.randint(1, 4)) if r.random() < 0.2 else "") + x for x in pieces)


def chain(page: str) -> tuple[list[list[int]], list[int]]:
    """Features and labels of a labelled page's blocks."""
    paths = Paths()
    found, features, labels = blocks(page, paths), [], []
    for k, (text, path, share) in enumerate(found):
        labels.append(int(text.startswith(_MARK)))
        text = text.lstrip(_MARK) or " "
        features.append([*text_features(text, share, k == 0), *sorted(paths.features[path])])
    return features, labels


@functools.lru_cache(1)
def default_model() -> Model:
    r = random.Random(11)
    pages = [deepened(page, r) if k % 4 == 0 else page for k, page in enumerate(labelled_pages())]
    return train([c for c in map(chain, pages) if c[1]])


def extract(pages: DataFrame, page: str = "html", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (its columns ``keep``; None: all but the page) with
    ``content``, the content blocks' texts, one a line, and the numbers
    ``n_blocks`` and ``n_content``.

    A null page has null in all three; a page without text, or without tags and
    text, has an empty content. Text outside any tag is a block. Whole pages are
    read. Rows are independent; repeated rows have equal results; an empty table
    gives an empty table. If a kept column has one of the new names, the new one
    gets an underscore before its name.
    """
    keep = [c for c in pages.columns if c != page] if keep is None else keep
    source = pages.select(*[col(c) for c in dict.fromkeys([*keep, page])])
    c_name, n_name, k_name = fresh(source, "content", "n_blocks", "n_content")
    kept = [f for f in source.schema if f.name in keep]
    schema = T.StructType([*kept, T.StructField(c_name, T.StringType()), T.StructField(n_name, T.LongType()), T.StructField(k_name, T.LongType())])
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        weights = m.weights.tolist()
        paths = Paths(m.weights)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                texts, counts, goods = [], [], []
                for value in only(batch, page):
                    source_text = value.as_py()
                    if source_text is None:
                        for x in (texts, counts, goods):
                            x.append(None)
                        continue
                    if len(paths.known) > 100_000:
                        paths = Paths(m.weights)
                    found = blocks(source_text, paths)
                    scores = [paths.scores[path] + sum([weights[f] for f in text_features(text, share, k == 0)]) for k, (text, path, share) in enumerate(found)]
                    good = m.decode(scores)
                    texts.append("\n".join([b[0] for b, g in zip(found, good) if g]))
                    counts.append(len(found))
                    goods.append(sum(good))
                yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(goods, pa.int64())], names=schema.names)

    return map_arrow(source, run, schema)
