"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi.

A page is cut into leaf blocks, the runs of text between block-level tags, each with the open elements around it.
Features are the tags of the ancestors, words of their class, id and role, and measures of the text and its neighbours. The field
has two states, article and other, with weights for features, transitions and the first block, fitted by gradient ascent on the
likelihood of labelled pages.

Labelled pages: on pages with an ``article`` or ``main`` element its blocks are article unless a ``nav``, ``aside``,
``form`` or ``footer`` lies between. Since one site's template teaches little, each labelled page also gives variants: its paragraphs in other
containers, with menus, adverts, notices, forms, side columns, reader comments and link lists set around and between them, whose labels are known.
At most ``SAMPLE`` pages of at most ``PAGE_BYTES`` are fitted on (those of the smallest hash); every page is decoded whole.

Defined results: null or empty html, and pages without text, give an empty text; broken markup is read as far as it goes; markup inside scripts,
styles and comments never counts; blocks are joined by one newline in page order; repeated rows are decoded each; without any labelled page the
field is empty and every block outside head, scripts and styles is article; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import thinned

SAMPLE, PAGE_BYTES, VARIANTS = 400, 200_000, 3
BITS, ROUNDS, RATE, RIDGE = 13, 80, 0.2, 1e-4
SIZE = 1 << BITS
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select xmp noframes".split())
#: opening one of these closes an open one of its kind, up to the given container
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
          "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: words of class, id and role that name a kind of block
KINDS = {
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner outbrain taboola affiliate",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toolbar skip links toc",
    "head": "header masthead topbar logo branding hero tagline",
    "foot": "footer foot copyright colophon legal imprint contentinfo",
    "side": "sidebar side aside widget widgets related recommended popular trending more recirc complementary rail teaser",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader readers feedback guestbook review reviews",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner warning message privacy paywall",
    "form": "form login signup signin subscribe subscription newsletter search register contact poll survey",
    "share": "share sharing social follow facebook twitter tools meta byline tags tag author bio print",
    "article": "article content post entry main body story text page maincontent prose markdown",
}
KIND_OF: dict[str, list[str]] = {}
for _kind, _words in KINDS.items():
    for _word in _words.split():
        KIND_OF.setdefault(_word, []).append(_kind)


#: the label of an element in a variant; on other pages an attribute like any other
MARK = "data-label"


class Element:
    __slots__ = ("tag", "marks", "label")

    def __init__(self, tag: str, attributes: str, marked: bool = False):
        self.tag, self.label, marks = tag, None, ["t:" + tag]
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next(filter(None, values), "")
                if name in ("class", "id", "role"):
                    for word in PIECES.findall(value):
                        word = word.lower()
                        marks += ["k:" + k for k in KIND_OF.get(word, ())] or ["w:" + word]
                elif marked and name == MARK:
                    self.label = int(value)
                elif name == "style" and "none" in value.replace(" ", "").partition("display:")[2][:4] or name == "aria-hidden" and value == "true":
                    marks.append("k:hidden")
            if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
                marks.append("k:hidden")
        self.marks = marks


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[Element, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str, marked: bool = False) -> list[Block]:
    """Leaf blocks of a page in order, white space collapsed and references decoded; ``marked`` if it is a variant with labels."""
    found: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, tuple(e for e in stack if e.tag not in INLINE or e.tag == "a"), linked))
            parts.clear()
        linked = 0

    def said(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(k: int):
        nonlocal links
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        links -= sum(e.tag == "a" for e in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if k is not None and not (tag in INLINE and any(e.tag not in INLINE and e.tag != "p" for e in stack[k:])):
                close(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            end = ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            kinds, bound = CLOSES.get(tag, ("", ()))
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i].tag
                if t == "p" or t in kinds.split():
                    close(i)
                    if t == "p":
                        continue
                    break
                if t in bound or (t not in INLINE and not kinds):
                    break
            while stack and stack[-1].tag in INLINE:  # a block is not part of the inline run it was left in
                close(len(stack) - 1)
        elif tag == "a" and links:
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "a")
            close(k)
        stack.append(Element(tag, m[3], marked))
        links += tag == "a"
    flush()
    return found


def _step(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def _measures(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    size = len(text)
    stops = sum(map(text.count, (". ", ", ", "! ", "? "))) + (text[-1] in ".!?:;\"”»")
    out = [f"n{_step(words, (2, 4, 8, 16, 32, 64))}", f"l{_step(block.linked / size, (0.01, 0.3, 0.6, 0.95))}", f"s{_step(stops, (1, 2, 4, 8))}"]
    if text[-1] in ".!?":
        out.append("end")
    if "©" in text or "·" in text or "|" in text:
        out.append("mark")
    if text.isupper():
        out.append("caps")
    return out


_known: dict[str, int] = {}


def _at(name: str) -> int:
    if name not in _known:
        if len(_known) > 200_000:
            _known.clear()
        _known[name] = zlib.crc32(name.encode()) & (SIZE - 1)
    return _known[name]


def features(page: list[Block]) -> list[list[int]]:
    """Classes of the features of each block."""
    own = [_measures(b) for b in page]
    out = []
    paths: dict[tuple, list[str]] = {}
    for i, block in enumerate(page):
        names = paths.get(block.path)
        if names is None:
            names = list(dict.fromkeys(x for e in block.path if e.tag not in ("html", "body") for x in e.marks))
            if block.path:
                inner = [e.tag for e in block.path if e.tag != "a"] or [""]
                names += ["own:" + inner[-1], "two:" + "/".join(inner[-2:])]
            paths[block.path] = names
        row = ["", *names, *own[i], "".join(own[i][:2])]
        row += ["p" + x for x in own[i - 1]] if i else ["first"]
        row += ["q" + x for x in own[i + 1]] if i + 1 < len(page) else ["last"]
        out.append(sorted({_at(x) for x in row}))
    return out


class Field:
    """Weights of the two states (1 is article)."""

    def __init__(self):
        self.unary = np.zeros((SIZE, 2))
        self.step = np.zeros((2, 2))
        self.fitted = False

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.concatenate(rows) if rows else np.zeros(0, int)
        begin = np.cumsum([0, *map(len, rows[:-1])]) if rows else []
        return np.add.reduceat(self.unary[flat], begin, axis=0)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest states of a page."""
        if not rows:
            return []
        if not self.fitted:
            return [1] * len(rows)
        (s00, s01), (s10, s11) = self.step.tolist()
        scores, back = self.scores(rows).tolist(), []
        a, b = scores[0]
        for x, y in scores[1:]:
            from_a, from_b = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
            back.append((from_a, from_b))
            a, b = (a + s00 if from_a == 0 else b + s10) + x, (a + s01 if from_b == 0 else b + s11) + y
        state = int(b > a)
        states = [state]
        for pair in reversed(back):
            state = pair[state]
            states.append(state)
        return states[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS) -> "Field":
        """Full-batch Adam on the conditional log-likelihood; all pages advance together, block by block."""
        pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
        if not pages:
            return self
        lengths = np.array([len(p[0]) for p in pages])
        rows = [r for p in pages for r in p[0]]
        flat, begin = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        block_of = np.repeat(np.arange(len(rows)), np.diff(begin))
        labels = np.concatenate([p[1] for p in pages]).astype(int)
        start = np.cumsum([0, *lengths[:-1]])
        gold = np.zeros((SIZE, 2))
        np.add.at(gold, (flat, labels[block_of]), 1.0)
        inner = np.ones(len(rows), bool)
        inner[start] = False
        at = np.flatnonzero(inner)
        gold_step = np.zeros((2, 2))
        np.add.at(gold_step, (labels[at - 1], labels[at]), 1.0)
        theta = [self.unary, self.step]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        alive = [start[lengths > t] + t for t in range(int(lengths[0]))]  # blocks at each place; pages are sorted by length
        for turn in range(1, rounds + 1):
            score = np.add.reduceat(self.unary[flat], begin[:-1], axis=0)
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            for t, here in enumerate(alive):
                forward[here] = score[here] if t == 0 else score[here] + np.logaddexp.reduce(forward[here - 1][:, :, None] + self.step, axis=1)
            for here in alive[:0:-1]:
                backward[here - 1] = np.logaddexp.reduce(self.step + (score[here] + backward[here])[:, None, :], axis=2)
            total = np.repeat(np.logaddexp.reduce(forward[start + lengths - 1], axis=1), lengths)
            state = np.exp(forward + backward - total[:, None])
            both = np.exp(forward[at - 1][:, :, None] + self.step + (score[at] + backward[at])[:, None, :] - total[at][:, None, None])
            expected = np.stack([np.bincount(flat, state[block_of, k], minlength=SIZE) for k in (0, 1)], axis=1)
            slopes = [(gold - expected) / len(pages) - RIDGE * self.unary, (gold_step - both.sum(axis=0)) / len(pages) - RIDGE * self.step]
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope * slope
                theta[k] += RATE * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
        self.fitted = True
        return self


def labels_of(page: list[Block]) -> list[int] | None:
    """Labels from article and main elements, or from the marks of a variant; None where neither occurs."""
    out, any_ = [], False
    for block in page:
        label = 0
        for e in block.path:
            if e.label is not None:
                label, any_ = e.label, True
            elif e.tag in ("article", "main"):
                label, any_ = 1, True
            elif e.tag in ("nav", "aside", "form", "footer"):
                label = 0
        out.append(label)
    return out if any_ else None


def variant(texts: list[str], others: list[str], rng: np.random.Generator) -> str:
    """A labelled page that sets the paragraphs in another template, with other texts as what surrounds an article."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    safe = lambda x: html.escape(x)
    words = lambda n: safe(" ".join(pick(*others).split()[:n]))
    links = lambda n: "".join(f"<li><a href='#'>{words(int(rng.integers(1, 5)))}</a></li>" for _ in range(n))
    named = lambda kind: pick(*KINDS[kind].split()) + pick("", "", "-box", "_wrap", f"-{int(rng.integers(9))}")
    prose = lambda: f"<p>{safe(pick(*others))}</p>" * int(rng.integers(1, 3))

    def other(kind: str) -> str:
        tag = {"menu": pick("nav", "div", "ul"), "head": pick("header", "div"), "foot": pick("footer", "div"), "side": pick("aside", "div", "section"),
               "form": pick("form", "div"), "comment": pick("section", "div", "ol")}.get(kind, pick("div", "section", "p"))
        if kind in ("menu", "side", "share") and rng.random() < 0.7:
            body = f"<ul>{links(int(rng.integers(2, 8)))}</ul>" + (prose() if kind == "side" and rng.random() < 0.5 else "")
        elif kind == "comment":
            body = "<h3>Comments</h3>" * int(rng.random() < 0.5) + "".join(f"<{c} class='comment'>{prose()}</{c}>" for c in [pick("div", "li", "article")] * int(rng.integers(1, 5)))
        elif kind == "form":
            body = f"<label>{words(3)}</label><input><button>{words(2)}</button>" + (prose() if rng.random() < 0.4 else "")
        elif kind == "foot":
            body = pick("&copy; ", "© 2024 ", "") + words(12)
        else:
            body = words(int(rng.integers(3, 25))) if tag == "p" or rng.random() < 0.5 else prose()
        bare = tag in ("nav", "aside", "footer", "form", "header") and rng.random() < 0.6
        return f"<{tag} {MARK}='0'{'' if bare else pick(' class', ' id') + chr(61) + chr(39) + named(kind) + chr(39)}>{body}</{tag}>"

    tag = pick("article", "main", "div", "div", "section", "td")
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else f" class='{named('article')}'"
    inside = [f"<h1>{safe(texts[0])}</h1>"]
    for text in texts[1:]:
        form = rng.random()
        inside.append(f"<p>{safe(text)}</p>" if form < 0.8 else f"<h2>{words(4)}</h2><p>{safe(text)}</p>" if form < 0.88 else
                      f"<ul><li>{safe(text)}</li><li>{words(6)}</li></ul>" if form < 0.94 else f"<blockquote>{safe(text)}</blockquote>")
        if rng.random() < 0.12:
            inside.append(other(pick("advert", "share", "side", "form", "notice")))
    if rng.random() < 0.3:
        inside.append(other(pick("comment", "share", "side")))
    before = [other(k) for k in ("notice", "head", "menu", "advert", "side", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("share", "comment", "side", "form", "advert", "notice", "foot") if rng.random() < 0.5]
    return f"<html><body>{''.join(before)}<{tag} {MARK}='1'{name}>{''.join(inside)}</{tag}>{''.join(after)}</body></html>"


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from a bounded sample of pages that carry labels, and their variants."""
    text = F.col("html").cast("string")
    usable = pages.where((F.octet_length(text) <= PAGE_BYTES) & F.rlike(F.lower(text), F.lit("<(article|main)\\b")))
    rows = (thinned(usable, F.xxhash64(text), sample, usable.count())
            .select(F.xxhash64(text).alias("h"), text.alias("html")).orderBy("h", "html").limit(sample).collect())
    rng = np.random.default_rng(5)
    parsed = [(page, got) for page in (blocks(r["html"]) for r in rows) if (got := labels_of(page))]
    others = [b.text for page, got in parsed for b, y in zip(page, got) if len(b.text) < 2000 and (not y or len(b.text) > 40)] or ["more"]
    data = [(features(page), got) for page, got in parsed]
    for page, got in parsed:
        texts = [b.text for b, y in zip(page, got) if y]
        for _ in range(VARIANTS if texts else 0):
            made = blocks(variant(texts[:20], others, rng), marked=True)
            data.append((features(made), labels_of(made)))
    return Field().fit([(f, y) for f, y in data if y])


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, sample))  # 2 x 2**BITS weights

    def decode(batches):
        field = shared.value
        for batch in batches:
            out = []
            for page in batch.column(2):
                found = blocks(page.as_py() or "")
                out.append("\n".join(b.text for b, keep in zip(found, field.decode(features(found))) if keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(decode, "page_id long, url string, text string, n_chars long")
