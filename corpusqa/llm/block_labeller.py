"""Main text of HTML pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks (runs of text between block-level tags). A
bidirectional LSTM in numpy sees for each block hashed vectors of its tag path (tags, class and
id words of all open elements) and of its words, and some measures; so each block is judged in
the context of the whole page. Blocks labelled as article text make up the result.

Training: the pages carry no labels. Blocks of TRAIN_PAGES pages (those whose hashed ids come
first) are labelled from plain markup, where elements say what they are; then their pages are
varied (other containers, more boilerplate, among it sidebars, notices, forms and reader
comments that hold article-like text), so that the labeller meets layouts beyond the sample.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb

TRAIN_PAGES = 384
TRAIN_BLOCKS = 400  # blocks of a training page; the sample's bound, not one of prediction
EPOCHS = 5
HIDDEN = 20
PATH_BUCKETS = 512
WORD_BUCKETS = 16
MEASURES = 6
BATCH_PAGES = 128

# Fixed lists: elements and names of pages, in plain words.
RAW = ("script", "style", "title")  # hold no markup and no text of the page
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr "
    # what is embedded: text inside is shown in its place, and one that is never closed holds nothing
    "object canvas iframe noscript "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction mglyph semantics annotation annotation-xml "
    "svg g defs desc symbol use path rect circle ellipse line polyline polygon text tspan textpath marker pattern clippath mask image "
    "lineargradient radialgradient stop filter foreignobject switch view metadata animate animatemotion animatetransform mpath set "
    "feblend fecolormatrix fecomponenttransfer fecomposite feconvolvematrix fediffuselighting fedisplacementmap fedistantlight "
    "fedropshadow feflood fefunca fefuncb fefuncg fefuncr fegaussianblur feimage femerge femergenode femorphology feoffset "
    "fepointlight fespecularlighting fespotlight fetile feturbulence"
).split())
SPACED = ("br", "img", "input", "desc", "text", "mtr", "mtd")  # inline, but words end there
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CLOSED_BY = {"p": None, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}
HOLDERS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu")
BOILERPLATE_TAGS = "nav footer aside form menu button select option textarea dialog fieldset legend".split()
BOILERPLATE_WORDS = (
    "nav navbar navigation menu sidebar side aside ad ads adv advert advertisement sponsor sponsored banner promo promotion cookie "
    "cookies consent gdpr notice alert popup modal overlay form search login signup subscribe subscription newsletter comment "
    "comments reply replies respond discussion disqus share sharing social follow related recommended more trending popular "
    "widget footer header masthead topbar breadcrumb breadcrumbs pager pagination tags copyright legal disclaimer toolbar skip"
).split()
ARTICLE_TAGS = ("article", "main")
ARTICLE_WORDS = "article content post entry story body text main".split()

# What varied pages are built from: (tags with class words) around article text, and around boilerplate.
CONTAINERS = (
    "article", "main", "main|article", "div.content", "div.main content", "div.article body", "div.post", "div.post content", "div.entry content",
    "section.story", "div.text", "div.page|div.content", "div.wrapper|article.post", "div.container|main.content", "section|article",
)
EXTRAS = (
    "nav|ul|li", "div.menu|ul|li", "header.site header|p", "header|div.banner", "div.topbar", "aside|p", "aside.sidebar|div|p", "div.sidebar|p",
    "div.sidebar widget|ul|li", "div.ad", "div.ads|p", "div.advert", "div.sponsored|p", "div.promo|p", "div.cookie notice|p", "div.notice", "div.alert|p",
    "div.consent banner|p", "form|p", "form.search", "form.newsletter|div", "div.newsletter|p", "section.comments|div.comment|p", "div.comments|p",
    "div.comment|p", "ul.comments|li|p", "ol.commentlist comments|li", "section.discussion|p", "div.reply|p", "div.related|ul|li", "section.related|p",
    "div.share|span", "div.social", "div.breadcrumb", "div.pagination", "footer", "footer|p", "footer|div", "div.footer|p", "div.copyright", "div.legal|p",
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    # open elements that say something those around them do not, then the innermost: tag, class and id words
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int  # characters inside links


@lru_cache(1 << 14)
def _tells(tag: str, names: tuple[str, ...]) -> frozenset:
    """All that labels and inputs take from an open element; at any depth there are few different ones."""
    fixed = {t for t in (tag,) if t in _TOLD_TAGS} | {f"word {w}" for w in names if w in _TOLD_WORDS}
    return frozenset({_bucket(f"tag {tag}", PATH_BUCKETS)} | {_bucket(f"word {w}", PATH_BUCKETS) for w in names} | fixed)


_TOLD_TAGS = {*BOILERPLATE_TAGS, *ARTICLE_TAGS, "header"}
_TOLD_WORDS = {*BOILERPLATE_WORDS, *ARTICLE_WORDS}


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    told: dict = {}  # what open elements tell, with the depth of the first that does
    telling: list[int] = []  # depths of those
    held: list[str] = []
    linked, links = 0, 0
    hidden = False  # inside a head
    foreign = False  # inside svg or math, where an element may close itself
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                around = [stack[i] for i in telling if i < len(stack) - 1]
                out.append(Block((*around, *stack[-1:]), text, linked))
            held.clear()
        linked = 0

    def opened(element: tuple[str, tuple[str, ...]]) -> None:
        new = [k for k in _tells(*element) if k not in told]
        if new:
            told.update(dict.fromkeys(new, len(stack)))
            telling.append(len(stack))
        stack.append(element)

    def closed(depth: int) -> None:
        del stack[depth:]
        if telling and telling[-1] >= depth:
            while telling and telling[-1] >= depth:
                telling.pop()
            for k in [k for k, i in told.items() if i >= depth]:
                del told[k]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if not hidden:
                held.append(text)
                if links:
                    linked += len(text)
            continue
        if m["raw"] is not None:
            raw = m["raw"].lower()
            if not (foreign and m[0].endswith("/>")):
                end = _RAW_END[raw].search(page, at)
                # a title without an end does not hide the page
                at = end.end() if end else at if raw == "title" else len(page)
            continue
        if m["tag"] is None:  # a comment or a declaration
            continue
        tag = m["tag"].lower()
        if tag in ("svg", "math"):
            foreign = not m["end"] and not m["attrs"].endswith("/")
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "head":
                hidden = False
            elif tag in INLINE or tag in VOID:
                if tag in SPACED:
                    held.append(" ")
            else:
                flush()
                foreign = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        closed(i)
                        break
            continue
        if tag == "a":
            links += 1
        elif tag == "head":
            flush()
            hidden = True
            continue
        if tag in INLINE:
            if tag in SPACED:
                held.append(" ")
            continue
        if tag in VOID:
            if tag in SPACED:
                held.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        links, hidden, foreign = 0, False, False
        if stack and stack[-1][0] == "p":
            closed(len(stack) - 1)  # a paragraph ends where another block begins
        for i in range(len(stack) - 1, -1, -1):
            ends = CLOSED_BY.get(stack[i][0])
            if ends and tag in ends:
                closed(i)
                break
            if stack[i][0] in HOLDERS:
                break
        if tag in ("html", "body"):
            continue
        names = tuple(w.lower() for a, b, c in _NAMES.findall(m["attrs"] or "") for w in _WORD.findall(a or b or c))
        if not m["attrs"].endswith("/"):
            opened((tag, names))
    flush()
    return out


def _said(path: tuple) -> bool | None:
    """What the markup says: article text, boilerplate, or nothing."""
    tags = [t for t, _ in path]
    words = {w for _, names in path for w in names}
    article = any(t in ARTICLE_TAGS for t in tags)
    if any(t in BOILERPLATE_TAGS for t in tags) or ("header" in tags and not article):
        return False
    if words & set(BOILERPLATE_WORDS) and not (article and words <= set(ARTICLE_WORDS)):
        return False
    return True if article or words & set(ARTICLE_WORDS) else None


def _label(page: list[Block]) -> np.ndarray:
    said = [_said(b.path) for b in page]
    if any(said):
        return np.array([s is True for s in said])
    # no container says so: long, punctuated, hardly linked blocks
    return np.array([s is None and len(b.text) >= 80 and b.linked < 0.3 * len(b.text) and b.text[-1:] in ".!?\"'" for s, b in zip(said, page, strict=True)], bool)


def _element(spec: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((e.partition(".")[0], tuple(e.partition(".")[2].split())) for e in spec.split("|"))


def _varied(page: list[Block], labels: np.ndarray, texts: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page in another container, with boilerplate before and after, some of it article-like."""
    container = _element(CONTAINERS[rng.integers(len(CONTAINERS))])
    body = [Block((*container, *b.path[-1:]) if b.path and b.path[-1][0] not in ARTICLE_TAGS else container, b.text, b.linked) for b, y in zip(page, labels, strict=True) if y]
    other = [b for b, y in zip(page, labels, strict=True) if not y]
    if rng.random() < 0.5:
        other = []

    def extra(inside: bool) -> list[Block]:
        path = _element(EXTRAS[rng.integers(len(EXTRAS))])
        out = []
        for _ in range(rng.integers(1, 5)):
            text = texts[rng.integers(len(texts))]
            if rng.random() < 0.6:
                words = text.split()
                text = " ".join(words[: rng.integers(1, 13)])
            out.append(Block((*container, *path) if inside else path, text, len(text) if path[-1][0] == "li" and rng.random() < 0.6 else 0))
        return out

    cut = int(rng.integers(len(other) + 1))
    before, after = other[:cut], other[cut:]
    for _ in range(rng.integers(0, 4)):
        before = before + extra(False)
    for _ in range(rng.integers(0, 4)):
        after = after + extra(rng.random() < 0.15)
    if body and rng.random() < 0.4:  # boilerplate between paragraphs
        at = int(rng.integers(1, len(body) + 1))
        between = extra(rng.random() < 0.5)
        middle = body[:at] + between + body[at:]
        mark = [True] * at + [False] * len(between) + [True] * (len(body) - at)
    else:
        middle, mark = body, [True] * len(body)
    return before + middle + after, np.array([False] * len(before) + mark + [False] * len(after), bool)


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def _path_buckets(path: tuple) -> list[int]:
    tokens = {f"tag {t}" for t, _ in path} | {f"word {w}" for _, names in path for w in names}
    if path:
        tokens |= {f"leaf {path[-1][0]}"} | {f"leaf word {w}" for w in path[-1][1]}
    return sorted({_bucket(t, PATH_BUCKETS) for t in tokens})


def _measures(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.empty((n, MEASURES), np.float64)
    for i, b in enumerate(page):
        size = len(b.text)
        out[i] = (np.log1p(size) / 5, b.linked / size, b.text.count(" ") / size * 5, b.text[-1] in ".!?", sum(map(b.text.count, ",;")) / size * 30, i / n)
    return np.minimum(out, 4)


def _word_vectors(pages: list[list[Block]]) -> np.ndarray:
    """Signed counts of hashed words of each block, over the root of their number."""
    raw = [b.text.encode("utf-8", "surrogatepass") for page in pages for b in page]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    out = np.zeros((len(raw), WORD_BUCKETS))
    data = np.frombuffer(b"".join(raw), np.uint8)
    for lo, hi in tb.spans(offsets, 1 << 20):
        starts, ends, first = tb.word_bounds(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h = tb.hash_runs(data[offsets[lo] : offsets[hi]], starts, ends, tb.LOWER_CODES)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        cell = row * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        got = np.bincount(cell, weights=sign, minlength=(hi - lo) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        out[lo:hi] = got / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
    return out


class Labeller:
    """Bidirectional LSTM over the blocks of a page, a logistic unit on top."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        dims, h = PATH_BUCKETS + WORD_BUCKETS + MEASURES, HIDDEN
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.15, (dims, 4 * h))
            self.p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0  # remember by default
            self.p[f"c{side}"] = bias
        self.p["o"] = rng.normal(0, 0.2, 2 * h)
        self.p["d"] = np.zeros(1)
        self._rows: dict[tuple, np.ndarray] = {}

    def inputs(self, pages: list[list[Block]]) -> np.ndarray:
        """What the input weights make of each block, for both directions (8 * HIDDEN numbers)."""
        weights = np.concatenate([self.p["xf"], self.p["xb"]], axis=1)
        if len(self._rows) > 50_000:
            self._rows.clear()
        rows = []
        for page in pages:
            for b in page:
                got = self._rows.get(b.path)
                if got is None:
                    got = self._rows[b.path] = weights[_path_buckets(b.path)].sum(0)
                rows.append(got)
        rest = np.concatenate([_word_vectors(pages), np.concatenate([_measures(p) for p in pages])], axis=1)
        return np.stack(rows) + rest @ weights[PATH_BUCKETS:]

    def _run(self, z: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        # z: (steps, pages, 4 * HIDDEN)
        steps, n = mask.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.empty((steps, n, HIDDEN))
        w, bias = self.p[f"h{side}"], self.p[f"c{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ w + bias
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            th = np.tanh(new_c)
            new_h = o * th
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            c = np.where(m, new_c, c)
            h = np.where(m, new_h, h)
            out[t] = h
        return out

    @staticmethod
    def _padded(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps, n = max(sizes), len(sizes)
        page = np.repeat(np.arange(n), sizes)
        step = tb.ragged(np.zeros(n, np.int64), np.array(sizes))
        z = np.zeros((steps, n, rows.shape[1]))
        z[step, page] = rows
        mask = np.zeros((steps, n), bool)
        mask[step, page] = True
        return z, mask, np.stack([step, page])

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the chance of every block to be article text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages of like length, together at most so many padded blocks
            to = at + 1
            while to < len(order) and to - at < BATCH_PAGES and (to - at + 1) * len(pages[order[to]]) <= 1 << 14:
                to += 1
            part = [pages[i] for i in order[at:to]]
            sizes = [len(p) for p in part]
            z, mask, (step, page) = self._padded(self.inputs(part), sizes)
            both = np.concatenate([self._run(z[:, :, : 4 * HIDDEN], mask, "f"), self._run(z[:, :, 4 * HIDDEN :], mask, "b")], axis=2)
            y = 1 / (1 + np.exp(-(both[step, page] @ self.p["o"] + self.p["d"])))
            for i, s in zip(order[at:to], np.split(y, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = s
            at = to
        return out

    def _step(self, pages: list[list[Block]], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        sizes = [len(p) for p in pages]
        paths = [_path_buckets(b.path) for p in pages for b in p]
        x = np.zeros((len(paths), PATH_BUCKETS))
        x[np.repeat(np.arange(len(paths)), [len(q) for q in paths]), np.concatenate([np.array(q, np.int64) for q in paths])] = 1
        x = np.concatenate([x, _word_vectors(pages), np.concatenate([_measures(p) for p in pages])], axis=1)
        z, mask, (step, page) = self._padded(np.concatenate([x @ self.p["xf"], x @ self.p["xb"]], axis=1), sizes)
        kept: dict[str, list] = {"f": [], "b": []}
        h = {s: self._run(z[:, :, (0 if s == "f" else 4 * HIDDEN) :][:, :, : 4 * HIDDEN], mask, s, kept[s]) for s in "fb"}
        both = np.concatenate([h["f"], h["b"]], axis=2)
        y = 1 / (1 + np.exp(-(both[step, page] @ self.p["o"] + self.p["d"])))
        d = (y - np.concatenate(labels)) / len(y)
        grad = {"o": both[step, page].T @ d, "d": np.array([d.sum()])}
        over = np.zeros((*mask.shape, 2 * HIDDEN))
        over[step, page] = d[:, None] * self.p["o"]
        for s in "fb":
            w = self.p[f"h{s}"]
            dz = np.zeros((*mask.shape, 4 * HIDDEN))
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(sizes), HIDDEN)), np.zeros((len(sizes), HIDDEN))
            top = over[:, :, :HIDDEN] if s == "f" else over[:, :, HIDDEN:]
            for t, h0, c0, i, f, o, g, th, m in reversed(kept[s]):
                dh = dh + top[t]
                do, dcc = dh * th * m, (dc + dh * o * (1 - th * th)) * m
                da = np.concatenate([dcc * g * i * (1 - i), dcc * c0 * f * (1 - f), do * o * (1 - o), dcc * i * (1 - g * g)], axis=1)
                dz[t] = da
                gw += h0.T @ da
                gb += da.sum(0)
                dh = np.where(m, da @ w.T, dh)
                dc = np.where(m, dcc * f, dc)
            grad[f"h{s}"], grad[f"c{s}"] = gw, gb
            grad[f"x{s}"] = x.T @ dz[step, page]
        return grad

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24) -> Labeller:
        """Adam on the cross entropy of all blocks."""
        rng = np.random.default_rng(5)
        used = [i for i in range(len(pages)) if pages[i]]
        first, second, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            # pages of like length in a batch, batches in any order
            order = sorted(used, key=lambda i: (len(pages[i]) // 4, rng.random()))
            starts = np.arange(0, len(order), batch)
            for a in rng.permutation(starts).tolist():
                rows = order[a : a + batch]
                t += 1
                for k, g in self._step([pages[i] for i in rows], [labels[i] for i in rows]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 8e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self._rows.clear()
        return self


def train(pages: list[str]) -> Labeller:
    """A labeller from unlabelled pages."""
    rng = np.random.default_rng(11)
    found = [p[:TRAIN_BLOCKS] for p in map(blocks, pages) if p]
    labels = [_label(p) for p in found]
    texts = [b.text for p in found for b in p] or ["."]
    sets, marks = list(found), list(labels)
    for _ in range(2):
        for page, y in zip(found, labels, strict=True):
            other, mark = _varied(page, y, texts, rng)
            if other:
                sets.append(other)
                marks.append(mark)
    return Labeller().fit(sets, [m.astype(np.float64) for m in marks]) if sets else Labeller()


_PARTS = 4 << 20


@tb.tidy
def _extract(batches: Iterator[pa.RecordBatch], labeller) -> Iterator[pa.RecordBatch]:
    tb.make_room()
    model: Labeller = labeller.value
    for batch in batches:
        data, offsets = tb.flat(batch.column(2))
        for lo, hi in tb.spans(offsets, _PARTS):
            pages = [blocks(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(lo, hi)]
            texts, kept = [], []
            for page, score in zip(pages, model.scores(pages), strict=True):
                chosen = [b.text for b, s in zip(page, score.tolist(), strict=True) if s >= 0.5]
                texts.append("\n".join(chosen))
                kept.append(len(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(p) for p in pages], pa.int64()), pa.array(kept, pa.int64())],
                names=["page_id", "url", "text", "n_blocks", "n_kept"],
            )


def fit(pages: DataFrame, sample: int = TRAIN_PAGES) -> Labeller:
    """Train on the ``sample`` pages with html whose hashed ids come first."""
    ids = pages.filter("html is not null").select(F.col("page_id").cast("long").alias("page_id")).filter("page_id is not null").distinct()
    keys = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter("html is not null")
    # ids first, then only their pages; rows that repeat an id count once
    chosen = rows.join(F.broadcast(keys), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    found = sorted(((r["page_id"], r["html"]) for r in chosen.toLocalIterator()), key=lambda r: r[0])
    return train([h for _, h in found])


def extract_main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row of ``pages`` (page_id, url, html).

    ``text`` joins the article blocks of the whole page by newlines; it is empty where there are
    none, as for a null html. Null and repeated ids keep their rows (pages without an id are not
    learned from); other columns are ignored; an empty table gives an empty result.
    """
    labeller = fit(pages) if labeller is None else labeller
    tb.small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(labeller)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(partial(_extract, labeller=sent), "page_id long, url string, text string, n_blocks long, n_kept long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
