"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of each page.

A page is cut into leaf blocks. Each has a vector: its tag path (names, classes, ids and roles of the
open elements, hashed), its words (hashed) and a few measures. The LSTM reads the blocks of the page
in both directions, so that each label depends on the whole page; blocks labelled as content are joined.

The model is trained here, in numpy, on a bounded sample of pages (``SAMPLE`` pages of up to
``SAMPLE_BYTES``, the least by hash of their html). Their labels come from the markup itself: what stands
in an article and in no menu, header, footer, aside, form, advert, notice or comment part is content. So
that the network doesn't only learn that rule, each page is also used in disguise (other tags and class
names, further parts put in), and blinded, without any of the names that the labels were taken from;
some with an article that is made much longer.

Cases: null or empty html, and pages without content, give an empty text; a null page_id or url is
passed through; repeated rows are extracted alike; unbalanced markup is read as browsers do for the
cases that matter here (implied ends of p, li, td and the like; unknown ends ignored), but elements and
quotes that are never closed don't swallow the rest of the page; an empty table gives an empty result;
other columns are ignored. Pages of any length are read whole, in time and memory proportional to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages to train on, and the most bytes of each: documented bounds, whatever the size of the table.
SAMPLE, SAMPLE_BYTES = 150, 200_000
HIDDEN, PATH_SIZE, WORD_SIZE, MEASURES = 16, 96, 64, 5
EPOCHS, BATCH, RATE = 12, 16, 0.01

#: Elements without content, elements whose text is never shown, and elements that begin a block: fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
HIDDEN_TEXT = frozenset("head noscript template svg select object math canvas audio video".split())
BLOCK = frozenset("html body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption label".split())
#: Elements that end when one of the same kind begins.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Parts of a page that are not its article, by tag and by words of class, id or role.
STOPS = frozenset("table ul ol dl div article section body td".split())
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog search".split())
OTHER_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side\w*|foot\w*|head|header|masthead|toolbar|cookies?|consent|notice\w*|alert|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comments?|replies|reply|discussion|disqus|login|search|widget\w*|copyright|legal|contentinfo|complementary|navigation)(?:$|[-_\s\d])", re.I)

NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: Attributes with their values up to the end of a tag: a quote counts only after an equals sign.
REST = re.compile(r"(?:[^>=]|=(?!\s*[\"'])|=\s*(?:\"[^\"]*\"|'[^']*'))*+>")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block:
    """A leaf block: its text, the slots of its path's tokens as bits, its depth, the share of its text in links, its weak label, and the tokens if they were asked for."""

    __slots__ = ("content", "depth", "linked", "path", "text", "tokens")

    def __init__(self, text: str, path: int, depth: int, linked: float, content: bool, tokens: tuple[str, ...] = ()):
        self.text, self.path, self.depth, self.linked, self.content, self.tokens = text, path, depth, linked, content, tokens


def made(text: str, tokens: tuple[str, ...], linked: float, content: bool) -> Block:
    """A block with the given path."""
    path = 0
    for t in tokens:
        path |= 1 << slot(t)
    return Block(text, path, sum(not t.startswith(".") for t in tokens), linked, content, tokens)


class Open:
    """The open elements: what is asked of all of them is counted as they come and go, so that a tag costs no walk over them."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.names: dict[str, int] = {}
        self.slots = [0] * PATH_SIZE
        self.path = self.others = self.hidden = 0

    def count(self, *names: str) -> int:
        return sum(self.names.get(n, 0) for n in names)

    def push(self, name: str, tokens: tuple[str, ...], other: bool) -> None:
        self.stack.append((name, tokens, other))
        self.names[name] = self.names.get(name, 0) + 1
        self.others += other
        self.hidden += name in HIDDEN_TEXT
        for t in tokens:
            k = slot(t)
            self.slots[k] += 1
            self.path |= 1 << k

    def pop(self) -> str:
        name, tokens, other = self.stack.pop()
        self.names[name] -= 1
        self.others -= other
        self.hidden -= name in HIDDEN_TEXT
        for t in tokens:
            k = slot(t)
            self.slots[k] -= 1
            if not self.slots[k]:
                self.path &= ~(1 << k)
        return name

    def close(self, names: tuple[str, ...] | set[str], stops: frozenset[str] = frozenset()) -> None:
        """Closes the innermost element of one of the names with all inside it, if none of ``stops`` is in between."""
        if not self.count(*names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in stops:
                return


def blocks(html: str, tokens: bool = False) -> list[Block]:
    """The leaf blocks of a page, in order: white space is one space, character references are decoded.

    One pass. What browsers would lose with the rest of the page is kept: a hidden element that is never closed
    hides nothing, and a tag with a quote that is never closed ends at its first ``>``.
    """
    out: list[Block] = []
    now = Open()
    parts: list[str] = []
    ends: dict[str, int] = {}  # where the last end tag of a name stands
    linked = at = 0
    last, loose = html.rfind(">"), False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                content = now.count("article", "main") > 0 and not now.others
                path = tuple(t for _, own, _ in now.stack for t in own) if tokens else ()
                out.append(Block(text, now.path, len(now.stack), min(1.0, linked / len(text)), content, path))
            parts.clear()
        linked = 0

    def ends_later(name: str, at: int) -> bool:
        if name not in ends:
            ends[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])", html, re.I)), default=-1)
        return ends[name] >= at

    n = len(html)
    while at < n:
        tag = html.find("<", at)
        tag = n if tag < 0 else tag
        if tag > at and not now.hidden:
            parts.append(html[at:tag])
            if now.count("a"):
                linked += tag - at
        if tag == n:
            break
        nxt = html[tag + 1 : tag + 2]
        if nxt in ("!", "?"):
            if html.startswith("<!--", tag):
                end = html.find("-->", tag + 4) if ends.get("-->", 1) else -1
                if end < 0:
                    ends["-->"] = 0  # no more of them: the comment ends with its tag
            else:
                end = -1
            if end >= 0:
                at = end + 3
            else:
                end = html.find(">", tag) if tag < last else -1
                at = end + 1 if end >= 0 else n
            continue
        closing = nxt == "/"
        m = NAME.match(html, tag + 1 + closing)
        if not m or tag > last:
            if closing and tag < last:
                at = html.find(">", tag) + 1  # an end tag without a name is a comment
                continue
            if not now.hidden:
                parts.append("<")
            at = tag + 1
            continue
        rest = None if loose else REST.match(html, m.end())
        if rest is None:
            loose = True  # some quote is not closed: from here on tags end at their first bracket
            stop = html.find(">", m.end()) + 1
            if not stop:
                at = n
                break
        else:
            stop = rest.end()
        attributes, at, name = html[m.end() : stop - 1], stop, m[0].lower()
        if closing:
            if name in BLOCK:
                flush()
            elif name == "br" and not now.hidden:
                parts.append(" ")
            now.close((name,))
            continue
        if name in RAW:
            if not SELF_CLOSED.search(attributes):
                if ends_later(name, at):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = end.end()
                else:
                    end = html.find("<", at)
                    at = end if end >= 0 else n
            if not now.hidden:
                parts.append(" ")
            continue
        if name in BLOCK:
            now.close(("head", "svg", "math"))  # what can't hold a block ends with one
            flush()
            now.close(IMPLIED.get(name, ("p",) if name not in ("option", "label", "button") else ()), STOPS - IMPLIED.get(name, set()))
        elif name == "br" and not now.hidden:
            parts.append(" ")
        if name in VOID or SELF_CLOSED.search(attributes):
            continue
        if name in HIDDEN_TEXT:
            if not now.hidden:
                parts.append(" ")
            if name != "head" and not ends_later(name, at):
                continue
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if "=" in attributes else ""
        other = name in OTHER_TAGS and not (name == "header" and now.count("article")) or bool(names and OTHER_NAMES.search(names))
        now.push(name, (name, *(f".{x}" for x in re.split(r"[\s_-]+", names) if x)), other)
    flush()
    return out


_slots: dict[str, int] = {}


def slot(token: str) -> int:
    """The feature of a path token."""
    k = _slots.get(token)
    if k is None:
        k = zlib.crc32(token.encode()) % PATH_SIZE
        if len(_slots) < 100_000:
            _slots[token] = k
    return k


def vectors(page: list[Block]) -> np.ndarray:
    """A row of features per block; all its words count."""
    out = np.zeros((len(page), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
    for i, b in enumerate(page):
        raw = np.frombuffer(b.path.to_bytes(PATH_SIZE // 8, "little"), np.uint8)
        out[i, :PATH_SIZE] = np.unpackbits(raw, bitorder="little")
        words = b.text.lower().split()
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount([zlib.crc32(w.encode()) % WORD_SIZE for w in words], minlength=WORD_SIZE) / len(words)
        out[i, PATH_SIZE + WORD_SIZE :] = np.log1p(len(b.text)) / 8, b.linked, min(b.depth, 64) / 8, b.text[-1] in ".!?…\"»”", i / max(1, len(page) - 1)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output, with its training in numpy."""

    def __init__(self, seed: int = 7):
        rng, n = np.random.default_rng(seed), PATH_SIZE + WORD_SIZE + MEASURES
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {"x" + d: f(n, 4 * HIDDEN), "h" + d: f(HIDDEN, 4 * HIDDEN), "c" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.w["c" + d][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w |= {"o": f(2 * HIDDEN, 1), "ob": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states of batch x (pages, blocks, features) in one direction; a page's padding leaves the state as it is. ``keep``: all steps' gates too, for training."""
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        own = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            g = own[:, t] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, z = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c1 = f * c + i * z
            q = np.tanh(c1)
            if keep:
                kept.append((t, i, f, o, z, q, c, h, m))
            c, h = m * c1 + (1 - m) * c, m * o * q + (1 - m) * h
            out[:, t] = h
        return out, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, d, keep=False)[0] for d in "fb"], 2)
        return 1 / (1 + np.exp(-(h @ self.w["o"] + self.w["ob"])[:, :, 0]))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = 1 / (1 + np.exp(-(h @ self.w["o"] + self.w["ob"])[:, :, 0]))
        e = ((p - y) * mask / mask.sum())[:, :, None]
        g = {"o": np.einsum("pbh,pbk->hk", h, e), "ob": e.sum((0, 1))}
        back = e * self.w["o"][:, 0]
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            own, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w["h" + d])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, i, f, o, z, q, c0, h0, m in reversed(runs[d][1]):
                dh = dh + part[:, t]
                c1 = m * dc + m * dh * o * (1 - q * q)
                gates = np.concatenate([c1 * z * i * (1 - i), c1 * c0 * f * (1 - f), m * dh * q * o * (1 - o), c1 * i * (1 - z * z)], 1)
                own[:, t] = gates
                gh += h0.T @ gates
                dh, dc = (1 - m) * dh + gates @ self.w["h" + d].T, (1 - m) * dc + c1 * f
            g |= {"x" + d: np.einsum("pbn,pbk->nk", x, own), "h" + d: gh, "c" + d: own.sum((0, 1))}
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam over batches of pages of like length, in an order that is always the same."""
        rng, first, second, step = np.random.default_rng(11), {}, {}, 0
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        cuts = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
        for _ in range(EPOCHS):
            for k in rng.permutation(len(cuts)):
                x, mask = padded([p for p, _ in cuts[k]])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, own) in enumerate(cuts[k]):
                    y[i, : len(own)] = own
                step += 1
                for n, g in self.gradients(x, mask, y).items():
                    first[n] = 0.9 * first.get(n, 0) + 0.1 * g
                    second[n] = 0.999 * second.get(n, 0) + 0.001 * g * g
                    self.w[n] = (self.w[n] - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is content."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= 8192:
                b += 1
            x, mask = padded([pages[k] for k in order[a:b]])
            p = self.probabilities(x, mask) > 0.5
            for i, k in enumerate(order[a:b]):
                out[k] = p[i, : len(pages[k])]
            a = b
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((len(pages), n, PATH_SIZE + WORD_SIZE + MEASURES), np.float32), np.zeros((len(pages), n), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


#: Parts put into disguised pages: path tokens of each kind, and how many blocks.
PARTS = (
    (("aside", ".sidebar"), "li", 4), (("div", ".sidebar"), "p", 2), (("div", ".comments"), "p", 3), (("section", ".comments"), "li", 3), (("div", ".comment"), "p", 2),
    (("div", ".cookie", ".notice"), "p", 1), (("div", ".notice"), "p", 1), (("form",), "label", 3), (("form", ".newsletter"), "p", 1), (("div", ".ad"), "p", 1), (("aside",), "p", 2),
    (("header", ".site", ".header"), "a", 2), (("div", ".menu"), "li", 5), (("div", ".related"), "li", 3), (("div", ".footer"), "p", 2), (("div", ".share"), "a", 3), (("div", ".popup"), "p", 1),
)
HOMES = (("article",), ("main",), ("main", "article"), ("article", "section"), ("div", ".content"), ("div", ".main"), ("div", ".post"), ("div", ".entry", ".content"), ("article", "div", ".body"))


#: Elements that say nothing of what part of a page they are.
PLAIN = frozenset("html body p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 a pre blockquote table tr td th figure figcaption span".split())


def blinded(page: list[Block]) -> list[Block]:
    """The page without the names that its labels were taken from: other elements are divs, and no class, id or role is left."""
    return [made(b.text, tuple(t if t in PLAIN else "div" for t in b.tokens if not t.startswith(".")), b.linked, b.content) for b in page]


def disguised(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with its article in another element and further parts around and inside it."""
    home, seen = HOMES[rng.integers(len(HOMES))], [b for b in page if b.content]
    words = [w for b in page for w in b.text.split()]
    out: list[Block] = []

    def part() -> list[Block]:
        where, leaf, n = PARTS[rng.integers(len(PARTS))]
        outer = ("html", "body", *(home if rng.random() < 0.4 else ()), *where)
        more = []
        for _ in range(n):
            at, size = int(rng.integers(len(words))), int(rng.integers(1, 30))
            more.append(made(" ".join(words[at : at + size]) or "x", (*outer, leaf), float(leaf in ("a", "li")) * float(rng.random() < 0.7), False))
        return more

    for b in page:
        if b.content:
            k = b.tokens.index("article") if "article" in b.tokens else b.tokens.index("main") if "main" in b.tokens else 0
            leaf = b.tokens[k + 1 :] if rng.random() < 0.8 else (*b.tokens[k + 1 :], ("blockquote", "ul", "section", "figure")[rng.integers(4)])
            out.append(made(b.text, (*b.tokens[:k], *home, *leaf), b.linked, True))
            if rng.random() < 0.5 / max(1, len(seen)):
                out += part()
        else:
            out.append(b)
    front = [x for _ in range(rng.integers(0, 3)) for x in part()]
    back = [x for _ in range(rng.integers(0, 3)) for x in part()]
    return [*front, *out, *back]


def stretched(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with an article of up to 60 blocks more, of its own words; half the time without what comes before or after."""
    words = [w for b in page for w in b.text.split()]
    seen = [k for k, b in enumerate(page) if b.content]
    first, last = seen[0], seen[-1]
    more = []
    for _ in range(int(rng.integers(15, 60))):
        b = page[seen[rng.integers(len(seen))]]
        at, size = int(rng.integers(len(words))), int(rng.integers(4, 40))
        more.append(made((" ".join(words[at : at + size]) or "x") + ("." if rng.random() < 0.8 else ""), b.tokens, 0.0, True))
    return [*(page[:first] if rng.random() < 0.5 else []), page[first], *more, *page[first + 1 : last + 1], *(page[last + 1 :] if rng.random() < 0.5 else [])]


def sample(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """The html of the pages to train on: the least by hash, so always the same ones."""
    hashed = pages.filter(F.octet_length("html") <= SAMPLE_BYTES).select(F.xxhash64("html").alias("h"), "html")
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(n).collect()]
    if not least:
        return []
    rows = hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: r.h)]


def trained(htmls: list[str]) -> Labeller:
    rng, model = np.random.default_rng(5), Labeller()
    cases = []
    for h in htmls:
        page = blocks(h, tokens=True)
        if any(b.content for b in page):
            cases += [page, disguised(page, rng), disguised(page, rng), blinded(page)]
            if len(cases) % 3 == 1:
                cases.append(stretched(page, rng))
    model.train([(vectors(p), np.array([b.content for b in p], np.float32)) for p in cases])
    return model


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per page: page_id, url, text (the content blocks, one a line), n_chars."""
    model = model or trained(sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cut = [blocks(h or "") for h in part.column("html").to_pylist()]
                kept = model.label([vectors(p) for p in cut])
                texts = ["\n".join(b.text for b, k in zip(p, own, strict=True) if k) for p, own in zip(cut, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
