"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks. Each is described by the names on its path
(tags, classes, ids), its words and a few numbers; a network of long short-term
memory reads the sequence from both sides and says which blocks are the
article, so that every decision sees the whole page.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import chain
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.llm.common import by_batch
from marginlake.llm.recurrent import Adam, SequenceLabeller

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template head title noscript iframe object svg canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements that end an open element of their kind, up to the nearest of these containers.
CLOSED_BY = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = BLOCKS - {"button", "label", "select", "option", "optgroup", "legend"}
CONTAINERS = frozenset(
    "article aside blockquote body div dl fieldset figure footer form header html main menu nav ol section table td th ul".split()
)

MARKS, WORDS, UNITS = 2048, 1024, 12


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    link_chars: int


def _names(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, ...]:
    out = [tag]
    for k, v in attrs:
        if k in ("class", "id", "role", "itemprop") and v:
            out += ["=" + x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if x]
        elif k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            out.append("=hidden")
    return tuple(out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, names, and the different names on the way to them, the innermost first.
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []
        self.unread = 0
        self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, names, above = self.stack[-1] if self.stack else ("", (), ())
                self.blocks.append(Block(tuple(dict.fromkeys(names + above)), text, self.link_chars))
            self.parts, self.link_chars = [], 0

    def _pop(self, count: int) -> None:
        for tag, *_ in self.stack[len(self.stack) - count :]:
            self.unread -= tag in UNREAD
            self.links -= tag == "a"
        del self.stack[len(self.stack) - count :]

    def _close(self, tags: set[str] | frozenset[str]) -> None:
        for k, (tag, *_) in enumerate(reversed(self.stack)):
            if tag in tags:
                self._pop(k + 1)
                return
            if tag in CONTAINERS:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P:
                self._close({"p"})
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag == "body":
            # What only a head may hold ends here, closed or not.
            while self.unread:
                self._pop(1)
        if tag not in VOID:
            names, above = _names(tag, attrs), self.stack[-1][2] if self.stack else ()
            # Nested elements of the same names share one list: depth alone costs nothing.
            new = tuple(n for n in dict.fromkeys(names) if n not in above)
            self.stack.append((tag, names, new + above if new else above))
            self.unread += tag in UNREAD
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("svg", "path") or self.stack and self.stack[-1][0] == tag and tag not in BLOCKS):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k, (open_, *_) in enumerate(reversed(self.stack)):
            if open_ == tag:
                self._pop(k + 1)
                return
            if tag not in CONTAINERS and open_ in CONTAINERS:
                return

    def parse_marked_section(self, i, report=1):
        """``<![...`` up to the next ``>`` is a comment in HTML, whatever it says; without one, all that follows."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_data(self, data):
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in its order: path from the inside out, text with single blanks, characters in links."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def _bucket(name: str | bytes, size: int) -> int:
    return xxhash.xxh32_intdigest(name) % size


class Buckets(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name):
        if len(self) > 200_000:
            self.clear()
        found = self[name] = _bucket(name, self.size)
        return found


NUMBERS = 6


def bags(pages: list[list[Block]], marks: Buckets) -> tuple:
    """Marks, words and numbers of all blocks of some pages, one page behind the other."""
    mark, word, sizes, numbers = [], [], [], []
    for page in pages:
        for k, b in enumerate(page):
            # The innermost name counts twice: by itself and as the innermost.
            own = [marks[n] for n in dict.fromkeys(b.path)] + [marks[f"0:{n}"] for n in b.path[:1]]
            tokens = b.text.lower().encode("utf-8", "surrogatepass").split()
            chars, count = len(b.text), max(1, len(tokens))
            mark += own
            word.append(tokens)
            sizes.append(len(own))
            numbers.append(
                (
                    math.log1p(count) / 5,
                    min(1.0, b.link_chars / chars),
                    1.0 if b.text[-1] in ".!?:;\"'”»" else 0.0,
                    (b.text.count(".") + b.text.count(",")) / count,
                    (k + 1) / len(page),
                    math.log1p(chars / count) / 3,
                )
            )
    counts = np.fromiter(map(len, word), np.int64, len(word))
    hashed = np.fromiter(map(xxhash.xxh32_intdigest, chain.from_iterable(word)), np.int64, int(counts.sum()))
    return (
        (np.array(mark, np.int64), np.array(sizes, np.int64)),
        (hashed % WORDS, counts),
        np.array(numbers, np.float32).reshape(-1, NUMBERS),
    )


def joined(parts: list[tuple]) -> tuple:
    """The bags of several lists of pages as one."""
    together = lambda i, j: np.concatenate([p[i][j] for p in parts])
    return (together(0, 0), together(0, 1)), (together(1, 0), together(1, 1)), np.concatenate([p[2] for p in parts])


# ---- training pages

# Names that sites give to parts of a page, and words in them: what the labeller learns from.
MAIN_NAMES = (
    "content post entry article story body text main page article-body post-content entry-content story-body "
    "main-content blog-post prose markdown news detail hentry rich-text articleBody single paper copy"
).split()
PARTS = {
    "menu": ("nav menu navbar navigation main-menu site-nav topnav breadcrumb breadcrumbs tabs toolbar pagination pager toc", "home about contact news products services blog help login search next previous archive"),
    "header": ("header masthead site-header top banner page-header logo branding topbar title-bar tagline", "welcome the official site of daily your guide to"),
    "footer": ("footer site-footer bottom colophon page-footer legal copyright credits foot", "© copyright all rights reserved privacy policy terms of use imprint powered by contact"),
    "sidebar": ("sidebar side aside widget widget-area secondary right-rail rail related related-posts recommended trending popular tags tag-cloud author-box bio more-stories teaser", "related popular recent posts read more also trending categories tags archives follow us"),
    "notice": ("cookie cookie-banner notice consent gdpr alert message disclaimer banner-notice popup modal overlay newsletter subscribe-box paywall promo-bar announcement", "we use cookies to accept agree consent privacy this site by continuing settings subscribe now"),
    "advert": ("ad ads advert advertisement ad-slot ad-container sponsored sponsor promo promoted banner-ad adsense dfp commercial partner affiliate", "advertisement sponsored buy now offer sale discount click here limited shop deal"),
    "form": ("form search-form subscribe signup login newsletter-form contact-form register input-group", "email name password submit send subscribe sign up search your address"),
    "comment": ("comments comment comment-list commentlist comment-body reply respond discussion disqus responses replies reviews reader-comments user-comments", "reply posted by says comment great thanks agree wrote ago like report"),
    "share": ("share social sharing share-buttons social-links follow print-link tools actions", "share tweet facebook email print like save"),
}
OWN_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class PageMaker:
    """Invented pages with a label for each block."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def word(self) -> str:
        return "".join(map(self.pick, ["bcdfghjklmnprstvwz", "aeiouäéó"] * int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int, some: list[str] = (), share: float = 0.0) -> str:
        n = int(self.rng.integers(low, high))
        return " ".join(self.pick(some) if len(some) and self.rng.random() < share else self.word() for _ in range(n))

    def prose(self) -> str:
        if self.rng.random() < 0.15:
            return self.words(1, 8).capitalize() + self.pick([".", ".", "", ":"])
        noise = self.pick(["", "", "", "", "$$$ ", "%%% ", "| ", "!! "])
        return " ".join(self.words(2, 24).capitalize().replace(" ", " " + noise) + self.pick([".", ".", ".", "!", "?"]) for _ in range(int(self.rng.integers(1, 7))))

    def _chain(self, name: str) -> tuple[str, ...]:
        """Names of one element, by chance with a second name and a framework's classes."""
        out = [self.pick(["div", "div", "div", "section"])]
        if self.rng.random() < 0.85:
            out += ["=" + x.lower() for x in re.split(r"[-]", re.sub(r"([a-z])([A-Z])", r"\1-\2", name))]
        if self.rng.random() < 0.3:
            out += ["=" + self.pick(["container", "wrapper", "row", "col", "box", "inner", "block", "section", "clearfix", "module", "x1", "css"])]
        return tuple(out)

    def part(self, kind: str, outer: tuple[str, ...]) -> list[tuple[Block, int]]:
        names, said = PARTS[kind]
        own, rng = OWN_TAGS.get(kind), self.rng
        box = (own,) if own and rng.random() < 0.7 else ()
        if not box or rng.random() < 0.4:
            named = self._chain(self.pick(names.split()))
            if len(named) == 1 and not box:
                named = (named[0], "=" + self.pick(names.split()).split("-")[0])
            box = (*named[1:], *box) if box and rng.random() < 0.5 else (*named, *box)
        path = (*box, *outer)
        said = said.split()
        out = []
        if rng.random() < 0.3:  # a heading of its own
            out.append((Block((self.pick(["h2", "h3", "h4"]), *path), self.words(1, 4, said, 0.8), 0), 0))
        for _ in range(int(rng.integers(1, 9 if kind in ("menu", "comment", "sidebar", "footer") else 4))):
            prose = kind in ("comment", "advert", "notice", "sidebar", "footer") and rng.random() < 0.55
            text = self.prose() if prose else self.words(1, 7, said, rng.random())
            link = len(text) if kind in ("menu", "share") and rng.random() < 0.9 or rng.random() < 0.3 else 0
            inner = self.pick([("li", "ul"), ("p",), ("span",), (), (), ("div",), ("li", "ol"), ("h3",), ("h2",), ("td", "tr", "table")])
            if kind == "form":
                inner = self.pick([("label",), ("button",), ("option", "select"), ("p",), ()])
            inner = (("a", *inner) if link else inner)
            out.append((Block((*inner, *path), text, link), 0))
        return out

    def article(self, outer: tuple[str, ...]) -> list[tuple[Block, int]]:
        rng = self.rng
        box = self.pick([("article",), ("article",), ("main",), ("article", "main"), ("section",), ()])
        if not box or rng.random() < 0.4:
            box = (*self._chain(self.pick(MAIN_NAMES)), *box)
        path = (*box, *outer)
        out = []
        if rng.random() < 0.8:
            head = ("header",) if rng.random() < 0.12 else ()
            out.append((Block((self.pick(["h1", "h1", "h2"]), *head, *path), self.words(1, 14).capitalize() + self.pick(["", "."]), 0), 1))
        for _ in range(int(rng.integers(1, 22))):
            r = rng.random()
            if r < 0.68:
                out.append((Block((*self.pick([("p",), ("p",), ("p",), ("b", "p"), ("div",), ("em", "p"), ()]), *path), self.prose(), 0), 1))
            elif r < 0.78:
                out.append((Block((self.pick(["h2", "h3", "h4"]), *path), self.words(1, 8), 0), 1))
            elif r < 0.85:
                for _ in range(int(rng.integers(2, 6))):
                    out.append((Block(("li", self.pick(["ul", "ol"]), *path), self.words(2, 20), 0), 1))
            elif r < 0.9:
                out.append((Block((*self.pick([("blockquote",), ("p", "blockquote"), ("figcaption", "figure"), ("td", "tr", "table"), ("pre",)]), *path), self.prose(), 0), 1))
            else:
                out += self.part(self.pick(["advert", "advert", "share", "sidebar", "notice", "form", "comment"]), path)
        return out

    def page(self) -> list[tuple[Block, int]]:
        rng, outer = self.rng, ("body", "html")
        bare = rng.random() < 0.25  # few parts besides the article
        if rng.random() < 0.4:
            outer = (*self._chain(self.pick(["page", "wrapper", "site", "container", "main", "layout", "app"])), *outer)
        before = [k for k in ("header", "menu", "notice", "advert", "menu", "share") if rng.random() < (0.25 if bare else 0.5)]
        after = [k for k in ("share", "sidebar", "comment", "form", "advert", "sidebar", "notice", "footer", "footer") if rng.random() < (0.25 if bare else 0.5)]
        rng.shuffle(before)
        out = [x for k in before for x in self.part(k, outer)]
        out += self.article(outer)
        if rng.random() < 0.1:
            out += self.article(outer)
        return out + [x for k in after for x in self.part(k, outer)]


#: Training: invented pages, passes over them, pages in a batch.
PAGES, PASSES, BATCH, RATE = 2500, 6, 40, 0.02


def train(pages: int = PAGES, passes: int = PASSES, seed: int = 3) -> SequenceLabeller:
    """A labeller from invented pages; the same each time."""
    maker = PageMaker(seed)
    marks, data = Buckets(MARKS), []
    for _ in range(pages):
        page = maker.page()
        data.append((bags([[b for b, _ in page]], marks), [y for _, y in page]))
    model = SequenceLabeller(MARKS, WORDS, NUMBERS, UNITS)
    adam, rng, done, total = Adam(model.params, RATE), np.random.default_rng(seed), 0, passes * -(-pages // BATCH)
    for _ in range(passes):
        order = rng.permutation(pages)
        for i in range(0, pages, BATCH):
            some = [data[k] for k in order[i : i + BATCH]]
            y = np.array([v for _, ys in some for v in ys], np.float32)
            lengths = np.array([len(ys) for _, ys in some])
            _, grads = model.gradients(joined([d for d, _ in some]), lengths, y)
            adam.step(grads, 1 - 0.9 * done / total)
            done += 1
    return model


def label(model: SequenceLabeller, pages: list[list[Block]], marks: Buckets) -> list[np.ndarray]:
    """Probability of being article for each block of each page."""
    lengths = np.array([len(p) for p in pages], np.int64)
    some = lengths > 0
    if not some.any():
        return [np.empty(0) for _ in pages]
    prob = model.probabilities(bags(pages, marks), lengths[some])
    ends = np.cumsum(lengths)
    return [prob[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def extract(pages: DataFrame, model: SequenceLabeller, html: str = "html") -> DataFrame:
    """``pages`` without the html, with text (main text) and n_chars (its code points).

    Null and empty html, and pages without an article block, have empty text.
    Every block is labelled and kept whole or dropped whole. Columns text and
    n_chars are replaced.
    """

    def make():
        marks = Buckets(MARKS)

        def step(cols):
            texts = []
            raw = cols.pop("__html")
            for some in together(raw.to_pylist()):
                read = [blocks(h) for h in some]
                for page, prob in zip(read, label(model, read, marks), strict=True):
                    texts.append(" ".join(b.text for b, p in zip(page, prob, strict=True) if p >= 0.5))
            return cols | {"text": texts, "n_chars": list(map(len, texts))}

        return step

    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{html}`").cast("string").alias("__html"))
    return by_batch(rows, make, [*((f.name, f.dataType) for f in keep), ("text", "string"), ("n_chars", "long")])


def together(pages: list, size: int = 2_000_000):
    some, held = [], 0
    for p in pages:
        some.append(p)
        held += len(p or "")
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some
