"""Main text of HTML pages.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link density, those of the two blocks
before and the two after it, and what tags and names say of its place (in an article, in something named like one, beside it,
in a menu, notice, form and so on). A decision tree over these numbers, fitted to a small labelled table, keeps or drops the
block. A third of that table are pages that name nothing, so there the counts and densities alone decide.

A page takes time in proportion to its length, however deep its elements are nested.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block, that hold no text to read, and that have no end tag.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template textarea svg math iframe object canvas audio video title head".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id and role, that stand for what isn't the article, and for what is.
OUTER_TAGS = frozenset("nav footer aside form menu dialog button select option label fieldset search".split())
OUTER = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer footnav header masthead topbar sidebar aside complementary ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations teaser comment comments commentlist respond reply replies disqus form widget toolbar pagination pager copyright contentinfo legal disclaimer skip dialog".split()
)
INNER = frozenset("article main content post entry story body text articlebody maincontent postcontent".split())
#: Elements, and words of class, id and role, that an article in them doesn't cancel; words of a name after which the next ones say nothing.
CLOSED_TAGS = OUTER_TAGS - {"form", "fieldset", "search"}
CLOSED = frozenset("comment comments commentlist respond reply replies disqus ad ads adv advert adverts advertisement advertising sponsor sponsored related recommended recommendations teaser promo promotion".split())
ABOUT = re.compile(r"(?:has|have|no|not|non|with|without)$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A comment, a declaration or a tag; what the end of the page cuts off goes to its end.
TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|$)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WHITE = re.compile(r"\s+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


#: Kinds of an element that isn't part of the article.
OPEN, WORDED, SHUT = 1, 2, 3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    inner: bool
    strong: bool
    outer: bool
    wrapped: bool = False
    numbers: tuple = field(default=())


def _tokens(value: str) -> set[str]:
    """Words of the names in a class, id or role; those after "has", "no" or "with" tell of the page, not of the element."""
    names = (TOKEN.findall(name) for name in value.split())
    return {t.lower() for name in names for t in itertools.takewhile(lambda t: not ABOUT.match(t), name)}


def _place(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element begins the article, and whether something that isn't part of it: OPEN ends where an article begins, WORDED may, SHUT doesn't."""
    if tag in ("html", "body", "head"):
        return False, 0
    tokens = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return False, SHUT
        if name != "style":
            tokens |= _tokens(value)
    inner, outer = tag in ("article", "main") or bool(tokens & INNER), tag in OUTER_TAGS or bool(tokens & OUTER)
    if outer and tag in ("article", "main"):
        outer = bool(tokens & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "related", "teaser", "promo"})
    if not outer:
        return inner, 0
    return False, SHUT if tag in CLOSED_TAGS else WORDED if tokens & CLOSED else OPEN


class _Page:
    """What is open while a page is read: elements, and how many of each tag and kind."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple] = []
        self.open: Counter = Counter()
        self.inside = self.strong = self.links = self.silent = 0
        self.outside = (0, 0, 0, 0)
        self.text: list[str] = []
        self.linked: list[str] = []
        self.heading = False

    def close(self) -> None:
        """End a block."""
        body = WHITE.sub(" ", "".join(self.text)).strip()
        if body:
            beside = self.open["header"] > 0 and not (self.inside > 0 and self.heading)
            outer, wrapped = sum(self.outside) > 0 or beside, self.outside[0] > 0 and sum(self.outside[1:]) == 0 and not beside
            words, linked = len(body.split()), len("".join(self.linked).split())
            self.out.append(Block(body, words, linked, self.heading, self.inside > 0, self.strong > 0, outer, wrapped))
        self.text.clear()
        self.linked.clear()
        self.heading = False

    def say(self, raw: str) -> None:
        if raw and not self.silent:
            x = entities.unescape(raw)
            self.text.append(x)
            if self.links:
                self.linked.append(x)

    def push(self, tag: str, attributes: str) -> None:
        inner, outer = _place(tag, attributes)
        # What was open around it comes back at its end.
        self.stack.append((tag, inner, self.outside))
        self.open[tag] += 1
        article = tag in ("article", "main")
        if not outer and article:
            self.outside = (self.outside[0] + self.outside[WORDED], 0, 0, self.outside[SHUT])
        elif outer:
            self.outside = tuple(n + (k == outer) for k, n in enumerate(self.outside))
        self.count(tag, inner, 1)

    def pop(self) -> str:
        tag, inner, self.outside = self.stack.pop()
        self.open[tag] -= 1
        self.count(tag, inner, -1)
        return tag

    def pop_to(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def count(self, tag: str, inner: bool, by: int) -> None:
        self.inside += by * inner
        self.strong += by * (inner and tag in ("article", "main"))
        self.links += by * (tag == "a")
        self.silent += by * (tag in SILENT)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, without empty ones."""
    x = _Page()
    at, raw_until = 0, None
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        tag = (m[2] or "").lower()
        if raw_until:
            if m[1] and tag == raw_until:
                at = m.end()
            else:
                # An end tag may hide in what looks like another tag or a comment.
                end = re.compile(rf"</{raw_until}\b[^>]*>", re.I).search(page, at)
                if not end:
                    break
                at = end.end()
            raw_until = None
            x.pop()
            continue
        x.say(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if m[1]:
            if x.open[tag]:
                if tag in BLOCK:
                    x.close()
                x.pop_to(tag)
            elif tag in BLOCK:
                x.close()
            continue
        if tag == "br":
            x.say(" ")
        if tag in BLOCK:
            x.close()
            while x.open["p"]:  # a block ends an open paragraph, and what was left open in it
                x.pop_to("p")
            if tag in ("li", "option", "dt", "dd", "tr", "td", "th") and x.stack and x.stack[-1][0] == tag:
                x.pop()
            x.heading = tag in HEADINGS
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in BLOCK and tag != "a":
            continue
        x.push(tag, m[3])
        if tag in RAW:
            raw_until = tag
    if not raw_until:
        x.say(page[at:])
    x.close()
    return measured(x.out)


#: What the tree sees of a block, in order: counts and densities first, of itself and of those at -2, -1, 1 and 2; then its place.
NUMBERS = ("words", "density", "words-2", "density-2", "words-1", "density-1", "words+1", "density+1", "words+2", "density+2", "inner", "outer", "beside")


def measured(found: list[Block]) -> list[Block]:
    density = [b.linked / b.words for b in found]
    # A name such as "related" around an article stands for what isn't the main text, unless that has most of the page's words.
    if not any(b.inner and not b.outer for b in found) and 2 * sum(b.words for b in found if b.wrapped) >= sum(b.words for b in found):
        for b in found:
            b.outer = b.outer and not b.wrapped
    main = any(b.strong and not b.outer for b in found)
    for k, b in enumerate(found):
        around = ((found[j].words, density[j]) if 0 <= j < len(found) else (0, 0.0) for j in (k - 2, k - 1, k + 1, k + 2))
        place = 2 if b.strong else int(b.inner)
        b.numbers = (b.words, density[k], *itertools.chain.from_iterable(around), place, int(b.outer), int(main and not b.strong))
    return found


def say(mark: str, n: int) -> str:
    """A text of n words that begins with K (keep) or D (drop)."""
    return " ".join([mark, *(f"w{i}" for i in range(n - 1))])


def bare(seed: int, pages: int) -> list[str]:
    """Pages without a tag or name that says what is what: menus, notices, adverts, an article, more links, a footer."""
    rnd, out = random.Random(seed), []
    link = lambda n: f'<a href="#">{say("D", n)}</a>'
    for _ in range(pages):
        menu = "".join(f"<div>{link(rnd.randint(1, 3))}</div>" for _ in range(rnd.randint(3, 8)))
        notice = f"<div>{say('D', rnd.randint(6, 18))} {link(rnd.randint(1, 3))}</div>"
        advert = f"<div>{say('D', rnd.randint(3, 14))}</div>"
        more = "".join(f"<p>{link(rnd.randint(3, 9))}</p>" for _ in range(rnd.randint(3, 6)))
        foot = f"<p>{say('D', rnd.randint(2, 14))}" + f" {link(1)}" * rnd.randint(0, 4) + "</p>"
        prose = [f"<p>{say('K', rnd.randint(18, 120))}</p>" for _ in range(rnd.randint(2, 7))]
        for k in range(1, len(prose)):
            short = rnd.choice((f"<h2>{say('K', rnd.randint(1, 9))}</h2>", f"<p>{say('K', rnd.randint(1, 15))}</p>", ""))
            some = f"<p>{say('K', rnd.randint(20, 60))} <a href='#'>{say('L', rnd.randint(1, 5))}</a> {say('w', rnd.randint(4, 30))}</p>"
            prose[k] = short + rnd.choice((prose[k], prose[k], some))
        title = f"<h1>{say('K', rnd.randint(2, 12))}</h1>" if rnd.random() < 0.8 else ""
        top = rnd.choice(("", menu, menu + advert, menu + notice, menu))
        end = rnd.choice(("", foot, more + foot, more, menu + foot))
        out.append(f"<div>{top}</div><div>{title}{''.join(prose)}</div><div>{end}</div>")
    for n in (1, 2, 3, 5, 9, 15, 25, 50, 120):
        out += [f"<p>{say('K', n)}</p>", f"<h1>{say('K', n)}</h1><p>{say('K', 30)}</p>"]
    return out


def named(seed: int, pages: int) -> list[str]:
    """Pages whose text column has a name, but holds menus and links that have none."""
    names = ("content", "main-content", "post-body", "entry", "story text")
    split = '</div><div class="{}">'
    out = []
    for k, page in enumerate(bare(seed, pages)[:pages]):
        name = names[k % len(names)]
        out.append(page.replace("</div><div>", split.format(name), 1) if k % 2 else f'<div class="{name}">{page}</div>')
    return out


def told() -> list[str]:
    """Pages with an article, and with tags and names for what is around it."""
    link = lambda n: f'<a href="#">{say("D", n)}</a>'
    rows = []
    for n in (1, 2, 4, 9, 25, 80):
        prose = "".join(f"<p>{say('K', k)}</p>" for k in (60, n, 35, 2, n, 50))
        menu = "<ul>" + f"<li>{link(n)}</li>" * 4 + "</ul>"
        around = [
            f"<nav>{menu}</nav>",
            f"<header><p>{say('D', n)}</p></header>",
            f"<footer>{say('D', n)} {link(2)}</footer>",
            f'<div class="ad">{say("D", n)}</div>',
            f"<aside><h3>{say('D', 2)}</h3><p>{say('D', n)}</p></aside>",
            f'<div class="cookie-notice"><p>{say("D", n)}</p></div>',
            f"<form><label>{say('D', n)}</label></form>",
            f'<div class="comments"><p>{say("D", n)}</p><p>{say("D", 40)}</p></div>',
        ]
        linked = f"<p><a href='#'>{say('K', n)}</a></p><ul><li><a href='#'>{say('K', 3)}</a></li><li>{say('K', n)}</li></ul>"
        for k, x in enumerate(around):
            y = around[(k + 3) % len(around)]
            rows.append(f"{x}<article><h1>{say('K', 1 + n % 12)}</h1>{prose}</article>{y}")
            rows.append(f"{x}<article>{prose}{y}<p>{say('K', n)}</p></article><p>{say('D', n)}</p>")
            rows.append(f"<article><p>{say('K', n)}</p></article>{x}")
            rows.append(f"{y}<article><p>{say('K', 30)}</p>{linked}</article>{x}")
            rows.append(f"{x}<div><h1>{say('K', 6)}</h1><p>{say('K', 60)}</p><p>{say('K', 30 + n)}</p></div>{y}")
        for name in ("layout has-sidebar", "no-ads", "with-comments", "social-science", "legal-text"):
            rows.append(f'<div class="{name}">{around[0]}<article><h1>{say("K", 5)}</h1>{prose}</article>{around[4]}</div>')
    return rows


def rows_of(pages: list[str]) -> list[tuple[tuple, int]]:
    return [(b.numbers, int(b.text.startswith("K"))) for page in pages for b in blocks(page)]


def labelled() -> list[tuple[tuple, int]]:
    """The labelled table: (numbers, keep 0/1), some thousand blocks of pages that are put together by rule."""
    return rows_of(3 * told() + bare(1, 160) + named(2, 80))


def grow(rows: list[tuple[tuple, int]], depth: int, least: int = 4):
    """A binary tree by Gini impurity: (feature, border, low, high), or the share of kept rows in a leaf of `least` rows or more."""
    kept = sum(y for _, y in rows)
    if depth == 0 or kept in (0, len(rows)):
        return kept / max(1, len(rows))
    best = None
    for f in range(len(rows[0][0])):
        ordered = sorted((x[f], y) for x, y in rows)
        left = n = 0
        for k in range(len(ordered) - 1):
            n, left = n + 1, left + ordered[k][1]
            if ordered[k][0] == ordered[k + 1][0] or n < least or len(ordered) - n < least:
                continue
            right, m = kept - left, len(ordered) - n
            impurity = left * (n - left) / n + right * (m - right) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (ordered[k][0] + ordered[k + 1][0]) / 2)
    if best is None:
        return kept / len(rows)
    _, f, border = best
    low, high = ([r for r in rows if (r[0][f] > border) == side] for side in (False, True))
    return f, border, grow(low, depth - 1, least), grow(high, depth - 1, least)


@functools.cache
def fitted(depth: int = 9):
    return grow(labelled(), depth)


def keeps(tree, numbers: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if numbers[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree) -> str:
    return "\n\n".join(b.text for b in blocks(page or "") if keeps(tree, b.numbers))


def extracted(pages: DataFrame, html: str = "html", depth: int = 9) -> DataFrame:
    """The columns of `pages` but the html (and any text or n_chars), with text and n_chars.

    Null and empty html gives an empty text; repeated rows stay, and each page is judged by itself.
    """
    tree = fitted(depth)
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    x = pages.select(*rest, F.col(html).alias("text"))

    def extract(batches):
        for b in batches:
            new = pa.array([main_text(x.as_py(), tree) for x in b["text"]], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else b.column(k) for k, c in enumerate(b.schema.names)], names=b.schema.names)

    return x.mapInArrow(extract, x.schema).withColumn("n_chars", F.length("text").cast("long"))
