"""Main text of web pages from templates deduced per host by equivalence classes.

Tokens of a page are its block tags, each with its path of tags and classes, and its text blocks with the path they
stand at. Per host, tokens that occur once on each page they are on are grouped by the vector of pages they occur on
(kept as an XOR of page hashes, so a hot host is summed up before the shuffle). Classes on at least `SHARE` of the
host's distinct pages are candidates, which bounds them by the tokens of a page. A class is valid if its tokens keep
their order on every page and it lies inside one gap of the host's largest class on every page; valid classes nested
in that one are the host's template. Its tags are the frame of the pages and its texts are boilerplate.

What the frame leaves open are the slots. Text of a slot is article text by the strongest sign that the page has:
inside <article>, inside <main> (or role=main), inside an element named as an article, inside one named as content;
with none of these the innermost slot with half of the text that is no link. Elements of navigation, headers, footers, sidebars,
notices, adverts, forms and comments are left out by tag, role or class name, and so are template texts that stand on
`CONSTANT` of at least `LEAST_PAGES` distinct pages of the host. A host with fewer pages has no evidence for a template:
each of its pages is its own frame. Paragraphs that copies or quotations repeat on some pages of a host are kept.

Pages without a tag or text count for no template. Null or empty html gives the empty text; null urls are one host; repeated rows count once for the template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, stored
from .tokens import slices

SHARE = 0.3
CONSTANT = 0.9
LEAST_PAGES = 5
#: Hosts whose templates are broadcast together (about a kilobyte each).
BROADCAST_HOSTS = 20_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template iframe object svg math select option title head canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article body div main section table tbody td tr center".split())
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead topbar toolbar footer foot copyright sidebar sidenav aside rail ad ads advert adverts "
    "advertisement advertising adsense banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager widget widgets comment comments commentlist disqus respond responses replies reply discussion feedback form search skip disclaimer legal cta".split())
# Of these, words that also name a layout around the article.
LAYOUT_WORDS = frozenset("nav navbar navigation menu header masthead topbar toolbar footer sidebar sidenav aside rail search banner widget".split())
STRONG_WORDS = frozenset("article articlebody articletext post entry story".split())
WEAK_WORDS = frozenset("content main maintext bodytext text".split())
NEGATIONS = frozenset("has with without no not is".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


def named(attributes: dict[str, str]) -> tuple[int, int]:
    """Whether class, id or role name an aside (1: by a word that may name a layout, 2: surely), and how strongly the article (0 to 3)."""
    role = attributes.get("role", "").lower()
    aside, level = 2 * (role in ASIDE_ROLES), 3 if role == "main" or attributes.get("itemprop", "").lower() == "articlebody" else 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        aside = 2
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or not NEGATIONS.isdisjoint(words):
            continue
        if found := ASIDE_WORDS.intersection(words):
            aside = max(aside, 1 if found <= LAYOUT_WORDS else 2)
        elif not STRONG_WORDS.isdisjoint(words) or "".join(words) in STRONG_WORDS:
            level = max(level, 2)
        elif not WEAK_WORDS.isdisjoint(words):
            level = max(level, 1)
    return aside, level


class Element:
    __slots__ = ("tag", "path", "aside", "level", "inline", "number")

    def __init__(self, tag: str, path: int, aside: int, level: int, inline: bool, number: int):
        self.tag, self.path, self.aside, self.level, self.inline, self.number = tag, path, aside, level, inline, number


class Block:
    """A text block: where it stands, whether in an aside, how strongly in an article, how much of it is links.

    `apart`: in an aside that lies inside the outermost <article> or <main>, or in one that is no layout.
    """

    __slots__ = ("text", "token", "aside", "apart", "level", "containers", "linked")

    def __init__(self, text, token, stack, linked):
        self.text, self.token, self.linked = text, token, linked
        self.aside = any(e.aside for e in stack)
        self.level = max(e.level for e in stack)
        outermost = next((i for i, e in enumerate(stack) if e.level >= 3), len(stack))
        self.apart = any(e.aside > (i < outermost) for i, e in enumerate(stack))
        self.containers = [(e.path, e.number) for e in stack if e.tag in CONTAINERS]


def hashed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) >> 2


def read_page(page: str | None) -> tuple[list[int], list[Block]]:
    """Tokens of a page in order (even: tag, odd: text block) and its text blocks."""
    page = page or ""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack = [Element("", 0, 0, 0, False, 0)]
    pieces: list[str] = []
    links = at = linked = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                path = next(e.path for e in reversed(stack) if not e.inline)
                token = hashed(path, text) * 2 + 1
                tokens.append(token)
                blocks.append(Block(text, token, stack, linked / len(text)))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            links -= stack.pop().tag == "a"

    while at < size:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        inline = name in INLINE
        if name in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>" if name != "head" else r"</head\s*>|<body\b", re.I).search(page, at)
                # an unclosed title or head ends at the next tag; other raw content runs to the end of the page
                if end:
                    at = end.start() if end[0].lower().startswith("<body") else end.end()
                elif name not in ("title", "head", "option", "select", "noscript"):
                    at = size
            if name not in ("script", "style", "template"):
                flush()
            continue
        if name in VOID:
            if name in ("br", "hr", "input"):
                pieces.append(" ")
            continue
        if not inline:
            flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    pop_to(depth)
                    break
                if inline and not stack[depth].inline:
                    break
            continue
        if not inline:
            # a block ends an open paragraph; items and cells end their like
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if not stack[depth].inline:
                    break
            if name in CLOSED_BY:
                likes, limits = CLOSED_BY[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in likes:
                        pop_to(depth)
                        break
                    if stack[depth].tag in limits:
                        break
        raw = m[3] or m[6] or ""
        aside, level, label = 2 * (name in ASIDE_TAGS), 4 if name == "article" else 3 if name == "main" else 0, name
        if raw.strip(" /\n\t\r") and name not in ("html", "body"):
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
            if re.search(r"(?:^|\s)hidden(?:\s|/|$)", raw):
                found["hidden"] = ""
            more, said = named(found)
            aside, level = max(aside, more), max(level, said)
            label = f"{name}.{re.sub(r'[0-9]+', '', found.get('class', ''))}#{re.sub(r'[0-9]+', '', found.get('id', ''))}"
        path = stack[-1].path if inline else hashed(next(e.path for e in reversed(stack) if not e.inline), label)
        if name == "a":
            links += 1
        stack.append(Element(name, path, aside, level, inline, len(tokens)))
        if not inline:
            tokens.append(path * 2)
        if raw.endswith("/") and name in ("div", "section", "p"):
            pop_to(len(stack) - 1)
    flush()
    return tokens, blocks


def main_text(page: str | None, frame: frozenset[int] = frozenset(), constant: frozenset[int] = frozenset()) -> str:
    """Article text of a page, given the tag tokens of its host's template and the texts that are boilerplate."""
    _, blocks = read_page(page)
    blocks = [b for b in blocks if b.token not in constant]
    open_blocks = [b for b in blocks if not b.aside]
    best = max((b.level for b in open_blocks), default=0)
    if best < 3 and (wrapped := [b for b in blocks if b.level >= 3 and not b.apart]):
        # the article stands inside an element that is named like an aside, such as a layout
        open_blocks, best = wrapped, max(b.level for b in wrapped)
    if not open_blocks:
        return ""
    if best:
        chosen = [b for b in open_blocks if b.level == best]
    else:
        # no sign of an article: the innermost element of the frame that holds half of the text outside of links
        held: dict[tuple[int, int], float] = {}
        total = 0.0
        for b in open_blocks:
            plain = len(b.text) * (1 - min(1, b.linked))
            total += plain
            for c in b.containers:
                if not frame or c[0] * 2 in frame:
                    held[c] = held.get(c, 0) + plain
        around = [c for c, n in held.items() if n >= total / 2]
        slot = max(around, key=lambda c: c[1], default=None)  # elements are numbered as they open
        chosen = [b for b in open_blocks if slot is None or slot in b.containers]
    return " ".join(b.text for b in chosen)


def ordered_and_nested(tokens: np.ndarray, classes: list[np.ndarray]) -> list[tuple[bool, int]]:
    """For each class (tokens in template order, the root first): kept in order on this page, and the root's gap it lies in.

    Gap -1: the class is not on this page, -2: it spans gaps.
    """
    order = np.argsort(tokens, kind="stable")
    found = tokens[order]
    out, root = [], None
    for members in classes:
        at = np.searchsorted(found, members)
        there = (at < len(found)) & (found[np.minimum(at, len(found) - 1)] == members) if len(found) else np.zeros(len(members), bool)
        if not there.all():
            out.append((True, -1))
            continue
        places = order[at]
        rising = bool((np.diff(places) > 0).all())
        if root is None:
            root = np.sort(places)
            out.append((rising, 0))
        else:
            gaps = np.searchsorted(root, places)
            out.append((rising, int(gaps[0]) if (gaps == gaps[0]).all() else -2))
    return out


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def page_tokens(hosted: DataFrame) -> DataFrame:
    """(host, page, tokens, times): distinct tokens of the distinct pages of each host; `page` is a hash of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.num_rows, 256):
                part = batch.slice(a, b - a)
                counts = [Counter(read_page(p)[0]) for p in part.column(2).to_pylist()]  # in order of first place
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([list(c) for c in counts], pa.list_(pa.int64())),
                     pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                    names=["host", "page", "tokens", "times"])

    read = hosted.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(
        run, "host string, page long, tokens array<long>, times array<int>")
    return stored(read.where(F.size("tokens") > 0).dropDuplicates(["host", "page"]), "page-tokens")


def of_host(rows: DataFrame, groups: DataFrame, hosts: DataFrame) -> DataFrame:
    """Join rows with one row per host; few hosts are broadcast, and with many the rows of a hot host are dealt out."""
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(groups), "host")
    return join_spread(rows, groups, "host", hosts, "n_rows", rows.columns[1])


def templates(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, frame, constant) of each host in `hosts` (host, n_pages, n_rows)."""
    spread = tokens.select("host", "page", F.posexplode(F.arrays_zip("tokens", "times")).alias("place", "found"))
    vectors = spread.groupBy("host", F.col("found.tokens").alias("token")).agg(
        F.bit_xor(F.xxhash64("page")).alias("vector"), F.count("*").alias("n"), F.max("found.times").alias("most"), F.avg("place").alias("place"))
    frequent = vectors.where("n > 1 AND most = 1")
    candidates = of_host(frequent, hosts, hosts).where((F.col("n_pages") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("n_pages")))
    members = F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    classes = candidates.groupBy("host", "vector").agg(F.max("n").alias("n"), members.alias("members")).where(F.size("members") > 1)
    # at most tokens-of-a-page / SHARE candidates on a host, so its classes fit one row
    listed = F.sort_array(F.collect_list(F.struct("n", F.size("members").alias("width"), "vector", "members")), asc=False)
    found = stored(classes.groupBy("host").agg(listed.alias("classes")), "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            host, number, kept, gap = [], [], [], []
            for h, tokens_, members_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if h not in known:
                    known[h] = [np.array(m, np.int64) for m in members_.as_py()]
                for k, (rising, place) in enumerate(ordered_and_nested(np.array(tokens_.as_py(), np.int64), known[h])):
                    if place != -1:
                        host.append(h), number.append(k), kept.append(rising), gap.append(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(number, pa.int32()), pa.array(kept, pa.bool_()), pa.array(gap, pa.int32())],
                names=["host", "number", "kept", "gap"])

    laid = of_host(tokens.select("host", "page", "tokens"), found, hosts).select("host", "tokens", F.transform("classes", lambda c: c["members"]).alias("members"))
    checked = laid.mapInArrow(run, "host string, number int, kept boolean, gap int").groupBy("host", "number").agg(
        F.every("kept").alias("kept"), F.min("gap").alias("low"), F.max("gap").alias("high")).where("kept AND low = high AND low >= 0")
    valid = found.select("host", F.posexplode("classes").alias("number", "one")).join(checked.select("host", "number"), ["host", "number"], "left_semi")
    known = hosts.join(valid, "host", "left").select(
        "host", "n_pages", F.col("one.n").alias("n"), F.explode_outer("one.members").alias("token"))
    odd = F.col("token").bitwiseAND(F.lit(1)) == 1
    return known.groupBy("host").agg(
        F.collect_list(F.when(~odd, F.col("token"))).alias("frame"),
        F.collect_list(F.when(odd & (F.col("n") >= CONSTANT * F.col("n_pages")), F.col("token"))).alias("constant"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    hosted = with_host(pages)
    tokens = page_tokens(hosted)
    counts = hosted.groupBy("host").agg(F.count("*").alias("n_rows"))
    distinct = tokens.groupBy("host").agg(F.count("*").alias("n_pages"))
    hosts = stored(counts.join(distinct, "host", "left").fillna(0, ["n_pages"]), "hosts")
    found = stored(templates(tokens, hosts), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            for a, b in slices(batch.num_rows, 256):
                part = batch.slice(a, b - a)
                texts = []
                for h, page, frame, constant in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5)):
                    if h not in known:
                        known[h] = frozenset(frame.as_py()), frozenset(constant.as_py())
                    texts.append(main_text(page, *known[h]).encode("utf-8", "replace").decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return of_host(hosted.select("host", "page_id", "url", "html"), found, hosts).select("host", "page_id", "url", "html", "frame", "constant").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
