"""Main text of web pages by container paths that a host's pages agree on. Parsing and scoring take time in proportion to the page.

Pass 1 parses each page, scores its containers by the text that they hold and names the best by a generalised path: tags
with their classes, digits replaced. Spark counts the votes for each host and path. Pass 2 takes, on each page, the
elements at the path with most votes that the page has, and its own best container, so the votes drop nothing that a page
names as its article; a page with none of them falls back on its own best container. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role and
words of class and id; words do not leave out what is around the article.

A path needs two votes to be a host's; all of those count, in the order of their votes. Words of class and id drop elements that
hold blocks, not paragraphs, headings or words in a line.

Defined cases: a null html is an empty page, with an empty text; a null or odd URL has the empty host; a very long, deep or
broken page is parsed as a whole: where a quote is not closed, quotes count for nothing from there on; rows that repeat are
extracted each; an empty table gives an empty result; columns besides page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, lean, materialize

#: Votes that make a path a host's, and paths whose table is broadcast; with more it is joined by a shuffle.
VOTES, BROADCAST_PATHS = 2, 300_000
#: Weight of an element that says it is the article, and share of the page's text that it then needs.
NAMED, ENOUGH = 1.5, 0.8

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form button select option datalist menu search svg canvas iframe audio video map template script style".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar".split()
)
NO_CONTAINERS = frozenset("p li h1 h2 h3 h4 h5 h6 pre dt dd tr ul ol blockquote".split())
#: Of these, the words of readers' comments: much text does not make them the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that say of the next one that the element is about it, not that it is it.
ABOUT = frozenset("no not has have with without".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert menu menubar".split())
NAMED_WORDS = frozenset("article content main post entry story".split())
ENDS_ITS_LIKE = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_QUOTED = re.compile(r">|=\s*+([\"'])")
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in sorted(RAW)}
#: Elements in which words of class and id drop nothing, as they hold a paragraph or a heading.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption caption summary".split())
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def words_in(names: str) -> set[str]:
    """Words of classes and ids, without those that a class only speaks about: no-sidebar is no sidebar."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        out.update(w for k, w in enumerate(words) if not k or words[k - 1] not in ABOUT)
    return out


_DIGITS = re.compile(r"\d+")


class Tags:
    """The tags of a source in turn: (start, end, name, whether it closes, attributes); name is empty for comments and the like.

    A quote counts after an equals sign. Once one is not closed, a tag ends at the next bracket, here and from there on.
    """

    def __init__(self, source: str):
        self.source, self.last, self.quotes = source, source.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        source = self.source
        while True:
            start = source.find("<", at)
            if start < 0 or start >= self.last:
                return None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, "", False, ""
            name = _NAME.match(source, start + 1)
            if name:
                end = self._end(name.end())
                closing = name[0][0] == "/"
                return start, end + 1, name[0][closing:].lower(), closing, "" if closing else source[name.end() : end]
            if source.startswith(("!", "?", "/"), start + 1):
                return start, source.index(">", start) + 1, "", False, ""
            at = start + 1

    def _end(self, at: int) -> int:
        """Where the bracket is that closes a tag."""
        source, first = self.source, at
        while self.quotes:
            found = _QUOTED.search(source, at)
            if found and not found[1]:
                return found.start()
            at = source.find(found[1], found.end()) + 1 if found else 0
            self.quotes = at > 0
        return source.index(">", first)


class Page:
    """Elements that matter as parallel lists, parents first, and the blocks of text in page order."""

    __slots__ = ("blocks", "depth", "in_article", "label", "left_out", "marked", "named", "named_in", "parent", "path_hash", "tag")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.label, self.left_out, self.named = [""], [-1], [0], [""], [False], [False]
        self.in_article, self.named_in, self.path_hash = [False], [False], [0]
        self.marked: dict[int, bool] = {}  # elements marked by words of class and id, and whether as comments
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(source)
        if self.marked:
            self._leave_out_marked()

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        classes = role = ident = ""
        hidden = False
        if attributes:
            for name, value in _ATTR.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "class":
                    classes = value
                elif name == "id":
                    ident = value
                elif name == "role":
                    role = value.lower()
                else:
                    hidden |= name == "hidden" or value.lower() == "true"
        words = words_in(f"{classes} {ident}") if classes or ident else frozenset()
        inside = self.in_article[parent]
        out = self.left_out[parent] or hidden or tag in LEFT_OUT or role in LEFT_OUT_ROLES or tag == "header" and not inside
        if not out and tag not in ("html", "body", "article", "main") and tag in BLOCK and tag not in _LINES and (words & LEFT_OUT_WORDS or "header" in words and not inside):
            self.marked[len(self.tag)] = bool(words & COMMENT_WORDS)
        label = _DIGITS.sub("N", tag + "".join(f".{c}" for c in sorted(classes.split()))) if classes else tag
        named = tag in ("article", "main") or role == "main" or bool(words & NAMED_WORDS)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.label.append(label)
        self.left_out.append(out)
        self.named.append(named)
        self.in_article.append(inside or tag in ("article", "main"))
        self.named_in.append(self.named_in[parent] or named and tag not in ("html", "body"))
        self.path_hash.append(step_hash(self.path_hash[parent], label))
        return len(self.tag) - 1

    def _held(self) -> list[int]:
        """Characters below each element, those in links counted against them."""
        held = [0] * len(self.tag)
        for element, text, links in self.blocks:
            held[element] += max(0, len(text) - 2 * links)
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return held

    def _leave_out_marked(self) -> None:
        """Marked elements go, but for those around the article: the longest article element, or most of the page's text."""
        n = len(self.tag)
        held, under = self._held(), [False] * n
        for k in range(1, n):
            under[k] = under[self.parent[k]] or k in self.marked
        free = sum(max(0, len(text) - 2 * links) for element, text, links in self.blocks if not under[element])
        articles = [k for k in range(n) if self.tag[k] in ("article", "main") and held[k] and not self.left_out[k]]
        longest = max(articles, key=lambda k: (held[k], -k), default=0)
        around = set(self._ancestors(longest)) if longest and (not under[longest] or held[longest] > free) else set()
        for k in range(1, n):
            if k in self.marked:
                most = not around and 2 * held[k] > held[0] and not self.marked[k]
                self.left_out[k] |= not (k in around or most)
            self.left_out[k] |= self.left_out[self.parent[k]]
        self.blocks = [b for b in self.blocks if not self.left_out[b[0]]]

    def _ancestors(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parent[element]

    def _parse(self, source: str) -> None:
        stack, texts, in_link, link_chars, at = [0], [], 0, 0, 0
        open_: Counter = Counter()  # tags in the stack
        tags = Tags(source)

        def flush() -> None:
            nonlocal link_chars
            if texts:
                text = " ".join(entities.unescape("".join(texts)).split())
                if text and not self.left_out[stack[-1]]:
                    self.blocks.append((stack[-1], text, link_chars))
                texts.clear()
            link_chars = 0

        def add(text: str) -> None:
            nonlocal link_chars
            if text and not self.left_out[stack[-1]]:
                texts.append(text)
                if in_link:
                    link_chars += len(text)

        def cut(place: int) -> None:
            for k in stack[place:]:
                open_[self.tag[k]] -= 1
            del stack[place:]

        def push(tag: str, attributes: str) -> None:
            stack.append(self._open(stack[-1], tag, attributes))
            open_[tag] += 1

        while found := tags.next(at):
            start, end, tag, closing, attributes = found
            add(source[at:start])
            at = end
            if not tag:
                continue
            if tag in RAW and not closing:
                stop = _RAW_END[tag].search(source, at)
                at = stop.start() if stop else len(source)
                continue
            if tag == "a":
                in_link = 0 if closing else 1
            if closing:
                if open_[tag]:
                    depth = next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag)
                    if any(self.tag[k] in BLOCK for k in stack[depth:]):
                        flush()
                    elif self.left_out[stack[depth]]:
                        texts.append(" ")
                    cut(depth)
                elif tag in BLOCK:
                    flush()
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    add(" ")
                continue
            if tag in BLOCK:
                flush()
                if tag in ENDS_ITS_LIKE:
                    likes, bounds = ENDS_ITS_LIKE[tag]
                    for like in likes.split():  # tr ends an open td and then the tr around it
                        if open_[like]:
                            k = len(stack) - 1
                            while k > 0 and self.tag[stack[k]] != like and self.tag[stack[k]] not in bounds:
                                k -= 1
                            if k > 0 and self.tag[stack[k]] == like:
                                cut(k)
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] not in BLOCK:
                    k -= 1
                if self.tag[stack[k]] == "p":
                    cut(k)
                push(tag, attributes)
            elif tag in LEFT_OUT or self._hides(attributes):
                push(tag, attributes)
        add(source[at:])
        flush()

    def _hides(self, attributes: str) -> bool:
        """Whether an element within a line is hidden or has a role that is left out."""
        if "hidden" not in attributes and "role" not in attributes:
            return False
        return any(n.lower() == "hidden" or n.lower() == "aria-hidden" and v.strip("\"'").lower() == "true" or n.lower() == "role" and v.strip("\"'").lower() in LEFT_OUT_ROLES for n, v in _ATTR.findall(attributes))

    def path(self, element: int) -> str:
        return ">".join(reversed([self.label[k] for k in self._ancestors(element) if self.label[k] not in UNNAMED]))

    def best(self) -> tuple[int, float]:
        """The container with the article and its score."""
        element, _, score = self._article()
        return element, score

    def _article(self) -> tuple[int, bool, float]:
        """The container with the article, whether the page names it, and its score.

        It holds all that the page names, with the title, or the whole page; a deeper one is taken only if it loses no more
        than blocks of links, and none within an article element.
        """
        held, child = self._held(), {}
        if not held[0]:
            return 0, False, 0.0
        stated = [k for k in range(len(self.tag)) if held[k] and not self.left_out[k] and (self.named[k] and self.tag[k] not in ("html", "body") or self.tag[k] == "h1")]
        at, named = 0, False
        if any(self.tag[k] not in NO_CONTAINERS for k in stated):
            at = self._around(stated)
            named = held[at] * NAMED >= ENOUGH * held[0] and self.tag[at] not in ("", "html", "body")
            at = at if named else 0
        for k in range(1, len(self.tag)):
            if held[k] and held[k] == held[self.parent[k]]:
                child[self.parent[k]] = k
        found = at
        while self.tag[found] != "article" and at in child:
            at = child[at]
            if self.tag[at] not in NO_CONTAINERS:
                found = at
        return found, named, held[found] * (NAMED if named else 1.0)

    def _around(self, elements: list[int]) -> int:
        """The deepest element that holds all of them."""
        below = [0] * len(self.tag)
        for k in elements:
            below[k] += 1
        for k in range(len(below) - 1, 0, -1):
            below[self.parent[k]] += below[k]
        return max((k for k in range(len(below)) if below[k] == len(elements)), key=lambda k: self.depth[k])

    def text(self, paths: list[str]) -> str:
        """Blocks below the elements at the first of paths that has text, with those of the page's own container.

        The own container is passed over where the page does not name it and the host's is named.
        """
        own, named, _ = self._article()
        at: dict[int, set[int]] = {}
        if paths:
            for k in range(len(self.tag)):
                if not self.left_out[k]:
                    at.setdefault(self.path_hash[k], set()).add(k)
        for path in paths:
            roots = at.get(hash_of_path(path), set()) if path else {0}
            if roots and self._below(roots):
                sure = not named and any(self.named_in[root] for root in roots)
                return self._below(roots if sure else roots | {own})
        return self._below({own})

    def _below(self, roots: set[int]) -> str:
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k in roots or self.parent[k] >= 0 and inside[self.parent[k]]
        return "\n".join(text for element, text, _ in self.blocks if inside[element])


#: Labels that no path has.
UNNAMED = ("", "html", "body")


def step_hash(above: int, label: str) -> int:
    """A path's hash from that of the path above it."""
    return above if label in UNNAMED else xxhash.xxh3_64_intdigest(label, seed=above)


def hash_of_path(path: str) -> int:
    out = 0
    for label in path.split(">"):
        out = step_hash(out, label)
    return out


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, pages, score: what the pages of each host say."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py())
                element, score = page.best()
                if score:
                    for column, value in zip(rows, (host, page.path(element), score), strict=True):
                        column.append(value)
            yield batch_of(schema, rows)

    source = pages.select(_host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(lean(run), "host string, path string, score double").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths with VOTES votes or more of each host, by votes, then score, then path. They are a host's templates, not its pages."""
    listed = votes(pages).where(F.col("pages") >= VOTES).groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("score")).alias("s"), "path"))).alias("x"))
    return materialize(listed.select("host", F.transform("x", lambda x: x["path"]).alias("paths")), "host-paths")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: a row for each row of pages."""
    winners = host_paths(pages)
    few = winners.agg(F.coalesce(F.sum(1 + F.size("paths")), F.lit(0))).first()[0] <= BROADCAST_PATHS
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("__host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    winners = winners.withColumnRenamed("host", "__winner")
    joined = source.join(F.broadcast(winners) if few else winners, F.col("__host") == F.col("__winner"), "left").select("page_id", "url", "html", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py()).text(paths) for source, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(lean(run), "page_id long, url string, text string")
