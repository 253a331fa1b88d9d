"""Main text of web pages by consensus paths of their hosts.

A page is read once from left to right into containers (article, div, ...), each with a
generalised path of tags and classes (digits count as one sign), and blocks of text. A path is
a number of eight bytes, made from its parent's and its own tag and classes, so that deep pages
cost no more than flat ones. Containers are scored by their own blocks and, less, by those of containers inside them. Every page votes
for the path of its best container; the path of a host with the most votes wins, and each page
of the host is then read from the containers on that path. A page without such a container is
read from its own best one.

Boilerplate (menus, footers, sidebars, adverts, forms, comments, ...) is told by tag, role or
class and takes no part. Character references are decoded, white space in a block becomes one
space, blocks are joined by a line feed. Null and empty pages have an empty text. Pages without
a url (or without `://`) share the empty host. Every row gives one row; repeated rows repeat. An
empty table gives an empty one. Pages are read in time and memory linear in their length, however
deep their elements are nested. Columns of pages other than `carry`, url and html are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of hosts whose winning paths are broadcast; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20
#: What a container inherits of the score of one inside it; what the tags and classes of main
#: text multiply a score by.
INHERITED, MAIN_TAG, MAIN_CLASS = 0.8, 1.5, 1.25

CONTAINERS = frozenset("body article main section div td center figure blockquote details".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre address hr html header footer nav "
    "aside form fieldset figcaption summary hgroup dialog menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, or never shown.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object".split())
BOILERPLATE = frozenset(
    "nav footer aside form button select dialog menu search fieldset label audio video canvas head".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "commentlist disqus respond replies reviews share sharing social related recommended recommendations pagination pager "
    "widget skip paywall disclaimer".split()
)
MAIN_MARKS = frozenset("article content entry main post story text body page".split())
#: A start tag of the first ends open ones of the second, inside the third.
_SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
#: Whole attributes from left to right, so that no name is found in another's value or name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Containers by number: parent, path, score of own blocks, factor; blocks in order."""

    parent: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    own: list[float] = field(default_factory=list)
    factor: list[float] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def scores(self) -> list[float]:
        score = list(self.own)
        for i in range(len(score) - 1, -1, -1):
            score[i] *= self.factor[i]
            if self.parent[i] >= 0:
                score[self.parent[i]] += INHERITED * score[i]
        return score

    def best(self) -> int | None:
        """The first container of the highest score; None without any text."""
        score = self.scores()
        i = max(range(len(score)), key=lambda i: (score[i], -i))
        return i if score[i] > 0 or self.blocks else None

    def text(self, path: int | None) -> str:
        """Of the containers on the path or, if there are none, of the best one."""
        chosen = {i for i, p in enumerate(self.path) if p == path}
        if len(chosen) > 1:  # lists of links on the same path are left out, if they aren't all
            score = self.scores()
            chosen = {i for i in chosen if score[i] > 0} or chosen
        if not chosen and (best := self.best()) is not None:
            chosen = {best}
        inside = [False] * len(self.path)
        for i, parent in enumerate(self.parent):  # parents come first
            inside[i] = i in chosen or (parent >= 0 and inside[parent])
        return "\n".join(text for i, text in self.blocks if inside[i])


def _marks(attributes: str) -> tuple[str, bool, bool, bool]:
    """Generalised classes; whether a class or id marks boilerplate, main text, a header. A name
    marks what its first or last word says, unless it only says that such a part is there."""
    classes, boiler, main, header = "", False, False, False
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                boiler |= value in ROLES
            elif key == "hidden":
                boiler = True
            elif key == "aria-hidden":
                boiler |= value == "true"
            elif key in ("class", "id"):
                for name in value.split():
                    words = _WORD.findall(name)
                    if not words or words[0] in ("has", "with", "no", "without", "is"):
                        continue
                    ends = {words[0], words[-1]}
                    if not MARKS.isdisjoint(ends):
                        boiler = True
                    elif not MAIN_MARKS.isdisjoint(ends):
                        main = True
                    header |= words[-1] == "header"
                if key == "class":
                    classes = "".join(sorted({"." + _DIGITS.sub("#", c) for c in value.split()}))
    return classes, boiler, main, header


def step(path: int, name: str) -> int:
    """The path of an element of this tag and these classes inside one of a path."""
    return xxhash.xxh3_64_intdigest(name, path) >> 1


def path_of(*names: str) -> int:
    """Of tags with classes from the root on: path_of("html", "body", "div.main")."""
    return reduce(step, names, 0)


def parse(source: str) -> Page:
    page = Page([-1], [path_of("html")], [0.0], [0.5], [])
    # open elements: (tag, container, whether boilerplate, whether inside a link)
    stack: list[tuple[str, int, bool, bool]] = [("html", 0, False, False)]
    # where in the stack the elements of each tag, and those that are blocks, are open
    places: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    parts: list[str] = []
    linked = 0
    at = 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                container = stack[-1][1]
                page.blocks.append((container, text))
                page.own[container] += max(0.0, len(text) - 1.5 * linked)
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        top = stack[-1]
        if text and not top[2]:
            parts.append(text)
            if top[3]:
                linked += len(text)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int):
        """Ends the open elements from the k-th on."""
        for tag, *_ in stack[k:]:
            places[tag].pop()
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()
        del stack[k:]

    def close(tags, barrier: int):
        """Ends the last open element of these tags and what is inside it, unless it is outside
        the open element that the barrier names."""
        k = last(tags)
        if k > barrier:
            if open_blocks and open_blocks[-1] >= k:
                flush()
            cut(k)

    while True:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                add(" ")
            elif tag in BLOCKS:
                close((tag,), 0)
                flush()
            else:
                close((tag,), open_blocks[-1] if open_blocks else 0)
            continue
        if tag in RAW:
            # white space stays: the words around it are apart only if the page says so
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            close(("p",), last(("td", "th", "table", "button")))
            flush()
            if tag in _SIBLINGS:
                tags, until = _SIBLINGS[tag]
                close(tags.split(), last(until))
            elif tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                cut(len(stack) - 1)
        if tag in VOID:
            continue
        classes, marked, main, named_header = _marks(m[3] or m[6] or "")
        _, container, boiler, link = stack[-1]
        # the header of an article belongs to it; that of the page does not
        header = (tag == "header" or named_header) and not last(("article", "main"))
        marked = (marked or header) and tag not in ("html", "body", "main") and not (tag == "article" and main)
        boiler = boiler or marked or tag in BOILERPLATE
        if tag in CONTAINERS and not boiler:
            page.parent.append(container)
            page.path.append(step(page.path[container], tag + classes))
            page.own.append(0.0)
            factor = MAIN_TAG if tag in ("article", "main") else 1.0
            page.factor.append(factor * (MAIN_CLASS if main else 1.0))
            container = len(page.path) - 1
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, container, boiler, link or tag == "a"))
    flush()
    return page


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _votes(batches):
    for batch in batches:
        hosts, paths = [], []
        for name, source in zip(batch.column("__host").to_pylist(), batch.column("__html").to_pylist(), strict=True):
            page = parse(source)
            if (best := page.best()) is not None:
                hosts.append(name)
                paths.append(page.path[best])
        votes = [1] * len(hosts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(votes, pa.int64())],
            names=["__host", "__path", "votes"],
        )


def _extract(batches):
    for batch in batches:
        texts = [
            parse(source).text(path)
            for source, path in zip(batch.column("__html").to_pylist(), batch.column("__path").to_pylist(), strict=True)
        ]
        keep = batch.drop_columns(["__host", "__html", "__path"])
        yield pa.RecordBatch.from_arrays(
            [*keep.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*keep.schema.names, "text", "n_chars"],
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(__host, __path): the path with the most votes of each host; of equals the greatest number."""
    rows = pages.select(host(F.col("url")).alias("__host"), F.coalesce("html", F.lit("")).alias("__html"))
    votes = rows.mapInArrow(_votes, "__host string, __path long, votes long")
    sums = votes.groupBy("__host", "__path").agg(F.sum("votes").alias("votes"))
    best = sums.groupBy("__host").agg(F.max(F.struct("votes", "__path")).alias("best"))
    return best.select("__host", F.col("best.__path").alias("__path"))


def extract(pages: DataFrame, carry: list[str], paths: DataFrame | None = None) -> DataFrame:
    """The columns `carry` of pages (url, html, ...), then text and n_chars in code points."""
    paths = winning_paths(pages).checkpoint() if paths is None else paths
    if (paths.agg(F.sum(F.octet_length("__host") + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        paths = F.broadcast(paths)
    rows = pages.select(*carry, host(F.col("url")).alias("__host"), F.coalesce("html", F.lit("")).alias("__html"))
    fields = [f for f in rows.schema.fields if f.name not in ("__host", "__html")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.join(paths, "__host", "left").mapInArrow(_extract, schema)
