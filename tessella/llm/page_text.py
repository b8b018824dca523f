"""Main text of web pages: flat text blocks, judged by a decision tree trained on a small labelled table.

A page becomes a row of blocks in page order: runs of text between the tags that start or end a block. Each has its words,
the share of them inside links (link density), the same of its neighbours, whether it is a heading, and where it stands:
in an article or main part, in one that isn't the page's subject (menus, footers, forms, adverts, notices, comments, by tag,
role or a word of class or id), or neither. A classification tree, grown by Gini impurity on LABELLED, says which blocks are
main text; those are joined by one space. A page is read in one pass inside its own row: nothing is shuffled and a task
holds a batch of bounded bytes.

Defined results: null or empty html, and a page without main text, have an empty text of 0 code points; scripts, styles,
comments, titles, hidden parts and options are no blocks; unclosed elements end where their parent does, an unclosed
comment, script or tag reaches to the page's end; text without any tag is one block and judged as such; repeated rows are
judged alike; very long pages are read whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

_TAG = re.compile(
    r"<!--(?:.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Fixed values of HTML: elements that start and end blocks, that have raw text, that never have contents.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
SKIPPED = frozenset("noscript template svg math select button object audio video canvas datalist map head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of the same kind, and the elements that an end doesn't reach beyond.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_WALLS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
_SCOPE = frozenset(("table", "td", "th", "caption", "template"))

#: Words of class, id and role that tell what a part is. Those of FIRM count inside articles too.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted comment comments reply replies respond disqus discussion related recommended recommendations popular trending newsletter subscribe subscription signup login cookie cookies consent gdpr sidebar rail nav navbar navigation menu breadcrumb breadcrumbs pager pagination footer share sharing social follow popup modal copyright complementary contentinfo search skip widget dialog alertdialog".split())
LOOSE = frozenset("header masthead banner topbar toolbar notice notices alert overlay head".split())
SUBJECT = frozenset("article articlebody content contents post entry story main maincontent hentry text body".split())
_VAGUE = frozenset("has with no without".split())
AWAY_TAGS = frozenset("nav footer aside dialog menu search".split())

#: Where a block stands.
AWAY, NEITHER, MAIN = -1, 0, 1
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "part", "heading", "page_has_main")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    part: int
    heading: bool


class _Open(NamedTuple):
    name: str
    part: int
    firm: bool  # nothing inside is the page's subject
    skip: bool
    form: bool


def _hints(name: str, attrs: str, above: _Open) -> tuple[int, bool]:
    """The part that an element begins, and whether nothing inside it can be the subject."""
    if name in ("html", "body"):
        return above.part, above.firm
    words: set[str] = set()
    role = ""
    if attrs.strip():
        for key, *values in _ATTRIBUTE.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                for token in value.split():
                    own = {w.lower() for w in _WORD.findall(token)} | {token.lower()}
                    if not own & _VAGUE:
                        words |= own
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop" and value.lower() == "articlebody":
                role = "article"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return AWAY, True
    if above.firm:
        return AWAY, True
    if words & FIRM or role in ("navigation", "contentinfo", "complementary", "search", "dialog", "alertdialog") or name in AWAY_TAGS:
        return AWAY, True
    if name in ("article", "main") or role in ("main", "article"):
        return MAIN, False
    if name == "form" or above.part != MAIN and not words & SUBJECT and (words & LOOSE or role == "banner" or name == "header"):
        return AWAY, False
    if (above.part == NEITHER or above.form) and words & SUBJECT:
        return MAIN, False
    return above.part, above.firm


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    forms: list[bool] = []
    stack = [_Open("", NEITHER, False, False, False)]
    texts: list[str] = []
    linked = 0
    link_at = 0  # the depth at which an open link began
    heading = False
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if texts:
            words = "".join(texts).split()
            if words:
                top = stack[-1]
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), top.part, heading))
                forms.append(top.form)
            texts.clear()
        linked = 0

    def cut(depth: int) -> None:
        nonlocal link_at
        del stack[depth:]
        if link_at > depth:
            link_at = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].skip:
            piece = entities.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if link_at:
                linked += len(piece.split())

    while pos < end:
        m = _TAG.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        name = m["name"]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                text(page[m.start() + 9 : pos].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                link_at = 0
            elif name in BLOCKS or name in SKIPPED:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        flush()
                        cut(depth)
                        break
                    if stack[depth].name in _SCOPE and name not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
                        break
                if name in BLOCKS:
                    flush()
                if name[0] == "h" and name[1:].isdigit():
                    heading = False
            elif name == "br":
                text(" ")
            continue
        if name in RAW:
            stop = _raw_end(name).search(page, pos)
            pos = stop.start() if stop else end
            continue
        if name == "a":
            link_at = len(stack) if re.search(r"(?i)\bhref\b", m["attrs"]) else 0
        elif name == "br":
            text(" ")
        elif name in BLOCKS or name in SKIPPED:
            if name in BLOCKS:
                if name == "body":  # what the head left open ends here
                    flush()
                    for depth, o in enumerate(stack):
                        if o.name == "head":
                            cut(depth)
                            break
                flush()
                if stack[-1].name == "p":
                    cut(len(stack) - 1)
                if name in _ENDS:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].name in _ENDS[name]:
                            cut(depth)
                            break
                        if stack[depth].name in _WALLS[name]:
                            break
            if name in VOID or m["attrs"].endswith("/") and name in SKIPPED:
                continue
            above = stack[-1]
            part, firm = _hints(name, m["attrs"], above)
            form = not firm and part == AWAY and (name == "form" or above.form)
            stack.append(_Open(name, part, firm, above.skip or name in SKIPPED, form))
            if name in BLOCKS:
                heading = name[0] == "h" and name[1:].isdigit()
    flush()
    # A form around half of the page's words or more is the page's frame.
    inside = sum(b.words for b, f in zip(out, forms) if f)
    if inside and 2 * inside >= sum(b.words for b in out):
        out = [b._replace(part=NEITHER) if f else b for b, f in zip(out, forms)]
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; what is before the first and after the last counts as empty."""
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked for b in page]) / np.maximum(words, 1)
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6] = [b.part for b in page]
    out[:, 7] = [b.heading for b in page]
    out[:, 8] = any(b.part == MAIN for b in page)
    return out


class Tree(NamedTuple):
    """Nodes as arrays: go left where the feature is at most the threshold; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray

    def judge(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            goes_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return self.keep[at]


def grow(x: np.ndarray, keep: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """A classification tree by Gini impurity. Of equally good splits the first feature and lowest threshold win."""
    nodes: list[list] = []

    def split(rows: np.ndarray, left: int) -> int:
        me, y = len(nodes), keep[rows]
        nodes.append([-1, 0.0, 0, 0, 2 * y.sum() >= len(y)])
        if not left or y.all() or not y.any():
            return me
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, kept = x[rows[order], f], np.cumsum(y[order])
            for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
                if least <= i <= len(y) - least:
                    a, b = kept[i - 1], kept[-1] - kept[i - 1]
                    impurity = 2 * a * (1 - a / i) + 2 * b * (1 - b / (len(y) - i))
                    if impurity < best[0] - 1e-9:
                        best = (impurity, f, (v[i - 1] + v[i]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:4] = best[1], best[2], split(rows[low], left - 1), split(rows[~low], left - 1)
        return me

    split(np.arange(len(x)), depth)
    return Tree(*(np.array(c) for c in zip(*nodes)))


#: The labelled table: pages in pieces, each with whether it is main text. {n} stands for n words. Fixed and bounded: it is
#: all that the tree is trained on.
LABELLED: tuple[tuple[tuple[bool, str], ...], ...] = (
    ((False, "<nav><ul><li><a href=/>{1}</a></li><li><a href=/>{2}</a></li></ul></nav>"), (False, "<div class=ad>{9}</div>"), (True, "<article><h1>{8}</h1><p>{60}</p><p>{35}</p><p>{4}</p></article>"), (False, "<footer>{12}</footer>")),
    ((False, "<div class=ad>{40}</div>"), (True, "<article><h1>{3}</h1><p>{2}</p></article>"), (False, "<footer>{3} <a href=/>{2}</a></footer>")),
    ((False, "<header><a href=/>{2}</a><p>{7}</p></header>"), (True, "<main><h1>{5}</h1><p>{30} <a href=/>{3}</a> {20}</p><h2>{3}</h2><p>{12}</p><ul><li>{6}</li><li>{3}</li></ul>"), (False, "<aside><p>{25}</p></aside></main>"), (False, "<footer><p>{30}</p></footer>")),
    ((False, "<div id=cookie-notice><p>{28}</p><a href=/>{2}</a></div>"), (True, "<article><h2>{6}</h2><p>{90}</p><p><a href=/>{4}</a> {10}</p>"), (False, "<ul class=related><li><a href=/>{7}</a></li><li><a href=/>{6}</a></li></ul></article>"), (False, "<section id=comments><h3>{2}</h3><p>{45}</p><p>{70}</p></section>")),
    ((False, "<div><a href=/>{1}</a> <a href=/>{1}</a> <a href=/>{1}</a></div>"), (True, "<div><h1>{6}</h1><p>{50}</p><p>{7}</p><p>{40} <a href=/>{2}</a></p></div>"), (False, "<div><a href=/>{3}</a></div><div>{4} <a href=/>{3}</a></div>")),
    ((False, "<table><tr><td><a href=/>{1}</a></td><td><a href=/>{2}</a></td></tr></table>"), (True, "<table><tr><td><h1>{5}</h1>{80}<p>{25}</p><p>{16}</p></td></tr></table>"), (False, "<p>{3} <a href=/>{2}</a> <a href=/>{2}</a></p>")),
    ((False, "<ul><li><a href=/>{4}</a></li><li><a href=/>{6}</a></li><li><a href=/>{11}</a></li></ul>"), (True, "<h1>{4}</h1><p>{22}</p><p>{18}</p><p>{33}</p>"), (False, "<p><a href=/>{5}</a></p><p><a href=/>{6}</a></p><p>{4}</p>")),
    ((False, "<p>{2} <a href=/>{1}</a></p>"), (True, "<h2>{9}</h2><p>{120}</p>"), (False, "<p>{5}</p><p><a href=/>{2}</a></p>")),
    ((True, "<p>{200}</p>"),),
    ((True, "<p>{25}</p><p>{30}</p>"),),
    ((True, "<div class=post-content><h1>{7}</h1><p>{15}</p><p>{1}</p><blockquote>{14}</blockquote></div>"), (False, "<div class=sidebar><h3>{2}</h3><p>{18}</p></div>"), (False, "<form><label>{3}</label><p>{14}</p></form>")),
    ((False, "<div class=header><p>{11}</p></div><p>{6}</p>"), (True, "<div id=content><p>{45}</p><p>{5}</p><p><a href=/>{3}</a></p><p>{17}</p></div>"), (False, "<p>{9}</p><div id=footer><p>{22}</p></div>")),
    ((False, "<p>{35}</p>"), (True, "<article><p>{1}</p></article>"), (False, "<p>{50}</p><p>{3}</p>")),
    ((True, "<article><h1>{10}</h1><p>{40}</p>"), (False, "<div class=share><a href=/>{1}</a> {2}</div><div class=promo>{30}</div>"), (True, "<p>{6}</p><h3>{2}</h3><p>{9}</p></article>"), (False, "<div class=newsletter><p>{20}</p></div><p><a href=/>{8}</a></p>")),
    ((True, "<article><p>{20}</p><p><a href=/>{9}</a></p><p>{15}</p></article>"), (False, "<div><a href=/>{9}</a></div>")),
    ((False, "<div class=notice>{60}</div><p>{13}</p>"), (True, "<main><p>{11}</p></main>"), (False, "<p>{13}</p><h4>{3}</h4>")),
    ((False, "<h2>{2}</h2><ul><li><a href=/>{3}</a></li><li><a href=/>{4}</a></li></ul>"), (True, "<h1>{6}</h1><p>{65}</p><h2>{3}</h2><p>{48}</p>"), (False, "<h2>{2}</h2><ul><li><a href=/>{9}</a></li><li><a href=/>{12}</a></li></ul>")),
    ((False, "<div>{9}</div><div><a href=/>{1}</a></div>"), (True, "<div>{70}</div><div>{8}</div><div>{45}</div>"), (False, "<div>{11}</div><div>{3} <a href=/>{2}</a></div>")),
    ((False, "<p>{7}</p><p>{2} <a href=/>{2}</a></p>"), (True, "<h1>{6}</h1><div>{38}</div><div>{10}</div><div>{52}</div><div>{29}</div>"), (False, "<div>{8}</div>")),
    ((False, "<div>{12}</div><div>{6}</div>"), (True, "<h3>{9}</h3><p>{64}</p><p>{5}</p><p>{31}</p>"), (False, "<div>{10}</div><div>{7}</div>")),
    ((False, "<p><a href=/>{14}</a></p><p><a href=/>{20}</a> {3}</p>"), (True, "<p>{75} <a href=/>{5}</a></p><p>{21}</p>"), (False, "<p>{2}</p><p>{3}</p>")),
)


def labelled_blocks(pages: tuple[tuple[tuple[bool, str], ...], ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table's blocks. A page's pieces are read as one text; marks tell them apart."""
    xs, ys = [], []
    for page in pages:
        fill = lambda piece, k: re.sub(r"\{(\d+)\}", lambda m: " ".join([f"w{k}"] * int(m[1])), piece)
        read = blocks("".join(fill(piece, k) for k, (_, piece) in enumerate(page)))
        xs.append(features(read))
        ys += [page[int(b.text.split()[0][1:])][0] for b in read]
    return np.concatenate(xs), np.array(ys)


@lru_cache(maxsize=1)
def fitted() -> Tree:
    return grow(*labelled_blocks())


def main_text(page: str | None, tree: Tree) -> str:
    read = blocks(page or "")
    if not read:
        return ""
    return " ".join(b.text for b, keep in zip(read, tree.judge(features(read)).tolist()) if keep)


def page_texts(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = bounded_batches(df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html")))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = tree or fitted()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(part, schema)


def page_blocks(df: DataFrame, page_id: str = "page_id", html: str = "html", tree: Tree | None = None) -> DataFrame:
    """The flat blocks themselves: page_id, block (from 0), text, the features, kept."""
    rows = bounded_batches(df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{html}`").cast("string").alias("html")))
    schema = T.StructType([rows.schema.fields[0], T.StructField("block", T.IntegerType()), T.StructField("text", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES], T.StructField("kept", T.BooleanType())])
    tree = tree or fitted()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in enumerate(b.column(1).to_pylist()):
                if read := blocks(page or ""):
                    x = features(read)
                    owner = b.column(0).take(pa.array([i] * len(read)))
                    yield pa.RecordBatch.from_arrays([owner, pa.array(np.arange(len(read), dtype=np.int32)), pa.array([r.text for r in read]), *[pa.array(c) for c in x.T], pa.array(tree.judge(x))], names=schema.names)

    return rows.mapInArrow(part, schema)


#: DuckDB, for pages whose subject is one article element without parts that don't belong to it, as all in the given tables:
#: what lies in it, tags that only mark words removed, other tags as white space, the references that occur decoded.
ORACLE_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) as t from pages),
b as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g')) as t from a),
c as (select page_id, url, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') as t from b)
select page_id, url, t as text, length(t) as n_chars from c
"""
