"""Main text of web pages by composite text density.

For every DOM node: characters C and tags T below it, and those in links, LC and LT. The link-adjusted density is

    C / T * ln(C / LC * T / LT) / ln(ln(C / (C - LC) * LC + LC_body / C_body * C + e))

with counts of 0 taken as 1; on a page without any link it is C / T. The sum of a node's children's densities picks the
subtree with the most text; the least density on its path to the body is the threshold by which other parts beside that
path join it. Elements that are never article text (navigation, footer, aside, scripts and their like) count for the
densities but give no text. Forms, and elements of which a whole class, id or role token is a name for boilerplate
("comments", "cookie-banner", "site-search"; not "comments-open", "has-sidebar" or "search-result-page"), give none either, unless they hold most of the
page's text: then the name is taken for one of the page, and the densities decide. Only names for reader comments stand
however long the comments are. Another id alone (any heading has one) says so only of parts that are mostly links or less dense than
the page; that of a heading says nothing. A page of which nothing is left is read again by its densities alone.

Blocks are the runs of text between block elements or line breaks; white space in a block becomes one blank.

Results for odd rows: a null or empty page, or one without text, gives an empty string; unclosed, stray and cut tags are
read as browsers do in the common cases (a paragraph ends the one before it); ties fall to the first node in page order;
repeated rows get a row each; an empty table gives no row. Only ``page_id``, ``url`` and ``html`` are read; whole pages.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
#: One attribute: a name and, if any, its value with or without quotes.
_ATTRIBUTE = re.compile(r"([^\s=>/\"'][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_LETTERS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside button dialog embed footer head header iframe input label link menu meta nav noscript object option script select style svg template textarea title".split())
NEVER_NAMED = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say where or how big a part is, not what it holds; a token made of these and a name above is still that name.
PLACES = frozenset("a area author bar block body bottom box container content cta fixed global group inner item left links list main menu outer panel placeholder primary right row secondary section site slot sticky text the thread top unit wrap wrapper".split())
#: Words that make a token the state of a page.
STATES = frozenset("closed disabled enabled free has hide is no not on off open show with without".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies respond responses".split())
#: The share of a page's text from which a part's name is taken for one of the page.
MOST = 0.6
KEPT = frozenset("html body main article".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag ends, up to the elements that hold it in.
_ENDS = {
    **dict.fromkeys(BLOCK - {"br", "hr", "li", "dd", "dt", "td", "th", "tr", "option", "body", "html"}, (frozenset({"p"}), frozenset("article section div td th li table blockquote main body form aside".split()))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})), "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}


class _Node:
    __slots__ = ("chars", "density", "kids", "link_chars", "link_tags", "never", "own", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, own: int):
        """own: how sure the element itself says that it isn't article text; never: whether it or one above gives none."""
        self.tag, self.parent, self.own, self.kids, self.never = tag, parent, own, [], False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


#: How sure an element itself says that it isn't article text. What only its id says holds where its density agrees: ids are
#: the anchors of headings and parts, whatever these are about.
BY_ID, NAMED, SURE = 1, 2, 3


def _token_says(token: str) -> int:
    """Whether a class, id or role token is a name for boilerplate: its last word is one, or all its words are or say where it stands."""
    words = _LETTERS.findall(token)
    if not any(w in NEVER_NAMED or w in COMMENTS for w in words) or any(w in STATES for w in words):
        return 0
    if words[-1] not in NEVER_NAMED | COMMENTS and any(w not in NEVER_NAMED | COMMENTS | PLACES for w in words):
        return 0
    return SURE if any(w in COMMENTS for w in words) else NAMED


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag by name in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _names(value: str) -> int:
    return max((_token_says(re.sub(r"([a-z])([A-Z])", r"\1-\2", t).lower()) for t in value.split()), default=0)


def _says(tag: str, text: str) -> int:
    """0, BY_ID, NAMED or SURE: whether an element isn't article text by its tag, its class, role and id, or being hidden."""
    if tag in NEVER:
        return SURE
    if tag in KEPT or not text:
        return NAMED if tag == "form" else 0
    has = attributes(text)
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(has.get("style", "")):
        return SURE
    by_id = 0 if tag in HEADINGS else _names(has.get("id", ""))
    by_id = BY_ID if by_id == NAMED else by_id  # ids for reader comments stand, as other names for them do
    return max(_names(has.get("class", "")), _names(has.get("role", "")), by_id) or (NAMED if tag == "form" else 0)


class _Open:
    """The open elements, and at which places those of each tag are, so that no end tag has to look through them."""

    def __init__(self, root: _Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: _Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]


def parse(html: str) -> tuple[_Node, list[_Node]]:
    """The body (or the root, without one) and all nodes in page order. Linear in the page, whatever its tags."""
    root = _Node("html", None, 0)
    nodes, open_, body, at = [root], _Open(root), None, 0
    stack = open_.stack
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if html[m.start()] != "<" or m.end() - m.start() == 1:
                stack[-1].kids.append(unescape(m[0]))
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if place := open_.last((tag,)):
                if tag not in ("body", "html"):
                    open_.cut(place)
            elif tag in BLOCK:
                stack[-1].kids.append(None)
            continue
        if tag == "html":
            continue
        if tag == "body":
            if body is None:
                open_.cut(1)
                body = _Node(tag, root, 0)
                root.kids.append(body)
                nodes.append(body)
                open_.push(body)
            continue
        if tag in _ENDS:
            ends, holds = _ENDS[tag]
            if (place := open_.last(ends)) > open_.last(holds):
                open_.cut(place)
        node = _Node(tag, stack[-1], _says(tag, attrs or ""))
        stack[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
        if tag not in VOID:  # a slash at the end of a start tag means nothing in HTML
            open_.push(node)
    return body or root, nodes


def _flag(nodes: list[_Node], by_names: bool) -> None:
    """Sets ``never``: of tags and comments always, of other names and forms where they hold less than MOST of the text beside the former."""
    sure: set[int] = set()
    text = 0
    for n in nodes:
        if n.own == SURE or n.parent is not None and id(n.parent) in sure:
            sure.add(id(n))
        else:
            text += n.chars - sum(k.chars for k in n.kids if isinstance(k, _Node))
    usual = nodes[0].chars / max(1, nodes[0].tags)
    for n in nodes:
        named = n.own == NAMED or n.own == BY_ID and (n.density < usual or 2 * n.link_chars > n.chars)
        n.never = id(n) in sure or n.parent is not None and n.parent.never or by_names and named and n.chars < MOST * text


def _measure(nodes: list[_Node], body: _Node) -> None:
    for n in reversed(nodes):
        if n.tag in RAW or n.tag == "head":
            n.chars = n.tags = n.link_chars = n.link_tags = 0
            continue
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            elif k is not None:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        n.density = c / t
        if c and share:
            base = math.log(math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e))
            n.density *= math.log(max(1.0, c / lc * t / lt)) / max(base, 1e-6)


def _sum(n: _Node) -> float:
    """The densities of the block children, and that of what stands beside them. Inline markup is part of its block."""
    blocks = [k for k in n.kids if isinstance(k, _Node) and k.tag in BLOCK and k.chars]
    if not blocks:
        return n.density
    chars = n.chars - sum(k.chars for k in blocks)
    tags = n.tags - sum(k.tags + 1 for k in blocks)
    return sum(k.density for k in blocks if not k.never) + chars / max(1, tags)


def _blocks(parts: list, out: list[str]) -> None:
    """Adds the blocks of a list of nodes and texts, walking without recursion."""
    run: list[str] = []

    def end() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    todo = list(reversed(parts))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.never:
            if x.tag in BLOCK:
                todo.append(None)
                end()
            todo.extend(reversed(x.kids))
        elif x.tag in BLOCK:
            end()
    end()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    body, nodes = parse(html)
    _measure(nodes, body)
    _flag(nodes, True)
    text = _densest(body, nodes)
    if not text and body.chars:
        _flag(nodes, False)
        text = _densest(body, nodes)
    return text


def _densest(body: _Node, nodes: list[_Node]) -> str:
    """The blocks of the subtree with the greatest density sum and of what joins it."""
    best, most, inside = None, -1.0, {id(body)}
    for n in nodes:
        if n is not body and not (n.parent is not None and id(n.parent) in inside):
            continue
        inside.add(id(n))
        if n.never or not n.chars:
            continue
        if n is not body and n.tag not in BLOCK:
            continue
        total = _sum(n)
        if total > most:
            best, most = n, total
    if best is None:
        return ""
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    parts = [best]
    for child, above in zip(path, path[1:], strict=False):
        at = next(i for i, k in enumerate(above.kids) if k is child)
        dense = lambda k: k is None or (len("".join(k.split())) >= least if isinstance(k, str) else not k.never and k.density >= least and k.chars > 0)
        parts = [k for k in above.kids[:at] if dense(k)] + [None, *parts, None] + [k for k in above.kids[at + 1 :] if dense(k)]
    out: list[str] = []
    _blocks(parts, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``; no shuffle."""

    def run(batches):
        for b in slices(batches):
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
