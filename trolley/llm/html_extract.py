"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree. A node of the tree is a
path of elements (tag, class names, order of like parts) from the root; its importance is an
entropy: of the child sequences that pages show at it (presentation), and of
the texts that stand directly in it (content). A node that looks and reads
alike on all pages of a host has no entropy: menus, notices, footers. Every
branch that a reader sees is judged, whatever its name, and branches whose every
node has low importance are removed from each page first. What is left and has no
sign in the entropy, because it differs from page to page, is told by names: forms,
adverts, asides and reader comments go wherever they stand, and where a page marks
its article, only that is kept. A name tells that only as a whole; a wrapper
stays, whatever its name, if the main element or the page's article stands in it.
With ``names=False`` the tree decides alone.

Spark does the merging: each page gives one row for each node with hashes of
its child sequence and text; these are counted by (host, node, value), so a
host with a third of all pages is summed in the map tasks first and never
gathered. The few low-importance nodes of each host are joined back to its
pages, an equi-join whose hot keys Spark splits.

Nulls and empty pages give an empty text. Hosts with fewer than MIN_PAGES
different pages, and pages without a host, are judged by element names alone.
Repeated rows give repeated results; copies of a page count once in the tree. Very
long pages are parsed whole, one at a time. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

MIN_PAGES = 5
MIN_IMPORTANCE = 0.2

# Element names of HTML, by what they mean here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NEVER = {
    "script", "style", "head", "title", "template", "noscript", "nav", "header", "footer", "aside", "form", "button",
    "select", "option", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "noembed", "noframes",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
BLOCKS_CLOSE_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "ul",
}
# Parts of a page: those of one look under one parent are told apart by their order.
ORDERED = {"div", "section", "table", "ul", "ol", "dl"}
# An opening tag that ends an open element of these names, unless one of the fences stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Of these, the ones that pages also put around their whole content.
WRAPPERS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
# Class, id and role values that name parts which are not the article: such a word, alone or with words for a place before
# it and for a part of a page behind it. Words of other meaning make it another name: has-sidebar, social-policy.
_WORD = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo|related|replies|"
    r"respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|search)"
)
_PLACE = (
    r"(?:article|bottom|desktop|entry|fixed|floating|global|header|inline|js|left|main|mobile|page|post|primary|right|"
    r"secondary|site|sticky|story|sub|tertiary|top|user|wp)"
)
_PART = (
    r"(?:area|articles|bar|block|body|bottom|box|btn|buttons?|center|close|column|container|content|field|form|group|head|"
    r"header|heading|holder|icons?|inner|input|items?|label|left|links?|list|main|media|outer|overlay|panel|posts|primary|"
    r"right|row|secondary|section|signup|slot|stories|strip|thread|title|to|toggle|tools|top|unit|wrap|wrapper|\d+)"
)
_NOISE = re.compile(rf"(?:{_PLACE}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PART}))*[_-]*")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    path: str
    hidden: bool = False
    stated: bool = False  # hidden by the page itself, not for its name
    children: list = field(default_factory=list)  # nodes and strings
    looks: dict = field(default_factory=dict)  # how many children of each look that are told apart by order


def parse(page: str) -> Node:
    """Tree of a page; unclosed and misnested elements end where browsers end them."""
    root = Node("#root", "")
    stack = [root]
    marked: list[tuple[Node, list[Node]]] = []  # main and article elements, and what hides them
    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    # An inline element's end does not end the blocks inside which it is misnested.
                    if tag in INLINE and any(n.tag not in INLINE for n in stack[i + 1 :]):
                        break
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS_CLOSE_P:
            _close(stack, {"p"}, {"button", "td", "th", "table", "div", "article", "section"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        # Of a repeated attribute the first counts.
        attributes = {a.lower(): v.strip("\"'") for a, v in reversed(_ATTRIBUTE.findall(m[3]))} if m[3] else {}
        names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
        inside = any(n.tag == "article" for n in stack)
        # Numbers in names differ from page to page; the style is the same.
        look = re.sub(r"\d+", "0", attributes.get("class", "").lower()).strip()
        step = tag + (f".{look}" if look else "")
        if tag in ORDERED:
            nth = stack[-1].looks[step] = stack[-1].looks.get(step, 0) + 1
            step += f"#{nth}" if nth > 1 else ""
        node = Node(tag, f"{stack[-1].path}/{step}")
        node.stated = (
            tag in NEVER - WRAPPERS
            or "hidden" in attributes
            or attributes.get("aria-hidden", "") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        node.hidden = (
            node.stated
            or tag in NEVER and not (tag == "header" and inside)
            or tag not in ("html", "body", "main") and any(map(_NOISE.fullmatch, names.split()))
            or ("header" in names.split() and not inside)
        )
        if tag in ("article", "main"):
            hides = [n for n in (*stack, node) if n.hidden]
            if not any(n.stated for n in hides):
                marked.append((node, hides))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in BLOCKS_CLOSE_P:
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            node.children.append(page[at : end.start()] if end else page[at:])
            at = close + 1 if close >= 0 else len(page)
            continue
        stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    _reveal(root, marked)
    return root


def _reveal(root: Node, marked: list[tuple[Node, list[Node]]]) -> None:
    """Shows the wrappers of the main element and, if no article is seen otherwise, of the page's articles.

    Articles in a hidden part are the page's own if they hold more text than all that is seen without them; else they
    are teasers of other pages.
    """
    for node, hides in marked:
        if node.tag == "main":
            for n in hides:
                n.hidden = False
    articles = [(node, hides) for node, hides in marked if node.tag == "article"]
    if articles and all(any(n.hidden for n in hides) for _, hides in articles):
        names = [(n, n.hidden) for _, hides in articles for n in hides]
        before = sum(map(_length, _articles(root) or [root]))
        for n, _ in names:
            n.hidden = False
        if sum(map(_length, _articles(root))) <= before:
            for n, hidden in names:
                n.hidden = hidden


def _length(top: Node) -> int:
    """Characters of text seen under a node, white space at the ends of its pieces left out."""
    total, stack = 0, [top]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += len(c.strip())
            elif not c.hidden:
                stack.append(c)
    return total


def _close(stack: list[Node], names: set[str], fences: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in fences:
            return
        if stack[i].tag in names:
            del stack[i:]
            return


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def nodes(root: Node) -> dict[str, tuple[str, str]]:
    """Path -> (its child sequences, its direct texts) on this page, without what the page itself hides."""
    out: dict[str, tuple[list[str], list[str]]] = {}
    stack = [root]
    while stack:
        n = stack.pop()
        looks, texts = out.setdefault(n.path, ([], []))
        inner = [c for c in n.children if isinstance(c, Node)]
        looks.append(",".join(c.path.rsplit("/", 1)[1] for c in inner))
        texts += [t for t in (clean(c) for c in n.children if isinstance(c, str)) if t]
        stack += [c for c in inner if not c.stated]
    return {p: (";".join(a), "\n".join(b)) for p, (a, b) in out.items()}


def text_of(root: Node, noise: set[str], names: bool = True) -> str:
    """Blocks of the main content, in page order, two line breaks between them.

    noise: paths of the host's style tree whose whole branch has low importance;
    names: whether element names hide what is left, and mark the article. If
    nothing were left without the noise, it stays.
    """
    if not names:
        _unname(root)
    tops = (_articles(root) if names else []) or [root]
    for unwanted in (noise, set()) if noise else (set(),):
        blocks: list[str] = []
        for top in tops:
            _blocks(top, unwanted, blocks)
        if blocks:
            break
    return "\n\n".join(blocks)


def _unname(root: Node) -> None:
    stack = [root]
    while stack:
        n = stack.pop()
        n.hidden = n.stated
        stack += [c for c in n.children if isinstance(c, Node)]


def _articles(root: Node) -> list[Node]:
    """Outermost article elements, else the first main element, if any."""
    stack = [root]
    out: list[Node] = []
    mains: list[Node] = []
    while stack:
        n = stack.pop()
        if n.hidden:
            continue
        if n.tag == "article":
            out.append(n)
            continue
        if n.tag == "main":
            mains.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out or mains[:1]


def _blocks(top: Node, noise: set[str], blocks: list[str]) -> None:
    line: list[str] = []

    def flush() -> None:
        text = clean("".join(line))
        line.clear()
        if text:
            blocks.append(text)

    stack: list = [top]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.hidden or (n.path in noise and n.tag not in INLINE):
            if n.tag in BLOCKS_CLOSE_P:
                flush()
        elif n.tag == "br":
            line.append(" ")
        elif n.tag in INLINE:
            stack += reversed(n.children)
        else:
            flush()
            stack.append(None)
            stack += reversed(n.children)
    flush()


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def named(pages: DataFrame) -> DataFrame:
    """_id, _url, _host, _html, _copy (a hash of the page) of pages."""
    host = F.lower(F.nullif(F.regexp_extract(F.col("url"), HOST, 1), F.lit("")))
    return pages.select(
        F.col("page_id").alias("_id"),
        F.col("url").alias("_url"),
        host.alias("_host"),
        F.coalesce(F.col("html"), F.lit("")).alias("_html"),
        F.xxhash64("html").alias("_copy"),
    )


def style_tree(pages: DataFrame, stages: Stages, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(_host, _noise): for each host, the paths whose whole branch has low importance, without those below another.

    pages: as named() gives. Importance of a node with m different pages: the
    entropy, base m, of its child sequences or of its texts, whichever is
    larger. A branch is noise if that is low for every node in it and its top
    stands on at least min_pages pages.
    """
    names = ["_host", "_path", "_look", "_text", "_copy"]

    def run(batches):
        for b in batches:
            found: list[tuple] = []
            for host, page, copy in zip(*(b.column(c).to_pylist() for c in ("_host", "_html", "_copy"))):
                found += [(host, p, look, text, copy) for p, (look, text) in nodes(parse(page)).items()]
            columns = [pa.array(c, pa.string()) for c in zip(*(f[:4] for f in found))] or [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[4] for f in found], pa.int64())], names=names)

    # Pages without a host are nobody's: each is judged alone, by names.
    seen = pages.where(F.col("_host").isNotNull()).mapInArrow(run, "_host string, _path string, _look string, _text string, _copy bigint")
    # Values only matter as equal or not; hashes move instead of texts. Copies of a page count once.
    seen = stages.put(
        seen.select("_host", "_path", F.xxhash64("_look").alias("_look"), F.xxhash64("_text").alias("_text"), "_copy").distinct()
    )

    def entropy(column: str, name: str) -> DataFrame:
        n = seen.groupBy("_host", "_path", column).agg(F.count("*").alias("_n"))
        sums = n.groupBy("_host", "_path").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.log("_n")).alias("_s"))
        m = F.col("_m")
        # H = ln m - sum(n ln n) / m, in units of ln m.
        h = F.when(m > 1, (F.log(m) - F.col("_s") / m) / F.log(m)).otherwise(F.lit(1.0))
        return sums.select("_host", "_path", "_m", h.alias("_h"), F.lit(name).alias("_kind"))

    both = entropy("_look", "look").unionByName(entropy("_text", "text"))
    per = stages.put(both.groupBy("_host", "_path").agg(F.max("_m").alias("_m"), F.max("_h").alias("_h")))
    # A node is worth keeping if any node below it is: mark all its ancestors.
    steps = F.split(F.col("_path"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    wanted = (
        per.where((F.col("_h") >= min_importance) | (F.col("_m") < min_pages))
        .select(F.col("_host").alias("_h2"), F.explode(ancestors).alias("_p2"))
        .distinct()
    )
    same = (F.col("_host") == F.col("_h2")) & (F.col("_path") == F.col("_p2"))
    low = stages.put(per.join(wanted, same, "left_anti").select("_host", "_path"))
    # What stands below a block that goes need not be listed.
    last = F.regexp_extract(F.col("_path"), r"([^/.#]*)[^/]*$", 1)
    tops = low.where(~last.isin(*INLINE)).select(F.col("_host").alias("_h2"), F.col("_path").alias("_p2"))
    under = (F.col("_host") == F.col("_h2")) & (F.regexp_replace("_path", "/[^/]*$", "") == F.col("_p2"))
    return low.join(tops, under, "left_anti").groupBy("_host").agg(F.collect_set("_path").alias("_noise"))


def extract(
    pages: DataFrame, stages: Stages, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, names: bool = True
) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    source = named(pages)
    noise = stages.put(style_tree(source, stages, min_pages, min_importance)).withColumnRenamed("_host", "_h2")
    joined = source.join(noise, F.col("_host") == F.col("_h2"), "left").select("_id", "_url", "_html", "_noise")

    def run(batches):
        for b in batches:
            noises = b.column("_noise").to_pylist()
            texts = [text_of(parse(p), set(n or ()), names) for p, n in zip(b.column("_html").to_pylist(), noises)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = f"page_id {source.schema['_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return joined.mapInArrow(run, schema)
