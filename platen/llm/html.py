"""Main text of web pages by consensus host paths (operator 5).

1. Each page is parsed and its containers are scored; the best one's path is the page's vote. A path is the chain of
   tags from the body with their classes, in which digits are generalised, so that ``post-12`` and ``post-7`` vote alike.
2. Votes are counted by host in Spark; the path with the most votes (then the greatest score, then the smallest) wins.
3. Each page is extracted again from all containers at its host's winning path, or from its own best container where it
   has no such path.

Blocks come in page order, joined by an empty line. Dropped wherever they stand: navigation, page headers and footers,
asides, notices, adverts, forms, scripts, styles, comments of readers and markup. A header inside the article keeps its
headings. An element is dropped for its tag or role alone, but for words in its class or id only if it holds less than
half of its page's text, so that a wrapper named ``has-sidebar`` or ``related-work`` around the article stays; comments, which
may be longer than their article, go unless they hold a main, an h1 or all text.

Nodes know whether a heading is around them, the open elements of each tag are kept by tag, and a path is followed level by
level, so the work is linear in the page's length however deep its elements are.

Defined cases: null or empty html gives an empty text; a null or odd url has no host, and such pages use their own
container; unclosed and stray tags are closed or ignored as browsers do; very long pages are read whole; of equal votes
the path with more text, then the smaller one wins, of equal containers the first; rows of equal page_id each come back;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, tune, written
from .hashing import bounded

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_CUT = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?\Z")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|/)")
# Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set("html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption center".split())
CONTAINER = set("body article main section div td center".split())
DROPPED = set("head script style noscript template iframe object embed svg math canvas audio video select option button input textarea form fieldset nav menu aside footer dialog title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROPPED_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription sidebar aside widget widgets menu nav navbar navigation navigations breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations popup modal overlay paywall login signup hidden skip toolbar pagination pager".split())
COMMENT_WORDS = set("comment comments commentlist reply replies respond disqus".split())
HEADER_WORDS = set("header".split())
# Elements that words in classes never drop, and how open elements end.
WHOLE = ("body", "html", "article", "main")
SCOPE = "div article section main td th table blockquote ul ol li form aside nav header footer".split()
CLOSES_ALL = BLOCK | CONTAINER
ENDS = {
    "li": (("li",), ("ul", "ol", "dl", "table", "select", "menu")),
    "option": (("option",), ("ul", "ol", "dl", "table", "select", "menu")),
    "dt": (("dt", "dd"), ("ul", "ol", "dl", "table", "select", "menu")),
    "dd": (("dt", "dd"), ("ul", "ol", "dl", "table", "select", "menu")),
    "td": (("td", "th"), ("ul", "ol", "dl", "table", "select", "menu", "tr")),
    "th": (("td", "th"), ("ul", "ol", "dl", "table", "select", "menu", "tr")),
    "tr": (("tr", "td", "th"), ("ul", "ol", "dl", "table", "select", "menu")),
}
#: A container is chosen if it has this part of the page's text, an article or main if it has that part of its parent's.
MOST, ARTICLE = 0.85, 0.5


_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "header", "heading", "size", "links", "step")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, named: str = "", header: bool = False, step: str = ""):
        self.tag, self.parent, self.children, self.step = tag, parent, [], step or tag
        self.drop, self.named = drop, named  # by tag or role, here or above; by words in its own class or id
        self.header, self.heading = header, tag in HEADINGS or parent is not None and parent.heading
        self.size = self.links = 0


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw else {}


def _open(tag: str, raw: str, parent: Node) -> Node:
    if not raw:
        return Node(tag, parent, parent.drop or tag in DROPPED, "", parent.header or tag == "header")
    have = _attributes(raw)
    names = f"{have.get('class', '')} {have.get('id', '')}".lower()
    words = set(_WORD.findall(names)) if tag not in WHOLE and names.strip() else set()
    hides = "hidden" in raw and ("hidden" in have or _HIDDEN.search(raw)) or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "")
    drop = parent.drop or tag in DROPPED or have.get("role", "").lower() in DROPPED_ROLES or bool(hides)
    header = parent.header or tag == "header" or bool(words & HEADER_WORDS)
    classes = sorted({_DIGITS.sub("#", c) for c in have.get("class", "").lower().split()})
    named = "comment" if words & COMMENT_WORDS else "other" if words & DROPPED_WORDS else ""
    return Node(tag, parent, drop, named, header, tag + "".join("." + c for c in classes))


class _Stack:
    """The open elements, with the places of each tag's, so that the nearest one of some tags is found without a walk."""

    def __init__(self, body: Node):
        self.nodes, self.places = [body], {}

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 (the body's) if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def parse(html: str) -> Node:
    """The page as a tree below its body; children are nodes and texts, character references decoded."""
    body = Node("body", Node("html", None))
    body.parent.children.append(body)
    stack, at, end = _Stack(body), 0, len(html)
    cut = _CUT.search(html, max(0, end - 4096))
    end = cut.start() if cut else end
    while at < end:
        m = _TAG.search(html, at, end)
        text = html[at : m.start() if m else end]
        if text:
            stack.nodes[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag in ("html", "body"):
            continue
        if closing:
            place = stack.last((tag,))
            if place and (tag in CLOSES_ALL or place > stack.last(("td", "th", "article", "main"))):
                stack.cut(place)
            continue
        if tag in BLOCK:  # what is open inside a p ends with it
            place = stack.last(("p", *HEADINGS) if tag in HEADINGS else ("p",))
            if place > stack.last(SCOPE):
                stack.cut(place)
        if tag in ENDS:
            same, stop = ENDS[tag]
            place = stack.last(same)
            if place > stack.last(stop):
                if tag == "tr":  # cells of the open row end with it
                    place = max(stack.last(("tr",)), 0) if stack.last(("tr",)) > stack.last(stop) else place
                stack.cut(place)
        node = _open(tag, raw, stack.nodes[-1])
        stack.nodes[-1].children.append(node)
        if tag in VOID or raw.endswith("/") and tag in ("path", "svg"):
            continue
        if tag in RAW:
            close = _CLOSE[tag].search(html, at, end)
            at = close.end() if close else end
            continue
        stack.push(node)
    return body


def _nodes(top: Node) -> list[Node]:
    """All nodes from ``top`` down, parents before their children, in page order."""
    order, stack = [], [top]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.children) if not isinstance(c, str)]
    return order


def _sum(order: list[Node]) -> None:
    """Sizes of the text below each node that could be content, and of its links."""
    inside = set()
    for x in order:
        x.size = x.links = 0
        if x.tag == "a" or id(x.parent) in inside:
            inside.add(id(x))
        if not x.drop and (not x.header or x.heading):
            x.size = sum(len(c.strip()) for c in x.children if isinstance(c, str))
            x.links = x.size if id(x) in inside else 0
    for x in reversed(order):
        x.parent.size += x.size
        x.parent.links += x.links


def _drop(order: list[Node], these: set[int]) -> None:
    """Drop the named nodes and all below them, and take the sizes anew."""
    if these:
        for x in order:
            x.drop = x.drop or x.parent.drop or id(x) in these
        _sum(order)


def _measure(body: Node) -> list[Node]:
    """Sizes, after words in classes and ids have dropped what they may. Returns the nodes."""
    order = _nodes(body)
    _sum(order)
    said = [x for x in order if x.named == "comment"]
    if said:
        titled: set[int] = set()
        for x in reversed(order):
            if x.tag in ("h1", "main") or id(x) in titled:
                titled.add(id(x.parent))
        _drop(order, {id(x) for x in said if id(x) not in titled and x.size < body.size})
    _drop(order, {id(x) for x in order if x.named == "other" and 2 * x.size < body.size})
    return order


def best(body: Node) -> Node:
    """The deepest container that still has most of the page's text, or the outermost article or main with half of its parent's.

    Below an article or main only another one is chosen, and only if it has all of its text.
    """
    now = body
    whole = now.size - now.links
    while True:
        inner, stack = [], [c for c in now.children if not isinstance(c, str)]
        while stack:
            c = stack.pop()
            if c.tag in CONTAINER and not c.drop:
                inner.append(c)
            elif not c.drop:
                stack += [x for x in c.children if not isinstance(x, str)]
        score = lambda c: (c.size - c.links) * (2 if c.tag in ("article", "main") else 1)
        inner = [c for c in inner if c.size]
        if not inner:
            return now
        top = max(reversed(inner), key=score)
        own, article = top.size - top.links, top.tag in ("article", "main")
        if now.tag in ("article", "main"):
            if not article or top.size < now.size:
                return now
        elif own < (ARTICLE * (now.size - now.links) if article else MOST * whole):
            return now
        now = top


def path(node: Node | None) -> str:
    steps = []
    while node is not None:
        steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def at_path(body: Node, wanted: str) -> list[Node]:
    """The containers at a generalised path, in page order; none is inside another, as all are as deep."""
    steps = wanted.split(">")[1:]
    level = [body] if steps and body.step == steps[0] else []
    for step in steps[1:]:
        level = [c for x in level for c in x.children if not isinstance(c, str) and c.step == step and not c.drop]
    return level


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below ``top`` in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = _SPACE.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x is not top and x.drop:
            now.append(" " if x.tag not in BLOCK else "")
            if x.tag in BLOCK:
                flush()
        elif x.tag in ("br", "img", "wbr"):
            now.append("" if x.tag == "wbr" else " ")
        else:
            inside = x.header and not top.header and not x.heading
            children = [c for c in x.children if not (inside and isinstance(c, str))]
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            elif x.tag in ("td", "th"):
                now.append(" ")
                stack.append(" ")
            stack += reversed(children)
    flush()
    return out


def vote(html: str | None) -> tuple[str, int] | None:
    """The path of the page's best container and its text's size."""
    body = parse(html or "")
    _measure(body)
    top = best(body)
    return (path(top), top.size - top.links) if top.size else None


def extract(html: str | None, wanted: str | None = None) -> str:
    body = parse(html or "")
    _measure(body)
    tops = at_path(body, wanted) if wanted else []
    if not any(top.size for top in tops):
        tops = [best(body)]
    return "\n\n".join(b for top in tops for b in blocks(top))


def host(url: str) -> "F.Column":
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def winners(pages: DataFrame) -> DataFrame:
    """host and its winning path, one row a host."""

    def run(batches):
        for batch in batches:
            for part in bounded(batch, "html"):
                votes = [vote(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array([v and v[0] for v in votes], pa.string()), pa.array([v and v[1] for v in votes], pa.int64())], names=["host", "path", "score"])

    votes = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(run, "host string, path string, score long")
    counted = votes.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path"))
    return written(counted.withColumn("r", first).filter("r = 1").select("host", "path"), "paths")


def main_texts(pages: DataFrame, most_broadcast: int = 20_000) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tune(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host("url").alias("host"))
    won = small(winners(pages), most_broadcast)

    def run(batches):
        for batch in batches:
            for part in bounded(batch, "html"):
                texts = [extract(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.join(won, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
