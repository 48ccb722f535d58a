"""Main text of web pages by a site style tree.

The pages of one host are merged: an element node is the path of tag, id and class from the root; a
style node is the sequence of child elements a page shows under it.  Importance of an inner node is the
entropy of its styles over the host's pages (base the number of pages), composed with that of its
children; of a leaf it is one less the mean entropy of its content features (texts, link targets) over
the pages.  Everything alike on all pages tends to 0, what differs to 1.

From each page go: invisible elements, elements whose tag or role or one of whose ids / classes names a
boilerplate part (the whole name, or its first part: ``share-buttons``; not ``with-sidebar``), and branches that are low: the element and all below it are on at least ``pages_least``
pages of the host and of an importance below ``least``.  If a page has an ``article`` or ``main``, text
outside it goes; inside, an inline element among text is part of its sentence and goes only with its block.
Where the low branches are all there is to a page (one article under many urls), its text stays.

A branch named as boilerplate stays if the headline or every ``article`` / ``main`` would go with it.

The parser reads tags as they come: missing end tags are closed by the next block of the same kind or by
an enclosing end tag, stray ones ignored; its time is in proportion to the page, whatever is unclosed or
nested.  Nodes are known by a hash of their path.  Below ``HEIGHT`` levels a node counts as its ancestor
there, in the tree only: its text is kept or goes with that.

Null and empty html is an empty page, an empty table gives an empty result; ids may be null or repeat.  Pages
without a host are one site.  The merged trees are a table of (host, node), never gathered on the driver;
pages meet the roots of their host's low branches by a join: as many as its templates have, however many
pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
HEIGHT = 64
ATTR = re.compile(r"(?<![^\s\"'/])([^\s=\"'<>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Never shown, or not article text by their meaning.
DROP = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea input label menu dialog noembed noframes xmp title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Take no room on the page, so text around them is one block.
UNSEEN = frozenset("script style template noscript".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements whose end tags close what is open inside; missing ones are not looked for beyond them.
HOLDS = frozenset("ul ol table dl article main section div body td th li blockquote".split())
BLOCK = frozenset("address article aside blockquote body center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A whole id or class, or the start of one up to a hyphen or underscore; ``site-`` and the like may stand before.
BOILER = re.compile(r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary)[_-]|(?:post|entry|article)[_-](?!header|footer))?(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|comment-\w+|respond|replies|disqus|widget|toolbar|pagination|pager|legal|disclaimer|copyright|skip|search)(?:[_-].*)?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "path", "level", "kids", "parent", "bad", "named", "main")

    def __init__(self, tag: str, name: str, parent: Node | None, bad: bool = False, main: bool = False):
        self.tag, self.parent, self.bad, self.main, self.named = tag, parent, bad, main, False
        self.level = 0 if parent is None else min(parent.level + 1, HEIGHT)
        self.path = _h(name) if parent is None else parent.path if parent.level == HEIGHT else _h(f"{parent.path}/{name}")
        self.kids: list[Node | str] = []


class _Tags:
    """Where tags end; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.none = page, False
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if none does.  A quote that never closes is a character like others."""
        page, last = self.page, self.last
        while at <= last[">"]:
            m = STOP.search(page, at)
            c = m[0]
            if c == ">":
                return m.start()
            at = m.end()
            if at <= last[c]:
                at = page.find(c, at) + 1
        return -1


def parse(page: str) -> Node:
    """A light tree: ``kids`` are nodes and strings in order.  Raw text elements keep no content."""
    root = node = Node("", "", None)
    tags, at, n = _Tags(page), 0, len(page)
    open_tags: dict[str, int] = {}

    def leave(to: Node) -> Node:
        """Close elements up to and without ``to``."""
        x = node
        while x is not to:
            open_tags[x.tag] -= 1
            x = x.parent
        return to

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            node.kids.append(page[at:])
            break
        if lt > at:
            node.kids.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            node.kids.append(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt) and tags.last[">"] > lt:
            at = page.find(">", lt) + 1
            continue
        closing = page.startswith("</", lt)
        m = NAME.match(page, lt + 1 + closing)
        end = tags.end(m.end()) if m else -1
        if end < 0:  # no tag: a character like others
            node.kids.append("<")
            at = lt + 1
            continue
        tag, raw, at = m[0].lower(), page[m.end() : end], end + 1
        if closing:
            if open_tags.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up.parent)
            elif tag == "p":
                node.kids.append(Node("p", "p", node))
            continue
        if tag in CLOSES or tag in BLOCK:
            ends = CLOSES.get(tag, ()) + (("p",) if tag in BLOCK else ())
            if any(map(open_tags.get, ends)):
                up = node
                while up is not root and (up.tag not in HOLDS or up.tag in ends):
                    if up.tag in ends:
                        node = leave(up.parent)
                        break
                    up = up.parent
        name, bad, named = tag, tag in DROP, False
        main = tag == "main" or tag == "article"
        if raw and "=" in raw:
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(raw)}
            marks = " ".join(x for x in (attrs.get("id"), attrs.get("class")) if x)
            if marks:
                name = f"{tag}.{marks}"
                named = tag not in ("html", "body", "article", "main") and any(map(BOILER.fullmatch, marks.split()))
            role = attrs.get("role", "")
            bad = bad or role in ROLES
            main = main or role == "main"
        if raw and (" hidden" in raw.lower() or "display:none" in raw.replace(" ", "").lower()) and re.search(r"(?:\s|^)hidden(?:\s|=|$)|display\s*:\s*none", raw, re.I):
            bad = True
        new = Node(tag, name, node, bad, main)
        new.named = named
        node.kids.append(new)
        if tag in RAW and not raw.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "title":
                new.kids.append(page[at : stop.start() if stop else n])
            at = stop.end() if stop else n
        elif tag not in VOID and not raw.endswith("/"):
            node = new
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def mark_named(root: Node) -> None:
    """Branches with a telling name are bad, unless they hold the headline or all there is of ``article`` / ``main``."""
    nodes = list(_walk(root))
    if not any(x.named for x in nodes):
        return
    # how many mains a node stands in, and the nearest
    around: dict[Node, tuple[int, Node | None]] = {root: (0, None)}
    for x in nodes[1:]:
        n, near = around[x.parent]
        around[x] = (n + 1, x.parent) if x.parent.main else (n, near)
    # of mains inside mains the outer ones, so that work stays in proportion to the page
    mains = [x for x in nodes if x.main and around[x][0] < 4]
    inner: dict[Node, list[Node]] = {root: mains}
    for y in mains:
        x = around[y][1]
        while x is not None:
            inner.setdefault(x, []).append(y)
            x = around[x][1]
    for x in mains or [root]:
        _spare(_headline(x), x)
    for x in [root, *(x for x in mains if x.tag != "article")]:
        if all(_named(y, x) for y in inner.get(x, ())) and (x is root or not _text(x)):
            for y in inner.get(x, ()):
                _spare(y, x)
    for x in nodes:
        x.bad = x.bad or x.named


def _headline(top: Node) -> Node | None:
    """The first ``h1``, those outside named branches first; without one, an ``h2`` ahead of the paragraphs of an article."""
    heads = [x for x in _walk(top) if x.tag == "h1"]
    if not heads and top.tag == "article":
        heads = [x for x in _walk(top) if x.tag in ("h2", "p")][:1]
        heads = [x for x in heads if x.tag == "h2"]
    return next((x for x in heads if not _named(x, top)), heads[0] if heads else None)


def _text(top: Node) -> bool:
    """Whether there is text outside named and dropped branches."""
    stack = [top]
    while stack:
        x = stack.pop()
        for k in x.kids:
            if isinstance(k, str):
                if k.strip():
                    return True
            elif not (k.named or k.bad):
                stack.append(k)
    return False


def _named(node: Node, top: Node) -> bool:
    """Whether ``node`` stands in a named branch below ``top``."""
    while node is not top:
        if node.named:
            return True
        node = node.parent
    return False


def _spare(node: Node | None, top: Node) -> None:
    while node is not None and node is not top:
        node.named = False
        node = node.parent


def _walk(node: Node) -> Iterator[Node]:
    """The nodes of a branch in order."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]


def mark_headers(root: Node) -> None:
    """A header goes too, but inside an article one that carries the headline stays."""
    nodes = list(_walk(root))
    if not any(x.tag == "header" for x in nodes):
        return
    heads = set()
    for x in reversed(nodes):
        if (x in heads or x.tag in ("h1", "h2")) and x.parent is not None:
            heads.add(x.parent)
    inside: set[Node] = set()
    for x in nodes:
        if x.parent is not None and (x.parent.main or x.parent in inside):
            inside.add(x)
        if x.tag == "header":
            x.bad = x.bad or not (x in inside and x in heads)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _h(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


STYLE = "host string, node bigint, parent bigint, level int, kind int, feature bigint, c bigint"


def observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, parent, level, kind, feature, pages): kind 0 counts pages with the node, 1 its styles, 2 its content features."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            tally: dict = {}
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                seen: set = set()
                root = parse(page or "")
                places = {root: (root.path, 0, 0)}
                for x in _walk(root):
                    if x is not root:
                        places[x] = places[x.parent] if x.parent.level == HEIGHT else (x.path, x.parent.path, x.level)
                    at = places[x]
                    seen.add((*at, 0, 0))
                    if x.level < HEIGHT:
                        blocks = dict.fromkeys(k.path for k in x.kids if isinstance(k, Node) and k.tag not in INLINE)
                        seen.add((*at, 1, _h("|".join(map(str, blocks)))))
                    own = " ".join(" ".join(k.split()) for k in x.kids if isinstance(k, str)).strip()
                    if own:
                        seen.add((*at, 2, _h(own)))
                host = host_of(url)
                for k in seen:
                    tally[host, *k] = tally.get((host, *k), 0) + 1
            if tally:
                cols = list(zip(*tally))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0])] + [pa.array(c, t) for c, t in zip((*cols[1:], tally.values()), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "node", "parent", "level", "kind", "feature", "c"])


def importances(pages: DataFrame, scratch: Scratch, damping: float, least: float, pages_least: int) -> DataFrame:
    """``host, node, parent, m, importance, low`` of the merged trees; ``low``: the node and all below it are."""
    seen = pages.mapInArrow(observations, STYLE).groupBy("host", "node", "parent", "level", "kind", "feature").agg(F.sum("c").alias("c"))
    seen = scratch.table(seen, "observations")
    size = seen.where("kind = 0").groupBy("host", "node", "parent", "level").agg(F.sum("c").alias("m"))
    parts = seen.where("kind > 0").groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))).alias("style"),
        F.avg(F.when(F.col("kind") == 2, F.log("c"))).alias("content"),
    )
    nodes = size.join(parts, ["host", "node"], "left")
    # entropy of styles, base m: ln m - sum c ln c / m, over ln m; a feature shown alike on c pages has entropy ln c / ln m
    own = F.when(F.col("m") <= 1, 1.0).otherwise(1 - F.coalesce(F.col("style") / F.col("m"), F.lit(0.0)) / F.log("m"))
    leaf = F.when(F.col("m") <= 1, 1.0).when(F.col("content").isNotNull(), 1 - F.col("content") / F.log("m"))
    nodes = scratch.table(nodes.select("host", "node", "parent", "level", "m", own.alias("own"), leaf.alias("leaf")), "nodes")
    scratch.drop(seen)
    out = []
    for level in range(nodes.agg(F.max("level")).head()[0] or 0, -1, -1):  # from the deepest level to the root
        here = nodes.where(F.col("level") == level)
        if out:  # children's importance, weighted by the pages that show them
            below = out[-1].groupBy("host", F.col("parent").alias("node")).agg((F.sum(F.col("importance") * F.col("m")) / F.sum("m")).alias("kids"), F.min("low").alias("kids_low"))
            here = here.join(below, ["host", "node"], "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("double")).withColumn("kids_low", F.lit(None).cast("boolean"))
        text = F.coalesce("leaf", F.lit(0.0))
        here = here.withColumn("importance", F.when(F.col("kids").isNull(), text).otherwise(F.greatest(text, (1 - damping) * F.col("own") + damping * F.col("kids"))))
        low = (F.col("m") >= pages_least) & (F.col("importance") < least) & F.coalesce("kids_low", F.lit(True))
        out.append(scratch.table(here.select("host", "node", "parent", "m", "importance", low.alias("low")), "level"))
    scratch.drop(nodes)
    schema = out[0].schema
    return pages.sparkSession.read.schema(schema).parquet(*(x._brindle_path for x in out))


def main_text(page: str, low: frozenset[int]) -> str:
    """The kept blocks of a page joined by one space; ``low``: nodes of low branches on its host."""
    root = parse(page)
    mark_named(root)
    mark_headers(root)
    tops = _mains(root) or [root]
    return " ".join(_blocks(tops, low) or low and _blocks(tops, frozenset()) or [])


def _blocks(tops: list[Node], low: frozenset[int]) -> list[str]:
    blocks: list[str] = []
    for top in tops:
        run: list[str] = []
        stack: list = [(top, top.main, False)]
        while stack:
            x = stack.pop()
            if x is None:
                _flush(run, blocks)
            elif isinstance(x, str):
                run.append(x)
            else:
                node, inside, among = x
                if node.bad or low and not (inside and among and node.tag in INLINE) and node.path in low:
                    if node.tag not in INLINE and node.tag not in UNSEEN:
                        _flush(run, blocks)
                    continue
                text = among and node.tag in INLINE or any(isinstance(k, str) and k.strip() for k in node.kids)
                inner = [k if isinstance(k, str) else (k, inside or k.main, text) for k in node.kids]
                if node.tag not in INLINE:
                    _flush(run, blocks)
                    inner.append(None)
                stack += reversed(inner)
        _flush(run, blocks)
    return blocks


def _flush(run: list[str], blocks: list[str]) -> None:
    if run:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()


def _mains(root: Node) -> list[Node]:
    """The outermost ``article`` / ``main`` elements that stand in no dropped branch; inside ``main`` its articles, if any."""
    found: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        x, around = stack.pop()
        if x.bad:
            continue
        if x.main:
            found.append((x, around))
            if x.tag == "article":
                continue
        stack += [(k, x if x.main else around) for k in reversed(x.kids) if isinstance(k, Node)]
    holding = {around for _, around in found}
    return [x for x, _ in found if x not in holding]


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.35, pages_least: int = 8, damping: float = 0.9
) -> DataFrame:
    """``page_id, url, text`` for every row."""
    scratch = Scratch(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = importances(pages, scratch, damping, least, pages_least)
    # of each low branch its root: what is below goes with it
    low = scratch.table(tree.where(F.col("low") & (F.col("node") != _h(""))).select("host", "node", "parent"), "low")
    above = low.select("host", F.col("node").alias("parent"))
    low = scratch.table(low.join(above, ["host", "parent"], "left_anti").groupBy("host").agg(F.collect_list("node").alias("low")), "roots")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for page, nodes in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    key = tuple(nodes or ())
                    if key not in sets:
                        sets[key] = frozenset(key)
                    texts.append(main_text(page or "", sets[key]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = pages.withColumn("host", host).join(low, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(run, "page_id bigint, url string, text string")
