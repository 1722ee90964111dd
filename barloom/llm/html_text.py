"""Main text of web pages, with the site's template removed.

Each page becomes a small element tree. Its removable subtrees (containers outside running text and articles that hold at most
half of the page's text) are hashed; Spark counts for each hash how many pages of a host that differ in the rest of their text
it stands on, and subtrees that recur so are deleted. What recurs on too few pages goes where its tag or names mark it as furniture:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments.
What is left of the article (or, without one, of the body) is the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, table

#: A subtree is template if it stands on at least this many pages of the host, of any size, whose other texts differ.
MIN_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
FURNITURE = frozenset(
    "head title script style noscript template iframe svg canvas nav footer aside form button select textarea dialog menu object audio video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers that a template may consist of; running text (paragraphs, headings, cells) never goes for recurring.
CONTAINERS = frozenset("div section ul ol dl table header footer nav aside form figure details center".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th".split())
#: What a start tag ends, up to the nearest of the elements behind it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class and id names that mark furniture, if the name's other words say nothing but where or in what form it stands.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored banner banners promo promos promotion cookie cookies consent notice notices sidebar "
    "sidebars menu menus nav navs navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus share sharing social related recommended "
    "newsletter subscribe signup login popup modal pagination skip gdpr fbcomments teaser teasers werbung anzeige anzeigen kommentar kommentare publicidad anuncio anuncios comentario "
    "comentarios publicite annonce annonces commentaire commentaires".split()
)
PLAIN_WORDS = frozenset(
    "site page main global primary secondary top bottom left right upper lower header mobile desktop sticky fixed box bar block blocks list lists link links item items icon icons "
    "button buttons wrap wrapper container inner outer content section area panel widget slot unit text label form post posts article articles thread to the and user users reader readers fb law info overlay count form".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(<[a-zA-Z/][^>]*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


@lru_cache(10_000)
def furniture_name(name: str) -> bool:
    """Whether one class or id names furniture: cookie-banner and siteFooter do, social-history and notice-of-meeting do not."""
    words = [w.lower() for w in _PARTS.findall(name) if len(w) > 1]
    return any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in PLAIN_WORDS for w in words)


def attributes_of(source: str) -> dict[str, str]:
    """The attributes of a start tag, the first of a name counting; those without a value are empty."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return found


def _hidden(found: dict[str, str]) -> bool:
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    rules = (rule.partition(":") for rule in found.get("style", "").lower().split(";"))
    return any(name.strip() == "display" and value.split()[:1] in (["none"], ["none!important"]) for name, _, value in rules)


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "mark", "removable", "size", "total", "article")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.names, self.role, self.children, self.mark = tag, "", "", [], 0
        self.hidden = self.removable = False
        if attributes:
            found = attributes_of(attributes)
            self.names = f"{found.get('class', '')} {found.get('id', '')}".strip()
            self.role = found.get("role", "").strip().lower()
            self.hidden = _hidden(found)

    def furniture(self) -> bool:
        if self.tag in ("html", "body", "main"):
            return False
        return self.tag in FURNITURE or self.hidden or self.role in FURNITURE_ROLES or any(map(furniture_name, self.names.split()))


def parse(source: str) -> Node:
    """An element tree of any input: open elements end where HTML lets them; a tag cut off at the end is dropped."""
    root = Node("html")
    stack, at, size = [root], 0, len(source)
    opened: Counter[str] = Counter()  # tags on the stack, so that a deep one is searched only for what it holds

    def cut(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw))

    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if m[4] is not None:  # unbalanced quotes, or the page ends inside a tag
            if not m[0].endswith(">"):
                break
            inner = re.match(r"<(/?)([a-zA-Z][^\s/>]*)(.*)", m[4], re.S)
            if not inner:
                continue
            closing, tag, attributes = inner[1], inner[2], inner[3]
        elif tag is None:
            continue
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag does not end blocks
            continue
        if tag in ("html", "body"):
            node = Node(tag, attributes)
            if tag == "body":
                root.children.append(node)
                cut(1)
                stack.append(node)
                opened[tag] += 1
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in ("table", "td", "th", "article", "body", "button"):
                    break
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ends) else ():
                if stack[i].tag in ends:
                    cut(i)
                    break
                if stack[i].tag in bounds:
                    break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else size])
            at = size if not end else (source.find(">", end.start()) + 1 or size)
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def mark(root: Node) -> dict[int, int]:
    """Hash every subtree and say which may be template; for each mark of these, the sum of hashes of the page's other texts.

    What tags or names call furniture is counted like the rest, but never belongs to the other texts.
    """
    nodes, todo = [], [(root, False, False)]
    while todo:
        node, running, kept = todo.pop()
        gone = node.furniture() or node.tag == "header"
        nodes.append((node, running or kept, gone))
        running, kept = running or node.tag in RUNNING, kept or gone or node.tag in ("article", "main")
        todo.extend((c, running, kept) for c in node.children if not isinstance(c, str))
    for node, _, gone in reversed(nodes):  # children come before their parents
        digest = xxhash.xxh3_64(f"<{node.tag} {node.names}>".encode("utf-8", "surrogatepass"))
        node.size, node.total, node.article = 0, 0, node.tag in ("article", "main") and not gone
        for child in node.children:
            if isinstance(child, str):
                raw = " ".join(child.split()).encode("utf-8", "surrogatepass")
                digest.update(raw)
                if raw and not gone:
                    node.size += len(raw)
                    node.total += xxhash.xxh3_64_intdigest(raw)
            else:
                digest.update(child.mark.to_bytes(8, "little"))
                node.article |= child.article
                if not gone:
                    node.size += child.size
                    node.total += child.total
        node.mark = digest.intdigest()
    found: dict[int, int] = {}
    for node, barred, gone in nodes:
        node.removable = node.tag in CONTAINERS and not (barred or node.article) and (gone or 0 < 2 * node.size <= root.size)
        if node.removable:
            found[node.mark] = found.get(node.mark, root.total) - node.total
    return found


def _articles(root: Node, tag: str) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.furniture():
            continue
        if node.tag == tag:
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def _weight(tops: list[Node]) -> int:
    """Characters of text outside furniture."""
    total, todo = 0, list(tops)
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                total += len("".join(child.split()))
            elif not child.furniture():
                todo.append(child)
    return total


def _tops(root: Node) -> list[Node]:
    """The articles; the main element where these hold less than half as much text; the page where there is neither."""
    articles, mains = _articles(root, "article"), _articles(root, "main")
    if articles and mains and 2 * _weight(articles) < _weight(mains):
        return mains
    return articles or mains or [root]


def rules_of(root: Node, template: frozenset[int]) -> tuple[int, int]:
    """(subtrees that recur on the host's pages, other subtrees that tags or names call furniture), anywhere on the page."""
    recurring = named = 0
    todo = [root]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                continue
            if child.removable and child.mark in template:
                recurring += 1
            elif child.furniture():
                named += 1
            else:
                todo.append(child)
    return recurring, named


def blocks_of(root: Node, template: frozenset[int]) -> list[str]:
    """The text blocks of the article in page order, white space folded."""
    tops = _tops(root)
    in_article = tops[0] is not root
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            out.append(words)

    def walk(top: Node) -> None:
        todo: list[Node | str | None] = list(reversed(top.children))  # None: a block ends here
        while todo:
            child = todo.pop()
            if child is None:
                end()
            elif isinstance(child, str):
                line.append(child)
            elif child.tag == "br":
                line.append(" ")
            else:
                if child.tag in BLOCKS:
                    end()
                if child.removable and child.mark in template or child.furniture() or child.tag == "header" and not in_article:
                    continue
                if child.tag in BLOCKS:
                    todo.append(None)
                todo.extend(reversed(child.children))

    for top in tops:
        walk(top)
        end()
    return out


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, marks, rests = [], [], []
        for i, source in enumerate(batch.column("html").to_pylist()):
            found = mark(parse(source or ""))
            page.extend([i] * len(found))
            marks.extend(map(_signed, found))
            rests.extend(map(_signed, found.values()))
        at = pa.array(page, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(at), batch.column("host").take(at), pa.array(marks, pa.int64()), pa.array(rests, pa.int64())],
            ["key", "host", "mark", "rest"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for source, marks in zip(batch.column("html").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            if not source:
                texts.append("")
                counts.append((0, 0))
                continue
            root = parse(source)
            if marks:
                mark(root)
            template = frozenset(m % (1 << 64) for m in marks or ())
            texts.append("\n".join(blocks_of(root, template)))
            counts.append(rules_of(root, template))
        text = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        recurring, named = (pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("row"), text, recurring, named], ["row", "text", "n_recurring", "n_named"])


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all but the html), text, n_recurring and n_named (see rules_of) for every row of pages.

    Null and empty html give an empty text; a null url is a host of its own; repeated rows and pages of equal
    text count once as evidence and keep a row each; an empty table gives no rows; pages of any depth and length are parsed whole. Counts per host come from partial aggregates, so a host of any size spreads over all tasks.
    """
    scratch = Scratch(pages.sparkSession)
    carry = [c for c in pages.columns if c != html_col] if carry is None else carry
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    key = F.xxhash64(F.col(url_col), F.col(html_col))
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), key.alias("key"), host.alias("host"), F.col(html_col).alias("html"))
    marks = scratch.put(keyed.select("key", "host", "html").mapInArrow(_subtrees, "key long, host string, mark long, rest long"))
    common = marks.groupBy("host", "mark").agg(F.count_distinct("rest").alias("n"))
    template = scratch.put(common.where(F.col("n") >= MIN_PAGES).select("host", "mark"))
    by_page = marks.join(template, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("marks"))
    joined = keyed.select("row", "key", "html").join(by_page, "key", "left").select("row", "html", "marks")
    schema = StructType([joined.schema["row"], *_parse_datatype_string("text string, n_recurring long, n_named long").fields])
    return joined.mapInArrow(_texts, schema)


def op2_site_template(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"), "n_recurring", "n_named")
