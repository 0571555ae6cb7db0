"""Main text of web pages by removal of site templates.

Every page is parsed into a tree, menus, footers and all, and each block element that has text gets a hash of its subtree. Spark
counts on how many different pages of a host, and of all hosts, each hash occurs; pages whose longest block is the same count
as one, so that copies of an article do not make it a template. Subtrees that recur on many pages are the site's template and
are deleted wherever they stand outside the page's main part; inside it only what most main parts of the host carry is.
The main part is the article or main element with most text, else the parent of the longest block that is no template.

Only then come names: what is left goes if its tag or role says that it is no content (navigation, forms and so on), and outside
the main part if one of its classes does. On hosts of too few pages to tell templates, an article or main element is taken alone.
What browsers never show (scripts, styles, hidden elements) takes no part in anything.

Defined cases: a null page has no text; broken markup is read as far as it goes (open elements end with the page, stray end tags
are ignored); a null or odd address belongs to the host ``""``; repeated rows get the same text; an empty table gives an empty
result. Only id, address and html are read. Deep nesting costs memory, not stack, and time in proportion.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
UNSEEN = frozenset("audio canvas embed head iframe input map noscript object option script select style svg template textarea title video".split())
NO_CONTENT = frozenset("aside button dialog fieldset footer form label menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CLASSES = frozenset(
    "ad ads adbox adslot advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie"
    " cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pagination paywall popup promo"
    " promotion related replies respond share sharing sidebar signup sitenav social sponsor sponsored subscribe topbar widget".split()
)
#: an end of the element on the right ends with a start of the one on the left
ENDS_OPEN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<=\s)(hidden)(?=[\s/]|$)""", re.I)


@dataclass(frozen=True)
class Template:
    """A subtree is a template from so many different pages, and so large a share, of a host on, or of all hosts (``any_*``);
    ``main_*``: inside main parts. The shares bound how many templates there can be."""

    min_pages: int = 5
    min_share: float = 0.01
    any_pages: int = 20
    any_share: float = 0.001
    main_pages: int = 10
    main_share: float = 0.6


TEMPLATE = Template()
MAIN = ("article", "main")
#: the most template marks that are broadcast; parts of a host's pages beyond
BROADCAST_ROWS, PARTS = 300_000, 16
#: stands for all hosts
ANY = "*"


class Node:
    __slots__ = ("tag", "parent", "children", "unseen", "listed", "classed", "mark", "has_text")

    def __init__(self, tag: str, parent: "Node | None", unseen: bool):
        self.tag, self.parent, self.unseen, self.children, self.mark, self.has_text = tag, parent, unseen, [], 0, False
        self.listed = self.classed = False


def name_attributes(node: Node, attrs: str, in_main: bool) -> None:
    """Sets whether the element is never shown (``unseen``), and what its tag or role (``listed``) and its classes (``classed``) say
    about it. Ids say nothing."""
    tag = node.tag
    node.unseen |= tag in UNSEEN
    node.listed = tag in NO_CONTENT or tag == "header" and not in_main
    if not attrs.strip() or tag in ("html", "body", "main"):
        return
    for m in ATTRIBUTE.finditer(attrs):
        if m[3]:
            node.unseen = True
            continue
        name, value = m[1].lower(), m[2].strip("\"'").lower()
        if name == "role" and value in ROLES:
            node.listed = True
        elif name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
            node.unseen = True
        elif name == "class" and not CLASSES.isdisjoint(value.split()):
            node.classed = True


class Open:
    """The open elements, with the places of each tag, so that no question walks through all of them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 if there is none."""
        return self.places[tag][-1] if self.places.get(tag) else 0

    def close(self) -> None:
        node = self.stack.pop()
        if self.stack:
            self.places[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
        if node.unseen:
            return
        parts = [f"<{node.tag}>"]
        for child in node.children:
            if isinstance(child, str):
                if words := " ".join(child.split()):
                    node.has_text = True
                    parts.append(words)
            elif not child.unseen and child.has_text:
                node.has_text = True
                parts.append(f"\x00{child.mark}")
        node.mark = xxhash.xxh3_64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)

    def close_from(self, place: int) -> None:
        while len(self.stack) > place:
            self.close()


def parse(page: str) -> Node:
    """The tree of a page; each node knows the hash of its subtree without what is never shown."""
    root = Node("#root", None, False)
    now, at = Open(root), 0
    while m := TOKEN.search(page, at):
        if m.start() > at and not now.stack[-1].unseen:
            now.stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if place := now.last(tag):
                now.close_from(place)
            continue
        if tag in BLOCKS and now.last("p") > now.blocks[-1]:
            now.close_from(now.last("p"))
        if tag in ENDS_OPEN:
            ended, held = (max(now.last(t) for t in kinds) for kinds in (ENDS_OPEN[tag], HOLDS[tag]))
            if ended > held:
                now.close_from(ended)
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        above = now.stack[-1]
        node = Node(tag, above, above.unseen)
        name_attributes(node, attrs or "", bool(now.last("article") or now.last("main")))
        if not above.unseen:
            above.children.append(node)
        if tag in RAW:  # no markup inside
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in UNSEEN:
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            now.push(node)
            now.close()
        elif tag in VOID or (attrs or "").rstrip().endswith("/") and tag not in BLOCKS:
            continue
        else:
            now.push(node)
    if at < len(page) and not now.stack[-1].unseen:
        now.stack[-1].children.append(html.unescape(page[at:]))
    now.close_from(0)
    return root


def inside(node: Node) -> Iterator[Node]:
    """The node's visible elements in page order, itself first."""
    stack = [node]
    while stack:
        node = stack.pop()
        if not node.unseen:
            yield node
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]


def block_sizes(root: Node, templates: frozenset[int] = frozenset()) -> dict[Node, int]:
    """Characters of text of each block's own, without what is listed or a template."""
    sizes: dict[Node, int] = {}
    stack: list[tuple[Node, Node]] = [(root, root)]
    while stack:
        node, block = stack.pop()
        if node.unseen or node.listed or node.tag in BLOCKS and node.mark in templates:
            continue
        block = node if node.tag in BLOCKS else block
        for child in node.children:
            if isinstance(child, str):
                if n := len(child.strip()):
                    sizes[block] = sizes.get(block, 0) + n
            else:
                stack.append((child, block))
    return sizes


def longest_block(sizes: dict[Node, int]) -> Node | None:
    """The block with most text of its own; of equal ones that with the smallest mark."""
    return min(sizes, key=lambda n: (-sizes[n], n.mark), default=None)


def main_part(root: Node, templates: frozenset[int] = frozenset()) -> Node:
    """The article or main element with most text, else the parent of the longest block."""
    sizes = block_sizes(root, templates)
    held: dict[Node, int] = {}
    for block, n in sizes.items():
        node, outermost = block, None
        while node is not None:
            outermost = node if node.tag in MAIN else outermost
            node = node.parent
        if outermost is not None:
            held[outermost] = held.get(outermost, 0) + n
    for tag in MAIN:
        if found := longest_block({n: size for n, size in held.items() if n.tag == tag}):
            return found
    longest = longest_block(sizes)
    return root if longest is None else longest.parent or root


def block_texts(root: Node, main: Node, templates: frozenset[int], main_templates: frozenset[int]) -> list[str]:
    """Texts of the page's blocks that are left."""
    above, node = set(), main
    while node is not None:
        above.add(node)
        node = node.parent
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list = [(root, root is main)]
    while stack:
        item, within = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.unseen:
            if item not in above:
                if item.listed or item.classed and not within:
                    continue
                if item.tag in BLOCKS and item.mark in (main_templates if within else templates):
                    continue
            if item.tag in BLOCKS:
                flush()
                stack.append((None, within))
            elif item.tag in ("br", "td", "th"):
                run.append(" ")
            stack += [(child, within or item is main) for child in reversed(item.children)]
    flush()
    return out


def main_text(page: str, templates: frozenset[int] = frozenset(), main_templates: frozenset[int] = frozenset(), few: bool = False) -> str:
    """``templates`` go outside the main part, ``main_templates`` inside; ``few``: the host has too few pages to tell any."""
    root = parse(page)
    main = main_part(root, templates)
    return "\n\n".join(block_texts(main if few and main.tag in MAIN else root, main, templates, main_templates))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def subtree_rows(pages: DataFrame) -> DataFrame:
    """host, mark, article, main: the hash of each block with text of a page, and of its longest block, once a page; and with
    ``main`` the same of the blocks inside the main part. Without a mark the row stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                rows: list[tuple[str, int | None, int, bool]] = []
                for url, page in zip(*(c.to_pylist() for c in whole.slice(start, 128).columns), strict=True):
                    root, host = parse(page or ""), host_of(url)
                    longest = longest_block(block_sizes(root))
                    article = longest.mark if longest else 0
                    for main, node in ((False, root), (True, main_part(root))):
                        rows += {(host, n.mark, article, main) for n in inside(node) if n.has_text and n.tag in BLOCKS} | {(host, None, article, main)}
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["host", "mark", "article", "main"])

    return pages.mapInArrow(run, "host string, mark bigint, article bigint, main boolean")


def site_templates(pages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """host, few, marks, main_marks: subtrees that recur across the host's pages, and across its main parts; whether it has too few
    pages; and a row for all hosts. At most (blocks a page / share) marks a host."""
    each = subtree_rows(pages).distinct()
    least = F.when(F.col("main"), template.main_pages).otherwise(F.when(F.col("host") == ANY, template.any_pages).otherwise(template.min_pages))
    share = F.when(F.col("main"), template.main_share).otherwise(F.when(F.col("host") == ANY, template.any_share).otherwise(template.min_share))
    counts = each.groupBy("host", "mark", "main").agg(F.count("*").alias("n"))
    # an article on several hosts counts once for each of them here, as its pages may be copies of one another's templates only
    overall = counts.where("NOT main").groupBy(F.lit(ANY).alias("host"), "mark", "main").agg(F.sum("n").alias("n"))
    counts = stored(counts.unionByName(overall).where(F.col("mark").isNull() | (F.col("n") >= least)), "html-counts")
    sizes = counts.where("mark IS NULL").select("host", "main", F.col("n").alias("pages"))
    often = counts.where("mark IS NOT NULL").join(sizes, ["host", "main"]).where(F.col("n") >= share * F.col("pages"))
    listed = lambda main: F.collect_list(F.when(F.col("main") == main, F.col("mark")))
    found = often.groupBy("host").agg(listed(False).alias("marks"), listed(True).alias("main_marks"))
    hosts = sizes.where("NOT main").select("host", (F.col("pages") < template.min_pages).alias("few"))
    none = F.array().cast("array<bigint>")
    return stored(hosts.join(found, "host", "left").select("host", "few", F.coalesce("marks", none).alias("marks"), F.coalesce("main_marks", none).alias("main_marks")), "html-templates")


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template: Template = TEMPLATE) -> DataFrame:
    """Per page: id, url, text, n_chars."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = site_templates(slim.select("url", "html"), template)
    size = templates.agg(F.sum(F.size("marks") + F.size("main_marks") + 1).alias("all"), F.sum(F.when(F.col("host") == ANY, F.size("marks"))).alias("any")).first()
    # what recurs on all hosts is bounded by its share; the rest is broadcast while it is small, otherwise each page meets its host's
    small = (size["all"] or 0) <= BROADCAST_ROWS
    sent_rows = templates if small else templates.where(F.col("host") == ANY)
    known = {r["host"]: (frozenset(r["marks"]), frozenset(r["main_marks"]), r["few"]) for r in sent_rows.collect()}
    sent = slim.sparkSession.sparkContext.broadcast(known)
    none = F.array().cast("array<bigint>")
    if small:
        joined = slim.withColumns({"marks": none, "main_marks": none, "few": F.lit(None).cast("boolean")})
    else:  # a host's pages are spread over parts, and its templates repeated for each
        named = slim.withColumn("host", F.udf(host_of, "string", useArrow=True)(F.col("url"))).withColumn("_part", F.pmod(F.xxhash64("url", "id"), F.lit(PARTS)).cast("int"))
        parts = templates.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = named.join(parts, ["host", "_part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        nothing = (frozenset(), frozenset(), True)
        everywhere = known.get(ANY, nothing)[0]
        together = {host: marks | everywhere for host, (marks, _, _) in known.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                texts = []
                for url, page, marks, main_marks, few in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "marks", "main_marks", "few")), strict=True):
                    if few is None:
                        host = host_of(url)
                        texts.append(main_text(page or "", together.get(host, everywhere), *known.get(host, nothing)[1:]))
                    else:
                        texts.append(main_text(page or "", frozenset(marks) | everywhere, frozenset(main_marks), few))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = slim.schema["id"].dataType.simpleString()
    out = joined.select("id", "url", "html", "marks", "main_marks", "few").mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
