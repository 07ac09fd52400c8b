"""Main text of web pages: site templates go, the article stays.

*Template removal.* Every element's subtree gets a hash of its tag, its text and its
children. Spark counts, per host, on how many pages each hash occurs; a subtree that occurs
on many pages of its host is template and is deleted wherever it stands. "Many" counts
pages that differ in title or main headings, so copies of one page do not make its article a
template; a page without a title stands for itself, as its only heading may be a logo. Many are
at least ``LEAST_PAGES`` of them and at least ``LEAST_SHARE`` of the host's. Paragraphs,
headings, list items and the like inside an element marked as the article are text,
however often they recur; containers in it (boxes, notices) are not safe.

*Marked parts.* Elements that say what they are go as well: menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments, by tag, role, class or id.
Names of articles' sections are made of the same words ("market-share", "cookies"), so
inside the article, and for headings, sections and other text anywhere, only names that
that can mean nothing else count, and ids of headings and sections never do.

*Votes.* Any other name that might mark a box (comments, a notice, a promotion) is one vote. A
second one deletes the box: a class that is just that word; the same box, whatever its text, on
many pages of its host (these shapes are counted like subtrees); or, for reader comments, a
thread (siblings of one kind, dates, authors) or a place behind all other text. A box that holds
the page's main heading stays.

If the page marks its article (``article``, else ``main``) and this holds most of the text
that is left, only that is read; teaser cards are no reason to leave out the rest.

A host's list of template hashes holds at most its mean number of elements per page over
``LEAST_SHARE``. It is sent to the tasks if all lists together are small; else pages meet
their host's list in a join whose hot hosts adaptive execution splits.

Text: character references are decoded, elements that start a block and ``br`` end the one
before, white space of any kind becomes one space, blocks are joined by one space.

Cases: null html is an empty page; a null or odd url is a host of its own kind (""). Broken
markup closes what it can: unknown end tags are ignored, open elements end with their
parent. Repeated rows get a row each. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, slices

LEAST_PAGES = 5
LEAST_SHARE = 0.2
BROADCAST_HOSTS = 50_000
BROADCAST_HASHES = 1_000_000
BATCH_ROWS = 200

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose start ends an open element of the second kind.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
ENDS_P = BLOCK - {"br", "body", "html", "head", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "option"}
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main"))

# What is never main text.
DROP_TAGS = frozenset(
    "head title script style noscript template iframe object embed svg canvas audio video map form button select textarea "
    "input label nav footer aside menu dialog".split()
)
ASIDES = frozenset(("nav", "aside", "footer", "template", "noscript", "dialog"))
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav aside "
    "widget widgets menu menus nav navbar navigation navlinks breadcrumb breadcrumbs header masthead topbar footer bottombar "
    "comment comments commentlist disqus respond reply replies related recommended share sharing social pagination pager skip "
    "toolbar login search".split()
)
#: The part of these that means nothing else at either end of a name.
CLEAR_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense gdpr newsletter sidebar sidenav navbar navlinks breadcrumb breadcrumbs "
    "topbar bottombar commentlist disqus pagination pager".split()
)
#: Whole names that mean nothing else, though their words do.
CLEAR_WHOLE = CLEAR_NAMES | frozenset(
    "comments comment-list comment-form comment-section comments-area user-comments post-comments related-posts related-articles "
    "related-stories related-links recommended-posts share-buttons share-links share-bar social-share social-links social-icons "
    "social-media-links sharing-buttons cookie-banner cookie-notice cookie-consent cookie-bar subscribe-form subscribe-box "
    "newsletter-signup signup-form search-form search-box login-form skip-link skip-links skip-to-content promo-box sponsored-content".split()
)
#: Words that also begin or end the slugs of articles' sections; outside the article they count as whole names only.
SLUG_WORDS = frozenset(
    "share sharing social search login related recommended alert cookie cookies consent notice notices notification promo promotion "
    "subscribe subscription signup reply replies respond skip sponsor sponsored advertising banner header footer overlay modal popup "
    "navigation comment masthead toolbar widget widgets".split()
)
#: The part of these that also marks an ``article`` as no main text.
DROP_ARTICLES = frozenset("ad advert comment comments reply replies related recommended promo sponsored respond".split())
#: First words of class names that only say what a wrapper holds.
HOLDS = frozenset("has with no without is not js".split())
KEEP_TAGS = frozenset(("html", "body", "article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th b i em strong a span u s q code cite small sub sup br mark figcaption".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Boxes that a name can vote against, and the words that do. Headers, banners and widgets often hold the text itself.
BOXES = frozenset("div section ul ol dl p figure details table".split())
VOTE_NAMES = DROP_NAMES - frozenset("header masthead banner toolbar overlay search widget widgets navigation".split())
TALK = frozenset("comment comments reply replies respond".split())
WRITERS = frozenset("author avatar byline commenter username date timestamp reply permalink".split())
ENTRIES = frozenset("li div article section".split())
ENOUGH = 2

# A quote opens a value only behind an equals sign; elsewhere in a tag it is an ordinary character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|([^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: its children, its subtree's hash, and what speaks against it."""

    __slots__ = ("tag", "attributes", "drop", "kids", "digest", "votes", "talk", "shape", "top")

    def __init__(self, tag: str, drop: bool, attributes: str = ""):
        self.tag, self.attributes, self.drop, self.kids, self.digest = tag, attributes, drop, [], 0
        self.votes, self.talk, self.shape, self.top = 0, False, 0, tag == "h1"


def named(value: str, ends: frozenset, whole: frozenset) -> bool:
    """Whether a class or id begins or ends with one of some words, or is one of some names."""
    for one in value.split():
        words = [x.lower() for x in NAME.findall(one)]
        if words and words[0] not in HOLDS and (words[0] in ends or words[-1] in ends or "-".join(words) in whole):
            return True
    return False


def names_for(tag: str, kind: str, in_article: bool) -> tuple[frozenset, frozenset]:
    """The words and whole names that mark an element by its class or id."""
    none = frozenset()
    slug = kind == "id"
    if tag == "article":
        return none if slug else DROP_ARTICLES - SLUG_WORDS, DROP_ARTICLES
    if in_article or tag in PROSE or tag == "section":
        if slug and (tag in HEADINGS or tag == "section"):
            return none, none
        return none if slug else CLEAR_NAMES, CLEAR_WHOLE
    return DROP_NAMES - SLUG_WORDS, DROP_NAMES | CLEAR_WHOLE


def marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element says that it is not main text."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if named(value, *names_for(tag, name, in_article)):
                return True
        elif name == "role":
            if value.strip().lower() in DROP_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def hash_of(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def suspect(node: Node) -> None:
    """Votes of a box's names, and its shape: the tag and the first such name."""
    for kind, value in ATTRIBUTE.findall(node.attributes):
        if kind.lower() not in ("class", "id"):
            continue
        for one in value.strip("\"'").split():
            words = [x.lower() for x in NAME.findall(one)]
            if not words or words[0] in HOLDS or not (words[0] in VOTE_NAMES or words[-1] in VOTE_NAMES):
                continue
            sure = kind.lower() == "class" and len(words) == 1
            node.votes = max(node.votes, 2 if sure else 1)
            node.talk |= words[0] in TALK or words[-1] in TALK
            node.shape = node.shape or hash_of("shape", node.tag, "-".join(words))


def thread(box: Node) -> bool:
    """Whether a box holds what readers' comments do: entries of one kind, dates or authors."""
    todo = [box]
    while todo:
        node, kinds = todo.pop(), set()
        for kid in node.kids:
            if type(kid) is not Node:
                continue
            classes = " ".join(v for k, v in ATTRIBUTE.findall(kid.attributes) if k.lower() == "class") if kid.attributes else ""
            if kid.tag == "time" or named(classes.replace('"', " ").replace("'", " "), WRITERS, frozenset()):
                return True
            if kid.digest and kid.tag in ENTRIES:
                kind = (kid.tag, classes)
                if kind in kinds:
                    return True
                kinds.add(kind)
            todo.append(kid)
    return False


def judge(root: Node) -> None:
    """Add the votes of structure and place to reader comments; a box with the main heading has none."""
    todo = [(root, True, False)]
    while todo:
        node, last, known = todo.pop()
        free = last or node.tag in ("article", "main")
        for kid in reversed(node.kids):
            if type(kid) is not Node:
                free = free and not kid.strip()
                continue
            if kid.top:
                kid.votes = 0
            elif kid.votes and kid.talk and not known:
                kid.votes += free + thread(kid)
            todo.append((kid, free, known or kid.talk))
            free = free and (kid.drop or not kid.digest or kid.votes > 0)


def shut(stack: list[Node], at: int, opened: dict[str, int]) -> None:
    for node in stack[at:]:
        opened[node.tag] -= 1
    del stack[at:]


def parse(page: str) -> Node:
    """The page as a tree. Text stays as it is written, in pieces among the children."""
    root = Node("#page", False)
    stack, opened, at, first = [root], {}, 0, True
    end = len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            stack[-1].kids.append(text)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    shut(stack, i, opened)
                    break
                if stack[i].tag in ("body", "html"):
                    break
            continue
        if tag in ENDS_P and stack[-1].tag != "#page":
            close(stack, ("p",), opened)
        if tag in CLOSES:
            close(stack, CLOSES[tag], opened)
        in_article = bool(opened.get("article") or opened.get("main"))
        node = Node(tag, marked(tag, m[3], in_article), m[3])
        if m[3] and tag in BOXES and not node.drop:
            suspect(node)
        stack[-1].kids.append(node)
        if first and tag in ("article", "main") and not node.drop:
            # What holds the page's first article is no sidebar or form, whatever it is called.
            first = False
            for up in stack:
                up.drop = up.drop and up.tag in ASIDES
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.kids.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def close(stack: list[Node], tags: tuple[str, ...], opened: dict[str, int]) -> None:
    """End the innermost open element of these tags, inside the scope around it."""
    if not any(opened.get(t) for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            shut(stack, i, opened)
            return
        if stack[i].tag in SCOPES:
            return


def walk(root: Node):
    """(node, inside the article) of all elements, children before parents; no recursion."""
    todo, order = [(root, False)], []
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo += [(k, inside) for k in node.kids if type(k) is Node]
    return reversed(order)


def hash_all(root: Node) -> list[tuple[Node, bool]]:
    """Give each element the hash of its subtree; 0 if it holds no text."""
    order = list(walk(root))
    for node, _ in order:
        parts, full = [node.tag], False
        for kid in node.kids:
            if type(kid) is Node:
                full |= kid.digest != 0
                node.top |= kid.top
                parts.append(f"<{kid.digest or kid.tag}>")
            elif s := " ".join(kid.split()):
                full = True
                parts.append(s)
        if full:
            node.digest = hash_of(*parts)
    judge(root)
    return order


def safe(node: Node, inside: bool) -> bool:
    """Elements that are never template: page and article roots, text inside the article."""
    return node.tag in KEEP_TAGS or node.tag == "#page" or (inside and node.tag in PROSE)


def gone(node: Node, inside: bool, template: frozenset) -> bool:
    """Whether an element is no main text: marked, voted out or template."""
    if node.drop or node.votes >= ENOUGH or (node.votes and node.shape in template):
        return True
    return node.digest in template and not safe(node, inside)


def title_of(order: list[tuple[Node, bool]], root: Node) -> int:
    """What tells pages of a host apart: title and main headings, or the whole page if it has no title."""
    title = [str(n.digest) for n, _ in order if n.tag == "title" and n.digest]
    heads = [str(n.digest) for n, _ in order if n.tag in ("h1", "h2") and n.digest]
    return hash_of("title", *title, *heads) if title else hash_of("page", str(root.digest))


def text_of(root: Node, template: frozenset) -> str:
    """Text of a subtree without marked elements and template. No recursion: pages nest deeply."""
    out, todo = [], [(root, False)]
    while todo:
        item, inside = todo.pop()
        if type(item) is str:
            out.append(item)
            continue
        if item is not root and gone(item, inside, template):
            out.append(" ")
            continue
        edge = " " if item.tag in BLOCK else ""
        inside = inside or item.tag in ("article", "main")
        todo.append((edge, False))
        todo += [(k if type(k) is Node else markup.unescape(k), inside) for k in reversed(item.kids)]
        out.append(edge)
    return " ".join("".join(out).split())


def main_text(page: str, template: frozenset) -> str:
    """The article's text, of several outermost articles all, if it is most of the page's; else the page's."""
    root = parse(page)
    hash_all(root)
    whole = text_of(root, template)
    for tag in ("article", "main"):
        roots, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and gone(node, False, template):
                continue
            if node.tag == tag:
                roots.append(node)
            else:
                todo += [k for k in reversed(node.kids) if type(k) is Node]
        text = " ".join(t for n in roots if (t := text_of(n, template)))
        if 2 * len(text) > len(whole):
            return text
    return whole


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, digest, title): subtrees that might be template; digest 0 stands for the page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            hosts, digests, titles = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                order = hash_all(root)
                own = {n.digest for n, inside in order if not safe(n, inside)} | {n.shape for n, _ in order if n.votes} | {0}
                digests += own
                hosts += [host] * len(own)
                titles += [title_of(order, root)] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.int64()), pa.array(digests, pa.int64()), pa.array(titles, pa.int64())], ["host", "digest", "title"]
            )

    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    return rows.mapInArrow(read, "host long, digest long, title long")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, template): the hashes of each host's recurring subtrees."""
    counts = cut(subtrees(pages).distinct().groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages), "subtrees")
    total = counts.filter("digest = 0").select("host", F.col("n").alias("pages"))
    return (
        counts.filter("digest <> 0").join(total, "host").filter(F.col("n") >= least_share * F.col("pages"))
        .groupBy("host").agg(F.collect_list("digest").alias("template"))
    )


def small(hosts: DataFrame) -> bool:
    """Whether both the lists and all that they hold are few enough to go to every task."""
    if not fits(hosts, BROADCAST_HOSTS):
        return False
    return (hosts.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_HASHES


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``."""
    hosts = cut(templates(pages, least_pages, least_share), "templates").withColumnRenamed("host", "_host")
    hosts = F.broadcast(hosts) if small(hosts) else hosts
    rows = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    rows = rows.join(hosts, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "template")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            texts = [
                main_text(page or "", frozenset(template or ()))
                for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = rows.select("page_id", "url").withColumn("text", F.lit("")).schema
    return rows.mapInArrow(read, schema)
