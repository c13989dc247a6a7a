"""Main text of pages by a site style tree.

Pages of a host are merged: element nodes with the same path (tags, classes and ids from the body
down) are one style node. For every style node the pages' presentations (which kinds of children it
has) and contents (hash of the text below it) are counted; their normalised entropies say how much
the node varies over the site. Templates repeat, articles do not: a node whose importance, the mean
of both weighted with depth, stays under a bound on enough pages is a branch to remove.

The counts are sums over hashed keys, so a host with a third of all pages is no single task, and
page texts are not shuffled: only the removed branches of each host travel back to its pages.

Element roles come before entropy. Branches with a boilerplate role (nav, footer, aside, forms,
advert or comment classes and so on) go even on a site's only page, and an article's plain
paragraphs stay even where a site repeats them; entropy decides about the rest. Inside the main text
words of classes and ids are no role: they only lower a node's importance (``SUSPECT``), and headings
are never judged by their ids. Only containers named exactly as adverts or comments go there at once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework.llm.common import prepare, stored

#: A style node is judged when this many pages of its host have it.
LEAST_PAGES = 8
#: Branches under this importance are removed.
LEAST_IMPORTANCE = 0.2
#: Weight of contents against presentation.
CONTENT = 0.7
#: Factor on the importance of nodes inside the main text whose class or id has a bad word.
SUSPECT = 0.4

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
DROPPED = frozenset((*RAW, "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "head", "menu", "dialog",
                     "audio", "video", "map", "datalist", "fieldset", "label", "math"))
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                    "h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption").split())
CLOSES_P = BLOCKS - frozenset(("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that may end without an end tag.
IMPLIED = frozenset("p li dt dd tr td th option tbody thead tfoot".split())
#: Where an implied end tag stops looking.
SCOPES = frozenset("ul ol dl table div section article main aside nav footer header body form blockquote".split())
# Words in classes, ids and roles.
BAD_WORDS = frozenset((
    "ad ads adbox adslot advert adverts advertisement advertising advertorial banner banners sponsor sponsors sponsored promo promos promotion "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login paywall "
    "share sharing social related recommended recommendations recommend trending popular widget widgets "
    "comment comments commentlist reply replies respond disqus discussion footer footnav masthead copyright colophon search searchbox hidden skip").split())
#: Whole class or id names of adverts and comments.
BAD_NAMES = frozenset((
    "ad ads ad-slot ad-container ad-banner adbox adslot advert adverts advertisement advertising sponsored "
    "comments comment-list commentlist comments-area comments-section disqus disqus_thread").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
TEXT_WORDS = frozenset("article post entry story main".split())
BODY_WORDS = frozenset("content body text".split())
TEXT_NAMES = frozenset("article content main post entry story maincontent".split())

_TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<[!?][^>]*>"
    r"|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An open element: its path, what happens to text below it, and what was seen there."""
    __slots__ = ("tag", "path", "drop", "main", "plain", "suspect", "kids", "digest", "texts", "parent")

    def __init__(self, tag: str, path: str, parent: Node | None, drop: bool, main: bool, plain: bool, suspect: bool = False):
        self.tag, self.path, self.parent = tag, path, parent
        self.drop, self.main, self.plain, self.suspect = drop, main, plain, suspect
        self.kids: list[str] = []
        self.digest = xxhash.xxh64()
        self.texts = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\t\r\n") else {}


def _signature(tag: str, attrs: dict[str, str]) -> str:
    marks = sorted(attrs.get("class", "").split())
    if attrs.get("id") and tag not in HEADINGS:
        marks.append("#" + re.sub(r"[0-9]+", "0", attrs["id"]))
    return tag + "".join("." + m for m in marks)


_KNOWN: dict[tuple[str, str], tuple[str, int, int, bool]] = {}


def _known(tag: str, raw: str) -> tuple[str, int, int, bool]:
    """Signature of a start tag, its role outside and inside the main text, and whether it is suspect
    inside; kept for equal tags."""
    found = _KNOWN.get((tag, raw))
    if found is None:
        if len(_KNOWN) > 20_000:
            _KNOWN.clear()
        attrs = _attributes(raw)
        found = _KNOWN[tag, raw] = (
            _signature(tag, attrs), _role(tag, attrs, False), _role(tag, attrs, True), bool(_words(tag, attrs) & BAD_WORDS))
    return found


def _ends(text: str) -> dict[int, int]:
    """Where elements end by their own end tags, by the place after their start tags. Tags in comments,
    scripts and attributes are none; one pass, however many branches are dropped."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for m in _TAGS.finditer(text):
        if tag := m["start"]:
            opened.setdefault(tag.lower(), []).append(m.end())
        elif (tag := m["end"]) and (held := opened.get(tag.lower())):
            ends[held.pop()] = m.end()
    return ends


def _words(tag: str, attrs: dict[str, str]) -> set[str]:
    """Words of the class and id; a heading's id is made from its text and says nothing."""
    return {w.lower() for w in _WORDS.findall(attrs.get("class", "") + " " + ("" if tag in HEADINGS else attrs.get("id", "")))}


def _role(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """-1 boilerplate, 1 main text, 0 undecided."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return -1
    if tag == "header" and not in_main:
        return -1
    if tag in ("html", "body"):
        return 0
    role = attrs.get("role", "").lower()
    if role in BAD_ROLES:
        return -1
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    words = _words(tag, attrs)
    if in_main:
        if tag in BLOCKS and tag not in HEADINGS and set(names.lower().split()) & BAD_NAMES:
            return -1
        if words & BAD_WORDS:
            return 0
    elif words & BAD_WORDS or (words & HEAD_WORDS and not words & TEXT_WORDS):
        return -1
    if tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody":
        return 1
    if tag in ("div", "section", "td") and ((words & TEXT_WORDS and words & BODY_WORDS) or set(names.lower().split()) & TEXT_NAMES):
        return 1
    return 0


class Page:
    """One pass over a page. ``blocks``: (in main, text) in page order; ``nodes``: closed block
    elements that roles leave to the style tree, as (path, presentation, content, suspect)."""

    def __init__(self, text: str, removed: frozenset[int] = frozenset(), observe: bool = False):
        self.blocks: list[tuple[bool, str]] = []
        self.nodes: list[tuple[int, int, int, bool]] = []
        self._open: list[str] = []
        self._where = (False, False)
        self._removed, self._observe, self._source = removed, observe, text
        self._ends: dict[int, int] | None = None
        stack, at = [Node("", "", None, False, False, True)], 0
        while m := _TAGS.search(text, at):
            if m.start() > at:
                self._text(stack[-1], text[at:m.start()])
            at = m.end()
            if tag := m["start"]:
                at = self._start(stack, tag.lower(), m["attrs"], at)
            elif tag := m["end"]:
                self._end(stack, tag.lower())
        if at < len(text):
            rest = text[at:]
            cut = re.search(r"<[A-Za-z/!?][^>]*\Z", rest)  # a tag that the end of the page cuts off
            self._text(stack[-1], rest[:cut.start()] if cut else rest)
        while len(stack) > 1:
            self._close(stack)
        self._flush()

    def _text(self, node: Node, raw: str) -> None:
        if node.drop:
            return
        value = entities.unescape(raw) if "&" in raw else raw
        if self._observe:
            node.digest.update(value.encode("utf-8", "surrogatepass"))
            node.texts += len(value)
        if self._where != (node.main, True):
            self._flush()
            self._where = (node.main, True)
        self._open.append(value)

    def _flush(self) -> None:
        if self._open:
            value = " ".join("".join(self._open).split())
            if value:
                self.blocks.append((self._where[0], value))
            self._open = []
            self._where = (False, False)

    def _start(self, stack: list[Node], tag: str, raw: str, at: int) -> int:
        """Open an element; the place to read on from, which is past a branch that is dropped."""
        block = tag in BLOCKS
        if block:
            if tag in CLOSES_P and any(n.tag == "p" for n in stack):
                while stack[-1].tag != "p":
                    self._close(stack)
                self._close(stack)
            if tag in SIBLINGS:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in SIBLINGS[tag] or stack[k].tag in SCOPES), 0)
                if depth and stack[depth].tag in SIBLINGS[tag]:
                    while len(stack) > depth:
                        self._close(stack)
            self._flush()
        elif tag == "br":
            self._text(stack[-1], " ")
        if tag in VOID:
            return at
        top = stack[-1]
        if top.drop:
            stack.append(Node(tag, top.path, top, True, top.main, False))
            return at
        signature, outside, inside, suspect = _known(tag, raw)
        role = inside if top.main else outside
        suspect = suspect and top.main
        judged = block or suspect
        path = f"{top.path}>{signature}" if judged else top.path
        drop = role < 0
        # The style tree judges what has no role of its own: anything outside the main text, marked elements inside.
        if judged and self._removed and not drop and role == 0 and (signature != tag or not top.main):
            drop = xxhash.xxh64_intdigest(path) in self._removed
        if judged and self._observe:
            top.kids.append(signature)
        if drop and tag not in IMPLIED:
            if self._ends is None:
                self._ends = _ends(self._source)
            if (end := self._ends.get(at)) is not None:
                return end
        stack.append(Node(tag, path, top, drop, top.main or role > 0, signature == tag, suspect))
        return at

    def _end(self, stack: list[Node], tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                while len(stack) > depth:
                    self._close(stack)
                return
            if not block and stack[depth].tag in BLOCKS:  # an inline end tag does not close the block around it
                return

    def _close(self, stack: list[Node]) -> None:
        node = stack.pop()
        if node.tag in BLOCKS:
            self._flush()
        if self._observe and node.parent is not None and node.texts:
            node.parent.digest.update(node.digest.digest())
            node.parent.texts += node.texts
            if (node.tag in BLOCKS or node.suspect) and node.tag not in ("html", "body") and not node.drop and (not node.main or not node.plain):
                self.nodes.append((xxhash.xxh64_intdigest(node.path), xxhash.xxh64_intdigest(" ".join(sorted(set(node.kids)))), node.digest.intdigest(), node.suspect))

    def main_text(self) -> str:
        """The blocks of the main element where there is one, else all blocks that stayed."""
        inside = [t for main, t in self.blocks if main]
        return "\n".join(inside if inside else [t for _, t in self.blocks])


# --- Spark -------------------------------------------------------------------------------------

def host_of(url: Column) -> Column:
    """Host in lower case; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _observed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for host, text in zip(frame["host"], frame["_html"]):
            seen = set()
            for path, look, content, suspect in Page(text or "", observe=True).nodes:
                rows.append((host, _signed(path), _signed(look), _signed(content), int(path not in seen), int(suspect)))
                seen.add(path)
        yield pd.DataFrame(rows, columns=["host", "path", "look", "content", "page", "suspect"]).astype(
            {"path": "int64", "look": "int64", "content": "int64", "page": "int64", "suspect": "int64"})


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, pages, presentation, content, importance)`` of all style nodes of all hosts.
    Entropies are normalised by the logarithm of the number of occurrences, so 1 is all different.
    The importance of suspect nodes is lowered."""
    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("_html")).mapInPandas(
        _observed, "host string, path long, look long, content long, page long, suspect long")
    # One row per (node, look) and one per (node, content), from one pass over the pages.
    kinds = seen.select("host", "path", "page", "suspect", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("look").alias("value")), F.struct(F.lit(1).alias("side"), F.col("content").alias("value")))))
    counts = kinds.groupBy("host", "path", "side", "value").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("page").alias("page"),
                                                              F.max("suspect").alias("suspect"))

    def entropy(side: int) -> Column:
        n = F.when(F.col("side") == side, F.col("n"))
        total = F.sum(n)
        return F.when(total > 1, (F.log(total) - F.sum(n * F.log(n)) / total) / F.log(total)).otherwise(F.lit(1.0))

    nodes = counts.groupBy("host", "path").agg((F.sum("page") / 2).cast("long").alias("pages"), entropy(0).alias("presentation"), entropy(1).alias("content"),
                                               F.max("suspect").alias("suspect"))
    prior = F.when(F.col("suspect") > 0, F.lit(SUSPECT)).otherwise(F.lit(1.0))
    return nodes.withColumn("importance", prior * (CONTENT * F.col("content") + (1 - CONTENT) * F.col("presentation"))).drop("suspect")


def removed_branches(tree: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``(host, removed)``: hashes of the paths that carry too little. A host's list is bounded by
    the number of its repeated templates, not by its pages."""
    return (tree.where((F.col("pages") >= least_pages) & (F.col("importance") < least))
            .groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("removed")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_blocks``.

    NULL html gives the empty text; pages without a host share one tree; repeated rows give equal
    texts; a page cut off in the middle keeps what came before; other columns are ignored.
    """
    prepare(pages.sparkSession)
    removed = stored(removed_branches(style_tree(pages, url_col, html_col), least_pages, least), "branches").withColumnRenamed("host", "_host")

    @F.pandas_udf("text string, n_blocks long")
    def texts(html: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(html, lists):
            value = Page(text or "", frozenset(int(x) & ((1 << 64) - 1) for x in gone) if gone is not None else frozenset()).main_text()
            rows.append((value, value.count("\n") + 1 if value else 0))
        return pd.DataFrame(rows, columns=["text", "n_blocks"]).astype({"n_blocks": "int64"})

    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("host"))
            .join(removed, F.col("host") == F.col("_host"), "left").withColumn("_out", texts("_html", "removed"))
            .select("page_id", "url", F.col("_out.text").alias("text"), F.length("_out.text").cast("long").alias("n_chars"), F.col("_out.n_blocks").alias("n_blocks")))
