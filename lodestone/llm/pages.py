"""Main text of web pages with site style trees.

The pages of a host are merged into one style tree: a node is a path of
elements (tag and class), and for each node the tree holds how often it
occurs, which contents its branch has had, in which layouts (the elements
below it) and how much of its pages' text it holds. The entropy of the contents
and that of the layouts, each over the host's pages, are its importance, scaled
by its share of the text. What the markup says is a prior that the importance is
multiplied by: 0 for elements that are presentation by their kind (navigation,
forms, hidden boxes, reader comments), SOFT for class words such as "ad" or
"notice", OUTSIDE beside an article. Branches below LEAST are cut. An undeclared
branch is cut where its content hardly varies over the host's pages (low
entropy) from the pages whose own content there is one of those that the host
repeats; articles are never cut into that way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import slices, string_column
from lodestone.plans.staging import stage

#: Element kinds of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe title object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html legend optgroup option summary tbody td tfoot th thead tr".split())
#: What each start tag ends implicitly, and which tags stop the search.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table body article section div main aside nav header footer form td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and class words that are presentation on any host; of class words only those of reader comments decide by themselves.
PLAIN_DROP = frozenset("nav footer aside form button select menu dialog head input label fieldset search datalist audio video".split()) | RAW
ROLE_DROP = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
CLASS_DROP = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|banners?|promos?|promoted|promotion|sponsor\w*|side-?bars?|menus?|nav|navs|navbar|navigation|"
    r"bread-?crumbs?|footers?|site-?header|page-?header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modals?|overlay|newsletter|"
    r"subscribe|subscription|share|sharing|social|related|recommend\w*|widgets?|"
    r"log-?in|sign-?up|sign-?in|search|skip|pagination|pager|disclaimer|copyright|toolbar|hidden|visually-hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
COMMENT_DROP = re.compile(
    r"(?:^|[\s_-])(?:comments?|comment-?list|replies|respond|disqus|discussion|responses?|guest-?book|(?:user|reader|customer|visitor)s?-?(?:reviews?|remarks?|opinions?|feedback|posts?))(?=$|[\s_-])",
    re.I,
)
CLASS_HEADER = re.compile(r"(?:^|[\s_-])headers?(?=$|[\s_-])", re.I)

#: Class words that say what a layout has, not what the element is.
_LAYOUT = re.compile(r"^(?:has|no|with|without)[_-]", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: What an article element may be besides an article.
ARTICLE_DROP = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|comments?|replies|respond|related|teasers?)(?=$|[\s_-])", re.I)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
#: The rest of a tag up to its end, over quoted values; it never goes back.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: The entropy's unit stops growing at so many pages: three equally frequent contents are the most that count as repeats (fixed value).
UNIT_PAGES = 320
#: The least share of a branch's pages that a content is on to count as one the host repeats (fixed value).
REPEATED = 0.1

#: Priors of branches with a class word of presentation, and of those beside the page's article; what prior times importance must reach.
SOFT, OUTSIDE, LEAST = 0.5, 0.35, 0.25
#: The share of the text from which on a branch counts fully, and the least share of a host's pages that a node of its tree is on (fixed values).
WHOLE_SHARE, ON_PAGES = 0.75, 0.01
#: Longer paths of elements are named by a hash of what they would be called.
PATH_CHARS = 240

#: Long numbers in class names differ from page to page.
_DIGITS = re.compile(r"\d{3,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element of a page: its parent, and as ``key`` the path of labels down to it."""

    __slots__ = ("beside", "content", "key", "layout", "length", "opened", "parent", "repeated")

    def __init__(self, parent: Node | None, label: str):
        key = f"{parent.key}>{label}" if parent else label
        self.key = key if len(key) <= PATH_CHARS else f"#{xxhash.xxh3_64_hexdigest(key)}"
        self.parent, self.opened, self.content, self.layout, self.length = parent, False, 0, 0, 0
        self.beside: Node | bool | None = None
        self.repeated: bool | None = None


class Form:
    """A form of a page; whether it is presentation is known at the page's end."""

    __slots__ = ("frames", "inside", "length")

    def __init__(self, inside: bool):
        self.length, self.inside, self.frames = 0, inside, False  # text, whether in an article, whether around one


class Block:
    """A run of text between block boundaries: the element it stands in, whether in an article, declared presentation (hard), the branch with a class word of it (soft), and the form around it."""

    __slots__ = ("form", "hard", "main", "node", "soft", "text")

    def __init__(self, text: str, node: Node | None, main: bool = False, hard: bool = False, soft: Node | None = None, form: Form | None = None):
        self.text, self.node, self.main, self.hard, self.soft, self.form = text, node, main, hard, soft, form


def _label(tag: str, attrs: dict[str, str]) -> str:
    return tag + "".join("." + c for c in sorted(set(_DIGITS.sub("0", attrs.get("class", "")).lower().split())))


def _declared(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """What the markup says of an element: 2 presentation by its kind, 1 by a class word, 0 nothing."""
    if tag in PLAIN_DROP or attrs.get("role", "").lower() in ROLE_DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return 2
    if tag in ("body", "html", "main"):
        return 0
    names = " ".join(_HUMP.sub("-", x) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).split() if not _LAYOUT.match(x))
    if COMMENT_DROP.search(names) or _HIDDEN.search(attrs.get("style", "")) or (tag == "header" and not in_main):
        return 2
    if tag == "article":
        return 2 if ARTICLE_DROP.search(names) else 0
    if not names:
        return 0
    soft = CLASS_DROP.search(names) or (not in_main and CLASS_HEADER.search(names))
    return 0 if not soft else 1 if tag in BLOCK else 2


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order, in time linear in the page.

    Unclosed and misnested tags are repaired as browsers do for paragraphs,
    lists and tables; a "<" that no ">" follows is text.
    """
    out: list[Block] = []
    # tag, main, hard, soft, form, and whether text in it goes: 1 up to the next block, 2 up to its end
    top = ("", False, False, None, None, 0)
    stack: list[tuple[str, bool, bool, Node | None, Form | None, int]] = []
    path: list[Node] = []
    held: Counter[str] = Counter()
    parts: list[str] = []
    pos, end = 0, len(html)
    quotes = True  # whether quoted values are minded: not any more after one that ran over the page's end
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, main, hard, soft, form, _ = stack[-1] if stack else top
                out.append(Block(text, path[-1] if path else None, main, hard, soft, form))

    def pop(index: int) -> None:
        gone = [x[0] for x in stack[index:]]
        levels = sum(x in BLOCK for x in gone)
        if levels:
            flush()
            del path[len(path) - levels :]
        held.subtract(gone)
        del stack[index:]

    def say(text: str) -> None:
        if not (stack and stack[-1][5]):
            parts.append(text)

    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            say(html[pos:])
            break
        if at > pos:
            say(html[pos:at])
        lead = html[at + 1 : at + 2]
        if lead in ("!", "?"):
            mark = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            stop = html.find(mark, at + (4 if mark == "-->" else 2))
            pos = end if stop < 0 else stop + len(mark)
            continue
        m = _NAME.match(html, at)
        rest = m and quotes and _REST.match(html, m.end())
        if m and not rest:
            quotes = False
            stop = html.find(">", m.end())
            if stop < 0:
                say(html[at:])
                break
        if not m:
            say("<")
            pos = at + 1
            continue
        pos = rest.end() if rest else stop + 1
        tag, inner = m[2].lower(), html[m.end() : pos - 1]
        if m[1]:
            if held[tag] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main", "table"):
                        break
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in VOID:
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(inner)} if inner.strip(" /\n\t") else {}
        if tag in RAW:
            if not inner.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                if close is None:
                    unclosed.add(tag)
                pos = close.end() if close else (end if tag in ("script", "style", "textarea", "title") else pos)
            continue
        if tag in BLOCK and stack and stack[-1][5] == 1:
            # A block ends the inline elements that go with their text.
            first = len(stack) - 1
            while first and stack[first - 1][5] == 1:
                first -= 1
            pop(first)
        if tag in CLOSES_P and held["p"] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in ENDS and any(held[x] > 0 for x in ENDS[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDS[tag]:
                    pop(i)
                    break
                if stack[i][0] in STOPS:
                    break
        _, main, hard, soft, form, gone = stack[-1] if stack else top
        says = _declared(tag, attrs, main)
        if tag in BLOCK:
            flush()
            path.append(Node(path[-1] if path else None, _label(tag, attrs)))
            soft = soft or (path[-1] if says == 1 else None)
            if tag == "form" and says == 2:
                form, says = form or Form(main), 0
        else:
            if says and not hard and not gone:
                gone = 1
                if tag in PLAIN_DROP:
                    closed = tag not in unclosed and re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                    if not closed:
                        unclosed.add(tag)
                    gone = 2 if closed else 0
            says = 0
        inside = main or tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        if form and inside and not main:
            form.frames = True
        stack.append((tag, inside, hard or says == 2, soft, form, gone))
        held[tag] += 1
    flush()
    settle_forms(out)
    return out


def settle_forms(page: list[Block]) -> None:
    """Mark what stands in forms as presentation. One around the article, or (without an article) around most of the text, is the page's frame and no form."""
    seen = [b for b in page if not b.hard]
    article = any(b.main for b in seen)
    for b in seen:
        if b.form:
            b.form.length += len(b.text)
    total = sum(len(b.text) for b in seen)
    for b in seen:
        if b.form and not b.form.frames and (article or 2 * b.form.length <= total):
            b.hard = True


def _fold(held: int, value: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d,%d" % (held, value))


def branches(page: list[Block]) -> dict[str, tuple[int, int, float]]:
    """For each style path of the page: hashes of its branch's content and of its layout, and its share of the page's text (of what is not presentation by its kind).

    Hashes are folded from the elements below, each once, so the time is linear in the page however deep it is.
    """
    total = sum(len(b.text) for b in page if not b.hard) or 1
    held: dict[str, list[int]] = {}
    open_: list[Node] = []

    def close() -> None:
        n = open_.pop()
        n.opened = False
        x = held.setdefault(n.key, [0, 0, 0])
        x[0], x[1], x[2] = _fold(x[0], n.content), _fold(x[1], n.layout), x[2] + n.length
        if n.parent:
            label = xxhash.xxh3_64_intdigest(n.key)
            n.parent.content, n.parent.layout, n.parent.length = _fold(n.parent.content, n.content), _fold(_fold(n.parent.layout, label), n.layout), n.parent.length + n.length

    for b in page:
        chain, x = [], b.node
        while x and not x.opened:
            chain.append(x)
            x = x.parent
        while open_ and open_[-1] is not x:
            close()
        for n in reversed(chain):
            n.opened, n.content, n.layout, n.length = True, 0, 0, 0
            open_.append(n)
        if b.node:
            b.node.content, b.node.layout, b.node.length = _fold(b.node.content, xxhash.xxh3_64_intdigest(b.text)), _fold(b.node.layout, 1), b.node.length + len(b.text)
    while open_:
        close()
    return {k: (c - 2**63, t - 2**63, min(1.0, n / total)) for k, (c, t, n) in held.items()}


def importance(content: float, layout: float, share: float) -> float:
    return (content + layout) / 2 * min(1.0, share / WHOLE_SHARE)


def judged(page: list[Block], known: dict[str, float], repeats: dict[str, list[int]], max_share: float) -> list[str]:
    """For each block what becomes of it: "kept", "declared" (presentation by its kind) or "cut" (of low importance).

    ``known``: importance of the host's nodes; where a node is none, the page
    itself counts (own content, one layout). ``repeats``: undeclared paths of low
    content entropy with the contents that the host repeats there.
    """
    own = branches(page)
    inside: set[str] = set()
    article = False
    for b in page:
        if b.main and not b.hard:
            article = True
            x = b.node
            while x and x.key not in inside:
                inside.add(x.key)
                x = x.parent

    def weighs(k: str, prior: float) -> bool:
        return prior * known.get(k, importance(1.0, 0.0, own[k][2])) >= LEAST

    def above(node: Node | None, known_of) -> list[Node]:
        """The node and those above it of which nothing is known yet, the highest first."""
        chain = []
        while node and known_of(node) is None:
            chain.append(node)
            node = node.parent
        return chain[::-1]

    def beside(node: Node | None) -> Node | bool:
        """The highest element above a block, or its own, that holds no article."""
        for n in above(node, lambda x: x.beside):
            n.beside = (n.parent.beside if n.parent else False) or (n if n.key not in inside else False)
        return node.beside if node else False

    def repeated(node: Node | None) -> bool:
        for n in above(node, lambda x: x.repeated):
            n.repeated = bool(n.parent and n.parent.repeated) or (own[n.key][2] <= max_share and own[n.key][0] in repeats.get(n.key, ()))
        return bool(node and node.repeated)

    def fate(b: Block) -> str:
        if b.hard:
            return "declared"
        if b.soft and not weighs(b.soft.key, SOFT):
            return "cut"
        if article:
            at = beside(b.node)
            return "kept" if b.main or (at and weighs(at.key, OUTSIDE)) else "cut"
        return "cut" if repeats and repeated(b.node) else "kept"

    return [fate(b) for b in page]


def main_text(page: list[Block], known: dict[str, float] | None = None, repeats: dict[str, list[int]] | None = None, max_share: float = 0.25) -> str:
    """The blocks that are kept, joined by newlines."""
    return "\n".join(b.text for b, f in zip(page, judged(page, known or {}, repeats or {}, max_share), strict=True) if f == "kept")


def style_tree(df: DataFrame, min_pages: int = 8) -> DataFrame:
    """The nodes of each host's style tree: host, path, pages, share, repeats, content, layout.

    ``df`` has _host and _html. Copies of a page count once. ``content`` and
    ``layout`` are the entropies of what a node's branch has held and of how it was
    laid out, in units of the largest possible (all different, on UNIT_PAGES pages
    at most). ``repeats`` are the contents on ``min_pages`` pages and REPEATED of the node's
    pages at least. The tree has the nodes on ``min_pages`` pages and ON_PAGES of
    the host's pages at least.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                rows = []
                for host, html in zip(part.column("_host").to_pylist(), string_column(part, "_html").to_pylist(), strict=True):
                    page = xxhash.xxh3_64_intdigest(html) - 2**63
                    rows += [(host, path, page, *node) for path, node in branches(blocks(html)).items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "page", "content", "layout", "share"])

    nodes = df.select("_host", "_html").mapInArrow(emit, "host string, path string, page bigint, content bigint, layout bigint, share double")
    nodes = nodes.groupBy("host", "path", "content", "layout", "page").agg(F.max("share").alias("share"))
    pairs = stage(nodes.groupBy("host", "path", "content", "layout").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share")), "style-nodes")

    def entropy(pages: str, nln: str) -> Column:
        return (F.ln(pages) - F.col(nln) / F.col(pages)) / F.ln(F.greatest(F.lit(2), F.least(F.col(pages), F.lit(UNIT_PAGES))))

    contents = pairs.groupBy("host", "path", "content").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    tree = contents.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("_nln"), (F.sum("share") / F.sum("n")).alias("share"),
        F.collect_list(F.when(F.col("n") >= min_pages, F.struct("n", "content"))).alias("_often"),
    )
    layouts = pairs.groupBy("host", "path", "layout").agg(F.sum("n").alias("n")).groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("_nln"))
    layouts = layouts.select("host", "path", entropy("pages", "_nln").alias("layout"))
    widest = tree.groupBy("host").agg(F.max("pages").alias("_most"))
    repeats = F.transform(F.filter("_often", lambda x: x["n"] >= F.col("pages") * REPEATED), lambda x: x["content"])
    tree = tree.join(layouts, ["host", "path"]).join(widest, "host").where((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("_most") * ON_PAGES))
    return tree.select("host", "path", "pages", "share", repeats.alias("repeats"), entropy("pages", "_nln").alias("content"), "layout")


def extract_pages(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_importance: float = 0.2,
    max_share: float = 0.25,
    min_pages: int = 8,
) -> DataFrame:
    """The main text of every page: id, url, text (blocks joined by newlines), n_chars, n_cut, n_declared.

    ``n_cut`` blocks went for their low importance in the host's style tree,
    ``n_declared`` as presentation by their kind. A branch with a class word of
    presentation, or beside the article, stays if its prior times its
    importance reaches LEAST. Without article, branches of content entropy under
    ``min_importance`` that hold on average at most ``max_share`` of their pages'
    text are cut from a page where its own content is one that the host repeats
    and its own share is as small. Null and empty pages give an empty text; long
    pages count whole, in linear time; pages without a host in the url share one
    tree; repeated rows are kept; an empty input gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), host.alias("_host"))
    tree = style_tree(rows, min_pages)
    low = (F.col("content") < min_importance) & (F.col("share") <= max_share)
    weight = (F.col("content") + F.col("layout")) / 2 * F.least(F.lit(1.0), F.col("share") / WHOLE_SHARE)
    # Nodes on ON_PAGES of a host's pages: their number does not grow with the host.
    node = F.struct("path", weight.alias("weight"), F.when(low, F.col("repeats")).alias("repeats"))
    trees = stage(tree.groupBy("host").agg(F.collect_list(node).alias("_tree")), "style-trees")
    rows = rows.join(trees, F.col("_host") == F.col("host"), "left").select("_id", "_url", "_html", "_host", "_tree")
    kind, url_kind = rows.schema["_id"].dataType.simpleString(), rows.schema["_url"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple[dict, dict]] = {}
        for batch in batches:
            for part in slices(batch, "_html"):
                texts, cut, declared = [], [], []
                hosts, nodes = part.column("_host").to_pylist(), part.column("_tree")
                for i, html in enumerate(string_column(part, "_html").to_pylist()):
                    if hosts[i] not in trees:
                        if len(trees) >= 256:
                            trees.clear()
                        held = nodes[i].as_py() or []
                        trees[hosts[i]] = {x["path"]: x["weight"] for x in held}, {x["path"]: x["repeats"] for x in held if x["repeats"]}
                    page = blocks(html)
                    fates = judged(page, *trees[hosts[i]], max_share)
                    texts.append("\n".join(b.text for b, f in zip(page, fates, strict=True) if f == "kept"))
                    cut.append(fates.count("cut"))
                    declared.append(fates.count("declared"))
                counts = [pa.array(x, pa.int64()) for x in (list(map(len, texts)), cut, declared)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), *counts], names=[id_col, url_col, "text", "n_chars", "n_cut", "n_declared"])

    return rows.mapInArrow(extract, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars bigint, n_cut bigint, n_declared bigint")
