"""HTML extraction with site template removal.

A page is read once, in one pass: its elements become a tree, and its text blocks get numbers in page order. Every
element that could be furniture gets a hash of its whole subtree and knows the blocks it holds. Spark counts per
host in how many different articles a subtree recurs; subtrees that recur in many are the site's template, and their
blocks go wherever they stand. What no count can know goes by lists: elements that are never
text, menus, headers, footers, sidebars, adverts, forms and comments that say so by tag or name. A name that
only hints at furniture has no effect alone: then a smaller share makes a subtree template, as it does outside
the article.

Never template: paragraphs and headings of a marked-up article, and what holds over half of a page's main text,
if that is LARGE. Copies of an article count once.

Defined cases: null and empty pages, and pages without text, have an empty text; broken markup is closed where
HTML closes it; a quote that is never closed ends with its tag; a page that ends within a tag or a reference keeps
what is complete; elements deeper than MAX_DEPTH are siblings; repeated rows and null keys each get a row; pages
without a usable url share one host; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, small_batches, stored, tidy

#: A subtree is template if it recurs in this share of a host's different articles, and in so many of them.
SHARE, MIN_ARTICLES = 0.2, 3
#: The same for what holds no main text of a page that marks up its main text, and for what is named as furniture might be.
EASY_SHARE, EASY_ARTICLES = 0.01, 2
#: Characters of main text from which a subtree that holds over half of a page's is the article.
LARGE = 200
#: As in browsers.
MAX_DEPTH = 512

#: The end of a tag, or an attribute's quoted value.
TAG_STOP = re.compile(r">|=\s*(?=[\"'])")
#: A whole attribute: its name, and its value if it has one. A search finds them in order, so none begins within another.
ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text no reader sees as text.
NEVER = frozenset("head script style noscript template iframe button select option textarea input svg canvas object embed dialog title".split())
FURNITURE = frozenset("nav header footer aside form menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: What class and id names call furniture: the last part of a name that isn't a carrier says what it is ("main-nav", "ad-slot", but not "ad-hoc").
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsors sponsored promo promos banner banners cookie cookies consent gdpr notice notices notification notifications"
    " newsletter subscribe signup login popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar toolbar"
    " social share sharing sharebar sharethis related recommended recommendations trending comment comments commentlist reply replies disqus respond pagination pager skip alert".split()
)
#: Names that only hint at it.
HINTS = FURNITURE_NAMES | frozenset("discussion subscription promotion promotions side rail".split())
CARRIERS = frozenset("wrapper wrap container box block area section list links link buttons button bar posts post articles items item slot unit panel inner outer row col column thread form feed icons top bottom left right main global".split())
NOT_OF_IT = frozenset("has no with without is".split())
#: Headers that are the site's even inside the article.
SITE = frozenset("site page global top main".split())

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A start of the first closes an open element of the second, up to a border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH_ENDERS = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "legend"}
#: Inside the article only these can be template: an article's own paragraphs may recur in its revisions.
CONTAINERS = frozenset("div section ul ol dl table figure details aside nav header footer form menu".split())
#: A block's kind.
PLAIN, MAIN, LISTED = 0, 1, 2


def name_parts(name: str) -> list[str]:
    """Parts of a class or id name, without carriers and numbers at its end."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    parts = [p.lower() for p in parts]
    while len(parts) > 1 and (parts[-1] in CARRIERS or parts[-1].isdigit()):
        parts.pop()
    return parts


def says_furniture(names: str, main: bool) -> bool:
    """Whether class or id names mark furniture. An article's own header isn't, nor is a wrapper named for what it has."""
    for name in names.split():
        parts = name_parts(name)
        if not parts or parts[0] in NOT_OF_IT or parts[-1] not in FURNITURE_NAMES and "".join(re.findall("[a-z]+", name.lower())) not in FURNITURE_NAMES:
            continue
        if not (main and parts[-1] == "header" and not SITE.intersection(name.lower().replace("_", "-").split("-"))):
            return True
    return False


def hints_furniture(names: str) -> bool:
    return any(HINTS.intersection(p.lower() for p in re.split(r"[-_]+", name)) for name in names.split())


class _Node:
    __slots__ = ("tag", "parent", "names", "role", "never", "dropped", "main", "text", "hash", "start", "end")

    def __init__(self, tag: str, parent: _Node | None, start: int, attributes: str = ""):
        found = {a.lower(): x or y or z for a, x, y, z in reversed(ATTRIBUTE.findall(attributes))} if attributes.strip() else {}  # the first of a name counts
        self.tag, self.parent, self.start, self.end = tag, parent, start, start
        self.names, self.role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
        self.never = parent is not None and (parent.never or tag in NEVER or "hidden" in found or found.get("aria-hidden") == "true")
        self.text: list = []
        self.hash = 0
        self.main = self._is_main(parent is not None and parent.main)
        keeps = tag in ("html", "body", "main") or (tag == "article" and not self.names)
        named = bool(self.names and not keeps and says_furniture(self.names, parent.main))
        # The article's own heading may be marked up as a header.
        by_tag = tag in FURNITURE and not (tag == "header" and parent.main)
        self.dropped = by_tag or named or self.role in FURNITURE_ROLES

    def _is_main(self, before: bool) -> bool:
        return before or self.tag in ("article", "main") or self.role in ("main", "article")


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; -1 if the page ends within it."""
    while m := TAG_STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        closed = page.find(page[m.end()], m.end() + 1)
        if closed < 0:
            return page.find(">", m.end())
        at = closed + 1
    return -1


def parse(page: str) -> tuple[list[tuple[str, _Node]], list[_Node], list[_Node]]:
    """Blocks of text, each with its element; all elements as they open, and as they close."""
    root = _Node("", None, 0)
    stack, blocks, opened, closed, pending = [root], [], [], [], []
    counts: Counter[str] = Counter()

    def end_block() -> None:
        if pending:
            text = " ".join(_html.unescape("".join(pending)).split())
            pending.clear()
            if text and not stack[-1].never:
                stack[-1].text.append(text)
                blocks.append((text, stack[-1]))

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack[-1]
            if node.tag in BLOCKS or node.dropped or node.never:
                end_block()
            stack.pop()
            counts[node.tag] -= 1
            node.end = len(blocks)
            closed.append(node)
            node.parent.text.append(node)

    def end(tag: str) -> None:
        if counts[tag] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("table", "article", "body") and tag not in ("html", "body", "article", "main", "div", "section", "table"):
                    break

    def start(tag: str, attributes: str) -> _Node | None:
        if tag == "br":
            pending.append(" ")
            return None
        if counts["head"] > 0 and tag not in IN_HEAD:
            end("head")
        if tag in BLOCKS:
            end_block()
            if tag in PARAGRAPH_ENDERS and counts["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
        if tag in CLOSES:
            ends, border = CLOSES[tag]
            last = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in border:
                    break
                if stack[k].tag in ends:
                    last = k
            if last:
                close(last)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return None
        if len(stack) > MAX_DEPTH:
            close(MAX_DEPTH)
        node = _Node(tag, stack[-1], len(blocks), attributes)
        if node.dropped or node.never:
            end_block()
            node.start = len(blocks)
        if tag in ("article", "main", "h1") and counts["form"] > 0:
            for above in stack:  # a form that holds the article is no form to fill in
                if above.tag == "form" and not says_furniture(above.names, False):
                    above.dropped = False
        stack.append(node)
        counts[tag] += 1
        opened.append(node)
        return node

    at = 0
    while (i := page.find("<", at)) >= 0:
        if i > at:
            pending.append(page[at:i])
        name = TAG_NAME.match(page, i + 2 if page.startswith("/", i + 1) else i + 1)
        if name:
            tag, stop = name[0].lower(), _tag_end(page, name.end())
            if stop < 0:
                break
            at = stop + 1
            if page[i + 1] == "/":
                end(tag)
                continue
            node = start(tag, page[name.end() : stop])
            if node is not None and tag in RAW:
                found = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not node.never:
                    pending.append(page[at : found.start()] if found else page[at:])
                at = found.end() if found else len(page)
                close(len(stack) - 1)
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            mark, past = ("-->", i + 2) if page.startswith("<!--", i) else ("]]>", i) if page.startswith("<![CDATA[", i) else (">", i)
            stop = page.find(mark, past)
            if stop < 0:
                break
            at = stop + len(mark)
        else:
            pending.append("<")
            at = i + 1
    else:
        pending.append(page[at:])
    end_block()
    close(1)
    for node in opened:  # parents before their children
        node.dropped |= node.parent.dropped
        node.main = node._is_main(node.parent.main) and not node.dropped
    return blocks, opened, closed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def kept(blocks: list[tuple[str, int]], gone=()) -> list[str]:
    """Texts of the main blocks, of the plain ones if a page has no main ones; without those whose number is in ``gone``."""
    wanted = MAIN if any(k == MAIN for _, k in blocks) else PLAIN
    return [t for i, (t, k) in enumerate(blocks) if k == wanted and i not in gone]


def read_page(page: str | None) -> tuple[list[tuple[str, int]], list[tuple[int, int, int, bool]], int]:
    """Blocks (text, kind); what may be template (subtree hash, from and to block, whether it is easily template); a hash of the main text."""
    import xxhash

    if not page:
        return [], [], 0
    found, opened, closed = parse(page)
    for node in closed:  # children close before their parents
        said = "\x1f".join([node.tag, node.names, *(x if isinstance(x, str) else format(x.hash, "x") for x in node.text)])
        node.hash = xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"))
        node.text = []
    blocks = [(t, LISTED if n.dropped else MAIN if n.main else PLAIN) for t, n in found]
    has_main = any(k == MAIN for _, k in blocks)
    wanted = MAIN if has_main else PLAIN
    sizes = np.concatenate([[0], np.cumsum([len(t) if k == wanted else 0 for t, k in blocks])]).astype(int)
    nodes = []
    for n in opened:
        able = n.tag in BLOCKS and n.tag not in ("html", "body", "article", "main") and (not n.main or n.tag in CONTAINERS)
        size = sizes[n.end] - sizes[n.start]
        if able and n.end > n.start and (size < LARGE or size * 2 <= sizes[-1]):
            nodes.append((_signed(n.hash), n.start, n.end, has_main and not size or hints_furniture(n.names)))
    whole = xxhash.xxh64_intdigest("\n".join(kept(blocks)).encode("utf-8", "surrogatepass"))
    return blocks, nodes, _signed(whole)


def extract(page: str | None) -> list[str]:
    """Blocks of a page's main text as far as the page alone tells."""
    return kept(read_page(page)[0])


BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8())]))
NODE_TYPE = pa.list_(pa.struct([("subtree", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("easy", pa.bool_())]))


def read_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """row, k, u, host, article (hash of the main text), blocks (array of text, kind), nodes (array of subtree, start, end, easy), stored."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), F.col(html).cast("string").alias("h"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            article, blocks, nodes = [], [], []
            for h in batch.column(4).to_pylist():
                own, subtrees, whole = read_page(h)
                article.append(whole)
                blocks.append([{"text": t, "kind": k} for t, k in own])
                nodes.append([dict(zip(("subtree", "start", "end", "easy"), n)) for n in subtrees])
            columns = [*(batch.column(i) for i in range(4)), pa.array(article, pa.int64()), pa.array(blocks, BLOCK_TYPE), pa.array(nodes, NODE_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "k", "u", "host", "article", "blocks", "nodes"])

    types = {c: rows.schema[c].dataType.simpleString() for c in ("k", "u")}
    schema = f"row long, k {types['k']}, u {types['u']}, host string, article long, blocks array<struct<text:string,kind:tinyint>>, nodes array<struct<subtree:bigint,start:int,end:int,easy:boolean>>"
    return stored(rows.mapInArrow(tidy(seen), schema), "pages-read")


def templates(read: DataFrame, *, min_articles: int = MIN_ARTICLES, share: float = SHARE, easy_articles: int = EASY_ARTICLES, easy_share: float = EASY_SHARE) -> DataFrame:
    """host, subtree, n (different articles it stands in), of those that are template; ``read`` from ``read_pages``."""
    subtrees = read.select("host", "article", F.explode("nodes").alias("x")).select("host", "article", "x.subtree", "x.easy")
    once = subtrees.groupBy("host", "subtree", "article").agg(F.min("easy").alias("easy"))
    spread = once.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.min("easy").alias("easy")).where(F.col("n") >= min(min_articles, easy_articles))
    hosts = read.where(F.size("blocks") > 0).select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    enough = lambda least, part: (F.col("n") >= least) & (F.col("n") >= F.col("articles") * part)
    return spread.join(bounded(hosts), "host").where(enough(min_articles, share) | F.col("easy") & enough(easy_articles, easy_share)).select("host", "subtree", "n")


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """key, url, text, n_chars, n_template (blocks that went as template), one row a page."""
    read = read_pages(pages, key=key, url=url, html=html)
    template = stored(templates(read, **options), "template")
    subtrees = read.select("row", "host", F.explode("nodes").alias("x")).select("row", "host", "x.subtree", "x.start", "x.end")
    hits = stored(subtrees.join(bounded(template.select("host", "subtree")), ["host", "subtree"]).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "template-hits")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, deleted = [], []
            for blocks, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                cover = np.zeros(len(blocks) + 1, np.int64)
                for g in gone or ():
                    cover[g["start"]] += 1
                    cover[g["end"]] -= 1
                out = set(np.flatnonzero(np.cumsum(cover)).tolist())
                texts.append("\n".join(kept([(b["text"], b["kind"]) for b in blocks], out)))
                deleted.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int32())], [key, url, "text", "n_chars", "n_template"])

    rows = read.join(bounded(hits), "row", "left").select(F.col("k").alias(key), F.col("u").alias(url), "blocks", "gone")
    types = {c: rows.schema[c].dataType.simpleString() for c in (key, url)}
    return rows.mapInArrow(tidy(joined), f"`{key}` {types[key]}, `{url}` {types[url]}, text string, n_chars long, n_template int")
