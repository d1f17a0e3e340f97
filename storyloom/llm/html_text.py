"""Main text of web pages by removal of each site's template.

Pages are parsed to element trees, subtrees are hashed, and Spark counts for each host with how many
different stories a subtree occurs; a page's story is its four longest blocks, so copies of a page don't make its
text a template. What recurs is deleted first, by its share of the host's stories: short blocks that recur on few pages go, prose
must recur on more, and what a page itself marks as its article on most. Recurrence has nothing to say about what occurs
once: there HTML's own elements (menus, forms, scripts and the like) and whole class words decide. What is left of the article (of the
whole body, where a page marks none) is the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed

#: A subtree can be template if it's with so many different stories of its host. Levels 1 to 3 are shares of the host's stories:
#: 1 is enough for what stands outside of a marked article, and for short blocks of blocks where a page marks none; 2 for prose, paragraphs, list
#: items, cells and headings of such a page; 3 inside a marked article, where texts quote and copy each other.
LEAST_PAGES, SHARES = 4, (0.01, 0.10, 0.60)
#: A subtree of so many words is prose.
PROSE = 40
#: Up to so many recurring subtrees are sent to all workers (10 bytes each); more are joined to the pages' own subtrees.
BROADCAST_ROWS = 400_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li"
    " main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
#: Blocks that hold a text of their own; other blocks hold blocks.
TEXTUAL = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li option p pre summary td th tr".split())
#: What an article's own text stands in.
PARAGRAPHS = frozenset("p pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of an article that stand between others: they recur as headings and items do, and go only with what they stand in.
PARTS = HEADINGS | frozenset("li dt dd td th tr".split())
#: What never is text of the article.
DROPPED = frozenset(
    "script style title textarea noscript iframe template xmp head nav footer aside form button select option input svg canvas object audio video dialog menu dir".split()
)
#: Whole words of class, id and role that mark what isn't the article's own text; a part of a longer word marks nothing.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr"
    " notice popup modal overlay newsletter subscribe signup share sharing social comment comments disqus reply replies related recommended footer masthead complementary search contentinfo"
    " toolbar paywall".split()
)
#: An element that opens closes an open one of these kinds, unless one of the others stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("tbody",), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
WALLS = frozenset("table td th button object caption html template".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</\Z",
    re.S,
)
MARK = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def host_of(url: str | None) -> str:
    """The host in lower case, empty where there is none."""
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


class Page:
    """One page's elements in the order they open, and its texts and block borders in page order."""

    __slots__ = ("tag", "parent", "mark", "events", "marked")

    def __init__(self, html: str | None):
        self.tag, self.parent, self.mark, self.marked = ["#page"], [-1], [""], [False]
        self.events: list[tuple[int, str | None]] = []
        self._parse(html or "")

    def _open(self, stack: list[int], tag: str, rest: str) -> int:
        marks = [(k.lower(), a or b or c) for k, a, b, c in MARK.findall(rest)] if "=" in rest else []
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.mark.append(" ".join(f"{k}={v}" for k, v in marks))
        self.marked.append(any(not MARKS.isdisjoint(v.lower().split()) for _, v in marks))
        return len(self.tag) - 1

    def _push(self, stack: list[int], open_: dict[str, list[int]], node: int) -> None:
        tag = self.tag[node]
        open_[tag].append(len(stack))
        if tag in BLOCK:
            open_["#block"].append(len(stack))
        stack.append(node)

    def _close(self, stack: list[int], open_: dict[str, list[int]], kinds: tuple, walls) -> None:
        """Close the innermost open element of these kinds, and what is open in it, unless a wall stands before it.

        ``open_`` has the places of open elements of each kind, so that nothing is searched however deep the page is.
        """
        k = max((open_[kind][-1] for kind in kinds if open_[kind]), default=0)
        if not k or any(open_[wall][-1] > k for wall in walls if open_[wall]):
            return
        for node in reversed(stack[k:]):
            tag = self.tag[node]
            open_[tag].pop()
            if tag in BLOCK:
                open_["#block"].pop()
        del stack[k:]

    def _parse(self, html: str) -> None:
        stack, open_, at, events, n = [0], defaultdict(list), 0, self.events, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                events.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                events.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[1] or m[3]
            if not name:
                if m[0].startswith("<![CDATA["):
                    events.append((stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            if not m[0].endswith(">"):
                break  # the page ends within a tag
            tag, closing = name.lower(), m[0][1] == "/"
            block = tag in BLOCK
            if closing:
                if tag == "br":
                    events.append((stack[-1], " "))
                    continue
                self._close(stack, open_, (tag,), () if block else ("#block",))
                if block:
                    events.append((stack[-1], None))
                continue
            if block and tag != "option":
                self._close(stack, open_, ("p",), WALLS)
            if tag in CLOSES:
                self._close(stack, open_, *CLOSES[tag])
            node = self._open(stack, tag, m[2] or m[4] or "")
            if block:
                events.append((node, None))
            if tag == "br":
                events.append((stack[-1], " "))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                if end is None:
                    break
                close = html.find(">", end.end())
                at = n if close < 0 else close + 1
                if tag not in DROPPED:
                    events.append((node, html[m.end() : end.start()]))
                continue
            self._push(stack, open_, node)

    def hashes(self) -> list[int]:
        """A hash of each element with all that is in it: kind, marks, texts and children in order."""
        parts: list[list] = [[t, m] for t, m in zip(self.tag, self.mark)]
        place = [0] * len(parts)
        texts: list[list[tuple[int, str]]] = [[] for _ in parts]
        for k, (node, text) in enumerate(self.events):
            if text is not None and (text := " ".join(text.split())):
                texts[node].append((k, text))
            elif text is None and not place[node]:
                place[node] = k
        out = [0] * len(parts)
        children: list[list[int]] = [[] for _ in parts]
        for node in range(len(parts) - 1, -1, -1):
            own = [*parts[node], *(t for _, t in texts[node]), *(format(out[c], "x") for c in reversed(children[node]))]
            out[node] = xxhash.xxh64_intdigest("\x1f".join(own).encode("utf-8", "surrogatepass"))
            if node:
                children[self.parent[node]].append(node)
        return out

    def content(self) -> list[bool]:
        """For each element, whether it's in the content that the page marks: article, or main where there is none.

        One that stands in a menu, an aside or an element of a marked class counts only where the page has no other; a form about it says nothing.
        An article in an article that has paragraphs of its own is a reader's comment, and is not in the content.
        """
        apart = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            tag = self.tag[k]
            apart[k] = apart[self.parent[k]] or tag in DROPPED and tag != "form" or self.marked[k] and tag not in ("html", "body")
        article = lambda k: self.tag[k] == "article" and not self.marked[k]
        main = lambda k: (self.tag[k] == "main" or "role=main" in self.mark[k]) and not self.marked[k]
        ways = [lambda k: article(k) and not apart[k], lambda k: main(k) and not apart[k], article, main]
        found = next((w for w in ways if any(map(w, range(1, len(self.tag))))), None)
        inside = [False] * len(self.tag)
        if found is None:
            return inside
        outer = [0] * len(self.tag)  # the innermost article about each element, itself included
        for k in range(1, len(self.tag)):
            inside[k] = inside[self.parent[k]] or found(k)
            outer[k] = k if self.tag[k] == "article" and inside[k] else outer[self.parent[k]]
        told = {outer[k] for k in range(1, len(self.tag)) if self.tag[k] in PARAGRAPHS and inside[k] and outer[k]}
        for k in range(1, len(self.tag)):
            above = self.parent[k]
            if self.tag[k] == "article" and outer[above] in told or inside[k] and not inside[above] and outer[above] in told:
                inside[k] = False
        return inside

    def holds(self, inside: list[bool]) -> list[bool]:
        """For each element, whether content stands in it."""
        out = [False] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            if inside[k] or out[k]:
                out[self.parent[k]] = True
        return out

    def standing(self, template: np.ndarray, inside: list[bool]) -> list[int]:
        """Recurring headings before what doesn't recur, and recurring items and cells of the content: they stay, unless what they stand in goes."""
        follows: dict[int, int] = {}
        out = []
        for k in range(len(self.tag) - 1, 0, -1):
            after = follows.get(self.parent[k])
            follows[self.parent[k]] = k
            if template[k] and (self.tag[k] in PARTS and inside[k] or self.tag[k] in HEADINGS and after is not None and not template[after]):
                out.append(k)
        return out

    def units(self, inside: list[bool]) -> list[int]:
        """The elements that can be template: blocks, and what stands directly in a block of blocks; none that holds what the page marks as its content."""
        holds = self.holds(inside)
        out = []
        for k in range(1, len(self.tag)):
            tag, above = self.tag[k], self.tag[self.parent[k]]
            if tag in ("html", "body", "head", "article", "main") or holds[k] and not inside[k]:
                continue
            if tag in BLOCK or above in BLOCK and above not in TEXTUAL:
                out.append(k)
        return out

    def words(self) -> list[int]:
        """The words in each element."""
        out = [0] * len(self.tag)
        for node, text in self.events:
            if text is not None:
                out[node] += len(text.split())
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def levels(self, inside: list[bool]) -> list[int]:
        """The level of recurrence at which each element is template."""
        if any(inside):
            return [3 if i else 1 for i in inside]
        return [2 if t in TEXTUAL or n >= PROSE else 1 for t, n in zip(self.tag, self.words())]

    def blocks(self, keep) -> list[str]:
        """Texts of the elements that ``keep`` has, cut at the borders of blocks, white space as one space."""
        found, now = [], []
        for node, text in [*self.events, (0, None)]:
            if text is None:
                if now and (block := " ".join("".join(now).split())):
                    found.append(block)
                now = []
            elif keep[node]:
                now.append(unescape(text))
        return found

    def story(self) -> int:
        """A hash of the four longest blocks."""
        longest = sorted(self.blocks([True] * len(self.tag)), key=lambda b: (-len(b), b))[:4]
        return xxhash.xxh64_intdigest("\x1f".join(longest).encode("utf-8", "surrogatepass"), 2)

    def text(self, found: np.ndarray | None = None) -> tuple[str, int]:
        """The blocks that are left, joined by two line feeds, and how many subtrees went as template. ``found`` has each element's level of recurrence."""
        inside = self.content()
        somewhere = any(inside)
        holds = self.holds(inside)
        template = np.zeros(len(self.tag), bool)
        if found is not None and found.any():
            units = self.units(inside)
            template[units] = found[units] >= np.array(self.levels(inside))[units]
            template[self.standing(template, inside)] = False
        gone, deleted = [False] * len(self.tag), 0
        for k, by_count in enumerate(template.tolist()):
            tag = self.tag[k]
            if k and gone[self.parent[k]]:
                gone[k] = True
            elif by_count:
                gone[k], deleted = True, deleted + 1
            else:
                named = self.marked[k] and (tag not in ("html", "body", "article", "main") or inside[self.parent[k]])
                gone[k] = (tag in DROPPED or named or tag == "header" and not inside[k]) and not (holds[k] and not inside[k])
        keep = [not g and (i or not somewhere) for g, i in zip(gone, inside)]
        return "\n\n".join(self.blocks(keep)), deleted


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _host_key(url: str | None) -> int:
    """0 for a page without a host: it has no site, and so no template."""
    host = host_of(url)
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 1) if host else 0


def _keys(host: int, hashes: list[int]) -> np.ndarray:
    """Numbers of subtrees that differ from host to host."""
    mixed = (np.array(hashes, np.uint64) ^ np.uint64(host)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _rows(pages: DataFrame) -> DataFrame:
    html = F.col("html").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.xxhash64("url", html).alias("row"))


def subtrees(pages: DataFrame) -> DataFrame:
    """``(page_id, row, host, story, key)``: the subtrees of each page that can be template, each once; key 0 stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "row", "host", "story", "key"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, rows, hosts, stories, keys = [], [], [], [], []
                for page_id, url, html, row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    host = _host_key(url)
                    if not host:
                        continue
                    page = Page(html)
                    units = page.units(page.content())
                    own = np.unique(np.append(_keys(host, page.hashes())[units], 0))
                    keys.append(own)
                    for values, value in ((ids, page_id), (rows, row), (hosts, _signed(host)), (stories, _signed(page.story()))):
                        values.extend([value] * len(own))
                columns = [*(pa.array(x, pa.int64()) for x in (ids, rows, hosts, stories)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _rows(pages).mapInArrow(run, "page_id long, row long, host long, story long, key long")


def recurring(found: DataFrame) -> DataFrame:
    """``(key, level)``: the subtrees that recur on their host, with the highest level of ``SHARES`` that they reach."""
    counts = found.select("host", "key", "story").distinct().groupBy("host", "key").count().where(F.col("count") >= LEAST_PAGES)
    counts = checkpointed(counts)
    pages = counts.where("key = 0").select(F.col("host").alias("of"), F.col("count").alias("pages"))
    share = F.col("count") / F.col("pages")
    level = sum((F.when(share >= s, 1).otherwise(0) for s in SHARES), F.lit(0)).cast("int")
    return counts.where("key <> 0").join(pages, F.col("host") == F.col("of")).select("key", level.alias("level")).where("level > 0")


def main_text(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS, counting: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars, n_template)`` for every row of ``pages(page_id, url, html, ...)``.

    ``n_template`` counts the subtrees that were deleted because they recur; without ``counting`` none is. A null or empty html, and a page
    without text, gives an empty text. A page whose url is null or has no host
    has no site: it is cleaned by its own markup alone. Broken html is read as far as it goes: open elements end
    where their parent does, a tag that the page's end cuts is left out. Repeated rows are
    returned each, other columns are ignored, an empty table gives an empty result.
    """
    rows = _rows(pages)
    none = np.zeros(0, np.int64), np.zeros(0, np.int8)
    looked = lambda keys, levels: (keys[at := np.argsort(keys)], levels[at])
    if not counting:
        look = lambda part: [none] * part.num_rows
    else:
        found = subtrees(pages)
        template = checkpointed(recurring(found))
        if template.limit(broadcast_rows + 1).count() <= broadcast_rows:
            got = template.toArrow()  # at most broadcast_rows
            sent = pages.sparkSession.sparkContext.broadcast(looked(got.column("key").to_numpy(), got.column("level").to_numpy().astype(np.int8)))
            look = lambda part: [sent.value] * part.num_rows
        else:
            hits = found.join(template, "key").groupBy(F.col("page_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_set(F.struct("key", "level")).alias("hits"))
            rows = rows.join(hits, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left").select("page_id", "url", "html", "row", "hits")
            listed = lambda h: looked(np.array([x["key"] for x in h], np.int64), np.array([x["level"] for x in h], np.int8)) if h else none
            look = lambda part: [listed(h) for h in part.column(4).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, deleted = [], []
                for url, html, (keys, levels) in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), look(part)):
                    page, host, level = Page(html), _host_key(url), None
                    if host and len(keys):
                        own = _keys(host, page.hashes())
                        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        level = np.where(keys[at] == own, levels[at], 0)
                    text, n = page.text(level)
                    texts.append(text)
                    deleted.append(n)
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(deleted, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_template"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")
