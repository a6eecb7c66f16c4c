"""Main text of web pages by consensus of the pages of a host.

Each page proposes the deepest container beside which only scraps stand: short boxes
of bare text, without a paragraph, heading, list or table.  The tag-class paths of
containers and scraps, numbers generalised, are votes; Spark counts them per host.
A page with the container that its host has agreed on keeps all content that is not
boilerplate, but for boxes at paths that most pages of the host call scraps.  A page
without that container, or without a host, goes by its own proposal.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import slim
from rankwell.session import written

#: Share of the content of a page that its container must hold; scraps are the rest.
COVERAGE = 0.95

# Element names of the HTML standard, and words of class names.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li"
    " main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head input label map menu nav object"
    " option search select svg video".split()
)
_ARTICLE = frozenset(("article", "main"))
_BOXES = frozenset("center div section".split())
_CLOSED_BY_BLOCK = frozenset(("p",))
_SAME_CLOSES = frozenset(("li", "dt", "dd", "td", "th", "tr", "option"))
_COMMENT_WORDS = frozenset(
    "comment comments commentlist disqus discussion replies reply respond".split()
)
_HEADER_WORDS = frozenset(("header", "head", "masthead"))
_PAGE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb"
    " breadcrumbs byline consent cookie cookies copyright dropdown footer gdpr legal login menu menubar modal"
    " nav navbar navigation newsletter notice notices notification overlay pager pagination popup"
    " popover promo promoted promotion recommendations recommended related search share sharing"
    " sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription toolbar"
    " topbar widget widgets".split()
)

_FRAME_WORDS = frozenset(
    "area articles bar block bottom box button buttons caption cell col column container content count desktop"
    " fixed form group icon icons inline inner item items left link links list main message mobile module outer"
    " panel post posts row section site sticky stories story text thread title top total user users wrap wrapper"
    " page right small large the a of and number on".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value right after an equals sign only
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S
)
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
#: White space of HTML and of Unicode alike; a no-break space counts too.
_BLANKS = re.compile(r"\s+")


@lru_cache(maxsize=100_000)
def speaks_against(name: str, in_article: bool) -> bool:
    """Whether a class or id names boilerplate or comments, and nothing besides but its frame.

    So ``comments-area`` does, and ``has-comments``, ``comments-open`` and ``related-work`` do not.
    """
    words = {w.lower() for w in _CLASS_WORD.findall(name) if not w.isdigit()}
    told = _PAGE_WORDS | _COMMENT_WORDS if in_article else _PAGE_WORDS | _COMMENT_WORDS | _HEADER_WORDS
    return bool(words & told) and words <= told | _FRAME_WORDS


@dataclass
class Node:
    """One element: its place, what speaks against it, and what it holds."""

    parent: int
    tag: str
    path: str
    dropped: bool
    doubtful: bool
    named: bool
    inside: bool = False
    text: int = 0
    content: int = 0
    links: int = 0
    depth: int = 0


@dataclass
class Block:
    node: int
    parts: list[str] = field(default_factory=list)
    links: int = 0


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


class Page:
    """The elements and blocks of one page, in order."""

    def __init__(self, source: str) -> None:
        self.nodes = [Node(-1, "", "", False, False, False)]
        self.blocks: list[Block] = []
        self._open = [0]
        self._tags: Counter[str] = Counter([""])
        self._links = 0
        self._block = Block(0)
        at = 0
        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, m[3])
            if tag in _RAW:  # up to its own end tag, whatever stands in it
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else end
                self._close(tag)
        if at < end:
            self._text(source[at:])
        self._break()
        self._weigh()

    def _text(self, raw: str) -> None:
        text = html_lib.unescape(raw) if "&" in raw else raw
        self._block.parts.append(text)
        if self._links:
            self._block.links += len(text.strip())

    def _break(self) -> None:
        """Ends the current block."""
        block = self._block
        if block.parts:
            text = _BLANKS.sub(" ", "".join(block.parts)).strip()
            if text:
                block.parts = [text]
                self.blocks.append(block)
        self._block = Block(self._open[-1])

    def _start(self, tag: str, source: str) -> None:
        if tag in _BLOCK:
            for closed in (_CLOSED_BY_BLOCK, {tag} & _SAME_CLOSES):
                self._close_if_open(closed)
            self._break()
        if tag == "br":
            self._block.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self._links += 1
        if tag not in _BLOCK and tag not in _RAW and tag not in _DROPPED:
            if tag == "a" or not source.strip():
                return  # inline elements make no container
        parent = self._open[-1]
        above = self.nodes[parent]
        attributes = _attributes(source) if source.strip() else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        in_article = above.inside
        top = tag in ("html", "body")
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")
        ) is not None
        role = attributes.get("role", "")
        dropped = not top and (
            tag in _DROPPED or tag in _RAW or hidden
            or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
            or (tag == "header" and not in_article)
        )
        doubtful = not top and tag not in _ARTICLE and any(
            speaks_against(name, in_article) for name in names.split()
        )
        named = tag in _ARTICLE or role in ("main", "article") or attributes.get("itemprop") == "articleBody"
        label = tag + "".join(f".{_DIGITS.sub('#', c)}" for c in sorted(attributes.get("class", "").split()))
        # a path is a hash of fixed length, however deep it is
        path = blake2b(f"{above.path}>{label}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        self.nodes.append(
            Node(parent, tag, path, above.dropped or dropped, doubtful, named, in_article or named, depth=above.depth + 1)
        )
        self._open.append(len(self.nodes) - 1)
        self._tags[tag] += 1
        if tag in _BLOCK:
            self._block = Block(self._open[-1])
        elif dropped:
            self._break()

    def _close_if_open(self, tags: set[str] | frozenset[str]) -> None:
        if tags and self.nodes[self._open[-1]].tag in tags:
            self._close(self.nodes[self._open[-1]].tag)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._links = max(0, self._links - 1)
            return
        if tag in _BLOCK:
            self._break()
        if not self._tags[tag]:
            return
        while True:
            node = self._open.pop()
            self._tags[self.nodes[node].tag] -= 1
            if self.nodes[node].tag in _BLOCK or self.nodes[node].dropped:
                self._break()
            if self.nodes[node].tag == tag:
                break
        self._block.node = self._open[-1] if not self._block.parts else self._block.node

    def _weigh(self) -> None:
        for block in self.blocks:
            self.nodes[block.node].text += len(block.parts[0])
            self.nodes[block.node].links += min(block.links, len(block.parts[0]))
        for node in reversed(self.nodes[1:]):
            self.nodes[node.parent].text += node.text
            self.nodes[node.parent].links += node.links
        # a class name says nothing against what holds an article
        holds = [n.named for n in self.nodes]
        for i in range(len(self.nodes) - 1, 0, -1):
            holds[self.nodes[i].parent] |= holds[i]
        certain = [n.dropped for n in self.nodes]
        own = self._own_words()
        for i, node in enumerate(self.nodes[1:], 1):
            certain[i] = certain[i] or certain[node.parent] or self._is_menu(i, own)
            node.dropped = certain[i] or self.nodes[node.parent].dropped or (node.doubtful and not holds[i])
        if not any(not self.nodes[b.node].dropped for b in self.blocks):
            # where class names would take all, they are not believed
            for node, drop in zip(self.nodes, certain, strict=True):
                node.dropped = drop
        for block in self.blocks:
            if not self.nodes[block.node].dropped:
                self.nodes[block.node].content += len(block.parts[0])
        for node in reversed(self.nodes[1:]):
            self.nodes[node.parent].content += node.content

    def _own_words(self) -> dict[int, tuple[int, int]]:
        """First and last child of each element with words that are no links."""
        own: dict[int, tuple[int, int]] = {}
        for i, node in enumerate(self.nodes[1:], 1):
            if node.text > node.links:
                first, _ = own.get(node.parent, (i, i))
                own[node.parent] = first, i
        return own

    def _is_menu(self, i: int, own: dict[int, tuple[int, int]]) -> bool:
        """A list of links outside an article, unless it stands between other words."""
        node = self.nodes[i]
        if node.tag not in ("ul", "ol", "dl") or node.inside or not node.text or node.links <= 0.9 * node.text:
            return False
        first, last = own.get(node.parent, (i, i))
        return not first < i < last

    def proposal(self) -> tuple[int, list[int]]:
        """The deepest element beside which only scraps stand, and these scraps."""
        nodes = self.nodes
        filled: list[list[int]] = [[] for _ in nodes]
        bare = [n.tag in _BOXES or n.tag not in _BLOCK for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].content:
                filled[nodes[i].parent].append(i)
                bare[nodes[i].parent] &= bare[i]
        at, scraps = 0, []
        while filled[at]:
            best = max(filled[at], key=lambda i: (nodes[i].content, -i))
            rest = [i for i in filled[at] if i != best]
            own = nodes[at].content - sum(nodes[i].content for i in filled[at])
            if own or nodes[best].tag not in _BLOCK or nodes[best].tag == "p":
                break
            if rest and (bare[best] or nodes[best].content < COVERAGE * nodes[0].content):
                break
            if not all(bare[i] and nodes[i].tag in _BOXES for i in rest):
                break
            scraps += rest
            at = best
        return at, scraps

    def container(self) -> int:
        return self.proposal()[0]

    def outvoted(self, agreed: str | None, rejected: frozenset[str]) -> list[int]:
        """What goes besides boilerplate: boxes the host rejects, or else the page's scraps."""
        holders = {i for i, n in enumerate(self.nodes) if n.path == agreed and n.content} if agreed else ()
        if not holders:
            return self.proposal()[1]
        kept = [False] * len(self.nodes)
        around = [i in holders for i in range(len(self.nodes))]
        for i, node in enumerate(self.nodes):
            kept[i] = i in holders or (node.parent >= 0 and kept[node.parent])
        for i in range(len(self.nodes) - 1, 0, -1):
            around[self.nodes[i].parent] |= around[i]
        return [i for i, n in enumerate(self.nodes) if n.path in rejected and not kept[i] and not around[i]]

    def text(self, container: int, without: Sequence[int] = ()) -> str:
        """Blocks inside the container; nothing of the elements ``without``."""
        inside = [False] * len(self.nodes)
        out = set(without)
        for i, node in enumerate(self.nodes):
            inside[i] = (i == container or (node.parent >= 0 and inside[node.parent])) and i not in out
        return "\n".join(
            b.parts[0] for b in self.blocks if inside[b.node] and not self.nodes[b.node].dropped
        )


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str, int, int, int]] = []
        for host, source in zip(
            batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True
        ):
            if host is None:
                continue
            page = Page(source or "")
            if not page.nodes[0].content:
                continue
            best, scraps = page.proposal()
            rows.append((host, page.nodes[best].path, 1, 0, page.nodes[best].content))
            rows += [(host, path, 0, 1, 0) for path in {page.nodes[i].path for i in scraps}]
        hosts, paths, chosen, out, sizes = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chosen, pa.int64()),
             pa.array(out, pa.int64()), pa.array(sizes, pa.int64())],
            names=["host", "path", "chosen", "out", "size"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str] = []
        for source, path, rejected in zip(
            batch.column("html").to_pylist(), batch.column("agreed").to_pylist(),
            batch.column("rejected").to_pylist(), strict=True,
        ):
            page = Page(source or "")
            texts.append(page.text(0, page.outvoted(path, frozenset(rejected or ()))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id").cast(pa.int64()),
                batch.column("url").cast(pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, agreed, rejected): the path most pages of a host propose, and the paths of
    boxes that more than half of its pages call scraps.

    Counted per (host, path) before hosts meet, so a host with a third of all pages
    is a few rows.  Ties: more content, then the smaller path.  A page has few scraps,
    so there are at most twice as many rejected paths as scraps of an average page.
    """
    votes = pages.select("host", "html").mapInArrow(
        _votes, "host string, path string, chosen bigint, out bigint, size bigint"
    )
    # written, as three plans read it and each would read all pages
    counted = written(votes.groupBy("host", "path").agg(
        F.sum("chosen").alias("votes"), F.sum("out").alias("out"), F.sum("size").alias("size")
    ), "host_paths")
    hosts = counted.groupBy("host").agg(
        F.min_by("path", F.struct(-F.col("votes"), -F.col("size"), F.col("path"))).alias("agreed"),
        F.sum("votes").alias("voters"), F.max("out").alias("most_out"),
    )
    outs = counted.filter("out > 0").select(F.col("host").alias("out_host"), "path", "out")
    rejected = (
        outs.join(hosts.filter("2 * most_out > voters"), F.col("out_host") == F.col("host"))
        .filter("2 * out > voters").groupBy("out_host").agg(F.collect_set("path").alias("rejected"))
    )
    return hosts.join(rejected, F.col("host") == F.col("out_host"), "left").select(
        "host", "agreed", "rejected"
    )


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks are joined in page order by one line feed; white space inside a block is
    one space.  NULL or empty html, and pages without content, give the empty text.
    A NULL url, or one without a host, takes no part in the votes and is extracted
    by itself.  Repeated rows vote one by one.  Very long pages are read whole.  An
    empty table gives an empty table.  Other columns are not read.
    """
    rows = slim(pages, page_id=page_id, url=url, html=html)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    # a hot host is split by the adaptive join; a small table of hosts is broadcast by it
    agreed = host_paths(rows).withColumnRenamed("host", "agreed_host")
    joined = rows.join(agreed, F.col("host") == F.col("agreed_host"), "left")
    return joined.select("page_id", "url", "html", "agreed", "rejected").mapInArrow(
        _texts, "page_id bigint, url string, text string, n_chars bigint"
    )
