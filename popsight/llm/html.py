"""HTML extraction with site template removal.

A page is read as a stream of tags and text. Every element gets a hash of
its subtree (tag, texts, children, bottom-up, so in linear time). Spark first counts on how many of
a host's pages each block of text occurs: a block that recurs is nobody's own. Then it counts
per host beside how many different main texts each subtree occurs (a page is stood for by a block of its own if it has one,
so that a long text that all pages share can't stand for them; copies of a page, which have none, count
once), and keeps those on at least ``min_pages`` pages that are a share of
``min_share`` of the host's pages or MANY_PAGES: the site's template. A last pass deletes these subtrees, and elements that say
themselves that they are menus, headers, footers, side bars, notices, adverts, forms or reader
comments, and writes the remaining blocks of the article.

A host with a third of all pages is counted by subtree and main text, so it is spread. Its template has
at most 1 / min_share subtrees for each element of an average page, and one for each
MANY_PAGES elements of all its pages. Templates are sent with the task when they are few
(counted); beyond that pages are joined by host and a salt, so that a hot host is split.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import q, ship, stored, table

MIN_PAGES, MIN_SHARE = 5, 0.1
MANY_PAGES = 100            # recurring on as many pages is enough, whatever the share
FEW_PAGES = 3               # the least a host has for a template: what is on all of them
DRAWS = 2                   # independent ones, as a block that many pages share may be drawn often; the larger count holds
BROADCAST_SUBTREES = 200_000
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: Their content isn't markup; it is skipped.
RAW = frozenset("script style title textarea noscript iframe template noembed noframes xmp svg math".split())
DROPPED = frozenset("nav aside form button select dialog menu head object audio video canvas fieldset footer".split())
#: Parts of class and id names that mark what isn't the article.
MARKS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr "
                  "notice notices alert sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs "
                  "footer masthead comment comments disqus reply replies respond share sharing social related "
                  "recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar "
                  "pagination pager skip hidden".split())
#: Parts of names that say nothing by themselves: a name marks an element if it has a part of MARKS and all others are of these.
PLAIN = frozenset("area article articles bar bars block blocks body bottom box boxes button buttons card cards close col column "
                  "container content count desktop entry fixed global google group header icon icons inner item items js left link links list "
                  "main media message mobile module outer page panel post posts primary reader right row secondary section site slot "
                  "small sticky stories story text thread title top unit user wrap wrapper zone".split())
#: In front of a mark these say that it isn't one: no-sidebar, has-footer, with-comments.
NEGATIONS = frozenset("no not non has have with without is hide enable disable".split())
#: Marks of what goes even if it is most of a page: reader comments, adverts, notices, sign-ups.
FIRM_MARKS = frozenset("comment comments disqus reply replies respond ad ads advert adverts advertisement adsense sponsor sponsored "
                       "promo cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup "
                       "modal hidden".split())
LEAST_PROSE = 200           # characters of running text that make the most of a page an article whatever its name
OWN_WORDS = 4               # a block of fewer doesn't stand for a page: page numbers, advert codes
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
#: Opening one of these ends an open element of the same set.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"),
        "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: What an implied end doesn't reach across.
SCOPE = frozenset("article section div table ul ol dl body html main td th blockquote nav aside footer header form".split())
#: Running text of an article; copies of it on other pages are no template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dt dd figcaption tr".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*)>"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|\d+")


def _marked(name: str) -> bool:
    """Whether one class or id name marks what isn't the article."""
    parts = [x for x in _PART.findall(name) if x.isalpha()]
    at = next((i for i, x in enumerate(parts) if x in MARKS), None)
    return at is not None and NEGATIONS.isdisjoint(parts[:at]) and all(x in MARKS or x in PLAIN for x in parts)


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element says that it isn't part of the article: 0 no, HARD by tag, role or because it
    is hidden, SOFT by its names, FIRM by a name of FIRM_MARKS."""
    if tag in DROPPED or tag == "header" and not in_article:
        return HARD
    if not attrs or attrs.isspace() or tag in ("html", "body", "main") or tag == "article" and not in_article:
        return 0
    found = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
        if name == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if name in ("class", "id"):
            for one in value.split():
                if _marked(one):
                    found = max(found, SOFT if FIRM_MARKS.isdisjoint(_PART.findall(one)) else FIRM)
                elif "header" in one and not in_article and tag not in PROSE:
                    parts = [x for x in _PART.findall(one) if x.isalpha()]
                    if "header" in parts and NEGATIONS.isdisjoint(parts) and PLAIN.issuperset(parts):
                        found = max(found, SOFT)
    return found


HARD, SOFT, FIRM = 3, 1, 2


class _Node:
    __slots__ = ("tag", "seen", "dropped", "soft", "inner", "article", "at", "words", "holds")

    def __init__(self, tag: str, dropped: bool, article: bool, at: int, soft: int = 0, inner: bool = False):
        self.tag, self.dropped, self.article, self.at, self.soft, self.inner = tag, dropped, article, at, soft, inner
        self.seen, self.words, self.holds = [], False, False


def block_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text, 77) - (1 << 63)


def rests(blocks: list[tuple[str, bool, bool]], elements: list[tuple[int, int, int]], draw: int,
          common: set[int] | frozenset[int] = frozenset()) -> tuple[int, list[int | None]]:
    """What stands for the main text of a page, and for the main text beside each element
    (None where there is none): the hash of one block, drawn by hash and in proportion to the
    square of its length, among the blocks of OWN_WORDS words that aren't ``common`` on the host, or among all
    if there is none. Copies of an article draw the same block even when something short beside it differs."""
    from xxhash import xxh64_intdigest

    in_article = any(b[2] for b in blocks)
    usable = [not dropped and (article or not in_article) for _, dropped, article in blocks]
    own = [u and b[0].count(" ") >= OWN_WORDS - 1 and block_hash(b[0]) not in common for u, b in zip(usable, blocks)]
    if any(own):
        usable = own
    nothing = (math.inf, 0)
    drawn = [nothing] * len(blocks)
    for i, (text, _, _) in enumerate(blocks):
        if usable[i]:
            h = xxh64_intdigest(text, draw)
            drawn[i] = (-math.log((h + 1) / (1 << 64)) / len(text) ** 2, h - (1 << 63))
    before = list(accumulate(drawn, min, initial=nothing))
    after = list(accumulate(reversed(drawn), min, initial=nothing))[::-1]
    found = [min(before[a], after[b]) for _, a, b in elements]
    return before[-1][1], [None if x == nothing else x[1] for x in found]


def read(page: str) -> tuple[list[tuple[str, bool, bool]], list[tuple[int, int, int]]]:
    """(blocks, elements) of a page. Blocks are (text, dropped, in an article)
    in page order; elements are (subtree hash, first block, one past the last) of those
    with text that can be a template: not the article or what holds it, and not its prose."""
    from xxhash import xxh64_intdigest

    blocks: list[tuple[str, bool, bool]] = []
    by_name: list[tuple[int, bool, bool]] = []       # of a block: the outermost element that drops it by name, whether another one does, prose
    elements: list[tuple[int, int, int]] = []
    root = _Node("", False, False, 0)
    stack, text = [root], []
    open_tags: Counter = Counter()
    pos, n, found_article, softs = 0, len(page), False, 0
    firm: set[int] = set()

    def flush() -> None:
        words = " ".join(_html.unescape("".join(text)).split())
        text.clear()
        if words:
            top = stack[-1]
            blocks.append((words, top.dropped or top.soft > 0, top.article))
            by_name.append((0 if top.dropped else top.soft, top.inner, top.tag in PROSE))
            top.seen.append(words)
            top.words = True

    def pop() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        up = stack[-1]
        if not node.words:
            up.holds |= node.holds
            return
        h = xxh64_intdigest(node.tag + "\x00" + "\x01".join(map(str, node.seen))) - (1 << 63)
        up.seen.append(h)
        up.words = True
        up.holds |= node.holds
        if not (node.holds or node.tag in ("article", "main", "body", "html") or node.article and node.tag in PROSE):
            elements.append((h, node.at, len(blocks)))

    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos:
            text.append(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in INLINE:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            flush()
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            flush()
            end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        flush()
        if tag in VOID or attrs.endswith("/") and tag not in SCOPE and tag not in PROSE:
            continue
        for other in ENDS.get(tag, ("p",)):
            if not open_tags[other]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == other:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in SCOPE:
                    break
        up = stack[-1]
        main = tag in ("article", "main")
        says = _dropped(tag, attrs, up.article)
        dropped, soft, inner = up.dropped or says == HARD, up.soft, up.inner
        if main and not dropped and not found_article and soft not in firm:
            soft, inner = 0, False                   # what holds the article isn't dropped for its name
        if says in (SOFT, FIRM):
            if soft:
                inner = True
            else:
                softs += 1
                soft = softs
                if says == FIRM:
                    firm.add(soft)
        kept = not dropped and not soft
        found_article |= main and kept
        stack.append(_Node(tag, dropped, (up.article or main) and kept, len(blocks), soft, inner))
        stack[-1].holds = main and kept
        open_tags[tag] += 1
    if pos < n:
        text.append(page[pos:])
    flush()
    while len(stack) > 1:
        pop()
    if softs and not found_article:
        # most of a page isn't dropped for the name of what holds it
        size, prose = Counter(), Counter()
        for (words, gone, _), (outer, _, running) in zip(blocks, by_name):
            if outer or not gone:
                size[outer] += len(words)
                prose[outer] += len(words) * running
        top = max((k for k in size if k and k not in firm), key=lambda k: (size[k], -k), default=0)
        if top and 2 * size[top] > sum(size.values()) and prose[top] >= LEAST_PROSE:
            blocks = [(w, d and (outer != top or inner), x) for (w, d, x), (outer, inner, _) in zip(blocks, by_name)]
    return blocks, elements


def main_text(page: str, template: set[int]) -> str:
    """Blocks of the article (of the whole page where none is marked) that
    aren't dropped or inside a template subtree, joined by newlines."""
    blocks, elements = read(page)
    keep = [not b[1] for b in blocks]
    for h, a, b in elements:
        if h in template:
            keep[a:b] = [False] * (b - a)
    in_article = any(b[2] for b in blocks)
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k and (b[2] or not in_article))


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(q(url)).cast("string"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's different blocks, and the page itself (null)."""
    for batch in batches:
        hosts, hashes = [], []
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            found = {block_hash(b[0]) for b in read(page or "")[0] if not b[1]}
            hosts += [host] * (len(found) + 1)
            hashes += [None, *found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "h"])


def _votes(hosts: list, pages: list, common: list) -> pa.RecordBatch:
    out: tuple[list, ...] = ([], [], [], [])
    for host, page, known in zip(hosts, pages, common):
        blocks, elements = read(page or "")
        for draw in range(DRAWS):
            whole, beside = rests(blocks, elements, draw, known)
            found = {(e[0], x) for e, x in zip(elements, beside) if x is not None}
            out[0].extend([host] * (len(found) + 1))
            out[1].extend([None, *(h for h, _ in found)])    # the page itself, to count pages
            out[2].extend([draw] * (len(found) + 1))
            out[3].extend([whole, *(x for _, x in found)])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64()))],
                                      ["host", "h", "draw", "rest"])


def _subtrees_of(known: dict[str, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages = (c.to_pylist() for c in batch.columns)
            yield _votes(hosts, pages, [known.get(h, frozenset()) for h in hosts])

    return run


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages = (c.to_pylist() for c in batch.columns[:2])
        yield _votes(hosts, pages, _sets(batch.column(2)))


def _sets(lists: pa.Array) -> list:
    """Each row's list as a set; equal neighbours share one."""
    out, last, known = [], None, frozenset()
    for t in lists:
        if not t.is_valid:
            known, last = frozenset(), None
        elif last is None or not t.equals(last):
            known, last = set(t.as_py()), t
        out.append(known)
    return out


def _recurring(counts: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, found): what recurs, of counts (host, h, n); the host's pages are its row with a null h."""
    total = counts.filter("h is null").select("host", F.col("n").alias("all"))
    n, every = F.col("n"), F.col("all")
    recurs = (n >= min_pages) & ((n >= min_share * every) | (n >= MANY_PAGES)) | (every < min_pages) & (n >= every) & (n >= FEW_PAGES)
    return counts.filter("h is not null").join(total, "host").filter(recurs).groupBy("host").agg(F.collect_list("h").alias("found"))


def _beside(rows: DataFrame, found: DataFrame, sent, joined, schema: str) -> DataFrame:
    """mapInArrow over ``rows`` (host last) with what was ``found`` of each row's host: sent with the task where it
    is little (counted), else joined by host and a salt, so that a hot host is split."""
    size = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    if size <= BROADCAST_SUBTREES:
        return rows.mapInArrow(sent({r["host"]: set(r["found"]) for r in found.collect()}), schema)
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return each.select(*rows.columns, "found").mapInArrow(joined, schema)


def templates(pages: DataFrame, url: str = "url", html: str = "html",
              min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, found): hashes of the subtrees that recur on a host beside different main
    texts, so that copies of a page count once: on ``min_pages`` of them and either a share of ``min_share``
    or MANY_PAGES. A host of fewer than ``min_pages``, but FEW_PAGES, has those that are on
    all; below that nothing recurs often enough. Urls without a host count as one."""
    least = min(min_pages, FEW_PAGES)
    rows = pages.select(host_of(url).alias("host"), F.col(q(html)).cast("string").alias("html"))
    blocks = (rows.mapInArrow(_blocks, "host string, h bigint").groupBy("host", "h")
              .agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) | F.col("h").isNull()))
    common = stored(_recurring(stored(blocks, "blocks"), min_pages, min_share), "common-blocks")
    votes = _beside(rows, common, _subtrees_of, _subtrees, "host string, h bigint, draw int, rest bigint")
    seen = (votes.distinct().groupBy("host", "h", "draw").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("host", "h").agg(F.max("n").alias("n")).filter(F.col("n") >= least))
    return _recurring(stored(seen, "subtrees"), min_pages, min_share)


def _extracted(ids: pa.Array, urls: pa.Array, pages: list, known: list) -> pa.RecordBatch:
    got = [main_text(x or "", k) for x, k in zip(pages, known)]
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(got, pa.string())], ["page_id", "url", "text"])


def _texts_of(known: dict[str, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, html, host = batch.columns
            yield _extracted(page, url, html.to_pylist(), [known.get(y, frozenset()) for y in host.to_pylist()])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, url, html, _, found = batch.columns
        yield _extracted(page, url, html.to_pylist(), _sets(found))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``. Null and empty html give
    an empty text; repeated rows are extracted one by one (and count once as
    pages of their host); unclosed and truncated markup is read to the end. Time is linear in a page."""
    found = stored(templates(pages, url, html, min_pages, min_share), "templates")
    rows = pages.select(F.col(q(page_id)).cast("long").alias("page_id"), F.col(q(url)).cast("string").alias("url"),
                        F.col(q(html)).cast("string").alias("html"), host_of(url).alias("host"))
    return _beside(rows, found, _texts_of, _texts, "page_id bigint, url string, text string")


def op10_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Nulls, empty and long pages, repeated rows, an empty table: see ``extract``."""
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ship(__name__)
