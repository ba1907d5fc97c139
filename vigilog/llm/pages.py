"""Main text of web pages: page structure, and a host-wide suffix order for what the structure leaves open.

Structure first: scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and reader comments go by
element, role and class, and with them the articles inside them (teasers, comments). If a page marks its article, the
text inside is the main text, whole, even where other pages repeat it. Pages without such a mark keep what is neither marked as surroundings nor boilerplate of their host.

Boilerplate is found over the token streams of all pages of a host (outside marked articles). A run of tokens goes if it
lies in a substring of at least ``LONG`` tokens that distinct pages of the host repeat; pages with equal streams count
as one page, so a page and its copies don't erase each other. For this all suffixes of a host are put in order: these
substrings are the intervals of suffixes whose neighbours have ``LONG`` tokens or more in common and that come from more
than one page. A host may hold a third of all pages, so the order is not an array in one task: suffixes are dealt out
by ranges of host and first ``LONG`` tokens, so that no interval is cut, and put in order inside each range. Suffixes are
cut after ``DEPTH`` tokens, and equal ones are one row (its least and greatest page) before they are shuffled, since a
menu may stand on every page. Only unmarked pages are joined back.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .substrings import run_hashes, word_hashes

#: Least tokens of a repeated substring.
LONG = 10
#: Tokens of a suffix, at least ``LONG``; suffixes that have all of them in common are equal in the order.
DEPTH = 12
#: Bytes beyond which a token stands in the order by a digest, so that suffixes of very long tokens stay short.
TOKEN_BYTES = 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[A-Za-z/!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME = re.compile("[a-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)
# Elements by what they do to the text.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form button select iframe noscript template svg canvas menu dialog object audio video".split())
_BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_CELLS = frozenset("td th".split())
_SELF_CLOSED = frozenset("p li dt dd option tr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_LAYOUT = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead banner notice notices popup modal overlay share sharing social widget widgets pagination pager toolbar copyright".split())
_FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login related recommended comment comments commentlist respond disqus replies".split()
)
_CONTENT = frozenset("article body content entry main post story text".split())
_TURNED = (frozenset("has is no not with without".split()), frozenset("enabled disabled free friendly off on open".split()))


@dataclass
class Page:
    """What the structure of a page gives: marked articles, other text, and the tokens outside the articles."""

    marked: bool = False
    article: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)
    outside: list[bytes] = field(default_factory=list)

    def text(self) -> str:
        return "\n".join(self.article)


@dataclass
class _Skip:
    """Surroundings being left out: the element, how often it is open, and what told them apart.

    ``hard``: element, role or style; ``foreign``: a name of other people's text; ``layout``: a name of the page's frame,
    which the element around the article may carry too.
    """

    element: str
    kind: str
    open: int = 1
    closed: bool = False
    size: int = 0


@dataclass
class _Mark:
    """An article or main element: the surroundings it stands in, and the characters of its own text."""

    within: _Skip | None
    size: int = 0


def _named(value: str) -> str:
    """What a class or id says: ``foreign``, ``layout`` or nothing. Names are judged one by one and by their parts.

    A name of content alone (``post-content``) outweighs a name that only starts or ends like surroundings
    (``share-friendly``); names that turn their word (``no-ads``, ``has-sidebar``) say nothing.
    """
    found, content = "", False
    for name in value.split():
        parts = _NAME.findall(name)
        if not parts or len(parts) > 1 and (parts[0] in _TURNED[0] or parts[-1] in _TURNED[1]):
            continue
        if not _FOREIGN.isdisjoint(parts):
            return "foreign"
        if not _LAYOUT.isdisjoint(parts):
            found = "layout"
        elif not _CONTENT.isdisjoint(parts):
            content = True
    return "" if content else found


def _surrounding(name: str, attributes: str, in_article: bool) -> str:
    """The kind of surroundings that an element opens, if any."""
    if name in _DROPPED or (name == "header" and not in_article):
        return "hard"
    if not attributes or name in ("body", "html"):
        return ""
    kinds = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            kinds.add(_named(value))
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            kinds.add("hard")
        if key == "style" and re.search(r"display\s*:\s*none", value):
            kinds.add("hard")
    if name in ("article", "main") and not in_article:
        kinds.discard("layout")
    return next((k for k in ("hard", "foreign", "layout") if k in kinds), "")


def parse(source: str) -> Page:
    """Blocks of a page in page order, white space in a block as one space, character references decoded.

    The article is what stands in ``article`` or ``main`` outside all surroundings. Surroundings by a name of layout that
    hold more than half of the text of their article are not surroundings. If no article has text, the largest one that
    stands in layout, or in surroundings that are never closed, is the article.
    """
    parts: list[str] = []
    blocks: list[tuple[str, _Mark | None, _Skip | None]] = []
    marks: list[tuple[_Mark, _Skip | None]] = []  # open ones, each with the surroundings that it interrupts
    skip: _Skip | None = None
    at, n = 0, len(source)

    def end_block() -> None:
        if parts:
            if block := " ".join(entities.unescape("".join(parts)).split()):
                mark = marks[0][0] if marks else None
                blocks.append((block, mark, skip))
                if mark and (not skip or skip.kind == "layout"):
                    mark.size += len(block)
                if skip:
                    skip.size += len(block)
            parts.clear()

    while at < n:
        tag = _TAG.search(source, at)
        if not tag:
            parts.append(source[at:])
            break
        if tag.start() > at:
            parts.append(source[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1]), tag[3] or ""
        if name in _RAW and not closing:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            continue
        if name in _BLOCKS or name in _DROPPED:
            end_block()
        elif name in _CELLS:
            parts.append(" ")
        is_mark = name in ("article", "main")
        if skip and skip.element in _SELF_CLOSED and (name in _BLOCKS or closing and name == skip.element):
            end_block()
            skip = None
            if closing and name in _SELF_CLOSED:
                continue
        if skip and name == skip.element:
            skip.open += -1 if closing else 1
            if not skip.open:
                end_block()
                skip.closed, skip = True, None
            continue
        if closing:
            if is_mark and marks:  # with it all that stood open inside it
                end_block()
                skip = marks.pop()[1]
            elif name == "body":
                skip = None
            continue
        if is_mark:
            if skip and (skip.kind == "foreign" or marks or _surrounding(name, attributes, bool(marks))):
                continue
            if not skip and (kind := _surrounding(name, attributes, bool(marks))):
                skip = _Skip(name, kind)
                continue
            marks.append((_Mark(skip if not marks else marks[0][0].within), skip))
            skip = None
        elif not skip and name not in _VOID and (kind := _surrounding(name, attributes, bool(marks))):
            end_block()
            skip = _Skip(name, kind)
    end_block()
    return _page(blocks)


def _page(blocks: list[tuple[str, _Mark | None, _Skip | None]]) -> Page:
    def own(mark: _Mark | None, skip: _Skip | None) -> bool:
        return mark is not None and (not skip or skip.kind == "layout" and 2 * skip.size > mark.size)

    if any(mark and not mark.within and own(mark, skip) for _, mark, skip in blocks):
        chosen = lambda mark: not mark.within
    else:
        inside = [m for _, m, skip in blocks if m and m.within and own(m, skip) and (m.within.kind == "layout" or not m.within.closed)]
        largest = max(inside, key=lambda m: m.size, default=None)
        chosen = lambda mark: mark is largest
    page = Page()
    for block, mark, skip in blocks:
        if own(mark, skip) and chosen(mark):
            page.marked = True
            page.article.append(block)
            continue
        if not mark and not skip:
            page.other.append(block)
        page.outside.extend(block.encode().split())
    return page


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def long_runs(tokens: list[bytes], long: int = LONG) -> np.ndarray:
    """A hash of each run of ``long`` tokens, in order: the suffixes, cut."""
    return run_hashes(word_hashes(tokens, 11), long).view(np.int64)


def short_tokens(tokens: list[bytes]) -> list[bytes]:
    return [t if len(t) <= TOKEN_BYTES else xxhash.xxh3_128_hexdigest(t).encode() for t in tokens]


def ordered_suffixes(streams: DataFrame, long: int = LONG) -> DataFrame:
    """(host, suffix, a, b): the distinct suffixes of all streams (host, page, outside) with their least and greatest page.

    In order inside partitions, which are ranges of host and the suffix's first ``long`` tokens.
    """
    depth = max(long, DEPTH)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages = batch.column(0), batch.column(1)
            tokens = [short_tokens(x.split()) for x in batch.column(2).to_pylist()]
            found = [[b" ".join(t[i : i + depth]) for i in range(len(t) - long + 1)] for t in tokens]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([hosts.take(at), pa.array([x for f in found for x in f], pa.binary()).cast(pa.string()), pages.take(at)], ["host", "suffix", "page"])

    rows = streams.select("host", "page", "outside").mapInArrow(cut, "host string, suffix string, page long")
    once = rows.groupBy("host", "suffix").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return once.repartitionByRange("host", F.substring_index("suffix", " ", long)).sortWithinPartitions("host", "suffix")


def common_tokens(one: list[bytes], other: list[bytes]) -> int:
    return next((i for i, (x, y) in enumerate(zip(one, other)) if x != y), min(len(one), len(other)))


def repeated_runs(streams: DataFrame, long: int = LONG) -> DataFrame:
    """(host, run): the beginnings of the intervals of a host's suffix order that come from more than one page."""

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, tokens, least, greatest = None, [], 0, 0
        for batch in batches:
            hosts, runs = [], []
            for h, suffix, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                now = suffix.encode().split(b" ")
                if h == host and common_tokens(tokens, now) >= long:
                    least, greatest = min(least, a), max(greatest, b)
                else:
                    if least < greatest:
                        hosts.append(host)
                        runs.append(tokens[:long])
                    least, greatest = a, b
                host, tokens = h, now
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([long_runs(r, long)[0] for r in runs], pa.int64())], ["host", "run"])
        if least < greatest:
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array(long_runs(tokens[:long], long))], ["host", "run"])

    return ordered_suffixes(streams, long).mapInArrow(intervals, "host string, run long")


def unique_blocks(blocks: list[str], tokens: list[bytes], repeated: set[int], long: int = LONG) -> list[str]:
    """Blocks without the tokens that lie in repeated runs of the page's tokens; blocks without a token left go."""
    place = 0
    covered = np.zeros(len(tokens) + 1, np.int64)
    for i, run in enumerate(long_runs(short_tokens(tokens), long).tolist()):
        if run in repeated:
            covered[i] += 1
            covered[i + long] -= 1
    gone = covered.cumsum() > 0
    out = []
    for block in blocks:
        words = block.encode().split()
        while tokens[place : place + len(words)] != words:  # skipped surroundings stand between the blocks
            place += 1
        if left := [w for w, c in zip(words, gone[place : place + len(words)]) if not c]:
            out.append(b" ".join(left).decode())
        place += len(words)
    return out


def main_text(pages: DataFrame, long: int = LONG) -> DataFrame:
    """page_id, url, text, n_chars, one row a row of ``pages``.

    Null and empty html give empty text. A null url is a host of its own name (the empty one). Repeated rows and
    page_ids stay rows of their own; whole pages are read, however long. Other columns are ignored whatever their names;
    an empty table gives an empty table.
    """
    given = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(h or "") for h in batch.column(3).to_pylist()]
            done = [p.marked or not p.other for p in found]
            streams = [b" ".join(p.outside) for p in found]
            whole = np.array([xxhash.xxh64_intdigest(x, 5) for x in streams], np.uint64).view(np.int64)
            columns = [
                pa.array(done, pa.bool_()), pa.array([p.text() for p in found], pa.string()), pa.array([host_of(u) for u in batch.column(2).to_pylist()], pa.string()),
                pa.array(whole), pa.array([None if d else np.unique(long_runs(short_tokens(p.outside), long)) for p, d in zip(found, done)], pa.list_(pa.int64())),
                pa.array([None if d else p.other for p, d in zip(found, done)], pa.list_(pa.string())), pa.array(streams, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["row", "page_id", "url", "done", "text", "host", "page", "runs", "other", "outside"])

    read = f"row long, page_id {kinds['page_id']}, url {kinds['url']}, done boolean, text string, host string, page long, runs array<long>, other array<string>, outside binary"
    # Every page is parsed once; what the host decides over is kept with it.
    found = stored(given.mapInArrow(parsed, read), "pages")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = ["\n".join(unique_blocks(other, outside.split(), set(r or ()), long)) for other, outside, r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    repeated = repeated_runs(found, long)
    rest = found.where("NOT done")
    answers = rest.select("row", "host", F.explode("runs").alias("run")).join(repeated, ["host", "run"]).groupBy("row").agg(F.collect_list("run").alias("repeated"))
    result = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    texts = rest.join(answers, "row", "left").select("page_id", "url", "other", "outside", "repeated").mapInArrow(decided, result)
    return found.where("done").select("page_id", "url", "text").unionByName(texts).withColumn("n_chars", F.char_length("text").cast("long"))
