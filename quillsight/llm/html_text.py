"""HTML extraction: pages are paired by URL path within a host, and lines that both share are deleted."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T

from .common import common_subsequence, materialize
from .url_filter import host_of, path_of

#: Elements that begin and end a line.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never main text.
_DROPPED = frozenset("aside button canvas datalist dialog footer form head header iframe input label math menu nav noscript object select svg template textarea title".split())
#: Elements whose content isn't markup.
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark such content in any element.
_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising alert banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo promoted promotion related replies reply "
    "respond share sharing sidebar sidenav skyscraper social sponsor sponsored subscribe taboola toolbar widget".split()
)
_ROLES = frozenset("banner complementary contentinfo navigation search alert dialog form menu menubar".split())
#: An open element that these begin is closed first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    article: bool
    dropped: bool


def _marked(attributes: str) -> bool:
    for name, *values in _MARK.findall(attributes):
        value = "".join(values).lower()
        words = _ROLES if name.lower() == "role" else _NAMES
        if any(part in words for token in value.split() for part in (token, *re.split(r"[-_]", token))):
            return True
    return False


def page_lines(page: str) -> list[Line]:
    """The page's blocks of text in order; dropped: in an element that is never main text; article: in article or main."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, article
    text: list[str] = []

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                lines.append(Line(line, stack[-1][2] if stack else False, stack[-1][1] if stack else False))

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        if (name := found[2]) is None:
            continue
        name = name.lower()
        if found[1]:
            if name in _BLOCK or name in _DROPPED:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and any(s[0] in _BLOCK or s[0] in _DROPPED for s in stack[depth:]):
                flush()
            if depth is not None:
                del stack[depth:]
            continue
        if name in _RAW:
            flush() if name in _BLOCK else None
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _BLOCK or name in _DROPPED:
            flush()
            if name in _CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select") or stack[i][0] in ("article", "main", "section", "div"):
                        break
                    if stack[i][0] in _CLOSES[name]:
                        del stack[i:]
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
        if found[3].rstrip().endswith("/") and name not in _BLOCK:
            continue
        dropped, article = stack[-1][1:] if stack else (False, False)
        within = article or name in ("article", "main")
        gone = dropped or name in _DROPPED or (name not in ("html", "body", "article", "main") and _marked(found[3]))
        if name in _BLOCK or gone != dropped or stack and stack[-1][0] in _DROPPED:
            if gone != dropped:
                flush()
        stack.append((name, gone, within))
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of both lists, in memory that is linear in them."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(line, len(numbers)) for line in lines], dtype=np.int64) for lines in (a, b))
    return set(np.flatnonzero(common_subsequence(x, y) >= 0).tolist())


#: Another page that has this share of an article's characters is a copy of it, and tells nothing about boilerplate.
COPIED = 0.5


def _body(lines: list[Line]) -> list[int]:
    """Positions of the lines that would be the main text without another page: those of the article if there is one."""
    own = [i for i, x in enumerate(lines) if not x.dropped]
    return [i for i in own if lines[i].article] or own


def body_hash(lines: list[Line]) -> int:
    """Pages of equal bodies are copies, whatever stands around them."""
    body = "\n".join(lines[i].text for i in _body(lines))
    return int.from_bytes(hashlib.md5(body.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def main_text(lines: list[Line], others: list[list[Line]]) -> tuple[str, int, int]:
    """Main text, lines shared with another page, and lines deleted.

    Lines in elements that are never main text go, and those outside of the article where there is one; of the others, those
    that the other page shares. The first of `others` serves, but none that shares half of an article's characters: copied articles aren't
    boilerplate.
    """
    body = _body(lines)
    article = any(lines[i].article for i in body)
    size = sum(len(lines[i].text) for i in body)
    shared: set[int] = set()
    for other in others:
        found = shared_lines([x.text for x in lines], [x.text for x in other])
        if not article or sum(len(lines[i].text) for i in body if i in found) < COPIED * size:
            shared = found
            break
    kept = [lines[i].text for i in body if i not in shared]
    return "\n".join(kept), len(shared), len(lines) - len(kept)


def _near(path: str, other: str) -> int:
    """Length of the path segments that both begin with, then of the characters."""
    same = next((i for i, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))
    return path[:same].count("/") * 1_000_000 + same


SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_shared", T.LongType()),
        T.StructField("n_deleted", T.LongType()),
    ]
)


def extract_text(pages: DataFrame, range_chars: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_deleted for every row of pages (page_id, url, html).

    Pages are sorted by host and URL path. Each is compared with the nearest page before and the nearest after it on its host whose
    body differs (copies tell nothing), first with the one whose path begins alike for longest (the one before if both do).
    Their lines are aligned by longest common subsequence. See main_text for what goes.

    1. Every page's key and hash of its body are written, range-sorted (into ranges of about range_chars of HTML), and the ends of each range are read: its first and last page, and
       the pages nearest to them with other bodies. From these the driver tells which pages of other ranges each range needs: two at most.
    2. The pages are dealt out by the same ranges with those neighbours (one shuffle, whatever the size of a host) and read in order.
       So the results don't depend on the ranges.

    Null html gives an empty text; null urls and those without :// share one empty host; a page alone on its host, or with copies
    only, is only cleaned of markup and of elements that are never main text; cut-off markup ends with the page; repeated rows stay;
    no rows give no rows; other columns are ignored.
    """
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("html").alias("tie"))
    bodies = materialize(keyed.select(*ORDER, "html").mapInArrow(_bodies, _BODIES), "page-bodies")
    size = bodies.agg(F.sum("size")).first()[0] or 0
    ends = bodies.repartitionByRange(size // range_chars + 1, *ORDER[:-1]).sortWithinPartitions(*ORDER).drop("size").mapInArrow(_ends, _ENDS).collect()
    ends.sort(key=lambda r: _key(r["first"]))
    cuts = [_key(r["first"])[:-1] for r in ends]
    needed: dict[tuple, list[int]] = defaultdict(list)
    for i in range(len(ends)):
        for side in (1, -1):
            page = _beyond(ends, i, side)
            if page is not None:
                needed[_key(page)].append(i)
    needed = dict(needed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, lent = [], [], []
            columns = [batch.column(c).to_pylist() for c in ORDER]
            for i, key in enumerate(map(_sortable, *columns)):
                own = max(0, bisect_right(cuts, key[:-1]) - 1)
                for part in (own, *needed.get(key, ())):
                    rows.append(i)
                    parts.append(part)
                    lent.append(part != own)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.int32()), pa.array(lent, pa.bool_())], names=[*batch.schema.names, "part", "lent"])

    dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("lent", T.BooleanType())]))
    return dealt.repartitionById(max(1, len(cuts)), F.col("part")).sortWithinPartitions("part", *ORDER).mapInArrow(_extract, SCHEMA)


#: Pages of equal host, path and id are kept together, and sorted by the hash of their HTML.
ORDER = ("host", "path", "page_id", "tie")
_PAGE = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("body", T.LongType())]
)
_BODIES = T.StructType([*_PAGE.fields, T.StructField("size", T.LongType())])
#: Of a sorted range: the first page, the first of another host or body than its; the last page, the last of another host or body.
_ENDS = T.StructType([T.StructField(c, _PAGE) for c in ("first", "second", "last", "before_last")])


def _sortable(host: str, path: str, page_id: int | None, tie: int) -> tuple:
    """A key that sorts as Spark does: a null id comes first."""
    return host, path, page_id is not None, page_id or 0, tie


def _key(page: Row) -> tuple:
    return _sortable(*page[:4])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(body_hash(page_lines(page)), len(page)) for page in (x.as_py() or "" for x in batch.column(4))]
        hashes, sizes = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], names=_BODIES.names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = second = last = before_last = None
    for batch in batches:
        for page in batch.to_pylist():
            run = page["host"], page["body"]
            if first is None:
                first = page
            elif second is None and run != (first["host"], first["body"]):
                second = page
            if last is not None and run != (last["host"], last["body"]):
                before_last = last
            last = page
    if first is not None:
        kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()), ("body", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x in (first, second, last, before_last)], names=_ENDS.names)


def _beyond(ends: list[Row], i: int, side: int) -> Row | None:
    """The page nearest to range i after (1) or before (-1) it that has another body than the page at its edge, on the same host."""
    edge, near, far = ("last", "first", "second") if side == 1 else ("first", "last", "before_last")
    page = ends[i][edge]
    j = i + side
    while 0 <= j < len(ends):
        for other in (ends[j][near], ends[j][far]):
            if other is not None and other["host"] != page["host"]:
                return None
            if other is not None and other["body"] != page["body"]:
                return other
        j += side
    return None


class _Page(NamedTuple):
    page_id: int | None
    url: str | None
    path: str
    lines: list[Line]
    lent: bool


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs() -> Iterator[tuple[tuple, list[_Page]]]:
        """Neighbouring pages of one part, host and body; equal pages share their lines."""
        run, held, of_html = None, [], {}
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "host", "path", "part", "lent")]
            for i in range(batch.num_rows):
                page_id, url, page, host, path, part, lent = (c[i].as_py() for c in columns)
                page = page or ""
                lines, body = of_html.get(page) or (None, None)
                if lines is None:
                    lines = page_lines(page)
                    body = body_hash(lines)
                if run != (part, host, body):
                    if held:
                        yield run, held
                    run, held, of_html = (part, host, body), [], {}
                of_html[page] = lines, body
                held.append(_Page(page_id, url, path, lines, lent))
        if held:
            yield run, held
        yield (), []

    def rows() -> Iterator[tuple]:
        before: list[_Page] = []
        (run, held), before_run = ((), []), ()
        for after_run, after in runs():
            near = [x for x, there in ((before[-1:], before_run), (after[:1], after_run)) if x and there[:2] == run[:2]]
            for now in held:
                if not now.lent:
                    others = sorted((x[0] for x in near), key=lambda x, now=now: -_near(now.path, x.path))
                    text, n_shared, n_deleted = main_text(now.lines, [x.lines for x in others])
                    yield now.page_id, now.url, text, len(text), n_shared, n_deleted
            before, before_run = held, run
            run, held = after_run, after

    chunk, size = [], 0
    for row in rows():
        chunk.append(row)
        size += len(row[2])
        if size > 4_000_000 or len(chunk) >= 5000:
            yield _batch(chunk)
            chunk, size = [], 0
    if chunk:
        yield _batch(chunk)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)
