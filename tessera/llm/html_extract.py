"""Main text of web pages, by nearest-URL page differencing.

A page becomes lines, one for each block, menus and footers included. Every page is paired with the page of
its host whose URL path is nearest (of its two neighbours in path order, the one that shares more leading
path), and all lines of both are aligned by a longest common subsequence. Lines that the two share are the
template's and go, unless the markup vetoes it: a line within an article element stays, as a passage that two
articles share would be lost else. The markup also adds deletions: elements and roles for menus, page headers
and footers, sidebars, forms and dialogs, and containers whose class or id is just such a name, or that of a notice,
advert or comment list, go although only one page has them. All other lines are open, also beside an article, and
differencing decides on them. Names that only contain such a word, as `page-header` or `search-algorithms`,
delete nothing alone: their lines are suspect, which makes them go if either neighbour shares them and not only the nearest.

Pages of a host with the same lines are copies, not templates of each other: they pair as one page. Texts
never move for the pairing, only hashes of lines; pages are parsed once for these and once more for the text.

Defined results: null and empty html give an empty text with 0 characters; a null url belongs to the host
without name. A host's only page keeps its open lines. Pages that repeat give equal results. Lines that a page
repeats are aligned one by one. Very long pages are read whole: an alignment takes time in proportion to the
product of the numbers of lines over the bits of a machine word, and linear memory. Other columns of the input
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialise

#: Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is no line, and those whose lines are not main text.
NO_TEXT = frozenset("head script style noscript template svg canvas button select option textarea title iframe object audio video xmp noembed noframes datalist".split())
CHROME_ELEMENTS = frozenset("nav footer aside form dialog menu search".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "li", "dd", "dt", "title"}
#: Elements whose start ends an open one of these, within the nearest of the listed containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in class and id names that make lines outside articles suspect.
CHROME = re.compile(
    r"(?:^|[\s_-])(?<!with-)(?<!has-)(?<!no-)(?<!with_)(?<!has_)(?<!no_)(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|sidebar|comments?|commentlist|"
    r"replies|reply|disqus|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|popup|modal|overlay|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|topbar|"
    r"toolbar|widget|pagination|pager|skip|login|signup|search|disclaimer|copyright|tags|teaser)(?=$|[\s_-])",
    re.I,
)
#: What such names must say of an article to drop it: its other names tell how it looks.
NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|related|recommended|teaser)(?=$|[\s_-])", re.I)
#: Within an article only containers with one of these as a whole name are not main text.
CONTAINERS = frozenset("div section ul ol dl table details".split())
ARTICLE_CHROME = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo banner notice notices cookie-notice sidebar comment comments commentlist comment-list replies menu nav navigation footer newsletter".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


MAIN, OPEN, MARKED, SUSPECT = 0, 1, 2, 3


def _role(tag: str, attributes: str, in_article: bool) -> int:
    """What an element's own markup says of its lines: MARKED, SUSPECT or, of neither, OPEN."""
    if tag in CHROME_ELEMENTS or tag == "header" and not in_article:
        return MARKED
    if not attributes.strip() or tag in ("html", "body"):
        return OPEN
    found = OPEN
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.strip().lower() in CHROME_ROLES:
            return MARKED
        if name in ("class", "id"):
            if tag in CONTAINERS and not ARTICLE_CHROME.isdisjoint(value.lower().split()) or tag == "article" and NO_ARTICLE.search(value):
                return MARKED
            if not in_article and tag not in ("article", "main") and CHROME.search(value):
                found = SUSPECT
    return found


def parse(html: str | None) -> tuple[list[str], list[int]]:
    """Lines of a page, and of each whether it is in an article (MAIN), OPEN, SUSPECT, or MARKED as other than main text."""
    lines: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, kind of its lines, without lines
    count: dict[str, int] = {}  # open elements by name

    def cut(k: int) -> None:
        for x, *_ in stack[k:]:
            count[x] -= 1
        del stack[k:]

    def flush() -> None:
        if text:
            if line := _SPACE.sub(" ", entities.unescape("".join(text))).strip():
                lines.append(line)
                kinds.append(stack[-1][1] if stack else OPEN)
            text.clear()

    at, end, source = 0, len(html or ""), html or ""
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        kind, silent = stack[-1][1:] if stack else (OPEN, False)
        if not tag:
            if not silent and (source[m.start()] != "<" or m.end() == m.start() + 1):
                text.append(m[0])
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not silent:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                text.append(" ")
        if closing:
            if count.get(tag):
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID:
            continue
        if not silent:
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
            if tag in ENDS and any(count.get(x) for x in ENDS[tag][0]):
                ended, within = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in ended:
                        cut(k)
                        break
            kind, silent = stack[-1][1:] if stack else (OPEN, False)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else end
            if close:
                at = source.find(">", at) + 1 or end
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        role = OPEN if kind == MARKED or silent else _role(tag, attributes, kind == MAIN)
        silent = silent or tag in NO_TEXT or role == MARKED and tag not in BLOCKS
        if tag in BLOCKS or silent:
            if role == MARKED or kind == MARKED:
                kind = MARKED
            elif tag == "article":
                kind = MAIN
            elif role == SUSPECT and kind == OPEN:
                kind = SUSPECT
            stack.append((tag, kind, silent))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return lines, kinds


def _alignment(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """The bit vector of every prefix of a: the zeros among its first j bits count the common subsequence with b[:j]."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    whole = state = (1 << len(b)) - 1
    for x in a:
        hit = state & masks.get(x, 0)
        state = (state + hit | state - hit) & whole
        yield state


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with b[:j] for every j."""
    state = (1 << len(b)) - 1
    for state in _alignment(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate(([0], np.cumsum(bits == 0)))


#: Cells of an alignment whose bit vectors are held at once.
CELLS = 1 << 26


def common(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head, tail = list(range(low)), list(range(len(a) - high, len(a)))
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return head + tail
    if len(a) > 1 and len(a) * len(b) > CELLS:  # halve a, and cut b where both halves have most in common
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        middle = common(a[:half], b[:cut]) + [half + i for i in common(a[half:], b[cut:])]
    else:
        states, middle = list(_alignment(a, b)), []
        i, j = len(a), len(b)
        while i and j:
            if states[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or states[i - 1] >> j - 1 & 1:
                middle.append(i)
                j -= 1
        middle.reverse()
    return head + [low + i for i in middle] + tail


def shared_path(a: str, b: str) -> tuple[int, int]:
    """Leading path segments, then leading characters, that two paths share."""
    segments = next((k for k, (x, y) in enumerate(zip(a.split("/"), b.split("/"))) if x != y), min(a.count("/"), b.count("/")) + 1)
    characters = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return segments, characters


def _cut(own: dict, before: dict | None, after: dict | None) -> list[int]:
    """Open lines that a page shares with the nearer of its neighbours in path order (of a tie the one before), and suspect ones that it shares with either."""
    beside = [x for x in (before, after) if x and x["host"] == own["host"]]
    if not beside:
        return []
    beside.sort(key=lambda x: shared_path(x["path"], own["path"]), reverse=True)
    suspect = set(own["suspect"])
    found = set(common(own["hashes"], beside[0]["hashes"])).intersection(own["open"])
    if suspect and len(beside) > 1:
        found |= suspect.intersection(common(own["hashes"], beside[1]["hashes"]))
    return sorted(found)


def _shared_lines(pages: DataFrame) -> DataFrame:
    """Of distinct (host, digest) with path, line hashes and open lines: (host, digest, cut), the open lines to delete.

    Pages are sorted over all partitions by host and path, so neighbours follow each other within one; the two
    pages at a partition's ends, and their inner neighbours, are matched with those of the next one afterwards.
    """
    ordered = pages.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("host", pa.string()), ("digest", pa.int64()), ("cut", pa.list_(pa.int32())), ("page", _EDGE), ("inner", _EDGE)])
        before = own = None
        first = True
        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if own is not None:
                    out.append((part, 1, own["host"], own["digest"], None, own, after) if first else (part, 0, own["host"], own["digest"], _cut(own, before, after), None, None))
                    first = False
                before, own = own, after
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        if own is not None:  # the last page; a partition's only one is its first as well (edge 3)
            row = (part, 3 if first else 2, own["host"], own["digest"], None, own, before)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    page = "struct<host:string,digest:bigint,path:string,hashes:array<bigint>,open:array<int>,suspect:array<int>>"
    aligned = materialise(ordered.mapInArrow(align, f"part int, edge int, host string, digest long, cut array<int>, page {page}, inner {page}"), "aligned")
    # a row for each partition, so the numbering window is small; places follow each other where partitions may be empty
    ends = aligned.filter("edge > 0")
    places = ends.select("part").distinct().withColumn("k", F.row_number().over(Window.orderBy("part")))
    edges = ends.join(F.broadcast(places), "part").select("k", "edge", "page", "inner")
    lasts = edges.filter("edge in (2, 3)").select((F.col("k") + 1).alias("k"), F.col("page").alias("outer_before"))
    firsts = edges.filter("edge in (1, 3)").select((F.col("k") - 1).alias("k"), F.col("page").alias("outer_after"))
    met = edges.join(lasts, "k", "left").join(firsts, "k", "left").select("edge", "page", "inner", "outer_before", "outer_after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cuts = [_cut(r["page"], r["inner"] if r["edge"] == 2 else r["outer_before"], r["inner"] if r["edge"] == 1 else r["outer_after"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["page"]["host"] for r in rows], pa.string()), pa.array([r["page"]["digest"] for r in rows], pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], names=["host", "digest", "cut"])

    return aligned.filter("edge = 0").select("host", "digest", "cut").unionByName(met.mapInArrow(finish, "host string, digest long, cut array<int>"))


_EDGE = pa.struct([("host", pa.string()), ("digest", pa.int64()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("open", pa.list_(pa.int32())), ("suspect", pa.list_(pa.int32()))])
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
#: Pages with deletions up to which these are broadcast; more are joined by a shuffle, with salted keys.
MAX_BROADCAST_PAGES = 100_000
SALTS = 16


def decisions(pages: DataFrame) -> DataFrame:
    """(k1, k2, cut) of every page content that differencing takes lines from: the key of url and html, and the lines to delete."""
    bounded_batches(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    addressed = pages.select(*_key(), F.lower(F.regexp_extract(url, _URL, 1)).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t) for t in batch.column(4).to_pylist()]
            hashes = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines] for lines, _ in found]
            digests = [xxhash.xxh3_64_intdigest(np.array(h, np.int64).tobytes() + bytes(kinds)) - (1 << 63) for h, (_, kinds) in zip(hashes, found, strict=True)]
            is_open, suspect = ([[i for i, k in enumerate(kinds) if k in wanted] for _, kinds in found] for wanted in ((OPEN, SUSPECT), (SUSPECT,)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), *[pa.array(x, pa.list_(pa.int32())) for x in (is_open, suspect)]], names=["k1", "k2", "host", "path", "digest", "hashes", "open", "suspect"])

    hashed = materialise(addressed.mapInArrow(run, "k1 long, k2 long, host string, path string, digest long, hashes array<long>, open array<int>, suspect array<int>").filter(F.size("hashes") > 0), "hashes")
    distinct = hashed.groupBy("host", "digest").agg(F.min(F.struct("path", "hashes", "open", "suspect")).alias("f")).select("host", "digest", "f.path", "f.hashes", "f.open", "f.suspect")
    cuts = materialise(_shared_lines(distinct).filter(F.size("cut") > 0), "cuts")
    keys = hashed.filter(F.size("open") > 0).select("k1", "k2", "host", "digest").distinct()
    return keys.join(cuts, ["host", "digest"]).select("k1", "k2", "cut")


def _key() -> list:
    return [F.xxhash64("url", "html").alias("k1"), F.xxhash64("html", "url", F.lit(1)).alias("k2")]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    base = pages.select("page_id", "url", "html")
    kind = base.schema["page_id"].dataType.simpleString()
    cuts = materialise(decisions(base), "decisions")
    keyed = base.select("page_id", "url", "html", *_key())
    if cuts.limit(MAX_BROADCAST_PAGES + 1).count() <= MAX_BROADCAST_PAGES:
        joined = keyed.join(F.broadcast(cuts), ["k1", "k2"], "left")
    else:
        salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = set(cut or ())
                texts.append("\n".join(line for i, (line, kind) in enumerate(zip(*parse(html), strict=True)) if kind != MARKED and i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "cut").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
