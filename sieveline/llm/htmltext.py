"""Main text of web pages, by nearest-URL page differencing and page structure.

A page is cut into text blocks, each with the kind of region that it stands in. Every page is differenced against the
pages with the nearest URL paths on its host: their lines are aligned by a longest common subsequence, and what two
neighbours share in the same order is the site's and not the page's. Structure weighs that evidence: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by their elements, roles and class
names, go in any case, and so does what stands beside a marked article; the lines of a marked article stay, as articles
quote the same passages. Shared lines that neither holds for are deleted.

Class names are words of a list. Outside an article one such word is enough; inside, a class must consist of them and of
words for containers, so that ``related-posts`` goes and ``related-work`` stays.

First, the pages' lines are hashed, range-partitioned by (host, path) and sorted, so that a page's neighbours are the
rows next to it and a host with a third of all pages still fills many tasks. Pages next to each other with equal lines are
one run; each run is compared to the run before and the run after it. The driver hands the hashes of the first two and
last two runs of each partition on, so that the runs at its edges have both neighbours too, however the pages are
partitioned. What is to be deleted is a table of line numbers, empty for most pages, and joined back to them: the pages
themselves are shuffled only if that table is large.

Defined results: a null or empty page has an empty text; a null url is a host of its own; a very long page is read
whole, in one task's memory; a page alone on its host has nothing to be differenced against; equal pages next to each
other are no evidence and share the nearest different ones; of equal paths the smaller id comes first; repeated rows are
returned each by itself; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import keep, written
from sieveline.llm.url_filters import split_url

_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", regex.S
)
_ATTRIBUTE = regex.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = regex.compile(r"\s+")
_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form script style noscript template button select textarea iframe object svg canvas video audio map dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rp rt".split())
#: Words of class, id and role that name what isn't the article; fixed values.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead toolbar pagination pager "
    "comment comments reply replies disqus discussion respond share sharing social related recommended newsletter subscribe subscription signup login search "
    "widget copyright contentinfo complementary skip".split()
)
#: Words of class names that say nothing beside one of those; fixed values.
CONTAINERS = frozenset("area bar block body bottom box button buttons container content form group icon icons inner item items left link links list main outer panel post posts right row section slot text title top unit wrap wrapper".split())
#: Headings in a header of the article are the article's.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a new one of the same kind ends.
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    region: str  # article, body or dropped


@dataclass
class Element:
    name: str
    region: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)

    @property
    def marked(self) -> bool:
        return any(b.region == "article" for b in self.blocks)


def _named(rest: str, inside: bool) -> bool:
    """Whether class, id or role name what isn't the article; ``inside`` an article a whole class must."""
    for m in _ATTRIBUTE.finditer(rest):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for token in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _WORD.findall(token)]
            if any(w in NAMED for w in words) and (not inside or all(w in NAMED or w in CONTAINERS for w in words)):
                return True
    return False


def blocks(text: str | None) -> Page:
    """The text blocks of a page, in order."""
    page, stack = Page(), [Element("", "body")]
    run: list[str] = []

    def close_block() -> None:
        said = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if said:
            page.blocks.append(Block(said, stack[-1].region))

    at, text = 0, text or ""
    while True:
        m = _TOKEN.search(text, at)
        plain = text[at : m.start() if m else len(text)]
        if plain:
            run.append(entities.unescape(plain))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if m["cdata"]:
            run.append(m["cdata"])
        if not name:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if name not in INLINE or stack[-1].region != stack[k - 1].region:
                        close_block()
                    del stack[k:]
                    break
            continue
        if name not in INLINE:
            close_block()
        elif stack[-1].region != "dropped" and _named(m["rest"], stack[-1].region == "article"):
            close_block()
        if name in VOID or m["rest"].endswith("/") and name not in RAW and name not in INLINE and name != "p":
            continue
        for end in range(len(stack) - 1, 0, -1):
            if stack[end].name in ENDS_ITSELF.get(name, ()):
                del stack[end:]
                break
            if stack[end].name in ("article", "main", "div", "section", "ul", "ol", "table", "body", "blockquote", "dl", "nav", "aside", "footer", "header", "form"):
                break
        region = stack[-1].region
        if name == "article" and region == "dropped" and stack[-1].name in ("nav", "header", "head", "ul", "li", "a"):
            # A menu that was never closed ends where the article begins.
            while stack[-1].region == "dropped":
                stack.pop()
            region = stack[-1].region
        if region != "dropped":
            if name in DROPPED or name == "header" or name not in ("html", "body", "main") and _named(m["rest"], region == "article" or name == "article"):
                region = "dropped"
            elif name == "article":
                region = "article"
        elif name in HEADINGS and stack[-1].name == "header" and any(e.region == "article" for e in stack):
            region = "article"
        stack.append(Element(name, region))
        if name in RAW:
            end = regex.compile(rf"</{name}\s*>", regex.I).search(text, at)
            at = end.end() if end else len(text)
            stack.pop()
    close_block()
    return page


#: Bits of the table of a longest common subsequence up to which it is held whole.
TABLE = 1 << 28


def _row(v: int, hit: int, full: int) -> int:
    u = v & hit
    return ((v + u) | (v - u)) & full


def _table(a: list, b: list) -> Iterator[int]:
    """A row for each start of ``b``, from none: bit i is zero where the i-th of ``a`` makes the subsequence longer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    yield v
    for y in b:
        v = _row(v, places.get(y, 0), full)
        yield v


def in_common(a: list, b: list) -> set[int]:
    """The places in ``a`` of one longest common subsequence."""
    there, here = set(b), set(a)
    at, b = [i for i, x in enumerate(a) if x in there], [y for y in b if y in here]
    a = [a[i] for i in at]
    if len(a) * len(b) > TABLE and len(a) > 1:  # the halves of ``a`` against the parts of ``b`` that are best for both
        half = len(a) // 2
        up = [half - v.bit_count() for v in _table(a[:half], b)]
        down = [len(a) - half - v.bit_count() for v in _table(a[half:][::-1], b[::-1])][::-1]
        cut = max(range(len(b) + 1), key=lambda j: up[j] + down[j])
        return {at[i] for i in in_common(a[:half], b[:cut])} | {at[half + i] for i in in_common(a[half:], b[cut:])}
    rows = list(_table(a, b))
    out, i, j = set(), len(a) - 1, len(b)
    while i >= 0 and j > 0:  # a zero bit is where the length grows
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(at[i])
            i -= 1
            j -= 1
    return out


def lines(page: Page) -> list[str]:
    """What is compared: all lines but those of dropped regions."""
    return [b.text for b in page.blocks if b.region != "dropped"]


def main_text(page: Page, shared: set[int] = frozenset()) -> str:
    """The lines of a marked article, or else all lines but the shared ones, given by their places."""
    if page.marked:
        return "\n".join(b.text for b in page.blocks if b.region == "article")
    return "\n".join(x for i, x in enumerate(lines(page)) if i not in shared)


def shared_lines(mine: list, neighbours: list[list]) -> set[int]:
    shared: set[int] = set()
    for theirs in neighbours:
        if theirs != mine:
            shared |= in_common(mine, theirs)
    return shared


#: (host, hashes of the lines) of a run of pages.
Run = tuple[str, list[int]]


def outer(edges: dict[int, list[Run]], at: int, back: bool) -> Run | None:
    """The nearest run with other lines beyond partition ``at``; edges: its first two and last two runs, or its only one."""
    parts = sorted((k for k in edges if (k < at if back else k > at)), reverse=back)
    mine = edges[at][0 if back else -1]
    for k in parts:
        runs = edges[k][::-1] if back else edges[k]
        for run in runs[:2]:
            if run[0] != mine[0]:
                return None
            if run != mine:
                return run
    return None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Run, list[tuple]]]:
    """Runs of pages (page_id, key) with one host and equal lines; of marked pages only the run is told."""
    run, pages = None, []
    for b in batches:
        for k in range(0, b.num_rows, 256):
            for host, _, page, key, said, marked in zip(*[c.to_pylist() for c in b.slice(k, 256).columns], strict=True):
                if (host, said) != run:
                    if run:
                        yield run, pages
                    run, pages = (host, said), []
                if not marked and (page, key) != (pages[-1] if pages else None):
                    pages.append((page, key))
    if run:
        yield run, pages


def _cuts(slim: DataFrame) -> DataFrame:
    """page_id, _key and the places of the shared lines of each page that isn't marked and has any."""
    from pyspark.sql.pandas.types import to_arrow_type

    ident, kind = slim.dtypes[0][1], to_arrow_type(slim.schema["page_id"].dataType)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                read = [blocks(x) for x in part.column(5).to_pylist()]
                said = pa.array([[xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines(p)] for p in read], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(0), part.column(4), said, pa.array([p.marked for p in read], pa.bool_())], names=["_host", "_path", "page_id", "_key", "said", "marked"])

    order = ("_host", "_path", "page_id", "_key")
    near = slim.mapInArrow(parse, f"_host string, _path string, page_id {ident}, _key long, said array<long>, marked boolean")
    # Kept, as both passes below must see the same partitions.
    near = keep(near.repartitionByRange(*order).sortWithinPartitions(*order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[Run] = []
        last: list[Run] = []
        for n, (run, _) in enumerate(_runs(batches)):
            if n < 2:
                first.append(run)
            last = [*last[-1:], run]
        runs = first if len(first) < 2 else first + last
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at] * len(runs), pa.int32()), pa.array(range(len(runs)), pa.int32()), pa.array([r[0] for r in runs], pa.string()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["at", "n", "host", "said"])

    edges: dict[int, list[Run]] = {}
    # Four rows a partition at most.
    for r in sorted(near.mapInArrow(ends, "at int, n int, host string, said array<long>").collect(), key=lambda r: (r["at"], r["n"])):
        edges.setdefault(r["at"], []).append((r["host"], list(r["said"])))
    beyond = near.sparkSession.sparkContext.broadcast({k: (outer(edges, k, True), outer(edges, k, False)) for k in edges})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before, after = beyond.value.get(TaskContext.get().partitionId(), (None, None))
        now = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"page_id": pa.array([x[0] for x in out], kind), "_key": pa.array([x[1] for x in out], pa.int64()), "shared": pa.array([x[2] for x in out], pa.list_(pa.int32()))})

        for nxt in chain(_runs(batches), [(after, [])]):
            if now:
                (site, said), here = now
                if here and (shared := sorted(shared_lines(said, [x[1] for x in (before, nxt[0]) if x and x[0] == site]))):
                    for page, key in here:
                        out.append((page, key, shared))
                        if len(out) >= 1000:
                            yield batch()
                            out = []
                before = now[0]
            now = nxt
        if out:
            yield batch()

    return near.mapInArrow(run, f"page_id {ident}, _key long, shared array<int>").dropDuplicates(["page_id", "_key"])


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    link, body = F.col(f"`{url}`"), F.col(f"`{html}`")
    host, path = split_url(link)
    slim = pages.select(F.col(f"`{page}`").alias("page_id"), link.alias("url"), host.alias("_host"), path.alias("_path"), F.xxhash64(link, body).alias("_key"), body.alias("_html"))
    # Written, so that its size is known: it is sent to all tasks if it is small.
    cuts = written(_cuts(slim)).select(F.col("page_id").alias("_p"), F.col("_key").alias("_k"), "shared")
    both = slim.join(cuts, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_key") == F.col("_k")), "left").select("page_id", "url", "_html", "shared")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                text = [main_text(blocks(x), frozenset(shared or ())) for x, shared in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(read, f"page_id {slim.dtypes[0][1]}, url string, text string")
