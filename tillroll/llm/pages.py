"""Main text of web pages by nearest-URL page differencing.

1. A page is cut into lines: the text of each block element, white space folded, references decoded. A line is content
   if it lies in an article (or, without one, in ``main``), furniture if it lies in an element that never holds main
   text (menus, footers, forms, adverts, comments; by tag, role, class or id), and open otherwise. Within an article class
   and id count for less (see ``_marked_inside``).
2. Within each host the pages are ordered by URL path and each is paired with the next one; pages with the same lines
   count once. The lines of a pair outside articles are aligned by their longest common subsequence. Shared lines are
   the host's template. Two pages that share more than two thirds of their open lines are copies of each other,
   and these lines say nothing about the template.
3. The text of a page is its content lines or, if it has no article, its open lines without those of the template.

Pairing moves hashes of lines only, never pages: hosts are range-partitioned with their paths, so a host of any size is
spread over tasks. Template lines are sent to the tasks if they are few, else joined line by line. A null or empty page
has no text. A page whose URL has no host is not paired. Repeated pages count once in the pairing and each get their text;
an empty table gives an empty one; a column named like the new one is an error, others stay.
"""

from __future__ import annotations

import bisect
import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage
from tillroll.llm.text import added, slices, tidy, wider

#: Template lines (8 bytes each) that may be handed to every task.
HANDED = 1_000_000

# Elements of HTML by what they do to text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rb rt rp s samp"
    " small span strike strong sub sup time tt u var wbr img input nobr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math select object".split())
FURNITURE = frozenset("nav footer aside form menu dialog button head".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe subscription sidebar sidebars menu nav navbar navigation"
    " breadcrumb breadcrumbs comment comments reply replies disqus share sharing social related recommended footer header"
    " masthead widget widgets pagination pager login signup search skip contentinfo complementary".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)",  # a quote that never ends: up to the next bracket
    re.DOTALL,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^<>]*)")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_URL = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")

CONTENT, OPEN, FURNISHED, MAIN = 0, 1, 2, 3

#: Elements that hold an article's own text, whatever their class or id.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th figcaption section".split())


def _marked(attributes: str) -> bool:
    """Whether class, id or role name furniture."""
    return any(not MARKS.isdisjoint(_WORD.findall(name)) for name in _names(attributes))


def _names(attributes: str) -> list[str]:
    """The names in class, id and role, in lower case."""
    if "=" not in attributes:
        return []
    values = (next(x for x in (*found.groups(), "") if x is not None) for found in _NAMES.finditer(attributes))
    return [name for value in values for name in value.lower().split()]


def _marked_inside(tag: str, attributes: str) -> bool:
    """The same within an article, where a name is a vote among others.

    Only one that begins with a word for furniture counts (``comment-list``, not ``section-header``), a heading of the
    article's own is no menu, and elements of prose are text whatever they are called (``<h2 id="comment-on-x">``).
    """
    first = (_WORD.match(name) for name in _names(attributes))
    return tag not in PROSE and any(word and word.group() in MARKS - {"header"} for word in first)


def lines(page: str) -> list[tuple[int, str]]:
    """The lines of a page in order, each with what it is (content, open or furniture)."""
    found: list[list] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and 1 for furniture
    depth = inside = mains = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                what = FURNISHED if depth else CONTENT if inside else MAIN if mains else OPEN
                found.append([what, text])

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if not token:
            held.append(page[at:])
            break
        if token.start() > at:
            held.append(page[at : token.start()])
        at = token.end()
        part = token
        if not token.group(2) and token.group()[1] not in "!?":
            part = _LOOSE.match(token.group())
        tag = (part.group(2) or "").lower() if part.re is _LOOSE or token.group(2) else ""
        slash, attributes = (part.group(1), part.group(3)) if tag else ("", "")
        marked = _marked_inside(tag, attributes) if inside else _marked(attributes)
        if not tag or tag in INLINE and not marked:
            if tag and slash and stack and stack[-1][0] == tag:  # ends an inline element that is furniture
                flush()
                depth -= stack.pop()[1]
            continue
        flush()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for name, furniture in stack[i:]:
                        depth -= furniture
                        inside -= name == "article"
                        mains -= name == "main"
                    del stack[i:]
                    break
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            own = tag in ("html", "body", "main")
            furniture = not own and (tag in FURNITURE or tag == "header" and not inside or marked)
            stack.append((tag, int(furniture)))
            depth += furniture
            inside += tag == "article"
            mains += tag == "main"
    flush()
    article = any(what == CONTENT for what, _ in found)
    return [(what if what != MAIN else OPEN if article else CONTENT, text) for what, text in found]


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (lower case; empty if there is none) and path of a URL."""
    found = _URL.match(url or "")
    return (found.group(1).lower(), found.group(2)) if found else ("", "")


def line_key(what: int, text: str) -> int:
    """Hash of a line; the last bit says that it is open."""
    return xxhash.xxh64_intdigest(text) & ~1 | (what == OPEN)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """A longest common subsequence: the longest chain of matching places, after the equal ends are taken off."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = a[:head] + a[len(a) - tail :]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tops: list[int] = []
    links: list[tuple] = []
    for x in a:
        for j in places.get(x, ()):
            k = bisect.bisect_left(tops, j)
            link = (x, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    chain, link = [], links[-1] if links else None
    while link:
        chain.append(link[0])
        link = link[1]
    return ends + chain


def template_of(a: list[int], b: list[int]) -> list[int]:
    shared = shared_lines(a, b)
    n_open = sum(x & 1 for x in shared)
    copies = 3 * n_open > 2 * min(sum(x & 1 for x in a), sum(x & 1 for x in b))
    return [x for x in shared if not (copies and x & 1)]


def templates(pages: DataFrame) -> DataFrame:
    """host and line key of the lines that nearest pages of a host share."""
    spark = pages.sparkSession

    def outline(batches):
        for batch in slices(batches, 1):
            hosts, paths, keys = [], [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = url_parts(url)
                cut = lines(page) if host and page else []
                own = [line_key(what, text) for what, text in cut if what != CONTENT]
                if own:
                    hosts.append(host)
                    paths.append(path)
                    keys.append(np.array(own, np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(keys, pa.binary())],
                names=["host", "path", "keys"],
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    outlines = pages.select("url", "html").mapInArrow(tidy(outline), "host string, path string, keys binary")
    once = outlines.groupBy("host", "keys").agg(F.min("path").alias("path"))
    order = ("host", "path", "keys")

    def pair(batches):
        """Kind 0: a template line. Kind 1: the first and last page of the task, which meet those of its neighbours."""
        first = last = None
        for batch in batches:
            hosts, found = [], []
            columns = (batch.column(i).to_pylist() for i in (0, 2))
            for host, raw in zip(*columns, strict=True):
                own = (host, np.frombuffer(raw, np.uint64).tolist())
                if last and last[0] == host:
                    shared = template_of(last[1], own[1])
                    hosts += [host] * len(shared)
                    found += shared
                first, last = first or own, own
            yield rows(0, hosts, found, [b""] * len(found))
        if last:
            yield rows(1, [first[0], last[0]], [0, 0], [np.array(x[1], np.uint64).tobytes() for x in (first, last)])

    def rows(kind, hosts, found, keys):
        task = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(hosts), pa.int32()), pa.array([task] * len(hosts), pa.int32()),
             pa.array(hosts, pa.string()), pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(keys, pa.binary())],
            names=["kind", "task", "host", "key", "keys"],
        )

    ordered = once.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    paired = stage(ordered.mapInArrow(tidy(pair), "kind int, task int, host string, key long, keys binary"), "page-pairs")
    edges: dict[int, list] = {}
    for r in paired.filter("kind = 1").collect():  # two rows a task
        edges.setdefault(r.task, []).append((r.host, np.frombuffer(r.keys, np.uint64).tolist()))
    more, tasks = [], sorted(edges)
    for a, b in zip(tasks, tasks[1:], strict=False):
        (host, left), (other, right) = edges[a][1], edges[b][0]
        if host == other:
            more += [(host, int(np.uint64(k).astype(np.int64))) for k in template_of(left, right)]
    across = spark.createDataFrame(more, "host string, key long")
    return paired.filter("kind = 0").select("host", "key").union(across).distinct()


def _joint(host: str, key: int) -> int:
    return xxhash.xxh64_intdigest(host, seed=key & 0xFFFFFFFFFFFFFFFF)


def extract(pages: DataFrame, url: str = "url", column: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text of every page."""
    source = pages.select(F.col(url).alias("url"), F.col(column).alias("html"))
    # of the lines that pages share, only open ones can stand in a text
    template = stage(templates(source).filter(F.col("key").bitwiseAND(1) == 1), "templates")
    place = pages.columns.index(column)

    def texts(batch, known):
        found = []
        places = [batch.schema.get_field_index(x) for x in (url, column)]
        for i, (address, page) in enumerate(zip(*(batch.column(j).to_pylist() for j in places), strict=True)):
            cut = lines(page) if page else []
            if any(what == CONTENT for what, _ in cut):
                kept = [text for what, text in cut if what == CONTENT]
            else:
                host = url_parts(address)[0]
                kept = [text for what, text in cut if what == OPEN and not known(i, host, line_key(what, text))]
            found.append(" ".join(kept))
        return pa.array(found, pa.string())

    if template.count() <= HANDED:
        held = frozenset(_joint(r.host, r.key) for r in template.collect())

        def run(batches):
            for batch in slices(batches, place):
                yield added(batch, {name: texts(batch, lambda i, host, key: _joint(host, key) in held)})

        return pages.mapInArrow(tidy(run), wider(pages, **{name: "string"}))

    def open_lines(batches):
        for batch in slices(batches, 1):
            owners, hosts, keys = [], [], []
            for owner, address, page in zip(*(batch.column(i).to_pylist() for i in (2, 0, 1)), strict=True):
                cut = lines(page) if page else []
                if not any(what == CONTENT for what, _ in cut):
                    own = {line_key(what, text) for what, text in cut if what == OPEN}
                    owners += [owner] * len(own)
                    hosts += [url_parts(address)[0]] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(hosts, pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64))],
                names=["owner", "host", "key"],
            )

    # Line by line, so that no host's template is ever in one place; a page gets the template lines it has itself.
    owner = F.xxhash64("url", "html").alias("owner")
    each = source.select("url", "html", owner).mapInArrow(tidy(open_lines), "owner long, host string, key long").distinct()
    shared = each.join(template, ["host", "key"]).groupBy("owner").agg(F.collect_set("key").alias("keys"))
    row = F.struct(*[F.col(f"`{x}`") for x in pages.columns]).alias("row")
    joined = pages.select(row, F.xxhash64(F.col(url), F.col(column)).alias("owner")).join(shared, "owner", "left")

    def run_joined(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            sets = [{k & 0xFFFFFFFFFFFFFFFF for k in x or ()} for x in batch.column(1).to_pylist()]
            yield added(rows, {name: texts(rows, lambda i, host, key: key in sets[i])})

    return joined.select("row", "keys").mapInArrow(tidy(run_joined), wider(pages, **{name: "string"}))


def digest(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
