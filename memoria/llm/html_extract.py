"""HTML extraction by nearest-URL page differencing."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names and the words in class, id and role that mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form button select menu dialog object canvas audio video head fieldset search".split())
RAW = "script|style|template|svg|iframe|noscript|textarea|title|math|xmp|noembed|noframes"
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription signup login comment comments disqus replies respond share sharing social related "
    "recommended footer header masthead popup modal overlay toolbar pagination pager widget skip hidden form search complementary contentinfo".split()
)
UNMARKED = frozenset("has with no without".split())
FRAMES = frozenset("div dl ol section ul".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Page:
    key: tuple
    host: str | None
    path: str
    lines: list[str] = field(default_factory=list)
    #: Of each line, whether it is inside an article or main element, and whether its markup says it is not the article.
    content: list[bool] = field(default_factory=list)
    chrome: list[bool] = field(default_factory=list)
    #: Of each line, the elements of FRAMES with attributes that hold it inside an article: a number, name and attributes.
    frames: list[tuple] = field(default_factory=list)


def _marked(attributes: str) -> bool:
    """Whether class, id, role or visibility say that an element is not part of the article."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                words = set(_WORD.findall(one))
                if words & MARKS and not words & UNMARKED:
                    return True
    return False


def parse(source: str | None, page: Page) -> Page:
    """Fill in a page's lines: one for each block that has text, references decoded, white space made one space."""
    source = source or ""
    # Open elements: name, marked as not the article (1 by its name, 2 by an attribute), and an article or main element.
    stack: list[list] = []
    frames: list[tuple] = []
    words: list[str] = []
    chrome = inside = 0

    def flush() -> None:
        if words:
            line = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if line:
                page.lines.append(line)
                page.content.append(inside > 0)
                page.chrome.append(chrome > 0)
                page.frames.append(tuple(frames))

    def close(n: int) -> None:
        nonlocal chrome, inside
        while len(stack) > n:
            _, mark, article, framed = stack.pop()
            chrome -= mark > 0
            inside -= article
            if framed:
                frames.pop()

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            words.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name == "br":
            words.append(" ")
            continue
        block = name in BLOCKS or name in CHROME
        if block:
            flush()
        if m[2] or m[5]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    close(n)
                    break
            continue
        if name in VOID:
            continue
        attributes = m[4] or m[7] or ""
        if block and stack and stack[-1][0] == "p" or name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        article = name in ("article", "main")
        if article:
            # A frame whose attributes merely mention a sidebar, and that holds the article, is no sidebar.
            for e in stack:
                if e[1] == 2:
                    e[1] = 0
                    chrome -= 1
        mark = 1 if name in CHROME or name == "header" and not inside else 2 if attributes and not article and name not in ("html", "body") and _marked(attributes) else 0
        if not attributes.rstrip().endswith("/") or block:
            framed = inside > 0 and name in FRAMES and bool(attributes.strip(" /"))
            if framed:
                frames.append((m.start(), name, " ".join(attributes.split())))
            stack.append([name, mark, article, framed])
            chrome += mark > 0
            inside += article
    if at < len(source):
        words.append(source[at:])
    flush()
    return page


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a a longest common subsequence with b takes. Rows of the table are bits of whole numbers; every
    s-th row is kept and the others are made again while tracing back, so memory is about sqrt(n) * m bits."""
    n, m = len(a), len(b)
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    mask = (1 << m) - 1

    def row(v: int, line: str) -> int:
        u = v & where.get(line, 0)
        return ((v + u) | (v - u)) & mask

    s = isqrt(n) + 1
    saved = [mask]
    v = mask
    for i in range(n):
        v = row(v, a[i])
        if (i + 1) % s == 0:
            saved.append(v)
    taken = [False] * n
    i, j = n, m
    rows: dict[int, int] = {}

    def at(i: int) -> int:
        if i not in rows:
            base = max(i - 1, 0) // s * s
            rows.clear()
            v = rows[base] = saved[base // s]
            for r in range(base, i):
                v = rows[r + 1] = row(v, a[r])
        return rows[i]

    while i and j:
        if at(i) >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if at(i) >> (j - 1) & 1:
            taken[i] = True
            j -= 1
    return taken


def _near(a: Page, b: Page) -> int:
    """How many characters of their paths two pages have in common at the start."""
    n = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        n += 1
    return n


def compared(page: Page, others: Iterable[Page | None], copies: float = 0.8) -> Iterator[tuple[Page, list[bool]]]:
    """The other pages of a page's host, the nearest first, each with which lines of this one are in it, in order. A page
    that has over `copies` of this one's lines, but for those that markup says are not the article, is a copy of it, which
    tells template and article apart no better, so it is left out."""
    asked = [p for p in others if p and page.host and p.host == page.host]
    for other in sorted(asked, key=lambda p: -_near(page, p)):
        taken = common_lines(page.lines, other.lines)
        own = [t for t, x in zip(taken, page.chrome, strict=True) if not x]
        if sum(own) <= copies * len(own):
            yield other, taken


def shared_lines(page: Page, before: Page | None, after: Page | None, copies: float = 0.8) -> list[bool]:
    """Which lines a page shares, in order, with the nearest page of its host that is no copy of it."""
    return next((taken for _, taken in compared(page, (before, after), copies)), [False] * len(page.lines))


def repeated_frames(page: Page, others: Iterable[Page | None]) -> list[bool]:
    """Which lines inside an article are template by the frame they are in: each line of it (but what markup says is not
    the article) is aligned with the two nearest pages that are no copies, and stands there in a frame alike. A passage
    that pages quote has their own words in its frame, or is in none, and stays."""
    near = list(islice(compared(page, others), 2)) if any(page.frames) else []
    if len(near) < 2:
        return [False] * len(page.lines)
    held = [{(line, f[-1][1:]) for line, f in zip(other.lines, other.frames, strict=True) if f} for other, _ in near]
    own: set[int] = set()
    for k, (line, f, x) in enumerate(zip(page.lines, page.frames, page.chrome, strict=True)):
        if f and not x and not all(taken[k] and (line, f[-1][1:]) in there for (_, taken), there in zip(near, held, strict=True)):
            own.update(at for at, *_ in f)
    return [bool(f) and f[-1][0] not in own for f in page.frames]


def article_text(page: Page, shared: list[bool], repeated: list[bool]) -> str:
    """The lines that stay: those of article or main elements, or of the whole page where it has none, without what
    markup says is not the article. Lines shared with the nearest page go; inside an article element, where two pages may
    rightly quote one passage, those of frames that the nearest pages repeat."""
    has = any(c and not x for c, x in zip(page.content, page.chrome, strict=True))
    rows = zip(page.lines, page.content, page.chrome, shared, repeated, strict=True)
    return "\n".join(line for line, c, x, s, r in rows if not x and (c and not r if has else not s))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id_col, url_col, text, n_chars, n_shared).

    Pages are range-partitioned and sorted by host, URL path and id, so a host with a third of all pages spreads over
    many tasks; each page is compared with its neighbours of the same host in its partition, the one whose path has
    most in common first. Their text lines are aligned by longest common subsequence; n_shared counts the lines that
    the alignment takes. Frames inside an article are compared with two of its four neighbours. See article_text for
    what stays.

    Null or empty html gives an empty text. A page with a null url, or one without a host, is compared with none; nor
    is a page alone in its partition. Repeated rows each give a row; an empty table gives none.
    """
    url = F.col(url_col).cast("string")
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
        F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    # At least some 200 pages to a partition, so that small tables keep neighbours together.
    n = max(1, min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.count() // 200))
    dealt = rows.repartitionByRange(n, "host", F.substring("path", 1, 200), "id").sortWithinPartitions("host", "path", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[Page]:
            for b in batches:
                ids, urls, *rest = b.columns
                for i, (source, host, path) in enumerate(zip(*(c.to_pylist() for c in rest), strict=True)):
                    yield parse(source, Page((ids.slice(i, 1), urls.slice(i, 1)), host, path or ""))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            ids, urls = (pa.concat_arrays([o[0][k] for o in out]) for k in (0, 1))
            texts = [o[1] for o in out]
            return pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                names=[id_col, url_col, "text", "n_chars", "n_shared"],
            )

        out: list[tuple] = []
        # Two pages on either side of the middle one.
        window: list[Page | None] = [None] * 5
        for after in chain(parsed(), (None, None)):
            window = [*window[1:], after]
            page = window[2]
            if page is not None:
                shared = shared_lines(page, window[1], window[3])
                repeated = repeated_frames(page, (window[1], window[3], window[0], window[4]))
                out.append((page.key, article_text(page, shared, repeated), sum(shared)))
                if len(out) >= 500:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long, n_shared long")
