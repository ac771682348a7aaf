"""Operator 9, main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. A line's weight is
its text length, nothing where most of it stands in links or inside page
furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments), which elements, roles, class names and ids tell; inline furniture is
cut out of its line. Lines of the article or main element with most text weigh
``mark`` times as much, and furniture inside it parts nothing; elsewhere
furniture between two lines of one container parts nothing. Weights are summed
over windows of following lines: where the sum rises from under the threshold
is a surge, where it has fallen back to nothing, or a mark begins or ends, a
dive. Stretches between surge and dive that hold the page's main mass are the
text, so that a marked teaser does not win over a long text without a mark. Of
stretches without a mark, short cells before the first heading or sentence and
copyright lines at the end are trimmed, and a main heading that only furniture
parts from its text is kept. Nothing else inside a stretch is left out.

Defined results: null and empty pages give an empty text, an empty table no row;
unclosed elements end with their parent; markup cut off at the end is dropped;
very long and deeply nested pages are read whole in linear time; repeated rows
give equal results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

# Fixed lists of element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas head title textarea select button audio video map".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements that hold lines of one text; only the other blocks are containers of their own.
FLOW = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li ol option p pre section summary table tbody tfoot thead title tr ul".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
#: A paragraph ends where one of these starts; a list item where the next one does, and so on.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Fixed words of class names and ids that tell page furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|widget|widgets|footer|foot|masthead|topbar|toolbar"
    r"|header|notice|notices|cookie|cookies|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|commentlist|disqus|replies|reply|respond|reader-comments|share|sharing|social|related|recommended|recommendations|pagination|pager|skip|form|search|toc)(?:$|[\s_-])"
)
#: A line that only tells who owns the page, and the marks that end a sentence.
OWNER = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)
SENTENCE = re.compile(r"[.!?:;…。！？]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that only look so: layouts that mention furniture, and headings of the article itself.
APART = re.compile(r"\b(?:no|has|with|without)[-_](?:\w+[-_])?(?:sidebar|menu|nav|header|footer|ads?|comments?)\b|\b(?:entry|post|article|content|story)[-_]?(?:header|heading)\b")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """One block of text: its text, the length of its linked part, and where it stands."""

    text: str
    linked: int
    furniture: bool
    main: int  # number of the article or main element it is in, or 0
    container: int  # number of the innermost container it is in, or 0
    tag: str  # the innermost block it is in


def furniture(name: str, attrs: str) -> bool:
    """Whether an element is page furniture by its name, role, class or id."""
    if name in FURNITURE:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and NAMES.search(APART.sub(" ", value)) and not (name == "article" and not re.search("comment|related|promo|teaser|sponsor|repl", value)):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def lines(page: str) -> list[Line]:
    """Strip the markup: the blocks of text in page order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, int, str, bool]] = []  # name, furniture, main element, container, block, hidden
    opened: dict[str, int] = {}
    buffer: list[str] = []
    hidden, bads, linked, links, mains, containers = 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            if text := SPACE.sub(" ", html.unescape("".join(buffer))).strip():
                out.append(Line(text, linked, bads > 0, *(stack[-1][2:5] if stack else (0, 0, ""))))
            buffer.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal hidden, links, bads
        for name, bad, *_, hides in stack[k:]:
            hidden -= hides
            bads -= bad
            links -= name == "a"
            opened[name] -= 1
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not hidden:
            piece = page[at:end]
            buffer.append(piece)
            linked += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        closing, attrs = m[1] or m[5], m[3] if m[2] else m[7]
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[k][0] == name:
                    if name in BLOCKS or any(x[0] in BLOCKS for x in stack[k:]):
                        flush()
                    close(k)
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name == "br":
            if not hidden:
                buffer.append("\n")
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS_P and opened.get("p"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            for k in range(len(stack) - 1, -1, -1) if any(opened.get(x) for x in CLOSED_BY.get(name, ())) else ():
                if stack[k][0] in CLOSED_BY[name]:
                    close(k)
                    if name != "tr":
                        break
                elif stack[k][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        if name in VOID or attrs.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:  # its content is no markup
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = stop.start() if stop else n
            at = stop
        bad = furniture(name, attrs) or name in HIDDEN
        up = stack[-1] if stack else ("", False, 0, 0, "", False)
        if name == "header" and up[2] and not bads:
            bad = False  # an article's own heading
        mains += (main := (name in ("article", "main") or ROLE_MAIN.search(attrs) is not None) and not bad)
        containers += (holds := name in BLOCKS and name not in FLOW)
        # inline furniture is cut out of its line; a block of it is a line of its own, without weight
        hides = name in HIDDEN or bad and name not in BLOCKS
        stack.append((name, bad, up[2] or mains * main, containers if holds else up[3], name if name in BLOCKS else up[4], hides))
        opened[name] = opened.get(name, 0) + 1
        hidden += hides
        bads += bad
        links += name == "a"
    flush()
    return out


def weights(rows: list[Line], mark: float) -> tuple[np.ndarray, np.ndarray]:
    """Each line's weight, and whether it is in the page's marked article: the one with most text."""
    size = np.array([len(r.text) for r in rows], float)
    off = np.array([r.furniture for r in rows])
    w = np.where(off | np.array([r.linked > 0.66 * len(r.text) for r in rows]), 0.0, size)
    mains = np.array([r.main for r in rows])
    told = np.zeros(len(rows), bool)
    if (own := w * (mains > 0)).any():
        told = mains == np.bincount(mains, own).argmax()
        w = np.where(told & ~off, mark * size, w)
    return w, told


def joined(rows: list[Line], told: np.ndarray, window: int) -> np.ndarray:
    """Positions of all lines but the furniture between two lines of one container or mark.

    Where the mark begins or ends stand ``window`` positions -1: lines of nothing.
    """
    out: list[int] = []
    between: list[int] = []
    last, inside = None, False
    for i, row in enumerate(rows):
        if row.furniture:
            between.append(i)
            continue
        here = "mark" if told[i] else row.container
        if here != last:
            out += between
        if told[i] != inside:
            out += [-1] * window
        between, last, inside = [], here, told[i]
        out.append(i)
    return np.array(out + between, np.int64)


def stretches(w: np.ndarray, window: int, least: float) -> list[tuple[int, int]]:
    """Surge to dive: [start, end) from where window sums rise over the threshold to where they are nothing."""
    if not w.any():
        return []
    total = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(len(w))
    sums = total[np.minimum(at + window, len(w))] - total[at]
    limit = min(least, 0.5 * sums.max())
    out, start = [], None
    for i in range(len(w)):
        if start is None and w[i] > 0 and sums[i] > limit:
            start = i
        elif start is not None and sums[i] <= 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(w)))
    return out


def trimmed(rows: list[Line], keep: list[int]) -> list[int]:
    """A stretch without a mark: short cells at its start and copyright lines at its end go, its main heading comes."""
    cell = lambda r: r.tag not in HEADINGS and r.tag not in ("p", "blockquote", "pre") and len(r.text) < 25 and not SENTENCE.search(r.text)
    a, b = 0, len(keep)
    while a < b and cell(rows[keep[a]]):
        a += 1
    a = a if a < b else 0
    while b > a + 1 and OWNER.match(rows[keep[b - 1]].text):
        b -= 1
    keep = keep[a:b]
    i = keep[0] - 1
    while i >= 0 and rows[i].furniture:
        i -= 1
    return [i, *keep] if i >= 0 and rows[i].tag == "h1" and not any(rows[k].tag == "h1" for k in keep) else keep


def main_text(page: str | None, window: int = 3, surge: float = 80.0, share: float = 0.25, mark: float = 32.0) -> str:
    """The lines between surges and dives, of all stretches with ``share`` of the largest's mass."""
    rows = lines(page or "")
    if not rows:
        return ""
    w, told = weights(rows, mark)
    at = joined(rows, told, window)
    heavy = np.where(at >= 0, w[at], 0.0)
    found = stretches(heavy, window, surge)
    mass = [heavy[a:b].sum() for a, b in found]
    keep: set[int] = set()
    for (a, b), s in zip(found, mass, strict=True):
        if s >= share * max(mass):
            own = [int(i) for i in at[a:b] if i >= 0 and not rows[i].furniture]
            keep |= {*(own if told[own[0]] else trimmed(rows, own))}
    return "\n".join(rows[i].text for i in sorted(keep))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", **options) -> DataFrame:
    """Rows (key, url, text, n_chars) of every page."""
    schema = StructType([pages.schema[key], pages.schema[url]]).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x, **options) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(key, url, page).mapInArrow(run, schema)
