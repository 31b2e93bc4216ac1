"""HTML extraction (2): main text by text-to-tag ratios.

The standard library's parser streams events; block-level tags end a line, and each line has its characters, the tags
met since the line before, and the container it is in. What is never text (scripts, buttons, ...) is left out piece by
piece, and lines in menus, footers, sidebars, forms and page headers, by their element or by their class, id or role, are
marked; a name alone is overruled where the element is around an article, or is nearly all of the page's text. The
logarithm of the ratio of text to tags is smoothed over the unmarked lines by a Gaussian; lines whose level is at least
half of the level that the page's text has on average are the content cluster, but for lists of links. The region is the
deepest container that holds nearly all of the cluster's text, or the article or main element around it; without such an
element, containers beside it that are mostly content belong to it as well. Its unmarked lines are the text, short ones
included, so that the ratio decides where the article is but drops nothing from it. A blockquote or details element is a
part of a text and never the region. Time is proportional to the page's length, whatever its depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
CONTAINER = frozenset("article blockquote body details div form header main section table td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never a page's text, wherever they stand.
UNSEEN = frozenset("audio button canvas head iframe label legend map math noscript object option script select style svg template textarea title video".split())
#: Parts of a page that are no part of its article, whatever they hold.
ASIDE = frozenset("aside dialog footer menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|alert|pager|pagination|popup|promo\w*|related|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Reader comments; an article inside them is no article of the page's.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Names that say what an element has or lacks, or that it is an article's own heading, count for nothing.
HAS = re.compile(r"(?:^|(?<=\s))(?:(?:no|not|has|have|with|without|is)[-_]\S+|(?:article|content|entry|post|story)[-_]+header(?=$|\s))", re.I)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: A start tag of the first kind ends an open element of the second, as browsers do.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"p", "li", "dt", "dd", "tr", "option"}}


class Lines(HTMLParser):
    """Collects lines: (text, tags since the line before, container, mark, characters in links).

    A mark is the number of the innermost marked element around the line, 0 for none; above_mark has the marked element
    around each, and final whether it is marked for good or only by what it is called. Elements that are never text,
    and inline elements called adverts and the like, are left out of a line where they stand.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, mark, text unseen
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.walls: list[int] = []  # where blocks and cells are open
        self.above, self.kinds = [-1], [""]  # of each container, the one around it, and its tag
        self.above_mark, self.final = [0], [False]
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.at = (0, 0)
        self.linked = self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def to_end(self, i: int) -> int:
        """The whole text is fed at once, so what isn't complete by its end never is: it is no text, and is read only once."""
        return len(self.rawdata) if i < 0 else i

    def parse_starttag(self, i: int) -> int:
        return self.to_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self.to_end(super().parse_endtag(i))

    def parse_html_declaration(self, i: int) -> int:
        return self.to_end(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self.to_end(super().parse_pi(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.to_end(super().parse_comment(i, report))

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text = []
            if line:
                self.lines.append((line, self.tags, *self.at, self.linked))
                self.tags = 0
            self.linked = 0

    def close_from(self, k: int) -> None:
        """Closes the open elements from place k on."""
        while len(self.open) > k:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        ends = ENDS.get(tag, ())
        while self.walls and self.open[self.walls[-1]][0] in ends:
            self.close_from(self.walls[-1])
        _, box, mark, unseen = self.open[-1]
        if not unseen:
            kind, unseen = self.judged(tag, attrs)
            if kind:
                self.end_line()
                self.above_mark.append(mark)
                self.final.append(kind == 2)
                mark = len(self.final) - 1
            if tag in ("article", "main") and not unseen:
                while mark and not self.final[mark]:  # what is around an article is no menu or advert
                    mark = self.above_mark[mark]
        if tag in CONTAINER:
            self.above.append(box)
            self.kinds.append(tag)
            box = len(self.above) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK or tag in ("td", "th"):
            self.walls.append(len(self.open))
        self.open.append((tag, box, mark, unseen))

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
        """(0, 1 if an element is called boilerplate, 2 if it is; whether its text is left out of the line it is in)."""
        if tag in ("body", "html"):
            return 0, False
        named, comments, unseen = False, False, tag in UNSEEN
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                value = HAS.sub("", value)
                named, comments = named or bool(NAMES.search(value)), comments or bool(COMMENTS.search(value))
            elif name == "role":
                named = named or value.lower() in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                unseen = True
        if unseen:
            return 0, True
        whole = any(self.places.get(t) for t in ("article", "main"))
        if tag in HEADINGS or tag == "header" and whole or self.places.get("pre") or self.places.get("code"):
            return 0, False  # an article's own headings; classes in program text say how it is coloured
        if tag in BLOCK or tag in ("td", "th"):
            return (2 if tag in ASIDE or comments and tag != "p" else int(named or comments or tag in ("form", "header"))), False
        return 0, named

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        elif tag in ("td", "th"):
            self.text.append(" ")
        k = self.places.get(tag)
        if k and (tag in BLOCK or not self.walls or self.walls[-1] <= k[-1]):  # an inline end tag doesn't close blocks
            if self.open[k[-1]][2] != self.open[-1][2] or self.open[k[-1]][2] != self.open[k[-1] - 1][2]:
                self.end_line()
            self.close_from(k[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        _, box, mark, unseen = self.open[-1]
        if unseen:
            return
        if not data.isspace():
            self.at = box, mark
            if self.places.get("a"):
                self.linked += len(data)
        self.text.append(data)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with a kernel cut at 3 sigma and divided by its weight at the borders."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[r:-r] / np.convolve(np.ones(len(x)), kernel)[r:-r]


def unmarked(p: Lines, share: float = 0.75) -> np.ndarray:
    """Which lines are no boilerplate. An element that is only called so, on a page without an article or main element,
    is the page itself if it has that share of the text that isn't boilerplate for good."""
    n = len(p.final)
    final = np.zeros(n, bool)
    for m in range(1, n):
        final[m] = p.final[m] or final[p.above_mark[m]]
    own = np.bincount([m for _, _, _, m, _ in p.lines], [len(t) for t, *_ in p.lines], n)
    total = own[~final].sum()
    articles = any(k in ("article", "main") for k in p.kinds)
    kept = np.zeros(n, bool)
    if not articles:
        for m in np.nonzero(~final & (own >= share * total))[0].tolist():
            while m and not kept[m]:
                kept[m], m = True, p.above_mark[m]
    gone = np.zeros(n, bool)
    for m in range(1, n):
        gone[m] = gone[p.above_mark[m]] or not kept[m]
    return ~gone[[m for _, _, _, m, _ in p.lines]]


def region_of(p: Lines, found: np.ndarray, share: float) -> tuple[int, bool]:
    """The content region by the cluster's text in each container, and whether it is an article or main element: the only
    one that holds half of that text or more, or the outermost one around the deepest container that holds that share of
    it; or else that container, or what is around it if it is a quotation."""
    n = len(p.above)
    around = [int(np.nonzero(found >= share * found[0])[0][-1])]
    while p.above[around[-1]] >= 0:
        around.append(p.above[around[-1]])
    for kind in ("article", "main"):
        within, tops = np.zeros(n, bool), []
        for b in range(1, n):
            within[b] = within[p.above[b]] or p.kinds[b] == kind
            if within[b] and not within[p.above[b]] and found[b]:
                tops.append(b)
        held = [b for b in around if p.kinds[b] == kind]
        if held or len(tops) == 1 and 2 * found[tops[0]] >= found[0]:
            return (held or tops)[-1], True
    return next(b for b in around if p.kinds[b] not in ("blockquote", "details")), False


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """Blocks of the main text joined by line feeds; "" for null, empty or markup without text."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    free = np.nonzero(unmarked(p))[0].tolist()
    if not free:
        return ""
    lines = [p.lines[i] for i in free]
    size = np.array([len(t) for t, *_ in lines], np.float64)
    prose = np.array([2 * linked <= len(t) for t, *_, linked in lines])
    level = smooth(np.log1p(size / np.maximum(1, [tags for _, tags, *_ in lines])), sigma)
    content = level >= (0.5 * (level @ size) / size.sum())
    if (content & prose).any():
        content &= prose
    n = len(p.above)
    box = np.array([b for _, _, b, _, _ in lines])
    found, every = np.bincount(box, size * content, n), np.bincount(box, size, n)
    for b in range(n - 1, 0, -1):  # a container's number is over those around it
        found[p.above[b]] += found[b]
        every[p.above[b]] += every[b]
    region, closed = region_of(p, found, share)
    inside = np.zeros(n, bool)
    inside[region] = True
    taken = np.zeros(len(lines), bool)
    if not closed:  # other parts that are mostly content, beside the region and beside what is around it
        around, b = {region}, region
        while p.above[b] >= 0:
            b = p.above[b]
            around.add(b)
        for b in range(1, n):
            if b not in around and p.above[b] in around and p.above[b] != region:
                inside[b] = 2 * found[b] >= every[b] > 0
        taken = content & np.isin(box, list(around))
    for b in range(1, n):
        inside[b] |= inside[p.above[b]]
    return "\n".join([t for (t, *_), ok in zip(lines, inside[box] | taken, strict=True) if ok])


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id and kept columns, text, n_chars) of every row, also of rows with a null or repeated id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "text", "n_chars"])

    rows = df.select(id_col, *keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_html").dtypes)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

#: The same rows by a plain reading of the test pages: what stands between an article's tags, cut at its blocks' tags.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' ') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda s: regexp_replace(s, '<[^>]*>', '', 'g')) AS l FROM a),
u AS (SELECT page_id, url, list_transform(l, lambda s: replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp', '&')) AS l FROM b),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(l, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> ''), chr(10)), '') AS text FROM u)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
