"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped: scripts, styles, comments and tags go, and every block element ends a line. What stands in menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, by element name, role, class or id, keeps its line but loses its text. An element
without content is an empty line; what nested block tags leave between them isn't a line. Summing text lengths over a sliding window of lines
then gives a distribution that surges where the main text starts and dives where it ends. The text runs from the first surge to the last dive,
where something left out counts as one line, however many it holds. Articles and main elements are taken as a whole, without a threshold, if
they hold at least half of that text.

A header is left out only where it isn't the article's own. A class or id counts where all its words name boilerplate or a place on the page;
headings in an article are exempt, and so are its sections' ids but for reader comments. No class, id or form leaves out an element that holds
most of the articles' text or of the page's (beside an article, if that is long, as an advert may be longer than a short article); a thread
of comments may be longer than the article. White space inside a line becomes one space, lines are joined by one space, and
nothing between surge and dive is dropped. Null, empty and text-free pages give an empty text. Unclosed and misplaced tags are tolerated:
an end tag closes the nearest element of its name, if any, and text up to the end of a cut-off page counts. The work grows with the length of a page,
however its tags are nested. Repeated rows each get their own row; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, table

#: Lines of a window, and characters in it from which text surges on pages without an article.
WINDOW, SURGE = 3, 86

#: Characters from which most of a page's text isn't an advert, whatever its name, on pages with an article.
LONG = 10 * SURGE

# Elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
CELLS = frozenset("td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg math canvas object audio video".split())
HIDDEN = frozenset("nav footer aside head menu dialog button select noscript".split())
MAIN = frozenset(("article", "main"))
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
HIDDEN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted related replies "
    "reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)

HIDDEN_STEMS = ("advert", "breadcrumb", "commentform", "commentlist", "commentsection", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
#: Words that may stand beside a name of boilerplate in a class or id; with any other word it names something else, like related-work.
PLACES = frozenset(
    "a area background bar block bottom box btn button buttons center closed col column container content desktop div element fixed float form global google group icon icons id "
    "inline inner item items js label large layout leaderboard left link links list main medium message mobile nr open outer overlay page panel placeholder post posts primary "
    "rail right row secondary section sidebar site skyscraper slot small sticky sub tablet tags text title top unit ul web window wrap wrapper x zone".split()
)
#: Names of what readers add.
THREADS = frozenset("comment comments commentform commentlist commentsection disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A class like has-sidebar or content-with-ads says what stands beside the text.
BESIDE = frozenset("has no with without".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++|[\"'](?=[^>]*+>))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+")


def _named(value: str, names: frozenset[str] = HIDDEN_NAMES, stems: tuple[str, ...] = HIDDEN_STEMS) -> bool:
    """Whether a token of a class or id, as a whole, names boilerplate."""
    for token in value.split():
        words = WORD.findall(token)
        if BESIDE.isdisjoint(words):
            named = [w in names or w.startswith(stems) for w in words]
            if any(named) and all(n or w in PLACES for n, w in zip(named, words, strict=True)):
                return True
    return False


#: Why an element is left out: for what it is, or by its name or as a form, unless it holds the text; THREAD is a name of reader comments.
SHOWN, HARD, SOFT, THREAD = range(4)


def _hidden(name: str, attributes: str, in_main: bool) -> int:
    if name in HIDDEN or (name == "header" and not in_main):
        return HARD
    soft = SOFT if name == "form" else SHOWN
    if name in ("html", "body") or (name in MAIN and not in_main) or "=" not in attributes and "hidden" not in attributes:
        return soft
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value.strip() in HIDDEN_ROLES:
            # a role names a part of the page as form does
            if value.strip() != "form":
                return HARD
            soft = soft or SOFT
        if key == "aria-hidden" and value == "true":
            return HARD
        if key not in ("class", "id") or (in_main and (name in HEADINGS or value.strip() in ("header", "footer"))):
            continue
        if _named(value, THREADS, ("commentform", "commentlist", "commentsection")):
            soft = THREAD
        elif not (in_main and name == "section" and key == "id") and _named(value):
            soft = soft or SOFT
    return HARD if re.search(r"(?:^|\s)hidden(?:\s|$|=)", ATTRIBUTE.sub(lambda m: m[0] if m[1].lower() == "hidden" else "", attributes)) else soft


class Lines:
    """The lines of a page in order: their text, empty where it is left out, the numbers of the article and of the left out element they stand in, or 0."""

    def __init__(self, page: str, spared: frozenset[int] = frozenset()) -> None:
        """spared: where elements start that are kept whatever they are named."""
        self._count = [0, 0, 0, 0]  # open elements that leave their text out, by reason
        self.read = self.told = 0  # characters outside of what is left out for what it is, and those of them in articles
        self.named: list[list[int]] = []  # elements left out by name or as forms: start, why, and the two numbers for what they hold
        self.text: list[str] = []
        self.main: list[int] = []
        self.gone: list[int] = []
        self._open: list[tuple[str, int, int, list[int]]] = []
        self._at: dict[str, list[int]] = {}  # where the open elements of a name are, the last one last; likewise those that an inline end tag doesn't reach over, and those that none does
        self._blocks: list[int] = []
        self._bodies: list[int] = []
        self._parts: list[str] = []
        self._hidden = self._in = self._mains = self._gone = 0
        self._hid = False  # text of this line was left out
        at, low, opened = 0, None, ""
        for m in iter(lambda: TOKEN.search(page, at), None):
            self._take(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name in BLOCK:
                self._end_line(bool(m[1]) and name == opened)
                opened = "" if m[1] or name in RAW or name in CELLS else name
            if m[1]:
                self._close(name)
                continue
            if name in RAW and not m[3].endswith("/"):
                low = low or page.lower()
                end = low.find(f"</{name}", at) if len(low) == len(page) else next((e.start() for e in re.compile(f"</{re.escape(name)}", re.I).finditer(page, at)), -1)
                at = len(page) if end < 0 else end
                self._enter(name, SHOWN, self._in, [])
                self._count[SHOWN] += 1
            elif name not in VOID and not m[3].endswith("/"):
                why, own = _hidden(name, m[3], bool(self._in)), []
                if why in (SOFT, THREAD):
                    if m.start() in spared:
                        why = SHOWN
                    else:
                        self.named.append(own := [m.start(), why, -self.read, -self.told])
                self._gone += why != SHOWN and not self._hidden
                self._hidden += why != SHOWN
                self._count[why] += 1
                if name in MAIN and not self._count[HARD] and not self._count[THREAD] and not self._in:
                    self._mains += 1
                    self._in = self._mains
                    self._enter(name, why, -1, own)
                else:
                    self._enter(name, why, self._in, own)
        self._take(page[at:])
        self._end_line()
        self._leave(0)

    def _take(self, text: str) -> None:
        if not self._count[HARD] and (size := len(text.strip())):
            self.read += size
            self.told += size if self._in else 0
        if self._hidden:
            self._hid = self._hid or not text.isspace() and bool(text)
        else:
            self._parts.append(text)

    def _end_line(self, empty: bool = False) -> None:
        """A line ends here; without text it is one only if some was left out, or as an empty element."""
        text = " ".join(html_entities.unescape("".join(self._parts)).split())
        if text or self._hid or (empty and not self._hidden):
            self.text.append(text)
            self.main.append(self._in)
            self.gone.append(self._gone if self._hid and not text else 0)
        self._parts, self._hid = [], False

    def _enter(self, name: str, why: int, before: int, own: list[int]) -> None:
        at = len(self._open)
        self._at.setdefault(name, []).append(at)
        if name in BLOCK:
            self._blocks.append(at)
            if name in ("body", "html"):
                self._bodies.append(at)
        self._open.append((name, why, before, own))

    def _close(self, name: str) -> None:
        """Leave the nearest element of the name; an inline end tag doesn't reach over a block, nor any over the body."""
        bars = self._bodies if name in BLOCK else self._blocks
        if (at := self._at.get(name)) and not (bars and bars[-1] > at[-1]):
            self._leave(at[-1])

    def _leave(self, i: int) -> None:
        for name, why, before, own in self._open[i:]:
            self._at[name].pop()
            self._hidden -= why != SHOWN
            self._count[why] -= 1
            if own:
                own[2] += self.read
                own[3] += self.told
            if before == -1:
                self._in = 0
        del self._open[i:]
        for held in (self._blocks, self._bodies):
            while held and held[-1] >= i:
                held.pop()

    def misnamed(self) -> frozenset[int]:
        """Where elements start that were left out by name or as forms, but hold most of the articles' text or the page's; beside an article an advert may be the longer one."""
        least = {SOFT: LONG if self.told else 0, THREAD: self.read + 1 if self.told else 0}
        return frozenset(at for at, why, read, told in self.named if (2 * read > self.read and read >= least[why]) or (2 * told > self.told and why == SOFT))


def window_sums(lengths: list[int], width: int = WINDOW) -> list[int]:
    """The sum of lengths over the width lines from each line on."""
    sums, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + width] if i + width < len(lengths) else 0)
        sums[i] = total
    return sums


def stretches(lengths: list[int], surge: int, width: int = WINDOW, gone: list[int] | None = None) -> list[tuple[int, int]]:
    """Line ranges [start, end) from a surge, a window with enough text that begins with text, to a dive, the last text before a window without any.

    Lines with the same number other than 0 in gone are one line of the dive's window.
    """
    sums, found, start, end, gap = window_sums(lengths, width), [], None, 0, 0
    for i, length in enumerate(lengths):
        if start is None and sums[i] >= surge and length:
            start = i
        if start is None:
            continue
        if length:
            end, gap = i + 1, 0
        else:
            gap += not (gone and gone[i] and gone[i] == gone[i - 1])
            if gap == width:
                found.append((start, end))
                start = None
    return found + ([(start, end)] if start is not None else [])


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    lines = Lines(page)
    if spared := lines.misnamed():
        lines = Lines(page, spared)
    lengths = [len(t) for t in lines.text]
    found = stretches(lengths, min(SURGE, max([*window_sums(lengths), 1])), gone=lines.gone)
    kept = lines.text[found[0][0] : found[-1][1]] if found else []
    articles = [t for t, article in zip(lines.text, lines.main, strict=True) if article]
    if 2 * sum(map(len, articles)) >= sum(map(len, kept)):
        kept = articles
    return " ".join(t for t in kept if t)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: its id, url, text and n_chars (code points of the text)."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return one

    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
