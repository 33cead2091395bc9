"""Main text of web pages by the distribution of text over lines.

1. The markup is stripped: a block starts a line, inline tags leave no trace, scripts, styles and the like go with what is in
   them. Elements whose tag, role, class or id tells of menus, headers, footers, sidebars, notices, adverts, forms or
   reader comments count as markup too; inside the article a header keeps its headings.
2. Each line has a length: its characters outside links. Where the page marks its article (article, main, a role or a property
   that says so), lines outside it have length 0 and those inside count in full.
3. Lengths are summed over a sliding window of lines. The text surges where the sums leave zero on the way to a peak that is high
   enough, and dives where they come back to it; everything between the two is kept, however short. A peak is high enough with
   SURGE characters, or half of the page's highest; in a marked article any peak is.
4. Character references are decoded, white space inside a line becomes one space, lines are joined by line feeds.

Defined results
* null or empty html, a page without text: empty text; text outside of any element is a line like others;
* elements that are not closed end with what encloses them, an unclosed menu or advert before the article at the latest;
* references without a semicolon are decoded where HTML does so, others stay as they are; a cut-off tag at the end is dropped;
* white space is that of Unicode, no-break spaces among it;
* repeated rows: each its own; null page_id and url are carried; empty table: empty result;
* extra columns are ignored by ``page_texts`` and carried by ``with_text``, whatever their names (its result column's is replaced).
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship_package

#: Lines of a window, and characters in one that mark a surge.
WINDOW, SURGE = 3, 80

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>?|[^<]++|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is not markup and never shown.
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_NEVER = frozenset("applet audio button canvas datalist dialog embed form head menu nav noscript object select svg template video aside footer".split())
_SPACED = frozenset("br option td th".split())
#: Words of classes, ids and roles that tell what an element is for.
_ADVERT = frozenset("ad ads advert advertisement advertising adverts adsense adslot promo promoted promotion sponsor sponsored".split())
_ASIDE = _ADVERT | frozenset(
    "alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup recommended related search share sharebar sharing sidebar signup social subscribe subscription teaser "
    "toolbar topbar trending widget".split())
_NEGATED = frozenset("has is no not with without".split())
_WHOLE = frozenset("html body main".split())
_INLINE = frozenset("a abbr b cite code em font i img ins label mark small span strong sub sup time u".split())


def _attributes(tag: str) -> dict[str, str]:
    inner = tag[1:].rstrip(">").split(None, 1)
    if len(inner) < 2:
        return {}
    return {k.lower(): references.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(inner[1])}


def _purpose(attributes: dict[str, str]) -> set[str]:
    """Words that tell what an element is for; those said not to hold are left out."""
    out: set[str] = set()
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            words = [w.lower() for w in _WORD.findall(token)]
            out.update(w for i, w in enumerate(words) if i == 0 or words[i - 1] not in _NEGATED)
    return out


def _kind(name: str, tag: str) -> str:
    """What an element is: gone (with all in it), header, article, main or plain."""
    if name in _NEVER:
        return "gone"
    attributes = _attributes(tag) if "=" in tag or " hidden" in tag else {}
    if name not in _WHOLE and ("hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()):
        return "gone"
    words = _purpose(attributes)
    if name not in _WHOLE and name not in _HEADINGS:
        if words & (_ADVERT if name in _INLINE else _ASIDE - {"header"}):
            return "gone"
        if name == "header" or "header" in words and name not in _INLINE:
            return "header"
    if name == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return "article"
    if name == "main" or attributes.get("role") == "main":
        return "main"
    return "plain"


class _Page:
    """Tokens of a page: ``tokens`` are (name or None for text, text or kind, where the element ends); an end tag has no token of its own but a place."""

    def __init__(self, html: str):
        self.tokens: list[list] = []
        self.stack: list[tuple[str, list]] = []
        self.open: Counter = Counter()
        at = 0
        while at < len(html):
            m = _TOKEN.match(html, at)
            token, at = m.group(), m.end()
            if len(token) > 1 and token[0] == "<" and token[-1] != ">":  # a quotation mark that isn't closed
                at = html.find(">", at) + 1 or len(html)
                token = html[m.start():at]
            if token[0] != "<" or token == "<":
                self.tokens.append([None, token, 0])
            elif token[1] == "/":
                name = re.split(r"[\s/>]", token[2:], maxsplit=1)[0].lower()
                self.close(name)
                self.tokens.append([name, "end", 0])
            elif token[1] not in "!?" and token[-1] == ">":  # nothing of a tag that is cut off
                name = re.split(r"[\s/>]", token[1:], maxsplit=1)[0].lower()
                at = self.begin(name, token, html, at)
        while self.stack:
            self.pop(closed=False)

    def pop(self, closed: bool) -> None:
        name, token = self.stack.pop()
        self.open[name] -= 1
        token[2] = len(self.tokens) if closed else -len(self.tokens)

    def pop_to(self, name: str, closed: bool) -> None:
        while self.stack[-1][0] != name:
            self.pop(closed=False)
        self.pop(closed)

    def close(self, name: str) -> None:
        if not self.open[name]:
            return
        if name in _INLINE:  # an inline element doesn't reach over the end of a block
            for other, _ in reversed(self.stack):
                if other == name:
                    break
                if other in _BLOCKS:
                    return
        self.pop_to(name, closed=True)

    def begin(self, name: str, tag: str, html: str, at: int) -> int:
        if name in _BLOCKS and self.open["p"]:
            self.pop_to("p", closed=True)
        if name in ("li", "dt", "dd"):
            for other, _ in reversed(self.stack):
                if other in ("ul", "ol", "dl", "menu"):
                    break
                if other == name or name != "li" and other in ("dt", "dd"):
                    self.pop_to(other, closed=True)
                    break
        if name in _RAW:
            end = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            at = html.find(">", end.start()) + 1 if end else len(html)
            return at or len(html)
        token = [name, _kind(name, tag), len(self.tokens) + 1]
        self.tokens.append(token)
        if name not in _VOID:
            self.stack.append((name, token))
            self.open[name] += 1
        return at

    def ends(self) -> None:
        """Elements that go and were never closed end before the article at the latest."""
        marks = [i for i, t in enumerate(self.tokens) if t[1] in ("article", "main")]
        for i, t in enumerate(self.tokens):
            if t[0] is not None and t[2] < 0:
                t[2] = -t[2]
                if t[1] in ("gone", "header"):
                    t[2] = next((m for m in marks if i < m < t[2]), t[2])


def _lines(page: _Page) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in an article, in main) of each line; a line without text stands between blocks that hold others."""
    page.ends()
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = gone = header = heading = link = article = main = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, i <= article, i <= main))
        parts, linked = [], 0

    i = 0
    for i, (name, what, end) in enumerate(page.tokens):
        if name is None:
            if i >= gone and (i >= header or i < heading and (i < article or i < main)):
                text = references.unescape(what)
                parts.append(text)
                linked += len(text.strip()) if i < link else 0
            continue
        if name in _BLOCKS:
            flush()
            if name not in ("p", "li", "tr", "hr") and name not in _HEADINGS and i >= gone and out and out[-1][0]:
                out.append(("", 0, False, False))
        elif name in _SPACED:
            parts.append(" ")
        if what == "gone":
            gone = max(gone, end)
        elif what == "header":
            header = max(header, end)
        elif i >= gone:
            if what == "article":
                article = max(article, end)
            elif what == "main":
                main = max(main, end)
            elif what != "end" and name in _HEADINGS:
                heading = end
            elif what != "end" and name == "a":
                link = end
    i += 1
    flush()
    return out


def main_text(html: str | None) -> str:
    """The page's main text, a line per block."""
    if not html:
        return ""
    lines = _lines(_Page(html))
    for inside in (lambda x: x[2] and x[3], lambda x: x[2], lambda x: x[3]):
        if marked := any(inside(x) and x[0] for x in lines):
            lengths = [len(x[0]) if inside(x) else 0 for x in lines]
            break
    else:
        lengths = [max(0, len(x[0]) - x[1]) for x in lines]
    half = WINDOW // 2
    sums = [sum(lengths[max(0, i - half):i + half + 1]) for i in range(len(lines))]
    enough = 1 if marked else min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    surge = 0
    while surge < len(sums):
        dive = surge
        while dive < len(sums) and sums[dive]:
            dive += 1
        if dive > surge and max(sums[surge:dive]) >= enough:
            held = [i for i in range(surge, dive) if lengths[i]]
            kept += [x[0] for x in lines[held[0]:held[-1] + 1] if x[0]]
        surge = dive + 1
    return "\n".join(kept)


def page_texts(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text and n_chars (its code points)."""
    ship_package(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, "page_id long, url string, text string, n_chars long")


def with_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The pages with their main text in one more column."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != text], extracted(F.col(f"`{html}`")).alias(text))


#: What these pages mark as their article, block by block. Only tags and references that occur in them are known to it.
HTML_SQL = r"""
WITH article AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS a FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(a, '</?(h1|p)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS a FROM article),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(a, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS a FROM bare),
told AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM told
"""
