"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles, comments and other elements that never hold prose go with their content; block
elements end a line. So do parts that are no article (navigation, header, footer, sidebar, notice, advert, reader comments, told by element,
role, class or id) and fields of forms. A line's weight is its length; lines outside articles that are mostly links weigh nothing.
The weights are summed over windows of ``WINDOW`` lines. A surge is a window whose sum reaches the threshold, a dive one whose sum has
fallen to zero. The weighing lines between surge and dive are the text. The threshold is ``SURGE`` characters, or half the largest sum on
pages where no window reaches it.

The same sums tell what ``article``, ``main`` and like elements are worth. If the largest sum within them is at least ``BELIEVED`` of the largest one
elsewhere, their lines are raised to the weight of a surge, however short, and all others lowered to zero; else they are teasers, and
lengths alone decide. Likewise for forms: one whose windows surge and that holds at least half of the page's weight is a wrapper of
the page, any other is dropped.

* NULL or empty html, and pages without prose, give an empty text. Unclosed and misnested elements end with their parents. Nothing is
  dropped or cut by length, however long a page. Repeated rows are extracted alike. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
BELIEVED = 0.5
LINKED = 0.6

#: Elements that are dropped whole, even in an article.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option datalist button input textarea head "
                   "title nav menu dialog".split())
#: Captions of fields, dropped in forms.
FIELDS = frozenset("label legend optgroup output".split())
#: Elements that are no article unless an article element holds them (its own heading may be in a header).
AROUND = frozenset("header footer aside".split())
ARTICLE = frozenset("article main".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
#: An open paragraph ends at these; likewise a list item at the next one.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                   "section table ul".split())
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Whole names in class, id or role (also several joined by hyphens) that tell parts which are no article.
_PART = (r"(?:ad|ads|adv|advert|advertisement|adverts|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
         r"sidebar|side|widget|widgets|cookie|cookies|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|"
         r"recommended|comment|comments|reply|replies|disqus|footer|header|masthead|pagination|pager|toolbar|search|complementary|contentinfo|tags)")
BOILERPLATE = re.compile(rf"(?:^|\s){_PART}(?:[_-]{_PART})*(?:$|\s)", re.I)
#: Names that hold in an article as well: what readers and others add.
ADDED = re.compile(r"(?:^|\s)(?:ad|ads|advert|advertisement|sponsored|promo|related|recommended|comment|comments|comment-list|reply|replies|disqus)"
                   r"(?:[_-](?:area|body|form|item|list|section|thread|[0-9]+))*(?:$|\s)", re.I)
PROSE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[\s_-](?:body|content|text))?(?:$|\s)", re.I)

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"\s+")

#: Text, in an article element, in a part that is none, the same if an outermost article clears what holds it, number of the form (0 for none), characters in links.
Line = tuple[str, bool, bool, bool, int, int]
_OUTSIDE = (False, False, False, False, 0, False)


def lines_of(html: str) -> list[Line]:
    """Text lines of a page in order."""
    lines: list[Line] = []
    # Open elements: name, then silent, article, around, around if articles clear it, form, link (each inherited).
    stack: list[tuple] = []
    state = _OUTSIDE
    parts: list[str] = []
    linked = forms = 0

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", unescape("".join(parts))).strip()
            if text:
                lines.append((text, *state[1:5], linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal state
        del stack[to:]
        state = stack[-1][1:] if stack else _OUTSIDE

    for token in _TOKEN.finditer(html):
        kind = token.lastgroup
        if kind == "text":
            if not state[0]:
                text = token.group()
                parts.append(text)
                if state[5]:
                    linked += len(text)
        elif kind == "close":
            name = token.group("close").lower()
            if name not in INLINE:
                end_line()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    pop(at)
                    break
        elif token.group("open"):
            name, attributes = token.group("open").lower(), token.group("attributes")
            if name not in INLINE:
                end_line()
            if name in VOID:
                continue
            if name in ENDS_P:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == "p":
                        pop(at)
                        break
                    if stack[at][0] not in INLINE:
                        break
            elif name in _ALIKE:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in _ALIKE[name]:
                        pop(at)
                        break
                    if stack[at][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            silent, article, around, loose, form, link = state
            silent = silent or name in SILENT or (form > 0 and name in FIELDS)
            if name == "form":
                forms += 1
                form = forms
            nested, added, part, prose = article, False, False, False
            if attributes and not silent and name not in ("body", "html"):
                for key, *values in _ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), "".join(values)
                    if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                        silent = True
                    elif key in ("class", "id", "role") and not re.fullmatch(r"h[1-6]", name):
                        added, prose = added or bool(ADDED.search(value)), prose or bool(PROSE.search(value))
                        part = part or bool(BOILERPLATE.search(value))
            if name in ARTICLE:
                # Its own layout names tell nothing, but an article of readers is none; what holds the outermost one tells little.
                part, loose, article = added, loose and nested, True
            elif part:
                pass
            elif prose:
                article = True
            elif name in AROUND:
                part = name != "header" or not article
            around, loose = around or part, loose or part
            if attributes.endswith("/") and name not in INLINE and name not in ENDS_P:
                continue
            stack.append((name, silent, article, around, loose, form, link or name == "a"))
            state = stack[-1][1:]
    end_line()
    return lines


def window_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Sum of lines i to i + window - 1 at every i."""
    padded = np.concatenate([weights, np.zeros(window - 1, np.int64)])
    return np.lib.stride_tricks.sliding_window_view(padded, window).sum(axis=1)


def weighed(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> tuple[list[str], np.ndarray]:
    """Lines left after stripping, and what each counts in the sums."""
    article, strict, loose = (np.array([line[k] for line in lines], bool) for k in (1, 2, 3))
    # An article in what is no article counts where the page has no other.
    left = ~(strict if (article & ~strict).any() else loose)
    size = np.array([len(line[0]) for line in lines], np.int64)
    form = np.array([line[4] for line in lines], np.int64)
    for number in np.unique(form[form > 0]):
        held = size[left & (form == number)]
        if not len(held) or window_sums(held, window).max() < surge or 2 * held.sum() < size[left].sum():
            left &= form != number
    if not left.any():
        return [], size[:0]
    article, size, linked = article[left], size[left], np.array([line[5] for line in lines], np.int64)[left]
    prose = np.where(linked > LINKED * size, 0, size)
    framed = np.where(article, size, 0)
    within, beside = window_sums(framed, window).max(), window_sums(np.where(article, 0, prose), window).max()
    if within > 0 and within >= BELIEVED * beside:
        prose = np.where(article, np.maximum(size, surge), 0)
    return [line[0] for line, use in zip(lines, left) if use], prose


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(html or "")
    if not lines:
        return ""
    texts, weights = weighed(lines, window, surge)
    if not len(weights):
        return ""
    sums = window_sums(weights, window)
    threshold = min(surge, sums.max() / 2)
    kept, inside = [], False
    for i, text in enumerate(texts):
        if not inside and sums[i] > 0 and sums[i] >= threshold:
            inside = True
        elif inside and sums[i] == 0:
            inside = False
        if inside and weights[i]:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``pages`` with the main ``text`` of ``html``."""
    schema = pages.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[f.name for f in schema.fields])
    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(run, schema)
