"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block element. Menus, adverts, forms, comment sections
and the like are left out. Every other line weighs as much as its text outside links. Sums over
sliding windows of lines rise where the article begins (surge) and fall to nothing where it ends
(dive). The lines between the two points are kept.

Where the page marks an article or main part, windows do not reach across its edges, lines in it
weigh more, and its surge is found even if it is weak: the strongest window of a marked part is
one. Lines of links at its ends are cut off there, too. A few lines of links amid text are text.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import read

WINDOW = 3  #: lines added up
SURGE = 80  #: weight in a window that begins an article
MARKED = 16  #: how much more a letter weighs in a part that is marked as article

# Element names by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input label map menu nav noscript object "
    "option select svg template textarea title video audio".split()
)
ARTICLES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Parts of class names and ids that tell what an element is.
NAMES = re.compile(
    r"ad|ads|adv|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|"
    r"discussion|disclaimer|dialog|footer|form|gdpr|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|"
    r"notices?|notification|pagination|pager|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|signup|"
    r"skyscraper|social|sponsor\w*|subscribe|subscription|toolbar|topbar|widget"
)
#: Parts that may stand beside them; any other (has-sidebar, no-comments) makes it a different name.
BESIDE = frozenset(
    "area bar block bottom box button buttons container global icons inner item items link links list page primary "
    "section secondary site slot top unit wrap wrapper".split()
)
HEADERS = frozenset(("header", "pageheader", "siteheader", "heading"))
#: Elements that hold articles of their own; other unwanted ones that are never closed end where an article begins.
CLOSED = re.compile(r"comments?|commentlist|disqus|discussion|replies|reply|respond|nav|navbar|navigation|menu|menubar|related|sidebar")

# What the HTML standard says on end tags that may be left out.
NO_END = frozenset("body dd dt head html li optgroup option p tbody td tfoot th thead tr".split())
CLOSE_P = BLOCKS - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
SCOPE = ("button", "caption", "object", "table", "td", "th")
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IN_HEAD = frozenset("base bgsound head html link meta noscript script style template title".split())
SIBLINGS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",), "optgroup": ("option", "optgroup")} | dict.fromkeys(
    ("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot")
)

_PARTS = re.compile(
    r"""(?P<skip><!--.*?(?:-->|\Z)|<(?P<raw>script|style|noembed|noframes|xmp)\b(?>[^>"']|"[^"]*"|'[^']*')*+>"""
    r""".*?(?:</(?P=raw)\s*>|\Z)|<[!?](?:[^>]*+>|\Z))"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Line:
    text: str
    weight: int
    in_article: bool
    form: int = -1  #: the form it lies in


def _is_unwanted(token: str, names: re.Pattern, more: frozenset[str]) -> bool:
    parts = [x for x in re.split("[_-]+", token) if x]
    told = [bool(names.fullmatch(x)) or x in more for x in parts]
    return any(told) and all(t or x in BESIDE for t, x in zip(told, parts, strict=True))


def _unwanted(name: str, attrs: str, inside: bool) -> str:
    """How an element is known to hold something else than the article's text, or nothing.

    "open" is one that ends where an article begins if it is never closed.
    """
    if name in NEVER_TEXT and name != "form" or name == "header" and not inside:
        return "closed"
    if not attrs or name in ("html", "body"):
        return ""
    given: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attrs):
        given.setdefault(key.lower(), value.strip("\"'").lower())
    if given.get("hidden", "until-found") != "until-found" or given.get("aria-hidden") == "true":
        return "closed"
    if given.get("role") in ROLES and (name, given["role"]) != ("form", "form"):
        return "closed"
    tokens = f"{given.get('class', '')} {given.get('id', '')}".split()
    if name == "form":
        tokens = [x for x in tokens if x != "form"]
    found = [x for x in tokens if _is_unwanted(x, NAMES, frozenset() if inside else HEADERS)]
    if any(CLOSED.fullmatch(y) for x in found for y in re.split("[_-]+", x)):
        return "closed"
    return "open" if found else ""


def _ends(parts: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """For each start tag: which part ends its element, and whether that is its own end tag."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by name
    blocks: list[int] = []
    stops: list[int] = []  # elements through which no list item is closed

    def pop_to(k: int, i: int, own: bool = False) -> None:
        while len(stack) > k:
            name, start = stack.pop()
            for places in (at[name], blocks, stops):
                if places and places[-1] == len(stack):
                    places.pop()
            ends.setdefault(start, (i, own and len(stack) == k))

    def last(names: Iterable[str]) -> int:
        return max((at[x][-1] for x in names if at[x]), default=-1)

    for i, m in enumerate(parts):
        if m["skip"] is not None:
            continue
        if m["text"] is not None:
            if stack and stack[-1][0] == "head" and m["text"].strip():
                pop_to(len(stack) - 1, i)
            continue
        name = m["name"].lower()
        if m["end"]:
            k = last((name,))
            if k < 0 or name not in ARTICLES and name not in NO_END and k < last(x for x in SCOPE if x != name) and name not in SCOPE:
                continue
            if name == "p" and k < last(SCOPE):
                continue
            if name in FORMATS and blocks and blocks[-1] > k:
                at[name].pop()
                ends[stack[k][1]] = (i, True)
            else:
                pop_to(k, i, True)
            continue
        if at["head"] and name not in IN_HEAD:
            pop_to(at["head"][-1], i)
        if name in CLOSE_P and at["p"] and at["p"][-1] > last(SCOPE):
            pop_to(at["p"][-1], i)
        if name in ("li", "dd", "dt") and stops and stack[stops[-1]][0] in (("li",) if name == "li" else ("dd", "dt")):
            pop_to(stops[-1], i)
        elif name in SIBLINGS:
            group = [x for x in SIBLINGS[name] if at[x] and at[x][-1] > last(("table", "select"))]
            if name in ("tr", "thead", "tbody", "tfoot"):  # cells and rows that are still open end, too
                group = [x for x in ("td", "th", "tr", "thead", "tbody", "tfoot") if at[x] and at[x][-1] > last(("table",))]
                group = [x for x in group if name != "tr" or x in ("td", "th", "tr")]
            if group:
                pop_to(min(at[x][-1] for x in group), i)
        if name in VOID or m["attrs"].endswith("/"):
            continue
        at[name].append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
            if name not in ("address", "div", "p"):
                stops.append(len(stack))
        stack.append((name, i))
    pop_to(0, len(parts))
    return ends


def lines_of(page: str) -> list[Line]:
    """The text of each block, in page order, with its weight.

    A form's lines are left out unless they hold most of the text: some pages are one form.
    """
    out: list[Line] = []
    texts: list[str] = []
    parts = list(_PARTS.finditer(page))
    ends = _ends(parts)
    linked = link_depth = article_end = form_end = 0
    form = -1

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Line(text, max(0, len(text) - linked), inside, form))
            texts.clear()
        linked = 0

    inside = False
    i = -1
    while (i := i + 1) < len(parts):
        m = parts[i]
        if inside and i >= article_end or form >= 0 and i >= form_end:
            close()
            inside = inside and i < article_end
            form = form if i < form_end else -1
        if m["text"] is not None:
            texts.append(m["text"])
            if link_depth:
                linked += len(m["text"].strip())
            continue
        if m["skip"] is not None:
            continue
        name, tag_ends = m["name"].lower(), bool(m["end"])
        if name in BLOCKS or name in NEVER_TEXT and name not in ("label", "button", "input"):
            close()
        elif name == "br":
            texts.append(" ")
        if name == "a":
            link_depth = 0 if tag_ends else 1
        if tag_ends or i not in ends:
            continue
        how = _unwanted(name, m["attrs"], inside)
        end, own = ends[i]
        if how:
            if name not in FORMATS and name not in ("label", "button", "span"):
                close()
            if how == "open" and not own and name not in NO_END:  # an element that was never closed
                end = next((j for j in range(i + 1, end) if j in ends and parts[j]["name"].lower() in ARTICLES), end)
                own = False
            if name == "a":
                link_depth = 0
            i = end if own else end - 1
        elif name in ARTICLES:
            article_end = max(article_end, end) if inside else end
            inside = True
        elif name == "form" and form < 0:
            form, form_end = i, end
    close()
    total = sum(len(x.text) for x in out)
    held: Counter[int] = Counter()
    for x in out:
        held[x.form] += len(x.text)
    return [x for x in out if x.form < 0 or 2 * held[x.form] > total]


def text_ranges(weights: list[int], marked: bool, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Surge and dive points of a part of a page: ranges of lines.

    A range begins with a line of text whose window reaches the surge; a marked part may begin
    with a line of links, such as a linked title. It ends where windows are empty; at the end of
    a marked part, links that do not fill a window belong to it.
    """
    n, before = len(weights), [0, *accumulate(weights)]
    sums = [before[min(n, i + window)] - before[i] for i in range(n)]
    if marked:
        surge = min(surge, max(sums, default=0))
    found, start = [], -1
    for i, ahead in enumerate(sums):
        if start < 0 and ahead >= surge > 0 and (weights[i] or marked and not i):
            start = i
        elif start >= 0 and not ahead and (not marked or i + window <= n):
            found.append((start, i))
            start = -1
    return found if start < 0 else [*found, (start, n)]


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Lines between surge and dive points, joined by line breaks."""
    kept: list[str] = []
    for marked, part in groupby(lines_of(page), key=lambda x: x.in_article):
        lines = list(part)
        weights = [x.weight * MARKED if marked else x.weight for x in lines]
        for low, high in text_ranges(weights, marked, window, surge):
            kept += [x.text for x in lines[low:high]]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        sizes = arrow.longs([len(x) for x in texts])
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A NULL or empty page, or one without an article, has an empty text. Ids and addresses pass
    through, NULL too; repeated rows are extracted each; an empty table gives no rows; other
    columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


@query("op6_page_text")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages"))
