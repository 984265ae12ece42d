"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, in page order. Lines that belong to menus,
headers, footers, sidebars, notices, adverts, forms or comments have no weight, nor outside the article have
lines made of links where a whole window of lines is.
The weights are summed over sliding windows of lines; a sum that rises over the threshold is a surge, a
fall to zero is a dive, and the lines between a surge and its dive are text. The threshold is a share of the
median weight of a line, so one long paragraph does not raise it. Stripped parts are no lines and end no run. Windows run over the lines
of one rank (in an article, a main, a named element, none), so a part of another rank cuts no text in two.
The rank goes into the weights: a line of the highest rank weighs a surge more than its length, and a line
outside article and main weighs less the more of the page's text is of higher rank.

Where a page has an article, a main or a named text element, that rank's lines pass by their weight and the window sums decide about the other lines.

An element that a word of its class or id calls aside, and a form, may be the wrapper of the page: it is not aside if it holds the page's main, its
largest article or a heading of level 1 and a fifth of the text, nor, on a page with none of these, if it holds half of the text.
Foreign elements (svg and the like) without an end tag end at the next block.

Each page is read alone, in Arrow batches, in the tasks that scan it: no shuffle. The scan of a page is
linear in its length.

Defined results: null or empty html gives an empty text. Unclosed elements end with their parent; an
article, a main or a heading of level 1 ends an unclosed menu, header or notice. A link is an ``a`` with an
``href``; it ends with the block around it, and one without an end tag at the next block. ``br`` is white space.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import free_name, query, table

#: Element names and class words by their part in a page; fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split())
RAW = frozenset("script style template textarea iframe noembed noframes noscript svg canvas object audio video select title xmp".split())
ASIDE = frozenset("nav header footer aside form button dialog menu head input label fieldset".split())
#: Without an end tag these hide the rest of the page, the other raw elements what comes before the next block.
ENDLESS = frozenset("script style textarea title xmp".split())
#: Aside by their tag, but like elements named so they may be the wrapper of a page.
WRAPPERS = frozenset(["form"])
#: In an article these are not aside by a word of their class.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert announcement banner breadcrumb breadcrumbs captcha comment comments consent "
    "cookie cookies copyright dialog disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promoted recommendations recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
TEXT_WORDS = frozenset("article content entry main post story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
WORD = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*+=", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article only these are aside by a word of their id; others have slugs of their titles there.
BOXES = frozenset("div ul ol table".split())
BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS - {"title"})) + r")(?=[\s/>])", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def part_of(tag: str, attributes: str, article: bool = False) -> str:
    """What an element opens, here inside an ``article``: "aside", "named" (aside by a word), "text" or nothing."""
    if tag in WRAPPERS:
        return "named"
    if tag in ASIDE:
        return "aside"
    if attributes:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", "")):
            return "aside"
        words, marks = ({w.lower() for w in WORD.findall(CAMEL.sub(" ", named.get(x, "")))} for x in ("class", "id"))
        slug = tag in HEADINGS or article and (tag not in BOXES or "section" in words)
        aside = words if slug else words | marks
        words = words | marks
        if tag not in ("body", "html", "main", "article"):
            if named.get("role", "").lower() in ASIDE_ROLES:
                return "aside"
            if aside & ASIDE_WORDS and not (article and tag in TEXTUAL):
                return "named"
        if tag == "article" and words & {"comment", "comments", "reply", "ad", "advert", "promo", "sponsored", "related"}:
            return "aside"
        if named.get("role", "").lower() in ("main", "article") or named.get("itemprop", "") == "articleBody":
            return "text"
        if tag in ("div", "section", "td") and words & TEXT_WORDS:
            return "text"
    return ""


class Named:
    """An element that may be aside or a wrapper of the page, or an article: what is in it. Outer ones are made before inner ones."""

    def __init__(self, outer):
        self.outer, self.chars, self.core, self.aside = outer, 0, False, False


def raw_end(page: str, tag: str, attributes: str, at: int) -> int:
    """Where the text goes on behind a raw element that opens before ``at``."""
    if attributes.rstrip().endswith("/") and tag not in ("script", "style", "title"):
        return at
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
    if tag == "svg" and end and not re.compile("<foreignobject", re.IGNORECASE).search(page, at, end.start()):
        end = None if BLOCK_TAG.search(page, at, end.start()) else end
    if end or tag in ENDLESS:
        return end.end() if end else len(page)
    block = BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, aside, rank of the text element around: 3 article, 2 main, 1 named, 0 none)."""
    lines, buffer = [], []
    stack: list[tuple] = []  # tag, aside, rank, opened the aside, innermost named element, innermost article
    opened: Counter[str] = Counter()
    aside, rank, links, at = False, 0, 0, 0
    named, article, boxes, articles = None, None, [], []
    in_link, closed, depth = False, False, 0  # in a link, it has an end tag, elements around it
    last = page.rfind(">") + 1  # no tag ends behind

    def flush():
        nonlocal links
        if buffer:
            text = SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                lines.append((text, links, aside, rank, named))
                for x in (named, article):
                    if x and not aside:
                        x.chars += len(text)
            buffer.clear()
        links = 0

    def say(piece: str):
        nonlocal links
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if in_link:
                links += len(piece.strip())

    def restore():
        nonlocal aside, rank, named, article, in_link
        aside, rank, named, article = (stack[-1][1], stack[-1][2], *stack[-1][4:]) if stack else (False, 0, None, None)
        in_link = in_link and len(stack) >= depth

    def shut(k: int):
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        restore()

    while True:
        m = TOKEN.search(page, at, last) if at < last else None
        say(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in BLOCKS:
                in_link = in_link and closed
            if tag in BLOCKS or opened[tag]:
                if tag in BLOCKS or aside or named:
                    flush()
                if opened[tag]:
                    flush()
                    shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            at = raw_end(page, tag, m[3], at)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag == "a":
            in_link = HREF.search(m[3]) is not None
            if in_link:
                following = LINK.search(page, at)
                closed, depth = following is not None and bool(following[1]), len(stack)
        if tag in BLOCKS:
            flush()
            in_link = in_link and closed
            if stack and stack[-1][0] == "p":  # a block ends the paragraph before it
                shut(len(stack) - 1)
        if tag in ("article", "main", "h1", "body") and aside and any(opened[x] for x in ("nav", "header", "menu", "head")):
            for k, x in enumerate(stack):  # an unclosed menu or header ends here
                if x[3] and (x[0] in ("nav", "header", "menu", "head") and tag != "h1" or x[0] in ("nav", "head")):
                    shut(k)
                    break
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            if stack and stack[-1][0] == tag:
                shut(len(stack) - 1)
        if tag in VOID:
            continue
        kind = part_of(tag, m[3], rank == 3)
        heading = tag in ("h1", "h2") and aside and opened["article"] and next(x[0] for x in stack if x[3]) == "header"
        here = 3 if tag == "article" else 2 if tag == "main" else 1 if kind == "text" else 0
        if tag in ("main", "h1") and (heading or not aside) and kind != "aside" and named:
            named.core = True
        if tag in BLOCKS or kind or tag in ASIDE:
            if kind in ("aside", "named"):
                flush()
            inner, body = named, article
            if kind == "named":
                inner = Named(named)
                boxes.append(inner)
            if tag == "article" and not aside and kind != "aside":
                body = Named(inner)
                articles.append(body)
            stack.append((tag, (aside or kind == "aside") and not heading, max(rank, here), kind == "aside" and not aside, inner, body))
            opened[tag] += 1
            restore()
    flush()
    tell_wrappers(boxes, articles, sum(len(x[0]) for x in lines if not x[2]), CORE.search(page) is not None)
    return [(text, links, aside or named is not None and named.aside, rank) for text, links, aside, rank, named in lines]


CORE = re.compile(r"<(?:main|h1|article)(?=[\s/>])", re.IGNORECASE)


def tell_wrappers(boxes: list[Named], articles: list[Named], total: int, core: bool) -> None:
    """Settles which of the named elements are aside: those that wrap no page, and all within them."""
    largest = max(articles, key=lambda x: x.chars, default=None)
    if largest and largest.outer:
        largest.outer.core = True
    for x in reversed(boxes):
        if x.outer:
            x.outer.chars += x.chars
            x.outer.core |= x.core
    for x in boxes:
        wraps = x.core and 5 * x.chars >= total or not core and 2 * x.chars > total
        x.aside = not wraps or x.outer is not None and x.outer.aside


def between(weights: list[int], window: int, surge: float, dive: int = 0) -> list[bool]:
    """The lines between surge and dive points of the window sums."""
    n = len(weights)
    sums = [sum(weights[i:i + window]) for i in range(n)]
    keep, start = [False] * n, None
    for i in range(n + 1):
        if start is None and i < n and sums[i] >= surge and sums[i] > dive:
            start = i
            while start and weights[start - 1] > 0:
                start -= 1
        elif start is not None and (i == n or sums[i] <= dive):
            for k in range(start, i):
                keep[k] = weights[k] > 0
            start = None
    return keep


def made_of_links(lines: list[tuple[str, int]], window: int, share: float = 0.6) -> list[bool]:
    """The lines made of links in a window of lines that is, so a link between paragraphs is none."""
    n, made = len(lines), [False] * len(lines)
    width = max(1, min(window, n))
    for i in range(n - width + 1):
        part = lines[i:i + width]
        if sum(x[1] for x in part) > share * sum(len(x[0]) for x in part):
            for k in range(i, i + width):
                made[k] = made[k] or lines[k][1] > share * len(lines[k][0])
    return made


def main_text(page: str | None, window: int = 3, surge_share: float = 0.2) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    weighed = [not aside for _, _, aside, _ in lines]
    for level in range(3):
        own = [i for i, (_, _, aside, rank) in enumerate(lines) if rank == level and not aside]
        for i, made in zip(own, made_of_links([lines[i][:2] for i in own], window)):
            weighed[i] = not made
    chars = [0, 0, 0, 0]
    for (text, _, _, rank), ok in zip(lines, weighed):
        chars[rank] += len(text) if ok else 0
    if not any(chars):
        return ""
    top = max(rank for rank in range(4) if chars[rank])
    share = [1.0 if rank > 1 else 1 - sum(chars[rank + 1:]) / sum(chars) for rank in range(4)]
    ranks: dict[int, tuple[list[float], list[int]]] = {}
    for i, ((text, _, aside, rank), ok) in enumerate(zip(lines, weighed)):
        if not aside:
            weights, place = ranks.setdefault(rank, ([], []))
            weights.append(len(text) * share[rank] if ok else 0)
            place.append(i)
    surge = surge_share * median(w for weights, _ in ranks.values() for w in weights if w)
    chosen: list[int] = []
    for rank, (weights, place) in ranks.items():
        if rank and rank == top:
            weights = [w + surge if w else 0 for w in weights]
        chosen += [i for i, ok in zip(place, between(weights, window, surge)) if ok]
    return "\n\n".join(lines[i][0] for i in sorted(chosen))


def extract(pages: DataFrame, html: str = "html", window: int = 3, surge_share: float = 0.2) -> DataFrame:
    """The columns of ``pages``, then ``_text`` (under a free name where the pages have such a column)."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, window, surge_share) for x in column], dtype=object)

    return pages.withColumn(free_name(pages, "_text"), texts(F.col(html)))


@query("op2_html_line_blocks")
def op2_html_line_blocks(spark, sf_dir):
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("bigint").alias("n_chars"))
