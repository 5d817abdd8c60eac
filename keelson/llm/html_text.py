"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element or line break).  A
division of the page (``DIVISIONS``) leaves ``GAP`` blank lines where it begins
and ends, so that text that stands apart on the page stands apart here; inside
a marked article none are left.  Elements that are silent, or that markup names
as a menu, header, footer, sidebar, notice, advert, form or reader comment,
leave no lines.  A line counts its text less twice that of its links; in a
marked article it counts all of it, and beside one an eighth.

Counts are summed over sliding windows of ``WINDOW`` lines.  A surge is a line
whose window holds ``SURGE``, or the greatest sum of a page that nowhere holds
as much; a dive is where a window sums to nothing.  The main text runs from the
first surge, and the lines that lead up to it without a blank, to the dive
behind the last surge.  Between them all lines stay, except lists of links.
So markup says what a line counts, and the distribution what is kept: an
unnamed advert, notice or footer is left out as it never surges.

Null, empty and text-free pages give an empty string.  Unclosed and crossed
tags, unclosed comments and bare ``<`` are tolerated, in time proportional to
the page.  Each page is read whole, by itself, in one narrow pass.  Ties can't
occur and repeated rows give repeated results; only the id, url and html
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_columns

#: Lines in a window, its least sum at a surge, blank lines between divisions, how much less a character counts beside a marked article.
WINDOW, SURGE, GAP, BESIDE = 3, 140, 3, 8

#: Elements whose content isn't text of the page (raw ones hold no markup), and those that aren't main text.
RAW = frozenset("script style textarea xmp".split())
SILENT = RAW | frozenset("noscript template svg math iframe object canvas audio video head select button".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DIVISIONS = frozenset("article aside body div footer form header main nav section".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
#: Elements whose end tag may be missing; a missing one must not swallow what follows.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of things beside the main text, the words that only say where or how they are laid out, and words of titles.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar aside widget widgets related recommended recommendations share sharing social menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments disqus respond reply replies discussion form search login copyright legal pagination pager skip toolbar topbar hidden".split()
)
LAYOUT = frozenset(
    "site page main global local primary secondary top bottom left right upper lower inner outer wide box block bar area list item items link links button buttons icon icons container wrapper wrap "
    "section group row column col panel pane slot unit holder region zone module component inline fixed sticky floating mobile desktop post posts article articles story stories blog web user users "
    "reader readers thread count more also like follow us text body content contents header head title message msg field fields input google".split()
)
#: Names that also decide as the last word behind any other.
STRONG = frozenset("ad ads advert adverts advertisement adsense banner popup modal overlay newsletter sidebar widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs masthead footer comments disqus pagination toolbar topbar".split())
TITLE_WORDS = frozenset("of the a an and or in on for to by with from as at is how what why".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

_open = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: What is left of a tag: quotes count behind an equals sign only, and only where they are closed.
_rest = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_modifier = re.compile(r"(has|have|with|without|no|not|is|show|hide)[-_]")
_joint = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_space = re.compile(r"\s+")


def _names_aside(token: str, in_article: bool) -> bool:
    """Whether a class or id names something beside the main text, and not a layout or a topic."""
    if _modifier.match(token.lower()):  # says something of the page's layout, not what the element is
        return False
    words = [w for w in _joint.split(token) if w]
    words = [w.lower().rstrip("0123456789") for w in words if not w.isdigit()]
    if not words or TITLE_WORDS & set(words):
        return False
    named = NAMES if in_article else NAMES | {"header"}
    return all(w in named or w in LAYOUT for w in words) and any(w in named for w in words) or words[-1] in STRONG


def _apart(tag: str, attributes: str, in_article: bool, named: bool = True, marked: bool = True) -> bool:
    """Whether an element is something beside the main text: by its tag if ``marked``, by names, roles and hiding if ``named``."""
    if tag in SILENT or tag == "form" or marked and (tag in ASIDE or tag == "header" and not in_article):
        return True
    if not attributes or not named or tag in ("html", "body", "main"):
        return False
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        # a heading's id names its topic
        if (name == "class" or name == "id" and tag not in HEADINGS) and any(_names_aside(token, in_article) for token in value.split()):
            return True
    return False


def lines_of(page: str, named: bool = True, marked: bool = True) -> list[tuple[str, int, bool, bool]]:
    """Lines of a page: text (none where blank), characters in links, whether in the article, a heading.

    Without ``named`` classes, ids and roles don't count; without ``marked`` neither do the
    tags of articles and of parts of a page.
    """
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, change of apart, article
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # tags that are not closed any more
    parts: list[str] = []
    linked = apart = article = 0
    link = muted = -1  # depth of the stack at which a link, or an inline element that is apart, was opened
    mute, nested = "", 0
    heading = loose = False

    def flush() -> None:
        nonlocal linked, heading
        if parts and not apart:
            text = _space.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, article > 0, heading))
        parts.clear()
        linked, heading = 0, False

    def divide(tag: str, change: int) -> None:
        # what is apart in the flow of the text doesn't divide it
        if tag in DIVISIONS and not article and not (change > 0 and tag == "div") and out and out[-1][0]:
            out.extend([("", 0, False, False)] * GAP)

    def leave(n: int) -> None:
        nonlocal apart, article, link, muted
        while len(stack) > n:
            tag, a, b = stack.pop()
            open_tags[tag] -= 1
            apart, article = apart - a, article - b
        link = -1 if link > n else link
        muted = -1 if muted > n else muted

    at = begin = 0
    while m := _open.search(page, at):
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            rest = None if loose or not m[3] else _rest.match(page, m.end())
            loose = loose or bool(m[3]) and rest is None  # from here on, a tag ends at the next sign
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                break  # no tag is closed any more: the rest is text
        if muted < 0 and m.start() > begin:
            parts.append(page[begin : m.start()])
            linked += (m.start() - begin) * (link >= 0)
        start, at = m.end(), end
        begin = at
        if not m[3]:
            continue
        tag, closing, attributes = m[3].lower(), bool(m[2]), page[start : end - 1]
        if tag in SILENT and not closing:
            if attributes.rstrip().endswith("/"):
                continue
            close = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if close:
                at = begin = close.end()
                continue
            endless.add(tag)
            if tag in RAW:
                begin = len(page)
                break
            if tag == "head":
                continue
        if tag in INLINE:
            if muted >= 0:
                if tag == mute and tag not in VOID:
                    nested += -1 if closing else 1
                    muted = muted if nested else -1
            elif tag == "a":
                link = -1 if closing else len(stack)
            elif not closing and tag not in VOID and attributes and _apart(tag, attributes, article > 0, named, marked):
                mute, nested, muted = tag, 1, len(stack)
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                change = stack[k][1]
                leave(k)
                divide(tag, change)
            continue
        if tag in LOOSE and stack and stack[-1][0] == tag:
            leave(len(stack) - 1)
        is_apart = _apart(tag, attributes, article > 0, named, marked)
        is_article = marked and tag in ("article", "main") and not is_apart
        heading = tag in HEADINGS
        change = -apart if marked and tag == "main" else int(is_apart)  # the main part isn't apart, whatever surrounds it
        divide(tag, change)
        stack.append((tag, change, is_article))
        open_tags[tag] += 1
        apart, article = apart + change, article + is_article
    if muted < 0 and begin < len(page):
        parts.append(page[begin:])
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between the first surge and the last dive, joined by one space."""
    if not page:
        return ""
    # an unclosed advert may swallow a page, and a page be named like a sidebar: then names don't count
    return kept(lines_of(page), window, surge) or kept(lines_of(page, named=False), window, surge)


def counts_of(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """How much each line counts; markup has no other say."""
    if any(inside for _, _, inside, _ in lines):
        return [len(text) if inside else max(0, len(text) - 2 * linked) // BESIDE for text, linked, inside, _ in lines]
    return [max(0, len(text) - 2 * linked) for text, linked, _, _ in lines]


def kept(lines: list[tuple[str, int, bool, bool]], window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page's lines."""
    counts, n = counts_of(lines), len(lines)
    before = [0, *accumulate(counts)]
    sums = [before[min(n, i + window)] - before[i] for i in range(n)]
    least = min(surge, max(sums, default=0))
    surges = [i for i in range(n) if counts[i] and sums[i] >= least]
    if not surges:
        return ""
    first, stop = surges[0], surges[-1]
    while first and lines[first - 1][0] and (counts[first - 1] or lines[first - 1][3]):
        first -= 1  # the lines that lead up to a surge belong to it
    while stop < n and sums[stop]:
        stop += 1
    while not counts[stop - 1]:
        stop -= 1
    out, i = [], first
    while i < stop:
        to = i
        while not counts[to]:
            to += 1
        # lines of links: a list of them is a menu, fewer belong to the text
        links = [text for text, *_ in lines[i:to] if text]
        out += links if len(links) < WINDOW else []
        out.append(lines[to][0])
        i = to + 1
    return " ".join(out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every page, by itself."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = src.schema["id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        texts = [main_text(h) for h in cols["html"]]
        return {"id": cols["id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_columns(src, f"id {kind}, url string, text string, n_chars bigint", run).withColumnRenamed("id", id_col)
