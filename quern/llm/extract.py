"""Main text of web pages by the distribution of line blocks (operator 1)."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: A comment, a declaration, or a tag: quotes may hold a ">"; where one is never closed, the tag ends at the first ">".
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")

# Elements of HTML by what they mean for the main text, and the names that pages give to what surrounds it.
RAW = frozenset("script style noscript template textarea title svg iframe object math select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
AROUND = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond disqus replies "
    "related recommended share sharing social toolbar pagination pager widget footer masthead skip".split()
)

#: Lines in a block, and the characters of a block at which the text surges; both as published for line-block methods.
WINDOW, SURGE = 3, 86
#: What a page's own marks are worth: a line in a main element counts so many characters more, and the characters of the
#: lines outside it, where a page has one with text, count a part only.
MARKED, OUTSIDE = SURGE, 4

def _surrounds(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds what surrounds an article rather than the article."""
    if tag in AROUND or (tag == "header" and not inside):
        return True
    if not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            words = set(_WORD.findall(value))
            if words & NAMES or (words & {"header"} and not inside):
                return True
        elif name == "role" and value in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def end_of_tags(page: str) -> int:
    """Where the last tag can end; looking no further keeps the search linear. An unclosed comment ends with the page."""
    closed = page.rfind(">") + 1
    return len(page) if page.find("<!--", page.rfind("-->") + 1) >= 0 else closed


GAP = ("", 0, False)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in a main element) of each line.

    Blocks end lines. Surrounding elements are left out and leave an empty line; where a main element begins or ends stand as
    many as a block has.
    """
    lines: list[tuple[str, int, bool]] = []
    held: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, surrounds, main
    depth = Counter()
    off = inside = in_link = 0

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((text, max(0, len(text) - linked), inside > 0))
        linked = 0

    def pop():
        nonlocal off, inside, in_link
        t, surrounds, main = stack.pop()
        if main:
            close()
            lines.extend([GAP] * WINDOW)
        depth[t] -= 1
        off -= surrounds
        inside -= main
        in_link -= t == "a"

    def text(piece: str):
        nonlocal linked
        if piece and not off:
            held.append(piece)
            if in_link:
                linked += len(piece)

    done, low, last = 0, None, end_of_tags(page)
    at = TAG.search(page, 0, last)
    while at:
        text(page[done : at.start()])
        done = at.end()
        tag = (at[2] or "").lower()
        if tag:
            if tag not in INLINE:
                close()
            if at[1]:
                if depth[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag in RAW:
                low = page.lower() if low is None else low
                end = low.find(f"</{tag}", done) if len(low) == len(page) else -1
                if end < 0:
                    m = re.compile(f"</{tag}", re.I).search(page, done)
                    end = m.start() if m else len(page)
                shut = page.find(">", end)
                done = len(page) if shut < 0 else shut + 1
            elif tag not in VOID and not at[3].endswith("/"):
                surrounds, main = _surrounds(tag, at[3], inside > 0), tag in MAIN or "role=\"main\"" in at[3]
                if surrounds and not off:
                    lines.append(GAP)
                if main:
                    lines.extend([GAP] * WINDOW)
                stack.append((tag, surrounds, main))
                depth[tag] += 1
                off += surrounds
                inside += main
                in_link += tag == "a"
        at = TAG.search(page, done, last)
    text(page[done:])
    close()
    return lines


def weights(lines: list[tuple[str, int, bool]]) -> list[int]:
    """What each line adds to its blocks: its characters outside links, changed by what the page itself marks as main."""
    if not any(main and text for text, _, main in lines):
        return [n for _, n, _ in lines]
    return [n + MARKED if main and text else n // OUTSIDE for text, n, main in lines]


def kept_lines(weight: list[int]) -> list[bool]:
    """Which lines lie between a surge and the dive after it.

    The text surges at a line with weight that lies in a block (WINDOW lines) of SURGE or more, and dives where a block of no
    weight begins, so short lines stay wherever the text has not ended.
    """
    n = len(weight)
    total, blocks = 0, []
    for i in range(n + WINDOW - 1):  # the block that ends at line i
        total += weight[i] if i < n else 0
        total -= weight[i - WINDOW] if i >= WINDOW else 0
        blocks.append(total)
    kept, on = [False] * n, False
    for i in range(n):
        on = bool(blocks[i + WINDOW - 1]) if on else weight[i] > 0 and max(blocks[i : i + WINDOW]) >= SURGE
        kept[i] = on
    return kept


def main_text(page: str | None) -> str:
    """The lines between surges and dives of the line-block distribution, joined by spaces.

    A page whose text never surges is one short text: all its lines that are more than links.
    """
    lines = lines_of(page or "")
    weight = weights(lines)
    kept = kept_lines(weight)
    if not any(kept):
        kept = [w > 0 for w in weight]
    return " ".join(text for (text, _, _), k in zip(lines, kept) if k and text)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, by the distribution of line blocks over the whole html.

    Null and empty pages give the empty text; null keys and addresses stay null; repeated rows are each extracted; broken
    markup never fails: unclosed elements end with their parent, a stray sign is text; extra columns are ignored; an empty
    table gives no rows. Time and memory are linear in the page.
    """

    def rows_of(columns):
        rows = []
        for key, url, page in zip(*columns):
            text = main_text(page)
            rows.append((key, url, text, len(text)))
        return rows

    return map_texts(pages.select(F.col("page_id"), F.col("url"), F.col("html")), rows_of, "page_id long, url string, text string, n_chars long", "page_id", "url", "html")
