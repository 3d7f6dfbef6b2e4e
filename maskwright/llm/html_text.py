"""Main text of web pages by composite text density.

A page becomes a DOM of block nodes (inline tags count as tags of their block).
What is never main text - navigation, forms, scripts, hidden parts - is left out of
all counts, and so are blocks whose class or id says advert, sidebar, notice, comments
and the like, unless they hold an article or, on a page without one, most of the text
outside of links.
Every node's density is its characters per tag, adjusted by
links: ``C/T * ln(C/LC * T/LT) / (1 + ln ln(LC*C/(C-LC) + C*LC_body/C_body + e))``
(C characters, T tags, LC and LT those in links; a zero divisor counts as 1). A
node's sum is that of its children's densities. The node of the greatest sum is
the heart of the page; the least density on its path to the body is the
threshold. The heart is taken with those branches beside its path that reach the
threshold; where the path passes an ``article`` or ``main``, branches within it need
not, unless links are a third of their characters, and beside it only further articles
count; where ``article`` and ``main`` have three tenths of the text outside of links, the
heart is in one of them. A branch of several links that have nine tenths of its characters is no content,
in the heart too.

A page is read in time linear in its length, whatever it holds: no regular expression
runs over an open quote or tag more than once, and open elements are found by kind.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# fixed values: names from the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
NEVER = frozenset("head nav aside footer form script style noscript template iframe object embed svg canvas math button select option textarea input dialog menu title link meta audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FOREIGN = frozenset(("svg", "math"))
#: Further elements that stand within a paragraph.
WITHIN = FOREIGN | frozenset("option button select object audio video canvas map picture output meter progress datalist slot template".split())
#: Elements that an opening tag of the same kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
#: Beyond these, no implied end is looked for.
WALLS = frozenset("html body table ul ol dl select article main section div".split())
#: A word of a class or id that says a block is not main text.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations"
    " comment comments commentlist disqus respond reply replies pagination pager toolbar widget widgets paywall".split()
)

#: Of these, the words that say so of a block of links only.
LINKS = frozenset("related recommended recommendations side".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_QUOTE = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never main text, whether its name alone says so, and whether that name holds for links only."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True, False, False
    if not attributes.strip():
        return False, False, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, False, False
    if found.get("role", "").lower() in ROLES:
        return True, False, False
    names = set(_NAME_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if tag in ("html", "body", "main"):
        return False, False, False
    if tag == "article":
        return bool(names & {"comment", "comments", "reply", "related", "promo", "ad", "sponsored"}), False, False
    return False, bool(names & CLUTTER), not names & (CLUTTER - LINKS)


def _tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; comments and declarations have no name. What has no end is text, comments last to the end."""
    at, n, quotes_end, no_more = 0, len(source), True, {"'": False, '"': False}
    while True:
        start = source.find("<", at)
        if start < 0 or start + 1 >= n:
            return
        mark = source[start + 1]
        if mark in "!?":
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if source.startswith(opening, start):
                    end = source.find(closing, start + len(opening))
                    at = n if end < 0 else end + len(closing)
                    break
            yield start, at, "", "", ""
            continue
        m = _TAG.match(source, start)
        if not m:
            at = start + 1
            continue
        end = m.end()
        while quotes_end:
            end = _TO_QUOTE.match(source, end).end()
            if end >= n or source[end] == ">":
                break
            mark = source[end]
            close = -1 if no_more[mark] else source.find(mark, end + 1)
            no_more[mark] = close < 0
            end = max(close, end) + 1
        if not quotes_end:
            end = source.find(">", end)
            if end < 0:
                return
        elif end >= n:  # with its quotes this tag never ends, so from here on quotes don't hide the end of a tag
            quotes_end, at = False, start
            continue
        yield start, end + 1, m.group(1), m.group(2).lower(), source[m.end() : end]
        at = end + 1


def density_of(chars: int, tags: int, link_chars: int, link_tags: int, whole: float) -> float:
    """Composite text density of a node; ``whole`` is the share of the page's characters that are in links."""
    if not chars:
        return 0.0
    inner = math.log(link_chars * chars / max(1, chars - link_chars) + chars * whole + math.e)
    return chars / (tags or 1) * max(0.0, math.log(chars / (link_chars or 1) * (tags or 1) / (link_tags or 1))) / (1 + math.log(inner))


class Page:
    """Nodes in the order of their start tags; node 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.named, self.weak = ["html"], [-1], [False], [False], [False]
        self.text: list[tuple[int, str]] = []  # (node, raw text or a space), in page order
        stack, where, walls = [0], {"html": [0]}, []  # open nodes; their places in the stack by kind; places of walls

        def close(place: int) -> None:
            while len(stack) > place:
                where[self.tag[stack.pop()]].pop()
            while walls and walls[-1] >= place:
                walls.pop()

        def last(names) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=0)

        at, resume = 0, 0
        for start, end, slash, name, attributes in _tokens(source):
            if start < resume:
                continue
            if start > at:
                self.text.append((stack[-1], source[at:start]))
            at = end
            if not name:
                continue
            if slash:
                place = last((name,))
                kept = name in INLINE and walls and walls[-1] > place or name not in WALLS | {"tr", "tbody", "thead", "td", "th"} and last(("td", "th")) > place
                if place and not kept:
                    close(place)
                continue
            if name in ("html", "body") and last((name,)):
                continue
            foreign = any(where.get(x) for x in FOREIGN)
            ends = () if foreign else ENDS.get(name) or ({"p"} if name not in INLINE and name not in VOID | RAW | WITHIN or name == "hr" else ())
            while (place := last(ends)) > (walls[-1] if walls else 0):
                close(place)
                if name not in ("tr", "tbody", "thead"):
                    break
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            drop, named, weak = _unwanted(name, attributes, bool(where.get("article") or where.get("main")))
            self.drop.append(drop)
            self.named.append(named)
            self.weak.append(weak)
            if name in ("br", "td", "th", "img", "wbr"):
                self.text.append((node, " " if name != "wbr" else ""))
            if name in VOID or attributes.endswith("/") and (foreign or name in FOREIGN):
                continue
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                at = resume = found.end() if found else len(source)  # all the rest belongs to what has no end, as it would in a browser
                continue
            where.setdefault(name, []).append(len(stack))
            if name in WALLS:
                walls.append(len(stack))
            stack.append(node)
        if at < len(source):
            self.text.append((stack[-1], source[at:]))

    def _left_out(self) -> list[bool]:
        """Nodes that are no main text, with all that they hold."""
        n = len(self.tag)
        article = [t in ("article", "main") and not d for t, d in zip(self.tag, self.drop, strict=True)]
        for i in range(n - 1, 0, -1):
            article[self.parent[i]] = article[self.parent[i]] or article[i]
        never, linked, plain, links = [False] * n, [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            # a wrapper that is dropped but holds an article is none
            never[i] = never[self.parent[i]] or self.drop[i] and not (article[i] and self.tag[i] not in ("article", "main"))
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for i, raw in self.text:
            if not never[i]:
                (links if linked[i] else plain)[i] += len(raw.strip())
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
            links[self.parent[i]] += links[i]
        gone = never
        for i in range(1, n):
            clutter = self.named[i] and not article[i] and (article[0] or plain[i] * 2 <= plain[0])
            gone[i] = gone[i] or gone[self.parent[i]] or clutter and not (self.weak[i] and plain[i] > 2 * links[i])
        return gone

    def main_text(self) -> str:
        n, gone = len(self.tag), self._left_out()
        block = [0] * n
        for i in range(1, n):
            block[i] = block[self.parent[i]] if self.tag[i] in INLINE else i
        chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
            if not gone[i]:
                tags[block[self.parent[i]]] += 1
                link_tags[block[self.parent[i]]] += self.tag[i] == "a"
        for i, raw in self.text:
            if not gone[i]:
                size = len(raw.strip())
                chars[block[i]] += size
                link_chars[block[i]] += size * linked[i]
        blocks = [i for i in range(n) if block[i] == i and not gone[i]]
        above = {i: block[self.parent[i]] for i in blocks if i}
        for i in reversed(blocks):
            if i:
                p = above[i]
                chars[p], tags[p], link_chars[p], link_tags[p] = chars[p] + chars[i], tags[p] + tags[i], link_chars[p] + link_chars[i], link_tags[p] + link_tags[i]
        whole = link_chars[0] / max(1, chars[0])
        density = {}
        for i in blocks:
            density[i] = density_of(chars[i], tags[i], link_chars[i], link_tags[i], whole)
        sums = dict.fromkeys(blocks, 0.0)
        for i in blocks:
            if i:
                sums[above[i]] += density[i]
        for i in blocks:
            sums[i] = sums[i] or density[i]  # a leaf stands for itself
        within = [False] * n
        for i in range(n):
            within[i] = self.tag[i] in ("article", "main") or i > 0 and within[self.parent[i]]
        tops = [i for i in blocks if within[i] and not (i and within[self.parent[i]])]
        told = sum(chars[i] - link_chars[i] for i in tops) * 10 >= 3 * (chars[0] - link_chars[0]) > 0
        heart = max((i for i in blocks if within[i] or not told), key=lambda i: (sums[i], chars[i]))
        path = [heart]
        while path[-1]:
            path.append(above[path[-1]])
        on_path = set(path)
        least = min((density[i] for i in path if i == heart or self.tag[i] != "html"), default=0.0)
        article = next((k for k in range(len(path) - 1, -1, -1) if self.tag[path[k]] in ("article", "main")), -1)
        eased = set(path[: article + 1])  # branches of these are within the article
        taken = {heart}
        for i in blocks:
            if i and above[i] in on_path and above[i] != heart and i not in on_path and density[i] > 0 and (article < 0 or above[i] in eased or self.tag[i] == "article"):
                if density[i] >= least or above[i] in eased and link_chars[i] * 3 <= chars[i]:
                    taken.add(i)
        for i in blocks:  # lists of links are no content, wherever they stand
            if link_tags[i] > 1 and link_chars[i] * 10 >= chars[i] * 9 and i not in on_path:
                gone[i] = True
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        loose = {i for i in path[1:] if i in eased}  # text that lies between the branches of the article
        inside = [False] * n
        for i in range(n):
            inside[i] = i in taken or (i > 0 and inside[self.parent[i]])
        for i in range(n):
            inside[i] = inside[i] or block[i] in loose
        out, now, parts = [], -1, []

        def end() -> None:
            line = _SPACE.sub(" ", "".join(parts)).strip()
            if line:
                out.append(line)
            parts.clear()

        for i, raw in self.text:
            if inside[i] and not gone[i]:
                if block[i] != now:
                    end()
                    now = block[i]
                parts.append(html.unescape(raw))
            elif not inside[i] or not gone[i] or self.tag[i] not in INLINE:
                end()
                now = -1
        end()
        return "\n".join(out)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source and not source.isspace() else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html has the empty text.

    Rows are independent of each other: repeated ones come out alike, an empty table
    gives no rows. Very long pages are read whole. Of nodes whose sums tie, the one
    with most characters is the heart, then the first. Further columns play no part.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
