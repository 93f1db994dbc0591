"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.

Pass one judges each block alone, by a sum of evidence. Its text counts once it is long enough to tell anything (``short_chars``): the density of stop words
speaks for it above ``stop_mid`` and against it below, and length speaks for it. Links speak against any block, by the share of its characters in them beyond
``free_links``. Where the block stands is prior evidence: against it inside a navigation, header, footer, sidebar, form, comment, notice or advert element, for it inside
the page's article or main element, and against it outside of one where a page has one; long prose or a list of links overturns any of these. A sum of ``margin`` or more is good, of -``margin`` or less is bad,
and what lies between is ambiguous. A short block or a heading is never good in this pass.

Pass two gives an ambiguous block the label of its nearest decided neighbours on its side of the article's edge: where both sides agree, theirs; where they differ, the nearer one's;
at like distance a heading takes the label of what follows, and another block that of the edge. The edges of an article count as good neighbours, those of a page
as bad ones; advertisements and the like inside an article say nothing of the text beside them and are no neighbours.

Character references are decoded, white space inside a block becomes one space, and blocks are joined in page order.
A page is read once from front to back, in time that grows with its length however malformed it is. Unclosed and stray tags are tolerated: a block-level tag ends the paragraph before it, an end tag closes what was opened after its
partner, and a tag or quoted value that never ends swallows the rest. Links are <a> with href; one that is left open ends with its block-level parent. Null and empty pages, and pages without main text, give an empty text. Repeated rows are read alike; any url may be null.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table
from .quality import STOP_WORDS

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends a tag, or opens a value in which nothing does.
TAG_END = re.compile(r">|=\s*([\"'])")
#: Elements whose content is no text of the page.
RAW = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in "script style noscript template textarea svg iframe title select".split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
HREF = re.compile(r"""(?:^|[\s"'])href\s*=""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand inside a block; every other tag ends one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end where their like begins.
ITEMS = frozenset("li dt dd td th tr option".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu fieldset".split())
MAIN = frozenset("article main".split())
#: Parts of class, id and role names that tell what an element is for: menus, headers, footers, sidebars, notices, adverts, forms and comments.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumb\w*|masthead|footer|sidebar\w*|aside|widget\w*|"
    r"comment\w*|disqus\w*|reply|replies|respond|newsletter|subscri\w*|signup|login|form|pagination|pager|toolbar|copyright|contentinfo|complementary|dialog|hidden)(?=$|[\s_-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.IGNORECASE)
STOPS = frozenset(STOP_WORDS)
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Params:
    short_chars: int = 70
    stop_mid: float = 0.1
    stop_weight: float = 12.0  # of the share of stop words above or below stop_mid, between -stop_most and stop_most
    stop_most: float = 2.5
    long_most: float = 2.0  # length counts by its doublings of short_chars
    free_links: float = 0.3
    link_weight: float = 6.0
    margin: float = 0.5
    # Prior evidence of elements, within the reach of what text and links can say (4.5 for a block, 5.4 and more against it).
    boilerplate: float = -4.4
    inside: float = 1.5
    outside: float = -3.0
    copyright: float = -3.0


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    boilerplate: bool
    main: bool
    heading: bool
    label: str = ""
    by: int = 0
    inherited: str = "bad"


@dataclass
class Open:
    tag: str
    boilerplate: bool
    main: bool


@dataclass
class Page:
    """Blocks of a page, filled tag by tag."""

    stack: list[Open] = field(default_factory=list)
    open_tags: Counter = field(default_factory=Counter)
    bad_depth: int = 0
    main_depth: int = 0
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    in_link: int = 0
    link_depth: int = 0  # how many elements were open when the link began
    heading: bool = False

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.in_link:
            self.links += len(raw.strip())

    def cut(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(text, self.links, self.bad_depth > 0, self.main_depth > 0, self.heading))
        self.parts, self.links = [], 0

    def push(self, tag: str, bad: bool, main: bool) -> None:
        self.stack.append(Open(tag, bad, main))
        self.open_tags[tag] += 1
        self.bad_depth += bad
        self.main_depth += main

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.in_link, self.link_depth = int(bool(HREF.search(attributes))), len(self.stack)
        elif self.in_link and tag in ITEMS and len(self.stack) == self.link_depth and self.stack and self.stack[-1].tag in ITEMS:
            self.in_link = 0
        if tag in INLINE and not attributes:
            return
        if tag not in INLINE:
            self.cut()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag == "p":
                self.close("p")
            if tag in VOID:
                return
        bad = self.ruled_out(tag, attributes)
        if tag in INLINE:
            if bad:
                self.cut()
                self.push(tag, True, False)
            return
        self.push(tag, bad, tag in MAIN and not bad)

    def ruled_out(self, tag: str, attributes: str) -> bool:
        """Whether the element is boilerplate. A header inside the article holds its title, and so does a heading whatever it is called."""
        bad = tag in BOILERPLATE and not (tag == "header" and self.main_depth)
        for name, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name in ("class", "id", "role"):
                bad |= tag not in ("html", "body") and bool(HINT.search(value) or HEADER.search(value) and not (self.main_depth or self.heading or tag in MAIN))
            else:
                bad |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
        return bad

    def close(self, tag: str) -> None:
        """End the innermost open element of that tag and what was opened in it; a p ends within its own container only."""
        if not self.open_tags[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.cut()
                if any(o.tag not in INLINE for o in self.stack[i : self.link_depth]):
                    self.in_link = 0
                for o in self.stack[i:]:
                    self.open_tags[o.tag] -= 1
                    self.bad_depth -= o.boilerplate
                    self.main_depth -= o.main
                del self.stack[i:]
                return
            if tag == "p" and self.stack[i].tag not in INLINE:
                return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag not in INLINE:
            self.cut()
            self.heading = False
        if tag not in VOID:
            self.close(tag)


def tag_end(source: str, at: int) -> int:
    """The place of the > that ends a tag, or -1; values in quotes may hold one."""
    while m := TAG_END.search(source, at):
        if m[0] == ">":
            return m.start()
        at = source.find(m[1], m.end()) + 1
        if not at:
            return -1
    return -1


def blocks(source: str) -> list[Block]:
    page, at = Page(), 0
    while at < len(source):
        i = source.find("<", at)
        if i < 0:
            page.text(source[at:])
            break
        m = NAME.match(source, i + 1)
        if not m and source[i + 1 : i + 2] not in ("!", "?"):
            page.text(source[at : i + 1])
            at = i + 1
            continue
        if i > at:
            page.text(source[at:i])
        if not m:
            comment = source.startswith("<!--", i)
            j = source.find("-->" if comment else ">", i + (4 if comment else 2))
            if j < 0:
                break
            at = j + (3 if comment else 1)
            continue
        j = tag_end(source, m.end())
        if j < 0:
            break
        at, tag = j + 1, m[2].lower()
        if m[1]:
            page.end(tag)
        elif tag not in RAW:
            page.start(tag, source[m.end() : j].strip(" /"))
        elif source[j - 1] != "/":
            over = RAW[tag].search(source, at)
            if not over:
                break
            at = over.end()
    page.cut()
    return page.blocks


def judge(block: Block, has_main: bool, p: Params) -> str:
    """Pass one: good, bad, or ambiguous."""
    n = len(block.text)
    short = n < p.short_chars or block.heading
    score = p.boilerplate if block.boilerplate else p.inside if block.main else p.outside if has_main else 0.0
    if not (block.main and block.heading):
        score -= p.link_weight * max(0.0, block.links / n - p.free_links)
    if "©" in block.text and not block.main and n < 3 * p.short_chars:
        score += p.copyright
    if not short:
        words = block.text.lower().split()
        stops = sum(w.strip(".,;:!?()\"'") in STOPS for w in words) / len(words)
        score += min(max(p.stop_weight * (stops - p.stop_mid), -p.stop_most), p.stop_most) + min(math.log2(n / p.short_chars), p.long_most)
    return "bad" if score <= -p.margin else "good" if score >= p.margin and not short else "ambiguous"


def label(found: list[Block], p: Params) -> None:
    """Both passes; ``by`` of a block is the pass that decided it."""
    has_main = any(b.main for b in found)
    for b in found:
        b.label, b.by = judge(b, has_main, p), 1
    for inside in (True, False):
        side = [b for b in found if b.main == inside and not (inside and b.boilerplate)]
        edge = "good" if inside else "bad"
        before, after = neighbours(side, edge), neighbours(side[::-1], edge)[::-1]
        for i, b in enumerate(side):
            if b.label == "ambiguous":
                (near, left), (far, right) = before[i], after[i]
                b.inherited = left if left == right or near < far else right if far < near or b.heading else edge
    for b in found:
        if b.label == "ambiguous":
            b.label, b.by = b.inherited, 2


def neighbours(side: list[Block], edge: str) -> list[tuple[int, str]]:
    """For each block how far the nearest decided block before it is, and its label."""
    out, last, label = [], -1, edge
    for i, b in enumerate(side):
        out.append((i - last, label))
        if b.label != "ambiguous":
            last, label = i, b.label
    return out


def labelled(source: str | None, p: Params = Params()) -> list[Block]:
    """The page's blocks, each with its label and the pass that gave it."""
    found = blocks(source or "")
    label(found, p)
    return found


def main_text(source: str | None, p: Params = Params()) -> str:
    return " ".join(b.text for b in labelled(source, p) if b.label == "good")


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("first_pass", pa.int32()), ("second_pass", pa.int32())])


def extracted(pages: DataFrame, p: Params = Params(), passes: bool = False) -> DataFrame:
    """page_id, url, text, n_chars of every page, and on request how many of its blocks each pass decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [labelled(x, p) for x in b.column(2).to_pylist()]
            texts = [" ".join(k.text for k in page if k.label == "good") for page in found]
            by = [[sum(k.by == n for k in page) for page in found] for n in (1, 2)]
            yield batch(OUT, b.column(0), b.column(1), texts, [len(x) for x in texts], *by)

    schema = "page_id long, url string, text string, n_chars long, first_pass int, second_pass int"
    out = map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, schema)
    return out if passes else out.drop("first_pass", "second_pass")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), passes=True)
