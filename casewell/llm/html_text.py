"""Main text of web pages from flat text blocks.

A page is read once into text blocks, which end at block-level tags. Each block has its words
and link density, those of its neighbours, and whether it stands in an article or in a part
named for navigation, adverts and the like. A decision tree trained on a small labelled table
classifies the blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

#: Fixed lists: tags whose content is not text, tags without content, tags inside a line, tags
#: and names of parts that are not the article.
SILENT = frozenset("head script style noscript template iframe object svg textarea select "
                   "button canvas audio video math".split())
#: What a head may hold; any other tag ends a head that is not closed.
IN_HEAD = frozenset("title meta link base script style noscript template object".split())
#: Tags whose content holds no tags.
RAW = frozenset("script style textarea title".split())
#: Tags that end with the element around them, since their own end is often missing.
LOOSE = frozenset("p li dt dd tr td th option".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
                   "wbr img".split())
PARTS = frozenset("nav header footer aside menu dialog form".split())
NAMES = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment "
                  "comments consent cookie cookies disclaimer footer form gdpr header login menu "
                  "nav navbar navigation newsletter notice notices pagination popup promo related "
                  "share sharing sidebar signup social sponsor sponsored subscribe toolbar "
                  "widget".split())
#: Words that make a class name say something about another part of the page.
ABOUT = frozenset("no not non has with without is hide hidden show".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog form menu alert "
                  "alertdialog".split())
#: Possessive, so that a broken page is read in one pass; a tag that the page ends in is no text.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?+)([A-Za-z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*+>|</?+[A-Za-z][^>]*+\Z""",
                 re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    part: bool
    article: bool


def _named(tag: str, attributes: str) -> bool:
    """Whether a tag opens a part that is not the article."""
    if tag in PARTS:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for words in (v.split("-") for v in value.replace("_", "-").split()):
                if words[0] not in ABOUT and NAMES & set(words):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Open parts end with their tag or with one around them; so
    do silent parts, and a head at the first tag that it cannot hold. A form that holds the
    article is no part of its own: some pages stand in a form as a whole."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, named, article
    inside: list[str] = []  # open tags of a silent part, itself first
    pieces: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            article = max((k for k, x in enumerate(stack) if x[2]), default=-1)
            part = any(x[1] and (k > article or x[0] != "form") for k, x in enumerate(stack))
            out.append(Block(text, len(text.split()), len("".join(linked).split()), part,
                             article >= 0))
        pieces.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not inside:
            text = html.unescape(raw)
            pieces.append(text)
            if links:
                linked.append(text + " ")

    at = 0
    while True:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if inside:
            if inside == ["head"] and tag not in IN_HEAD and not (closing and tag == "head"):
                inside.clear()  # its end tag is missing: go on with this tag
            elif not closing:
                if tag in RAW:
                    at = _after(page, tag, at)
                elif tag in SILENT or tag not in EMPTY | INLINE | LOOSE:
                    inside.append(tag)
                continue
            elif tag in inside:
                while inside.pop() != tag:
                    pass
                continue
            elif any(x[0] == tag for x in stack) and tag not in INLINE | LOOSE:
                inside.clear()  # the element around it ends
            else:
                continue
        if tag in SILENT and not closing:
            flush()
            if found[3].endswith("/") and tag in ("svg", "object"):
                continue
            if tag in RAW:
                at = _after(page, tag, at)
            else:
                inside.append(tag)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        if tag in EMPTY or tag in LOOSE:
            if not closing and tag not in EMPTY and _named(tag, found[3]):
                stack.append((tag, True, False))
            elif closing and stack and stack[-1][0] == tag:
                stack.pop()
            continue
        if not closing:
            stack.append((tag, _named(tag, found[3]), tag in ("article", "main")))
        elif any(x[0] == tag for x in stack):
            while stack.pop()[0] != tag:
                pass
            links = 0
    flush()
    return out


def _after(page: str, tag: str, at: int) -> int:
    """Where the content of a tag without tags inside has ended."""
    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """(part, article, page has an article, page has a block of text of some length, words and
    link density of the block, the one before and the one after) of each block."""
    has = float(any(b.article and not b.part for b in found))
    dense = [(float(b.words), b.linked / b.words) for b in found]
    long = float(any(b.words >= LONG and not b.part and d < 0.5
                     for b, (_, d) in zip(found, dense, strict=True)))
    edge = (0.0, 0.0)
    return [(float(b.part), float(b.article), has, long, *dense[i], *(dense[i - 1] if i else edge),
             *(dense[i + 1] if i + 1 < len(found) else edge)) for i, b in enumerate(found)]


#: Words of a block of some length.
LONG = 16
#: The labelled table. Where a page has an article, or a block stands in a part named for what
#: it is, the place decides: (part, article, page has an article, label), each with the sizes
#: below for the block and its neighbours. Only a block of links beside another one is no text of
#: an article either: it is a list of links.
PLACED = ((1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 1, 0), (0, 1, 1, 1), (0, 0, 1, 0))
SIZES = ((1, 0.0), (2, 1.0), (5, 0.4), (9, 0.0), (25, 0.1), (30, 1.0), (70, 0.0), (250, 0.05))
BESIDE = ((0, 0.0), (2, 1.0), (6, 0.0), (60, 0.0))
#: On other pages sizes and links decide: (words, link density, label). Short blocks without
#: links (label None) follow their neighbours: text beside a long block of text, else not. On a
#: page without any block of some length they are its text.
SIZED = ((2, 1.0, 0), (6, 0.6, 0), (15, 0.8, 0), (40, 0.9, 0), (80, 0.7, 0), (16, 0.0, 1),
         (25, 0.1, 1), (40, 0.0, 1), (70, 0.05, 1), (150, 0.2, 1), (400, 0.0, 1),
         (1, 0.0, None), (4, 0.0, None), (9, 0.1, None))


def labelled() -> list[tuple]:
    """The rows of the table, once for each pair of neighbours."""
    out = []
    for one in BESIDE:
        for other in BESIDE:
            listed = 1.0 in (one[1], other[1])
            for part, article, has, label in PLACED:
                for long in (0, 1):
                    out += [(part, article, has, long, *own, *one, *other,
                             label and not (listed and own[1] == 1.0)) for own in SIZES]
            beside_text = int(max(one, other)[0] >= 20)
            for words, links, label in SIZED:
                row = (words, links, *one, *other)
                if label is None and not beside_text:
                    out.append((0, 0, 0, 0, *row, 1))
                out.append((0, 0, 0, 1, *row, beside_text if label is None else label))
    return [(*row[:-1], int(row[-1])) for row in out]


def grow(rows, depth: int = 8):
    """Decision tree by Gini impurity: (feature, cut, lower, upper) or the majority label."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def main_text(page: str, tree) -> str:
    """Text of the blocks that the tree takes, joined by spaces in page order."""
    found = blocks(page)
    out = []
    for block, row in zip(found, features(found), strict=True):
        node = tree
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            out.append(block.text)
    return " ".join(out)


def _extractor(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page, and one without article text, has an empty text. Whole pages are read,
    broken markup included; repeated rows give equal results; null ids and urls stay null. An
    empty table gives an empty result; other columns are not looked at."""
    tree = grow(labelled())
    return (pages.select(F.col(id_col).cast("bigint").alias("page_id"),
                         F.col(url_col).cast("string").alias("url"),
                         text_of(html_col).alias("html"))
            .mapInArrow(_extractor(tree), EXTRACTED))
