"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block
from itself: where it stands (menus, footers, forms, adverts, notices, comments
and other boilerplate containers; or inside the article), its length, its link
density and its density of stop words. Short blocks stay undecided. Elements
such as menus and footers rule their blocks out; a class or id only does so if
all of its words are listed names, not if one of them is. Stop words of the
listed languages speak for a block, never against a long one without links: in
another language it is judged by its length and its neighbours. The second
pass gives an undecided block the label of the nearest decided neighbours: good
if both sides are good, otherwise that of the nearer side; a block as near to a
good as to a bad one is good if it is inside the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he in is it its not of on or that the this to was were which with you
    auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht sich sie sind und von war wie zu
    al como con de del el en es está la las lo los más no para pero por que se su sus un una y
    au aux avec ce dans de des du elle en est et il je la le les mais ne ou par pas pour qui sur un une
    """.split()
)

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section
    select summary table tbody td tfoot th thead tr ul
    """.split()
)
NOT_P = BLOCKS - {"p"}
BOILERPLATE = frozenset("nav aside footer form head menu dialog button select label legend fieldset".split())
ARTICLE = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    """
    ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline caption comment
    comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu menus modal nav
    navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion related
    replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    tags teaser toolbar widget
    """.split()
)
# Words around a name that say no more than where or what box it is.
BOXES = frozenset(
    "area bar block body box buttons container content form icons inner item items links list panel posts section slot unit wrap wrapper".split()
)
PLACES = frozenset("bottom global left main right site top user".split())
ARTICLE_NAMES = frozenset("article articlebody content entry main maincontent post story".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")  # a quote opens a value only after '='
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass."""

    short: int = 70
    long: int = 200
    link_density: float = 0.4
    low_stop_words: float = 0.12
    high_stop_words: float = 0.25


@dataclass
class Block:
    """Text of a block, the characters of it in links, and where it stands."""

    text: str
    linked: int
    boilerplate: bool
    article: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def _spellings(token: str) -> set[str]:
    """A class or id as one lower-case word; and its words, if all are listed but for places before and boxes behind."""
    parts = [p.lower() for p in _PARTS.split(token) if p]
    whole = "".join(parts)
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    while len(parts) > 1 and parts[0] in PLACES:
        parts.pop(0)
    return {whole, *parts} if BOILERPLATE_NAMES.issuperset(parts) else {whole}


def _role(name: str, attributes: str, inside_article: bool) -> str | None:
    """``boilerplate``, ``article`` or None for an element, from its name and its class, id and role."""
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return "boilerplate"
    role = "article" if name in ARTICLE else None
    if attributes.strip() and name not in ("html", "body"):
        found = _attributes(attributes)
        if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
            return "boilerplate"
        names = {x for key in ("class", "id", "role", "itemprop") for token in found.get(key, "").split() for x in _spellings(token)}
        if found.get("aria-hidden") == "true" and name not in ARTICLE:
            return "boilerplate"
        if names & BOILERPLATE_NAMES and (name not in ARTICLE or names & {"comment", "comments", "teaser", "related"}):
            return "boilerplate"
        if names & ARTICLE_NAMES:
            role = "article"
    return role


def blocks(page: str) -> Iterator[Block]:
    """The non-empty blocks of a page in their order; broken markup is read as far as it goes."""
    stack: list[tuple[str, str | None]] = []
    parts: list[str] = []
    linked = breaks = boilerplate = article = 0
    held: Counter[str] = Counter()  # open elements by name
    at, size = 0, len(page)

    def flush():
        nonlocal parts, linked, breaks
        text = " ".join(entities.unescape("".join(parts)).split())
        block = Block(text, linked, boilerplate > 0, article > 0) if text else None
        parts, linked, breaks = [], 0, 0
        return [block] if block else []

    def close(depth: int):
        nonlocal boilerplate, article
        for name, role in stack[depth:]:
            boilerplate -= role == "boilerplate"
            article -= role == "article"
            held[name] -= 1
        del stack[depth:]

    def innermost(names) -> int | None:
        if not any(held[n] for n in names):
            return None
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names)

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            text = page[at:mark]
            parts.append(text)
            if text.strip():
                breaks = 0
                if held["a"]:
                    linked += len(text.strip())
        if mark == size:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("/", mark + 1)
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if page[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:  # a sign in the text
                parts.append("<")
                at = mark + 1
            continue
        rest = _REST.match(page, name.end())
        if not rest:  # a tag that the page's end cuts off
            break
        tag, attributes, at = name[0].lower(), page[name.end() : rest.end() - 1], rest.end()
        if not closing and tag in RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if not attributes.endswith("/"):
                over = page.find(">", stop.end() - 1) if stop else -1
                at = over + 1 if over >= 0 else size
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                yield from flush()
            continue
        if tag in BLOCKS:
            yield from flush()
        if tag in VOID:
            continue
        if closing:
            depth = innermost((tag,))
            if depth is not None and (tag in BLOCKS or depth >= (innermost(BLOCKS) or 0)):
                close(depth)
            continue
        if tag in BLOCKS:
            if tag not in ("html", "head") and stack and (depth := innermost(("head",))) is not None and tag not in RAW:
                close(depth)
            if (depth := innermost(("p", "a"))) is not None and depth > (innermost(NOT_P) or -1):
                close(depth)
            if tag in ARTICLE:  # menus, headers and forms do not hold articles: one that is open was not closed
                while (depth := innermost(("nav", "header", "footer", "form", "menu"))) is not None:
                    close(depth)
            if tag == "li" and (depth := innermost(("li", "ul", "ol", "menu"))) is not None and stack[depth][0] == "li":
                close(depth)
        elif tag == "a" and (depth := innermost(("a",))) is not None:
            close(depth)
        if tag in BLOCKS or tag in ("a", "span") or "class" in attributes or "id" in attributes:
            role = _role(tag, attributes, article > 0)
            stack.append((tag, role))
            boilerplate += role == "boilerplate"
            article += role == "article"
            held[tag] += 1
    yield from flush()


def first_pass(block: Block, rules: Rules) -> str | None:
    """``good`` or ``bad`` from the block itself; None for a short block."""
    if block.boilerplate:
        return "bad"
    size = len(block.text)
    if block.linked > rules.link_density * size:
        return "bad"
    if size < rules.short:
        return "bad" if "©" in block.text and not block.article else None
    found = _WORD.findall(block.text.lower())
    known = sum(w in STOP_WORDS for w in found)
    density = known / max(1, len(found))
    if density >= rules.high_stop_words or (density >= rules.low_stop_words and size >= rules.long):
        return "good"
    if density >= rules.low_stop_words or block.article or block.linked == 0 and size >= rules.long and known:
        return None
    if known == 0 and block.linked == 0:  # another language, or no prose
        return "good" if size >= rules.long else None
    return "bad"


def extract(page: str | None, rules: Rules = Rules()) -> list[str]:
    """Texts of the good blocks of a page, in their order."""
    found = list(blocks(page or ""))
    labels = [first_pass(b, rules) for b in found]
    if "good" not in labels:  # no prose of the listed languages: long blocks without links decide
        labels = [
            "good" if x is None and not b.article and b.linked == 0 and len(b.text) >= rules.long else x for x, b in zip(labels, found)
        ]
    before: list[tuple[str, int] | None] = []
    last = None
    for i, x in enumerate(labels):
        last = (x, i) if x else last
        before.append(last)
    kept, after = [], None
    for i in range(len(found) - 1, -1, -1):
        x = labels[i]
        if x:
            after = (x, i)
        else:
            x = _inherited(before[i], after, i, found, "good" if found[i].article else "bad")
        if x == "good":
            kept.append(found[i].text)
    return kept[::-1]


def _inherited(left, right, at: int, found: list[Block], edge: str) -> str:
    """Label of an undecided block from the decided ones nearest on each side.

    Inside an article only its own blocks count, and its edges are good.
    """
    sides = []
    for side in (left, right):
        if side is None or (edge == "good" and not (found[side[1]].article and not found[side[1]].boilerplate)):
            sides.append((edge, len(found)))
        else:
            sides.append((side[0], abs(side[1] - at)))
    (a, far_a), (b, far_b) = sides
    if a == b or far_a == far_b:
        return a if a == b else edge
    return a if far_a < far_b else b


def extract_pages(
    df: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, by the whole page.

    Good blocks are joined by two line feeds; character references are decoded
    and white space inside a block is one space. A null or empty page, or one
    without good blocks, has an empty text. Null or repeated ids and null urls
    are kept as they are, an empty table gives no rows, and other columns,
    whatever their names, are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(extract(p.as_py(), rules)) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    pages = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"), F.col(html_col).alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")
