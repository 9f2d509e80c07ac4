"""Main text of web pages by two passes of block rules.

First every block is judged by itself.  Blocks under boilerplate elements, under elements named as such or hidden, and blocks
made of links are out; long blocks with many stop words are in; the others, short ones and such with few stop words, are
ambiguous.  Then an ambiguous block takes the label of the nearer of its decided neighbours (the one before it on ties), a
heading that of the next one.  Tags are one feature among these: blocks of an article have neighbours in articles only, and
stay where none is decided; elsewhere boilerplate counts as a neighbour, and without any the long blocks stay.  In an
article's own header the headings are kept, for they are its title; the rest of it goes, as page headers do.

Null and empty pages have an empty text.  Pages may be cut off anywhere and their tags unbalanced: a link ends at the next
one or, if no end tag comes before that, with its block.  Pages of any length are read whole.  Repeated rows are read each;
further columns are passed on (`text` and `n_chars` are replaced).
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map

#: Elements whose content is never shown, or no text.
SKIPPED = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video datalist map".split())
#: Elements that hold a page's furniture.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that begin and end a block; line breaks don't.
BLOCK = frozenset(
    "html body article main section header footer nav aside form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre hr address figure figcaption center details summary dialog menu hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold text rather than other blocks.
TEXT = frozenset("p li dd dt blockquote pre td th h1 h2 h3 h4 h5 h6 span em strong b i u a code figcaption".split())
#: Parts of names in class, id or role that mark furniture, as the first or last part of a name.
MARKS = re.compile(
    r"ads?|advert\w*|adsense|sponsor(?:ed|s)?|promo\w*|banners?|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|sidebar\w*|related|comments?|commentlist|disqus|respond|replies|contentinfo|complementary",
    re.I,
)
#: Such that mark furniture as the first part of a name, of elements that hold blocks: they are plain words too.
WEAK_MARKS = re.compile(r"alert|side|aside|widgets?|recommend\w*|share|sharing|social|toolbar|copyright|legal|disclaimer", re.I)
#: Such that mark furniture outside an article only: inside, they belong to it.
SITE_MARKS = re.compile(r"footer|header|masthead|topbar", re.I)
#: Such that mark an article element as a reader's comment.
READER_MARKS = re.compile(r"comments?|commentlist|respond|repl(?:y|ies)", re.I)
#: Frequent function words of the languages that are told by density.  Fixed values, in natural order.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it not of on or she that the their they this to was we were will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind über um und von war wie wir zu zum zur "
    "al como con del el ella ellos era es esta este fue ha hay la las lo los más no nos para pero por porque se sin su sus también un una y ya yo".split()
)
LINK_DENSITY, STOP_DENSITY, LONG = 0.34, 0.15, 60

#: Comments, declarations and tags.  A quote begins a value behind an equals sign only.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>]*+)))?")
LINK = re.compile(r"<(/?)a(?=[\s/>]|\Z)", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
SPACE, PART = re.compile(r"\s+"), re.compile(r"[-_]+")
OPEN, OUT, IN = 0, 1, 2


def attributes(raw: str) -> dict[str, str]:
    """By lower-case name, the first of each."""
    found: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(k.lower(), a or b or c)
    return found


def boilerplate(name: str, said: dict[str, str], article: bool) -> bool:
    """Whether an element's name and attributes say that it holds no main text; `article`: it stands in one."""
    if name in FURNITURE or name in SKIPPED or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(said.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    for key in ("class", "id", "role"):
        for token in said.get(key, "").split():
            parts = [p for p in PART.split(token) if p]
            if not parts:
                continue
            if name == "article":
                if READER_MARKS.fullmatch(parts[0]) or READER_MARKS.fullmatch(parts[-1]):
                    return True
            elif MARKS.fullmatch(parts[0]) or MARKS.fullmatch(parts[-1]):
                return True
            elif name not in TEXT and (WEAK_MARKS.fullmatch(parts[0]) or not article and (SITE_MARKS.fullmatch(parts[0]) or SITE_MARKS.fullmatch(parts[-1]))):
                return True
    return False


def blocks(page: str):
    """(text, characters in links, in furniture, in an article, a heading) of each block that has text."""
    found, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, in furniture, in an article, in a header
    link = False  # within a link
    unended = False  # no end tag comes before the next link

    def close():
        nonlocal linked, link
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            name, out, article, header = stack[-1] if stack else ("", False, False, False)
            heading = any(e[0] in HEADINGS for e in stack[-3:])
            found.append((text, linked, out or header and not (article and heading), article, heading))
        parts.clear()
        linked = 0
        link = link and not unended

    def text(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if link:
                linked += len(raw.strip())

    at = 0
    while True:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(entities.unescape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if name == "a":
                link = False
            if name in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            at = RAW[name].search(page, at).end()
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            close()
        if name in VOID or m[3].endswith("/"):
            continue
        said = attributes(m[3]) if m[3] else {}
        if name == "a":
            after = LINK.search(page, at)
            link, unended = "href" in said, not after or not after[1]
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if name in BLOCK or name in SKIPPED or said and name != "a":
            _, out, article, header = stack[-1] if stack else ("", False, False, False)
            out = out or boilerplate(name, said, article)
            header = header or name == "header"
            article = article or name in ("article", "main") or said.get("role") == "main"
            stack.append((name, out, article, header))
    close()
    return found


def first_label(text: str, linked: int, furniture: bool) -> int:
    if furniture or linked > LINK_DENSITY * len(text):
        return OUT
    words = text.lower().split()
    dense = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)
    return IN if dense and len(text) >= LONG else OPEN


def nearest(label: list[int], counts: list[bool]) -> list[tuple[int | None, int | None]]:
    """Of each block, the decided ones before and after it among those that count."""
    before, after, n = [None] * len(label), [None] * len(label), len(label)
    for into, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for k in order:
            into[k] = last
            if label[k] != OPEN and counts[k]:
                last = k
    return list(zip(before, after, strict=True))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    label = [first_label(*b[:3]) for b in found]
    inside = nearest(label, [article and not furniture for _, _, furniture, article, _ in found])
    anywhere = nearest(label, [True] * len(found))
    kept = []
    for k, (text, _, _, article, heading) in enumerate(found):
        own = label[k]
        if own == OPEN:
            sides = [s for s in (inside if article else anywhere)[k] if s is not None]
            if heading and sides and sides[-1] > k:  # a heading goes with what follows it
                sides = sides[-1:]
            own = label[min(sides, key=lambda s: (abs(s - k), s))] if sides else IN if article or len(text) >= LONG else OUT
        if own == IN:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with text and n_chars (code points)."""
    named = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([*pages.select(*named).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in named), *new], [*named, "text", "n_chars"])

    return arrow_map(pages.select(*named), run, schema)


def op9_main_text(pages: DataFrame) -> DataFrame:
    """Contract digest: page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
