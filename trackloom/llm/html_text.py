"""Operator 4: HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags; what scripts, styles and comments
hold is no text. Pass one decides what it can: blocks in boilerplate containers (by
element, role, or a class or id that names such a part as a whole) are bad, and so
are blocks of links; blocks that are long enough and rich in stop words are good, as
are long ones in scripts that no stop word is written in. What is short, has some
links, or has no stop words stays undecided. If no block is good, the stop words say
nothing of the page's language and the long undecided blocks are good. Pass two gives
undecided blocks the label of their nearest decided neighbours; of two neighbours as
near, and for headings, a good one wins. Boilerplate containers are no neighbours:
they are cut out. A container that holds the page is none: a form with more than half
of the page's longer text, or one that only its name marks with nine tenths of it and
of all text (reader comments, menus, footers and what is hidden stay cut,
whatever their size; none of these count as the page's text). If articles outside boilerplate hold at least as much good text as
the rest of the page, nothing beside them is main text; otherwise the page is one
region.

Results for odd rows: a null or empty page, or one without text, gives the
empty string; unclosed and stray tags are borne; what an element hides, its
descendants do not show; depth of nesting costs no more than length; repeated rows are extracted each; an empty table gives no
rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_rows, texts_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|math|title|select|canvas|video|audio)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>|[^>]*\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements that flow within a block; every other element ends it.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not the page's main text.
BOILER_TAGS = set("nav footer aside form menu dialog button fieldset legend".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: What class and id names call boilerplate; words that such a name may have beside it and still be one.
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus sidebar widget widgets footer "
    "foot masthead header comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login feedback tags share sharing sharebar social related recommended recommendations recommend breadcrumb breadcrumbs pagination pager toolbar skip disclaimer copyright teaser teasers".split()
)
BESIDE = set(
    "site main page top bottom left right primary secondary global blog post posts article articles entry user reader my the app web mobile desktop sticky fixed inner outer small big first last side bar "
    "box block area wrap wrapper container section list item items panel group row column col card cards content body text link links button buttons icon icons media widget slot unit placeholder header title "
    "form policy message messages info stories story news more also thread count number meta tools to us and you for in up of".split()
)
#: Names of reader comments, which may be longer than the article.
COMMENT_NAMES = set("comment comments commentlist respond reply replies disqus feedback".split())
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Frequent function words of the large European languages.
STOP_WORDS = set(
    "the of and to in is it that was for on are as with his they at be this have from or one had by but not what all were we when your can said there an which she do their if will he you "
    "der die das und ist von mit den dem ein eine zu auf für nicht auch sich des im es wie so als an werden bei nach aus wird sind noch hat "
    "le la les de des un une et est que qui dans pour pas sur au par avec ce il elle son plus ne se en du sont nous vous mais ou "
    "el los las una que en por con para del se no su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay "
    "il di che è per non sono della con del si lo gli nel o e os as do da em um uma não het een van niet op te zijn voor met ook".split()
)
WORD = re.compile(r"[^\W\d_]+")
#: The last of the Latin letters; stop words say nothing of what is written in others.
LAST_LATIN = "\u024f"
#: Characters and share of stop words from which a block is good; shares of link text from which it is undecided and bad.
LONG, STOP_SHARE, LINKED, LINK_SHARE = 40, 0.1, 0.5, 0.9
#: Shares of the page's longer text from which a form, and a container marked by its name alone, are no
#: boilerplate (the latter's of all text too); what is boilerplate at every share.
FORM_SHARE, NAME_SHARE, ALWAYS = 0.5, 0.9, 2.0
#: A character of scripts without spaces between words says as much as so many others.
DENSE, DENSE_WEIGHT = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"), 3
HEADINGS = {f"h{i}" for i in range(1, 7)}

#: CUT: in a boilerplate container.
GOOD, BAD, OPEN, CUT = 1, -1, 0, -2


def names_boilerplate(name: str) -> float:
    """The share up to which a class or id that names a part of boilerplate, and nothing else, marks it (0: never)."""
    parts = [x.lower() for x in NAME_PARTS.findall(name)]
    if any(x in BOILER_NAMES for x in parts) and all(x in BOILER_NAMES or x in BESIDE for x in parts):
        return ALWAYS if any(x in COMMENT_NAMES for x in parts) else NAME_SHARE
    return 0.0


def hidden(attrs: str, in_article: bool) -> float:
    """The share of the page up to which attributes mark boilerplate: its parts, and what is hidden (0: never)."""
    share = 0.0
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            share = max([share, *(names_boilerplate(x) for x in value.split() if not (in_article and "header" in x.lower()))])
        elif name == "role":
            if value.lower() in BOILER_ROLES:
                share = max(share, FORM_SHARE if value.lower() == "form" else ALWAYS)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            share = ALWAYS
        elif name == "style" and ("display:none" in value.lower().replace(" ", "") or "visibility:hidden" in value.lower().replace(" ", "")):
            share = ALWAYS
    return share


class Block:
    __slots__ = ("article", "boiler", "heading", "in_article", "label", "linked", "text")

    def __init__(self, text: str, linked: int, boiler: int = -1, article: int = -1, heading: bool = False):
        self.text, self.linked, self.heading, self.in_article = text, linked, heading, False
        self.boiler, self.article = boiler, article
        self.label = self._rule()

    def long(self) -> bool:
        return len(self.text) + (DENSE_WEIGHT - 1) * len(DENSE.findall(self.text)) >= LONG

    def _rule(self) -> int:
        if self.linked >= LINK_SHARE * len(self.text):
            return BAD
        if not self.long() or self.linked >= LINKED * len(self.text):
            return OPEN
        words = WORD.findall(self.text.lower())
        if words and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words):
            return GOOD
        return GOOD if 2 * sum(len(w) for w in words if w[0] > LAST_LATIN) > sum(map(len, words)) else OPEN


def cut(blocks: list[Block], boilers: list[tuple[int, float]], articles: list[tuple[int, int]]) -> bool:
    """Label what boilerplate containers (outer one, share) hold, mark what is in articles (outer
    one, container) outside of them, and tell whether there is such an article."""
    longer, full, always = [0] * len(boilers), [0] * len(boilers), []
    for outer, share in boilers:
        always.append(share == ALWAYS or (outer >= 0 and always[outer]))
    page = everything = 0
    for b in blocks:
        if b.label == BAD:
            continue
        everything += len(b.text)
        if b.boiler >= 0:
            full[b.boiler] += len(b.text)
        if b.long() and b.linked < LINKED * len(b.text) and not (b.boiler >= 0 and always[b.boiler]):
            page += len(b.text)
            if b.boiler >= 0:
                longer[b.boiler] += len(b.text)
    for i in range(len(boilers) - 1, -1, -1):
        if boilers[i][0] >= 0:
            longer[boilers[i][0]] += longer[i]
            full[boilers[i][0]] += full[i]
    shut: list[bool] = []
    for i, (outer, share) in enumerate(boilers):
        holds = page and longer[i] > share * page and (share == FORM_SHARE or full[i] > share * everything)
        shut.append(not holds or (outer >= 0 and shut[outer]))
    inside: list[bool] = []
    for outer, boiler in articles:
        inside.append(not (boiler >= 0 and shut[boiler]) or (outer >= 0 and inside[outer]))
    for b in blocks:
        b.in_article = b.article >= 0 and inside[b.article]
        if b.boiler >= 0 and shut[b.boiler]:
            b.label = CUT
    return any(inside)


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """The blocks of a page, and whether it marks an article."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, its innermost boilerplate container and article
    opened: Counter[str] = Counter()
    boilers: list[tuple[int, float]] = []
    articles: list[tuple[int, int]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else ("", -1, -1)
            found.append(Block(text, linked, top[1], top[2], any(x[0] in HEADINGS for x in stack[-3:])))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def push(tag: str, share: float, is_article: bool = False) -> None:
        _, boiler, article = stack[-1] if stack else ("", -1, -1)
        if share:
            boilers.append((boiler, share))
            boiler = len(boilers) - 1
        if is_article:
            articles.append((article, boiler))
            article = len(articles) - 1
        stack.append((tag, boiler, article))
        opened[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        in_article = bool(stack and stack[-1][2] >= 0)
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag != "a" and tag not in VOID and not m["close"] and len(m["attrs"]) > 1 and (share := hidden(m["attrs"], in_article)):
                end_block()
                push(tag, share)
            elif m["close"] and stack and stack[-1][0] == tag:
                end_block()
                pop()
            continue
        end_block()
        if m["close"]:
            if opened[tag]:
                while pop() != tag:
                    pass
                links = 0
        elif tag not in VOID and not m["attrs"].endswith("/>"):
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
                in_article = bool(stack and stack[-1][2] >= 0)
            share = FORM_SHARE if tag == "form" else ALWAYS if tag in BOILER_TAGS or (tag == "header" and not in_article) else 0.0
            if len(m["attrs"]) > 1 and tag not in ("html", "body", "main"):
                share = max(share, hidden(m["attrs"], in_article))
            push(tag, share, tag in ("article", "main"))
    if at < len(page):
        add(page[at:])
    end_block()
    return found, cut(found, boilers, articles)


def settle(blocks: list[Block], has_article: bool) -> None:
    """Pass two: undecided blocks take the label of their nearest decided neighbours in their region."""
    if not any(b.label == GOOD for b in blocks):
        for b in blocks:
            if b.label == OPEN and b.long() and WORD.search(b.text) and b.linked < LINKED * len(b.text):
                b.label = GOOD
    good = {region: sum(len(b.text) for b in blocks if b.label == GOOD and b.in_article == region) for region in (True, False)}
    if has_article and good[True] >= good[False] and any(b.in_article and b.label not in (BAD, CUT) for b in blocks):
        for b in blocks:
            if not b.in_article:  # beside the article nothing is main text
                b.label = CUT
    own = [b for b in blocks if b.label != CUT]
    labels = [b.label for b in own]
    decided = [i for i, x in enumerate(labels) if x != OPEN]
    k = 0
    for i, b in enumerate(own):
        if labels[i] != OPEN:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        near = [(abs(decided[j] - i), -labels[decided[j]]) for j in (k - 1, k) if 0 <= j < len(decided)]
        if b.heading and any(x == -GOOD for _, x in near):
            b.label = GOOD
        else:
            b.label = -min(near)[1] if near else GOOD


def main_text(page: str) -> str:
    blocks, has_article = blocks_of(page)
    settle(blocks, has_article)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(page) for page in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, the main text of each page and its code points."""
    rows = text_rows(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
