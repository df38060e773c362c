"""HTML extraction (6): blocks judged by stop-word density, length and link density, then by their neighbours.

Containers that are never an article (menus, forms, adverts, reader comments) go first; they bound what is judged. A page
that marks its article (article, main, role=main, or else a div named so) is judged within it, other pages in their body.

Pass 1 decides blocks by link density, and those that are long enough by the share of stop words; where a page has no block
in a language of the lists, or a block is in another script, by length alone. Pass 2 gives short and doubtful blocks the
label of their nearest decided neighbours. A region's edge counts as good in a marked article and as bad in a body, there for
blocks only that aren't in an element made for text, such as a paragraph or a heading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you
    au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous
    als auch auf aus bei das dem den der die ein eine einem einen einer er es hat ich im ist mit nach nicht noch oder sich sie sind so und vom von war wie wir zu zum zur
    al como con del el ella era fue ha hay las lo los más me mi muy no o para pero por porque si sin sobre su sus también tiene todo una unos y ya""".split()
)

BLOCKS = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu nav noframes noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()) - {"br"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("p blockquote pre figcaption caption".split())
LISTS = frozenset("li dt dd".split())
#: What a head can hold; anything else ends it.
HEADS = frozenset("base basefont bgsound html head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noscript template svg canvas object audio video".split())
NEVER = frozenset("nav footer aside form button select datalist dialog menu head".split()) | RAW
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of a class or id that mark what isn't an article.
NEVER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer form gdpr
    login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related replies reply
    search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split()
)
#: Parts that leave a name's meaning as it is: within a marked article a name counts if it has no other parts than these and those above.
NEUTRAL_NAMES = frozenset(
    """area article articles bar block body bottom box btn button buttons container content entry footer form header icons inline inner left link links list
    main module more page panel post posts right row section site story text title top wrap wrapper zone""".split()
)
#: Of the names above, the ones that count even on an element that marks an article.
NEVER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo reply replies sponsored related".split())

#: Parts of a class or id that mark an article, where the page has no element for it.
ARTICLE_NAMES = frozenset("article content entry main post story".split())

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
LETTER = re.compile(r"[^\W_]")
LATIN = re.compile(r"[a-zA-Z\u00c0-\u024f]")
NAME_PART = re.compile(r"[a-z0-9]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")

# Thresholds, in characters and in shares.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.10, 0.20, 0.5
GOOD, NEAR, BRIEF, BAD, EDGE = "good", "near-good", "short", "bad", "edge"


class Block:
    """article: 2 in an element that marks the article, 1 in one with a name that does. kind: list, text or neither. only_links: several, and no letter beside them."""

    __slots__ = ("text", "linked", "heading", "never", "article", "label", "kind", "only_links")

    def __init__(self, text: str, linked: int, heading: bool, never: bool, article: int, kind: str = "", only_links: bool = False):
        self.text, self.linked, self.heading, self.never, self.article, self.label, self.kind, self.only_links = text, linked, heading, never, article, "", kind, only_links


def _named_never(names: list[str], marks: int, article: int) -> bool:
    """Whether a class or id says that an element isn't of the article; names are its words, each of one or more parts."""
    for name in names:
        parts = set(NAME_PART.findall(name))
        if "header" in parts and article < 2 and not marks:
            return True
        if found := parts & (NEVER_ARTICLES if marks else NEVER_NAMES):
            # Within a marked article search-methods is a subject, share-buttons aren't.
            if marks or article < 2 or parts <= found | NEUTRAL_NAMES:
                return True
    return False


def _never(name: str, attributes: str, article: int) -> tuple[bool, int]:
    """Whether an element's content is never an article, and whether it marks one (2) or has the name of one (1)."""
    marks = 2 if name in ("article", "main") else 0
    if name in NEVER or (name == "header" and article < 2):
        return True, marks
    if not attributes or name in ("html", "body"):
        return False, marks
    names: list[str] = []
    hidden = False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            marks = 2 if value in ("main", "article") else marks
            if value in NEVER_ROLES:
                return True, marks
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return True, marks
        elif key == "aria-hidden":
            if value == "true":
                return True, marks
        elif key in ("class", "id"):
            names += value.split()
        elif key == "hidden":
            hidden = True
    if (hidden and not marks) or _named_never(names, marks, article):
        return True, marks
    return False, marks or (1 if name in ("div", "section", "td") and any(ARTICLE_NAMES.intersection(NAME_PART.findall(x)) for x in names) else 0)


class Element:
    """An open element. kind: what its blocks are, list in a list that the article holds, text in an element made for it."""

    __slots__ = ("name", "never", "article", "listed", "texts")

    def __init__(self, name: str, never: bool, article: int, listed: bool, texts: bool):
        self.name, self.never, self.article, self.listed, self.texts = name, never, article, listed, texts


class Open:
    """The open elements, with what is asked of them at every tag kept up to date, so that each step takes the same time however many are open."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements
        self.headings = 0
        self.bottom = Element("", False, 0, False, False)

    def top(self) -> Element:
        return self.stack[-1] if self.stack else self.bottom

    def push(self, name: str, attributes: str) -> None:
        up = self.top()
        own, marks = (False, 0) if up.never or name in ("a", "b", "i", "em", "strong") else _never(name, attributes, up.article)
        listed = True if name in LISTS else False if name in ("article", "main") else up.listed
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.headings += name in HEADINGS
        self.stack.append(Element(name, up.never or own, up.article if own or up.never else max(up.article, marks), listed, name in TEXTS if name in BLOCKS else up.texts))

    def cut(self, place: int) -> bool:
        """Closes all from a place on; whether a block element was among them."""
        block = bool(self.blocks) and self.blocks[-1] >= place
        while len(self.stack) > place:
            name = self.stack.pop().name
            self.places[name].pop()
            self.headings -= name in HEADINGS
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        return block

    def place(self, name: str) -> int:
        """The innermost open element of a name; -1 if there is none."""
        return self.places[name][-1] if self.places.get(name) else -1


def blocks(html: str) -> list[Block]:
    """The text between block tags, in page order, with what surrounds it. Empty blocks are left out.

    Takes time in proportion to the page, whatever it leaves open.
    """
    out: list[Block] = []
    open_, parts = Open(), []
    linked = at = links = anchors = 0
    loose = False  # a letter outside links
    endless: set[str] = set()  # names whose end tag doesn't come any more

    def flush() -> None:
        nonlocal linked, anchors, loose
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                e = open_.top()
                out.append(Block(text, linked, open_.headings > 0, e.never, e.article, "list" if e.listed and linked else "text" if e.texts else "", anchors > 1 and not loose))
            parts.clear()
        linked = anchors = 0
        loose = False

    find, length = TAG.search, len(html)
    while at < length:
        m = find(html, at)
        end = m.start() if m else length
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            if open_.top().name == "head" and piece.strip():
                flush()
                open_.cut(len(open_.stack) - 1)
            parts.append(piece)
            if links:
                linked += len(piece.strip())
            elif not loose and LETTER.search(piece):
                loose = True
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif closing:
            place = open_.place(name)
            if name in BLOCKS or (place >= 0 and open_.blocks and open_.blocks[-1] >= place):
                flush()
            if place >= 0:
                open_.cut(place)
            if name == "a":
                links = max(0, links - 1)
        else:
            if open_.top().name == "head" and name not in HEADS:
                flush()
                open_.cut(len(open_.stack) - 1)
            if name in RAW:
                if name in BLOCKS:
                    flush()
                if not attributes.endswith("/"):
                    low = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at) if name not in endless else None
                    if low:
                        close = html.find(">", low.end())
                        at = close + 1 if close >= 0 else length
                    else:
                        endless.add(name)
                        if name in ("script", "style", "textarea", "title"):
                            at = length
                continue
            if name in BLOCKS:
                flush()
                links = 0
                if open_.blocks:  # what the new block ends: an open p, or an li beside it
                    inner = open_.stack[open_.blocks[-1]].name
                    if inner == "p" or inner == name == "li":
                        open_.cut(open_.blocks[-1])
            if name in VOID or attributes.endswith("/"):
                continue
            if name == "a":
                links = 1
                anchors += 1
            open_.push(name, attributes)
    flush()
    return out


def density_of(text: str) -> float:
    words = NOT_LETTERS.sub(" ", text.lower()).split()
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def link_list(b: Block) -> bool:
    """Whether a block of a marked article, over half of it linked, is a list of links: a list's item, several links without a word between them, or a short block that isn't made for text."""
    if b.kind == "list" or b.only_links:
        return True
    return b.kind != "text" and (len(b.text) < SHORT or density_of(b.text) < STOP_LOW)


def first_pass(found: list[Block], marked: bool) -> list[str]:
    """Labels by link density, length and stop words. Of a marked article a long block is doubtful at worst: a table of figures or a listing may be part of it."""
    dense = [0.0 if len(b.text) < SHORT else density_of(b.text) for b in found]
    listed = any(x >= STOP_LOW for x in dense)  # the page is in a language that has a list
    labels = []
    for b, density in zip(found, dense, strict=True):
        n = len(b.text)
        if b.linked > LINKS * n and (link_list(b) if marked else not b.heading):
            labels.append(BAD)
        elif n < SHORT:
            labels.append(BRIEF)
        elif density >= STOP_LOW:
            labels.append(GOOD if density >= STOP_HIGH and n > LONG else NEAR)
        elif not listed or 2 * len(LATIN.findall(b.text)) < len(LETTER.findall(b.text)):
            labels.append(GOOD if n > LONG else NEAR)
        elif marked:
            labels.append(NEAR)
        else:  # too few words for their share to tell a paragraph from a list of keywords
            labels.append(BRIEF if b.kind == "text" and n <= LONG else BAD)
    if GOOD not in labels:  # the best that there is
        labels = [GOOD if x == NEAR else x for x in labels]
    return labels


def nearest(labels: list[str], undecided: tuple[str, ...]) -> list[tuple[str, int, str, int]]:
    """For each block the nearest decided label before it and after it, EDGE if there is none, and how many blocks away they are."""
    sides = []
    for run in (labels, labels[::-1]):
        got, last, away = [], EDGE, 1
        for x in run:
            got.append((last, away))
            last, away = (last, away + 1) if x in undecided else (x, 1)
        sides.append(got)
    return [(*x, *y) for x, y in zip(sides[0], reversed(sides[1]), strict=True)]


def inherited(b: Block, before: str, away: int, after: str, ahead: int, marked: bool) -> str:
    """The nearer neighbour's label; of two as near, a heading takes the one that follows, other blocks the bad one, in a marked article the good one.

    Of a marked article, what is in an element made for text stays, but for the heading of a link list.
    """
    if marked and b.kind == "text":
        return BAD if b.heading and before != EDGE and after == BAD and ahead <= away else GOOD  # the heading of a link list
    if b.kind == "text" and EDGE in (before, after) and before != after:
        return after if before == EDGE else before  # the only neighbour that is decided
    before, after = (x if x != EDGE else GOOD if marked else BAD for x in (before, after))
    if before == after or away < ahead:
        return before
    return after if ahead < away or b.heading else GOOD if marked else BAD


def judge(found: list[Block]) -> None:
    """Labels blocks good or bad, in two passes."""
    most = max((b.article for b in found if not b.never), default=0)
    marked = most > 0
    region = []
    for b in found:
        if b.never or b.article < most:
            b.label = BAD
        else:
            region.append(b)
    first = first_pass(region, marked)
    if not marked and GOOD not in first:
        # Nothing to go by but the elements: a page of a few short paragraphs, or one without any element.
        texts = any(b.kind == "text" and x == BRIEF for b, x in zip(region, first, strict=True))
        for b, x in zip(region, first, strict=True):
            b.label = GOOD if x == BRIEF and (b.kind == "text" or not texts) else BAD
        return
    near = nearest(first, (BRIEF, NEAR))
    second = [inherited(b, *d, marked) if x == BRIEF else x for b, x, d in zip(region, first, near, strict=True)]
    # Near-good blocks are bad only between bad ones.
    third = [x if x != NEAR else BAD if d[0] == d[2] == BAD else GOOD for x, d in zip(second, nearest(second, (NEAR,)), strict=True)]
    for b, x in zip(region, third, strict=True):
        b.label = x


def main_text(html: str | None) -> tuple[str, int, int]:
    """Text of the good blocks, joined by one space; numbers of blocks and of good ones. Null is an empty page."""
    found = blocks(html or "")
    judge(found)
    good = [b.text for b in found if b.label == GOOD]
    return " ".join(good), len(found), len(good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_good for each row of pages(page_id, url, html, ...), without a shuffle.

    Null html gives an empty text; null ids and urls and repeated rows are kept. Pages are read whole, in time that grows with
    their length whatever tags they leave open. Of neighbours that are equally near, a heading follows the next one, other
    blocks the bad one, or the good one within a marked article. An empty table gives an empty result. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                got = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got]))], ["page_id", "url", "text", "n_chars", "n_blocks", "n_good"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_good long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
