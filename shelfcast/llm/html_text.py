"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides every block by the share of stop words of the language
that the page's own text shows, by length, and by the share of its characters that are links. The region it stands in counts in that:
blocks of menus, footers, adverts and the like (by tag, role, class or id) are out; in an article or main part, few stop words
or some links leave a block undecided instead of bad. Where a page shows none of the listed languages, length and links decide. Where the
marked article has the bulk of the text, nothing else is taken. What is left undecided, short blocks and middling ones,
takes in the second pass the label that its nearest decided neighbours of the same region share. Where they differ or there are none, a block
of an article stays, a sentence follows the block before it, and any other one stays only if its stop words spoke for it.

Cases: null and empty pages, and pages without main text, give an empty text; unclosed and wrongly nested tags end with
the block or the element around them; a page cut off anywhere is read up to there; texts of any length are read
whole; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: elements that end a line of text
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
# fixed values: elements without content, and elements whose content is never text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "annotation annotation-xml applet audio button canvas datalist iframe noframes noscript object script select style svg template textarea "
    "title video".split()
)
# of these, what can hold no paragraphs: a new one ends it
NO_PARAGRAPHS = frozenset(["button", "select"])
# fixed values: what an opening tag ends if it is still open
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# fixed values: regions that are not the article, by tag, by role, and by what the class or id names
OUTSIDE_TAGS = frozenset("aside dialog footer form menu nav".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert announcement aside banner breadcrumb breadcrumbs byline "
    "comment commentlist comments consent cookie cookies copyright disclaimer disqus feedback footer form gdpr legal login "
    "masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tagcloud tags toolbar topbar warning widget widgets".split()
)
HEADER_NAMES = frozenset(["header", "head", "top"])
# parts of a page that hold what is not its article even where that is marked as an article
HARD_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside breadcrumb breadcrumbs comment commentlist comments disqus footer "
    "menu nav navbar navigation pager pagination promo promoted promotion recommended related replies reply respond sidebar "
    "sponsor sponsored tagcloud widget widgets".split()
)
INSIDE_TAGS = frozenset(["article", "main"])
INSIDE_NAMES = frozenset("article articlebody entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# class names that speak about the page, not about the element, at the start and inside
ABOUT_PAGE = ("has-", "with-", "no-", "is-", "not-", "without-")
ABOUT_REST = frozenset("and has no not with without".split())
# what may follow the noun that names an element: "comment-list" names comments, "top-story" a story, "related-work" work
AFTER_NOUN = frozenset(
    "area articles bar block body bottom box button buttons center col column container content danger fixed group holder icon icons info inner "
    "item items left link links list main news outer panel posts primary results right row secondary section slot stories success text "
    "this unit wrap wrapper".split()
)
AFTER_INSIDE = frozenset("area body container content inner text wrap wrapper".split())
# whole class names of a page's frame; beside them a name with a side or state speaks about the page
FRAMES = frozenset("body container content layout page row site wrap wrapper".split())
SIDES = frozenset("active enabled fixed left open right".split())
OPEN_PARAGRAPH = UNSEEN - NO_PARAGRAPHS
LISTS = ("ul", "ol", "dl", "table", "select")
# elements whose class or id can mark an article
CONTAINERS = frozenset("article body center dd details div fieldset li main section table tbody td tr ul ol".split())
# fixed values: frequent words of four languages
STOP_WORDS = {
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für hat "
    "ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wenn wer wie wir "
    "wird zu zum zur über",
    "en": "a about after all also an and are as at be been but by can could do for from had has have he her his i if in into is it "
    "its more no not of on one only or other our out she so some than that the their them then there these they this to up was "
    "we were what when which who will with would you your",
    "es": "al algo ante como con cuando de del desde donde el ella en entre era es esta este está ha hay la las le lo los me más mi "
    "muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te tiene todo un una uno y ya yo",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et été être eux il ils je la le les leur lui ma mais me même "
    "mes mon ne nos notre nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur ta te tu un une vous y",
}
STOP_SETS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[^\W\d_]+")
# scripts that write a word in one or two characters
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
NAME_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SHORT_CHARS, MIDDLING_CHARS, LONG_CHARS = 70, 100, 200
LOW_STOPS, HIGH_STOPS = 0.30, 0.32
# share of stop words from which on a page is taken to be of their language
SHOWN_STOPS = 0.25
MOST_LINKS, MOST_LINKS_INSIDE = 0.2, 0.5
# a line that says whose the page is, not a paragraph that speaks of it
NOTICE = regex.compile(r"\s*(?:©|\(c\)\s|copyright\b)", regex.I)
SENTENCE_ENDS, AFTER_SENTENCE = frozenset(".!?…。！？"), "\"'”’»)]"

# what is SOFT is outside, but an article in it is inside
UNKNOWN, INSIDE, OUTSIDE, SOFT = 0, 1, 2, 3
GOOD, BAD, SHORT, NEAR, LIST = "good", "bad", "short", "near", "list"


def _names(value: str | None, after: frozenset[str] = AFTER_NOUN) -> set[str]:
    """The nouns that the names in ``value`` end with, and the names as one word."""
    if not value:
        return set()
    tokens = value.split()
    framed = any(t.lower() in FRAMES for t in tokens)
    out: set[str] = set()
    for token in tokens:
        if token.lower().startswith(ABOUT_PAGE):
            continue
        words = [w.lower() for w in NAME_WORD.findall(token) if len(w) > 1]
        if framed and len(words) > 1 and words[-1] in SIDES:
            continue
        words = words[: next((i for i, w in enumerate(words) if i and w in ABOUT_REST), len(words))]
        out.add("".join(words))
        while len(words) > 1 and words[-1] in after:
            words.pop()
        out.update(words[-1:])
    return out


def _region(tag: str, attrs: dict[str, str | None], around: int) -> int:
    """The region an element opens, or the one around it."""
    if around == OUTSIDE or tag in ("html", "body"):
        return around
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return OUTSIDE
    if HIDDEN.search(attrs.get("style") or ""):
        return OUTSIDE
    role, classes = (attrs.get("role") or "").lower(), attrs.get("class")
    marked = tag in INSIDE_TAGS or role in ("article", "main") or "articlebody" in (attrs.get("itemprop") or "").lower()
    # a heading's id repeats its text, and so does that of a section of an article
    id_ = None if tag in HEADINGS or (tag == "section" and around == INSIDE) else attrs.get("id")
    names = _names(classes) | _names(id_)
    if tag == "form":
        # a form around the whole page, as some servers write it
        return around if "runat" in attrs and around == UNKNOWN else OUTSIDE if around == INSIDE else SOFT
    if tag in OUTSIDE_TAGS or role in OUTSIDE_ROLES:
        return OUTSIDE
    if not marked and tag not in {"a", "b", "em", "i", "strong"} and names & OUTSIDE_NAMES:
        return OUTSIDE if names & HARD_NAMES else SOFT
    if tag == "article" and names & {"comment", "reply", "ad", "advert", "promo", "sponsored", "related"}:
        return OUTSIDE
    # the head of an article holds its title; the head of a page does not, and an id "top" or "head" is a place to go to
    if around != INSIDE and not marked and (tag == "header" or _names(classes) & HEADER_NAMES or "header" in names):
        return SOFT
    inside = (_names(classes, AFTER_INSIDE) | _names(id_, AFTER_INSIDE)) & INSIDE_NAMES if tag in CONTAINERS else set()
    if marked or (around != SOFT and inside) or inside & {"article", "articlebody"}:
        return INSIDE
    return around


class Blocks(HTMLParser):
    """The blocks of a page: text, characters in links, region, and whether it is a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, int]] = []
        # places of the open elements by tag, of the open blocks, of the unseen ones: no tag looks through all that is open
        self.places: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.open_unseen: list[int] = []
        self.text: list[str] = []
        self.links, self.in_link, self.breaks, self.headings = 0, False, 0, 0

    @property
    def unseen(self) -> bool:
        return bool(self.open_unseen)

    def region(self) -> int:
        return self.open[-1][1] if self.open else UNKNOWN

    def last(self, tag: str) -> int:
        """The place of the innermost open element of this tag, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def begin(self, tag: str, region: int) -> None:
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.open_blocks.append(at)
        if tag in UNSEEN:
            self.open_unseen.append(at)
        self.headings += tag in HEADINGS
        self.open.append((tag, region))

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            region = OUTSIDE if self.region() == SOFT else self.region()
            self.found.append((text, self.links, region, self.headings > 0))
        self.text, self.links, self.in_link, self.breaks = [], 0, False, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            self.begin(tag, self.region())
            return
        told = dict(attrs)
        if tag == "br" and not self.unseen:
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            else:
                self.text.append(" ")
            return
        if tag in BLOCKS:
            if not self.unseen:
                self.end_block()
            at = self.last("p")
            # a block inside the paragraph keeps it open
            if at >= 0 and self.open_blocks[-1] == at:
                self._close(at, OPEN_PARAGRAPH if tag == "p" else UNSEEN)
            if tag in ENDS:
                at = max(map(self.last, ENDS[tag]))
                if at >= 0 and not any(self.last(t) > at for t in LISTS):
                    self._close(at, OPEN_PARAGRAPH)
        if tag in VOID:
            return
        if self.unseen:
            self.begin(tag, self.region())
            return
        region = _region(tag, told, self.region())
        if region != self.region() and tag not in BLOCKS:
            self.end_block()
        if tag == "a":
            self.in_link = "href" in told
        self.begin(tag, region)

    def _end(self, k: int) -> None:
        """Close the element at place ``k`` with all inside it, unseen ones too."""
        while len(self.open) > k:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            self.headings -= tag in HEADINGS
        for places in (self.open_blocks, self.open_unseen):
            while places and places[-1] >= k:
                places.pop()

    def _close(self, at: int, until: frozenset[str]) -> None:
        """Close the element at a place with all inside it, but not from within an unseen element of ``until``."""
        if self.open_unseen and self.open_unseen[-1] > at and any(self.last(t) > at for t in until):
            return
        if self.unseen and self.open_unseen[0] >= at:
            self.end_block()
        self._end(at)

    def handle_endtag(self, tag: str) -> None:
        at = self.last(tag)
        # an inline end tag does not close the block around it
        if tag not in BLOCKS and tag not in UNSEEN and self.open_blocks and self.open_blocks[-1] > at:
            at = -1
        seen = not self.unseen or 0 <= at < self.open_unseen[0]
        if tag in BLOCKS and seen:
            self.end_block()
        if tag == "a" and seen:
            self.in_link = False
        if at < 0:
            return
        if seen and tag not in BLOCKS and (self.open[at - 1][1] if at else UNKNOWN) != self.region():
            self.end_block()
        self._end(at)

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if data.strip():
            self.breaks = 0
        self.text.append(data)
        if self.in_link:
            self.links += len("".join(data.split()))


def _dense(text: str, links: int) -> float:
    """Share of a block's characters that are in links."""
    return links / max(1, len(text.replace(" ", "")))


def _length(text: str) -> int:
    """Characters, as many as the text would have in letters."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def _sentence(text: str) -> bool:
    return text.rstrip(AFTER_SENTENCE)[-1:] in SENTENCE_ENDS


def _stop_words(blocks: list[tuple[str, int, int, bool]], words: list[list[str]]) -> frozenset[str] | None:
    """Those of the language of the page's long blocks; None if it is none of the listed."""
    every = [
        w
        for (text, links, region, _), own in zip(blocks, words)
        if region != OUTSIDE and _length(text) >= SHORT_CHARS and _dense(text, links) <= MOST_LINKS
        for w in own
    ]
    found = {lang: sum(map(stops.__contains__, every)) for lang, stops in STOP_SETS.items()}
    best = max(found, key=found.__getitem__)
    return STOP_SETS[best] if found[best] >= max(1, SHOWN_STOPS * len(every)) else None


def _first_label(text: str, links: int, region: int, heading: bool, words: list[str], stops: frozenset[str] | None) -> str:
    if region == OUTSIDE:
        return BAD
    inside = region == INSIDE
    length, dense = _length(text), _dense(text, links)
    if dense > (MOST_LINKS_INSIDE if inside else MOST_LINKS):
        return SHORT if inside and length < SHORT_CHARS else BAD
    if length < LONG_CHARS and not inside and NOTICE.match(text):
        return BAD
    if length < SHORT_CHARS:
        return BAD if links and not inside else SHORT
    if stops is None:
        return GOOD if length > LONG_CHARS else NEAR
    share = sum(map(stops.__contains__, words)) / max(1, len(words))
    if share >= HIGH_STOPS:
        told = not links and length > MIDDLING_CHARS and _sentence(text)
        return GOOD if length > LONG_CHARS or inside or told else NEAR
    if share >= LOW_STOPS or inside:
        return NEAR
    return LIST if length <= LONG_CHARS and not links else BAD


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.end_block()
    blocks = page.found
    words = [WORD.findall(text.lower()) if region != OUTSIDE else [] for text, _, region, _ in blocks]
    stops = _stop_words(blocks, words)
    first = [_first_label(*b, w, stops) for b, w in zip(blocks, words)]
    # where the marked article has the bulk of the text, what stands around it is not asked
    good = {
        r: sum(_length(b[0]) for b, x in zip(blocks, first) if b[2] == r and (x in (GOOD, NEAR) or (x == SHORT and r == INSIDE)))
        for r in (INSIDE, UNKNOWN)
    }
    if good[INSIDE] and good[INSIDE] >= good[UNKNOWN]:
        first = [BAD if b[2] == UNKNOWN else label for b, label in zip(blocks, first)]
    before: list[str | None] = []
    after: list[str | None] = []
    for out, order in ((before, range(len(blocks))), (after, range(len(blocks) - 1, -1, -1))):
        seen: dict[int, str] = {}
        for i in order:
            out.append(seen.get(blocks[i][2]))
            if first[i] in (GOOD, BAD):
                seen[blocks[i][2]] = first[i]
    after.reverse()
    kept = []
    for (text, links, region, heading), label, left, right in zip(blocks, first, before, after):
        if label == LIST:
            # names or numbers between two blocks of the text
            label = GOOD if left == right == GOOD else BAD
        if label in (SHORT, NEAR):
            near = {x for x in (left, right) if x}
            if heading and right and region != INSIDE:
                label = right
            elif len(near) == 1:
                label = near.pop()
            elif region == INSIDE or label == NEAR:
                label = GOOD
            else:
                label = left if left and not links and _sentence(text) else BAD
        if label == GOOD:
            kept.append(text)
    return "\n".join(kept)


def extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def each(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(main_text, na_action=None).astype(object)

    return each(html)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Identifier, address, main text and its length in code points of every page."""
    return pages.select("page_id", "url", extracted(F.col(html)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
