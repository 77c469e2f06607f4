"""Main text of web pages by two passes of block rules.

Pass one classifies each block by its length, link density and share of stop words, pass two gives ambiguous short
blocks the label of their nearest decided neighbours. <article> and <main> are one feature beside these: they bound
where neighbours are looked for, and rule out what is outside if they hold enough of the good text. In pages of a
language without a list of stop words, marks that end sentences stand for them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.llm.shared import sliced

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its "
    "more no not of on one or other our she so some than that the their them then there these they this to up was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einen einer es für hat ich ihr im ist man mit nach nicht noch nur oder sich sie sind und von vor war wie wir zu zum zur über "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando de del el ella en entre era es esta este ha hay la las le lo los más me muy no nos o para pero por que se si sin sobre su sus también un una y ya".split()
)

#: Elements whose content is never text, those around boilerplate, around the article, and those that end a block.
SILENT = frozenset("script style noscript template svg canvas iframe object math head title select option textarea button audio video map".split())
OUTSIDE = frozenset("nav footer aside form dialog menu header".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Words in class, id or role that mark boilerplate, those that mark it unless the block reads like long prose, and of these the ones that also name subjects of articles.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notices?(?=$|\s)|outbrain|pagination|popup|replies|reply|respond|sharing|sidebar|signup|sponsor\w*|subscribe|taboola|toolbar|topbar|widget)(?=$|[\s_-])",
    re.IGNORECASE,
)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:disclaimer|header|legal|notice\w*|promo\w*|related|search|share|skip|social)(?=$|[\s_-])", re.IGNORECASE)
SUBJECTS = re.compile(r"(?:^|[\s_-])(?:legal|notice[_-]\w+|related|search|social)(?=$|[\s_-])", re.IGNORECASE)

#: What stands beside a copyright sign.
RIGHTS = re.compile(r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")

#: Marks that end a sentence, and characters of dense scripts, which count as DENSE letters.
SENTENCE = re.compile("[.!?…。！？｡।॥؟۔։།။។]")
DENSE, WIDE = 3, re.compile("[฀-໿က-႟ក-៿⺀-꓏가-힯豈-﫿\U00020000-\U0003ffff]")

#: Characters of a short and of a long block, link density that is boilerplate, and the shares of stop words that count as low and high.
SHORT, LONG, MOST_LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.4, 0.12, 0.2

#: Share of stop words in a page's unmarked text from which its language is a listed one, and words to a sentence mark that make prose in others.
LISTED, SENTENCE_WORDS = 0.04, 40

#: Share of the good text that <article> and <main> must hold to be believed.
LEAST_INSIDE = 1 / 3


class Block:
    __slots__ = ("doubtful", "heading", "inside", "linked", "marked", "parts", "size", "stops", "subject", "text", "words")

    def __init__(self, inside: bool, marked: bool, doubtful: bool, subject: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.inside, self.marked, self.doubtful, self.subject, self.heading, self.text = 0, inside, marked, doubtful, subject, heading, ""

    def close(self) -> None:
        self.text = SPACE.sub(" ", "".join(self.parts)).strip()
        wide = 0 if self.text.isascii() else len(WIDE.findall(self.text))
        words = LETTERS.findall(self.text.lower())
        self.size = len(self.text) + (DENSE - 1) * wide
        self.words = max(1, len(words), self.size // 8)
        self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))


class Open:
    """The open elements, with what is counted over them; an end tag costs what it closes."""

    def __init__(self):
        self.tags: list[tuple[str, bool, bool, int]] = []  # name, silent, marks boilerplate, marks it unless prose (2: a subject's name)
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # those that end a paragraph, and paragraphs
        self.silent = self.marked = self.doubtful = self.subjects = self.inside = self.links = self.headings = 0

    def enter(self, name: str, silent: bool, marks: bool, doubts: int) -> None:
        self.at.setdefault(name, []).append(len(self.tags))
        if name in BLOCKS:
            self.blocks.append(len(self.tags))
        self.tags.append((name, silent, marks, doubts))
        self._count(name, silent, marks, doubts, 1)

    def _count(self, name: str, silent: bool, marks: bool, doubts: int, by: int) -> None:
        self.silent += by * silent
        self.marked += by * marks
        self.doubtful += by * (doubts > 0)
        self.subjects += by * (doubts == 2)
        self.inside += by * (name in INSIDE)
        self.links += by * (name == "a")
        self.headings += by * (name in HEADINGS)

    def leave(self, to: int) -> None:
        while len(self.tags) > to:
            tag = self.tags.pop()
            self.at[tag[0]].pop()
            if tag[0] in BLOCKS:
                self.blocks.pop()
            self._count(*tag, -1)

    def end(self, name: str) -> None:
        if self.at.get(name):
            self.leave(self.at[name][-1])

    def end_paragraph(self, name: str) -> None:
        """An open paragraph, with what is open in it, ends where a block begins; so does a list item at the next one."""
        if self.blocks and self.tags[self.blocks[-1]][0] in (("p", "li") if name == "li" else ("p",)):
            self.leave(self.blocks[-1])


def _said(attributes: str) -> tuple[bool, str]:
    """(not shown, class, id and role) of a tag."""
    hidden, said = False, []
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            said.append(value)
        hidden |= name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and bool(UNSHOWN.search(value))
    return hidden, " ".join(said)


def _doubts(said: str) -> int:
    """0 if no word is doubtful, 2 if all that are can name a subject, else 1."""
    if not DOUBTFUL.search(said):
        return 0
    return 2 if not DOUBTFUL.search(SUBJECTS.sub(" ", said)) else 1


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with white space turned to single spaces and character references decoded. Takes time in proportion to the page."""
    found: list[Block] = []
    around = Open()
    now: Block | None = None
    at = 0

    def add(raw: str) -> None:
        nonlocal now
        if around.silent or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip():
                return
            # Every doubtful name around it must be one of subjects.
            now = Block(around.inside > 0, around.marked > 0, around.doubtful > 0, 0 < around.doubtful == around.subjects, around.headings > 0)
        now.parts.append(text)
        if around.links:
            now.linked += len(text.strip())

    def close() -> None:
        nonlocal now
        if now is not None:
            now.close()
            if now.text:
                found.append(now)
            now = None

    while (m := TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        if name == "br" and now is not None:
            now.parts.append(" ")
        if m[1]:
            around.end(name)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in BLOCKS:
            around.end_paragraph(name)
        hidden, said = _said(m[3]) if m[3] else (False, "")
        named = bool(said) and name not in ("html", "body", *INSIDE)
        # A page's own <header> is boilerplate, an article's is its heading.
        marks = name in OUTSIDE and not (name == "header" and around.inside) or named and bool(MARKED.search(said))
        around.enter(name, name in SILENT or hidden, marks, _doubts(said) if named else 0)
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    add(page[at:])
    close()
    return found


def listed(found: list[Block]) -> bool:
    """Whether the page's language is one with a list of stop words."""
    own = [b for b in found if not b.marked]
    words = sum(b.words for b in own)
    return sum(b.stops * b.words for b in own) >= LISTED * words


def decide(block: Block, by_stops: bool = True) -> str:
    """Pass one: good, bad, near (rather long or full of stop words) or short (ambiguous; inside, also one with few stop words)."""
    if block.marked or block.linked > MOST_LINKS * len(block.text):
        return "bad"
    signed = "©" in block.text and block.size < LONG
    ends = len(SENTENCE.findall(block.text)) if signed or block.doubtful or not by_stops else 0
    many, few = (block.stops >= MANY_STOPS, block.stops >= FEW_STOPS) if by_stops else (ends * SENTENCE_WORDS >= block.words, ends > 0)
    if signed and (RIGHTS.search(block.text) or not (few and ends)):
        return "bad"
    if block.doubtful:
        prose = many and ends and not block.linked
        return "good" if prose and block.size > (SHORT if block.inside and block.subject else LONG) else "bad"
    if block.size < SHORT:
        return "bad" if block.linked and not block.inside else "short"
    if many:
        return "good" if block.size > LONG or block.inside else "near"
    return "near" if few else "short" if block.inside else "bad"


def _sentence(block: Block) -> bool:
    """Whether a short block reads like a sentence."""
    return bool(SENTENCE.search(block.text)) and not block.linked and block.words > 1


def main_text(page: str | None) -> str:
    """The main blocks joined by line ends; empty for null, for pages without text and for those without main text."""
    found = blocks(page or "")
    by_stops = listed(found)
    labels = [decide(b, by_stops) for b in found]
    if any(b.inside for b in found):
        good = [(b.inside, b.size) for b, x in zip(found, labels, strict=True) if x == "good"]
        # A page that names its article has none of it outside; one whose <article> is a comment or a teaser doesn't name it.
        named = any(b.inside and not b.marked for b in found) and sum(n for i, n in good if i) >= LEAST_INSIDE * sum(n for _, n in good)
        for b in found:
            b.marked |= named and not b.inside
            b.inside &= named
        labels = [decide(b, by_stops) for b in found]
    if "good" not in labels:
        # A page of short blocks alone: the best it has is its text.
        labels = ["good" if x == "near" else x for x in labels]
    if "good" not in labels:
        labels = ["good" if x == "short" and _sentence(b) else x for b, x in zip(found, labels, strict=True)]
    # Marked blocks inside, as comments and forms, say nothing about the article around them.
    sure = [x if x in ("good", "bad") and not (b.inside and (b.marked or b.doubtful)) else None for b, x in zip(found, labels, strict=True)]
    # Nor does a single bad block between good ones, as a paragraph that is a link.
    known = [i for i, x in enumerate(sure) if x and found[i].inside]
    for i, j, k in zip(known, known[1:], known[2:], strict=False):
        if (labels[i], labels[j], labels[k]) == ("good", "bad", "good"):
            sure[j] = None

    def nearest(order: range) -> list[str | None]:
        last, was_inside, out = None, False, [None] * len(sure)
        for i in order:
            # Inside, only neighbours inside count.
            out[i] = last if not found[i].inside or was_inside else None
            last, was_inside = sure[i] or out[i], found[i].inside
        return out

    before, after = nearest(range(len(sure))), nearest(range(len(sure) - 1, -1, -1))
    kept = []
    for i, b in enumerate(found):
        around = {before[i] or "bad", after[i] or "bad"}
        if labels[i] == "near":
            good = "good" in around or before[i] is None and after[i] is None
        elif labels[i] == "short":
            # A heading goes with what follows it.
            good = b.inside and "bad" not in (before[i], after[i]) or around == {"good"} or b.heading and after[i] == "good"
        else:
            good = labels[i] == "good"
        if good:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (``page_id``, ``url``, ``html``).

    A null html is empty. Truncated and unclosed markup is read as far as it goes, in time that grows with the page alone.
    A block as far from neighbours of either kind counts both. Repeated rows and rows that share a page_id or have none
    each appear; an empty table gives an empty result. Further columns of ``pages``, whatever their names, are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(scan, "page_id long, url string, text string, n_chars long")
