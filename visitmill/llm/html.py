"""Main text of web pages by two passes of block rules.

First pass: the page is cut into blocks at block-level tags. Structure that is never article (menus, page headers, footers, sidebars,
forms, scripts, and elements that class, id or role call notices, adverts or comments) and blocks that are mostly links are bad; long
or stop-word rich blocks are good; short or poor ones stay open. Second pass: an open block takes the label of the nearest decided
block; in an article it is bad only if its decided neighbours on both sides are. Where a page marks an article, what stands outside of it is not main text.

Defined cases: null or empty html gives empty text. Tags that are never closed end with their container; a tag or comment that the
page's end cuts off is dropped, a cut-off character reference is text. Rows are independent: null and repeated ids and urls pass.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Very frequent words of four languages.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one
all we can her has there been if more when will would who so no
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch
le la les de des du et un une en est que qui dans pour pas au sur ne se ce il sont plus par je avec tout faire son mais ou nous comme
el los las y que del se por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta
""".split())

# What tags and names stand for.
BLOCK_TAGS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("""article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section
select table ul""".split())
NEVER = frozenset("nav aside footer form menu dialog fieldset select head".split())
RAW = frozenset("script style noscript template title textarea iframe object svg math button canvas audio video".split())
SWALLOWING = frozenset("script style".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# What wraps whole pages, or is left open, often enough that the text it holds may speak for it.
DOUBTFUL = frozenset("nav form header menu fieldset navigation banner menubar".split())
BAD_WORDS = re.compile(
    r"(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promos?|promot\w*|side(?:bar)?s?|nav\w*|menus?|breadcrumbs?|cookies?|consent|"
    r"gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|newsletters?|subscri\w*|signup|login|comments?|commentlist|replies|respond|"
    r"disqus|shar(?:e|ing)|social|related|recommend\w*|footers?|widgets?|toolbars?|pag(?:ination|er)|copyright|legal|disclaimers?|masthead|"
    r"skip|search|forms?)\d*")
# Words that say how a thing looks or where it stands; the word before them says what it is.
PLAIN_WORDS = frozenset("""area bar block body bottom box buttons button cell class col column container content desktop fixed group holder icon icons
inner item items large left line link links list media mobile outer panel primary right row secondary section slot small space sticky strip
text title top unit wrap wrapper""".split())
TELLING_FIRST = re.compile(r"related|recommend\w*|sponsor\w*|promot\w*|advertis\w*|adverts?|ads?|comments?|cookies?")
STORY_WORDS = frozenset("article blog content entry main page post story".split())
STATES = frozenset("has with without no is js show hide open closed free enabled disabled".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+\d*|[A-Z]+(?![a-z])\d*|\d+")

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

LONG, RICH, SHORT, LINKS = 200, 0.12, 60, 0.5
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Element:
    name: str
    above: "Element | None"
    bad: bool
    region: int
    doubtful: bool = False
    closed: bool = False
    #: Text that stands in it and in nothing worse, whether part of it reads as an article, whether an article begins in it.
    held: int = 0
    reads: bool = False
    story: bool = False
    #: The innermost element around the text, itself included, that is told to hold no main text.
    judged: "Element | None" = None


@dataclass
class Block:
    text: str
    linked: int
    element: Element
    tag: str
    own_bad: bool
    bad: bool = False
    label: int = OPEN

    @property
    def region(self) -> int:
        return self.element.region


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _is_bad_name(token: str) -> bool:
    """Whether a class or id names no main text. The last telling word decides: ``search-engine-post`` is a post."""
    words = [w.lower() for w in NAME_WORD.findall(token)]
    if not words or words[0] in STATES or words[-1] in STATES:
        return False
    told = list(words)
    while len(told) > 1 and (told[-1] in PLAIN_WORDS or told[-1].isdigit()):
        told.pop()
    if BAD_WORDS.fullmatch(told[-1]):
        return True
    return bool(TELLING_FIRST.fullmatch(words[0])) and told[-1] not in ("article", "story", "entry")


def _is_header_name(token: str) -> bool:
    words = [w.lower() for w in NAME_WORD.findall(token)]
    return words[-1:] in (["header"], ["siteheader"], ["pageheader"], ["topheader"]) and set(words[:-1]) <= {"site", "page", "top"}


def _hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""))))


def _is_bad(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is told to hold no main text. inside: it stands in an article."""
    if name in ("html", "body", "main"):
        return False
    if name in NEVER or name == "header" and not inside or attributes.get("role", "").lower() in BAD_ROLES or _hidden(attributes):
        return True
    called = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return any(_is_bad_name(c) or not inside and _is_header_name(c) for c in called)


def _is_doubtful(name: str, attributes: dict[str, str]) -> bool:
    called = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    told = name in DOUBTFUL or attributes.get("role", "").lower() in DOUBTFUL
    return told and not _hidden(attributes) and (name in DOUBTFUL or not any(map(_is_bad_name, called)))


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where a tag ends: at a > outside of quoted values. A quote opens a value only behind =, and only if it is closed at all."""
    while found := STOP.search(page, at):
        at, mark = found.end(), found[0]
        if mark == ">":
            return at
        if at <= last[mark]:
            before = found.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=":
                at = page.index(mark, at) + 1
    return len(page) + 1


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, tag name, inside of the tag, end) in page order; the name of a closing tag begins with /. No character is looked at
    more than a few times: nothing is searched again behind an end that is not there."""
    last = {mark: page.rfind(mark) for mark in "\"'"}
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], "", "", size
            return
        text, follows = page[at:start], page[start + 1: start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield text, "", "", at
            continue
        closing = follows == "/"
        name = NAME.match(page, start + 1 + closing)
        if not name:
            if follows in ("!", "?", "/"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                text, at = (text, size) if not follows else (text + "<", start + 1)
            yield text, "", "", at
            continue
        end = _tag_end(page, name.end(), last)
        at, tag = min(end, size), name[0].lower()
        if end > size:
            yield text, "", "", at
            return
        inside = page[name.end(): at - 1]
        if tag in RAW and not closing and not inside.endswith("/") and tag not in unclosed:
            found = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.IGNORECASE).search(page, at)
            if found:
                end = page.find(">", found.end())
                at = size if end < 0 else end + 1
            elif tag in SWALLOWING:
                at = size
            else:
                unclosed.add(tag)  # a button or a picture that never ends is no reason to lose the rest
        yield text, "/" * closing + tag, inside, at


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. region numbers the article they stand in, 0 is outside."""
    out: list[Block] = []
    root = Element("", None, False, 0)
    stack, seen = [root], [root]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = regions = 0
    own_bad, tag = False, ""  # of an open p, li or heading with a telling name

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), stack[-1], tag, own_bad))
        parts.clear()
        linked = 0

    for text, name, inside, _ in tokens(page):
        if text:
            parts.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))
        closing, name = name.startswith("/"), name.lstrip("/")
        if name in RAW:
            parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in CONTAINERS:
            flush()
            own_bad, in_link, tag = False, 0, name
            if closing:
                if depth[name]:
                    stack[-1].closed = stack[-1].name == name
                    while stack[-1].name != name:
                        depth[stack.pop().name] -= 1
                    depth[name] -= 1
                    stack.pop().closed = True
                continue
            if inside.endswith("/") and name != "div":
                continue
            attributes = _attributes(inside) if inside.strip() else {}
            above = stack[-1]
            bad = _is_bad(name, attributes, above.region > 0)
            region = above.region
            if not bad and not region and (name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")):
                regions += 1
                region = regions
            stack.append(Element(name, above, bad, region, bad and _is_doubtful(name, attributes)))
            stack[-1].judged = stack[-1] if bad else above.judged
            seen.append(stack[-1])
            depth[name] += 1
        elif name in BLOCK_TAGS:
            flush()
            attributes = {} if closing or not inside.strip() else _attributes(inside)
            own_bad = bool(attributes) and _is_bad(name, attributes, stack[-1].region > 0)
            tag = "" if closing else name
    flush()
    # What the page's end leaves open is no worse than the rest of the page; what a closing tag around it ended is in doubt.
    still_open = {id(e) for e in stack}
    for element in seen:
        if element.bad and not element.closed and id(element) not in still_open and element.name not in ("select", "head"):
            element.doubtful = True
    _acquit(out, seen)
    return out


def _acquit(found: list[Block], seen: list[Element]) -> None:
    """Structure is evidence, not verdict: a form, menu or header that holds most of the page's running text, some of it like an
    article's, is none. Inner elements are judged first; what an acquitted one holds counts for the one around it."""
    total = outside = article = 0
    for block in found:
        if block.own_bad or block.linked > LINKS * len(block.text):
            continue
        holder, plain = block.element.judged, len(block.text) - block.linked
        if holder:
            holder.held += plain
            holder.reads = holder.reads or _is_rich(block.text) and len(block.text) >= 2 * SHORT
            total += plain if holder.doubtful else 0
        else:
            total += plain
            outside += plain
            article += plain if block.region and block.tag not in HEADINGS else 0
    for element in reversed(seen):
        if element.above and (element.story or element.name in ("article", "main")) and not (element.bad and not element.doubtful):
            element.above.story = True
        if not (element.bad and element.doubtful and element.reads and 2 * element.held > total):
            continue
        if not element.story and (article or outside and element.closed):
            continue
        element.bad = False
        if element.above.judged:
            element.above.judged.held += element.held
            element.above.judged.reads = True
    # From the outside in: whether anything bad is around, and the article an acquitted element stands around.
    regions = max((e.region for e in seen), default=0)
    for element in seen[1:]:
        element.bad = element.bad or element.above.bad
        element.region = element.region or element.above.region
        if not element.bad and not element.region and element.name in ("article", "main"):
            regions += 1
            element.region = regions
    for block in found:
        block.bad = block.own_bad or block.element.bad


def _is_rich(text: str) -> bool:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / max(1, len(words)) >= RICH


def _decide(block: Block) -> int:
    """First pass."""
    if block.bad or block.linked > LINKS * len(block.text):
        return BAD
    rich = _is_rich(block.text)
    if block.region:
        return GOOD if rich and len(block.text) >= SHORT or len(block.text) >= LONG else OPEN
    return (GOOD if rich else BAD) if len(block.text) >= LONG else GOOD if rich and len(block.text) >= 2 * SHORT else OPEN


def _neighbours(found: list[Block], decided: list[int], within: bool) -> list[list[tuple[int, int]]]:
    """For each block, distance and label of the nearest decided block on each side, of its own region if within."""
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            region = found[i].region if within else 0
            if region in last:
                out[i].append((abs(i - last[region]), decided[last[region]]))
            if decided[i] != OPEN:
                last[region] = i
    return out


def label(found: list[Block]) -> list[Block]:
    """Second pass: labels for all blocks."""
    for block in found:
        block.label = _decide(block)
    # An article is marked only by more than its headings, unless the page has nothing else that reads as one.
    clear_outside = any(b.label == GOOD and not b.region for b in found)
    marked = any(b.region and b.label != BAD and not (clear_outside and b.tag in HEADINGS) for b in found)
    good_regions = {b.region for b in found if b.region and b.label == GOOD}
    nothing_clear = not marked and not clear_outside
    # What structure rules out inside an article (an advert, say) tells nothing of the text around it.
    inner = _neighbours(found, [OPEN if b.bad else b.label for b in found], True)
    outer = _neighbours(found, [b.label for b in found], False)
    for i, block in enumerate(found):
        if marked and not block.region:
            block.label = BAD
        elif block.label == OPEN and block.region:
            # Between bad neighbours only; an article without a single clear block is all there is.
            lost = block.region in good_regions and len(inner[i]) == 2 and all(x == BAD for _, x in inner[i])
            block.label = BAD if lost else GOOD
        elif block.label == OPEN and nothing_clear:
            # A short page: its headings, paragraphs and sentences are its text.
            block.label = GOOD if block.tag in PROSE or block.tag and block.text.endswith((".", "!", "?")) else BAD
        elif block.label == OPEN:
            block.label = min(outer[i], key=lambda x: (x[0], -x[1]))[1] if outer[i] else BAD
    return found


def main_text(page: str | None) -> str:
    """The page's main text: good blocks in page order, joined by one blank."""
    return " ".join(b.text for b in label(blocks(page or "")) if b.label == GOOD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; html is read whole."""
    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
