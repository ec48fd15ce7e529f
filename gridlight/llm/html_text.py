"""Main text of web pages (operator 2) by two passes of block rules.

The markup is cut into text blocks. The first pass decides blocks by their length and their densities of
stop words and link text; blocks inside page furniture are decided by that. Blocks that stay ambiguous
inherit, in the second pass, the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with his they at be this have from or one had by but not what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know
    der die das und ist in den von zu mit sich auf für nicht es dem ein eine als auch an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei im des
    le la les de des un une et est dans que qui pour pas sur au avec il ce se ne plus par je son en du sont aux mais ou comme leur nous vous ses cette elle été être
    el los las un una y es que de del en por con para su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy
    """.split()
)
#: Elements that begin and end blocks, that hold no text, and that are page furniture.
BLOCKS = frozenset("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object embed audio video canvas select textarea button".split())
FURNITURE = frozenset("nav footer header aside form menu dialog".split())
ASIDE = frozenset("footer aside form dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
CLOSING = frozenset("p li td tr dd dt option".split())
BARRIER = ("ul", "ol", "table", "dl", "article", "section", "div", "body", "nav", "footer", "header", "aside", "form", "main")
#: Whole tokens of class, id and role attributes that mark furniture.
MARKS = frozenset("ad-slot ad-banner ad-container cookie-banner cookie-notice cookie-consent site-header site-footer page-header page-footer global-header global-footer main-nav main-menu site-nav nav-menu nav-bar left-sidebar right-sidebar sidebar-left sidebar-right comment-list comments-area comment-form related-posts related-articles share-buttons social-share social-links newsletter-signup skip-link ad ads advert advertisement adsbygoogle sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended footer header masthead share sharing social comment comments disqus respond reply replies pagination pager toolbar search complementary contentinfo alert".split())

#: Words that mark furniture at the beginning or the end of a token with hyphens, and words beside them that say otherwise.
MARK_WORDS = frozenset("ad ads advert adverts advertisement comment comments sidebar newsletter cookie cookies consent promo sponsor sponsored related recommended breadcrumb breadcrumbs share sharing social pagination disqus reply replies navbar navigation popup subscribe signup".split())
DENIED = frozenset("has no non not with without enable enabled disable disabled show hide".split())
PLAIN = frozenset("layout page body main content article post story text entry title open active".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
#: Letters up to U+024F are Latin ones.
_LATIN, _OTHER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[^\\W\\d_A-Za-zÀ-ÖØ-öø-ɏ]")
_FOREIGN = re.compile(".*?[^\\W\\d_A-Za-zÀ-ÖØ-öø-ɏ]", re.DOTALL)


@dataclass(frozen=True)
class Settings:
    """Thresholds of the block rules: lengths in characters, densities as shares of words or characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.22
    link_most: float = 0.5


@dataclass
class Block:
    """A run of text between block boundaries, and where it stands."""

    text: str
    linked: int  # characters of it inside links
    furniture: bool  # inside menus, footers, adverts, forms and such
    main: int  # number of the outermost article or main element around it, 0 outside
    outer: bool  # that element is itself inside furniture
    label: str = ""


@lru_cache(50_000)
def is_mark(token: str) -> bool:
    """Whether a token of a class, id or role marks furniture: as a whole, or by its first or last word."""
    if token in MARKS:
        return True
    words = re.split(r"[-_]+", token)
    if len(words) < 2 or DENIED.intersection(words):
        return False
    return words[-1] in MARK_WORDS or words[0] in MARK_WORDS and not PLAIN.intersection(words)


def read_attributes(said: str) -> tuple[bool, bool]:
    """(marks furniture, hides what is inside) by an element's attributes; only the values that say so are looked at."""
    marked = hidden = False
    for name, value in _ATTRIBUTE.findall(said):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            marked = marked or any(map(is_mark, value.split()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            hidden = True
    return marked, hidden


def _close_raw(markup: str, name: str, at: int) -> int:
    """Where the raw text of an element ends: its end tag, or else the end of the page."""
    found = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(markup, at)
    return found.start() if found else len(markup)


def blocks_of(markup: str) -> list[Block]:
    """The text blocks of a page in order, without the text of scripts, styles and hidden elements.

    Unclosed elements end with the element around them, and what was opened inside a closed element
    closes with it. The inside of an unclosed tag is markup. Time is linear in the page: open elements are
    counted by name, so an end tag that closes nothing costs nothing.
    """
    out: list[Block] = []
    text: list[str] = []
    linked = at = 0
    mains = 0
    #: Open elements: name, hidden, furniture by element or mark, number of the main element, that one inside furniture, link, furniture that no article leaves
    stack: list[tuple[str, bool, bool, int, bool, bool, bool]] = [("", False, False, 0, False, False, False)]
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                top = stack[-1]
                out.append(Block(joined, linked, top[2], top[3], top[4]))
            text.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        top = stack[-1]
        if piece and not top[1]:
            said = html.unescape(piece) if "&" in piece else piece
            text.append(said)
            if top[5]:
                linked += len(said.strip())

    def close(name: str, barrier: tuple[str, ...] = ()) -> None:
        if not opened.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                for s in stack[k:]:
                    opened[s[0]] -= 1
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    size = len(markup)
    while at < size:
        m = _TOKEN.search(markup, at)
        if not m:
            take(markup[at:])
            break
        take(markup[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes its element and what is open inside; one that closes nothing is ignored
            if name in BLOCKS:
                flush()
            close(name)
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSING:  # these close an open one of their kind
                close(name, BARRIER)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            at = _close_raw(markup, name, at)
        top = stack[-1]
        marked, hiding = read_attributes(m[3]) if m[3] else (False, False)
        hidden = top[1] or name in HIDDEN or hiding
        if name == "body":
            hidden = False  # an unclosed head ends here
        furniture = top[2] or (name in FURNITURE and not (name == "header" and top[3])) or marked and name not in ("html", "body")
        main, outer = top[3], top[4]
        if name in MAIN and not main:  # what is around the outermost article or main element is looked at for the page as a whole
            mains += 1
            main, outer, furniture = mains, top[2], marked or top[6]
        stack.append((name, hidden, furniture, main, outer, top[5] or name == "a", top[6] or name in ASIDE))
        opened[name] = opened.get(name, 0) + 1
    flush()
    if any(b.main and not b.outer for b in out):  # else a wrapper of the whole page has the mark, or is an unclosed menu
        for b in out:
            b.furniture = b.furniture or b.outer
    return out


def _density(text: str) -> float:
    """The share of stop words among the words of a text; 0 without words."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0


def classify(blocks: list[Block], settings: Settings = Settings()) -> None:
    """First pass: labels 'good', 'bad', 'near' (longer, but undecided) or 'short'.

    Furniture is bad, and outside articles so are blocks of links. Otherwise stop words decide, everywhere: outside
    articles a block needs many and length to be good, and one with few is bad; inside an article or main element
    some stop words make a longer block good, and one with few stays undecided. On a page without a long block of that
    density (a language akin to the known ones) the densest of its long blocks set the measure; blocks in other
    scripts, which these words don't fit, go by length and links.
    """
    dense = [_density(b.text) for b in blocks]
    top = max((d for b, d in zip(blocks, dense) if not b.furniture and len(b.text) > settings.long and b.linked <= settings.link_most * len(b.text)), default=0.0)
    high = 0.8 * top if settings.stop_low <= top < settings.stop_high else settings.stop_high
    for b, stops in zip(blocks, dense):
        links = b.linked > settings.link_most * len(b.text)
        if b.furniture or links and not b.main:
            b.label = "bad"
        elif len(b.text) < settings.short or links:
            b.label = "short"
        elif not stops and _FOREIGN.match(b.text) and len(_OTHER.findall(b.text)) > len(_LATIN.findall(b.text)):
            b.label = "good" if b.main or len(b.text) > settings.long else "near"
        elif stops >= high and (b.main or len(b.text) > settings.long) or b.main and stops >= settings.stop_low:
            b.label = "good"
        else:
            b.label = "near" if b.main or stops >= settings.stop_low else "bad"


def inherit(blocks: list[Block]) -> list[bool]:
    """Second pass: whether each block is main text; an ambiguous one follows its nearest decided neighbours, at any distance.

    Inside an article or main element only the element's own text counts as a neighbour, not the furniture that stands in it, and
    an article is wanted whole: its titles, lists of links and tables, which have no stop words, are text. Elsewhere 'near' blocks
    are text if either neighbour is, 'short' ones if both are; a page's end is no text. Without any decided block the 'near' ones are text.
    """
    decided = any(b.label in ("good", "bad") for b in blocks)

    def nearest(order: Iterator[int]) -> list[str]:
        """For each block the last decided label met before it in ``order``."""
        found, last = [""] * len(blocks), "bad"
        for k in order:
            found[k] = last
            if blocks[k].label in ("good", "bad"):
                last = blocks[k].label
        return found

    befores, afters = nearest(iter(range(len(blocks)))), nearest(reversed(range(len(blocks))))
    out = []
    for b, before, after in zip(blocks, befores, afters):
        if b.label in ("good", "bad"):
            out.append(b.label == "good")
        elif b.main:
            out.append(True)
        elif b.label == "near":
            out.append("good" in (before, after) or not decided)
        else:
            out.append(before == after == "good")
    return out


def main_text(markup: str | None, settings: Settings = Settings()) -> str:
    """The page's main text: its blocks joined by newlines; an empty text if there is none."""
    blocks = blocks_of(markup or "")
    classify(blocks, settings)
    return "\n".join(b.text for b, kept in zip(blocks, inherit(blocks)) if kept)


def extract(pages: DataFrame, settings: Settings = Settings(), source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a string column ``out``, the main text of each page; a null page has an empty text.

    Other columns pass through; one named ``out`` is replaced. Pages are independent of each other.
    """
    plain = pages.drop(out)
    names = plain.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, settings) for h in batch.column(names.index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    return plain.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{out}` string")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
