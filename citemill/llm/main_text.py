"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read once into words and tags with the element each stands in. Elements that are never article text (scripts,
menus, forms, and elements whose class, id or role says advert, sidebar, comments and the like) fall out with all they
hold; of a header inside the article only its headings stay. A wrapper named like that which holds the page's article or
main element, or a first-level heading and a paragraph, stays. In what is left every word scores positive and every tag negative; a linear scan finds the
contiguous stretch with the highest sum (the first of equal ones), and the blocks it touches are the main text.

The weights come from labelled pages: pages with exactly one article (or else one main) element, which marks its content.
A word scores log(1 + inside / outside) by the block it stands in and whether it is in a link, a tag -log(1 + outside / inside) by its
name, where inside and outside are how often such words or tags stood inside and outside the content, plus one.
Words outside a page's only article or main element score 0. At most SAMPLE different labelled pages are learned from,
those with the smallest hashes of their html, copies once; with none, every word scores log 2 and every tag -log 2.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds. A
null or empty page, or one without words, has an empty text. Pages are read whole, whatever their length, in linear time.
Unclosed tags, elements and quotes are read as far as they make sense. Repeated rows give repeated results; a null
page_id or url stays. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import table

#: Labelled pages that are learned from, at most.
SAMPLE = 2000

# Names of HTML elements.
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes noembed".split())
NEVER = set("head script style title noscript template iframe object embed svg canvas math audio video map nav footer aside form button select textarea datalist dialog menu search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that the start of another one of the same list ends, and elements at which looking for them stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
BOUNDS = {"ul", "ol", "dl", "table", "select", "article", "section", "main", "body", "blockquote", "div", "td", "th"}
# Words in class and id, and roles, that mark what is not article text.
NOISE = re.compile(
    r"(?:ads?|adverts?|advert\w+|adbox|adslot|adsense|sponsor\w*|promos?|promotion\w*|banners?|cookies?|cookie\w+|consent|gdpr|notices?|notification\w*|alerts?|popups?|popover|modal|overlay|lightbox|"
    r"newsletter\w*|subscri\w+|signup|signin|login|paywall|sidebars?|sidebar\w+|sidenav|rail|widgets?|widget\w+|nav|navs|navbar\w*|navigation|topnav|menus?|menu\w+|submenu|breadcrumbs?|pagination|pager|"
    r"footers?|footer\w+|colophon|copyright|masthead|topbar|toolbar|comments?|commentlist|commentform|comment\w+|disqus\w*|respond|reply|replies|discussion|share|shares|sharing|sharebar|social\w*|"
    r"related|recommend\w*|trending|outbrain|taboola|searchform|searchbox|skiplink)"
)
HEADER = re.compile(r"headers?|siteheader|pageheader")
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())

_STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: What becomes of an element's own text.
OPEN, DROPPED, HEADINGS_ONLY = range(3)


@dataclass
class Element:
    name: str
    parent: Element | None
    block: str  # name of the nearest block it stands in
    link: bool
    noise: str = ""  # always, named or header
    holds: bool = False  # an article or main element
    marks: set[str] = field(default_factory=set)  # h1 and p, if it holds them
    fate: int = OPEN


@dataclass
class Page:
    #: (element, text or None, tag or None) in page order.
    items: list[tuple[Element, str | None, str | None]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", "") or ("", tag, attributes) of the whole page in order; tag is the name in lower case, after / where it ends."""
    at, size, pattern, lower, last = 0, len(html), _STRICT, None, html.rfind(">")
    while at < size:
        low = html.find("<", at)
        if low < 0:
            yield html[at:], "", ""
            return
        after = html[low + 1 : low + 2]
        if low > at:
            yield html[at:low], "", ""
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = size if end < 0 else end + 3
        elif after in ("!", "?") or (after == "/" and not html[low + 2 : low + 3].isalpha()):
            end = html.find(">", low)
            at = size if end < 0 else end + 1
        elif not (after == "/" or (after.isascii() and after.isalpha())):
            yield "<", "", ""
            at = low + 1
        elif low > last:  # a tag that never ends
            return
        else:
            found = pattern.match(html, low)
            if not found:
                pattern = _LOOSE  # a quote that never ends
                found = pattern.match(html, low)
            if not found:
                yield "<", "", ""
                at = low + 1
                continue
            name, at = found[2].lower(), found.end()
            yield "", found[1] + name, found[3]
            if name in RAW and not found[1] and not found[3].endswith("/"):
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == size else html.find(f"</{name}", at)
                at = size if end < 0 else end


def _noise(name: str, attributes: str) -> str:
    """Whether an element is no article text: always, named (by its class or id), header, or not at all."""
    if name in NEVER:
        return "named" if name == "form" else "always"
    found = "header" if name == "header" else ""
    if "=" not in attributes and "hidden" not in attributes:
        return found
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I) or values.get("role", "").lower() in ROLES:
        return "always"
    words = [w.lower() for w in _WORDS.findall(f"{values.get('class', '')} {values.get('id', '')}")]
    if name in ("html", "body", "main") or (name == "article" and not any(w.startswith("comment") for w in words)):
        return found
    if any(NOISE.fullmatch(w) for w in words):
        return "named"
    return "header" if name not in HEADINGS and any(HEADER.fullmatch(w) for w in words) else found


def parse(html: str) -> Page:
    """The words and tags of a page and the elements they stand in, what is dropped left out."""
    page, root = Page(), Element("", None, "", False)
    stack = [root]
    for text, tag, attributes in _tags(html):
        top = stack[-1]
        if text:
            page.items.append((top, text, None))
            continue
        if tag.startswith("/"):
            name = tag[1:]
            if any(e.name == name for e in stack[1:]):
                while stack.pop().name != name:
                    pass
            page.items.append((stack[-1], None, tag))
            continue
        if tag in BLOCKS and (inner := _open(stack, {"p"}, BOUNDS)):
            del stack[inner:]
        if tag in ENDS and (inner := _open(stack, ENDS[tag], BOUNDS - ENDS[tag])):
            del stack[inner:]
        top = stack[-1]
        element = Element(tag, top, tag if tag in BLOCKS else top.block, top.link or tag == "a", _noise(tag, attributes))
        page.elements.append(element)
        page.items.append((element, None, tag))
        if tag in ("article", "main") and element.noise not in ("always", "named"):
            above: Element | None = top
            while above and not above.holds:
                above.holds, above = True, above.parent
        if tag in ("h1", "p"):
            above = top
            while above and tag not in above.marks:
                above.marks.add(tag)
                above = above.parent
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
    _settle(page)
    page.items = [x for x in page.items if x[0].fate == OPEN]
    return page


def _open(stack: list[Element], names: set[str], bounds: set[str]) -> int:
    """The place in the stack of the outermost open element of those names before a bound; 0 for none."""
    found = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in names:
            found = k
        elif stack[k].name in bounds:
            break
    return found


def _settle(page: Page) -> None:
    """Gives every element its fate; parents come before what they hold."""
    inside: set[int] = set()  # ids of elements in an article or main
    for e in page.elements:
        above = e.parent.fate if e.parent else OPEN
        if e.name in ("article", "main") or id(e.parent) in inside:
            inside.add(id(e))
        if above == DROPPED or e.noise == "always" or (e.noise == "named" and not e.holds and len(e.marks) < 2):
            e.fate = DROPPED
        elif e.noise == "header" and not e.holds:
            e.fate = HEADINGS_ONLY if id(e.parent) in inside else DROPPED
        else:
            e.fate = OPEN if above == HEADINGS_ONLY and e.name in HEADINGS else above


def content(page: Page) -> set[int] | None:
    """ids of the elements in the page's only article, or else its only main element; None where neither is alone."""
    kept = [e for e in page.elements if e.fate == OPEN]
    for name in ("article", "main"):
        marks = [e for e in kept if e.name == name]
        if len(marks) == 1:
            inside = {id(marks[0])}
            for e in page.elements:
                if id(e.parent) in inside:
                    inside.add(id(e))
            return inside
    return None


def _key(element: Element, tag: str | None) -> str:
    """What a word or tag is weighted by."""
    if tag is None:
        return f"word {element.block or '-'}{' link' if element.link else ''}"
    name = tag.lstrip("/")
    return f"tag {'/' if tag.startswith('/') else ''}{name if name in BLOCKS or name in INLINE else 'other'}"


def labelled_counts(html: str) -> dict[str, list[int]]:
    """By key, how many words and tags of a labelled page stand inside and outside its content; empty for other pages."""
    page = parse(html)
    inside = content(page)
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    if inside is not None:
        for element, text, tag in page.items:
            # The content's own first tag stands outside it.
            within = id(element) in inside and not (tag in ("article", "main") and id(element.parent) not in inside)
            found[_key(element, tag)][0 if within else 1] += len(text.split()) if text else tag is not None
    return found


def weight(key: str, inside: int = 0, outside: int = 0) -> float:
    odds = (inside + 1) / (outside + 1)
    return math.log1p(odds) if key.startswith("word") else -math.log1p(1 / odds)


def best(scores: list[float]) -> tuple[int, int]:
    """First and last place of the stretch with the highest positive sum, the first of equal ones; (0, -1) if there is none."""
    top, first, last, total, begun = 0.0, 0, -1, 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, begun = 0.0, k
        total += score
        if total > top:
            top, first, last = total, begun, k
    return first, last


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    page = parse(html or "")
    inside = content(page)
    blocks: list[list[str]] = [[]]
    scores, places = [], []
    for element, text, tag in page.items:
        key = _key(element, tag)
        score = weights.get(key, weight(key))
        if tag is None:
            decoded = entities.unescape(text)
            blocks[-1].append(decoded)
            score *= len(decoded.split()) if inside is None or id(element) in inside else 0
        elif tag.lstrip("/") in BLOCKS:
            blocks.append([])
        elif tag == "br":
            blocks[-1].append(" ")
        scores.append(score)
        places.append(len(blocks) - 1)
    first, last = best(scores)
    if last < first:
        return ""
    lines = (" ".join("".join(parts).split()) for parts in blocks[places[first] : places[last] + 1])
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights by key, from at most sample different labelled pages of pages (html)."""
    ship(pages.sparkSession)
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64("html").alias("h"), "html")
    cut = marked.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h.as_py(), key, *n) for h, html in zip(batch.column(0), batch.column(1), strict=True) for key, n in labelled_counts(html.as_py()).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "key", "inside", "outside"), r, strict=True)) for r in rows], pa.schema([("h", pa.int64()), ("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]))

    counted = marked.where(F.col("h") <= cut).mapInArrow(run, "h long, key string, inside long, outside long").dropDuplicates(["h", "key"])
    found = counted.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()  # a few hundred keys: pairs of element names
    return {r.key: weight(r.key, r.inside, r.outside) for r in found}


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return main_text(pages, fit(pages))
