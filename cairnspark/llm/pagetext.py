"""Main text of HTML pages: parser events make lines, text-to-tag ratios choose the content region."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.text import bounded_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: What is in them is no text of the page.
_SILENT = frozenset(
    "audio button canvas datalist head iframe math noscript object option script select style svg template textarea title video".split()
)
#: Parts around an article.
_AROUND = frozenset("aside dialog footer menu nav".split())
_CONTENT = frozenset(["article", "main"])
_ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words in a class or id that name parts around an article,
_NAMES = frozenset(
    "ad ads adsbox advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted "
    "related replies responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: and words that may go with them.
_FILLERS = frozenset(
    "area bar block bottom box button buttons container content form global group inner item items left link links list main "
    "page post primary right secondary section side site the this top wrap wrapper".split()
)
_PARAGRAPH = frozenset(
    "blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre summary table tbody td tfoot th thead tr ul".split()
)
_SPLIT = re.compile(r"[^a-z]+")
#: A paragraph ends where the next one starts, also without its end tag.
_ENDS_ITSELF = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}

#: How a part of the page stands: its text counts, counts if its own ratio is high, or does not count.
PLAIN, DOUBTFUL, AROUND = 2, 1, 0
#: What the ratio of a doubtful line is multiplied with.
DOUBT = 0.25
#: A child element with this share of the seeds' text is the region instead of its parent.
NEARLY_ALL = 0.95


@dataclass
class Element:
    tag: str
    parent: int
    standing: int  #: its own; AROUND also if that of a parent is
    doubt: int  #: the outermost doubtful element around it or itself, 0 if none
    content: int  #: the article or main element around it or itself, 0 if none


@dataclass
class Line:
    """A block of text between two block tags."""

    text: str
    tags: int  #: tags since the last line, and inside this one
    linked: int  #: letters inside links
    element: int  #: the block element around it, or a part that does not count


def _standing(tag: str, attrs: dict[str, str | None]) -> int:
    """What the element itself says about its text."""
    role = (attrs.get("role") or "").lower()
    if tag in _AROUND or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return AROUND
    if tag in ("html", "body", *_CONTENT):
        return PLAIN
    found = DOUBTFUL if tag == "form" or role == "form" else PLAIN
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
        if any(w in _NAMES for w in words):
            if all(w in _NAMES or w in _FILLERS for w in words):
                return AROUND
            found = DOUBTFUL  # a name inside a longer one may mean something else
    return found


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, PLAIN, 0, 0)]
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element around its text, whether it is silent
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1][1]))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            if tag in _ENDS_ITSELF and self.stack[-1][0] in _ENDS_ITSELF[tag]:
                self.leave()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        _, at, silent = self.stack[-1]
        around = self.elements[at]
        standing = _standing(tag, dict(attrs))
        if tag == "header" and not around.content:
            standing = AROUND
        if tag in _BLOCK or standing != PLAIN:
            if tag not in _BLOCK:
                self.flush()  # an inline part that stands differently is a line of its own
            number = len(self.elements)
            doubt = around.doubt or (number if standing == DOUBTFUL else 0)
            content = number if tag in _CONTENT and not (around.content and tag == "main") else around.content
            self.elements.append(Element(tag, at, min(standing, around.standing) if around.standing == AROUND else standing, doubt, content))
            at = number
        self.stack.append((tag, at, silent or tag in _SILENT))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def leave(self) -> str:
        gone, at, _ = self.stack[-1]
        if at != self.stack[-2][1] and gone not in _BLOCK:
            self.flush()
        self.stack.pop()
        self.open[gone] -= 1
        return gone

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        if self.open[tag]:
            while self.leave() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def page_lines(html: str) -> tuple[list[Line], list[Element]]:
    """The lines of a page and its block elements, parents before their children; 0 is the page."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines, parser.elements


def smoothed(values: list[float], radius: int = 1) -> list[float]:
    """Gaussian smoothing with standard deviation ``radius``, cut at twice that; the ends repeat."""
    reach = 2 * radius
    kernel = [math.exp(-(d * d) / (2 * radius * radius)) for d in range(-reach, reach + 1)]
    padded = [values[0]] * reach + values + [values[-1]] * reach if values else []
    return [sum(k * v for k, v in zip(kernel, padded[i:])) / sum(kernel) for i in range(len(values))]


def threshold(values: list[float]) -> float:
    """Where the means of the values below and above are equally far away, from the standard deviation on.

    If all values are equal it is that value, so none lies below.
    """
    mean = sum(values) / len(values)
    found = min(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)), max(values))
    for _ in range(20):
        low, high = [v for v in values if v < found], [v for v in values if v >= found]
        if not low or not high:
            break
        moved = min((sum(low) / len(low) + sum(high) / len(high)) / 2, max(values))
        if moved == found:
            break
        found = moved
    return found


def standings(lines: list[Line], elements: list[Element]) -> list[int]:
    """How each line stands. A doubtful element that holds most of the page's text is in no doubt."""
    letters = [0] * len(elements)
    for line in lines:
        if elements[line.element].standing != AROUND:
            letters[line.element] += len(line.text)
    for i in range(len(elements) - 1, 0, -1):
        letters[elements[i].parent] += letters[i]

    in_doubt = [False] * len(elements)  # parents come first
    for i, e in enumerate(elements):
        own = e.standing == DOUBTFUL and 2 * letters[i] <= letters[0]
        in_doubt[i] = own or (i > 0 and in_doubt[e.parent])
    return [AROUND if elements[x.element].standing == AROUND else DOUBTFUL if in_doubt[x.element] else PLAIN for x in lines]


def content_seeds(lines: list[Line], standing: list[int]) -> list[bool]:
    """Whether a line's smoothed text-to-tag ratio lies in the upper of two clusters.

    Ratios are taken as logarithms, so that one very long paragraph does not leave the others in the
    lower cluster. A doubtful line must get there by a quarter of its own ratio; a line of a part around the
    article has the ratio 0.
    """
    own = [math.log1p(len(x.text) / max(1, x.tags)) if s else 0.0 for x, s in zip(lines, standing)]
    if not any(own):
        return [False] * len(lines)
    smooth = smoothed(own)
    less = [math.log1p(DOUBT * math.expm1(v)) for v in own]
    values = [0.0 if s == AROUND else min(v, w) if s == DOUBTFUL else v for v, w, s in zip(smooth, less, standing)]
    least = threshold(values)
    return [v >= least and v > 0 for v in values]


def regions(lines: list[Line], elements: list[Element], seeds: list[bool]) -> set[int]:
    """The elements whose lines are content.

    Articles and main parts with seeds, if they hold half of the seeds' text. Otherwise the smallest
    element around nearly all of it, but no paragraph: the common parent of the seeds.
    """
    weight = [0] * len(elements)
    for line, seed in zip(lines, seeds):
        weight[line.element] += len(line.text) * seed
    articles: Counter[int] = Counter()
    for i, w in enumerate(weight):
        if w and elements[i].content:
            articles[elements[i].content] += w
    if 2 * articles.total() >= sum(weight) > 0:
        return set(articles)
    best = [0] * len(elements)  # the child with the most
    for i in range(len(elements) - 1, 0, -1):
        parent = elements[i].parent
        weight[parent] += weight[i]
        if not best[parent] or weight[i] >= weight[best[parent]]:
            best[parent] = i
    at = 0
    while best[at] and weight[best[at]] >= NEARLY_ALL * weight[at] and elements[best[at]].tag not in _PARAGRAPH:
        at = best[at]
    return {at}


def main_text(html: str | None) -> str:
    """The blocks of the content regions, joined by two line feeds.

    A line is a block of text. Its ratio of letters to tags, smoothed over its neighbours, is high or
    low; the high ones are seeds, see ``content_seeds``. The region is an article or the seeds' common
    parent, see ``regions``. All its lines are content, short ones too, other than: lines of parts around
    an article (menus, page headers, footers, sidebars, notices, adverts, comments) and of forms
    or other doubtful parts, unless they are seeds; and, outside of articles, children of the region
    without any seed that hold blocks of their own, or mostly links.
    """
    lines, elements = page_lines(html or "")
    standing = standings(lines, elements)
    seeds = content_seeds(lines, standing)
    if not any(seeds):
        return ""
    chosen = regions(lines, elements, seeds)
    inside = [0] * len(elements)  # the child of a region around each element; -1 outside of all
    for i, e in enumerate(elements):
        inside[i] = i if i in chosen else -1 if not i else i if e.parent in chosen else inside[e.parent]
    with_seeds = {inside[x.element] for x, seed in zip(lines, seeds) if seed}
    nested = {inside[e.parent] for e in elements[1:] if inside[e.parent] >= 0 and e.parent not in chosen}

    def counts(i: int, line: Line) -> bool:
        if seeds[i]:
            return True
        part = inside[line.element]
        if standing[i] != PLAIN or part < 0:
            return False
        if part in with_seeds or part in chosen or elements[part].content or elements[part].tag in _PARAGRAPH:
            return True
        return part not in nested and 2 * line.linked < len(line.text)

    return "\n\n".join(x.text for i, x in enumerate(lines) if inside[x.element] >= 0 and counts(i, x))


def extract(pages: DataFrame, html: str = "html", to: str = "main") -> DataFrame:
    """The rows with a struct ``to``: the main ``text`` and its number of code points ``n_chars``.

    A page that is null, empty or without text gives an empty text. A column named ``to`` is
    replaced; other columns pass unchanged. Each page is read on its own, so repeated rows and
    very long pages need nothing special.
    """
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("struct<text: string, n_chars: long>")
    def texts(column: pa.Array) -> pa.Array:
        found = [main_text(value.as_py()) for value in column]
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["text", "n_chars"]
        )

    return pages.withColumn(to, texts(F.col(html)))
