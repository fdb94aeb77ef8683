"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one for each block of text, with the
number of tags that stand in and around it and the share of its text inside links. Elements
that are no article by their own name, role or class (menus, page headers, footers, sidebars,
notices, adverts, forms, comments, code) are marked and left out. A tag, role or hidden state
marks no element that holds most of the page's text outside links: a form, dialog or header then
frames the page, and so does any other such element if an article or main element stands in it.
Controls, scripts and styles are left out wherever they stand. A class, or the id of a container, marks
by its whole name or last word, and never an article, main or body element; a container that holds
an article or most of the page's text outside links is marked by a class only where an
article or main element has at least a fifth of the text without it. Text-to-tag ratios of the lines
are smoothed with a Gaussian, and lines above the threshold, the standard deviation of the
smoothed ratios capped at their mean, form clusters of content. The region is the element
that holds them: the article or main element with most content if that is most of the page's,
or else the lowest container of all clusters and of the h1 before them. Every block left of
the region is kept, short ones too, in page order; without an article or main element, blocks
that are more than half links go where their container is too. Links are open a elements
with a target.

Cases: a null or empty page, and one without text outside marked elements, gives an empty
text with 0 characters. Unclosed and badly nested tags are closed by the next element that
cannot stand inside them, an open menu by an article or main element. Character references are decoded, white space inside a block
becomes one space, blocks are joined by one newline; pages are read whole. The work is linear
in the page, however deep its elements stand in each other. Of regions with equal mass the
inner one is taken. Repeated rows are extracted one by one. An empty table gives an empty table. Other columns pass through; result columns replace input columns of
the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import chunks

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("audio button canvas datalist frameset head iframe math noframes noscript object script select style svg template textarea title video".split())
#: Elements and roles that are no article unless most of the page's text stands in them: alone, or only if an article or main element holds some of it.
FRAMES, ASIDES = frozenset("dialog form header".split()), frozenset("aside footer menu nav search".split())
FRAME_ROLES, ASIDE_ROLES = frozenset("alertdialog dialog form".split()), frozenset("alert banner complementary contentinfo menu menubar navigation search toolbar tablist".split())
#: Words of a class or id that name something beside the article.
NAMES = frozenset(
    "ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus "
    "footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toc toolbar widget widgets".split()
)
#: An element that opens one of these closes those still open of the others, up to a container.
_CLOSES = {
    **{t: frozenset(["p", "select"]) for t in BLOCKS},
    "li": frozenset(["li", "p", "select"]), "dt": frozenset(["dt", "dd", "p", "select"]), "dd": frozenset(["dt", "dd", "p", "select"]),
    "tr": frozenset(["tr", "td", "th", "p", "select"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]), "a": frozenset(["a"]), "body": frozenset(["head", "p"]),
}
_CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section table ul".split())
#: Words that may follow such a name, first words of names that state something about the element's page or post, and of headers of an article.
ENDS = frozenset("area bar block box buttons container inner links list posts row section wrap wrapper".split())
STATES = frozenset("cat category has hide is no not show tag with without".split())
STORIES = frozenset("article blog content entry news post story".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    place: int
    title: bool = False


@dataclass
class Raw:
    """A line before it is known which class names mark: its parts with text, innermost named element around, in a link."""

    parts: list[tuple[str, int, bool]]
    tags: int
    place: int
    title: bool


@dataclass
class Element:
    tag: str
    marked: bool
    #: Innermost container; innermost element that a class names as no article; innermost article. 0 if there is none.
    place: int = 0
    name: int = 0
    article: int = 0
    link: bool = False
    title: bool = False


def _kind(tag: str, attrs: dict[str, str | None]) -> str | None:
    """Whether an element is skipped, or a frame or aside by tag, role or being hidden."""
    if tag in ("html", "body", "main"):
        return None
    role = (attrs.get("role") or "").lower()
    if tag in SKIPPED:
        return "skipped"
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return "aside"
    if tag in ASIDES or role in ASIDE_ROLES:
        return "aside"
    return "frame" if tag in FRAMES or role in FRAME_ROLES else None


def _named(tag: str, attrs: dict[str, str | None]) -> list[list[str]]:
    """Words of each class or id that names something beside the article; the id of a paragraph or heading is a target of links and names nothing."""
    if tag in ("html", "body", "main", "article"):
        return []
    found = []
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or '' if tag in _CONTAINERS else ''}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        while len(words) > 1 and words[-1] in ENDS:
            words.pop()
        if words and words[-1] in NAMES and (len(words) == 1 or words[0] not in STATES) and not (tag in HEADINGS and words[-1] == "header"):
            found.append(words)
    return found


class Lines(HTMLParser):
    """Collects a page's lines from parser events.

    Containers, named elements and articles have numbers, inner ones higher ones than those
    around them, and point to the next one around; 0 is the page. The stack is cut into scopes,
    one for each open container, which count their open tags, so that no event searches it in vain.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw: list[Raw] = []
        self.stack: list[Element] = [Element("", False)]
        self.scopes: list[Counter] = [Counter()]
        self.containers: Counter = Counter()
        self.count = 0
        #: By number: tag of containers; the next container, named element and named element around an article.
        self.tags_of = {0: ""}
        self.around = {0: 0}
        self.named_around: dict[int, int] = {}
        self.name_of_article: dict[int, int] = {}
        #: Characters outside links by innermost named element; articles with such text; named elements whose headings are an article's.
        self.size_of: dict[int, int] = {}
        self.texts: set[int] = set()
        self.headers: set[int] = set()
        #: Of size_of what stands in an article; by number: frame or aside, of elements that their tag, role or being hidden names.
        self.story_of: dict[int, int] = {}
        self.kinds: dict[int, str] = {}
        self._parts: list[tuple[str, int, bool]] = []
        self._tags = 0

    def cut(self) -> None:
        if any(not text.isspace() for text, _, _ in self._parts):
            top = self.stack[-1]
            self.raw.append(Raw(self._parts, self._tags, top.place, top.title))
            self._tags = 0
        self._parts = []

    def _asides(self, inner_first: list[int]) -> set[int]:
        """Frames and asides that are left out, with all named elements in them."""
        sizes, holds = dict(self.size_of), {self.name_of_article[a] for a in self.texts}
        for n in inner_first:
            around = self.named_around[n]
            sizes[around] = sizes.get(around, 0) + sizes.get(n, 0)
            if n in holds:
                holds.add(around)
        out: set[int] = set()
        for n in reversed(inner_first):
            most = 2 * sizes.get(n, 0) > sizes.get(0, 0) and (n in holds or self.kinds.get(n) == "frame")
            if self.named_around[n] in out or (n in self.kinds and not most):
                out.add(n)
        return out

    def _marks(self) -> set[int]:
        """Named elements that are left out, with all named elements in them."""
        inner_first = sorted(self.named_around, reverse=True)
        marks = self._asides(inner_first)
        # of what is left, each element's next one that a class names
        name = {0: 0}
        for n in reversed(inner_first):
            if n not in marks:
                name[n] = name[self.named_around[n]] if n in self.kinds else n
        around = {n: name[self.named_around[n]] for n in name if n and name[n] == n}
        sizes, plain = dict.fromkeys(name.values(), 0), 0
        for n, own in name.items():
            sizes[own] += self.size_of.get(n, 0)
            plain += 0 if own else self.story_of.get(n, 0)
        total = sum(sizes.values())
        holds = {name[n] for n in (self.name_of_article[a] for a in self.texts) if n in name}
        for n in sorted(around, reverse=True):
            sizes[around[n]] += sizes[n]
            if n in holds:
                holds.add(around[n])
        every, named = 5 * plain >= total, set()
        for n in sorted(around):
            if around[n] in named or every or (n not in holds and 2 * sizes[n] <= total):
                named.add(n)
        return marks | {n for n, own in name.items() if own in named}

    def lines(self) -> list[Line]:
        """The lines without what is marked by class names."""
        marks = self._marks()
        out, tags = [], 0
        for raw in self.raw:
            parts = [(text, link) for text, name, link in raw.parts if name not in marks]
            text, tags = " ".join("".join(x for x, _ in parts).split()), tags + raw.tags
            if text:
                out.append(Line(text, tags, min(sum(len(x.strip()) for x, link in parts if link), len(text)), raw.place, raw.title))
                tags = 0
        return out

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        if tag in _CONTAINERS:
            self.scopes.pop()
            self.containers[tag] -= 1
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag in ("br", "td", "th"):
            self._parts.append((" ", 0, False))
        if tag in VOID:
            return
        while tag in ("article", "main") and self.containers["nav"] > 0:  # no menu holds the story: it was not closed
            self._pop()
        for closed in _CLOSES.get(tag, ()):
            while self.scopes[-1][closed] > 0:
                self._pop()
        top = self.stack[-1]
        given = dict(attrs)
        self.count += 1
        number, name = self.count, top.name
        kind = None if top.marked else _kind(tag, given)
        marked = top.marked or kind == "skipped"
        if tag in HEADINGS:
            while name in self.headers:
                name = self.named_around[name]
        found = [] if marked or kind else _named(tag, given)
        if kind and not marked:
            self.named_around[number], self.kinds[number] = name, kind
            name = number
            if tag == "header" and top.article:
                self.headers.add(number)
        if found:
            self.named_around[number] = name
            name = number
            if all(words[-1] == "header" and (top.article or words[0] in STORIES) for words in found):
                self.headers.add(number)
        article = top.article
        if tag in ("article", "main"):
            article = number
            self.name_of_article[number] = name
        place = top.place
        if tag in _CONTAINERS:
            self.tags_of[number], self.around[number] = tag, place
            place = number
            self.scopes.append(Counter())
            self.containers[tag] += 1
        else:
            self.scopes[-1][tag] += 1
        link = top.link or (tag == "a" and any(key == "href" for key, _ in attrs))
        self.stack.append(Element(tag, marked, place, name, article, link, top.title or tag == "h1"))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag in _CONTAINERS if self.containers[tag] > 0 else self.scopes[-1][tag] > 0:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.marked:
            return
        self._parts.append((data, top.name, top.link))
        size = 0 if top.link else len(data.strip())
        if size:
            self.size_of[top.name] = self.size_of.get(top.name, 0) + size
            if top.article:
                self.story_of[top.name] = self.story_of.get(top.name, 0) + size
                self.texts.add(top.article)


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing with a window of 2 * radius + 1 lines; the ends repeat their line."""
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * max(radius / 2, 0.5) ** 2))
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.lines()
    if not lines:
        return ""
    ratios = smoothed(np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=np.float64))
    threshold = min(float(ratios.std()), float(ratios.mean()))
    inner_first = sorted(page.around, reverse=True)[:-1]

    def up(sums: dict[int, float]) -> dict[int, float]:
        """What each container holds, with all containers in it."""
        for n in inner_first:
            if sums.get(n):
                sums[page.around[n]] = sums.get(page.around[n], 0) + sums[n]
        return sums

    def inside(region: int, shown: list[Line]) -> str:
        held = {region}
        for n in reversed(inner_first):
            if page.around[n] in held:
                held.add(n)
        return "\n".join(x.text for x in shown if x.place in held)

    own: dict[int, float] = {}
    for line, ratio in zip(lines, ratios, strict=True):
        if ratio >= threshold:
            own[line.place] = own.get(line.place, 0.0) + len(line.text) - line.linked + 1e-3
    mass = up(own)
    articles = {n: m for n, m in mass.items() if page.tags_of[n] in ("article", "main")}
    most = max(articles.values(), default=0.0)
    if 2 * most > mass[0]:
        return inside(max(n for n, m in articles.items() if m >= 0.999 * most), lines)
    content = [i for i, ratio in enumerate(ratios) if ratio >= threshold]
    content += [i for i in range(content[0]) if lines[i].title and 2 * lines[i].linked <= len(lines[i].text)][-1:]
    held = up(dict(Counter(lines[i].place for i in content)))
    region = max(n for n, m in held.items() if m == len(content))
    sizes: dict[int, list[int]] = {}
    for line in lines:
        size = sizes.setdefault(line.place, [0, 0])
        size[0] += line.linked
        size[1] += len(line.text)

    def is_menu(line: Line) -> bool:
        linked, size = sizes[line.place]
        return 2 * line.linked > len(line.text) and 2 * linked > size

    return inside(region, [x for x in lines if not is_menu(x)])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars") or c == html]
    pages = pages.select(*(f"`{c}`" for c in kept))
    fields = [f for f in pages.schema.fields if f.name not in ("text", "n_chars")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, html):
                texts = [main_text(x) for x in batch.column(html).to_pylist()]
                columns = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
