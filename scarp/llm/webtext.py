"""Main text of web pages by tag-path ratios.

Each piece of text belongs to the path of tags (with class and id) from the root to it. By path, text length and
punctuation are summed over the page and divided by the number of pieces; the two ratios, smoothed along the page over
neighbouring paths, are fused into one score, and paths above a threshold (a share of the spread over the page) are content.

Evidence enters the score. Links count against a path. Elements that never hold an article's text (menus, headers, footers,
forms, scripts, by tag, or hidden) are left out. Names of class, id and role count against what is in the element: to a
twentieth, where a name is a word for a sidebar, an advert, comments and the like, alone or at its end (``ad``,
``post-comments``, ``related-posts``), and to a half, where such a word stands elsewhere in the name (``share-price-report``).
A name such as ``no-sidebar`` or ``has-sidebar`` is of the layout and says nothing, and an outermost ``article`` or ``main`` is
not bound by the names of the elements around it. Being inside an ``article`` or ``main`` element is a prior: with the share
of the page's text that those elements hold, the score of their paths grows up to twofold and their links count down to half.

The content paths select a region: the innermost element that holds ``REGION_SHARE`` of their text and, where ``article`` or
``main`` elements hold half of the page's text, these. Every block of the region stays, however short: titles, list items, cells,
code, captions. Lists of links stay there only if their own score is content, named elements only if they hold content; text
outside the region stays if its path is content. If only the page's body holds enough, the region runs from the first to the
last content block. A title of the first rank that stands before the region beside it or around it belongs to it.

Text is cut into blocks at block-level tags and line breaks; character references are decoded, white space inside a block
becomes one space, and the blocks of content paths are joined by newlines in page order.

Nulls, ties, repeats: null html counts as empty and gives empty text; a page whose paths all score alike keeps all of them;
repeated rows get equal results; an empty table gives an empty result. Other columns of the input are ignored. Work is
linear in the page's length, and no tag nesting recurses.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: A comment, a declaration, a tag, or text up to the next tag. A quote opens a value only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s\xa0]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
NEVER = frozenset("nav header footer aside form script style noscript template iframe textarea title head button select option menu dialog svg canvas object embed audio video input label".split())
#: A new one of the key ends an open one of the values.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of a class, id or role that mark what is not an article's text.
NOISE = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related"
    " recommend recommended reply replies search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget alert"
    " contentinfo complementary".split()
)
#: A name with one of these tells what the page has or lacks, or how it is laid out, not what the element is.
LAYOUT = frozenset("no not non without hide has have with layout grid columns cols".split())
#: Words at the end of a name that tell nothing of what the element holds.
GENERIC = frozenset(
    "area article articles bar block bottom box button buttons bg col container content feed group holder icon icons inner item items left link links list module outer page"
    " panel post posts region right row section slot stories story strip top unit wrap wrapper zone".split()
)
#: How an element stands to content: it may hold some; its names, or those of one around it, speak somewhat or much against
#: it; it can't.
OPEN, HINTED, NAMED, SHUT = range(4)
EVIDENCE = np.array([1.0, 0.5, 0.05, 0.0])
SMOOTHING = (0.25, 0.5, 0.25)
REGION_SHARE = 0.8


def names_noise(value: str) -> int:
    """How the names in a class, id or role speak against the element."""
    found = OPEN
    for words in map(NAME.findall, value.lower().split()):
        if NOISE.isdisjoint(words) or not LAYOUT.isdisjoint(words):
            continue
        while words[-1] in GENERIC:
            words.pop()
        found = max(found, NAMED if words[-1] in NOISE else HINTED)
    return found


def noise_of(tag: str, attributes: str) -> tuple[int, str]:
    """Whether an element can hold content, by itself, and what its class and id add to the path."""
    noise, label = SHUT if tag in NEVER else OPEN, ""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return noise, label
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden":
            noise = SHUT if name == "hidden" or value.lower() == "true" else noise
            continue
        label += "." + value
        noise = max(noise, names_noise(value))
    return noise, label


class Page:
    """Blocks of a page with the path of each: (text, path, how it stands to content, in an article, characters in links). A
    path is the number that its last element got under its parent's path, so deep nesting takes no more room. By path,
    its parent, its tag, and whether its names hint at noise; parents have smaller numbers."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.parents, self.tags, self.hinted = [0], [""], [False]
        paths: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.owner = (0, OPEN, False)
        #: Tag, path, how it stands to content, whether in an article, and the place of the innermost element not inline.
        stack: list[tuple[str, int, int, bool, int]] = [("", 0, OPEN, False, 0)]
        opened: Counter[str] = Counter()
        open_links, at, size = 0, 0, len(source)
        lower = None
        for_text = self.parts.append
        while at < size:
            m = TOKEN.match(source, at)
            at = m.end()
            if (text := m[4]) is not None:
                if not self.parts or not "".join(self.parts[-1:]).strip():
                    self.owner = stack[-1][1:4]
                for_text(text)
                if open_links:
                    self.linked += len(text)
                continue
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag not in INLINE:
                self.close()
            if tag == "a":
                open_links = max(0, open_links + (-1 if closing else 1))
            if closing:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        opened[stack.pop()[0]] -= 1
                    opened[stack.pop()[0]] -= 1
                continue
            if tag in RAW:
                lower = source.lower() if lower is None or len(lower) != size else lower
                end = lower.find(f"</{tag}", at) if len(lower) == size else source.find(f"</{m[2]}", at)
                at = size if end < 0 else end
                continue
            if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_P:
                continue
            ended = ENDS.get(tag) or ({"p"} if tag in CLOSES_P else ())
            if ended and stack[k := stack[-1][4]][0] in ended:
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
            own, label = noise_of(tag, m[3])
            _, path, noise, article, block = stack[-1]
            inside = tag in INLINE and own == OPEN
            if tag in ("article", "main"):
                # The names around an outermost one say nothing of it, unless its own say the same.
                noise = OPEN if noise < SHUT and own == OPEN and not article else max(noise, own)
            elif tag not in ("html", "body"):
                noise = max(noise, own)
            opened[tag] += 1
            if not inside:
                outer, path = path, paths.setdefault((path, tag + label), len(paths) + 1)
                if path == len(self.parents):
                    self.parents.append(outer)
                    self.tags.append(tag)
                    self.hinted.append(own == HINTED)
            stack.append((tag, path, noise, article or tag in ("article", "main"), block if tag in INLINE else len(stack)))
        self.close()

    def close(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append((text, *self.owner, self.linked))
            self.parts.clear()
            self.linked = 0


def smoothed(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, 1, mode="edge")
    return SMOOTHING[0] * padded[:-2] + SMOOTHING[1] * x + SMOOTHING[2] * padded[2:]


def content(page: Page, threshold: float) -> list[str]:
    """Texts of the page's content, by block."""
    own = [b for b in page.blocks if b[2] != SHUT]
    if not own:
        return []
    paths = list(dict.fromkeys(b[1] for b in own))
    place = {p: k for k, p in enumerate(paths)}
    length, points, count, linked = (np.zeros(len(paths)) for _ in range(4))
    article, noise = np.zeros(len(paths), bool), np.zeros(len(paths), np.int64)
    for text, path, against, inside, links in own:
        k = place[path]
        length[k] += len(text)
        points[k] += len(PUNCTUATION.findall(text))
        count[k] += 1
        linked[k] += min(links, len(text))
        article[k] |= inside
        noise[k] = against
    fair = np.where(noise == NAMED, 0.0, length - linked)
    share = fair[article].sum() / max(fair.sum(), 1.0)
    prior = np.where(article, 1 + share, 1.0)
    links = linked / prior
    weight = EVIDENCE[noise]
    lent = np.where(noise == NAMED, weight, 1.0)  # little of what such a path has passes to its neighbours
    text_ratio, point_ratio = lent * (length - links) / count, lent * points / count
    fused = smoothed(text_ratio) * (1 + smoothed(point_ratio)) * (1 - links / np.maximum(length, 1)) * weight
    articles = share >= 0.5
    chosen = (prior * fused >= threshold * fused.std()) & ((linked <= 0.5 * length) | article & articles)
    short = (linked <= 0.5 * length) & (noise < NAMED)
    inside = region(page, own, place, chosen, length, article, articles)
    return [b[0] for b, kept in zip(own, inside) if chosen[place[b[1]]] or kept and short[place[b[1]]]]


def region(page: Page, own: list, place: dict[int, int], chosen: np.ndarray, length: np.ndarray, article: np.ndarray, articles: bool) -> list[bool]:
    """Whether each block lies in the region of the chosen paths. ``articles``: elements of that name hold the text."""
    mass, holds = np.zeros(len(page.parents)), np.zeros(len(page.parents), bool)
    for path, k in place.items():
        if chosen[k]:
            mass[page.parents[path]] += length[k]
            holds[path] = True
    total = mass.sum()
    for path in range(len(page.parents) - 1, 0, -1):  # children come after their parents
        mass[page.parents[path]] += mass[path]
        holds[page.parents[path]] |= holds[path]
    if not total:
        return [False] * len(own)
    top = int(np.flatnonzero(mass >= REGION_SHARE * total)[-1])  # of the elements that hold so much, one in the other, the innermost
    within, shut = np.zeros(len(mass), bool), np.zeros(len(mass), bool)
    within[top] = True
    for path in range(1, len(mass)):
        within[path] |= within[page.parents[path]]
        shut[path] = shut[page.parents[path]] or page.hinted[path] and not holds[path]
    picked = [k for k, b in enumerate(own) if chosen[place[b[1]]]]
    first, last = picked[0], picked[-1]
    around, path = {top}, top
    while path:
        path = page.parents[path]
        around.add(path)
    title = next((k for k in range(first, -1, -1) if page.tags[own[k][1]] == "h1" and page.parents[own[k][1]] in around), None)
    bare = page.tags[top] in ("", "html", "body")
    out = []
    for k, b in enumerate(own):
        kept = (articles and bool(article[place[b[1]]])) or bool(within[b[1]]) and (not bare or first <= k <= last) or k == title
        out.append(kept and not shut[b[1]])
    return out


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""

    def run(batches):
        for batch in slices(batches, 128):
            texts = ["\n".join(content(Page(h), threshold)) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
