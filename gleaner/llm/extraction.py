"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a row of items, tags and pieces of text. Words score positive by the block they stand in (below
zero in blocks of links alone), tags negative. Words of class, id and role say whether an element is boilerplate;
its items score below zero too. All weights are log-odds from labelled pages, for which pages serve whose authors
marked one ``article`` or ``main`` element, drawn towards priors. A linear scan finds the contiguous region of greatest
score; the text in it, without the boilerplate embedded between its words, is the result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import batch_of
from .common import bounded_batches, table, within

#: Labelled pages the weights are learned from: the documented bound of the fit.
FIT_PAGES = 400

ITEM = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: What elements and words of class, id and role say before any page is seen: below zero of boilerplate, above of content.
TAG_PRIORS = dict.fromkeys("aside button canvas datalist dialog footer form head iframe label legend menu nav noscript object script select style svg template textarea title".split(), -6.0)
STRONG = dict.fromkeys(
    "advert advertisement adverts breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "login masthead menu menubar modal nav navbar navigation newsletter pager pagination popup promo promoted related respond search sidebar "
    "sponsor sponsored subscribe".split(),
    -6.0,
)
WEAK = dict.fromkeys("ad ads alert banner dropdown form notice notices share sharing social toolbar widget".split(), -3.0) | {"header": -2.0}
CONTENT = dict.fromkeys("article body content entry free post story text".split(), 2.0)
PRIORS = STRONG | WEAK | CONTENT
#: Labelled pages that a prior counts for, and the bound of what is learned.
PRIOR_PAGES = 20
BOUND = 4.0
#: Elements whose words are never below zero by their place alone.
GENERIC = set("article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What embedded boilerplate costs a region at most, and within an element of content.
HOLE, EMBEDDED = -20.0, -0.3
#: A page whose words stand in elements of weak evidence alone, so many times more than elsewhere, is read without it.
OVERRULED = 10
#: What counts as evidence of boilerplate, from all to least: words of class, id and role, only the strong ones, tags
#: alone, and tags but for a form around the page.
ALL, STRONG_ONLY, TAGS, NO_FORMS = range(4)
#: A page of nothing but boilerplate by its names has a main text where so many blocks of it hold words.
BLOCKS_OF_TEXT = 2
WORDS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    """An open element: its tokens, those of class, id and role apart, and the nearest block at and in it."""

    name: str
    tokens: tuple[str, ...]
    hidden: bool
    link: bool
    article: bool
    block: str
    above: Element | None


@dataclass(slots=True)
class Item:
    """A tag (``text`` None) or a piece of text in ``place``; ``key`` is what weights are learned for."""

    key: str
    place: Element | None
    text: str | None = None
    words: int = 0
    inside: bool = False
    breaks: bool = False
    link: bool = False


def element(name: str, attributes: str, above: Element | None) -> Element:
    tokens, hidden = set(), False
    for kind, value in ATTRIBUTE.findall(attributes):
        kind = kind.lower()
        if kind == "hidden" or kind == "aria-hidden":
            hidden = hidden or kind == "hidden" or "true" in value.lower()
        else:
            tokens |= {x.lower() for x in WORDS.split(value.strip("\"'")) if x}
    if name in ("html", "body", "article", "main"):
        tokens, hidden = set(), False
    up = above
    return Element(name, tuple(sorted(tokens)), hidden, name == "a" or bool(up and up.link), name in ("article", "main") or bool(up and up.article), name if name in BLOCK else up.block if up else "body", up)


def items(page: str) -> list[Item]:
    """Tags and texts of a page in order; unclosed and stray tags are borne with."""
    out: list[Item] = []
    stack: list[Element] = []
    first = 0  # of the items since the last block's bound

    def text(raw: str) -> None:
        if raw:
            plain, top = html.unescape(raw), stack[-1] if stack else None
            out.append(Item(f"text {top.block if top else 'body'}", top, plain, len(plain.split()), bool(top and top.article), False, bool(top and top.link)))

    def bound() -> None:
        # A block that is all links is told from one that holds a link among words.
        nonlocal first
        own = [x for x in out[first:] if x.words]
        if own and all(x.link for x in own):
            for x in own:
                x.key = "text links"
        first = len(out)

    def pop(to: int) -> None:
        del stack[to:]

    at = 0
    while at < len(page):
        found = ITEM.search(page, at)
        if not found:
            break
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in BLOCK:
            bound()
        if closing:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            top = stack[place] if place is not None else stack[-1] if stack else None
            out.append(Item(f"/{name}", top, inside=bool(top and top.above and top.above.article), breaks=name in BLOCK))
            if place is not None:
                pop(place)
            continue
        if name in BLOCK and name not in ("html", "body", "head"):
            # A paragraph ends where a block starts; list items and cells end where the next one starts.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p" or stack[i].name == name and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    pop(i)
                    break
                if stack[i].name in BLOCK:
                    break
        above = stack[-1] if stack else None
        own = element(name, attributes, above)
        out.append(Item(name, own, inside=bool(above and above.article), breaks=name in BLOCK))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            continue
        stack.append(own)
    text(page[at:])
    bound()
    return out


def labelled(found: list[Item]) -> bool:
    """Whether the author marked one content element."""
    return sum(x.text is None and x.key in ("article", "main") for x in found) == 1


def tokens_above(place: Element | None) -> set[str]:
    found = set()
    while place:
        found.update(place.tokens)
        place = place.above
    return found


@dataclass
class Weights:
    """Scores of a word by its place, of tags, and what words of class, id and role say."""

    known: dict[str, float] = field(default_factory=dict)
    tokens: dict[str, float] = field(default_factory=lambda: dict(PRIORS))

    def evidence(self, x: Element, level: int) -> float:
        """Of an element: below zero of boilerplate, above of content; ``level`` says what counts."""
        if x.hidden:
            return -6.0
        if x.name in ("html", "body", "article", "main"):
            return 2.0 if x.name in ("article", "main") else 0.0
        tag = -6.0 if x.name == "header" and not (x.above and x.above.article) else TAG_PRIORS.get(x.name, 0.0)
        if level == NO_FORMS:
            return 0.0 if x.name == "form" else tag
        said = [self.tokens.get(t, 0.0) for t in x.tokens if level == ALL or level == STRONG_ONLY and t not in WEAK]
        return max(-6.0, min(6.0, tag + sum(said)))

    def word(self, key: str) -> float:
        """Of one word by its place, boilerplate apart."""
        if key == "text links":
            return self.known.get(key, -0.5)
        return self.known.get(key, 1.0 if key[5:] in GENERIC else 0.3)

    def scores(self, found: list[Item], level: int = ALL, around: frozenset[int] = frozenset()) -> tuple[list[float], list[bool]]:
        """Every item's score, and whether it is part of boilerplate; elements ``around`` the content are not, unless hidden.

        An element of boilerplate costs no more than ``HOLE``, or ``EMBEDDED`` within content, however long it is,
        so that it does not part the text around it.
        """
        seen: dict[int, tuple[Element | None, bool]] = {}  # the outermost boilerplate at an element, and if it is in content

        def of(x: Element | None) -> tuple[Element | None, bool]:
            if x is None:
                return None, False
            if id(x) not in seen:
                outer, content = of(x.above)
                said = self.evidence(x, level) if outer is None else 0.0
                if id(x) in around and not x.hidden:
                    said = max(said, 0.0)
                seen[id(x)] = (outer or (x if said < 0 else None), content or outer is None and said >= 2)
            return seen[id(x)]

        scores, skips, left = [], [], {}
        for x in found:
            outer, content = of(x.place)
            if outer is None:
                # Within content a block of links is a paragraph like others.
                word = 0.3 if content and x.key == "text links" else self.word(x.key)
                scores.append(self.known.get(x.key, -0.2) if x.text is None else x.words * word)
            else:
                cost = -0.2 if x.text is None else -0.5 * x.words
                rest = left.get(id(outer), EMBEDDED if content else HOLE)
                scores.append(max(cost, rest))
                left[id(outer)] = rest - scores[-1]
            skips.append(outer is not None)
        return scores, skips


def learn(inside: Counter, outside: Counter, pages: int) -> Weights:
    """Weights from words (by place and by token) and tags counted inside and outside of marked content.

    Log-odds, bounded; plain words are kept above zero and tags below. What tokens say is drawn towards their
    priors, which count for ``PRIOR_PAGES`` pages, and keeps a prior's sign where it is one of boilerplate.
    """
    total = [sum(c[k] for k in c if k.startswith("text ")) for c in (inside, outside)]
    base = math.log((total[0] + 1) / (total[1] + 1))
    known, tokens = {}, dict(PRIORS)
    for key in inside | outside:
        odds = max(-BOUND, min(BOUND, math.log((inside[key] + 0.5) / (outside[key] + 0.5)) - base))
        if key.startswith("."):
            token, prior = key[1:], PRIORS.get(key[1:], 0.0)
            drawn = (odds * pages + prior * PRIOR_PAGES) / (pages + PRIOR_PAGES)
            # A word that is only ever around marked content, or also there, says little of itself.
            tokens[token] = min(-1.0, drawn) if prior < 0 else drawn if drawn < -2 or prior else 0.0
        elif key.startswith("text "):
            known[key] = max(0.3, min(3.0, odds)) if key[5:] in GENERIC else max(-3.0, min(3.0, odds))
        elif key.strip("/") not in ("article", "main"):
            known[key] = max(-0.3, min(-0.05, odds))
    return Weights(known, tokens)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous run of greatest sum; empty if no sum is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def holes(skips: list[bool], words: list[int], a: int, b: int) -> list[bool]:
    """Which items of the region ``a``:``b`` are boilerplate between kept words; the region's ends are the scan's."""
    kept = [i for i in range(a, b) if words[i] and not skips[i]]
    if not kept:
        return [False] * (b - a)
    return [skips[i] and kept[0] < i < kept[-1] for i in range(a, b)]


def around_marked(found: list[Item]) -> tuple[frozenset[int], int]:
    """Elements around the page's one ``main``, or else its one ``article``, and the words in it; none where there is no such one."""
    for name in ("main", "article"):
        marked = [x.place for x in found if x.text is None and x.key == name]
        if len(marked) == 1:
            own, inner = marked[0], {}

            def within_it(x: Element | None) -> bool:
                path = []
                while x is not None and id(x) not in inner and x is not own:
                    path.append(x)
                    x = x.above
                answer = x is own or x is not None and inner[id(x)]
                inner.update((id(y), answer) for y in path)
                return answer

            outer, x = set(), own.above
            while x is not None:
                outer.add(id(x))
                x = x.above
            return frozenset(outer), sum(x.words for x in found if x.words and within_it(x.place))
    return frozenset(), 0


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region: blocks in page order, white space as one blank, one newline between.

    Where that is less than the one element that the author marked, names and tags of the elements around it say
    nothing. Where it is nothing at all, the best region by tags alone counts, and then that within a form around
    the page, if it has text in more than one block; navigation, footers and what is hidden never do.
    """
    found = items(page or "")
    words = [x.words for x in found]

    def best(level: int, around: frozenset[int] = frozenset()) -> tuple[int, int, list[bool], int]:
        scores, skips = weights.scores(found, level, around)
        a, b = best_region(scores)
        return a, b, skips, sum(n for n, skip in zip(words[a:b], skips[a:b], strict=True) if not skip)

    level = ALL
    a, b, skips, kept = best(level)
    doubtful = sum(n for n, x, y in zip(words, skips, weights.scores(found, STRONG_ONLY)[1], strict=True) if x and not y)
    if doubtful > OVERRULED * kept:
        level = STRONG_ONLY
        a, b, skips, kept = best(level)
    around, marked = around_marked(found)
    if marked > kept and any(x.place is not None and id(x.place) in around and skip for x, skip in zip(found, skips, strict=True)):
        other = best(level, around)
        if other[3] > kept:
            a, b, skips, kept = other
    texts = blocks_of(found[a:b], holes(skips, words, a, b)) if kept else []
    for level in (TAGS, NO_FORMS):
        if not texts and any(words):
            a, b, skips, kept = best(level)
            texts = blocks_of(found[a:b], holes(skips, words, a, b)) if kept else []
            texts = texts if len(texts) >= BLOCKS_OF_TEXT else []
    return "\n".join(texts)


def blocks_of(region: list[Item], skipped: list[bool]) -> list[str]:
    """Texts of the region's blocks, without the items that are ``skipped``."""
    blocks, current = [], []
    for x, hole in zip(region, skipped, strict=True):
        if x.breaks:
            blocks.append("".join(current))
            current = []
        elif x.text is not None and not hole:
            current.append(x.text)
    blocks.append("".join(current))
    return [y for y in (" ".join(x.split()) for x in blocks) if y]


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Weights:
    """Weights from labelled pages among those of smallest id hash; priors alone if none is labelled.

    Rows repeated with all their columns are one page of the sample.
    """
    rows = bounded_batches(pages).where("html is not null").select("html", F.xxhash64("page_id", "url", F.octet_length("html")).alias("key"))
    sample = within(rows, "key", fit_pages).groupBy("key").agg(F.min("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                found = items(page.as_py() or "")
                if labelled(found):
                    inside["pages"] += 1
                    for x in found:
                        side = inside if x.inside else outside
                        side[x.key] += 1 if x.text is None else x.words
                        if x.words:
                            side.update(dict.fromkeys((f".{t}" for t in tokens_above(x.place)), x.words))
        keys = [*(inside | outside)]
        yield batch_of({"key": pa.array(keys, pa.string()), "a": pa.array([inside[k] for k in keys], pa.int64()), "b": pa.array([outside[k] for k in keys], pa.int64())})

    # Keys are those of at most ``fit_pages`` pages.
    rows = sample.mapInArrow(run, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    inside, outside = Counter({x["key"]: x["a"] for x in rows}), Counter({x["key"]: x["b"] for x in rows})
    return learn(inside, outside, inside.pop("pages", 0))


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Null html is empty and gives an empty text, as does a page of boilerplate alone; pages of any length are read
    whole; of regions of equal score the first counts; repeated rows give equal texts; an empty table gives no rows;
    further columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch[a : a + 500]
                texts = [main_text(x.as_py(), shared.value) for x in part.column(2)]
                yield batch_of({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = bounded_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
