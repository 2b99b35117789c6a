"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of words and tags. Words score positive and tags negative, each by weights learned from pages that mark
their content themselves (an article or main element); the contiguous part of the row with the largest sum, found in one
pass, is the content region. Blocks of the region that are boilerplate by their element or by the names it carries (menus,
adverts, forms, reader comments and the like) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import free_name, one_in, only, with_fields

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.I)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select datalist textarea title head".split())
#: Elements that are boilerplate wherever they stand.
BOILERPLATE = frozenset("nav footer aside form menu button dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input br meta link".split()
)
CONTENT = frozenset(("article", "main"))
TAGS = frozenset(
    "address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul a b br em i img span strong".split()
)
#: Words in class, id or role that mark boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget "
    "widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe "
    "subscription signup login search share sharing social related recommended comment comments disqus respond reply replies "
    "discussion pagination pager toolbar skip tracking".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that make a class a state or layout of the page ("has-sidebar", "comments-open"), and what the content is called:
#: "post-header" and "theme-post-content" are parts of it, "related-work" is a section.
STATES = frozenset("has no with without open closed enabled disabled".split())
CONTENT_NAMES = frozenset("post entry article story page content".split())
CONTENT_PARTS = frozenset("header content body text title".split())
#: Boilerplate elements that may wrap a whole page.
WRAPPERS = frozenset("form fieldset".split())


@dataclass
class Weights:
    """Score of a word by the block it stands in (positive) and of a tag (negative), with a prior for unknown ones."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -0.5


#: What a boilerplate element costs, whatever it holds, and the ends of the scores that are learned.
BOILERPLATE_SCORE, LEAST, MOST = -4.0, 0.02, 3.0


def names_boilerplate(value: str) -> bool:
    """Whether a class, id or role names boilerplate, by one of its blank-separated names."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if NAMES.isdisjoint(parts) or not STATES.isdisjoint(parts):
            continue
        if len(parts) > 1 and (parts[-2] in CONTENT_NAMES and parts[-1] in CONTENT_PARTS or parts[-2] == "related" and parts[-1] == "work"):
            continue
        return True
    return False


def is_boilerplate(name: str, attrs: str, in_content: bool) -> str:
    """"skip" for boilerplate, "wrap" for what is none if it holds most of the page, else nothing."""
    if name in BOILERPLATE or (name == "header" and not in_content):
        return "wrap" if name in WRAPPERS and "hidden" not in attrs else "skip"
    if "=" not in attrs and "hidden" not in attrs:
        return ""
    named = ""
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "skip"
        if key in ("class", "id", "role") and name not in ("body", "html", "article", "main") and names_boilerplate(value):
            named = "wrap"
    return named


class Shape:
    """What a reading of a page finds of its muting elements, by their place: how many words and content elements each
    holds, which have an end tag of their own, and which a content element inside has ended."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[int, int]] = {}
        self.closed: dict[int, str] = {}
        self.unclosed: dict[str, int] = {}  # the first place of each name without an end tag
        self.wraps: set[int] = set()
        self.ended: set[int] = set()
        self.words = self.contents = 0

    def freed(self) -> set[int]:
        """Elements that boilerplate names or a form would mute although they hold more than half of the page's words, and
        all of its article and main elements."""
        return {at for at in self.wraps if 2 * self.held[at][0] > self.words and self.held[at][1] == self.contents}

    def really_closed(self) -> set[int]:
        """Elements with an end tag that cannot be that of an unclosed element around them."""
        return {at for at, name in self.closed.items() if at < self.unclosed.get(name, at + 1)}


def events(page: str) -> list[tuple[str, str, str, bool]]:
    """The parts of a page, as ``scan`` gives them, once it is known what its muting elements hold and where they end."""
    shape = Shape()
    parts = list(scan(page, shape))
    freed, closed = shape.freed(), shape.really_closed()
    return list(scan(page, Shape(), freed, closed)) if freed or closed & shape.ended else parts


def scan(
    page: str, shape: Shape, freed: set[int] | frozenset[int] = frozenset(), closed: set[int] | frozenset[int] = frozenset()
) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, key, text, inside) for the page's parts in order: ``tag`` with its name, ``text`` with the innermost block's
    name and the decoded text, ``cut`` at a block's edge, ``skip`` for a boilerplate element. ``inside`` is whether the
    place is in an article or main element. Elements at places ``freed`` do not mute; of those that do, only the ones not
    in ``closed`` end where an article or main element opens."""
    open_: list[tuple[str, str, int, int, int]] = []  # (name, "" or "silent" or "skip", place, or -1 - place of what does not mute, words and contents before it)
    silent = 0
    content = 0
    muted = 0
    at = 0

    def inner() -> str:
        return next((n for n, *_ in reversed(open_) if n not in INLINE), "body")

    def said(raw: str) -> Iterator[tuple[str, str, str, bool]]:
        if raw and not silent:
            shape.words += len(raw.split())
        if raw and not muted:
            yield "text", inner(), html.unescape(raw), content > 0

    def leave(own: bool) -> str:
        nonlocal muted, silent, content
        last, how, place, words, contents = open_.pop()
        start = abs(place) - (place < 0)
        muted -= bool(how)
        silent -= how == "silent"
        content -= last in CONTENT
        if place >= 0:
            shape.held[place] = shape.words - words, shape.contents - contents
            if own:
                shape.closed[place] = last
        if not own:
            shape.unclosed[last] = min(start, shape.unclosed.get(last, start))
        return last

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            yield from said(page[at:])
            break
        match = TOKEN.match(page, begin)
        if match is None:  # a "<" that opens nothing is text
            end = page.find("<", begin + 1)
            end = len(page) if end < 0 else end
            yield from said(page[at:end])
            at = end
            continue
        yield from said(page[at:begin])
        at = match.end()
        if match["data"] is not None:
            yield from said(html.escape(match["data"], quote=False))
            continue
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        if match["end"] or match["end2"]:
            if any(n == name for n, *_ in open_):
                while leave(open_[-1][0] == name) != name:
                    pass
            if not muted:
                yield "tag", "/" + name, "", content > 0
                if name not in INLINE:
                    yield "cut", name, "", content > 0
            continue
        attrs = match["attrs"] or match["attrs2"] or ""
        if name in ("script", "style", "textarea", "title", "iframe", "noscript"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            if not muted and name not in ("title",):
                yield "tag", name, "", content > 0
            continue
        if name in CONTENT and content == 0:
            # Content that opens inside unclosed boilerplate ends that.
            for i, (n, how, place, *before) in enumerate(open_):
                if how and place not in closed:
                    open_[i] = (n, "", place, *before)
                    shape.ended.add(place)
                    muted -= 1
                    silent -= how == "silent"
        kind = "silent" if name in SILENT else is_boilerplate(name, attrs, content > 0)
        how = "skip" if kind == "wrap" and begin not in freed else "" if kind == "wrap" else kind
        if name == "p" and open_ and open_[-1][0] == "p":
            leave(False)
        if not muted:
            if name not in INLINE:
                yield "cut", name, "", content > 0
            elif name == "br":
                yield "text", inner(), "\n", content > 0
            yield ("skip" if how == "skip" and name not in VOID else "tag"), name, "", content > 0
        if name not in VOID and not attrs.rstrip().endswith("/"):
            open_.append((name, how, begin if how else -1 - begin, shape.words, shape.contents))
            if kind == "wrap":
                shape.wraps.add(begin)
            muted += bool(how)
            silent += how == "silent"
            content += name in CONTENT
            shape.contents += name in CONTENT
    while open_:
        leave(False)


def known(key: str) -> str:
    return key if key.lstrip("/") in TAGS else ("/" if key[0] == "/" else "") + "other"


def context(key: str, inside: bool, marked: bool) -> str:
    """Words outside the content of a page that marks its content are a context of their own."""
    return ("out:" if marked and not inside else "") + known(key)


def observe(page: str) -> dict[tuple[str, str], list[int]]:
    """(kind, key) -> [count outside, count inside] for a page that marks its content; nothing for others."""
    counts: dict[tuple[str, str], list[int]] = {}
    parts = list(events(page))
    if not any(inside for *_, inside in parts):
        return {}
    for kind, key, text, inside in parts:
        if kind == "text" and (n := len(text.split())):
            counts.setdefault(("words", context(key, inside, True)), [0, 0])[inside] += n
        elif kind == "tag":
            counts.setdefault(("tags", known(key)), [0, 0])[inside] += 1
    return counts


def learn(rows: list[tuple[str, str, int, int]]) -> Weights:
    """Weights from counts (kind, key, outside, inside): log odds of standing in the content, kept positive for words and
    negative for tags."""
    found = Weights()
    for kind, key, outside, inside in rows:
        odds = math.log((inside + 0.5) / (outside + 0.5))
        if kind == "words":
            found.words[key] = min(MOST, max(LEAST, odds))
        else:
            found.tags[key] = max(-MOST, min(-LEAST, odds - MOST))
    return found


def extract(page: str, weights: Weights) -> str:
    """The page's main text: blocks of the best region, one a line."""
    parts = list(events(page))
    marked = any(inside for *_, inside in parts)
    best, best_sum, begin, running = (0, 0), 0.0, 0, 0.0
    for i, (kind, key, text, inside) in enumerate(parts):
        if kind == "text":
            score = len(text.split()) * weights.words.get(context(key, inside, marked), LEAST if marked and not inside else weights.word)
        elif kind == "tag":
            score = weights.tags.get(known(key), weights.tag)
        else:
            score = BOILERPLATE_SCORE if kind == "skip" else 0.0
        if running <= 0:
            running, begin = 0.0, i
        running += score
        if running > best_sum:
            best_sum, best = running, (begin, i + 1)
    blocks, line = [], []
    for kind, _, text, _ in [*parts[best[0] : best[1]], ("cut", "", "", False)]:
        if kind == "text":
            line.append(text)
        elif kind in ("cut", "skip") and line:
            block = " ".join("".join(line).split())
            if block:
                blocks.append(block)
            line = []
    return "\n".join(blocks)


def fit(pages: DataFrame, sample: int = 2000, page_id: str = "page_id", page: str = "html") -> Weights:
    """Weights from about ``sample`` pages (chosen by a hash of the id); those among them that mark their content count."""
    cols = only(pages, page_id=page_id, html=page)
    some = cols.filter(one_in(F.xxhash64("page_id"), cols.count(), sample)).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for key, (outside, inside) in observe(text or "").items():
                    row = total.setdefault(key, [0, 0])
                    row[0] += outside
                    row[1] += inside
        rows = [(*k, *v) for k, v in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = ["kind", "key", "outside", "inside"]
    arrow = pa.schema([("kind", pa.string()), ("key", pa.string()), ("outside", pa.int64()), ("inside", pa.int64())])
    seen = some.mapInArrow(run, "kind string, key string, outside long, inside long")
    rows = seen.groupBy("kind", "key").agg(F.sum("outside"), F.sum("inside")).collect()  # one row a known tag or context
    return learn([tuple(r) for r in rows])


def main_text(pages: DataFrame, page_id: str = "page_id", page: str = "html", text: str = "text", sample: int = 2000) -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text``: the main text of the whole page.

    Null and empty pages, and pages without words, have an empty text. Without pages that mark their content the weights
    are priors. A column that is already called ``text`` is kept; the new one has an underscore in front.
    """
    weights = fit(pages, sample, page_id, page)
    kept = [c for c in pages.columns if c != page]
    fed = free_name(pages, "page_html")
    text = free_name(pages.select(*kept), text)
    source = pages.select(*[pages[f"`{c}`"] for c in kept], pages[f"`{page}`"].alias(fed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p or "", weights) for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*kept, text])

    return source.mapInArrow(run, with_fields(pages.select(*[pages[f"`{c}`"] for c in kept]), **{text: "string"}))


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
