"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is read as a row of tokens, tags and words. Words score positive and tags negative, by weights that labelled
pages give: pages whose markup declares its content (an article or main element) label their own tokens as inside or
outside, and a token kind's weight is the log ratio of its smoothed rates there, kept on its side of zero. Kinds of words
are words, words of links and of the first heading; those of tags are the names of blocks, and inline tags. One linear scan finds the contiguous
run of tokens with the highest sum; the blocks in it are the main text, on every page: what a page declares labels it for
the weights and decides nothing else.

Some parts take no part in the scan and aren't text: scripts, styles, graphics and what is hidden; elements for menus,
footers, asides, forms and their buttons, page headers; and parts whose class, id or role names them as such, as notices,
adverts or reader comments. A name is read by its head ("ad-free" is no advert, "comment-list" and "comment-body" are
comments), and a part that is also named as content isn't left out. Nor is a named part that holds the page's heading or
declared content, or a named part, form, aside or header that scores over RIVAL times as much as all that is left (comments
and consent notices only where nothing else is left): names don't remove an article.

Tags follow HTML's rules: an unquoted value ends at white space or ">", whatever quotes stand in it; a quoted one at its
quote, or, where that never comes, like an unquoted one; blocks end open paragraphs, items end items. A comment or script
that is never closed takes the rest of the page; a tag cut off by the page's end is dropped. A menu or other part that is
never closed ends at the next heading, paragraph, section, article or main element.

Null and empty pages give the empty text. Character references are decoded once, white space inside a block becomes one
space, blocks are joined by an empty line. Ties between runs go to the first, and to the longer of those that begin there.
Repeated rows are read each; text and n_chars columns are replaced; a table without labelled pages has weights too (PRIOR).
"""

from __future__ import annotations

import bisect
import dataclasses
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content isn't markup; they end at their own end tag only.
RAW = {"script", "style", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
#: Elements that are no text of a page.
UNSEEN = {"head", "template", "svg", "object", "canvas", "audio", "video", "select", "button", "datalist"}
PARTS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CONTENT = {"article", "main"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
#: What an unclosed part ends at, and start tags that end an open element of their group.
RESTART = {"main", "article", "section", "p", "h1", "h2", "h3"}
SIBLINGS = {n: g for g in ({"li"}, {"dd", "dt"}, {"tr"}, {"td", "th"}, {"option"}, {"tbody", "thead", "tfoot"}) for n in g}
#: Heads of names that mark a part as something other than the article; those that do so even if it is the larger part;
#: those that mark content; what may follow a head; and words before which a name tells of something else.
OFF = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices alert popup modal overlay subscribe subscription signup paywall social share sharing related recommended recommendations widget widgets breadcrumb breadcrumbs pagination pager login search skip toolbar sidebar aside nav navbar navigation menu header footer masthead topbar complementary contentinfo".split())
STRONG = set("comment comments reply replies respond disqus discussion cookie cookies consent gdpr newsletter".split())
GOOD = set("article content entry post story main body text page blog news".split())
TAIL = set("list area container wrapper wrap left right top bottom box block section inner outer links link items item posts buttons button bar panel group widget form unit slot row".split())
BEFORE = set("with has no without is not".split())
RIVAL = 4
#: Elements of PARTS, and page headers, that may hold an article all the same.
RIVALS = {"form", "fieldset", "header", "aside", "dialog"}
#: Counts added to those of labelled pages, inside and outside, so that a table without labels has weights too.
PRIOR = {"word": (2000, 200), "word:h1": (400, 4), "word:link": (100, 600), "tag": (300, 150)}


def _name(token: str) -> str:
    """What one class, id or role says of its part: off, strong, good or nothing."""
    parts = [p.lower() for p in _PART.findall(token)]
    if not parts or parts[0] in BEFORE:
        return ""
    own_head = len(parts) > 1 and parts[-1] in ("header", "head") and parts[0] in GOOD  # as in "entry-header"
    while len(parts) > 1 and (parts[-1] in TAIL or (parts[-1].removesuffix("s") in GOOD and parts[-2] in OFF | STRONG)):
        parts.pop()
    if own_head:
        return ""
    return "strong" if parts[-1] in STRONG or (parts[-1] in OFF and parts[0] in STRONG) else "off" if parts[-1] in OFF else "good" if parts[-1] in GOOD else ""


@dataclasses.dataclass
class Tag:
    name: str
    closing: bool
    attributes: str
    end: int = 0  # where the element ends, by token
    closed: bool = True
    off: str = ""  # unseen, part, strong or off: why it is left out
    link: bool = False

    def read(self, inside: bool) -> None:
        """Why the element is left out, if it is."""
        if self.name in UNSEEN:
            self.off = "unseen"
        elif self.name in PARTS or (self.name == "header" and not inside):
            self.off = "part"
        if not self.attributes or self.name in ("html", "body"):
            return
        says = set()
        for m in _ATTRIBUTE.finditer(self.attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if (name == "hidden" and value.lower() not in ("false", "until-found")) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
                self.off = "unseen"
                return
            if name in ("class", "id", "role"):
                says |= {_name(t) for t in html.unescape(value).split()}
        if self.off or self.name == "main":
            return
        if "good" not in says and says & {"off", "strong"} and not (self.name == "header" and inside):
            self.off = "strong" if "strong" in says else "off"


def lex(page: str) -> list[str | Tag]:
    """Texts and tags of a page; comments and what isn't markup are gone."""
    found: list[str | Tag] = []
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            found.append(page[at:])
            break
        if m.start() > at:
            found.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in RAW:
            if not closing:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end if close is None else (page.find(">", close.start()) + 1 or end)
            found.append(" ")
        elif page[m.end() - 1] == ">":
            found.append(Tag(name, closing, m[3]))
    return found


#: Elements that a sibling's start tag doesn't look beyond.
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")


def match(tokens: list[str | Tag]) -> None:
    """Sets where every element ends, by HTML's rules of implied ends, and what is left out. Where the last open element of
    each name stands is known, so a tag costs no walk through the open elements."""
    stack: list[tuple[int, Tag, bool]] = []  # token, tag, whether a content element is open
    places: dict[str, list[int]] = {}  # of each name's open elements
    blocks: list[int] = []  # places of open blocks

    def pop(k: int, at: int, closed: bool) -> None:
        for n in range(len(stack) - 1, k - 1, -1):
            tag = stack[n][1]
            tag.end, tag.closed = at, closed if n == k else tag.name in ("p", "li", "dd", "dt", "tr", "td", "th", "option")
            places[tag.name].pop()
            if tag.name in BLOCK:
                blocks.pop()
        del stack[k:]

    last = lambda name: places[name][-1] if places.get(name) else -1
    for i, tag in enumerate(tokens):
        if isinstance(tag, str):
            continue
        if tag.closing:
            k = last(tag.name)
            # the end of an inline element ends no block
            if k >= 0 and (tag.name in BLOCK or tag.name == "a" or not blocks or blocks[-1] <= k):
                pop(k, i + 1, True)
            continue
        if tag.name in BLOCK and blocks and stack[blocks[-1]][1].name == "p":  # a block ends an open paragraph
            pop(blocks[-1], i, True)
        if tag.name in SIBLINGS:
            k = max(map(last, SIBLINGS[tag.name]))
            if k >= 0 and k > max(map(last, _LISTS)):
                pop(k, i, True)
        inside = bool(stack) and stack[-1][2]
        tag.read(inside)
        tag.link = tag.name == "a"
        tag.end = i + 1
        if tag.name not in VOID:
            places.setdefault(tag.name, []).append(len(stack))
            if tag.name in BLOCK:
                blocks.append(len(stack))
            stack.append((i, tag, inside or (tag.name in CONTENT and not tag.off)))
    if stack:
        pop(0, len(tokens), False)
    restarts = [i for i, t in enumerate(tokens) if isinstance(t, Tag) and not t.closing and t.name in RESTART]
    for i, tag in enumerate(tokens):
        if isinstance(tag, Tag) and tag.off and not tag.closed:
            k = bisect.bisect_right(restarts, i)
            tag.end = min(tag.end, restarts[k]) if k < len(restarts) else tag.end


@dataclasses.dataclass
class Page:
    """The tokens that take part in the scan: kind, number of words or 1, and block; and the pieces of each block."""

    found: list[tuple[str, int, int]]
    blocks: list[list[str]]
    declared: bool
    inside: set[int]  # blocks of a declared content


def read(tokens: list[str | Tag], sizes: list[int], spared: frozenset[int] = frozenset()) -> Page:
    """tokens after match; sizes: words before each token; spared: named parts that are taken in nevertheless."""
    skip = [False] * (len(tokens) + 1)
    heads = [isinstance(t, Tag) and not t.closing and (t.name in ("main", "h1") or (t.name == "article" and not t.off)) for t in tokens]
    before = [0]
    for h in heads:
        before.append(before[-1] + h)
    until = 0
    for i, t in enumerate(tokens):
        if isinstance(t, Tag) and t.off and i >= until and i not in spared and (t.off != "off" or before[t.end] == before[i + 1]):
            until = t.end
        skip[i] = i < until
    seen = [0]
    for i in range(len(tokens)):
        seen.append(seen[-1] + (0 if skip[i] else sizes[i + 1] - sizes[i]))
    count = lambda t, i: seen[t.end] - seen[i]
    own = {n: [(i, t) for i, t in enumerate(tokens) if isinstance(t, Tag) and not t.closing and t.name == n and not skip[i]] for n in CONTENT}
    words = {n: max([0, *(count(t, i) for i, t in own[n])]) for n in CONTENT}
    # the narrower element declares the content, if it holds most of the wider one's words and a fair share of the page's
    name = "article" if own["article"] and 2 * sum(count(t, i) for i, t in own["article"]) >= words["main"] else "main"
    declared = bool(own[name]) and 5 * sum(count(t, i) for i, t in own[name]) >= seen[-1] > 0
    inside = [False] * len(tokens)
    until = 0
    for i, t in own[name] if declared else []:
        if t.end > until:  # nested ones are marked already
            at = max(i, until)
            inside[at : t.end] = [True] * (t.end - at)
            until = t.end
    found: list[tuple[str, int, int]] = []
    blocks: list[list[str]] = [[]]
    within: set[int] = set()
    link = title = 0
    for i, t in enumerate(tokens):
        if isinstance(t, str):
            if not skip[i]:
                blocks[-1].append(html.unescape(t))
                n = sizes[i + 1] - sizes[i]
                if n:
                    found.append(("word:link" if i < link else "word:h1" if i < title else "word", n, len(blocks) - 1))
                    if inside[i]:
                        within.add(len(blocks) - 1)
            continue
        if t.name in BLOCK:
            if blocks[-1]:
                blocks.append([])
        elif t.name in ("br", "td", "th"):
            blocks[-1].append(" ")
        if skip[i]:
            continue
        if t.link and not t.closing:
            link = max(link, t.end)
        if t.name == "h1" and not t.closing:
            title = max(title, t.end)
        found.append(("tag:inline" if t.name not in BLOCK else f"tag:/{t.name}" if t.closing else f"tag:{t.name}", 1, -1))
    return Page(found, blocks, declared, within)


def tokens_of(page: str | None) -> tuple[list[str | Tag], list[int]]:
    tokens = lex(page or "")
    match(tokens)
    sizes = [0]
    for t in tokens:
        sizes.append(sizes[-1] + (len(html.unescape(t).split()) if isinstance(t, str) else 0))
    return tokens, sizes


def counts(page: str | None) -> dict[str, list[int]]:
    """Of a labelled page: how many tokens of each kind are inside and outside; nothing for other pages."""
    tokens, sizes = tokens_of(page)
    own = read(tokens, sizes)
    seen: dict[str, list[int]] = {}
    if own.declared:
        first, last = min(own.inside, default=0), max(own.inside, default=-1)
        block = 0
        for kind, n, b in own.found:
            block = max(block, b)
            inside = b in own.inside if b >= 0 else first <= block <= last
            seen.setdefault(kind, [0, 0])[0 if inside else 1] += n
    return seen


def weights(summed: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log ratios of the smoothed rates, within bounds: words are over, tags under zero, words of links no lower than a
    plain word is high. Tags of kinds that weren't seen weigh as all seen together."""
    tags = [v for k, v in summed.items() if k.startswith("tag:")]
    summed = {**summed, "tag": (sum(a for a, _ in tags), sum(b for _, b in tags))}
    full = {k: (a + PRIOR.get(k, (0, 0))[0], b + PRIOR.get(k, (0, 0))[1]) for k, (a, b) in {**dict.fromkeys(PRIOR, (0, 0)), **summed}.items()}
    ins, outs = (sum(v[i] for v in full.values()) + len(full) for i in (0, 1))
    found = {}
    for kind, (a, b) in full.items():
        ratio = math.log((a + 1) / ins) - math.log((b + 1) / outs)
        low, high = {"word": (0.2, 3.0), "word:h1": (0.2, 4.0), "word:link": (-1.0, 3.0)}.get(kind, (-3.0, -0.05))
        found[kind] = min(max(ratio, low), high)
    return found


def best_run(scores: list[float]) -> tuple[int, int, float]:
    """(start, end, sum) of the first contiguous run with the highest sum; nothing where no score is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and span[1] and start == span[0]):
            best, span = total, (start, i + 1)
    return *span, best


def extract_text(page: str | None, weight: dict[str, float]) -> str:
    tokens, sizes = tokens_of(page)
    score = lambda own: [weight.get(kind, weight["tag"]) * n for kind, n, _ in own.found]
    own = read(tokens, sizes)
    start, end, best = best_run(score(own))
    rest = any(b >= 0 for _, _, b in own.found)  # strong names give way only where nothing else is left
    named = {i: sizes[t.end] - sizes[i] for i, t in enumerate(tokens) if isinstance(t, Tag) and (t.off == "off" or (t.off == "strong" and not rest) or (t.off == "part" and t.name in RIVALS))}
    if named and max(named.values()) * weight["word"] > RIVAL * best:  # a large part left out: taken in if it scores like an article
        wider = read(tokens, sizes, frozenset(i for i, n in named.items() if 2 * n >= max(named.values())))
        span = best_run(score(wider))
        if span[2] > RIVAL * best:
            own, (start, end, best) = wider, span
    kept = sorted({b for _, _, b in own.found[start:end] if b >= 0})
    lines = (" ".join("".join(own.blocks[b]).split()) for b in kept)
    return "\n\n".join(line for line in lines if line)


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages: counts of token kinds, summed by Spark. Kinds are names of BLOCK and few others."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for kind, (a, b) in counts(page).items():
                    own = summed.setdefault(kind, [0, 0])
                    own[0] += a
                    own[1] += b
        yield pa.RecordBatch.from_arrays([pa.array(list(summed), pa.string()), pa.array([v[0] for v in summed.values()], pa.int64()), pa.array([v[1] for v in summed.values()], pa.int64())], names=["kind", "a", "b"])

    rows = pages.select(html_col).mapInArrow(counted, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return weights({r["kind"]: (r["a"], r["b"]) for r in rows})


def extract(page: Column, weight: dict[str, float]) -> Column:
    """The main text."""

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract_text(x, weight) for x in batch.to_pylist()], pa.string())

    return extracted(page)


def main_text(spark: SparkSession, pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (columns of these names are replaced)."""
    return pages.withColumn("text", extract(F.col(html_col), learn(pages, html_col))).withColumn("n_chars", F.length("text").cast("long"))
