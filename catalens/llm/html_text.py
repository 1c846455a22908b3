"""Main text of web pages by consensus host paths.

1. Each page is cut into text blocks under their containers (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
   comments fall away here). A container scores the text of its blocks that isn't link text, and half of what its child containers score;
   article-like tags and classes weigh more. From the best one the page climbs to ancestors that add text (title, sibling parts) of which at most half
   is link text. It votes for the generalised path it reaches: tags and classes from the root, digits replaced.
2. Votes are counted in Spark per (host, path); the path with most votes wins its host. Counts are combined before the shuffle, so a host
   may hold any share of the pages.
3. Every page is cut again, climbs from its host's winning path likewise (not to the body) and gives the blocks under it. A page that lacks that path, or has no host, gives the blocks of its own best container.

Winners are one short row per host. Up to BROADCAST_HOSTS of them are sent to all tasks; beyond that pages and winners are joined by a shuffle.

Defined results: null, empty and text-less pages give an empty text; repeated pages are extracted alike; ties go to more text, then to the smaller
path; an empty table gives an empty result. Columns of the input stay, result columns replace those of the same name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import materialize


BROADCAST_HOSTS = 200_000
#: Elements whose content is no page text.
RAW = "script|style|noscript|template|title|textarea|iframe|svg|math|object|canvas|select|option|button|xmp"
#: Quotes count after an equals sign only. Every pattern takes what it has read, so a page is scanned once.
QUOTED = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+>"
PLAIN = r"[^<>]*+(?:>|(?=<)|\Z)"


def scanner(rest: str, last: str) -> re.Pattern[str]:
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b{rest}.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({rest})|<[!?/](?![a-zA-Z])[^>]*+(?:>|\Z){last}", re.S | re.I
    )


#: Up to the first tag that has no end outside its quotes, and from there on, where quotes don't count.
SCANNERS = scanner(QUOTED, "|(<)(?=/?[a-zA-Z])"), scanner(PLAIN, "")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CONTAINERS = frozenset("html body main article section div header footer nav aside form ul ol dl table tbody thead tfoot tr td th figure blockquote details fieldset menu dialog center hgroup search".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend".split())
DROPPED = frozenset("nav header footer aside form menu dialog search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NEVER_DROPPED = frozenset("html body main article".split())
#: Tags whose start ends open ones inside the same table, and the tags of which it ends the outermost there.
IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), **dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id tokens: content that may be longer than the article, and parts of the layout.
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay related recommended "
    "recommendations share sharing social comment comments commentlist disqus reply replies respond".split()
)
#: Words that may stand beside one of ASIDES without changing what the container is.
BESIDE = frozenset("area bar block body box card container content entry feed form grid holder inner item items left link links list main message meta outer page panel post posts right row section slot thread unit user wrap wrapper".split())
LAYOUT = frozenset("banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer header masthead toolbar pagination pager skip login search".split())
#: A token with one of these says how a container looks, not what it is: has-sidebar, comments-open, header-fixed.
MODIFIERS = frozenset("has no not with without is open opened closed fixed sticky enabled disabled active on off visible".split())
WORD_ENDS = re.compile(r"[_-]+")
ARTICLE = re.compile(r"(?:^|[\s_.-])(?:article|content|post|entry|story|main|text|body)(?:$|[\s_-])", re.I)
DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 16)
def boilerplate(names: str) -> str:
    """What the tokens of class and id call a container: "aside" or "layout" for sure, "mixed" for such a word among words that say something else, or nothing."""
    said = set()
    for token in names.lower().split():
        words = [w.rstrip("0123456789") for w in WORD_ENDS.split(token) if w]
        if MODIFIERS.isdisjoint(words):
            known = [w for k, w in enumerate(words) if w in ASIDES or w in LAYOUT and (k == 0 or w not in ("widget", "widgets"))]
            if any(w in ASIDES for w in known):
                said.add("aside" if all(w in ASIDES or w in LAYOUT or w in BESIDE or not w for w in words) else "mixed")
            elif known:
                said.add("layout" if len(known) == len(words) else "mixed")
    return min(said, default="")


def fallen(parents: list[int], tags: list[str], names: list[str], own: list[int]) -> list[bool]:
    """Which containers (parents first) fall away by their names or inside another. A container stays if it holds main, or half of what articles
    without such a name hold; one with a mixed name also if it holds most of the page's text that isn't link text."""
    text, article, main = list(own), [0] * len(own), [t == "main" for t in tags]
    for k in range(len(own) - 1, 0, -1):
        if tags[k] == "article" and not names[k]:
            article[k] = text[k]
        up = parents[k]
        text[up] += text[k] if names[k] != "aside" or main[k] or article[k] else 0
        article[up] += article[k]
        main[up] |= main[k]
    gone = [False] * len(own)
    for k in range(1, len(own)):
        stays = not names[k] or tags[k] in NEVER_DROPPED or main[k] or 0 < article[k] >= article[0] / 2 or (names[k] == "mixed" and 2 * text[k] > text[0])
        gone[k] = gone[parents[k]] or not stays
    return gone


def tokens(page: str) -> Iterator[re.Match[str]]:
    at, pattern = 0, SCANNERS[0]
    while found := pattern.search(page, at):
        if pattern is SCANNERS[0] and found[5]:
            at, pattern = found.start(), SCANNERS[1]
        else:
            yield found
            at = found.end()


@dataclass
class Tree:
    """The paths of a page (numbers, parents first; 0 is no container) and its blocks in page order: path, text, characters of link text."""

    parents: list[int]
    steps: list[str]
    blocks: list[tuple[int, str, int]]

    def __post_init__(self) -> None:
        n = len(self.parents)
        self.gain, self.size, self.links, self.first = [0.0] * n, [0] * n, [0] * n, [len(self.blocks)] * n
        for k, (at, text, links) in enumerate(self.blocks):
            self.gain[at] += max(len(text) - 2 * links, 0)
            self.size[at] += len(text)
            self.links[at] += links
            self.first[at] = min(self.first[at], k)
        for k in range(n - 1, 0, -1):
            if up := self.parents[k]:
                self.gain[up] += self.gain[k] / 2
                self.size[up] += self.size[k]
                self.links[up] += self.links[k]
                self.first[up] = min(self.first[up], self.first[k])

    def tag(self, at: int) -> str:
        return self.steps[at].partition(".")[0]

    def path(self, at: int) -> str:
        steps = []
        while at:
            steps.append(self.steps[at])
            at = self.parents[at]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int | None:
        """The number of a path that holds text."""
        known = {(up, step): k for k, (up, step) in enumerate(zip(self.parents, self.steps, strict=True)) if k}
        at: int | None = 0
        for step in path.split(">") if path else []:
            at = known.get((at, step))
            if at is None:
                return None
        return at if self.size[at] else None

    def texts(self, top: int) -> list[str]:
        under = [False] * len(self.parents)
        under[top] = True
        for k in range(top + 1, len(under)):
            under[k] = bool(top) and under[self.parents[k]]
        return [text for at, text, _ in self.blocks if under[at]]

    def climbed(self, at: int, to_body: bool) -> int:
        """The path, or its furthest ancestor up to main on the way to which each step adds text of which at most half is link text. The body
        counts if it adds a tenth to anything but an article, or holds text of its own before that of the path."""
        top = up = at
        while self.parents[up] and self.tag(up) != "main":
            up = self.parents[up]
            size = self.size[up] - self.size[top]
            if self.tag(up) in ("html", "body"):
                title = any(own == up and not links for own, _, links in self.blocks[: self.first[top]])
                article = self.tag(top) in ("article", "main")
                if not to_body or not (title or not article and 10 * size >= self.size[top]):
                    break
            if size and 2 * (self.links[up] - self.links[top]) > size:
                break
            if size:
                top = up
        return top

    def before(self, ties: list[int]) -> int:
        """Of several paths the one that is smaller step by step. They come down from the root together, each visited once."""
        lines: dict[int, list[int]] = defaultdict(list)
        wanted = set(ties)
        on_way = set()
        for k in ties:
            while k and k not in on_way:
                on_way.add(k)
                lines[self.parents[k]].append(k)
                k = self.parents[k]
        at = 0
        while at not in wanted:
            at = min(lines[at], key=lambda k: self.steps[k])
        return at

    def best(self) -> tuple[int, float] | None:
        """Number and score of the container that holds the main text; None without text."""
        if not self.blocks:
            return None
        weigh = lambda k: 1.6 if self.tag(k) in ("article", "main") else 1.25 if ARTICLE.search(self.steps[k]) else 1.0
        scores = {k: self.gain[k] * weigh(k) for k in range(len(self.steps)) if self.size[k]}
        most = max(scores.values())
        at = self.before([k for k, score in scores.items() if score == most])
        return self.climbed(at, True), most


def tree(page: str) -> Tree:
    """Containers and blocks of a page without boilerplate. Cells, rows and parts of a table end where the next one begins."""
    out: list[tuple[int, str, int]] = []  # number of the container, text, link text
    parents, path_of, tags, names, own = [0], [0], [""], [""], [0]
    known: dict[tuple[int, str], int] = {}
    path_parents, steps = [0], [""]
    stack: list[tuple[str, int, str]] = [("", 0, "")]  # tag, number, "gone" or "headings" (all else is gone)
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    leaf = ""
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            _, k, state = stack[-1]
            if text and (not state or state == "headings" and leaf in HEADINGS):
                links = len(" ".join(html.unescape("".join(linked)).split()))
                out.append((k, text, links))
                own[k] += max(len(text) - links, 0)
            parts.clear()
            linked.clear()

    def cut(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop()[0]].pop()

    for token in tokens(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
            if in_link:
                linked.append(parts[-1])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        closing = bool(token[2])
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in LEAVES:
            flush()
            leaf = "" if closing else tag
        elif tag in CONTAINERS:
            flush()
            leaf = ""
            if closing:
                if opened[tag]:
                    cut(opened[tag][-1])
                in_link = False
                continue
            table = opened["table"][-1] if opened["table"] else 0
            if ends := [k for t in IMPLIED.get(tag, ()) for k in opened[t][-1:] if k > table]:
                cut(min(ends))
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token[4])}
            state, named = stack[-1][2], boilerplate(" ".join(filter(None, (found.get("class"), found.get("id")))))
            dropped = tag in DROPPED
            if tag == "header" and (opened["article"] or opened["main"]):
                dropped, state, named = False, state or "headings", ""
            if dropped or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or (tag not in NEVER_DROPPED and found.get("role", "").lower() in DROPPED_ROLES):
                state = "gone"
            step = ".".join([tag, *sorted(DIGITS.sub("#", c.lower()).replace(">", "#") for c in found.get("class", "").split())])
            up = stack[-1][1]
            key = (path_of[up], step)
            if key not in known:
                known[key] = len(steps)
                path_parents.append(key[0])
                steps.append(step)
            opened[tag].append(len(stack))
            stack.append((tag, len(parents), state))
            parents.append(up)
            path_of.append(known[key])
            tags.append("" if state else tag)
            names.append(named)
            own.append(0)
    if at < len(page):
        parts.append(page[at:])
    flush()
    away = fallen(parents, tags, names, own) if any(names) else None
    return Tree(path_parents, steps, [(path_of[k], text, links) for k, text, links in out if not (away and away[k])])


def vote(page: str) -> tuple[str | None, float | None]:
    """Path and score of the page's own best container."""
    found = tree(page)
    best = found.best()
    return (found.path(best[0]), best[1]) if best else (None, None)


def main_text(page: str, path: str | None) -> tuple[str, str | None]:
    """(blocks under the path, or else under the page's own best container, joined by line feeds; the path used)."""
    found = tree(page)
    top = found.find(path) if path is not None else None
    if top is not None:
        top = found.climbed(top, False)
    elif best := found.best():
        top = best[0]
    return ("\n".join(found.texts(top)), found.path(top)) if top is not None else ("", None)


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, votes): the winning path of each host, stored."""

    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).filter("host is not null").mapInArrow(votes_of, "host string, path string, score double").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    winner = F.min_by(F.struct("path", "votes"), F.struct((-F.col("votes")).alias("v"), (-F.round("score")).alias("s"), "path"))
    return materialize(counted.groupBy("host").agg(winner.alias("w")).select("host", "w.path", "w.votes"), "host-paths")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The pages with text and path (of the container it comes from, null if empty)."""
    schema = [f for f in pages.schema.fields if f.name not in ("text", "path", "_host", "_path")]
    winners = host_paths(pages, url, page).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = pages.select(*[f.name for f in schema], host_of(F.col(url)).alias("_host")).join(winners, "_host", "left").drop("_host")
    order = [*[f.name for f in schema], "_path"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, paths = batch.column(batch.schema.get_field_index(page)).to_pylist(), batch.column(batch.schema.get_field_index("_path")).to_pylist()
            found = [main_text(text or "", path) for text, path in zip(own, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=[*batch.schema.names[:-1], "text", "path"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return joined.select(*order).mapInArrow(cut, f"{columns}, text string, path string")
