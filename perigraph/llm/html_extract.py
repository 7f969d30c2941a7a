"""Main-text extraction by consensus paths of each host.

Every page scores its containers by the text of their blocks and by how little of it is links. Text in an article or
main counts for the outermost of them; else one container may hold nearly all the text, or most of it, and takes it all,
with its headings; else blocks count for what they stand in. Each container votes for its generalised path (tags with
classes, digits folded) with its share of the page's score; Spark sums the votes of a host, and each page is extracted
again from the containers at its host's winning paths: the best, and others with comparable votes, so that a text that
is always split over several containers stays whole.

Time and memory grow linearly with a page at any nesting: elements know their nearest container and wrapper, and sums
over what an element holds are carried from the innermost outwards.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, small_side, whole_text

# Element names by their role in HTML, and words in class or id that name page furniture.
RAW = frozenset("script style noscript template iframe svg object textarea title select canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("article section main div body td center".split())
FURNITURE = frozenset("nav header footer aside form menu dialog legend fieldset head search annotation annotation-xml".split())
CONTROLS = frozenset("button label".split())
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups promo promotion recommended related reply replies respond share sharing sidebar signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tags toc toolbar topbar widget widgets".split())
#: Words that a paragraph of an article may have and yet be its text.
TEXT_WORDS = frozenset("byline promotion related skip social tags toc widget widgets".split())
#: Furniture of these words stays so, however much text it holds.
READERS_WORDS = frozenset("comment comments disqus reply replies respond".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open p ends where one of these starts; an open element of a key ends where one of its values starts.
ENDS_P = BLOCK - frozenset("html body tbody td tfoot th thead tr caption".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def path_step(tag: str, classes: str) -> str:
    """A tag with its sorted classes, runs of digits folded, so that numbered siblings look alike."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})])


#: Furniture or not; the last two may turn out to be wrappers of the page's text, LIKELY by holding most of it.
SHOWN, HIDDEN, READERS, LIKELY = 0, 1, 2, 3
#: The share of a page's text that one container must hold to take it all; if none does, the lesser share.
NEARLY_ALL, MOST = 0.9, 0.5
#: Besides the best path of a host, those win that have this share of its votes, and this share of all.
OF_BEST, OF_ALL = 0.5, 0.05
#: Longer paths are told by a digest of their beginning.
PATH_CHARS = 400
#: Tags that a new element's implied ends look at.
ENDING = frozenset([*ENDS, "p"])
SHIELDS = CONTAINER | frozenset("ul ol dl table".split())


def furniture_kind(tag: str, attributes: dict[str, str], in_article: bool = False) -> int:
    if tag in FURNITURE and tag != "form" or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDING.search(attributes.get("style", "")):
        return HIDDEN
    if tag in ("html", "body", "main", "article") and "comment" not in attributes.get("class", "").lower():
        return SHOWN
    words = re.split(r"[\s_-]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    known = FURNITURE_WORDS - TEXT_WORDS if tag == "p" and in_article else FURNITURE_WORDS
    if tag != "form" and attributes.get("role") not in FURNITURE_ROLES and known.isdisjoint(words):
        return SHOWN
    if tag not in BLOCK or tag == "article":
        return HIDDEN
    return LIKELY if READERS_WORDS.isdisjoint(words) else READERS


def worth(text: str, linked: int) -> float:
    return (len(text) - linked) ** 2 / max(1, len(text))


def longer(path: str, step: str) -> str:
    """The path of an element within what stands at a path."""
    out = f"{path}>{step}" if path else step
    return out if len(out) <= PATH_CHARS else f"{hashlib.sha256(out.encode()).hexdigest()[:32]}>{step[-PATH_CHARS // 2 :]}"


class Element(NamedTuple):
    """An open element, and the places on the stack of the nearest (or itself) of some kinds."""

    tag: str
    hidden: bool
    path: str
    container: int
    wrapper: int
    ending: int  # what implied ends look at, or what they stop at
    block: int
    shield: int  # a container


class Container(NamedTuple):
    tag: str
    path: str
    parent: int
    root: int  # the outermost article or main, -1 if there is none
    solid: int  # the nearest that is no section; itself if there is none
    above: int  # the next solid one, or -1
    wrapper: int  # the wrapper around it, or -1


class Page:
    """The text blocks of a page in order, each with its innermost container; furniture is left out."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, length of its link text, container
        self.heads: set[int] = set()  # containers with a heading of their own
        self.containers = [Container("body", "", -1, -1, 0, -1, -1)]  # the page itself comes first
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements on the stack, by tag
        self.wrappers: list[tuple[int, int]] = []  # kind and parent of what may be furniture or a wrapper of the page's text
        self.found: list[tuple[str, int, int, int, bool]] = []  # blocks with container, wrapper, and if headings
        self.text: list[str] = []
        self.asides: list[int] = []  # places in text of what stands in controls
        self.linked, self.hidden, self.controls = 0, 0, 0
        self.read(source)
        self.settle()

    def flush(self) -> None:
        if self.text:
            # Controls within a sentence belong to it; those that are most of their block are furniture.
            if self.asides and 2 * sum(len(self.text[i].strip()) for i in self.asides) > sum(len(x.strip()) for x in self.text):
                for i in self.asides:
                    self.text[i] = ""
            text = " ".join("".join(self.text).split())
            if text:
                last = self.stack[-1] if self.stack else None
                heading = bool(self.places["h1"] or self.places["h2"])
                self.found.append((text, min(self.linked, len(text)), last.container if last else 0, last.wrapper if last else -1, heading))
        self.text, self.linked, self.asides = [], 0, []

    def settle(self) -> None:
        """Leaves out the blocks in furniture, but not for a wrapper around the page's article or around most of its text."""
        holds, total, full = [0.0] * len(self.wrappers), 0.0, [False] * len(self.containers)
        for text, linked, container, wrapper, _ in self.found:
            points = worth(text, linked)
            total += points
            full[container] = True
            if wrapper >= 0:
                holds[wrapper] += points
        inside = [False] * len(self.wrappers)  # wrappers around an article or main with text
        for i in range(len(self.containers) - 1, 0, -1):
            own = self.containers[i]
            full[own.parent] |= full[i]
            if full[i] and own.tag in ("article", "main") and own.wrapper >= 0:
                inside[own.wrapper] = True
        for i in range(len(self.wrappers) - 1, -1, -1):
            if self.wrappers[i][1] >= 0:
                holds[self.wrappers[i][1]] += holds[i]
                inside[self.wrappers[i][1]] |= inside[i]

        def all_around(flags: list[bool]) -> list[bool]:
            out: list[bool] = []
            for flag, (_, parent) in zip(flags, self.wrappers, strict=True):
                out.append(flag and (parent < 0 or out[parent]))
            return out

        open_ = all_around(inside)
        shown = any(self.containers[c].root >= 0 and (w < 0 or open_[w]) for _, _, c, w, _ in self.found)
        kept = all_around([inside[i] or kind == LIKELY and not shown and 2 * holds[i] > total for i, (kind, _) in enumerate(self.wrappers)])
        for text, linked, container, wrapper, heading in self.found:
            if wrapper < 0 or kept[wrapper]:
                self.blocks.append((text, linked, container))
                if heading:
                    self.heads.add(self.containers[container].solid)

    def put(self, raw: str) -> None:
        if not self.hidden:
            text = html.unescape(raw)
            if self.controls:
                self.asides.append(len(self.text))
            self.text.append(text)
            if self.places["a"]:
                self.linked += len(text.strip())

    def pop(self) -> None:
        gone = self.stack.pop()
        self.hidden -= gone.hidden
        self.controls -= gone.tag in CONTROLS
        self.places[gone.tag].pop()

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    def close(self, tag: str) -> None:
        """Ends the innermost open element of that tag and all within; blocks shield what is around them from the end of
        what is no block, containers from the end of a paragraph."""
        if not self.places[tag]:
            return
        at, last = self.places[tag][-1], self.stack[-1]
        if not (tag not in BLOCK and last.block > at or tag == "p" and last.shield > at):
            self.cut(at)

    def end_implied(self, tag: str) -> None:
        at = self.stack[-1].ending if self.stack else -1
        while at >= 0:
            now = self.stack[at].tag
            if now == "p" and tag in ENDS_P or tag in ENDS.get(now, ()):
                return self.cut(at)
            if now in SHIELDS:
                return None
            at = self.stack[at - 1].ending if at else -1

    def open(self, tag: str, raw: str) -> None:
        if tag in BLOCK and self.places["head"]:  # a head whose end tag is left out
            self.close("head")
        if tag in ENDS_P or tag in ENDS:
            self.end_implied(tag)
        attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)} if raw else {}
        if raw and re.search(r"(?:^|\s)hidden(?:\s|$|=)", raw.lower()):
            attributes["hidden"] = ""
        last = self.stack[-1] if self.stack else Element("", False, "", 0, -1, -1, -1, -1)
        kind, place = furniture_kind(tag, attributes, self.containers[last.container].root >= 0), len(self.stack)
        wrapper, container, path = last.wrapper, last.container, last.path
        if tag in CONTAINER or tag == "html":
            path = longer(path, path_step(tag, attributes.get("class", "")))
        if tag in CONTAINER:
            around, container = self.containers[container], len(self.containers)
            root = around.root if around.root >= 0 else container if tag in ("article", "main") else -1
            plain = tag == "section" and last.container  # a section is a part of what is around it
            self.containers.append(Container(tag, path, last.container, root, around.solid if plain else container, around.above if plain else around.solid, wrapper))
        if kind in (READERS, LIKELY):
            self.wrappers.append((kind, wrapper))
            wrapper = len(self.wrappers) - 1
        near = lambda kinds, before: place if tag in kinds else before
        self.stack.append(Element(tag, kind == HIDDEN, path, container, wrapper, place if tag in ENDING or tag in SHIELDS else last.ending, near(BLOCK, last.block), near(CONTAINER, last.shield)))
        self.places[tag].append(place)
        self.hidden += kind == HIDDEN
        self.controls += tag in CONTROLS

    def read(self, source: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self.put(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self.flush()
            elif tag == "br" and not self.hidden:
                self.text.append(" ")
            if m[1] or m[4]:
                self.close(tag)
            elif tag in RAW:
                if not (m[3] or "").endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
            elif tag not in VOID:
                self.open(tag, m[3] or m[6] or "")
        if at < len(source):
            self.put(source[at:])
        self.flush()

    def holder(self, loose: list[tuple[float, int]], share: float) -> int | None:
        """The smallest container with a share of what these blocks are worth; the one around it if it adds text of its own."""
        below, direct = [0.0] * len(self.containers), set()
        for points, container in loose:
            below[container] += points
            if points:
                direct.add(container)
        total, depth = sum(below), [0] * len(self.containers)
        for i in range(len(self.containers) - 1, 0, -1):
            if self.containers[i].solid == i and self.containers[i].above >= 0:
                below[self.containers[i].above] += below[i]
        for i, own in enumerate(self.containers):
            depth[i] = depth[own.above] + 1 if own.above >= 0 else 0
        found = [i for i, x in enumerate(below) if total and x >= share * total and self.containers[i].tag != "body"]
        if not found:
            return None
        best = outer = max(found, key=lambda i: (depth[i], -i))
        while (outer := self.containers[outer].above) >= 0:
            if outer in (self.heads if self.containers[outer].tag == "body" else direct):
                best = outer
        return best

    def scores(self) -> dict[str, int]:
        """Points of container paths, 1000 in all, about.

        A block counts for the outermost article or main around it. Of the others, all count for the container that holds
        nearly all of them, or else most, or else each for its innermost container. Sections are parts of what is around
        them.
        """
        points: dict[str, float] = defaultdict(float)
        loose = []
        for text, linked, container in self.blocks:
            own = self.containers[container]
            if own.root >= 0:
                points[self.containers[own.root].path] += worth(text, linked)
            else:
                loose.append((worth(text, linked), own.solid))
        holder = self.holder(loose, NEARLY_ALL)
        holder = self.holder(loose, MOST) if holder is None else holder
        for value, container in loose:
            points[self.containers[container if holder is None else holder].path] += value
        total = sum(points.values())
        return {k: n for k, v in points.items() if (n := round(1000 * v / total))} if total else {}

    def main_text(self, paths: set[str]) -> str:
        """The blocks in containers at the paths, or at the page's own best ones where it has no such container."""
        text = self.text_at(paths)
        if text is None:
            own = self.scores()
            text = self.text_at({k for k, v in own.items() if v >= OF_BEST * max(own.values())})
        return "\n".join(x[0] for x in self.blocks) if text is None else text

    def text_at(self, paths: set[str]) -> str | None:
        chosen: list[bool] = []
        for own in self.containers:
            chosen.append(own.path in paths or own.parent >= 0 and chosen[own.parent])
        found = [text for text, _, container in self.blocks if chosen[container]]
        return "\n".join(found) if found else None


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, paths (the host's winning container paths).

    Blocks are joined by line feeds; white space inside a block is one space. Null or empty html gives an empty text; a
    null or odd url belongs to the host "" and votes with its like. Ties for the best path go to the first in text order;
    a host has at most 21 winning paths. A page without a container at one of them follows its own votes, and a page
    whose text is all links gives all of it. Buttons and labels stay where most of their block is other text; formulas stay,
    drawings do not. Rows that repeat an id each get a row; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    bound_batches(pages.sparkSession)
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), whole_text(F.col(f"`{html_col}`")).alias("html"))
    own = own.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))

    def vote(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, points in Page(source).scores().items():
                    votes[host, path] += points
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "points"])

    votes = own.select("host", "html").mapInArrow(vote, "host string, path string, points long").groupBy("host", "path").agg(F.sum("points").alias("points"))
    votes = materialize(votes, "host-votes")
    best = votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("points"), F.col("path"))).alias("best"), F.max("points").alias("most"), F.sum("points").alias("total"))
    wins = (F.col("path") == F.col("best")) | (F.col("points") >= F.col("most") * OF_BEST) & (F.col("points") >= F.col("total") * OF_ALL)
    winners = votes.join(small_side(materialize(best, "host-best"), 600), "host").filter(wins)
    winners = materialize(winners.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths")), "host-paths")

    def extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [Page(source).main_text(set(paths or ())) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "paths"])

    joined = own.join(small_side(winners, 1024), "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(extract, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, paths array<string>")
