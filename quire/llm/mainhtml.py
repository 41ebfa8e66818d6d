"""Main text of web pages by consensus of each host's pages.

Each page's containers get a score (text in their own blocks, less link text, half of it for the parent). A container's path is made of
the tags and first classes from the body on, without digits, so that it is the same on all pages of a template. Pages vote in
Spark: a host's winning path is the one of the largest sum of score shares. Then every page is extracted again from the
containers on its host's path; a page that has none there is extracted from its own best container.

Left out are menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments: by
tag, by role, and by what a class or id names: its last word that says more than a place or shape (``cookie-notice`` and
``ad-slot-3``, but not ``notice-period``). A name drops no element that holds the page's article or heading, none that is or
holds a container on its host's winning path, and nothing where it would leave a page without text.
Inside a block white space becomes one space; blocks are trimmed and joined by one space; character references are decoded.

Cases: a null or empty page has an empty text; a page without containers gives its body's text; broken markup is read as far as it
goes, in time that grows with its length (a path of over LONG characters goes by its digest); hosts that are empty hold no vote, their pages use their own best container; repeated rows are extracted alike
(and vote twice); null ids are kept; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import checkpointed, slices, whole_text
from quire.llm.urls import host_and_path

#: Comments, declarations, and tags; a tag whose quotes do not close ends at its first ``>``, and none reaches over a ``<``.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements by what they are.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div td th table tr tbody thead tfoot ul ol dl nav header footer aside form fieldset figure blockquote details dialog menu noscript template select button svg canvas object search address".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr figcaption summary caption legend option center".split())
DROPPED = frozenset("nav aside footer dialog menu noscript template select button svg canvas object search".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation complementary contentinfo search alert alertdialog dialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices "
    "notification notifications popup modal overlay newsletter subscribe subscription signup sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs toolbar "
    "footer masthead comment comments disqus discussion replies respond related recommended share sharing social pagination pager login search skip".split()
)
#: Words after the one that says what an element is.
SHAPES = frozenset(
    "area bar bars block blocks body bottom box boxes button buttons card center column columns container content entry footer form group header inner item items left link links "
    "list main module outer panel posts right section slot slots stories thread title toggle top unit units widget widgets wrap wrapper zone".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text".split())


#: Letters of a path from which on its digest stands for it, which keeps pages of deep nesting in bounded memory.
LONG = 1024


def named(name: str) -> bool:
    """Does a class or id name something that is left out?"""
    words = [w.lower() for w in WORDS.findall(name)]
    if words and words[-1] in DROPPED_WORDS:
        return True
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    return bool(words) and words[-1] in DROPPED_WORDS


class Page:
    """A page's containers and its text by block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.hard = ["root"], [0], [""], [False]
        self.weight, self.soft, self.saved, self.level = [1.0], [False], [False], [0]
        self.within = [False]  # is the container inside an article or main?
        self.blocks: list[list] = []  # container, text, link characters
        self._read(source)
        for k in range(len(self.tag) - 1, 0, -1):  # a name drops no element that holds the article
            if self.saved[k]:
                self.saved[self.parent[k]] = True
        self.drop = self._drops(self.saved)
        if not any(not self.drop[c] for c, _, _ in self.blocks):  # nor a page's only text
            self.drop = self._drops([True] * len(self.tag))

    def _drops(self, saved: list[bool]) -> list[bool]:
        out = [False] * len(self.tag)
        for k in range(1, len(out)):
            out[k] = out[self.parent[k]] or self.hard[k] or self.soft[k] and not saved[k]
        return out

    def _open(self, tag: str, attributes: str, at: int) -> int:
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        names = found.get("class", "").split()
        first = re.sub(r"[\d_-]+", "", names[0]) if names else ""
        inside, within, level = self.path[at], self.within[at], self.level[at] + 1
        called = [*names, *found.get("id", "").split()]
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        self.tag.append(tag)
        self.parent.append(at)
        self.level.append(level)
        path = f"{inside}>{tag}" + (f".{first}" if first else "")
        self.path.append(path if len(path) <= LONG else "#" + xxhash.xxh3_128_hexdigest(path))
        self.within.append(within or tag in ("article", "main"))
        self.hard.append(bool(tag in DROPPED or found.get("role", "").lower() in ROLES or hidden or tag == "header" and not within))
        self.soft.append(tag in FORMS or any(map(named, called)) or not within and any(w[-1:] in (["header"], ["Header"]) for w in map(WORDS.findall, called)))
        self.saved.append(tag in ("article", "main"))
        good = any(w.lower() in GOOD_WORDS for n in called for w in WORDS.findall(n))
        self.weight.append((1.5 if tag in ("article", "main") else 1.0) * (1.25 if good else 1.0))
        return len(self.tag) - 1

    def _read(self, source: str):
        stack, links, at = [0], 0, 0
        open_tags: dict[str, int] = {}
        parts: list[str] = []
        linked = 0

        def close():
            nonlocal linked
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append([stack[-1], text, linked])
            parts.clear()
            linked = 0

        pos, size = 0, len(source)
        while m := TOKEN.search(source, pos):
            if m.start() > at:
                parts.append(source[at : m.start()])
                linked += (m.start() - at) * (links > 0)
            pos = at = m.end()
            ends, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                close()
            if ends:
                if tag == "a":
                    links = max(0, links - 1)
                elif open_tags.get(tag):
                    while True:
                        last = self.tag[stack.pop()]
                        open_tags[last] -= 1
                        if last == tag:
                            break
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                pos = at = end.end() if end else size
            elif tag == "a":
                links = 1
            elif tag == "h1":
                self.saved[stack[-1]] = True
            elif tag in CONTAINERS and not attributes.rstrip().endswith("/"):
                stack.append(self._open(tag, attributes, stack[-1]))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < size:
            parts.append(source[at:])
        close()

    def scores(self) -> np.ndarray:
        out = np.zeros(len(self.tag))
        for c, text, linked in self.blocks:
            if not self.drop[c]:
                value = max(0, len(text) - 2 * linked)
                out[c] += value
                out[self.parent[c]] += value / 2 * (c > 0)
        return np.where(self.drop, 0, out * np.array(self.weight))

    def votes(self) -> dict[str, float]:
        """Each path's share of the page's best score."""
        found = self.scores()
        best = found.max()
        out: dict[str, float] = {}
        if best > 0:
            for path, s in zip(self.path, found.tolist(), strict=True):
                if s > 0:
                    out[path] = max(out.get(path, 0.0), s / best)
        return out

    def text(self, path: str | None) -> str:
        """The blocks inside the containers on ``path``, or inside the best container where there are none."""
        drop = self.drop
        chosen = [p == path for p in self.path] if path is not None else [False] * len(self.path)
        if any(chosen):
            saved = [a or b for a, b in zip(self.saved, chosen, strict=True)]
            for k in range(len(saved) - 1, 0, -1):
                if saved[k]:
                    saved[self.parent[k]] = True
            drop = [a and b for a, b in zip(drop, self._drops(saved), strict=True)]
        chosen = [a and not b for a, b in zip(chosen, drop, strict=True)]
        if not any(chosen):
            drop = self.drop
            best = int(np.argmax(self.scores()))
            chosen = [k == best for k in range(len(drop))]
        for k in range(1, len(chosen)):
            chosen[k] = chosen[k] or chosen[self.parent[k]]
        return " ".join(text for c, text, _ in self.blocks if chosen[c] and not drop[c])


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host, _ = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), whole_text(html_col).alias("html"))


def winning_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: each host's path of the most votes, the first in order on ties."""

    def run(batches):
        for b in slices(batches):
            cast: dict[tuple, float] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, share in Page(source).votes().items():
                    cast[host, path] = cast.get((host, path), 0.0) + share
            keys = list(cast)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([round(1e6 * cast[k]) for k in keys], pa.int64())], ["host", "path", "vote"])

    rows = _pages(pages, id_col, url_col, html_col).where("host != ''").select("host", "html")
    votes = rows.mapInArrow(run, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("vote")).alias("v"), "path")).alias("t")).select("host", F.col("t.path").alias("path"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """``page_id, url, path, text`` of every row; ``path`` is the host's, null where the host is empty or has none.

    The hosts' paths are broadcast where a count shows ``broadcast_hosts`` at most; else pages are joined by host.
    """
    paths = checkpointed(winning_paths(pages, id_col, url_col, html_col))
    if paths.count() <= broadcast_hosts:
        paths = F.broadcast(paths)

    def run(batches):
        for b in slices(batches):
            texts = [Page(source).text(path) for path, source in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"])

    rows = _pages(pages, id_col, url_col, html_col).join(paths, "host", "left").select("page_id", "url", "path", "html")
    return rows.mapInArrow(run, "page_id long, url string, path string, text string")
