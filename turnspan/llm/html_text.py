"""Main-text extraction by consensus on host paths.

1. Each page is cut into blocks of text, each with the chain of containers it stands in; a container
   is named by its tag and class with digits generalised, so `div.post-17` and `div.post-18` are one
   path, and a path is known by a digest. Every container of the page gets a score: the text of its own paragraphs less its links,
   weighed by what its name says.
2. In Spark, each page votes for the path of its best container; votes and scores are summed by host
   and path (a partial aggregation, so a host with a third of all pages is no hot group).
3. Every page names the paths that it has text under (their set is its shape); each shape's paths are
   joined with the votes of its host, all of them, and the one with the most votes wins. The page is
   read again: its text is all blocks under that path, without what is named as boilerplate inside it
   (names that an article's own sections may have count there only where links are most of the text).
   A page that has none of its host's paths keeps its own best container.

Character references are decoded, white space inside a block becomes one space, and blocks are
joined in page order by newlines.

Edge cases: a null or empty page, or one without text outside boilerplate, gives an empty text; a
null or odd url belongs to the host ''; unclosed and misnested tags are closed as a browser would
by the next block; repeated rows get equal results (and each votes); empty tables give no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspan.session import cut

from .batches import small_batches

BROADCAST_SHAPES = 50_000

#: A quote opens a value only after an equals sign; elsewhere it is like any other character.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|<[!?/][^>]*+>""", re.S)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")
_STATE = re.compile(r"(?:has|no|with|without|is|js)[-_]")
#: Elements whose content is no text, read up to their end tag.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "title", "object", "canvas", "video", "audio", "xmp"}
#: Containers make paths; leaves part blocks; all other elements are inline.
_CONTAINERS = {"body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "fieldset", "figure", "details", "center", "menu", "dialog", "blockquote", "hgroup"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "address", "summary", "legend", "hr"}
_BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "button"}
#: Words of class, id and role that name boilerplate; and that name content.
_BOILERPLATE = set(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement banner cookie cookies consent gdpr popup modal overlay"
    " promo promotion sponsor sponsored share sharing social recommendations comment comments respond newsletter subscribe subscription signup login"
    " breadcrumb breadcrumbs pagination pager widget toolbar masthead contentinfo outbrain taboola".split()
)
#: These may as well name a part of an article: inside one they count only where links are most of the text.
_DOUBTFUL = set("notice notices related recommend recommended reply replies discussion copyright legal disclaimer search tags skip alert complementary toc".split())
_HEADS = {"header", "masthead", "topbar", "banner"}
_CONTENT = set("article content post entry story main body text page blog news".split())


def _words(names: str) -> list[str]:
    """The words of an attribute's names; names like `has-sidebar` tell about the layout, not the element."""
    return [w for name in names.lower().strip("\"'").split() if not _STATE.match(name) for w in _PART.findall(name)]


class _Node:
    """A container of a page; key: a digest of its path from the root, which costs as much at any depth."""

    __slots__ = ("step", "key", "depth", "parent", "bad", "doubt", "own", "links", "weight", "inside")

    def __init__(self, step: str, parent: _Node | None, bad: bool = False, weight: float = 1.0, inside: bool = False, doubt: bool = False):
        self.step, self.parent, self.bad, self.weight, self.inside, self.doubt = step, parent, bad, weight, inside, doubt
        self.key = hashlib.md5((parent.key if parent else b"") + step.encode("utf-8", "replace")).digest()
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.links = 0.0

    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


Blocks = list[tuple[str, _Node]]


def blocks_of(page: str) -> Blocks:
    """(text, container) for each block of a page in its order; text under boilerplate is left out."""
    root = _Node("", None)
    node, nodes, stack, opened = root, [root], [("", root)], Counter()
    out: Blocks = []
    parts: list[str] = []
    in_link, linked, at = 0, 0, 0
    last, endless = page.rfind(">"), set()  # no tag ends after the last ">"

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                size = len(text)
                node.own += size
                node.links += min(linked, size)
                if not node.bad:
                    out.append((text, node))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if not node.bad:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def skipped(name: str, at: int) -> int | None:
        """Where an element ends that is left out; None if it never does."""
        if name in endless:
            return None
        end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        if end is None:
            endless.add(name)
        return end.end() if end else None

    while at < len(page):
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith("<!--", start)):
            cut_off = _OPENS.search(page, max(start, at)) if start >= 0 else None  # a tag that the page's end cuts off
            add(page[at : cut_off.start() if cut_off else len(page)])
            break
        token = _TOKEN.match(page, start)
        if token is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        at = token.end()
        name = token.group(2)
        if name is None:
            continue
        name = name.lower()
        if token.group(1):
            if name in _CONTAINERS:
                if opened[name]:
                    flush()
                    while True:
                        closed = stack.pop()[0]
                        opened[closed] -= 1
                        if closed == name:
                            break
                    node, in_link = stack[-1][1], 0
            elif name in _LEAVES:
                flush()
            elif name == "a":
                in_link = max(0, in_link - 1)
            continue
        rest = token.group(3)
        if name in _RAW:
            if not rest.endswith("/"):
                end = skipped(name, at)
                at = len(page) if end is None else end
            if name == "title":
                flush()
        elif name in _CONTAINERS:
            flush()
            names = [w for m in _NAMES.findall(rest) for w in _words(m)] if rest else []
            main = name in ("article", "main")
            doubtful = name != "body" and not main and any(w in _DOUBTFUL for w in names)
            bad = node.bad or name in _BOILERPLATE_TAGS or bool(rest and _HIDDEN.search(rest)) or (name != "body" and not main and any(w in _BOILERPLATE for w in names))
            if not node.inside and (name == "header" or any(w in _HEADS for w in names) or doubtful):
                bad = True
            weight = 1.5 if main else 1.25 if any(w in _CONTENT for w in names) else 0.5 if name in ("ul", "ol", "dl", "menu", "tr") else 1.0
            classes = _CLASS.findall(rest) if rest else []
            step = name + "".join(sorted({"." + re.sub(r"\d+", "#", c.lower()) for m in classes for c in m.strip("\"'").split()}))
            node = _Node(step, node, bad, weight, node.inside or main or "article" in names, doubtful)
            nodes.append(node)
            stack.append((name, node))
            opened[name] += 1
            in_link = 0
        elif name in _LEAVES:
            flush()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link += 1
        elif name == "button" and not rest.endswith("/"):
            end = skipped(name, at)
            at = at if end is None else end
        elif name == "body":
            flush()
    flush()
    return _settled(out, nodes)


def _settled(blocks: Blocks, nodes: list[_Node]) -> Blocks:
    """Without the blocks under doubtful containers of which links are most."""
    doubted = [n for n in nodes if n.doubt and not n.bad]
    if not doubted:
        return blocks
    own, links = {n: n.own for n in nodes}, {n: n.links for n in nodes}
    for n in reversed(nodes[1:]):
        own[n.parent] += own[n]
        links[n.parent] += links[n]
    for n in doubted:
        n.bad = 2 * links[n] > own[n]
    for n in nodes[1:]:
        n.bad = n.bad or n.parent.bad
    return [(t, n) for t, n in blocks if not n.bad]


def container_scores(blocks: Blocks) -> dict[_Node, float]:
    """Score by the first container of each path: a container's own paragraphs count in full, its
    children's by a part, so the one that holds the paragraphs themselves wins over those around it."""
    first: dict[bytes, _Node] = {}
    scores: dict[_Node, float] = {}
    for n in {n: None for _, n in blocks}:
        value, share = max(0.0, n.own - 2 * n.links), 1.0
        m: _Node | None = n
        while m is not None and share > 0.1:
            if m.parent is not None or m is n:  # the page itself only for text outside any container
                held = first.setdefault(m.key, m)
                scores[held] = scores.get(held, 0.0) + value * share * m.weight
            m, share = m.parent, share * 0.6
    return scores


def best_container(scores: dict[_Node, float]) -> _Node | None:
    """The container with the largest score; the outermost, and then the first by key, of equal ones."""
    return min(scores, key=lambda n: (-scores[n], n.depth, n.key)) if scores else None


def text_under(blocks: Blocks, key: bytes) -> str:
    """The text of all blocks in containers of that key, or inside of these."""
    known: dict[_Node, bool] = {}

    def under(n: _Node) -> bool:
        way, m = [], n
        while m is not None and m not in known and m.key != key:
            way.append(m)
            m = m.parent
        found = m is not None and known.get(m, True)
        known.update(dict.fromkeys(way, found))
        return found

    return "\n".join(t for t, n in blocks if under(n))


def keys_of(blocks: Blocks) -> dict[bytes, _Node]:
    """The keys that text_under finds text by, and the first container of each."""
    found: dict[bytes, _Node] = {}
    seen: set[_Node] = set()
    for _, n in blocks:
        m: _Node | None = n
        while m is not None and m not in seen:
            seen.add(m)
            found.setdefault(m.key, m)
            m = m.parent
    return found


def shape_of(keys: dict[bytes, _Node]) -> bytes:
    return hashlib.md5(b"".join(sorted(keys))).digest()


def host_of(url: Column) -> Column:
    """The host of a url in lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch of (host, page): its votes (host, at, depth, votes, score) and its shapes (host, shape, keys)."""
    for batch in batches:
        votes: dict[tuple[str, bytes], list[float]] = {}
        shapes: dict[tuple[str, bytes], list[bytes]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            blocks = blocks_of(page.as_py() or "")
            scores, keys = container_scores(blocks), keys_of(blocks)
            best = best_container(scores)
            if best is not None:
                held = votes.setdefault((host, best.key), [best.depth, 0, 0.0])
                held[1] += 1
                held[2] += scores[best]
            shapes[host, shape_of(keys)] = list(keys)
        none = [None] * len(shapes)
        columns = [
            [*(k[0] for k in votes), *(k[0] for k in shapes)],
            [*(k[1] for k in votes), *none],
            *([*(v[i] for v in votes.values()), *none] for i in range(3)),
            [*([None] * len(votes)), *(k[1] for k in shapes)],
            [*([None] * len(votes)), *shapes.values()],
        ]
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "at", "depth", "votes", "score", "shape", "keys"])


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [shape_of(keys_of(blocks_of(page.as_py() or ""))) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.binary())], names=["id", "url", "html", "host", "shape"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, used = [], []
        for page, key in zip(batch.column(2), batch.column(3).to_pylist()):
            blocks = blocks_of(page.as_py() or "")
            found = keys_of(blocks).get(key) or best_container(container_scores(blocks))
            texts.append(text_under(blocks, found.key) if found is not None else "")
            used.append(found.path() if found is not None else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
            names=["id", "url", "text", "n_chars", "path"],
        )


def shape_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, shape, path): for each host's pages of one shape, of the paths voted on the host that
    they have text under, the key of the one of most votes, then score, then least depth."""
    rows = small_batches(pages).select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    seen = cut(rows.mapInArrow(_profiles, "host string, at binary, depth long, votes long, score double, shape binary, keys array<binary>"))
    votes = seen.filter("at is not null").groupBy("host", "at").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"), F.min("depth").alias("depth"))
    votes = votes.select("host", "at", F.struct((-F.col("votes")).alias("v"), (-F.floor("score")).alias("s"), "depth", F.col("at").alias("path")).alias("vote"))
    shapes = seen.filter("shape is not null").select("host", "shape", "keys").dropDuplicates(["host", "shape"])
    named = shapes.select("host", "shape", F.explode("keys").alias("at"))
    return named.join(votes, ["host", "at"]).groupBy("host", "shape").agg(F.min("vote")["path"].alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, path), a row for each page; path: where its text was found."""
    paths = cut(shape_paths(pages, url_col, html_col))
    small = paths.count() <= BROADCAST_SHAPES  # a path each
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    rows = rows.mapInArrow(_shaped, f"id {id_type}, url string, html string, host string, shape binary")
    joined = rows.join(F.broadcast(paths) if small else paths, ["host", "shape"], "left").select("id", "url", "html", "path")
    out = joined.mapInArrow(_read, f"id {id_type}, url string, text string, n_chars long, path string")
    return out.toDF(id_col, url_col, "text", "n_chars", "path")
