"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's token streams: tags, text slots,
optional groups and repeated groups. It starts as one page, with all that the page has, and is aligned with
further pages of the host, one by one: elements are paired in order, what only one side has becomes a
repeated group beside its like and an optional group elsewhere, and texts that differ become a slot; texts
that the pages share are the host's template. From what varies the wrapper tells where the host keeps its
articles, and which groups are lists of links or records such as readers' comments. Each page is then
matched against the expression, and the slots inside the article's place are its text.

Pages that don't fit, and hosts of too few pages, are judged by their own stream and by fixed lists of tags,
roles and words. Inside a wrapper's article the lists only take out what is a smaller part of it.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, groups, hubs, spread_join, written

#: Pages of a host that a wrapper is inferred from (chosen by hash), how many must differ for it to say anything, and for shared texts to be template.
SAMPLE, LEAST, DIFFERENT = 8, 3, 4
#: Elements around a block that alignment looks at; deeper ones count as part of the last of these.
DEPTH = 64
#: Children of an element that are aligned in order; of longer lists, those of one name are a repeated group.
ORDERED = 64
#: Like neighbours from which on any element, and not only prose, is a repeated group.
MANY = 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: What an open element of the name is closed by, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A paragraph ends where one of these elements does.
SCOPES = BLOCKS - {"p"}
ASIDE = frozenset("nav footer aside form script style noscript iframe button select textarea template dialog menu search head title object svg canvas audio video label input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social follow related recommended recommendations teaser comment comments commentlist discussion reply replies respond disqus widget widgets pagination pager copyright disclaimer hidden skip search".split()
)
#: Parts of an article by tag: their ids name topics, apart from those of readers' comments.
TOPICS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CORE = frozenset(("html", "body", "article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt tr td th blockquote pre option figure figcaption section".split())


@dataclass
class Node:
    """An element of a stream or wrapper; ``name`` is "" for a text slot, whose ``text`` is None once it varies."""

    name: str
    children: list[Node] = field(default_factory=list)
    text: str | None = None
    repeated: bool = False
    optional: bool = False
    weight: float = 0.0  # of a slot: characters outside links, and inside them
    linked: float = 0.0
    pages: int = 1
    hard: bool = False
    keep: bool = True
    at: int = -1

    @property
    def shape(self) -> frozenset[str]:
        return frozenset(c.name for c in self.children)


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /\t\r\n\f") else {}


def signature(tag: str, own: dict[str, str]) -> str:
    """A tag with those of its classes that have no digits."""
    classes = sorted(c for c in own.get("class", "").split() if not any(x.isdigit() for x in c))
    return ".".join([tag, *classes]) + ("@main" if own.get("role") == "main" else "")


def tag_of(name: str) -> str:
    return name.split(".")[0].split("@")[0]


def beside(tag: str, own: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element says that it is no part of an article: by what its tag or role means, and by the words in its classes and id."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True, False
    if not own:
        return False, False
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True, False
    if tag in CORE:
        return False, False
    words_in = lambda name: {w.lower() for w in NAME.findall(html.unescape(own.get(name, "")))}
    words, ids = words_in("class"), words_in("id")
    if in_article and tag in TOPICS:
        ids &= READERS if tag == "section" else frozenset()
    words |= ids
    return False, bool(words & WORDS) or (not in_article and bool(words & {"header", "banner"}))


@dataclass
class Block:
    """A text block: the signatures and serial numbers of the elements around it, its text, characters in links, and whether tags (``hard``) or words (``soft``) put it beside the article."""

    path: tuple[tuple[str, int], ...]
    text: str
    linked: int
    hard: bool
    soft: bool


@dataclass
class Open:
    """An open element, with all that its blocks need to know of those around it."""

    tag: str
    path: tuple[tuple[str, int], ...]
    hard: bool
    soft: bool
    article: bool
    block: int  # where the nearest element is that ends blocks, itself included; -1: none


class Opened:
    """The elements open at a place of a page; what is asked of them takes the same time however many they are."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.serial = 0
        self.root = Open("", (), False, False, False, -1)

    @property
    def last(self) -> Open:
        return self.stack[-1] if self.stack else self.root

    def nearest(self, names: frozenset[str] | set[str]) -> int:
        return max((own[-1] for n in names if (own := self.places.get(n))), default=-1)

    def push(self, tag: str, own: dict[str, str], hard: bool, soft: bool) -> None:
        up = self.last
        self.serial += 1
        path = (*up.path, (signature(tag, own), self.serial)) if tag in BLOCKS and len(up.path) < DEPTH else up.path
        self.places.setdefault(tag, []).append(len(self.stack))
        ends = tag in BLOCKS or hard or soft
        self.stack.append(Open(tag, path, up.hard or hard, up.soft or soft, up.article or tag in ("article", "main"), len(self.stack) if ends else up.block))

    def pop(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()


def blocks_of(page: str) -> list[Block]:
    """A page's text blocks in order."""
    out: list[Block] = []
    opened = Opened()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            up = opened.last
            out.append(Block(up.path, text, linked, up.hard, up.soft))
        parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        if opened.last.block >= k:
            flush()
        opened.pop(k)

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if opened.places.get("a"):
            linked += len(text)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        # After the last ">" no tag ends, so only an open comment can still take text away.
        m = TOKEN.search(page, at) if at <= last else None
        if not m:
            end = page.find("<!--", at)
            say(page[at:] if end < 0 else page[at:end])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        ends = bool(m[1] or m[4])
        if tag in ("html", "body") and not ends and opened.places.get(tag):
            continue
        if ends:
            k = opened.nearest({tag})
            if k >= 0 and (tag in BLOCKS or opened.nearest(BLOCKS) < k):  # or else a stray end of an inline element
                pop_to(k)
            elif k < 0 and tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES:
            same, scope = CLOSES[tag]
            outer = opened.nearest(scope)
            if inside := [own[bisect_right(own, outer)] for name in same if (own := opened.places.get(name)) and own[-1] > outer]:
                pop_to(min(inside))
        if tag in BLOCKS and (k := opened.nearest({"p"})) > opened.nearest(SCOPES):
            pop_to(k)
        own = attributes(m[3] or m[6] or "")
        hard, soft = beside(tag, own, opened.last.article)
        if tag in BLOCKS or hard or soft:
            flush()
        if not (m[3] or m[6] or "").endswith("/"):
            opened.push(tag, own, hard, soft)
    flush()
    return out


def stream(blocks: list[Block]) -> Node:
    """A page's blocks as a nested stream of tags and text slots; ``at`` is a slot's block."""
    root = Node("")
    open_: list[Node] = [root]
    path: list[tuple[str, int]] = []
    for i, b in enumerate(blocks):
        same = 0
        while same < min(len(path), len(b.path)) and path[same] == b.path[same]:
            same += 1
        del open_[same + 1 :], path[same:]
        for step in b.path[same:]:
            node = Node(step[0])
            open_[-1].children.append(node)
            open_.append(node)
            path.append(step)
        open_[-1].children.append(Node("", text=b.text, weight=max(0, len(b.text) - b.linked), linked=b.linked, hard=b.hard, at=i))
    return root


def merged(a: Node, b: Node) -> Node:
    """One node for two of one name."""
    flags = dict(repeated=a.repeated or b.repeated, optional=a.optional or b.optional, weight=a.weight + b.weight, linked=a.linked + b.linked, pages=a.pages + b.pages, hard=a.hard and b.hard)
    if not a.name:
        return Node("", text=a.text if a.text == b.text else None, **flags)
    return Node(a.name, aligned(a.children, b.children), None, **flags)


def _again(into: Node, node: Node) -> Node:
    """A repeated group for two neighbours; pages are not counted twice."""
    out = merged(into, node)
    out.repeated, out.pages = True, max(into.pages, node.pages)
    return out


def folded(children: list[Node]) -> list[Node]:
    """Children in which like neighbours are repeated groups: all prose, other elements where they are many."""
    runs: list[list[Node]] = []
    for child in children:
        if runs and runs[-1][-1].name == child.name and runs[-1][-1].shape == child.shape:
            runs[-1].append(child)
        else:
            runs.append([child])
    out: list[Node] = []
    for run in runs:
        if len(run) >= MANY or not run[0].name or tag_of(run[0].name) in PROSE:
            out.append(reduce(_again, run))
        else:
            out += run
    if len(out) > ORDERED:
        by: dict[str, Node] = {}
        for child in out:
            by[child.name] = _again(by[child.name], child) if child.name in by else child
        out = list(by.values())
    return out


def likeness(a: Node, b: Node) -> float:
    """How well two nodes of one name pair; 0: their names differ."""
    if a.name != b.name:
        return 0.0
    if not a.name:
        return 1.0 + (a.text is not None and a.text == b.text)
    both = a.shape | b.shape
    return 1.0 + (len(a.shape & b.shape) / len(both) if both else 1.0)


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """The alignment of two lists, in order, whose pairs are most alike in all; None: nothing on that side."""
    if len(a) == len(b) and all(x.name == y.name and x.shape == y.shape for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    like = [[likeness(x, y) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like[i][j] if like[i][j] else 0.0)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < len(a) and best[i][j] == best[i + 1][j]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """One expression for two: what matches is merged, what only one side has becomes part of a repeated group beside its like, and optional elsewhere."""
    a, b = folded(a), folded(b)
    out: list[Node] = []
    for i, j in pairs(a, b):
        if i is not None and j is not None:
            out.append(merged(a[i], b[j]))
            continue
        node = a[i] if i is not None else b[j]
        if out and out[-1].name == node.name and out[-1].shape == node.shape:
            out[-1] = _again(out[-1], node)
        else:
            node.optional = True
            out.append(node)
    return out


def expression(node: Node) -> str:
    """The wrapper in the usual notation."""
    inner = " ".join(map(expression, node.children))
    own = f"<{node.name}> {inner} </>" if node.name else inner or ("#text" if node.text is None else json.dumps(node.text, ensure_ascii=False))
    return f"({own}){'+' * node.repeated}{'?' * node.optional}" if node.repeated or node.optional else own


def slots(node: Node) -> Iterator[Node]:
    if not node.children:
        yield node
    for child in node.children:
        yield from slots(child)


def nodes(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children:
        yield from nodes(child)


def total(node: Node) -> float:
    return sum(s.weight for s in slots(node) if s.keep and not s.hard)


def main_path(root: Node) -> tuple[str, ...]:
    """Where one page has its article: the element meant for it that holds most text, or else the smallest one with most of the text."""
    best: tuple[float, tuple[str, ...]] = (0.0, ())

    def find(node: Node, path: tuple[str, ...]) -> None:
        nonlocal best
        for child in node.children:
            if child.name:
                own = (*path, child.name)
                if (tag_of(child.name) in ("article", "main") or child.name.endswith("@main")) and (size := total(child)) >= max(best[0] * 0.5, 1):
                    inside = own[: len(best[1])] == best[1]
                    if not best[1] or size > best[0] or inside:
                        best = (size, own)
                find(child, own)

    find(root, ())
    return best[1] or tuple(n.name for n in place(root)[1:])


def place(root: Node) -> list[Node]:
    """The elements down to the smallest that still has most of the text."""
    out, whole = [root], total(root)
    while True:
        largest = max((c for c in out[-1].children if c.name and c.children), key=total, default=None)
        if largest is None or largest.repeated or tag_of(largest.name) in PROSE or tag_of(largest.name) in ("ul", "ol", "table") or total(largest) < 0.6 * whole:
            return out
        out.append(largest)
        whole = total(largest)


def judged(root: Node, different: int) -> list[str]:
    """Say of a wrapper's elements and slots whether they are the article's; the names of the elements down to it."""

    def drop(node: Node) -> None:
        for s in nodes(node):
            s.keep = False

    def look(node: Node) -> None:
        heading = any(re.match(r"h[1-6]\b", c.name) for c in node.children)
        for child in node.children:
            if not child.children:
                # The same text on all pages that have the slot, and on enough of them.
                if child.text is not None and not child.repeated and different >= DIFFERENT and child.pages >= max(LEAST, different // 2):
                    child.keep = False
                continue
            look(child)
            mine, linked = sum(s.weight for s in slots(child)), sum(s.linked for s in slots(child))
            inner = [c for c in child.children if c.children]
            record = child.repeated and tag_of(child.name) not in PROSE and not heading and len(inner) + sum(not c.children for c in child.children) > 1 and not any(re.match(r"h[1-6]\b", c.name) for c in inner)
            if linked > mine or record:
                drop(child)

    look(root)
    path = place(root)
    inside = {id(s) for s in nodes(path[-1])}
    for s in nodes(root):
        s.keep = s.keep and id(s) in inside
    return [n.name for n in path[1:]]


def packed(node: Node) -> list:
    return [node.name, int(node.repeated), int(node.keep), [packed(c) for c in node.children]]


def unpacked(own: list) -> Node:
    return Node(own[0], [unpacked(c) for c in own[3]], repeated=bool(own[1]), keep=bool(own[2]))


def infer(pages: list[str | None]) -> dict:
    """The wrapper of a host's sample: its article's place (``main``), the expression with what each slot is (``tree``), and how many pages it is from."""
    streams = [own for p in pages if p and (own := stream(blocks_of(p))).children]
    different = len({json.dumps([s.text for s in slots(own)]) for own in streams})
    if not streams:
        return {"main": [], "tree": None, "pages": 0}
    wrapper = Node("", folded(streams[0].children))
    for other in streams[1:]:
        wrapper = Node("", aligned(wrapper.children, other.children))
    main = judged(wrapper, different)
    return {"main": main, "tree": packed(wrapper) if different >= LEAST else None, "pages": len(streams)}


def matched(wrapper: Node, page: Node, slot_of: dict[int, Node]) -> None:
    """Give each of a page's blocks its slot of the wrapper; blocks that the expression has no slot for get the element around them."""

    def all_of(node: Node, slot: Node) -> None:
        for s in slots(node):
            slot_of[s.at] = slot

    # Like neighbours of a page are one group of its stream, as in the wrapper.
    runs: list[list[Node]] = []
    for child in page.children:
        if runs and runs[-1][-1].name == child.name and runs[-1][-1].shape == child.shape:
            runs[-1].append(child)
        else:
            runs.append([child])
    units: list[list[Node]] = []
    for run in runs:
        units += [run] if len(run) >= MANY or not run[0].name or tag_of(run[0].name) in PROSE else [[x] for x in run]
    if len(units) > ORDERED:
        by: dict[str, list[Node]] = {}
        for unit in units:
            by.setdefault(unit[0].name, []).extend(unit)
        units = list(by.values())
    last: Node | None = None
    for i, j in pairs(wrapper.children, [u[0] for u in units]):
        own = wrapper.children[i] if i is not None else None
        if j is None:
            last = own
            continue
        if own is None and last is not None and last.name == units[j][0].name and last.repeated:
            own = last
        for node in units[j]:
            if own is None:
                all_of(node, wrapper)
            elif not node.children:
                slot_of[node.at] = own if not own.children else wrapper
            else:
                matched(own, node, slot_of)
        last = own


def fallback(blocks: list[Block]) -> str:
    """By tags and roles, and by words unless these would leave nothing: what is not beside the article, in the place that has most of it."""
    soft = [b for b in blocks if not b.hard and not b.soft] or [b for b in blocks if not b.hard]
    main = main_path(stream(soft))
    return "\n".join(b.text for b in soft if tuple(n for n, _ in b.path[: len(main)]) == main)


def extract(page: str | None, wrapper: dict | None) -> str:
    """The blocks of a page's article, joined by line ends."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    if wrapper and wrapper.get("tree"):
        slot_of: dict[int, Node] = {}
        matched(wrapper["tree"] if isinstance(wrapper["tree"], Node) else unpacked(wrapper["tree"]), stream(blocks), slot_of)
        found = [b for i, b in enumerate(blocks) if slot_of[i].keep and not b.hard]
        clear = [b for b in found if not b.soft]
        # Words in names take out what is the smaller part of the article.
        if found:
            return "\n".join(b.text for b in (clear if 2 * sum(len(b.text) for b in clear) >= sum(len(b.text) for b in found) else found))
    return fallback(blocks)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html", sample: int = SAMPLE) -> DataFrame:
    """host, wrapper (JSON), n (pages): from at most ``sample`` different pages of each host, the least hash in each of as many slots."""
    rows = pages.select(host_of(f"`{url}`").alias("host"), F.xxhash64(F.col(f"`{page}`")).alias("h"), F.col(f"`{page}`").alias("html"))
    slot = F.pmod("h", F.lit(sample)).alias("slot")
    chosen = written(rows.groupBy("host", slot).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).select("host", "h", "n"))
    some = rows.join(F.broadcast(chosen) if fits(chosen) else chosen, ["host", "h"])
    # Pages that are alike are one before they travel, so no task gets more than ``sample`` of a host.
    some = some.groupBy("host", "h").agg(F.first("html").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches, ["host"]):
            own = part.sort_values("h")["html"].tolist()
            yield pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [json.dumps(infer(own))]})

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = some.repartition(n, "host").sortWithinPartitions("host").mapInPandas(run, "host string, wrapper string")
    return written(found.join(chosen.groupBy("host").agg(F.sum("n").alias("n")), "host"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text outside menus and the like, have an empty text. Pages without a
    url, or with one that names no host, share the host "". Repeated rows come out alike; an empty table gives
    no rows; other columns are ignored.
    """
    wrappers = infer_wrappers(pages, url, page, sample)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"), host_of(f"`{url}`").alias("host"))
    if fits(wrappers):
        rows = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        rows = spread_join(rows, wrappers, ["host"], hubs(wrappers, ["host"]), "url", "left")
    rows = rows.select("page_id", "url", "html", "wrapper")
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for own, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
                if wrapper not in known:
                    if len(known) > 1_000:
                        known = {None: None}
                    known[wrapper] = json.loads(wrapper)
                    if known[wrapper]["tree"]:
                        known[wrapper]["tree"] = unpacked(known[wrapper]["tree"])
                texts.append(extract(own, known[wrapper]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
