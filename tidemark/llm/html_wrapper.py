"""Main text of web pages by wrapper induction.

Each page's element tree is reduced: inline tags belong to their block, and siblings that repeat (alone, or in turns of two or
three) are one iterated node. A host's most frequent tree is its pivot. Simple tree matching aligns every other tree of the
host with it, so that a node stands for the same slot on all pages. A text that most pages show in one slot is template; a
slot that is nearly all links is a menu; what varies is content. Elements that say what they are (landmark tags, roles, names
of classes) decide for hosts of few pages, whose slots can't be told by comparison.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import weighed, written

#: A text is template where this share of the pages that have its slot show it, of so many at least.
CONSTANT, LEAST_PAGES = 0.8, 4
#: Slots with so much of their text in links are menus.
LINKS = 0.75
#: Deeper elements are part of their ancestor's slot.
DEPTH = 40
#: Wrappers of up to so many bytes are sent to every executor; more are joined by host.
BROADCAST_BYTES = 32 << 20
PAGES_AT_ONCE = 256

_words = lambda s: frozenset(s.split())
# Names of HTML elements.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words(
    "a abbr acronym area audio b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label map mark meter nobr output "
    "picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var video wbr"
)
RAW = _words("script style textarea title xmp noembed noframes iframe noscript")
CHROME = _words("head nav header footer aside form button select menu dialog template canvas svg math object applet datalist") | RAW
ENDS_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul")
SIBLINGS = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option"), "thead": _words("thead tbody tfoot tr td th"), "tbody": _words("thead tbody tfoot tr td th"), "tfoot": _words("thead tbody tfoot tr td th")}
BARRIERS = _words("table ul ol dl menu select html body article main section div td th")
# Roles, and words in names of classes and ids, of what isn't main text.
ROLES = _words("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status tablist")
NAMES = _words(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav rail footer masthead topbar "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay banner newsletter subscribe subscription signup "
    "login comment comments commentlist disqus reply replies respond social share sharing sharebar related recommended recommendations widget widgets "
    "copyright disclaimer toolbar searchbox searchform form skiplink"
)
HEADS = _words("header head top")
OF_TEXT = _words("article post entry story content title main blog news page")
NEGATED = _words("has with no without is hide")

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z|</[^A-Za-z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


@lru_cache(1 << 16)
def _named(names: str) -> bool:
    """Whether a class or id attribute names something other than main text."""
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] in NEGATED:
            continue
        if any(w in NAMES for w in words) or (words and words[-1] in HEADS and not any(w in OF_TEXT - {"page", "main"} for w in words)):
            return True
    return False


@lru_cache(1 << 16)
def _read(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, whether the element says that it isn't main text, whether that stands in a name only)."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    label = ".".join([tag if re.fullmatch("[a-z0-9:-]+", tag) else "other", *sorted(set(re.findall(r"[a-z]+", names.lower())))])
    by_name = tag not in ("html", "body", "main", "article") and _named(names)
    if tag == "article" and re.search(r"\b(comment|reply|related|teaser|promo|ad|sponsored)", names, re.I):
        by_name = True
    return label, bool(tag in CHROME or hidden or found.get("role", "").lower() in ROLES or by_name), by_name


class Page:
    """A page's block elements, in the order of their starts, and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.label, self.depth = [-1], ["#"], [0]
        #: Whether an element isn't main text, and the kind of its nearest container: 2 an article, 1 a main element, 0 none.
        self.chrome, self.within = [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, tags, at, size = [0], ["#"], 0, len(source)
        text: list[str] = []
        links = linked = muted = 0  # muted: open inline elements that aren't main text
        opened: list[tuple[str, bool]] = []  # open inline elements that count

        def flush() -> None:
            nonlocal text, linked
            if text:
                if joined := " ".join("".join(text).split()):
                    self.blocks.append((stack[-1], joined, min(linked, len(joined))))
                text, linked = [], 0

        def put(segment: str) -> None:
            nonlocal linked
            if segment and not muted:
                segment = html.unescape(segment) if "&" in segment else segment
                text.append(segment)
                linked += len(segment.strip()) if links else 0

        def close(to: int) -> None:
            nonlocal links, muted
            flush()
            del stack[to:], tags[to:]
            if opened:  # inline elements don't reach over blocks
                opened.clear()
                links = muted = 0

        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            put(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, end = tag.lower(), bool(m[1] or m[4])
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif end:
                    k = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == tag), None)
                    if k is not None:
                        links -= tag == "a"
                        muted -= opened.pop(k)[1]
                elif tag not in VOID:
                    mute = _read(tag, m[3] or m[6] or "")[1]
                    if tag == "a" or mute or any(t == tag for t, _ in opened):
                        opened.append((tag, mute))
                        links += tag == "a"
                        muted += mute
                continue
            if end:
                if tag in tags:
                    close(len(tags) - 1 - tags[::-1].index(tag))
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:  # its content isn't markup
                flush()
                stop = _RAW_END[tag].search(source, at)
                at = stop.start() if stop else size
                if not stop:
                    break
                continue
            if tag in ENDS_P and "p" in tags and not any(t in BARRIERS for t in tags[len(tags) - tags[::-1].index("p") :]):
                close(len(tags) - 1 - tags[::-1].index("p"))
            if tag in SIBLINGS:
                k = len(tags) - 1
                while k > 0 and tags[k] not in BARRIERS - SIBLINGS[tag] and tags[k] not in SIBLINGS[tag]:
                    k -= 1
                while k > 0 and tags[k] in SIBLINGS[tag]:
                    close(k)
                    k -= 1
            flush()
            if tag == "hr" or tag in VOID:
                continue
            label, chrome, by_name = _read(tag, attributes)
            up = stack[-1]
            if tag == "header" and not by_name and self.within[up]:
                chrome = False  # an article's own heading
            self.parent.append(up)
            self.label.append(label)
            self.depth.append(self.depth[up] + 1)
            self.chrome.append(self.chrome[up] or chrome)
            kind = 2 if tag == "article" else 1 if tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes) else 0
            self.within.append(max(self.within[up], kind))
            close(len(stack))
            if not attributes.rstrip().endswith("/") or tag not in ("path", "use"):
                stack.append(len(self.parent) - 1)
                tags.append(tag)
        if at < size:
            put(source[at:])
        flush()

    def tree(self) -> tuple[str, list[int]]:
        """The reduced tree as text, and each element's node in it, numbered in the order of their starts."""
        children: dict[int, list[int]] = defaultdict(list)
        owner = list(range(len(self.parent)))
        for i in range(1, len(self.parent)):
            if self.depth[i] > DEPTH:
                owner[i] = owner[self.parent[i]]
            else:
                children[self.parent[i]].append(i)
        sign, groups = {}, {}  # an element's reduced subtree, and the elements of each of its nodes' iterations
        for i in range(len(self.parent) - 1, -1, -1):
            if owner[i] != i:
                continue
            below = [(sign[c], [c]) for c in children[i]]
            for turn in (1, 2, 3):
                kept: list[tuple[str, list[int]]] = []
                for item in below:
                    kept.append((item[0], list(item[1])))
                    if len(kept) >= 2 * turn and all(kept[-k][0] == kept[-k - turn][0] for k in range(1, turn + 1)):
                        again = kept[-turn:]
                        del kept[-turn:]
                        for k in range(1, turn + 1):
                            kept[-k][1].extend(again[-k][1])
                below = kept
            groups[i] = [g for _, g in below]
            sign[i] = f"{self.label[i]}({','.join(s for s, _ in below)})" if below else self.label[i]
        node, number, todo = [0] * len(self.parent), 0, [[0]]
        while todo:
            group = todo.pop()
            for i in group:
                node[i] = number
            number += 1
            todo += [[c for i in group for c in groups[i][j]] for j in range(len(groups[group[0]]) - 1, -1, -1)]
        for i in range(len(self.parent)):
            if owner[i] != i:
                node[i] = node[owner[i]]
        return sign[0], node


@lru_cache(1 << 12)
def _nodes(tree: str) -> tuple[list[str], list[list[int]], list[int]]:
    """(labels, children, parents) of a reduced tree's nodes."""
    labels, children, parents, up = [], [], [], [-1]
    for m in re.finditer(r"([^(),]+)|([()])", tree):
        if m[1]:
            labels.append(m[1])
            children.append([])
            parents.append(up[-1])
            if up[-1] >= 0:
                children[up[-1]].append(len(labels) - 1)
        elif m[2] == "(":
            up.append(len(labels) - 1)
        else:
            up.pop()
    return labels, children, parents


@lru_cache(1 << 14)
def aligned(tree: str, pivot: str) -> tuple[str, ...]:
    """The slot of each node of a tree: the pivot's node that simple tree matching gives it, or its own path where there is none."""
    (la, ca, pa), (lb, cb, _) = _nodes(tree), _nodes(pivot)
    slots = ["" for _ in la]
    if tree == pivot:
        return tuple(f"#{i}" for i in range(len(la)))
    weight: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    for a in range(len(la) - 1, -1, -1):
        for b in range(len(lb) - 1, -1, -1):
            if la[a] != lb[b]:
                continue
            x, y = ca[a], cb[b]
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    both = weight.get((x[i - 1], y[j - 1]))
                    best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + both[0] if both else 0)
            pairs, i, j = [], len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((x[i], y[j]))
            weight[a, b] = (best[-1][-1] + 1, pairs)
    todo = [(0, 0)] if (0, 0) in weight else []
    while todo:
        a, b = todo.pop()
        slots[a] = f"#{b}"
        todo += weight[a, b][1]
    for a in range(len(la)):
        if not slots[a]:
            slots[a] = f"{slots[pa[a]] if pa[a] >= 0 else ''}/{la[a]}"
    return tuple(slots)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _counted(host: str, page: Page, into: dict) -> None:
    tree, node = page.tree()
    key = _hash(tree)
    tally(into, (host, key, -1, None), 0, 0, tree)
    sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for element, text, linked in page.blocks:
        if not page.chrome[element]:
            sizes[node[element]][0] += len(text)
            sizes[node[element]][1] += linked
    for k, (size, linked) in sizes.items():
        tally(into, (host, key, k, None), size, linked, None)
    for k, block in {(node[e], _hash(t)) for e, t, _ in page.blocks if not page.chrome[e]}:
        tally(into, (host, key, k, block), 0, 0, None)


def tally(into: dict, key: tuple, size: int, linked: int, tree: str | None) -> None:
    held = into.setdefault(key, [0, 0, 0, tree])
    held[0] += 1
    held[1] += size
    held[2] += linked


SEEN = "host string, tree_id long, node int, block long, pages long, size long, linked long, tree string"


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each tree of a host, its nodes and the texts in them, with numbers of pages; counted for some pages at a time."""
    names = [c.split()[0] for c in SEEN.split(", ")]
    for pdf in batches:
        for at in range(0, len(pdf), PAGES_AT_ONCE):
            into: dict = {}
            for host, source in zip(pdf["host"].iloc[at : at + PAGES_AT_ONCE], pdf["html"].iloc[at : at + PAGES_AT_ONCE], strict=True):
                _counted(host, Page(source or ""), into)
            made = pd.DataFrame([(*k, *v) for k, v in into.items()], columns=names)
            made["block"] = pd.array([k[3] for k in into], "Int64")
            yield made


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper): one wrapper for each host, from all of its pages, as three lines: the pivot's tree, each template text's
    slot and hash, and the menus' slots. Pages without a host teach nothing."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).filter("host <> ''")
    seen = rows.mapInPandas(_seen, SEEN).groupBy("host", "tree_id", "node", "block")
    seen = written(seen.agg(F.sum("pages").alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("tree").alias("tree")), "seen")
    trees = seen.filter("node < 0").select("host", "tree_id", "tree", "pages")
    pivots = trees.groupBy("host").agg(F.max_by("tree", F.struct("pages", "tree")).alias("pivot"), F.sum("pages").alias("pages"), F.count("*").alias("n_trees"))
    pivots = written(pivots, "pivots")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(h, t, n, slot) for h, t, tree, pivot in zip(pdf["host"], pdf["tree_id"], pdf["tree"], pdf["pivot"], strict=True) for n, slot in enumerate(aligned(tree, pivot))]
            yield pd.DataFrame(made, columns=["host", "tree_id", "node", "slot"])

    both = weighed(trees.select("host", "tree_id", "tree"), pivots.select("host", "pivot", "n_trees"), "host", "n_trees", 1)
    slots = written(both.select("host", "tree_id", "tree", "pivot").mapInPandas(align, "host string, tree_id long, node int, slot string"), "slots")
    place = ["host", "tree_id", "node"]
    sizes = seen.filter("node >= 0 AND block IS NULL").join(slots, place).groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    # only texts on several pages of a host can be template; they are few, whatever the number of pages
    often = seen.filter("block IS NOT NULL").groupBy("host", "block").agg(F.sum("pages").alias("n"), F.collect_list(F.struct("tree_id", "node", "pages")).alias("at"))
    often = often.filter(F.col("n") >= LEAST_PAGES).select("host", "block", F.inline("at")).join(slots, place).groupBy("host", "slot", "block").agg(F.sum("pages").alias("shown"))
    constants = often.join(sizes, ["host", "slot"]).filter((F.col("pages") >= LEAST_PAGES) & (F.col("shown") >= CONSTANT * F.col("pages")))
    constants = constants.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "slot", "block"))), " ").alias("constants"))
    menus = sizes.filter((F.col("size") > 0) & (F.col("linked") >= LINKS * F.col("size"))).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("slot")), " ").alias("menus"))
    lines = [F.coalesce(c, F.lit("")) for c in ("pivot", "constants", "menus")]
    return pivots.select("host", "pages", "pivot").join(constants, "host", "left").join(menus, "host", "left").select("host", "pages", F.concat_ws("\n", *lines).alias("wrapper"))


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without user and port; '' where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


@lru_cache(1 << 12)
def _wrapper(lines: str) -> tuple[str, frozenset, frozenset]:
    pivot, constants, menus = lines.split("\n")
    pairs = constants.split()
    return pivot, frozenset(zip(pairs[::2], map(int, pairs[1::2]), strict=True)), frozenset(menus.split())


def main_text(source: str | None, wrapper: str | None = None) -> str:
    """The main text of one page, with its host's wrapper or without one."""
    page = Page(source or "")
    pivot, constants, menus = _wrapper(wrapper) if wrapper else (None, (), ())
    blocks = [b for b in page.blocks if not page.chrome[b[0]]]
    kind = max((page.within[e] for e, _, _ in blocks), default=0)
    blocks = [b for b in blocks if page.within[b[0]] == kind]
    if blocks and (constants or menus):
        tree, node = page.tree()
        slots = aligned(tree, pivot)
        left = [b for b in blocks if (slots[node[b[0]]], _hash(b[1])) not in constants and (kind or slots[node[b[0]]] not in menus)]
        blocks = left or blocks  # a page whose every text is the host's usual one is a copy, not a template
    return " ".join(t for _, t, _ in blocks)


def extract(pages: DataFrame, found: DataFrame | None = None, url_col: str = "url", html_col: str = "html", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with main_text, the text of the article, by the wrappers of their hosts (those of wrappers() where none are given).

    Null and empty pages, and pages without main text, have an empty one; a page without a host is read by what its elements say
    alone. All rows and columns stay, repeated rows too; a column named main_text is replaced. Wrappers of up to most_bytes are
    broadcast, more are joined by host, where hosts of many pages are sent to all and the others shuffled."""
    found = written(wrappers(pages, url_col, html_col), "wrappers") if found is None else found
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 32)).first()[0] or 0
    names = [c for c in pages.columns if c != "main_text"]
    rows = pages.select(F.struct(*names).alias("_row"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    given = found.select(F.col("host").alias("_host"), F.col("pages").alias("_pages"), F.col("wrapper").alias("_wrapper"))
    if size <= most_bytes:
        both = rows.join(F.broadcast(given.drop("_pages")), "_host", "left")
    else:
        both = weighed(rows, given, "_host", "_pages", int(found.agg(F.sum("pages")).first()[0]), "left")

    @F.pandas_udf("string")
    def text(sources: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([main_text(source, wrapper) for source, wrapper in zip(sources, given, strict=True)], dtype=object)

    return both.select("_row", text("_html", "_wrapper").alias("main_text")).select("_row.*", "main_text")
