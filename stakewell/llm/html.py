"""Main text of web pages by wrapper induction.

Pages are parsed to trees of their block elements; neighbours that look alike (items of a
list, paragraphs) are one node. Pages of a host are aligned by simple tree matching
(the largest order-keeping match of equal labels) and merged into the host's wrapper. A wrapper
node knows some of the distinct pages that have it, whether its text is the same on all of them (template) or
varies (a slot), which of its items (single paragraphs, entries of a list) most pages have alike, and how much of it is links.

What is constant on at least KINDS distinct pages of a host is template, whatever it is called, unless it
outweighs all that varies (then the pages are copies of one article, which tell nothing). Of varying slots, the content root is the smallest
container that holds most of the text; slots outside it are left out, but for headings, paragraphs and second text containers beside it. Only where slots vary
in menus, adverts, notices and comments too, their element, their class words and share of links tell them from the article.

Wrappers are merged in each task, then FAN by FAN in a tree: what a task or group holds is
trees of distinct layouts, never pages, of at most NODES nodes (beyond, the rarest go). A page whose layout lacks the root is judged by
itself, and so are parts of a page that its wrapper doesn't know.

Text: character references are decoded, white space in a block becomes one space, blocks are
joined by one space. Null or empty html gives ''. A null url is a host of its own. A tag that never ends ends the page, as in browsers.
Repeated rows get equal texts and count as one page. Very long pages are read whole. Where two children tie as root, the first is taken. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_batches, written

#: Bytes of wrappers up to which they may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Share of the text that a container must hold to be entered.
MOST = 0.6
#: Elements nested deeper belong to the one at this depth.
DEPTH = 120
LINKS = 0.6
#: Distinct pages that must agree before a constant node is template.
KINDS = 3
#: Share of a node's pages that must have an item alike before it is template, and items that are counted for each node.
CONSTANT = 0.8
ITEMS = 256
#: Share of the root's text from which a second container beside it is kept.
SECOND = 0.2
#: Nodes of a wrapper, and wrappers that are merged at once.
NODES = 4_000
FAN = 32
#: Layouts and hosts that a task remembers before it begins anew.
REMEMBERED = 5_000

# Fixed values of HTML: elements by how they are laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption caption address summary".split())
SECTIONS = set("article main".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SCOPE = set("html body table td th caption object button template".split())
# Elements and class words that name what isn't the article.
OUT_TAGS = set("head nav footer aside form script style noscript template iframe button select option input textarea svg math dialog menu title object".split())
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot sidebar "
    "side aside related recommended widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form "
    "share sharing social comment comments commentlist respond disqus reply replies copyright legal disclaimer masthead toolbar skip".split()
)
#: Named elements and words that hold an article now and then, if they hold MOST of a host's text; those of readers never.
YIELD_TAGS = {"form", "aside"}
READERS = set("comment comments commentlist respond disqus reply replies".split())
OWN_WORDS = set("article entry post content story main title body".split())
#: A tag: quotes count only behind "=". Nothing is tried twice, so a page is read in linear time.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_OTHER = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element, or several alike in a row: its label, its children, and where the page's text blocks stand."""

    __slots__ = ("label", "children", "tag", "out")

    def __init__(self, tag: str, label: str, out: bool) -> None:
        self.tag, self.label, self.out, self.children = tag, label, out, []


def label_of(tag: str, attributes: str) -> tuple[str, bool]:
    """A node's label (tag and class words without numbers) and whether its names say that it isn't the article."""
    names = " ".join(next(filter(None, m[1:]), "") for m in _NAMES.findall(attributes)).lower()
    words = _WORD.findall(names)
    out = tag in OUT_TAGS or bool(attributes and _HIDDEN.search(attributes))
    if words and tag not in ("html", "body", "article", "main") and not OWN_WORDS.intersection(words):
        out = out or bool(OUT_WORDS.intersection(words)) or "header" in words
    elif words and tag not in ("html", "body", "article", "main"):
        out = out or bool({"comment", "comments", "respond", "ad", "ads", "advert", "share", "related", "nav", "navigation", "menu", "sidebar", "footer", "form", "cookie", "newsletter"}.intersection(words))
    return f"{tag}.{'.'.join(dict.fromkeys(words))}" if words else tag, out


class Page:
    """A page's tree and its blocks: (node, text, link characters), in page order."""

    def __init__(self, source: str) -> None:
        self.nodes = [Node("#root", "#root", False)]
        self.parent = [-1]
        self.depth = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)
        self._collapse()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: tag and block node (inline ones: that of their block)
        text: list[str] = []
        links = depth_a = at = 0

        def flush() -> None:
            nonlocal text, links
            if text:
                said = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if said:
                    self.blocks.append((stack[-1][1], said, min(links, len(said))))
            text, links = [], 0

        held: Counter = Counter()

        def push(tag: str, node: int) -> None:
            stack.append((tag, node))
            held[tag] += 1

        def close(k: int) -> None:
            nonlocal depth_a
            gone = stack[k:]
            held.subtract(t for t, _ in gone)
            if any(t not in INLINE for t, _ in gone):
                flush()
            depth_a -= sum(t == "a" for t, _ in gone)
            del stack[k:]

        def found(tags: set[str], scope: set[str]) -> int:
            if not any(held[t] for t in tags):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in scope:
                    return 0
            return 0

        size = len(source)

        def say(piece: str) -> None:
            nonlocal links
            text.append(piece)
            if depth_a > 0:
                links += len(piece.strip())

        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                say(source[at:])
                break
            if begin > at:
                say(source[at:begin])
            m = _TAG.match(source, begin)
            if not m:
                for opens, closes in _OTHER:
                    if source.startswith(opens, begin):
                        stop = source.find(closes, begin + len(opens))
                        at = stop + len(closes) if stop >= 0 else size
                        break
                else:
                    if source[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
                        break
                    say("<")
                    at = begin + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                k = found({tag}, set() if tag in ("body", "html") else SCOPE - {tag} if tag not in INLINE else SCOPE | {"div", "article", "section", "li"})
                if k:
                    close(k)
                elif tag == "p" or tag == "br":
                    flush() if tag == "p" else text.append(" ")
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in CLOSES_P and (k := found({"p"}, SCOPE)):
                close(k)
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and (k := found({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, {"ul", "ol", "dl", "table", "select"} if tag != "tr" else {"table"})):
                close(k)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = stop.end() if stop else size
                continue
            if tag in INLINE:
                if tag not in VOID and not m[3].endswith("/"):
                    push(tag, stack[-1][1])
                    depth_a += tag == "a"
                continue
            flush()
            if tag in VOID:
                continue
            above = stack[-1][1]
            if self.depth[above] >= DEPTH:
                push(tag, above)
                continue
            label, out = label_of(tag, m[3])
            self.nodes.append(Node(tag, label, out))
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            push(tag, len(self.nodes) - 1)
        flush()

    def _collapse(self) -> None:
        """Merges neighbours of one shape; numbers the nodes that stay in page order."""
        children: list[list[int]] = [[] for _ in self.nodes]
        for i, p in enumerate(self.parent):
            if p >= 0:
                children[p].append(i)
        shape, to = [""] * len(self.nodes), list(range(len(self.nodes)))
        for i in range(len(self.nodes) - 1, -1, -1):
            runs: list[int] = []
            for c in children[i]:
                if runs and shape[runs[-1]] == shape[c]:
                    to[c] = runs[-1]
                else:
                    runs.append(c)
            children[i] = runs
            shape[i] = f"{self.nodes[i].label}({','.join(shape[c] for c in runs)})"
        self.shape = shape[0]
        order: dict[int, int] = {}

        def walk() -> None:
            todo = [0]
            while todo:
                i = todo.pop()
                order[i] = len(order)
                todo += reversed(children[i])

        walk()
        # A node that went is its twin, and what was below it is what is in the same place below the twin.
        target: dict[int, int] = {0: 0}
        every: list[list[int]] = [[] for _ in self.nodes]
        for i, p in enumerate(self.parent):
            if p >= 0:
                every[p].append(i)
        todo = [(0, 0)]
        while todo:
            i, twin = todo.pop()
            kept = iter(children[twin])
            current, last = None, None
            for c in every[i]:
                if shape[c] != last:
                    current, last = next(kept), shape[c]
                target[c] = current
                todo.append((c, current))
        kept = sorted(order, key=order.get)
        self.tree = [(self.nodes[i].label, self.nodes[i].tag, self.nodes[i].out, order[target[self.parent[i]]] if i else -1) for i in kept]
        self.blocks = [(order[target[n]], t, k) for n, t, k in self.blocks]

    def figures(self, page: int) -> list[list]:
        """By node: [pages, text hash or None if it varies, characters, link characters, some distinct pages, items]; page: the page's hash.

        items: by hash of a block's text, [pages that have it, its characters].
        """
        own: list[dict[int, int]] = [{} for _ in self.tree]
        out = [[1, 0, 0, 0, [page], {}] for _ in self.tree]
        for n, t, k in self.blocks:
            own[n][_hash(t)] = len(t)
            out[n][2] += len(t)
            out[n][3] += k
        for n, items in enumerate(own):
            if items:
                out[n][1] = _hash(" ".join(map(str, items)))
                if len(items) > 1:
                    out[n][5] = {h: [1, size] for h, size in items.items()}
        return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def _cut(items: dict) -> dict:
    """The ITEMS most frequent items: what the next one has is taken off each, so that counts are never too high."""
    if len(items) <= ITEMS:
        return items
    most = sorted(items, key=lambda h: (-items[h][0], h))
    off = items[most[ITEMS]][0]
    return {h: [items[h][0] - off, items[h][1]] for h in most[:ITEMS] if items[h][0] > off}


def _add_figures(x: list, y: list) -> None:
    x[1] = x[1] if x[1] == y[1] else None
    for k in (0, 2, 3):
        x[k] += y[k]
    x[4] = sorted({*x[4], *y[4]})[:KINDS]
    if y[5]:
        for h, (n, size) in y[5].items():
            mine = x[5].setdefault(h, [0, size])
            mine[0] += n
        if len(x[5]) > 4 * ITEMS:
            x[5] = _cut(x[5])


def _add(into: list[list], more: list[list]) -> None:
    for a, b in zip(into, more, strict=True):
        _add_figures(a, b)


class Wrapper:
    """A merged tree: label, tag, out, figures and children of each node; node 0 is the root."""

    def __init__(self, tree: list, figures: list[list]) -> None:
        self.label, self.tag, self.out = (list(x) for x in zip(*[t[:3] for t in tree], strict=True))
        self.figures = [[*f[:5], dict(f[5])] for f in figures]
        self.children: list[list[int]] = [[] for _ in tree]
        for i, t in enumerate(tree):
            if t[3] >= 0:
                self.children[t[3]].append(i)

    def dump(self, last: bool = False) -> str:
        """As text; the last one holds of the items only the constant ones."""
        figures = [[*f[:5], [[h, *v] for h, v in (self.constant(f) if last else _cut(f[5])).items()]] for f in self.figures]
        return json.dumps([self.label, self.tag, self.out, figures, self.children], separators=(",", ":"))

    @staticmethod
    def constant(f: list) -> dict:
        """Items that most pages have alike, if they are the lesser part of the node's text."""
        if len(f[4]) < KINDS:
            return {}
        found = {h: v for h, v in f[5].items() if v[0] >= CONSTANT * f[0]}
        return found if sum(n * size for n, size in found.values()) <= 0.5 * f[2] else {}

    @staticmethod
    def load(text: str) -> "Wrapper":
        w = Wrapper.__new__(Wrapper)
        w.label, w.tag, w.out, figures, w.children = json.loads(text)
        w.figures = [[*f[:5], {h: [n, size] for h, n, size in f[5]}] for f in figures]
        return w

    def align(self, other: "Wrapper") -> dict[int, int]:
        """Nodes of other to nodes of self, by simple tree matching."""
        sizes: dict[tuple[int, int], tuple[int, list]] = {}

        def match(a: int, b: int) -> int:
            if self.label[a] != other.label[b]:
                return 0
            if (a, b) not in sizes:
                left, right = self.children[a], other.children[b]
                best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
                for i in range(1, len(left) + 1):
                    for j in range(1, len(right) + 1):
                        best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match(left[i - 1], right[j - 1]))
                pairs, i, j = [], len(left), len(right)
                while i and j:
                    if best[i][j] == best[i - 1][j]:
                        i -= 1
                    elif best[i][j] == best[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((left[i], right[j]))
                sizes[a, b] = 1 + best[-1][-1], pairs[::-1]
            return sizes[a, b][0]

        found: dict[int, int] = {}
        if match(0, 0):
            todo = [(0, 0)]
            while todo:
                a, b = todo.pop()
                found[b] = a
                todo += sizes[a, b][1]
        return found

    def merge(self, other: "Wrapper") -> None:
        """Takes other in: matched nodes add their figures, the rest become new nodes after their matched neighbours."""
        found = self.align(other)
        for b, a in found.items():
            _add_figures(self.figures[a], other.figures[b])

        def graft(b: int) -> int:
            self.label.append(other.label[b])
            self.tag.append(other.tag[b])
            self.out.append(other.out[b])
            self.figures.append([*other.figures[b][:5], dict(other.figures[b][5])])
            self.children.append([])
            me = len(self.label) - 1
            self.children[me] = [graft(c) for c in other.children[b]]
            return me

        for b, a in list(found.items()):
            place = 0
            for c in other.children[b]:
                if c in found:
                    place = self.children[a].index(found[c]) + 1
                else:
                    self.children[a].insert(place, graft(c))
                    place += 1

    def pruned(self) -> "Wrapper":
        """Self, or without the rarest nodes if there are more than NODES."""
        if len(self.label) <= NODES:
            return self
        least = sorted((f[0] for f in self.figures), reverse=True)[NODES - 1]
        kept, todo = [], [(0, -1)]
        while todo:
            i, above = todo.pop()
            kept.append((i, above))
            todo += [(c, len(kept) - 1) for c in reversed(self.children[i]) if self.figures[c][0] > least or self.figures[c][0] == least and len(kept) < NODES]
        return Wrapper([(self.label[i], self.tag[i], self.out[i], above) for i, above in kept], [self.figures[i] for i, _ in kept])

    def content(self) -> tuple[int, set[int]]:
        """The content root (-1: none) and the nodes whose text is content."""
        n = len(self.label)
        named, constant, mass = [False] * n, [False] * n, [0] * n
        all_text, todo = [f[2] - f[3] for f in self.figures], [0]
        for i in todo:
            todo += self.children[i]
        for i in reversed(todo):
            all_text[i] += sum(all_text[c] for c in self.children[i])
        order, todo = [], [(0, True, False)]
        while todo:
            i, ok, article = todo.pop()
            _, same, chars, links, kinds, _ = self.figures[i]
            article = article or self.tag[i] in SECTIONS
            ok = ok and not (self.out[i] and not (all_text[i] >= MOST * all_text[0] > 0 and self._yields(i))) and not (self.tag[i] == "header" and not article) and not (self.tag[i] not in LEAVES and i and chars and links > LINKS * chars)
            named[i] = ok
            constant[i] = len(kinds) >= KINDS and same not in (None, 0)
            order.append(i)
            todo += [(c, ok, article) for c in self.children[i]]
        own = [f[2] - f[3] for f in self.figures]
        # Copies of one article, in pages that differ around it, are no template.
        if sum(own[i] for i in order if constant[i] and named[i]) > sum(own[i] for i in order if not constant[i] and named[i]):
            constant = [c and (self.tag[i] not in LEAVES or "." in self.label[i]) for i, c in enumerate(constant)]
        live = [ok and not c for ok, c in zip(named, constant, strict=True)]
        for i in reversed(order):
            mass[i] = (own[i] if live[i] else 0) + sum(mass[c] for c in self.children[i])
        if not mass[0]:
            return -1, set()
        root, beside = 0, []
        while self.tag[root] not in SECTIONS:
            into = [c for c in self.children[root] if mass[c] >= MOST * mass[root] and self.tag[c] not in LEAVES]
            if not into:
                break
            # Headings and paragraphs beside the container belong to it, and so do containers of further paragraphs.
            beside += [c for c in self.children[root] if c != into[0] and (self.tag[c] in LEAVES or mass[c] >= SECOND * mass[root] and self._leaves(c))]
            root = into[0]
        if self.tag[root] in SECTIONS:
            beside = []
        chosen, todo = set(), [root, *beside]
        while todo:
            i = todo.pop()
            if live[i]:
                chosen.add(i)
            todo += self.children[i]
        return root, chosen

    def _yields(self, i: int) -> bool:
        """Whether a node is out only by a name that a page's main container may have too."""
        words = set(self.label[i].split(".")[1:])
        named = self.tag[i] in YIELD_TAGS or bool(OUT_WORDS & words)
        return named and (self.tag[i] not in OUT_TAGS or self.tag[i] in YIELD_TAGS) and not READERS & words and self._leaves(i)

    def _leaves(self, i: int) -> bool:
        """Whether a paragraph stands below a node."""
        todo = [i]
        while todo:
            k = todo.pop()
            if self.tag[k] == "p":
                return True
            todo += self.children[k]
        return False


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _merged(parts: Iterator[Wrapper]) -> Wrapper | None:
    whole = None
    for w in parts:
        if whole is None:
            whole = w
        else:
            whole.merge(w)
            whole = whole.pruned()
    return whole


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper: one tree for each host."""

    def partial(batches):
        pages_seen: set[int] = set()
        for b in batches:
            seen: dict[tuple[str, str], tuple[list, list]] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                name = _hash(source or "")
                if (host, name) in pages_seen:
                    continue
                pages_seen.add((host, name))
                page = Page(source or "")
                key = (host, page.shape)
                if key in seen:
                    _add(seen[key][1], page.figures(name))
                else:
                    seen[key] = page.tree, page.figures(name)
            by_host: dict[str, list[Wrapper]] = {}
            for (host, _), (tree, figures) in sorted(seen.items(), key=lambda x: x[0]):
                by_host.setdefault(host, []).append(Wrapper(tree, figures))
            if by_host:
                yield pa.record_batch([pa.array(list(by_host)), pa.array([TaskContext.get().partitionId()] * len(by_host), pa.int32()), pa.array([_merged(iter(w)).dump() for w in by_host.values()])], names=["host", "lot", "wrapper"])
            give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = _merged(Wrapper.load(t) for t in sorted(pdf["wrapper"]))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "lot": pdf["lot"].iloc[:1], "wrapper": [whole.dump()]})

    def finish(wrapper: pd.Series) -> pd.Series:
        return wrapper.map(lambda t: Wrapper.load(t).dump(last=True))

    schema = "host string, lot int, wrapper string"
    text_batches(pages.sparkSession)
    rows = written(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(partial, schema), "html-parts")
    lots = (rows.agg(F.max("lot")).first()[0] or 0) + 1
    while True:
        lots = -(-lots // FAN)
        rows = rows.withColumn("lot", F.floor(F.col("lot") / FAN).cast("int")).groupBy("host", "lot").applyInPandas(merge, schema)
        if lots == 1:
            return rows.select("host", F.pandas_udf(finish, "string")("wrapper").alias("wrapper"))


class Extractor:
    """Remembers each host's wrapper and where the content is in each layout."""

    def __init__(self) -> None:
        self.hosts: dict[str, tuple[Wrapper, int, set[int]]] = {}
        self.layouts: dict[tuple[str, str], dict[int, dict]] = {}

    def text(self, host: str, wrapper: str | None, source: str) -> str:
        page = Page(source)
        if not page.blocks:
            return ""
        key = (host, page.shape)
        if key not in self.layouts:
            own = Wrapper(page.tree, page.figures(0))
            if host not in self.hosts and wrapper:
                if len(self.hosts) >= REMEMBERED:
                    self.hosts.clear()
                w = Wrapper.load(wrapper)
                self.hosts[host] = (w, *w.content())
            chosen = None
            if host in self.hosts:
                w, root, content = self.hosts[host]
                found = w.align(own)
                if root in found.values():
                    chosen = {b: w.constant(w.figures[a]) for b, a in found.items() if a in content}
                    # Parts that the wrapper doesn't know, below a part that is content.
                    by_itself = own.content()[1]
                    todo = [b for b, a in found.items() if a == root]
                    while todo:
                        b = todo.pop()
                        if b not in found and b in by_itself:
                            chosen[b] = {}
                        todo += own.children[b]
            if not chosen:
                return self._join(page, dict.fromkeys(own.content()[1], {}))
            if len(self.layouts) >= REMEMBERED:
                self.layouts.clear()
            self.layouts[key] = chosen
        return self._join(page, self.layouts[key])

    @staticmethod
    def _join(page: Page, chosen: dict[int, dict]) -> str:
        return " ".join(t for n, t, _ in page.blocks if n in chosen and not (chosen[n] and _hash(t) in chosen[n]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    wrappers = written(induce(pages), "html-wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]

    def run(batches):
        extractor = Extractor()
        for b in batches:
            texts = [extractor.text(h, w, s or "") for h, w, s in zip(*(b.column(c).to_pylist() for c in ("host", "wrapper", "html")), strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            give_back()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
