"""Main-text extraction by wrapper induction.

Pages of a host with the same layout share a template.  The first page of such a group is the pivot; every other page's
DOM tree is aligned with it by simple tree matching: two nodes match if their labels (tag and class) do, and the
children of matched nodes are aligned in order so that as many nodes as possible match; runs of equal labels count as
one repeated slot.  The evidence of all pages, summed per node of the pivot, makes the wrapper:

* a matched node whose own text is the same on nearly all pages is part of the template;
* the content is the slot that varies most: from the root down, the child that holds most of the varying text outside
  links, as long as one child does and has blocks inside.  Tags and classes play no part in this, but a slot inside an
  article (or main region) widens to the whole of it.

A page's main text is what stands in its content slot and is neither template nor part of a region that is never
content: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known
by tag, role or class.  Pages whose group has too few pages for a wrapper, or that do not match it, take their
article (or main region, or body) instead.

A layout is the set of structural start tags (with their classes, digits left out), so that a host with several kinds
of pages has a pivot and a wrapper for each.  Evidence is summed per group and node before it is exchanged.  Pivots
and wrappers are sent to all tasks if their checked size is at most ``SENT_BYTES``; otherwise they are joined to the
pages, by group and a salt, so that a host with very many pages is dealt over tasks.

Defined cases: null html gives an empty text; pages without a host (null or odd URLs) form one host; a group of one or
two pages has no wrapper; ties for the pivot go to the smaller page id, then html; trees with very many differing
siblings are aligned greedily; repeated rows get a row each; an empty table gives an empty one; other columns are kept,
except ones named like the added.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.llm.common import saved

SENT_BYTES = 32_000_000
#: Pages that must differ from the pivot before there is a wrapper, and the share of them on which template is the same.
LEAST_PAGES, SAME = 2, 0.9
#: Share of its parent's varying text that the child on the way to the content must hold.
MOST = 0.6
#: Sibling runs (of both sides, multiplied) up to which children are aligned by the best of all ways.
WIDE = 10_000
#: Parts a group is dealt over where pivots are joined.
SALT = 16
#: Start tags that make a layout (fixed values).
STRUCTURE = "div|section|article|main|nav|aside|header|footer|table|form|ul|ol"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What is never content.
NEVER = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", *RAW}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog"}
NEVER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies",
    "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "share", "sharing", "social", "related", "widget",
}


class Node:
    __slots__ = ("tag", "label", "children", "never", "parts")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag = tag
        classes = attributes.get("class", "")
        self.label = f"{tag}.{' '.join(sorted(classes.split()))}" if classes else tag
        self.never = tag in NEVER
        if attributes and not self.never:
            words = set(re.split(r"[^a-z0-9]+", f"{classes} {attributes.get('id', '')}".lower()))
            self.never = attributes.get("role", "").lower() in NEVER_ROLES or bool(words & NEVER_WORDS) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        self.children: list[Node] = []
        self.parts: list = []  # text and nodes in page order


def parse(html: str | None) -> Node:
    root = Node("#page", {})
    open_ = [root]
    count: defaultdict[str, int] = defaultdict(int)  # of open tags
    at, html = 0, html or ""

    def text(piece: str) -> None:
        if piece:
            open_[-1].parts.append(entities.unescape(piece))

    def close(n: int) -> None:
        for x in open_[n:]:
            count[x.tag] -= 1
        del open_[n:]

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for n in range(len(open_) - 1, 0, -1) if count[tag] > 0 else ():
                if open_[n].tag == tag:
                    close(n)
                    break
            continue
        if tag in CLOSES_P and count["p"] > 0:
            for n in range(len(open_) - 1, 0, -1):
                if open_[n].tag == "p":
                    close(n)
                    break
                if open_[n].tag not in INLINE:
                    break
        if (ended := SAME_CLOSES.get(tag)) and any(count[x] > 0 for x in ended):
            for n in range(len(open_) - 1, 0, -1):
                if open_[n].tag in ended:
                    close(n)
                    break
                if open_[n].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        node = Node(tag, {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip() else {})
        open_[-1].children.append(node)
        open_[-1].parts.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.parts.append(entities.unescape(html[at : end.start()] if end else html[at:]))
            at = end.end() if end else len(html)
            continue
        open_.append(node)
        count[tag] += 1
    text(re.sub(r"</?[a-zA-Z][^>]*\Z", "", html[at:]) if at < len(html) else "")
    return root


def _own(node: Node) -> str:
    """The node's own text and that of what stands inline in it."""
    out = []
    todo = list(reversed(node.parts))
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag in INLINE and not p.never:
            todo += reversed(p.parts)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def _runs(nodes: list[Node]) -> list[list[Node]]:
    runs: list[list[Node]] = []
    for n in nodes:
        if runs and runs[-1][0].label == n.label:
            runs[-1].append(n)
        else:
            runs.append([n])
    return runs


def _blocks(node: Node) -> list[Node]:
    """Children that are not inline; what stands below inline ones comes up."""
    out: list[Node] = []
    todo = node.children[::-1]
    while todo:
        c = todo.pop()
        if c.tag not in INLINE:
            out.append(c)
        elif c.children:
            todo += c.children[::-1]
    return out


def _in_step(x: list[Node], y: list[Node], blocks) -> bool:
    """Runs whose members are matched one after the other: equally long ones, leaves, and very long ones."""
    return len(x) == len(y) or len(x) * len(y) > 400 or not any(blocks(n) for n in x) or not any(blocks(n) for n in y)


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]], list[int]]:
    """Simple tree matching: the number of matched nodes of two trees with equal root labels, the pairs, and the pair above each."""
    kids: dict[int, list[Node]] = {}

    def blocks(n: Node) -> list[Node]:
        if (got := kids.get(id(n))) is None:
            got = kids[id(n)] = _blocks(n)
        return got

    done: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}  # matched nodes, matched children
    size = lambda u, v: done[id(u), id(v)][0]

    def best(x: list, y: list, gain, wanted) -> list[tuple[int, int]]:
        """The pairs (i, j), in order on both sides, that gain most."""
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                most = max(table[i][j + 1], table[i + 1][j])
                if wanted(i, j):
                    most = max(most, table[i][j] + gain(i, j))
                table[i + 1][j + 1] = most
        i, j, out = len(x), len(y), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def run_pairs(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        if _in_step(x, y, blocks):
            return list(zip(x, y))
        return [(x[i], y[j]) for i, j in best(x, y, lambda i, j: size(x[i], y[j]), lambda i, j: True)]

    def greedy(left: list, right: list) -> list[tuple[int, int]]:
        out, j = [], 0
        places: dict[str, list[int]] = {}
        for k, r in enumerate(right):
            places.setdefault(r[0].label, []).append(k)
        for i, x in enumerate(left):
            where = places.get(x[0].label, [])
            k = bisect_left(where, j)
            if k < len(where):
                out.append((i, where[k]))
                j = where[k] + 1
        return out

    stack = [(a, b)]
    while stack:
        u, v = stack[-1]
        if (id(u), id(v)) in done:
            stack.pop()
            continue
        left, right = _runs(blocks(u)), _runs(blocks(v))
        if not left or not right:
            done[id(u), id(v)] = 1, []
            stack.pop()
            continue
        wide = len(left) * len(right) > WIDE
        chosen = greedy(left, right) if wide else [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0].label == y[0].label]
        needed = []
        for i, j in chosen:
            for x, y in zip(left[i], right[j]) if _in_step(left[i], right[j], blocks) else ((x, y) for x in left[i] for y in right[j]):
                if (id(x), id(y)) not in done:
                    if blocks(x) and blocks(y):
                        needed.append((x, y))
                    else:
                        done[id(x), id(y)] = 1, []
        if needed:
            stack += needed
            continue
        pairs = {(i, j): run_pairs(left[i], right[j]) for i, j in chosen}
        if not wide and len(chosen) > 1:
            gain = {k: sum(size(x, y) for x, y in got) for k, got in pairs.items()}
            chosen = best(left, right, lambda i, j: gain[i, j], lambda i, j: (i, j) in gain)
        matched = [pair for k in chosen for pair in pairs[k]]
        done[id(u), id(v)] = 1 + sum(size(x, y) for x, y in matched), matched
        stack.pop()
    pairs, above, todo = [], [], [((a, b), -1)]
    while todo:
        pair, n = todo.pop()
        todo += [(x, len(pairs)) for x in done[id(pair[0]), id(pair[1])][1]]
        pairs.append(pair)
        above.append(n)
    return size(a, b), pairs, above


def numbered(root: Node) -> dict[int, int]:
    """id(node) -> number in page order, of the nodes that align() can reach."""
    order: dict[int, int] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        order[id(n)] = len(order)
        todo += reversed(_blocks(n))
    return order


def _region(root: Node) -> list[Node]:
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.never and n is not root:
                continue
            if n.tag == wanted:
                found.append(n)
            else:
                todo += reversed(n.children)
        if found:
            return found
    return [root]


def main_text(region: list[Node], template: set[int], whole: bool = False) -> str:
    """``template``: ids of nodes whose own text is left out; ``whole``: the region is the page."""
    out: list[str] = []
    for top in region:
        todo: list = [(p, id(top) in template) for p in reversed(top.parts)]
        while todo:
            p, skip = todo.pop()
            if isinstance(p, str):
                if not skip:
                    out.append(p)
                continue
            if p.never or (whole and p.tag == "header"):
                out.append(" ")
                continue
            inline = p.tag in INLINE
            if not inline:
                out.append(" ")
                todo.append((" ", False))
            todo += [(x, skip if inline else id(p) in template) for x in reversed(p.parts)]
        out.append(" ")
    return " ".join("".join(out).split())


def _sizes(root: Node) -> dict[int, int]:
    """id(node) -> characters outside links and raw elements in and below it."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    sizes: dict[int, int] = {}
    for n in reversed(order):
        sizes[id(n)] = 0 if n.tag == "a" or n.tag in RAW else sum(len(p.strip()) if isinstance(p, str) else sizes[id(p)] for p in n.parts)
    return sizes


class Pivot:
    """A group's first page, parsed, with its wrapper (if there is evidence for one)."""

    def __init__(self, html: str, evidence: list[tuple[int, int, int, int]]):
        self.html, self.root = html, parse(html)
        self.number = numbered(self.root)
        self.own = {id(n): _own(n) for n in _walk(self.root) if id(n) in self.number}
        seen = {node: (pages, same, chars) for node, pages, same, chars in evidence}
        self.known = bool(seen) and seen[0][0] >= LEAST_PAGES
        self.fixed: set[int] = set()
        self.content: int | None = None
        if self.known:
            self.fixed = {node for node, (pages, same, _) in seen.items() if pages >= LEAST_PAGES and same >= pages * SAME}
            self.content = self._slot(seen)

    def _slot(self, seen: dict[int, tuple[int, int, int]]) -> int | None:
        """The number of the node with most of the varying text."""
        varying: dict[int, int] = {}
        for n in reversed(list(_walk(self.root))):  # children before their parents
            if (k := self.number.get(id(n))) is not None:
                varying[k] = (seen[k][2] if k in seen and k not in self.fixed else 0) + sum(varying[self.number[id(c)]] for c in _blocks(n))
        at, region = self.root, None
        while True:
            if region is None and at.tag in ("article", "main"):
                region = at
            inside = [(varying[self.number[id(c)]], c) for c in _blocks(at) if self.number[id(c)] in seen]
            if not inside:
                break
            chars, child = max(inside, key=lambda x: x[0])
            k, here = self.number[id(child)], self.number[id(at)]
            if not chars or chars < MOST * varying[here] or 2 * seen[k][0] < seen[here][0] or not _blocks(child):
                break
            at = child
        top = region or at
        return None if top.tag in ("#page", "html", "body") else self.number[id(top)]

    def compare(self, page: str):
        """(node of the pivot, same own text or None without any, characters in the node but in no matched child).

        Nothing where all texts are equal.
        """
        if page == self.html:
            return []
        root = parse(page)
        sizes = _sizes(root)
        _, pairs, above = align(self.root, root)
        chars = [sizes[id(y)] for _, y in pairs]
        for (_, y), n in zip(pairs[1:], above[1:]):
            chars[n] -= sizes[id(y)]
        same = [self.own[id(x)] == _own(y) if self.own[id(x)] else None for x, y in pairs]
        return [(self.number[id(x)], s, max(c, 0)) for (x, _), s, c in zip(pairs, same, chars)] if False in same else []

    def extract(self, page: str | None) -> str:
        root = parse(page)
        if self.content is not None:
            pairs = align(self.root, root)[1]
            top = next((y for x, y in pairs if self.number[id(x)] == self.content), None)
            if top is not None and not top.never:
                # a constant node is template only if it is so on this page, too
                skip = {id(y) for x, y in pairs if self.number[id(x)] in self.fixed and self.own[id(x)] and self.own[id(x)] == _own(y)}
                return main_text([top], skip)
        return by_tags(root)


def by_tags(root: Node) -> str:
    """The article, main region or body of a page without a wrapper."""
    region = _region(root)
    return main_text(region, set(), region == [root])


def _walk(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children


def extract_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", out: str = "main_text", keep_html: bool = False) -> DataFrame:
    """Adds the main text of each whole page."""
    spark = pages.sparkSession
    kept = [f for f in pages.schema.fields if f.name.lower() != out.lower() and (keep_html or f.name != html)]
    names = [f.name for f in kept]
    page = F.col(f"`{html}`")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    tags = F.regexp_extract_all(page, F.lit(rf'(?i)<((?:{STRUCTURE})\b(?:\s+class="[^"]*")?)'), F.lit(1))
    layout = F.hex(F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(F.lower(t), "[0-9]+", ""))))))
    hosted = pages.withColumn("__group", F.when(page.isNotNull(), F.concat_ws(" ", host, layout)))
    read = hosted.where("__group IS NOT NULL").select("__group", F.col(f"`{id_column}`").alias("__id"), page.alias("__html"))
    first = saved(read.groupBy(F.col("__group").alias("__of")).agg(F.min("__id").alias("__first")), "first-pages")
    few = first.agg(F.coalesce(F.sum(F.octet_length("__of") + 8), F.lit(0))).first()[0] <= SENT_BYTES  # else pages are joined by group
    pivots = read.join(F.broadcast(first) if few else first, F.expr("__group = __of AND __id <=> __first"))
    pivots = saved(pivots.groupBy("__group").agg(F.min("__html").alias("__pivot")), "pivots")
    size = pivots.agg(F.coalesce(F.sum(F.octet_length("__pivot")), F.lit(0))).first()[0]
    small = size <= SENT_BYTES
    none = F.lit(None).cast("array<struct<node:int,pages:bigint,same:bigint,chars:bigint>>")

    def with_pivot(df: DataFrame, side: DataFrame) -> tuple[DataFrame, object]:
        """Pivot and evidence by group: from a broadcast of checked size, or joined."""
        if small:
            return df, spark.sparkContext.broadcast({r["__group"]: (r["__pivot"], [tuple(e) for e in r["__evidence"] or ()]) for r in side.collect()})
        dealt = side.select("__group", "__pivot", "__evidence", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
        return df.withColumn("__salt", (F.pmod(F.xxhash64("__html"), F.lit(SALT))).cast("int")).join(dealt, ["__group", "__salt"], "left").select(*(F.col(f"`{n}`") for n in df.columns), "__pivot", "__evidence"), None

    def opened(kept_: dict, group: str, sent, b, i: int) -> Pivot:
        """The group's pivot, parsed once for all pages of the group that come together."""
        if group not in kept_:
            if len(kept_) > 64:
                kept_.clear()
            pivot, evidence = sent.value[group] if sent is not None else (b.column("__pivot")[i].as_py(), [tuple(e.values()) for e in b.column("__evidence")[i].as_py() or ()])
            kept_[group] = Pivot(pivot, evidence)
        return kept_[group]

    source, sent = with_pivot(read.select("__group", "__html"), pivots.withColumn("__evidence", none))

    def evidence(batches):
        sums: dict[tuple[str, int], list[int]] = {}
        pivots_: dict[str, Pivot] = {}

        def flush():
            rows = [(g, n, *v) for (g, n), v in sums.items()]
            sums.clear()
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], names=["group", "node", "pages", "same", "chars"])

        for b in batches:
            for i, (group, text) in enumerate(zip(b.column("__group").to_pylist(), b.column("__html").to_pylist())):
                for node, same, chars in opened(pivots_, group, sent, b, i).compare(text):
                    got = sums.setdefault((group, node), [0, 0, 0])
                    got[0] += 1
                    got[1] += same is True
                    got[2] += chars
            if len(sums) > 200_000:
                yield flush()
        yield flush()

    found = source.mapInArrow(evidence, "group string, node int, pages long, same long, chars long")
    found = found.groupBy("group", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    found = found.groupBy(F.col("group").alias("__group")).agg(F.collect_list(F.struct("node", "pages", "same", "chars")).alias("__evidence"))  # one row a node of the pivot
    wrappers = saved(pivots.join(found, "__group", "left"), "wrappers")
    source, sent_too = with_pivot(hosted.select(*(F.col(f"`{n}`") for n in names), "__group", page.alias("__html")), wrappers)
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches):
        pivots_: dict[str, Pivot] = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [opened(pivots_, group, sent_too, part, i).extract(text) if group is not None else "" for i, (group, text) in enumerate(zip(part.column("__group").to_pylist(), part.column("__html").to_pylist()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, out])

    return source.mapInArrow(run, schema)
