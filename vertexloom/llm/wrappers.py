"""Main text of web pages by union-free wrappers inferred per host.

A page becomes a tree of block elements. Two trees are aligned from the root:
equal labels match, siblings that repeat become one repeated group, what only
one side has becomes optional, and differing texts become slots. Folding a
host's pages gives its wrapper, a union-free regular expression over tags. Pages
are folded within each task, partial wrappers in two further rounds, so a host
with a third of all pages is combined like any sum.

The wrapper decides what of a page is its main text. It tells where that lies:
at the paths that at least half of the host's pages that have them mark as main,
also on pages that mark nothing; without marks, where most of the running text
is. And it tells what the
template says there: a text that every page of the host has at the same path is
no page's own and is left out, provided that at least ``TEMPLATE_PAGES`` pages
differ in what else they say. Pages whose longest texts agree count as copies of
one another, not as different pages.

Defined cases: null or empty html gives the empty text; a page without a usable
url belongs to the host with the empty name; pages that do not fit their host's
wrapper are read by their own tree; white space within a block, non-breaking
spaces included, becomes one space; broken or unclosed markup is closed at the
next element that cannot lie inside; elements nested deeper than ``DEPTH`` are
read as siblings, in order and with nothing lost; of several main elements all
are read in page order; pages are read whole, whatever their length; repeated
rows give equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vertexloom.llm._arrow import find_package, map_batches, slices, texts
from vertexloom.plans.scratch import Scratch

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
_MARK = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s
 samp small span strike strong sub sup time tt u var""".split())
_CHROME_TAGS = frozenset("""nav footer aside form script style noscript template iframe svg head title button select
 option textarea canvas object audio video dialog menu""".split())
_CHROME_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted
 nav navbar navigation menu menubar sidebar side footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr
 notice notices alert newsletter subscribe subscription signup login share sharing social comment comments disqus
 respond reply replies related recommended recommendations popup modal overlay widget toolbar pagination pager skip
 copyright disclaimer""".split())
_HEADER_WORDS = frozenset("header topbar".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"tr", "td", "th"}}
_IN_P = frozenset("""address article aside blockquote details div dl dd dt fieldset figure figcaption footer form h1 h2
 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tr td th ul body""".split())
_SCOPE = frozenset("table ul ol dl div article section main body html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pages of a host that must differ before a text found on all of its pages is taken for the template's.
TEMPLATE_PAGES = 4
#: Levels of block elements that keep their nesting.
DEPTH = 40
#: Paths of main elements that a wrapper keeps, those that most pages mark; others are read by their pages' own marks.
MAIN_PATHS = 64
#: Siblings after folding beyond which they become one repeated group of optional elements.
SIBLINGS = 200


class Node:
    """A block element of one page: label, whether it is page furniture, children and texts in order."""

    __slots__ = ("tag", "label", "chrome", "main", "kids")

    def __init__(self, tag: str, label: str, chrome: int, main: bool):
        self.tag, self.label, self.chrome, self.main, self.kids = tag, label, chrome, main, []


def _marks(tag: str) -> tuple[str, set[str], str, bool]:
    label, words, role, hidden = "", set(), "", False
    for m in _MARK.finditer(tag):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind == "role":
            role = value.strip()
        elif kind == "aria-hidden":
            hidden |= value == "true"
        elif kind in ("class", "id"):
            if kind == "class":
                label = ".".join(sorted(re.sub(r"\d+", "#", value).split()))  # numbers tell pages apart, not places
            words |= set(re.split(r"[\s_-]+", value))
    return label, words, role, hidden


class _Open:
    """The elements open while a page is read: blocks as nodes, inline elements as ``(tag, furniture)``."""

    def __init__(self, root: Node):
        self.stack: list = [root]
        self.blocks: list[Node] = [root]
        self.at: list[int] = [0]  # where in the stack each block stands
        self.places: list[Node] = [root]  # where a block's node hangs; deep ones hang from their ancestor at DEPTH
        self.count: dict[str, int] = {}
        self.bad = self.links = 0

    def push(self, x) -> None:
        self.stack.append(x)
        tag = x.tag if isinstance(x, Node) else x[0]
        self.count[tag] = self.count.get(tag, 0) + 1
        if isinstance(x, Node):
            parent = self.places[-1]
            parent.kids.append(x)
            self.blocks.append(x)
            self.at.append(len(self.stack) - 1)
            self.places.append(x if len(self.places) < DEPTH else parent)
        else:
            self.bad += x[1]
            self.links += tag == "a"

    def pop(self) -> None:
        x = self.stack.pop()
        tag = x.tag if isinstance(x, Node) else x[0]
        self.count[tag] -= 1
        if isinstance(x, Node):
            self.blocks.pop()
            self.at.pop()
            self.places.pop()
        else:
            self.bad -= x[1]
            self.links -= tag == "a"

    def add(self, kid) -> None:
        """A text or a rule at the end of the innermost block."""
        x, place = self.blocks[-1], self.places[-1]
        if place is not x and place.kids[-1] is not x:  # a deep block goes on after what lay inside it
            x = Node(x.tag, x.label, x.chrome, False)
            place.kids.append(x)
            self.stack[self.at[-1]] = self.blocks[-1] = x
        x.kids.append(kid)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only mark furniture and links."""
    root = Node("#root", "", 0, False)
    open_ = _Open(root)
    stack, count = open_.stack, open_.count
    at = 0

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            if not open_.bad:
                open_.add((_html.unescape(raw), open_.links > 0))
        elif raw:
            open_.add((" ", False))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tok = m[0]
        if m[1] or tok[1] in "!?":
            continue
        name = _NAME.match(tok)
        if not name:
            continue
        tag = name[1].lower()
        if tok[1] == "/":
            if not count.get(tag):
                continue
            if tag in _INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if isinstance(stack[i], Node):
                        break
                    if stack[i][0] == tag:
                        above = stack[i + 1:]
                        open_.cut(i)
                        for x in above:
                            open_.push(x)
                        break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if isinstance(stack[i], Node) and stack[i].tag == tag:
                        open_.cut(i)
                        break
                    if isinstance(stack[i], Node) and tag == "p" and stack[i].tag in _SCOPE:
                        break
            continue
        if tag in _VOID:
            if tag == "hr":
                open_.add(Node("hr", "hr", 0, False))
            elif tag in ("br", "img", "wbr"):
                open_.add((" ", False))
            continue
        label, words, role, hidden = _marks(tok) if "=" in tok else ("", set(), "", False)
        bad = bool(words & _CHROME_WORDS) or role in _CHROME_ROLES or hidden
        if tag in _INLINE:
            open_.push((tag, bad and tag != "a"))
            continue
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _IN_P else set())
        if any(map(count.get, closes)):
            for i in range(len(stack) - 1, 0, -1):
                x = stack[i]
                if isinstance(x, Node):
                    if x.tag in closes:
                        open_.cut(i)
                        break
                    if x.tag in _SCOPE:
                        break
        while not isinstance(stack[-1], Node):  # an unclosed inline element ends with its block
            open_.pop()
        main = tag in ("article", "main") or role == "main"
        head = (tag == "header" or bool(words & _HEADER_WORDS)) and tag not in _HEADINGS
        chrome = 2 if tag in _CHROME_TAGS or (bad and not main and tag not in ("html", "body")) else 1 if head else 0
        if open_.places[-1] is not open_.blocks[-1]:  # what hangs elsewhere takes what it lies in along
            chrome = max(chrome, open_.blocks[-1].chrome)
        open_.push(Node(tag, tag + ("." + label if label else ""), chrome, main))
    if at < len(page):
        text(page[at:])
    return root


# A wrapper node is [label, flags, items, pages, chars, link chars]; flags: 1 optional, 2 repeated, 4 furniture, 8 main.
# A text slot is ["#", flags, the constant's digest or None, pages, chars, link chars]; a repeated group has the label "()".
# The root has three more entries: the smallest TEMPLATE_PAGES digests of its pages' longest texts, the digests of the
# texts, each with its path, that all of its pages have, and how many pages mark a path as main.

OPTIONAL, REPEATED, CHROME, MAIN = 1, 2, 4, 8


def _digest(said: str) -> str:
    return hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _at(path: str, said: str) -> str:
    """What stands for a text at its path."""
    return _digest(f"{path}\n{said}")


def _of_page(node: Node) -> list:
    items, buf, links = [], [], 0

    def flush() -> None:
        nonlocal buf, links
        joined = " ".join("".join(buf).split())
        if joined:
            items.append(["#", 0, _digest(joined), 1, len(joined), min(links, len(joined))])
        buf, links = [], 0

    for k in node.kids:
        if isinstance(k, Node):
            flush()
            items.append(_of_page(k))
        else:
            buf.append(k[0])
            links += len(k[0]) if k[1] else 0
    flush()
    flags = (CHROME if node.chrome == 2 else 0) | (MAIN if node.main else 0)
    return [node.label, flags, _fold(items), 1, sum(x[4] for x in items), sum(x[5] for x in items)]


def _few(items: list) -> list:
    """Too many siblings become one repeated group with each label once, all optional."""
    if len(items) <= SIBLINGS:
        return items
    by: dict[str, list] = {}
    for x in items:
        for y in x[2] if x[0] == "()" else [x]:
            y = [y[0].split(".")[0], y[1] | OPTIONAL, *y[2:]]
            by[y[0]] = _merge(by[y[0]], y, True) if y[0] in by else y
    group = list(by.values())
    return [["()", REPEATED, group, max(x[3] for x in items), sum(x[4] for x in group), sum(x[5] for x in group)]]


def _fold(items: list) -> list:
    """Neighbours that repeat, alone or as a group of two to four, become one repeated item."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0] != "#":
            out[-1] = _merge(out[-1], x, same_page=True)
            out[-1][1] |= REPEATED
        else:
            out.append(x)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            head = [x[0] for x in out[i:i + period]]
            n = 1
            while [x[0] for x in out[i + n * period:i + (n + 1) * period]] == head:
                n += 1
            if n > 1:
                group = out[i:i + period]
                for j in range(1, n):
                    group = [_merge(a, b, same_page=True) for a, b in zip(group, out[i + j * period:i + (j + 1) * period])]
                out[i:i + n * period] = [["()", REPEATED, group, 1, sum(x[4] for x in group), sum(x[5] for x in group)]]
            i += 1
    return _few(out)


def _key(x: list) -> str:
    return x[0] if x[0] != "()" else "(" + " ".join(map(_key, x[2])) + ")"


def _merge(a: list, b: list, same_page: bool = False) -> list:
    """Align two wrapper items of one label."""
    pages = max(a[3], b[3]) if same_page else a[3] + b[3]
    flags = a[1] | b[1]
    chars, links = a[4] + b[4], a[5] + b[5]
    if a[0] == "#":
        return ["#", flags, a[2] if a[2] == b[2] else None, pages, chars, links]
    return [a[0], flags, _align(a[2], b[2], same_page), pages, chars, links]


def _align(a: list, b: list, same_page: bool) -> list:
    """Longest common subsequence of labels; the rest becomes optional, and runs of one label one repeated item."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    n, m = len(a), len(b)
    if ka == kb:
        return [_merge(x, y, same_page) for x, y in zip(a, b)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def optional(x: list) -> None:
        y = [x[0], x[1] | OPTIONAL, *x[2:]]
        if out and _key(out[-1]) == _key(y) != "#":
            out[-1] = _merge(out[-1], y, True)
            out[-1][1] |= REPEATED
        else:
            out.append(y)

    while i < n and j < m:
        if ka[i] == kb[j]:
            out.append(_merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            optional(a[i])
            i += 1
        else:
            optional(b[j])
            j += 1
    for x in [*a[i:], *b[j:]]:
        optional(x)
    return _few(out)


def _texts(node: Node, path: str = "") -> Iterator[tuple[str, str]]:
    """``(path, text)`` of the texts outside furniture."""
    buf: list[str] = []
    for k in [*node.kids, None]:
        if k is not None and not isinstance(k, Node):
            buf.append(k[0])
            continue
        joined = " ".join("".join(buf).split())
        if joined:
            yield path, joined
        buf.clear()
        if k is not None and k.chrome != 2:
            yield from _texts(k, f"{path}/{k.label}")


def infer(page: str) -> list:
    """The wrapper of a single page."""
    root = parse(page)
    said = list(_texts(root))
    longest = max((t for _, t in said), key=len, default="")
    return [*_of_page(root), [_digest(longest)], sorted({_at(p, t) for p, t in said}), {p: 1 for _, p in _marked(root)}]


def merge(a: list, b: list) -> list:
    """The wrapper of all pages that either wrapper stands for."""
    marks = {p: a[8].get(p, 0) + b[8].get(p, 0) for p in {**a[8], **b[8]}}
    if len(marks) > MAIN_PATHS:
        marks = {p: marks[p] for p in sorted(marks, key=lambda p: (-marks[p], p))[:MAIN_PATHS]}
    return [*_merge(a, b), sorted({*a[6], *b[6]})[:TEMPLATE_PAGES], sorted({*a[7]} & {*b[7]}), marks]


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    if w[0] == "#":
        body = "#TEXT" if w[2] is None else "#SAME"
    else:
        inner = " ".join(map(expression, w[2]))
        body = f"({inner})" if w[0] in ("()", "") else f"<{w[0]}>{inner}</>"
    flags = w[1] & (OPTIONAL | REPEATED)
    return body if not flags else f"({body})" + {1: "?", 2: "+", 3: "*"}[flags]


def plan(w: list) -> dict:
    """What extraction needs: the paths of the main elements, and the template's texts."""
    def own(x: list) -> tuple[int, int]:
        """Characters and link characters outside furniture."""
        if x[1] & CHROME:
            return 0, 0
        if x[0] == "#":
            return x[4], x[5]
        found = [own(k) for k in x[2]]
        return sum(f[0] for f in found), sum(f[1] for f in found)

    marks = w[8] if len(w) > 6 else {}
    begun = {p[:i] for p in marks for i, c in enumerate(p) if c == "/"} | set(marks)
    present: dict[str, int] = {}

    def walk(x: list, path: str) -> None:
        if x[0] != "#" and path in begun:
            if path in marks:
                present[path] = max(present.get(path, 0), x[3])
            for k in x[2]:
                for y in k[2] if k[0] == "()" else [k]:
                    walk(y, f"{path}/{y[0]}")

    walk(w, "")
    constants = w[7] if len(w) > 6 and len(w[6]) >= TEMPLATE_PAGES else []
    marked = sorted(p for p, n in marks.items() if 2 * n >= present.get(p, n))
    if marked:
        return {"main": marked, "constants": constants}
    # no element says it is the main one: go down while one child holds most of the running text
    node, path = w, ()
    while True:
        total = own(node)[0]
        kids = [k for k in node[2] if k[0] != "#"] if node[0] != "#" else []
        flat = [g for k in kids for g in (k[2] if k[0] == "()" else [k]) if g[0] != "#"]
        scored = sorted(((own(k)[0] - 2 * own(k)[1], -i) for i, k in enumerate(flat)), reverse=True)
        if not scored or total == 0 or scored[0][0] < 0.7 * total or flat[-scored[0][1]][1] & REPEATED:
            break
        if flat[-scored[0][1]][0].split(".")[0] in ("p", "pre", *_HEADINGS):
            break
        node = flat[-scored[0][1]]
        path = (*path, node[0])
    return {"main": ["".join(f"/{x}" for x in path)], "constants": constants}


def _find(root: Node, paths: list[str]) -> list[tuple[Node, str]]:
    """The page's elements at any of the paths with their paths, in page order, none inside another."""
    wanted = set(paths)
    if "" in wanted:
        return [(root, "")]
    begun = {w[:i] for w in wanted for i, c in enumerate(w) if c == "/"} | wanted
    found: list[tuple[Node, str]] = []

    def walk(node: Node, path: str) -> None:
        for k in node.kids:
            if isinstance(k, Node):
                here = f"{path}/{k.label}"
                if here in wanted:
                    found.append((k, here))
                elif here in begun:
                    walk(k, here)

    walk(root, "")
    return found


def _marked(node: Node, path: str = "") -> list[tuple[Node, str]]:
    out = []
    for k in node.kids:
        if isinstance(k, Node) and k.chrome != 2:
            here = f"{path}/{k.label}"
            out += [(k, here)] if k.main else _marked(k, here)
    return out


def _blocks(node: Node, out: list[str], path: str, drop: frozenset) -> None:
    buf: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(buf).split())
        if joined and not (drop and _at(path, joined) in drop):
            out.append(joined)
        buf.clear()

    for k in node.kids:
        if not isinstance(k, Node):
            buf.append(k[0])
        elif k.tag in ("td", "th"):
            cell: list[str] = []
            _blocks(k, cell, f"{path}/{k.label}", drop)
            buf.append(" " + " ".join(cell) + " ")
        elif k.chrome == 2:
            flush()
        elif k.chrome == 1 and node.tag != "#root":
            flush()
            heads: list[tuple[Node, str]] = []
            _headings(k, heads, f"{path}/{k.label}")
            for h, here in heads:
                _blocks(h, out, here, drop)
        else:
            flush()
            _blocks(k, out, f"{path}/{k.label}", drop)
    flush()


def _headings(node: Node, out: list[tuple[Node, str]], path: str) -> None:
    for k in node.kids:
        if isinstance(k, Node):
            here = f"{path}/{k.label}"
            if k.tag in _HEADINGS:
                out.append((k, here))
            else:
                _headings(k, out, here)


def extract(page: str, plan_of_host: dict | None = None) -> str:
    """The main text of a page, blocks joined by an empty line."""
    root = parse(page)
    drop: frozenset = frozenset()
    mains: list[tuple[Node, str]] = []
    if plan_of_host:
        mains = _find(root, plan_of_host["main"])
        drop = frozenset(plan_of_host["constants"])
    mains = mains or _marked(root) or _find(root, plan(_of_page(root))["main"]) or [(root, "")]
    out: list[str] = []
    for node, path in mains:
        _blocks(node, out, path, drop)
    return "\n\n".join(out)


def host(url: str = "url"):
    """The host part of an address in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
                              F.lit("")))


def _fold_hosts(load, keep=lambda w: w, limit: int = 2000):
    """Rows ``(host, value)`` to ``keep`` of their partial wrappers as JSON; about ``limit`` hosts are held.

    The host at a batch's end stays held, so rows sorted by host give one wrapper per host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(keep(w)) for w in held.values()], pa.string())],
                names=["host", "wrapper"])
            held.clear()
            return rows

        for batch in slices(batches):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = load(value)
                if w is not None:
                    held[name] = merge(held[name], w) if name in held else w
            if len(held) >= limit:
                last = batch.column(0)[-1].as_py()
                open_host = {last: held.pop(last)} if last in held else {}
                if held:
                    yield out()
                held.update(open_host)
        if held:
            yield out()

    return run


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep=lambda w: w) -> DataFrame:
    """``(host, wrapper)``: ``keep`` of the one wrapper for all pages of each host, as JSON."""
    find_package(pages.sparkSession)
    schema = "host string, wrapper string"
    first = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(
        _fold_hosts(lambda page: infer(page) if page else None), schema)
    second = first.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(32))).mapInArrow(
        _fold_hosts(json.loads), schema)
    return second.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(
        _fold_hosts(json.loads, keep), schema)


#: Plans are broadcast while all of them together stay under this; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    plans = scratch.save(host_wrappers(pages, url_col, html_col, plan).select(
        F.col("host").alias("h"), F.col("wrapper").alias("plan")), "plans")
    size = plans.agg(F.sum(F.length("plan") + F.length("h"))).first()[0] or 0
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html"), host(url_col).alias("host"))
    side = F.broadcast(plans) if size <= BROADCAST_BYTES else plans
    joined = src.join(side, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "plan")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, seen = [], {}
        for page, p in zip(texts(batch.column(2)), batch.column(3).to_pylist()):
            if p not in seen:
                seen[p] = json.loads(p) if p else None
            out.append(extract(page, seen[p]) if page else "")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined, kernel, "page_id long, url string, text string, n_chars long")
