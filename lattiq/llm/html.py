"""Main text of web pages through wrappers: union-free regular expressions inferred from same-host pages.

A page's token stream becomes a tree of its structural elements. Adjacent repeats are folded into repeated
groups, (x)+ or (x y)+. The trees of a host are aligned one after another with the host's wrapper: elements
that match are united, what only one side has becomes optional, (x)?, and text that differs becomes a slot,
while text that all pages share stays as template text. Wrappers are united in the tasks that read the pages
first, then by host and salt, then by host, always one at a time, so a host with a third of all pages costs a
task only its wrapper.

The wrapper tells where a host's main text stands: in the article or main elements, or below the deepest element
with most of the slots' text, whichever has most text on the page, weighed by its share of the host's slot text. A page's blocks below that place are its main text, without
boilerplate elements (by tag, role, class and id) and, where no article or main element marks the text, without
the template text of the host.

Elements nested very deep and very long lists of children are gathered in the wrapper alone (MAX_DEPTH, MAX_KIDS); the
text of a page is read whole.

Defined cases: a null page is the empty page, with empty text; a null or odd url belongs to the host ""; pages
that repeat are pages of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, only, staged

#: Pages that must share a text before it counts as template text.
TEMPLATE_PAGES = 5
SALTS = 16
#: Elements deeper than MAX_DEPTH stand in the one at that depth; a wrapper's element has MAX_KIDS kinds of children at most,
#: the ones with least text together beyond; longer lists than ALIGN_CELLS cells are aligned by nearby matches.
MAX_DEPTH, MAX_KIDS, ALIGN_CELLS, MAX_VOTES = 150, 500, 250_000, 64

# Element names by their role in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"} | {"math", "semantics", "menclose", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "input", "dialog", "menu", "object", "applet", "canvas", "audio", "video", "map", "fieldset", "datalist", "output", "progress", "meter", *RAW}
MAIN = ("article", "main")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a start tag of the given name ends, where they are open in the same container.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "aside", "nav", "header", "footer", "form", "blockquote", "td", "th", "figure", "details"}

_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|adsby\w*|adslot|adbox|adunit|adwrap\w*|sponsor\w*|promo\w*|banners?|nav|navs|navbar|navigation|navi|menus?|menubar|breadcrumbs?|header|masthead|topbar|footer|"
    r"side|sidebars?|sidenav|sidepanel|sidemenu|aside|rail|widgets?|related|recommend\w*|share|sharing|social|comment\w*|disqus|respond|repl(?:y|ies)|discussion|cookie\w*|consent|gdpr|notices?|notification\w*|alerts?|"
    r"popup|modal|overlay|newsletter|subscribe\w*|signup|login|search|searchbox|form|pagination|pager|toolbar|copyright|disclaimer|complementary|contentinfo|"
    r"feedback|poll|survey|toc|skip|skiplink)"
)
#: Words that mark boilerplate within compound names too, and words that turn the next one's meaning round.
_STRONG = re.compile(r"(?:ads?|adv|advert\w*|adsense|adsby\w*|adslot|adbox|adunit|adwrap\w*|sponsor\w*|promo\w*|banners?|navbar|breadcrumbs?|masthead|sidebars?|sidenav|sidepanel|widgets?|comment\w*|disqus|cookie\w*|consent|gdpr|newsletter|subscribe\w*|signup|pagination|pager|popup|modal)")
_TURNED = {"no", "not", "non", "has", "have", "with", "without", "hide"}
#: Strength of a vote: part of a compound name, a strong word in one, a whole name.
WEAK, STRONG, WHOLE = 1, 2, 3
#: Comments, declarations and tags. Quotes hold a value only after an equals sign; elsewhere they are plain characters.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)


def _vote(name: str) -> tuple[int, bool]:
    """(strength of a name's vote for boilerplate, 0 for none; whether it has a strong word)."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()) if w and not w.isdigit()]
    hits = [w for k, w in enumerate(words) if _WORDS.fullmatch(w) and not (k and words[k - 1] in _TURNED)]
    strong = any(_STRONG.fullmatch(w) for w in hits)
    return (0 if not hits else WHOLE if len(hits) == len(words) else STRONG if strong else WEAK), strong


@lru_cache(maxsize=20_000)
def _marks(attrs: str) -> tuple[str, bool, int, int, bool, bool]:
    """(key suffix, hidden, vote of class and role, vote of id, strong id, main) of a start tag's attributes."""
    names, hidden, vote, id_vote, id_strong, main = [], False, 0, 0, False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", value).lower()
            votes = [_vote(x) for x in value.split()]
            if name == "id":  # ids often number things
                id_vote, id_strong = max((v for v, _ in votes), default=0), any(k for _, k in votes)
            else:
                vote = max([vote, *(v for v, _ in votes)])
                names += sorted(re.sub(r"\d+", "0", spaced).split())  # numbers in names tell pages apart, not places
            main |= name == "role" and spaced in ("main", "article")
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
    return ("." + ".".join(names) if names else ""), hidden, vote, id_vote, id_strong, main


class Page:
    """Blocks of a page in order: (path, text, drop, region, characters of links); a path is a tuple of element keys.

    A region is the path of the article or main element a block stands in, the empty path outside of them. An article
    within main is a region of its own.
    """

    __slots__ = ("blocks", "tree", "votes", "read")

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[tuple[str, ...], str, bool, tuple[str, ...], int]] = []
        self.tree: list = ["", False, False, 1, 0, None, []]
        self.votes: list[list] = []  # strength, characters, characters of links, inside main text, holds the page's h1
        self.read: list = []  # path, text, dropped by tag, main, votes, tree node, characters of links
        self._read(html)
        self._settle()

    def _settle(self) -> None:
        """Drop what votes for boilerplate and is not overruled by the text it holds."""
        total = 0
        for _, text, drop, _, votes, _, links in self.read:
            if not drop:
                total += len(text)
                for v in votes:
                    self.votes[v][1] += len(text)
                    self.votes[v][2] += links
        out = []
        for strength, size, links, inside, h1 in self.votes:
            linked = 2 * links >= size
            if strength == WEAK:
                out.append(linked and not h1)
            else:
                out.append(strength == WHOLE or linked or inside or size < 0.6 * total)
        dropped = [x[2] or any(out[v] for v in x[4]) for x in self.read]
        if all(dropped):  # votes never leave a page without text
            dropped = [x[2] for x in self.read]
        for (path, text, _, region, _, node, links), drop in zip(self.read, dropped):
            self.blocks.append((path, text, drop, region, links))
            node[4] = len(text) * (not drop)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, tuple[str, ...], tuple[str, ...], list, tuple[int, ...]]] = [("", False, (), (), self.tree, ())]
        opened: Counter[str] = Counter()
        text: list[str] = []
        linked = 0  # characters of text within links
        hidden = 0  # boilerplate inline elements that are open
        inline: list[tuple[str, bool]] = []

        def flush() -> None:
            nonlocal linked
            if text:
                # white space of any kind becomes one space
                joined = " ".join(unescape("".join(text)).split())
                text.clear()
                if joined:
                    _, drop, main, path, node, votes = stack[-1]
                    node[6].append(["#", False, False, 1, 0, joined if len(joined) <= 400 else None, []])
                    self.read.append((path, joined, drop, main, votes, node[6][-1], min(linked, len(joined))))
            linked = 0

        at, n = 0, len(html)
        for m in iter(lambda: _TOKEN.search(html, at), None):
            if m.start() > at and not hidden:
                text.append(html[at : m.start()])
                linked += len(" ".join(text[-1].split())) * any(x == "a" for x, _ in inline)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name in INLINE:
                    while inline:
                        was, plate = inline.pop()
                        hidden -= plate
                        if was == name:
                            break
                elif opened[name]:
                    flush()
                    hidden, inline = 0, []
                    while (was := stack.pop()[0]) != name:
                        opened[was] -= 1
                    opened[name] -= 1
                elif name in ("p", "br"):
                    text.append(" ") if name == "br" else flush()
                continue
            suffix, plate, vote, id_vote, id_strong, main = _marks(m[3]) if m[3] else ("", False, 0, 0, False, False)
            if name in RAW:
                end = re.compile(rf"</{name}\s*>|\Z", re.I).search(html, at)
                if not (m[3].endswith("/") and (name == "svg" or not end[0])):  # a self-closing element holds nothing
                    at = end.end()
                continue
            if name in INLINE:
                plate |= max(vote, id_vote) >= (WEAK if name == "a" else STRONG)
                if not m[3].endswith("/"):
                    inline.append((name, plate))
                    hidden += plate
                continue
            if name == "br" or name == "wbr":
                text.append(" " if name == "br" else "")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            flush()
            hidden, inline = 0, []
            for k in range(len(stack) - 1, max(0, len(stack) - MAX_DEPTH), -1):
                open_name = stack[k][0]
                if open_name in ENDS.get(name, {"p"}) or open_name == "p":
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                elif open_name in SCOPES:
                    break
            parent = stack[-1]
            is_main = name in MAIN or main
            drop = parent[1] or name in DROPPED or plate and not is_main and name not in ("html", "body")
            if name in HEADINGS or name == "p" or name == "section" and parent[2] and not id_strong:
                id_vote = 0  # generated ids name what a heading or section is about
            vote = max(vote, id_vote)
            if name in ("html", "body", "main") or is_main and vote < WHOLE:
                vote = 0
            votes = () if is_main and not vote else parent[5]  # what stands around an article does not drop it
            if vote and len(votes) < MAX_VOTES:
                votes = (*votes, len(self.votes))
                self.votes.append([vote, 0, 0, bool(parent[2]), False])
            if name == "h1":
                for v in votes:
                    self.votes[v][4] = True
            if name in HEADINGS and parent[0] == "header" and len(stack) > 1 and stack[-2][2] and not stack[-2][1]:
                drop = False  # the heading of an article stands in its header
            if len(parent[3]) >= MAX_DEPTH:
                path, node = parent[3], parent[4]
            else:
                path, node = (*parent[3], name + suffix), [name + suffix, False, False, 1, 0, None, []]
                parent[4][6].append(node)
            where = parent[2]
            if is_main and not where or name == "article" and where[-1].split(".")[0] != "article":
                where = path
            if not m[3].endswith("/"):
                stack.append((name, drop, where, path, node, votes))
                opened[name] += 1
        if at < n and not hidden:
            text.append(html[at:])
        flush()


# A wrapper node is [key, optional, repeated, pages, text length, template text or None, children].


def unite(a: list, b: list) -> list:
    """The node that covers two nodes of one key."""
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None, align(a[6], b[6])]


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence; of long lists, one drawn from matches near the same place."""
    n, m, first = len(a), len(b), 0
    while first < min(n, m) and a[first] == b[first]:
        first += 1
    while n > first and m > first and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(first)]
    if (n - first) * (m - first) <= ALIGN_CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, first - 1, -1):
            row, below, key = best[i], best[i + 1], a[i]
            for j in range(m - 1, first - 1, -1):
                row[j] = below[j + 1] + 1 if key == b[j] else max(below[j], row[j + 1])
        i = j = first
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j in range(first, m):
            places.setdefault(b[j], []).append(j)
        tails: list[int] = []  # the smallest j that ends a chain of each length
        chains: list[tuple] = []
        for i in range(first, n):
            own = places.get(a[i], [])
            at = bisect_left(own, first + (i - first) * (m - first) // (n - first))
            for j in reversed(own[max(0, at - 4) : at + 4]):
                k = bisect_left(tails, j)
                link = (i, j, chains[k - 1] if k else None)
                if k == len(tails):
                    tails.append(j)
                    chains.append(link)
                elif j < tails[k]:
                    tails[k], chains[k] = j, link
        link, middle = chains[-1] if chains else None, []
        while link:
            middle.append(link[:2])
            link = link[2]
        out += middle[::-1]
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def align(a: list, b: list) -> list:
    """Align two child lists: matches are united, the rest becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [unite(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*_matches([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(unite(a[p], b[q]))
        i, j = p + 1, q + 1
    return out if len(out) <= MAX_KIDS else _gathered(out)


def _gathered(nodes: list) -> list:
    """Children of one key gathered into an optional repeated one; of too many kinds, those with least text into one kind."""
    kinds: dict[str, list] = {}
    for x in nodes:
        kinds[x[0]] = _same_page(kinds[x[0]], x) if x[0] in kinds else x
    out = [[x[0], True, True, *x[3:]] for x in kinds.values()]
    if len(out) > MAX_KIDS:
        least = sorted(x[4] for x in out)[len(out) - MAX_KIDS]
        rest = [x for x in out if x[4] <= least]
        out = [x for x in out if x[4] > least]
        out.append(["*", True, True, max(x[3] for x in rest), sum(x[4] for x in rest), None, []])
    return out


def fold(node: list) -> list:
    """The node with adjacent repeats of one to three children folded into repeated groups, at every depth."""
    kids = [fold(k) for k in node[6]]
    for width in (1, 2, 3):
        out, k = [], 0
        while k < len(kids):
            keys = [x[0] for x in kids[k : k + width]]
            times = 1
            while len(keys) == width and [x[0] for x in kids[k + times * width : k + (times + 1) * width]] == keys:
                times += 1
            if times == 1 or keys == ["#"]:
                out.append(kids[k])
                k += 1
                continue
            group = kids[k : k + width]
            for t in range(1, times):
                group = [_same_page(x, y) for x, y in zip(group, kids[k + t * width : k + (t + 1) * width])]
            out.append([*group[0][:2], True, *group[0][3:]] if width == 1 else ["(" + " ".join(keys) + ")", False, True, 1, sum(x[4] for x in group), None, group])
            k += times * width
        kids = out
    return [*node[:4], node[4] + sum(x[4] for x in kids), node[5], kids]


def _same_page(a: list, b: list) -> list:
    u = unite(a, b)
    return [*u[:3], max(a[3], b[3]), *u[4:]]


def render(node: list) -> str:
    """The wrapper as a regular expression over tokens; #TEXT is a slot."""
    if node[0] == "#":
        body = "#TEXT" if node[5] is None else json.dumps(node[5], ensure_ascii=False)
    else:
        inner = " ".join(render(k) for k in node[6])
        body = inner if node[0].startswith("(") or not node[0] else f"<{node[0]}> {inner} </{node[0].split('.')[0]}>".replace("  ", " ")
    if node[1] or node[2]:
        body = f"({body}){'*' if node[1] and node[2] else '+' if node[2] else '?'}"
    return body


def rules(wrapper: list) -> dict:
    """Where the host's main text stands (a path of keys), its template texts and the shares of slot text, from its wrapper."""
    fixed: list[str] = []

    def walk(x: list, total: int) -> None:
        if x[0] == "#" and x[5] is not None and x[3] >= TEMPLATE_PAGES and 2 * x[3] >= total:
            fixed.append(x[5])
        for k in x[6]:
            walk(k, total)

    walk(wrapper, wrapper[3])
    known = set(fixed)
    slots: dict[tuple[str, ...], int] = {}
    titled: set[tuple[str, ...]] = set()

    def fill(x: list, above: tuple[str, ...]) -> int:
        if x[0] == "#":
            return 0 if x[5] is not None and x[5] in known else x[4]
        here = above if not x[0] or x[0].startswith("(") else (*above, x[0])
        size = x[4] if x[0] == "*" else sum(fill(k, here) for k in x[6])
        if here != above:
            slots[here] = slots.get(here, 0) + size
        if x[0].split(".")[0] == "h1" and size:
            titled.update(here[:k] for k in range(1, len(here)))
        return size

    total = fill(wrapper, ())
    below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for p in slots:
        below.setdefault(p[:-1], []).append(p)
    path: tuple[str, ...] = ()
    while True:  # down to the deepest element that holds most of the slots' text, and the title where one is
        kids = [p for p in below.get(path, []) if p[-1].split(".")[0] not in DROPPED]
        best = max(kids, key=slots.get, default=None)
        if best is None or slots[best] < 0.6 * slots.get(path, total) or best[-1].split(".")[0] in HEADINGS | {"p", "li", "td", "blockquote", "pre", "*"} or any(p in titled for p in kids if p != best):
            break
        path = best
    return {"path": list(path), "fixed": fixed, "slots": {"\n".join(k): v / total for k, v in slots.items() if v >= 0.02 * total > 0}}


def main_text(html: str, rule: dict | None = None) -> str:
    """Main text of one page, its blocks joined by line feeds.

    Regions are weighed by the text they hold on the page, without links and template text, times the share of the
    host's slot text that the wrapper has there. Text outside of article and main elements counts a third.
    """
    good = [b for b in Page(html).blocks if not b[2]]
    fixed, path, slots = (set(rule["fixed"]), tuple(rule["path"]), rule["slots"]) if rule else (set(), (), {})
    sizes: dict[tuple[str, ...], float] = {}
    for b in good:
        if b[3] or path and b[0][: len(path)] == path:
            sizes[b[3]] = sizes.get(b[3], 0) + (0 if b[1] in fixed else len(b[1]) - b[4])

    def share(region: tuple[str, ...]) -> float:
        inner = [r for r in sizes if r and r != region and r[: len(region)] == region]
        own = slots.get("\n".join(region or path), 0) - sum(slots.get("\n".join(r), 0) for r in inner if region or r[: len(path)] == path)
        return 0.25 + max(own, 0)

    if any(sizes):
        best = max(sizes, key=lambda r: (sizes[r] * share(r) * (1 if r else 1 / 3), bool(r)))
        if best:
            return "\n".join(b[1] for b in good if b[3] == best)
        good = [b for b in good if not b[3]]
    below = [b for b in good if b[0][: len(path)] == path and path]
    kept = [b for b in below or good if b[1] not in fixed]
    return "\n".join(b[1] for b in kept or below or good)


_WRAPPERS = T.StructType([T.StructField("host", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("wrapper", T.StringType())])


def _first_wrappers(b: pa.RecordBatch):
    """One wrapper a host from a batch of different pages (host, html)."""
    by: dict[str, list] = {}
    salt = 0
    for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        salt = (salt * 31 + len(html)) % SALTS
        tree = fold(Page(html).tree)
        by[host] = unite(by[host], tree) if host in by else tree
    yield [list(by), [salt] * len(by), [json.dumps(w, ensure_ascii=False) for w in by.values()]]


def _united(wrappers: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One wrapper for each value of keys, united one at a time from a sorted stream; last: as rules."""
    rows = wrappers.repartition(*keys).sortWithinPartitions(*keys)
    at = [wrappers.columns.index(k) for k in keys]

    def run(batches):
        now, key, out = None, None, []

        def close():
            out.append((key[0], key[1] if len(key) > 1 else 0, json.dumps(rules(now) if last else now, ensure_ascii=False)))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                k = tuple(row[i] for i in at)
                w = json.loads(row[2])
                if k == key:
                    now = unite(now, w)
                    continue
                if key is not None:
                    close()
                now, key = w, k
            yield _rows(out)
            out.clear()
        if key is not None:
            close()
            yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=["host", "salt", "wrapper"])

    return rows.mapInArrow(run, _WRAPPERS)


def _pages(pages: DataFrame) -> DataFrame:
    rows = only(pages, page_id="long", url="string", html="string")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame, as_rules: bool = False) -> DataFrame:
    """(host, salt, wrapper): each host's wrapper, or the rules drawn from it, as JSON."""
    # equal pages of a host count once in the whole table, so that a template text needs different pages
    different = _pages(pages).select("host", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest")).dropDuplicates(["host", "digest"])
    first = arrow_map(different.select("host", "html"), _first_wrappers, _WRAPPERS)
    return _united(_united(first, ["host", "salt"], False), ["host"], as_rules)


@lru_cache(maxsize=2000)
def _rule(text: str) -> dict:
    return json.loads(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    known = staged(wrappers(pages, as_rules=True), "rules").select("host", F.col("wrapper").alias("rule"))
    rows = _pages(pages).join(known, "host", "left").select("page_id", "url", "html", "rule")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(b: pa.RecordBatch):
        ids, urls, htmls, ruled = (b.column(k).to_pylist() for k in range(4))
        for a in range(0, len(ids), 200):
            yield [ids[a : a + 200], urls[a : a + 200], [main_text(h, _rule(r) if r else None) for h, r in zip(htmls[a : a + 200], ruled[a : a + 200])]]

    return arrow_map(rows, run, schema).withColumn("n_chars", F.length("text").cast("long"))
