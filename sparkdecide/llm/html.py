"""Main text of web pages by wrappers: union-free regular expressions over same-host token streams.

A page is a stream of tags and texts, nested by its tags. A wrapper starts as the stream
of one page; each further page of the host is aligned with it, level by level. Equal
neighbours become a repeated group and what only one side has becomes optional. Each group
remembers how many pages have it, how much text and how much of it in links it has seen,
and whether its text was always the same: then it is part of the template, otherwise a slot.
In the finished wrapper the groups are marked as main text or as frame (menus, headers,
footers, sidebars, notices, adverts, forms, comments), by their tags and names, by the
article or main groups, and by the share of links on pages without any. An article or
main group is main text if on at least half of the pages that have it, it has a fifth
or more of the text of the page's largest one. On pages without such groups template text is frame
too, whatever its name: a group outside of repeated groups, before the first or after the last of its
neighbours whose text differs from page to page (not between them, where headings stand), with the same text on TEMPLATE
pages or more and on half of those that have the group around it.

Wrappers are fitted on all pages of a host: pages with one skeleton (tags, names and
quantities) are summed up first, and each skeleton is merged once. Pages are then read
along their host's wrapper. What it doesn't have where the page has it, and a page none
of whose main groups the wrapper takes, are marked by the same rules on the page alone.
Names that differ from page to page are left out: digits, ids without a meaning for the
rules, and all such names of html, body, article and main. Text inside a main group is never left out for being the same
on all pages: headings, labels and names of authors repeat there.

Defined results: null or empty html gives an empty text; a page without a host has
no wrapper and is read by the rules alone. Unclosed tags end where HTML ends them. From a
tag on whose quotes never end, tags end at their first >; a tag without any takes the rest.
Pages nest as deeply as they like, and lists of siblings are aligned in bit vectors.
Rows are independent given the wrappers; repeated rows give equal texts. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .texts import bounded_batches

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FRAME = frozenset("nav header footer aside form button select menu dialog head script style noscript template iframe svg textarea title".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table article section main div body html td th select".split())
FRAME_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header login menu modal nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post story".split())

#: Tasks that the skeletons of one host are first merged in.
PARTS = 32
#: Pages of a host with the same text in a group, for it to be part of the template.
TEMPLATE = 5

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "name", "children", "size", "digest")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.children, self.size, self.digest = tag, name, [], 0, 0


def unrolled(f: Callable) -> Callable:
    """A recursive function written as a generator, which yields the arguments of its inner calls."""

    @wraps(f)
    def run(*args: object) -> object:
        calls, value = [f(*args)], None
        while calls:
            try:
                inner = calls[-1].send(value)
            except StopIteration as end:
                calls.pop()
                value = end.value
            else:
                calls.append(f(*inner))
                value = None
        return value

    return run


@lru_cache(maxsize=1 << 16)
def named(tag: str, attributes: str) -> str:
    """Classes, id and role of a tag, without what differs from page to page."""
    out = []
    for key, value in _NAMED.findall(attributes):
        for word in value.strip("\"'").lower().split():
            if _is_main_name(word) or _is_frame_name(word) or key.lower() != "id" and tag not in ("html", "body", "article", "main"):
                out.append(_DIGITS.sub("0", word))
    return " ".join(out)


def _is_frame_name(word: str) -> bool:
    return any(w in FRAME_NAMES for w in (word, *re.split(r"[-_]+", word)))


def _is_main_name(word: str) -> bool:
    return re.sub(r"[-_]", "", word) in MAIN_NAMES


def parse(page: str) -> Node:
    """The page's stream, nested; texts are str children, with character references decoded."""
    root = Node("#root")
    stack, opened, at, n, quotes = [root], Counter(), 0, len(page), True

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text))

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if page.startswith(("<!", "<?"), lt):
            put(page[at:lt])
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment else page.find(">", lt)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            put(page[at : lt + 1])
            at = lt + 1
            continue
        put(page[at:lt])
        rest = _REST.match(page, m.end()) if quotes else None
        quotes = rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            break
        at, tag, attributes = end, m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag in INLINE:
                    break
            continue
        ends = ENDS.get(tag, ()) or (("p",) if tag in ENDS_P else ())
        for k in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in SCOPE:
                break
        node = Node(tag, named(tag, attributes) if attributes else "")
        stack[-1].children.append(node)
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = raw.end() if raw else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def sign(node: Node | str) -> str:
    return "#" if isinstance(node, str) else f"{node.tag}.{node.name}"


def _digest(data: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) >> 1 | 1


def wrapper_of(root: Node) -> dict:
    """The stream of one page as a wrapper, with equal neighbours made one repeated group.

    s: sign; q: "1", "?", "+" or "*"; t, l: characters of text seen, and those in links; n, k: pages
    that have it as a main region with text, and those that take it as main text; p: pages that have
    it; lo, hi: the lowest and the highest digest of its text; c: inner items.
    """
    order, work = [], [(root, False)]
    while work:
        node, in_link = work.pop()
        in_link = in_link or node.tag == "a"
        order.append((node, in_link))
        work.extend((c, in_link) for c in node.children if not isinstance(c, str))
    done: dict[int, dict] = {}
    for node, in_link in reversed(order):
        items: list[dict] = []
        seen: list[int] = []
        for child in node.children:
            if isinstance(child, str):
                words = child.split()
                if not words:
                    continue
                size = sum(map(len, words))
                item = _item("#", size, size * in_link, _digest(" ".join(words)), [])
            else:
                item = done.pop(id(child))
                if child.tag in INLINE and child.tag != "a":
                    if not item["t"]:
                        continue
                    item = _item("#", item["t"], item["l"], child.digest, [])
            if item["t"]:
                seen.append(item["lo"] if isinstance(child, str) else child.digest)
            if items and items[-1]["s"] == item["s"]:
                items[-1] = merged(items[-1], item) | {"q": "+"}
            else:
                items.append(item)
        node.size = sum(i["t"] for i in items)
        node.digest = _digest(np.array(seen, np.int64).tobytes()) if seen else 0
        done[id(node)] = _item(sign(node), node.size, sum(i["l"] for i in items), node.digest, items)
    return done[id(root)]


def _item(s: str, t: int, l: int, digest: int, c: list[dict]) -> dict:  # noqa: E741
    return {"s": s, "q": "1", "t": t, "l": l, "n": 0, "k": 0, "p": 1, "lo": digest, "hi": digest, "c": c}


def regions(wrapper: dict) -> list[dict]:
    """The outermost article and main groups that aren't in a frame."""
    out, work = [], [wrapper]
    while work:
        for c in work.pop()["c"]:
            if c["s"] == "#" or is_frame(c["s"]):
                continue
            (out if is_main(c["s"]) else work).append(c)
    return out


def page_wrapper(root: Node) -> dict:
    """The wrapper of one page, with its main regions compared with each other."""
    out = wrapper_of(root)
    found = [r for r in regions(out) if r["t"]]
    most = max((r["t"] for r in found), default=0)
    for r in found:
        r["n"], r["k"] = 1, int(r["t"] >= 0.2 * most)
    return out


_BOTH = {("1", "1"): "1", ("1", "?"): "?", ("1", "+"): "+", ("1", "*"): "*", ("?", "?"): "?", ("?", "+"): "*", ("?", "*"): "*", ("+", "+"): "+", ("+", "*"): "*", ("*", "*"): "*"}


def _quantity(a: str, b: str) -> str:
    return _BOTH.get((a, b)) or _BOTH[b, a]


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of two lists of signs, with the rest of both in order."""
    if (whole := _embedded(b, a)) is not None:
        by = {i: j for j, i in enumerate(whole)}
        return [(i, by.get(i)) for i in range(len(a))]
    if (whole := _embedded(a, b)) is not None:
        by = {j: i for i, j in enumerate(whole)}
        return [(by.get(j), j) for j in range(len(b))]
    common = set(a) & set(b)
    left, right = [i for i, x in enumerate(a) if x in common], [j for j, x in enumerate(b) if x in common]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for u, v in (*_matches([a[i] for i in left], [b[j] for j in right]), (len(left), len(right))):
        to_i, to_j = left[u] if u < len(left) else len(a), right[v] if v < len(right) else len(b)
        out += ((k, None) for k in range(i, to_i))
        out += ((None, k) for k in range(j, to_j))
        if to_i < len(a) and u < len(left):
            out.append((to_i, to_j))
        i, j = to_i + 1, to_j + 1
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence.

    A row of the table is one integer: bit j is 0 where the length grows from b[:j] to b[: j + 1].
    Rows are kept at the starts of blocks and made again for one block at a time on the way back.
    """
    ones = (1 << len(b)) - 1
    places: dict[str, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    masks: dict[str, int] = {}

    def mask(x: str) -> int:
        if x in masks:
            return masks[x]
        out = 0
        for j in places[x]:
            out |= 1 << j
        if len(places[x]) > 16:  # few signs, so few masks to keep
            masks[x] = out
        return out

    def rows(row: int, start: int, end: int) -> Iterator[int]:
        for i in range(start, end):
            both = row & mask(a[i])
            row = ((row + both) | (row - both)) & ones
            yield row

    block = isqrt(len(a)) + 1
    starts, row = [ones], ones
    for i, row in enumerate(rows(ones, 0, len(a)), 1):  # noqa: B007
        if i % block == 0:
            starts.append(row)
    out, j = [], len(b)
    for k in range(len(starts) - 1, -1, -1):
        start, end = k * block, min(len(a), (k + 1) * block)
        kept = list(rows(starts[k], start, end))
        i = end
        while i > start and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif kept[i - 1 - start] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return out[::-1]


def _embedded(few: list[str], many: list[str]) -> list[int] | None:
    """Places in ``many`` of all of ``few``, in order, if they are there."""
    out, at = [], 0
    for x in few:
        try:
            at = many.index(x, at) + 1
        except ValueError:
            return None
        out.append(at - 1)
    return out


def merged(a: dict, b: dict) -> dict:
    """Two groups of one sign as one: a mismatch becomes optional, a repetition stays one."""
    return _merged(a, b) if a["c"] or b["c"] else _joined(a, b, [])


def _joined(a: dict, b: dict, items: list[dict]) -> dict:
    return {
        "s": a["s"],
        "q": _quantity(a["q"], b["q"]),
        **{k: a[k] + b[k] for k in "tlnkp"},
        "lo": min(a["lo"], b["lo"]),
        "hi": max(a["hi"], b["hi"]),
        "c": items,
    }


@unrolled
def _merged(a: dict, b: dict) -> Iterator:
    items = []
    for i, j in aligned([x["s"] for x in a["c"]], [x["s"] for x in b["c"]]):
        if i is None or j is None:
            one = a["c"][i] if j is None else b["c"][j]
            item = one | {"q": _quantity(one["q"], "?")}
        else:
            x, y = a["c"][i], b["c"][j]
            item = (yield x, y) if x["c"] or y["c"] else _joined(x, y, [])
        if items and items[-1]["s"] == item["s"]:
            q = "*" if "?" in items[-1]["q"] + item["q"] else "+"
            items[-1] = (yield items[-1], item) | {"q": q}
        else:
            items.append(item)
    return _joined(a, b, items)


@lru_cache(maxsize=1 << 16)
def is_frame(s: str) -> bool:
    """Is a group of this sign frame, by its tag or its names?"""
    tag, _, name = s.partition(".")
    if tag in FRAME:
        return True
    if not name or tag in ("html", "body", "article", "main"):
        return False
    return any(_is_frame_name(x) for x in name.split())


@lru_cache(maxsize=1 << 16)
def is_main(s: str) -> bool:
    tag, _, name = s.partition(".")
    return tag in ("article", "main") or any(_is_main_name(x) for x in name.split())


OUT, OPEN, IN = 0, 1, 2


def marked(wrapper: dict) -> dict:
    """The wrapper with marks: m by its main regions, a by the share of links, for pages without main regions.

    IN is main text, OUT is frame with all that is inside, OPEN is neither (it may hold main regions).
    x says whether a group is template text for a page without main regions, and h its digest in hexadecimal.
    """
    chosen = {id(r) for r in regions(wrapper) if r["n"] and 2 * r["k"] >= r["n"]}
    whole = ("#root.", "html.", "body.")

    @unrolled
    def mark(w: dict, m: int, a: int, x: int, most: int) -> Iterator:
        once, same = w["q"] in "1?", w["lo"] == w["hi"]
        if is_frame(w["s"]):
            m = a = OUT
        elif id(w) in chosen:
            m = IN
        if a and w["s"] not in whole and w["t"] and w["l"] > 0.6 * w["t"]:
            a = OUT
        template = x if once and same and w["t"] and w["s"] not in ("#", *whole) and w["p"] >= TEMPLATE and 2 * w["p"] >= most else 0
        # x: this group, or one around it, differs as a whole and is not repeated
        x = 1 if once and not same and (x or w is wrapper) else 0
        slots = [k for k, c in enumerate(w["c"]) if c["lo"] != c["hi"] or c["q"] not in "1?"]
        items = []
        for k, c in enumerate(w["c"]):
            inside = slots and slots[0] < k < slots[-1]
            items.append((yield c, m, a, 0 if inside or id(w) in chosen else x, w["p"]))
        return w | {"m": m, "a": a, "x": template, "h": f"{w['lo']:x}" if template else "", "c": items}

    return mark(wrapper, OPEN, IN, 0, wrapper["p"])


def infer(pages: list[str]) -> dict:
    """The marked wrapper of some pages of a host."""
    out = None
    for p in pages:
        one = page_wrapper(parse(p))
        out = one if out is None else merged(out, one)
    return marked(out)


def _find(group: dict | None, s: str, at: int) -> int | None:
    """The next item of a sign, or the first if they come in another order."""
    items = group["c"] if group else ()
    for k in (at, at + 1):
        if k < len(items) and items[k]["s"] == s:
            return k
    if not items:
        return None
    if "places" not in group:
        group["places"] = places = {}
        for k, item in enumerate(items):
            places.setdefault(item["s"], []).append(k)
    found = group["places"].get(s)
    if not found:
        return None
    k = bisect_left(found, at)
    return found[k] if k < len(found) else found[0]


def read(page: str, wrapper: dict | None = None) -> str:
    """Blocks of the page's main text, two line ends between them; without a wrapper by the page alone."""
    root = parse(page)
    one = page_wrapper(root)
    own = marked(one)
    mode = "m" if any(r["n"] for r in regions(one)) else "a"
    return (_read(root, wrapper, own, mode) if wrapper else "") or _read(root, None, own, mode)


def _read(root: Node, wrapper: dict | None, own: dict, mode: str) -> str:
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        text = " ".join("".join(open_).split())
        if text:
            blocks.append(text)
        open_.clear()

    # an explicit stack: pages may nest deeply. Each entry: node, its groups in both wrappers or None, its mark
    work: list[tuple] = [(root, wrapper, own, (wrapper or own)[mode])]
    while work:
        node, group, alone, state = work.pop()
        if node is None:
            end()
            continue
        if isinstance(node, str):
            if state == IN:
                open_.append(node)
            continue
        if node.tag == "br" or node.tag in VOID:
            open_.append(" ")
        block = node.tag not in INLINE
        if block:
            end()
        todo: list[tuple] = []
        at = [0, 0]
        groups = (group, alone)

        def step(s: str) -> list[dict | None]:
            out: list[dict | None] = []
            for w in (0, 1):
                k = _find(groups[w], s, at[w])  # noqa: B023
                if k is not None and k >= at[w]:  # noqa: B023
                    at[w] = k  # noqa: B023
                out.append(None if k is None else groups[w]["c"][k])  # noqa: B023
            return out

        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    step("#")
                todo.append((child, None, None, state))
            elif child.tag in INLINE and child.tag != "a":
                if child.size:
                    step("#")
                todo.append((child, group, alone, OUT if is_frame(sign(child)) else state))
            else:
                s = sign(child)
                known, here = step(s)
                if known is not None:
                    same = mode == "a" and known["x"] and known["h"] == f"{child.digest:x}"
                    mark = OUT if same else known[mode]
                elif state == OUT or is_frame(s):
                    mark = OUT
                elif here is not None:
                    mark = here[mode] if state == OPEN or mode == "a" else IN
                else:
                    mark = IN if state == OPEN and is_main(s) else state
                todo.append((child, known, here, mark))
        if block:
            todo.append((None, None, None, OUT))
        work.extend(reversed(todo))
    end()
    return "\n\n".join(blocks)


def flat(wrapper: dict, keys: str) -> str:
    """Items in order, one a line: depth, values of ``keys``, sign."""
    out, work = [], [(0, wrapper)]
    while work:
        depth, w = work.pop()
        out.append(f"{depth}\t{''.join(str(w[k]) for k in keys)}\t{w['s']}")
        work.extend((depth + 1, c) for c in reversed(w["c"]))
    return "\n".join(out)


SUMS = ("t", "l", "n", "k", "p", "lo", "hi")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of two wrappers of one skeleton as one."""
    a, b = a.reshape(-1, len(SUMS)), b.reshape(-1, len(SUMS))
    low, high = np.minimum(a[:, 5:6], b[:, 5:6]), np.maximum(a[:, 6:], b[:, 6:])
    return np.hstack([a[:, :5] + b[:, :5], low, high]).ravel()


def numbers(wrapper: dict) -> list[int]:
    """t, l, n, k, p, lo, hi of the items in the order of ``flat``."""
    out, work = [], [wrapper]
    while work:
        w = work.pop()
        out += (w[k] for k in SUMS)
        work.extend(reversed(w["c"]))
    return out


def nested(text: str) -> list[dict]:
    """Items of ``flat`` in order, the first with all others inside; the values are in v."""
    out: list[dict] = []
    path: list[dict] = []
    for line in text.split("\n"):
        depth, v, s = line.split("\t")
        item = {"s": s, "v": v, "c": []}
        del path[int(depth) :]
        if path:
            path[-1]["c"].append(item)
        path.append(item)
        out.append(item)
    return out


def of_skeleton(skeleton: str, sums: np.ndarray) -> dict:
    items = nested(skeleton)
    for item, values in zip(items, sums.reshape(-1, len(SUMS)).tolist(), strict=True):
        item |= {"q": item.pop("v"), **dict(zip(SUMS, values, strict=True))}
    return items[0]


@lru_cache(maxsize=1024)
def _wrapper(text: str) -> dict:
    items = nested(text)
    for item in items:
        v = item.pop("v")
        item |= {"m": int(v[0]), "a": int(v[1]), "x": int(v[2]), "h": v[3:]}
    return items[0]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, skeleton, sums of the distinct skeletons of a batch of host, html."""
    for b in batches:
        known: dict[tuple[str, str], np.ndarray] = {}
        for h, page in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
            w = page_wrapper(parse(page))
            key, sums = (h, flat(w, "q")), np.array(numbers(w), np.int64)
            known[key] = added(known[key], sums) if key in known else sums
        yield _rows([k[0] for k in known], [k[1] for k in known], list(known.values()))


def _rows(hosts: list[str], texts: list[str], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(sums, pa.list_(pa.int64()))], names=["host", "skeleton", "sums"])


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
    """One wrapper for each run of rows with equal host and part, whose equal skeletons follow each other."""
    run, skeleton, sums, out = None, None, None, None

    def put() -> dict:
        one = of_skeleton(skeleton, sums)
        return one if out is None else merged(out, one)

    for b in batches:
        for h, part, s, v in zip(b["host"].to_pylist(), b["part"].to_pylist(), b["skeleton"].to_pylist(), b["sums"], strict=True):
            more = v.values.to_numpy(zero_copy_only=False)
            if run == (h, part) and skeleton == s:
                sums = added(sums, more)
                continue
            if run is not None:
                out = put()
                if run != (h, part):
                    yield run[0], out
                    out = None
            run, skeleton, sums = (h, part), s, more
    if run is not None:
        yield run[0], put()


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of each host, from all its pages."""
    rows = pages.select(host(F.col("url")).alias("host"), "html").filter("host <> '' and html <> ''")
    schema = "host string, skeleton string, sums array<bigint>"

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w in fitted(batches):
            yield _rows([h], [flat(w, "q")], [np.array(numbers(w), np.int64)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w in fitted(batches):
            yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([flat(marked(w), "maxh")])], names=["host", "wrapper"])

    seen = rows.mapInArrow(skeletons, schema).withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(PARTS)))
    parts = seen.repartition("host", "part").sortWithinPartitions("host", "part", "skeleton").mapInArrow(partly, schema).withColumn("part", F.lit(0).cast("long"))
    return materialize(parts.repartition("host").sortWithinPartitions("host", "skeleton").mapInArrow(whole, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    known = wrappers(pages)

    def extract(source: pa.Array, wrapper: pa.Array) -> pa.Array:
        out = []
        for h, w in zip(source.to_pylist(), wrapper.to_pylist(), strict=True):
            out.append(read(h, _wrapper(w) if w else None) if h else "")
        return pa.array(out, pa.string())

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(known, "host", "left")
    text = F.arrow_udf(extract, "string")("html", "wrapper")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
