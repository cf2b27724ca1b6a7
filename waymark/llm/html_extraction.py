"""Operator 7: HTML main-text extraction by union-free wrapper inference.

The pages of a host share templates. Each page is a stream of tokens (start and end tags of block elements with their class
names, and texts), kept nested; elements without any text are left out. The streams are aligned left to right into a wrapper, a union-free expression: sequences of
elements and texts, each once, optional (``?``) or repeated (``+``), and groups of neighbours that repeat together. Texts that
differ become slots. A mismatch of tags is first tried as a repetition (square matching: the tokens from there on equal the end of what was just read), else resolved as an
optional by a cross search for the next token that both sides have. All that any page holds stays matched, so a page can be
read by its wrapper. Tasks align their own pages; their wrappers, whose size is bounded by ``WIDTH`` and ``DEPTH`` and not by the number of pages, are aligned by host. All
pages of a host count.

The wrapper decides: texts that never differ across three or more pages count a fifth, links less (unless there is no other text), and the article is the smallest group with
nearly all of what is left. If a group that names itself (``article``, ``main``, a content class) holds at least half of that, it is
taken instead, with its constant texts. Menus, headers, footers, sidebars, notices, adverts, forms and comments by tag or class name are no part of it; a class name counts as a
whole (``has-sidebar`` is none), and not at all on a group that holds most of the slot text together with an article, main or h1.
Each page is then read by the wrapper's automaton, and what its texts are is what the units that match them are. A page that has
nothing in the container gets a wrapper of its own.

Cases. A null or empty page, or one without an article text, gives an empty text. Pages without a host share one wrapper. Unclosed
and stray tags are tolerated; an unclosed comment, script or style runs to the end. Repeated rows are all returned and count as pages each; other
columns are ignored. An empty table gives an empty one. Of texts of one page that are equal, all are kept.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored
from waymark.llm.url_filter import host_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[a-z]+")
NOT_NAME = re.compile(r"[^a-z]+")

# HTML elements by their part in a page.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address "
    "header footer nav aside form fieldset legend details summary hr center dir menu dialog hgroup search option optgroup".split()
)
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas audio video head title".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_BY_BLOCK = frozenset(BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "html", "body"})
SCOPE = frozenset("html body main article section div ul ol table td th blockquote header footer nav aside form details figure".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog search fieldset option".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu sidebar side footer header masthead ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond reply replies discussion share sharing social related "
    "recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget toolbar pagination pager copyright legal skip tags byline".split()
)
CONTENT_NAMES = frozenset("content article post entry story main maincontent articlebody body text".split())
#: Pieces of a class name that say what a page has or how it is laid out, and pieces that only say which part of a noise group it is.
LAYOUT_PIECES = frozenset("has have is no not with without hide hidden show layout col cols column columns two three".split())
PART_PIECES = frozenset("area list section wrap wrapper container box block bar panel inner outer top bottom left right item items links link text content primary secondary main posts articles stories entries".split())
#: Noise names that are parts of an article when they stand in one.
HEADING_NAMES = frozenset("header byline".split())


def label_of(tag: str, attrs: str) -> str:
    """The tag with its class, id and role names, in which runs of other signs than letters are hyphens."""
    if not attrs:
        return tag
    names = sorted({w for m in NAMES.finditer(attrs) for x in (m[2] or m[3] or m[4] or "").lower().split() if (w := NOT_NAME.sub("-", x).strip("-"))})
    return f"{tag}.{'.'.join(names)}" if names else tag


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """The text blocks of a page in order: (path of labels, text, characters of it inside links, numbers of the path's elements)."""
    out: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []
    stack: list[str] = []  # labels of open block elements
    ids: list[int] = []
    tags: list[str] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((tuple(stack), joined, min(linked, len(joined)), tuple(ids[:DEPTH])))
            text.clear()
        linked = 0

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = TAG.match(page, lt) if lt < n else None
        if lt < n and not m:  # a sign, not a tag
            lt += 1
        if lt > at:
            piece = page[at:lt]
            if "&" in piece:
                piece = entities.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            at = lt
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS and tag in tags:
                flush()
                cut = len(tags) - 1 - tags[::-1].index(tag)
                del tags[cut:], stack[cut:], ids[cut:]
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
            for closing in (CLOSES.get(tag, set()), {"p"} if tag in CLOSED_BY_BLOCK else set()):
                for x in range(len(tags) - 1, -1, -1):
                    if tags[x] in closing:
                        del tags[x:], stack[x:], ids[x:]
                        break
                    if tags[x] in SCOPE:
                        break
            if tag not in VOID:
                tags.append(tag)
                stack.append(label_of(tag, m[3]))
                ids.append(at)
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag not in VOID:
            continue
    flush()
    return out


# A unit of an expression: [label, least, most, pages, chars, link chars, digest of a text that never differed or None, units inside].
# The label of a text is "#", that of a group of neighbours that repeats together is empty; "div*" stands for a div of any names.
LABEL, LEAST, MOST, PAGES, CHARS, LINKS, CONST, KIDS = range(8)
TEXT = "#"

#: Levels of a page that have units of their own; what lies deeper is read as parts of the last.
DEPTH = 64
#: Units of one sequence beyond which it is written as a repeated group of its labels. Its texts all stay.
WIDTH = 64
#: Units in a period that is looked for where a sequence is that long.
PERIOD = 32


def unit(label: str, chars: int = 0, links: int = 0, const: str | None = None) -> list:
    return [label, 1, 1, 1, chars, links, const, []]


def same(a: list, b: list) -> bool:
    """Whether two units stand for the same token: equal labels, or for groups equal labels of all parts."""
    x, y = a[LABEL], b[LABEL]
    if not x or not y:
        return x == y and len(a[KIDS]) == len(b[KIDS]) and all(map(same, a[KIDS], b[KIDS]))
    return x == y or x[-1] == "*" and y.split(".")[0].rstrip("*") == x[:-1] or y[-1] == "*" and x.split(".")[0] == y[:-1]


def merged(a: list, b: list, once: bool) -> list:
    """One unit for two that are the same; ``once`` if both are on one page. Texts that differ are a slot."""
    label = b[LABEL] if b[LABEL][-1:] == "*" else a[LABEL]
    out = [label, min(a[LEAST], b[LEAST]), max(a[MOST], b[MOST]), max(a[PAGES], b[PAGES]) if once else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS]]
    return [*out, a[CONST] if a[CONST] == b[CONST] else None, aligned(a[KIDS], b[KIDS], once)]


def again(a: list, b: list) -> list:
    """A unit and its next round, which other pages may lack."""
    out = merged(a, b, True)
    out[LEAST], out[MOST] = a[LEAST], 2
    return out


def optional(a: list) -> list:
    return [a[LABEL], 0, *a[2:]]


def round_of(group: list, units: list, at: int) -> int:
    """Number of units from ``at`` on that are one round of a group; 0 if they are none."""
    n = 0
    for part in group[KIDS]:
        begin = n
        while at + n < len(units) and same(part, units[at + n]) and (n == begin or part[MOST] > 1):
            n += 1
        if n == begin and part[LEAST]:
            return 0
    return n


def next_round(group: list, units: list) -> list:
    return again(group, ["", 1, 1, 1, 0, 0, None, units])


def repeated(out: list, units: list, at: int) -> int:
    """Square matching: if units from ``at`` on repeat the end of ``out``, which must end in the same token, both
    become one repeated group. Gives the number of units read."""
    if not out:
        return 0
    last = out[-1]
    if not last[LABEL]:
        n = round_of(last, units, at)
        if n:
            out[-1] = next_round(last, units[at : at + n])
        return n
    if same(last, units[at]):
        out.pop()
        while out and same(out[-1], last):
            last = again(last, out.pop())
        out.append(again(last, units[at]))
        return 1
    size = next((d + 1 for d in range(1, min(PERIOD, len(out), len(units) - at)) if same(last, units[at + d])), 0)
    if not size or not all(map(same, out[-size:], units[at : at + size])):
        return 0
    group = ["", 1, 2, max(u[PAGES] for u in out[-size:]), 0, 0, None, out[-size:]]
    del out[-size:]
    while len(out) >= size and all(map(same, out[-size:], group[KIDS])):
        group = next_round(group, out[-size:])
        del out[-size:]
    out.append(next_round(group, units[at : at + size]))
    return size


def aligned(left: list, right: list, once: bool = False) -> list:
    """One sequence that matches all that either does, read from left to right. A mismatch is resolved as a repeated
    group if either side repeats what was just read, else by a cross search: what must be stepped over to meet the other
    side's token again is optional."""
    out: list = []
    i = j = 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and same(left[i], right[j]):
            out.append(merged(left[i], right[j], once))
            i, j = i + 1, j + 1
        elif j < len(right) and (n := repeated(out, right, j)):
            j += n
        elif i < len(left) and (n := repeated(out, left, i)):
            i += n
        elif i == len(left) or j == len(right):
            out.extend(map(optional, left[i : i + 1] or right[j : j + 1]))
            i, j = (i, j + 1) if i == len(left) else (i + 1, j)
        elif not left[i][LABEL] and (n := round_of(left[i], right, j)):
            out.append(merged(left[i], ["", 1, 1, 1, 0, 0, None, right[j : j + n]], once))
            i, j = i + 1, j + n
        elif not right[j][LABEL] and (n := round_of(right[j], left, i)):
            out.append(merged(right[j], ["", 1, 1, max(u[PAGES] for u in left[i : i + n]), 0, 0, None, left[i : i + n]], once))
            i, j = i + n, j + 1
        else:
            over = next((d for d in range(1, len(right) - j) if same(left[i], right[j + d])), len(right))
            back = next((d for d in range(1, len(left) - i) if same(left[i + d], right[j])), len(left))
            n, m = (over, 0) if j + over < len(right) and (over <= back or i + back >= len(left)) else (0, back) if i + back < len(left) else (1, 1)
            out.extend(map(optional, (*left[i : i + m], *right[j : j + n])))
            i, j = i + m, j + n
    return bounded(out)


def bounded(units: list) -> list:
    """The sequence itself up to ``WIDTH`` units. Beyond, its repeats are folded; if it is still longer, it is written as
    one repeated group in which each tag is optional and stands for any names: that matches all that the sequence does."""
    if len(units) <= WIDTH:
        return units
    out: list = []
    for u in units:
        if not repeated(out, [u], 0):
            out.append(u)
            size = next((d for d in range(2, min(PERIOD, len(out) // 2) + 1) if same(out[-1 - d], u)), 0)
            if size and (tail := out[-size:]) and all(map(same, out[-2 * size : -size], tail)):
                del out[-size:]
                repeated(out, tail, 0)
            else:
                size = next((d for d in range(2, min(PERIOD, len(out) - 1) + 1) if not out[-1 - d][LABEL]), 0)
                if size and round_of(out[-1 - size], out[-size:], 0) == size:
                    out[-1 - size :] = [next_round(out[-1 - size], out[-size:])]
    if len(out) <= WIDTH:
        return out
    by_tag: dict[str, list] = {}

    def put(u: list) -> None:
        if not u[LABEL]:
            for part in u[KIDS]:
                put(part)
            return
        tag = u[LABEL].split(".")[0]
        general = [tag if tag == TEXT or tag[-1] == "*" else f"{tag}*", 0, *u[2:]]
        by_tag[tag.rstrip("*")] = again(known, general) if (known := by_tag.get(tag.rstrip("*"))) else general

    for u in out:
        put(u)
    return [["", 1, 2, max(u[PAGES] for u in by_tag.values()), 0, 0, None, list(by_tag.values())]]


def digest(text: str) -> str:
    """A constant text is known by a digest of the whole of it."""
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def page_tree(blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]) -> list:
    """The token stream of a page, nested: each element that holds text, and each text, is a unit."""
    root = unit("")
    opened: list[tuple[int, list]] = [(-1, root)]
    for path, text, linked, ids in blocks:
        n = 0
        while n < min(len(opened) - 1, len(ids), DEPTH) and opened[n + 1][0] == ids[n]:
            n += 1
        del opened[n + 1 :]
        for label, number in zip(path[n:DEPTH], ids[n:DEPTH], strict=True):
            at = unit(label)
            opened[-1][1][KIDS].append(at)
            opened.append((number, at))
        opened[-1][1][KIDS].append(unit(TEXT, len(text), linked, digest(text)))
    return root


def tree_of(blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]) -> list:
    """A page's own expression: its token stream, with no sequence beyond the bound."""

    def narrow(at: list) -> list:
        at[KIDS] = bounded([narrow(k) for k in at[KIDS]])
        return at

    return narrow(page_tree(blocks))


def align(a: list, b: list) -> list:
    """The wrapper that both pages, or the pages of both wrappers, match."""
    return merged(a, b, False)


def expression(at: list) -> str:
    """The wrapper as text: groups with ``?`` and ``+``, slots as ``#``, constant texts as ``'``."""
    if at[LABEL] == TEXT:
        inner = "#" if at[CONST] is None else "'"
    else:
        inner = f"{at[LABEL]}({' '.join(map(expression, at[KIDS]))})"
    return f"{inner}{'?' if not at[LEAST] else ''}{'+' if at[MOST] > 1 else ''}"


class Machine:
    """Position automaton of one sequence of units: which unit may come first, last and after which."""

    def __init__(self, units: list):
        self.units: list[list] = []
        self.after: list[set[int]] = []
        self.empty, self.first, self.last = self.chain(units)

    def chain(self, units: list) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for u in units:
            e, f, ends = self.one(u)
            for x in last:
                self.after[x] |= f
            first |= f if empty else set()
            last = last | ends if e else ends
            empty = empty and e
        return empty, first, last

    def one(self, u: list) -> tuple[bool, set[int], set[int]]:
        if u[LABEL]:
            empty, first, last = False, {len(self.units)}, {len(self.units)}
            self.units.append(u)
            self.after.append(set())
        else:
            empty, first, last = self.chain(u[KIDS])
        if u[MOST] > 1:
            for x in last:
                self.after[x] |= first
        return empty or not u[LEAST], first, last

    def read(self, tokens: list, fits: Callable[[list, list], bool] = same) -> list[int] | None:
        """The unit of each token; None if the sequence does not match."""
        steps: list[dict[int, int]] = []
        now: dict[int, int] = {-1: -1}
        for t in tokens:
            then: dict[int, int] = {}
            for x in sorted(now):
                for y in self.first if x < 0 else self.after[x]:
                    if y not in then and fits(self.units[y], t):
                        then[y] = x
            if not then:
                return None
            steps.append(then)
            now = then
        ends = sorted(self.last & set(now)) if tokens else []
        if tokens and not ends or not tokens and not self.empty:
            return None
        out: list[int] = []
        at = ends[0] if ends else -1
        for then in reversed(steps):
            out.append(at)
            at = then[at]
        return out[::-1]


class Reader:
    """Reads pages by one expression; automata are kept from page to page."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.machines: dict[int, Machine] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def start(self, page: list) -> bool:
        """Begins a page, given as its tree; whether all of it matches."""
        self.known = {}
        return self.machine(self.wrapper).read(page[KIDS], self.fits) is not None

    def machine(self, at: list) -> Machine:
        if id(at) not in self.machines:
            self.machines[id(at)] = Machine(at[KIDS])
        return self.machines[id(at)]

    def fits(self, at: list, token: list) -> bool:
        """Whether a unit matches an element with all that is in it."""
        if not same(at, token):
            return False
        if token[LABEL] == TEXT:
            return True
        key = (id(at), id(token))
        if key not in self.known:
            self.known[key] = self.machine(at).read(token[KIDS], self.fits) is not None
        return self.known[key]

    def units(self, at: list, token: list) -> list[list | None]:
        """The unit of each part of an element: by whole match, else by labels, else the first unit with its label."""
        machine = self.machine(at)
        found = machine.read(token[KIDS], self.fits) or machine.read(token[KIDS])
        if found is not None:
            return [machine.units[x] for x in found]
        return [next((u for u in machine.units if same(u, k)), None) for k in token[KIDS]]


def matches(wrapper: list, page: str) -> bool:
    """Whether a page is matched by an expression as a whole."""
    return Reader(wrapper).start(page_tree(blocks_of(page)))


@lru_cache(100_000)
def is_noise_name(name: str, inside: bool) -> bool:
    """Whether a class name says noise: its last piece does, or its first with only parts after it; ``entry-header`` is an article's."""
    *before, last = name.split("-")
    if LAYOUT_PIECES.intersection(before):
        return False
    if last in NOISE_NAMES:
        return not (last in HEADING_NAMES and (inside or CONTENT_NAMES.intersection(before)))
    return bool(before) and before[0] in NOISE_NAMES and not (inside and before[0] in HEADING_NAMES) and all(p in PART_PIECES or p in NOISE_NAMES for p in (*before[1:], last))


def is_noise(label: str, inside: bool) -> bool:
    tag, *names = label.split(".")
    if tag in NOISE_TAGS and not (inside and tag == "header"):
        return True
    return tag not in ("html", "body", "main", "article") and any(is_noise_name(n, inside) for n in names)


def slot_text(at: list, linked: int) -> float:
    """Characters of a text, those in links ``linked`` times less; a constant text counts a fifth."""
    own = max(0, at[CHARS] - linked * at[LINKS])
    return own if at[CONST] is None or at[PAGES] < 3 else 0.2 * own


def holders(wrapper: list, linked: int) -> set[int]:
    """Units that hold most of the slot text and an article, main or h1, none of them below a noise tag."""
    known: dict[int, tuple[float, bool]] = {}

    def walk(at: list) -> tuple[float, bool]:
        tag = tag_of(at)
        below = [walk(k) for k in at[KIDS] if tag_of(k) not in NOISE_TAGS]
        known[id(at)] = (slot_text(at, linked) if tag == TEXT else 0) + sum(t for t, _ in below), tag in ("article", "main", "h1") or any(h for _, h in below)
        return known[id(at)]

    whole, _ = walk(wrapper)
    return {u for u, (t, h) in known.items() if h and 2 * t > whole}


def tag_of(at: list) -> str:
    return at[LABEL].split(".")[0].rstrip("*")


# A rule's unit has a decision in place of the pages, and the digest of a constant text to leave out in place of the chars.
DECISION, DROP = PAGES, CHARS
MAIN, KEPT = 1, 2


def decision(wrapper: list) -> dict:
    """``wrapper``: its units, each with whether it is the article's container or is kept whatever its name; ``semantic``: whether
    the container names itself. ``main`` is false if there is no text."""
    out = decided(wrapper, 2)
    return out if out["main"] else decided(wrapper, 0)  # all text is in links


def decided(wrapper: list, linked: int) -> dict:
    keep = holders(wrapper, linked)
    found: list[tuple[int, float, int, int]] = []  # rank, text, depth, unit

    def walk(at: list, depth: int, inside: bool) -> float:
        tag = tag_of(at)
        if tag == TEXT:
            return slot_text(at, linked)
        names = PIECES.findall(at[LABEL])[1:]
        semantic = 3 if tag == "article" else 2 if tag == "main" or "main" in names and tag == "div" else 1 if CONTENT_NAMES.intersection(names) and tag in ("div", "section", "td") else 0
        total = sum(walk(k, depth + 1, inside or semantic > 1) for k in at[KIDS] if id(k) in keep or not is_noise(k[LABEL], inside or semantic > 1))
        if total and (at[LABEL] or not depth) and (semantic or tag in ("", "html", "body", "div", "section", "td", "main", "center")):
            found.append((semantic, total, depth, id(at)))
        return total

    whole = walk(wrapper, 0, False)
    if not whole:
        return {"main": False, "semantic": False, "wrapper": None}
    # the slots decide: the article is the smallest group with nearly all slot text; a name counts among groups with most of it
    named = [f for f in found if f[0] and 2 * f[1] >= whole]
    best = max(named, key=lambda f: (f[0], f[1], -f[2])) if named else max((f for f in found if f[1] >= 0.9 * whole), key=lambda f: (f[2], f[1]))

    def told(at: list) -> list:
        constant = at[CONST] if not named and at[LABEL] == TEXT and at[PAGES] >= 3 else None
        return [*at[:PAGES], (MAIN if id(at) == best[3] else 0) | (KEPT if id(at) in keep else 0), constant, None, None, [told(k) for k in at[KIDS]]]

    return {"main": True, "semantic": bool(named), "wrapper": told(wrapper)}


def main_text(blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]], rule: dict) -> str:
    """The page is read by the wrapper: its texts in the container, without noise groups and constant template texts. Where a
    sequence does not match, an element is the first unit with its label, and kept if there is none."""
    if not rule["main"]:
        return ""
    if "reader" not in rule:
        rule["reader"] = Reader(rule["wrapper"])
    reader = rule["reader"]
    out: list[str] = []
    texts = iter(blocks)

    def walk(token: list, at: list | None, depth: int, start: int) -> None:
        """``start``: level below which names are judged, the container's; 0 outside of it."""
        if token[LABEL] == TEXT:
            path, text, _, _ = next(texts)
            # levels beyond DEPTH have no units and are judged by name alone
            if start > 0 and not (at and at[DROP] and at[DROP] == token[CONST]) and not any(is_noise(x, rule["semantic"]) for x in path[max(DEPTH, start - 1) :]):
                out.append(text)
            return
        if at and at[DECISION] & MAIN:
            start = depth + 1
        elif start > 0 and is_noise(token[LABEL], rule["semantic"]) and not (at and at[DECISION] & KEPT):
            start = -1
        for k, u in zip(token[KIDS], reader.units(at, token) if at else [None] * len(token[KIDS]), strict=True):
            walk(k, u, depth + 1, start)

    page = page_tree(blocks)
    reader.start(page)
    walk(page, rule["wrapper"], 0, 0)
    return "\n\n".join(out)


def extract(page: str | None, rule: dict | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    out = main_text(blocks, rule) if rule else ""
    return out or main_text(blocks, decision(tree_of(blocks)))


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, rule)``: the decision of each host's wrapper as JSON."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = tree_of(blocks_of(page))
                own[host] = align(own[host], tree) if host in own else tree
            if len(own) > 20_000:
                yield told(own)
                own = {}
        if own:
            yield told(own)

    def told(own: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(map(json.dumps, own.values()), pa.string())], ["host", "wrapper"])

    def joined(rows: pd.DataFrame) -> list:
        trees = iter(sorted(rows["wrapper"]))
        out = json.loads(next(trees))
        for t in trees:
            out = align(out, json.loads(t))
        return out

    some = pages.where("html is not null").select("host", "html").mapInArrow(learn, "host string, wrapper string")
    # a hot host has a wrapper from each task: they are aligned in groups first
    some = some.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(64)).alias("part")).applyInPandas(lambda r: pd.DataFrame({"host": r["host"][:1], "wrapper": [json.dumps(joined(r))]}), "host string, wrapper string")
    return some.groupBy("host").applyInPandas(lambda r: pd.DataFrame({"host": r["host"][:1], "rule": [json.dumps(decision(joined(r)))]}), "host string, rule string")


#: Bytes of all rules up to which they are broadcast.
RULE_BYTES = 4_000_000


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rules = stored(wrappers(pages), "wrappers")
    size = rules.agg(F.sum(F.length("rule") + F.length("host") + 64)).first()[0] or 0
    ruled = pages.join(F.broadcast(rules) if size <= RULE_BYTES else rules, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rule not in known:
                    if len(known) > 50_000:
                        known = {None: None}
                    known[rule] = json.loads(rule)
                texts.append(extract(page, known[rule]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ruled.mapInArrow(run, "page_id long, url string, text string, n_chars long")
