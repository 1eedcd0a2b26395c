"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over token streams, as in RoadRunner (Crescenzi, Mecca and
Merialdo, 2001). A page is a stream of tokens: elements (tag, class, id and role; runs of digits count alike)
with their extents, and texts. First a page is folded: an element that follows its like, or a short series that follows its
like, becomes a repeated group. Then the host's pages are aligned one after the other by walking two streams in
parallel; each mismatch is resolved:

* text against other text: the place becomes a slot;
* a token that the other stream has further on: what lies before it becomes optional;
* the same tag with other attributes: the attributes become open;
* else both tokens become optional.

Every token keeps on how many pages it occurs and how much text it held. A wrapper then tells what its host's pages
have as an article: from the root it is followed down to the container that holds most of the text that varies
between pages, links and page furniture by tag (menus, headers, footers, ...) aside, until that container has
headings or paragraphs of its own. A template of its own on some of a host's pages gives a further container. Inside
a container, a block with a class or id that is alike on all of three or more different pages is boilerplate, but for tables, quotes, lists of more than links and
what else an article is made of. Every page is matched
against its host's expression, and what lies in the matched container comes out, block by block: slots, optional and repeated
parts, and constant sentences alike, as a sentence that pages share is part of the text.

Names (classes and ids that say advert, sidebar, comments) are a last resort: where a host has one page, or pages that are
all alike, nothing varies, and the page's own text decides, without what names say is furniture. Inside the
article names never decide, but for lists of reader comments, which vary as articles do and carry no other mark.

All pages take part. A task aligns the pages that it reads, host by host, and hands on wrappers, not pages; wrappers of a
host meet in two rounds (by host and salt, then by host) and are aligned as they stream by, so neither a large host nor a
page that is repeated without end gathers anywhere. No step recurses, so nesting may be of any depth.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import lookup_join, spool
from .url_filter import host_of

#: Tokens of wrappers that a task holds before it hands them on.
HELD = 300_000
#: Tokens of a wrapper inferred in one go from a list of pages (see infer) beyond which optional parts on less than one in RARE of its pages are
#: forgotten. Wrappers of a table's hosts forget nothing, however large they grow.
LARGEST, RARE = 20_000, 50
#: Partial wrappers of a host meet by so many salts first.
SALT = 32
#: Rows of a batch that are worked on at a time.
ROWS = 200

# HTML's element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never text of an article.
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog embed footer form frame frameset head iframe input map menu nav noembed noframes noscript object optgroup option script select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold an article beside other things, when they may hold one at all.
CONTAINERS = frozenset("#page html body div section article main center table tbody tr td form fieldset".split())
#: Elements that an article is made of: what is in them is its text, though every page of the host should have it.
CONTENT = frozenset("p table tr td th ul ol li dl dt dd blockquote pre figure details".split())
#: Opening one of the first closes an open one of the second (HTML's implied end tags).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
#: An implied end does not reach through one of these.
FENCES = frozenset("table ul ol dl div article section aside nav main body td th header footer form menu select".split())
#: Words in class, id or role that name page furniture, and whole names of lists of reader comments.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup privacy promo promoted promotion recommend recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
COMMENT_LISTS = frozenset("comments comment-list commentlist comments-area comments-section disqus_thread reader-comments respond".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag, or to a quote that nothing closes.
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TEXT = "#"


def name_of(tag: str, attributes: str) -> str:
    """An element's name in a stream: the tag, then class, id and role; runs of digits are one ``0``."""
    if not attributes:
        return tag
    found = {k.lower(): " ".join((a or b or c).split()) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    return tag + "".join(f" {k}={re.sub('[0-9]+', '0', found[k])}" for k in sorted(found) if found[k]) if found else tag


def tag_of(name: str) -> str:
    return name.partition(" ")[0]


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, attributes) of the tags and comments of a page, in order; comments and declarations have no name. The consumer may send a
    place from which to go on.

    A tag ends at the first ``>`` outside quotes; if a quote is never closed, quotes don't count up to there. Without a further ``>`` the rest is text. No part of
    the page is looked at more than a few times, whatever is in it.
    """
    at, blind, close = 0, 0, -1  # up to ``blind``, quotes don't count; ``close`` is the next ``>``
    while (begin := source.find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = (yield begin, end + 3 if end >= 0 else len(source), "", "", "") or (end + 3 if end >= 0 else len(source))
            continue
        if close < begin and (close := source.find(">", begin)) < 0:
            return
        end = close
        m = NAME.match(source, begin)
        if not m:
            at = begin + 1
            if source[at] in "!?":
                at = (yield begin, end + 1, "", "", "") or end + 1
            continue
        if begin >= blind and ('"' in (inside := source[m.end() : end]) or "'" in inside):
            quoted = QUOTED.match(source, m.end()).end()
            if quoted < len(source) and source[quoted] == ">":
                end = quoted
            else:
                blind = quoted + 1
        at = (yield begin, end + 1, m[1], m[2].lower(), source[m.end() : end]) or end + 1


class Page:
    """A page's token stream: name, end (the token after an element's last) and text of each token, in page order; texts
    are named ``#``. Token 0 is the page."""

    __slots__ = ("names", "ends", "texts", "summaries")

    def __init__(self) -> None:
        self.names, self.ends, self.texts, self.summaries = ["#page"], [0], [""], None

    def summary(self, at: int) -> int:
        """The bits of the names inside an element; passed over are furniture's insides."""
        if self.summaries is None:
            self.summaries = self._summed()
        return self.summaries[at]

    def _summed(self) -> list[int]:
        found, parent, open_ = [0] * len(self.names), [-1] * len(self.names), []
        for i in range(len(self.names)):
            while open_ and self.ends[open_[-1]] <= i:
                open_.pop()
            parent[i] = open_[-1] if open_ else -1
            if self.ends[i] > i + 1:
                open_.append(i)
        for i in range(len(self.names) - 1, 0, -1):
            up = parent[i]
            tag = tag_of(self.names[up])
            if tag in RAW or (tag in FURNITURE and tag != "form"):
                continue
            found[up] |= found[i] | _bit(self.names[i])
        return found

    def add(self, name: str, text: str = "") -> int:
        self.names.append(name)
        self.ends.append(len(self.names))
        self.texts.append(text)
        return len(self.names) - 1


def parse(source: str) -> Page:
    """The token stream of a page. Unclosed and stray tags are borne as browsers bear them: an end tag closes up to
    its start or is ignored, some starts imply ends, and a paragraph ends where a block starts."""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements
    places: dict[str, list[int]] = {}  # their places in the stack by tag
    blocks, fences = [-1], [-1]  # places of blocks and of fences

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, token = stack.pop()
            page.ends[token] = len(page.names)
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            if tag in FENCES:
                fences.pop()

    at, found, go_on = 0, tags(source), None
    while True:
        try:
            begin, end, slash, tag, attributes = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if begin > at:
            page.add(TEXT, source[at:begin])
        at = end
        if not tag:
            continue
        if slash:
            open_at = places.get(tag)
            if open_at and (tag in BLOCKS or open_at[-1] > blocks[-1]):
                close(open_at[-1])
            continue
        if tag in BLOCKS and places.get("p") and places["p"][-1] == blocks[-1]:
            close(blocks[-1])
        if tag in CLOSES:
            ended = [p[k] for t in CLOSES[tag] if (p := places.get(t)) and (k := bisect_left(p, fences[-1] + (t not in FENCES))) < len(p)]
            if tag in ("td", "th", "tr", "tbody", "tfoot"):  # cells are fences themselves
                table = max((p[-1] for t in ("table",) if (p := places.get(t))), default=-1)
                ended = [p[k] for t in CLOSES[tag] if (p := places.get(t)) and (k := bisect_right(p, table)) < len(p)]
            if ended:
                close(min(ended))
        token = page.add(name_of(tag, attributes))
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            after = source.find(">", over.end()) if over else -1
            page.add(TEXT, source[at : over.start() if after >= 0 else len(source)])
            page.ends[token] = len(page.names)
            at = go_on = after + 1 if after >= 0 else len(source)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            if tag in FENCES:
                fences.append(len(stack))
            stack.append((tag, token))
    if at < len(source):
        page.add(TEXT, source[at:])
    close(1)
    page.ends[0] = len(page.names)
    return page


# A wrapper's stream is a list of tokens [name, size, quantifier, pages, hash, characters]: size counts the tokens of an element, itself included; hash is
# that of a constant text, None for a slot; characters are those of a text on all pages.


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def fold(page: Page) -> list[list]:
    """A page's stream as a wrapper of that page alone. Like neighbours, and like series of two or three, become repeated
    groups as they come, so its size follows what is distinct in the page; inside furniture nothing is looked at."""
    out: list[list] = []
    open_: list[tuple[int, int, list[int]]] = []  # end in the page, place in out, places of the children
    held: dict[int, int] = {}  # summaries by place

    def settle() -> None:
        """The last child of the innermost open element is complete: fold it into its like."""
        kids = open_[-1][2] if open_ else None
        if not kids:
            return
        name = out[kids[-1]][0]
        if name == TEXT and (len(kids) < 2 or out[kids[-2]][0] != TEXT):
            return
        for span in (1, 2, 3):
            if len(kids) < 2 * span:
                return
            if out[kids[-1 - span]][0] != name or any(out[kids[-k]][0] != out[kids[-k - span]][0] for k in range(2, span + 1)):
                continue
            if any(out[k][0] in CONTAINERS and not _like(held[k], held[kids[m - span]]) for m, k in enumerate(kids[-2 * span : -span])):
                continue
            first, second = kids[-2 * span], kids[-span]
            joined = merge(out[first:second], out[second:], True)
            del out[first:]
            del kids[-2 * span :]
            at, inside = 0, _summaries(joined)
            while at < len(joined):
                token = joined[at]
                kids.append(first + at)
                held[first + at] = inside[at]
                if token[0] != TEXT:
                    token[2] = "*" if token[2] in "?*" else "+"
                at += token[1]
            out.extend(joined)
            return

    names, ends, texts = page.names, page.ends, page.texts
    i, n = 0, len(names)
    while i < n or open_:
        while open_ and open_[-1][0] <= i:
            _, place, kids = open_.pop()
            out[place][1] = len(out) - place
            held[place] = 0
            for k in kids:
                held[place] |= held.get(k, 0) | _bit(out[k][0])
            settle()
        if i >= n:
            continue
        if names[i] == TEXT:
            text = " ".join(texts[i].split())
            if text:
                open_[-1][2].append(len(out))
                out.append([TEXT, 1, "1", 1, _hash(text), len(text)])
                settle()
            i += 1
            continue
        if open_:
            open_[-1][2].append(len(out))
        tag = tag_of(names[i])
        out.append([names[i], 1, "1", 1, None, 0])
        if tag in RAW or (tag in FURNITURE and tag != "form"):
            held[len(out) - 1] = 0
            i = ends[i]
            settle()
        else:
            open_.append((ends[i], len(out) - 1, []))
            i += 1
    return out


def _either(a: str, b: str) -> str:
    """The weakest of two quantifiers: 1, ?, +, *."""
    if a == b:
        return a
    may_miss, may_repeat = {a, b} & {"?", "*"}, {a, b} & {"+", "*"}
    return "*" if may_miss and may_repeat else "?" if may_miss else "+" if may_repeat else "1"


#: Bits of the summaries by which boxes under one bare tag are told apart.
BITS = 251


def _bit(name: str) -> int:
    """A name's bit in a summary; boxes, texts and marks of characters have none."""
    tag = tag_of(name)
    return 1 << zlib.crc32(name.encode()) % BITS if " " in name or tag in ("a", "img") or (tag in BLOCKS and tag not in CONTAINERS) else 0


def _summaries(stream: list[list]) -> list[int]:
    """What lies within each token of a stream: the bits of the names inside."""
    found, parent, open_ = [0] * len(stream), [-1] * len(stream), []
    for i, token in enumerate(stream):
        while open_ and open_[-1] + stream[open_[-1]][1] <= i:
            open_.pop()
        parent[i] = open_[-1] if open_ else -1
        if token[1] > 1:
            open_.append(i)
    for i in range(len(stream) - 1, -1, -1):
        if parent[i] >= 0:
            found[parent[i]] |= found[i] | _bit(stream[i][0])
    return found


def _like(a: int, b: int) -> bool:
    """Whether two elements that have a bare tag in common hold alike things."""
    return a == b or 2 * (a & b).bit_count() > (a | b).bit_count()


def _siblings(stream: list[list], start: int, end: int) -> dict[str, list[tuple[int, int]]]:
    """(ordinal, place) of the siblings in a stretch of a stream, by name."""
    found: dict[str, list[tuple[int, int]]] = {}
    k = 0
    while start < end:
        found.setdefault(stream[start][0], []).append((k, start))
        k, start = k + 1, start + stream[start][1]
    return found


def merge(a: list[list], b: list[list], within: bool = False) -> list[list]:
    """The union-free expression that both streams match. Texts of two pages that differ become a slot; those ``within``
    one page become one constant, which is a slot only if another page has others there."""
    out: list[list] = []
    inside: list[list[int]] = []  # summaries of both streams, once needed
    # Stretches of both streams that are being walked: cursor and end in each, the open token, siblings by name once needed.
    frames = [[0, len(a), 0, len(b), -1, None, None]]

    def optional(stream: list[list], start: int, end: int) -> None:
        while start < end:
            token = stream[start]
            copied = [t[:] for t in stream[start : start + token[1]]]
            copied[0][2] = _either(token[2], "?")
            out.extend(copied)
            start += token[1]

    while frames:
        f = frames[-1]
        i, ie, j, je = f[:4]
        if i >= ie or j >= je:
            optional(a, i, ie)
            optional(b, j, je)
            frames.pop()
            if f[4] >= 0:
                out[f[4]][1] = len(out) - f[4]
            continue
        x, y = a[i], b[j]
        same, name = x[0] == y[0], x[0]
        if same and name in CONTAINERS and not inside:
            inside = [_summaries(a), _summaries(b)]
        if same and name in CONTAINERS and not _like(inside[0][i], inside[1][j]):
            # Boxes of unlike content under one bare tag: an optional one before a like pair, if there is one.
            if f[5] is None:
                f[5], f[6] = _siblings(a, i, ie), _siblings(b, j, je)
            p = next((s for _, s in f[5][name] if s > i and _like(inside[0][s], inside[1][j])), None)
            q = next((s for _, s in f[6][name] if s > j and _like(inside[1][s], inside[0][i])), None)
            if p is not None and (q is None or p - i <= q - j):
                optional(a, i, p)
                f[0] = p
                continue
            if q is not None:
                optional(b, j, q)
                f[2] = q
                continue
        if not same:
            if f[5] is None:
                f[5], f[6] = _siblings(a, i, ie), _siblings(b, j, je)
            ahead_a, ahead_b = f[5].get(y[0], ()), f[6].get(x[0], ())
            p, q = bisect_left(ahead_a, i, key=lambda s: s[1]), bisect_left(ahead_b, j, key=lambda s: s[1])
            in_a, in_b = p < len(ahead_a), q < len(ahead_b)
            if in_a and in_b:  # the shorter way
                in_a = ahead_a[p][1] - i <= ahead_b[q][1] - j
            if in_a:
                optional(a, i, ahead_a[p][1])
                f[0] = ahead_a[p][1]
                continue
            if in_b:
                optional(b, j, ahead_b[q][1])
                f[2] = ahead_b[q][1]
                continue
            if TEXT in (x[0], y[0]) or tag_of(x[0]) != tag_of(y[0]):
                optional(a, i, i + x[1])
                optional(b, j, j + y[1])
                f[0], f[2] = i + x[1], j + y[1]
                continue
            name = tag_of(x[0]) + " *"
        f[0], f[2] = i + x[1], j + y[1]
        n = max(x[3], y[3]) if within else x[3] + y[3]
        if name == TEXT:
            h = x[4] if x[4] == y[4] and not within else None if None in (x[4], y[4]) or not within else _hash(f"{x[4]} {y[4]}")
            out.append([TEXT, 1, _either(x[2], y[2]), n, h, x[5] + y[5]])
        else:
            out.append([name, 1, _either(x[2], y[2]), n, None, 0])
            if x[1] > 1 or y[1] > 1:
                frames.append([i + 1, i + x[1], j + 1, j + y[1], len(out) - 1, None, None])
    return out


def pruned(stream: list[list], pages: int) -> list[list]:
    """A wrapper's stream without optional parts on few pages, if it is very large."""
    if len(stream) <= LARGEST or pages < RARE:
        return stream
    out, open_ = [], []
    i = 0
    while i < len(stream) or open_:
        while open_ and open_[-1][0] <= i:
            place = open_.pop()[1]
            out[place][1] = len(out) - place
        if i >= len(stream):
            continue
        token = stream[i]
        if token[2] in "?*" and token[3] * RARE < pages:
            i += token[1]
            continue
        out.append(token[:])
        if token[1] > 1:
            open_.append((i + token[1], len(out) - 1))
        i += 1
    return out


class Wrapper:
    """A host's expression, the number of pages it stands for, and hashes of up to four different ones."""

    __slots__ = ("stream", "pages", "seen")

    def __init__(self, stream: list[list], pages: int, seen: list[int]):
        self.stream, self.pages, self.seen = stream, pages, seen

    @classmethod
    def of_page(cls, source: str) -> Wrapper:
        return cls(fold(parse(source)), 1, [_hash(source)])

    def join(self, other: Wrapper) -> Wrapper:
        return Wrapper(merge(self.stream, other.stream), self.pages + other.pages, sorted({*self.seen, *other.seen})[:4])

    def packed(self) -> bytes:
        return zlib.compress(json.dumps([self.stream, self.pages, self.seen], separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Wrapper:
        return cls(*json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass")))


def infer(pages: list[str]) -> Wrapper:
    """A wrapper from a list of pages, for a look at a host: of bounded size, see pruned. extract_pages doesn't use it."""
    wrapper = None
    for source in pages:
        wrapper = Wrapper.of_page(source) if wrapper is None else wrapper.join(Wrapper.of_page(source))
        wrapper.stream = pruned(wrapper.stream, wrapper.pages)
    return wrapper or Wrapper([["#page", 1, "1", 0, None, 0]], 0, [])


def expression(wrapper: Wrapper) -> str:
    """A wrapper as text: tags with their quantifiers, constant texts as ``'``, slots as ``_``."""
    out, open_, i = [], [], 0
    stream = wrapper.stream
    while i < len(stream) or open_:
        if open_ and open_[-1][0] <= i:
            _, token = open_.pop()
            out.append(f"</{tag_of(token[0])}>{token[2].replace('1', '')}")
            continue
        token = stream[i]
        if token[0] == TEXT:
            out.append(("_" if token[4] is None else "'") + token[2].replace("1", ""))
        else:
            out.append(f"<{token[0]}>")
            open_.append((i + token[1], token))
        i += 1
    return "".join(out)


def _words(name: str) -> set[str]:
    """The lower-case words of a name's attributes."""
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name.partition(" ")[2]).lower())) if " " in name else set()


def _weights(w: Wrapper) -> tuple[list[int], list[float], bool]:
    """Parents of a wrapper's tokens, the text that each holds outside links and furniture, and whether that is text that varies."""
    s = w.stream
    parent, quiet, open_ = [-1] * len(s), [False] * len(s), []
    for i, token in enumerate(s):
        while open_ and open_[-1] + s[open_[-1]][1] <= i:
            open_.pop()
        parent[i] = open_[-1] if open_ else -1
        tag = tag_of(token[0])
        quiet[i] = (parent[i] >= 0 and quiet[parent[i]]) or tag == "a" or (tag in FURNITURE and tag != "form") or tag == "header"
        open_.append(i)

    def summed(keep) -> list[float]:
        mass = [float(t[5]) if t[0] == TEXT and not q and keep(t) else 0.0 for t, q in zip(s, quiet)]
        for i in range(len(s) - 1, 0, -1):
            mass[parent[i]] += mass[i]
        return mass

    everything = summed(lambda t: True)
    if len(w.seen) > 1:
        varying = summed(lambda t: t[4] is None)
        # Two pages that differ in a date are no evidence of what varies.
        if varying[0] > 0 and varying[0] >= (0.1 if len(w.seen) == 2 else 0.02) * everything[0]:
            return parent, varying, True
    # Nothing to compare with: names are the last resort, unless what they call furniture holds most of the page.
    for i, t in enumerate(s):
        q = i > 0 and quiet[parent[i]]
        named = tag_of(t[0]) in CONTAINERS | {"ul", "ol"} and bool(FURNITURE_WORDS & _words(t[0])) and everything[i] < 0.5 * everything[0]
        quiet[i] = quiet[i] or q or named
    return parent, summed(lambda t: True), False


def _single(s: list[list], parent: list[int], mass: list[float], several: bool) -> int | None:
    """The one element that a host's pages mark up as their article, outside furniture, if it stands once on a page and has text."""
    open_, best = [True] * len(s), None
    for i, token in enumerate(s):
        tag = tag_of(token[0])
        open_[i] = (i == 0 or open_[parent[i]]) and token[2] in "1?" and (tag not in FURNITURE or tag == "form") and tag != "header"
        if tag == "article" and open_[i] and (mass[i] > 0 or not several) and (best is None or mass[i] > mass[best]):
            best = i
    return best


def _follow(s: list[list], parent: list[int], mass: list[float], several: bool) -> list[int]:
    """The places of the container of most text, and of headings that stand before it, in page order."""
    heads: list[int] = []
    node = _single(s, parent, mass, several)
    if node is not None:
        return [node]
    node = 0
    while True:
        kids, i = [], node + 1
        while i < node + s[node][1]:
            kids.append(i)
            i += s[i][1]
        holds = lambda i: tag_of(s[i][0]) in CONTAINERS or "-" in tag_of(s[i][0])
        inner = [i for i in kids if holds(i) and mass[i] > 0]
        if not inner:
            break
        best = max(inner, key=lambda i: (mass[i], -i))
        own = sum(mass[i] for i in kids if not holds(i) and tag_of(s[i][0]) not in HEADINGS)
        if tag_of(s[best][0]) == "article" and mass[best] >= 0.5 * mass[node]:
            node = best
            break
        if mass[best] < 0.5 * mass[node] or own >= 0.25 * mass[node] or (s[best][2] in "+*" and tag_of(s[best][0]) != "article"):
            break
        heads += [i for i in kids if i < best and tag_of(s[i][0]) in HEADINGS and mass[i] > 0]
        node = best
    return [*heads, node]


def _links(stream: list[list]) -> bool:
    """Whether all text of an element lies in links."""
    i = 0
    while i < len(stream):
        if stream[i][0] == TEXT:
            return False
        i += stream[i][1] if tag_of(stream[i][0]) == "a" else 1
    return True


def plan_of(w: Wrapper) -> dict:
    """What extraction needs of a wrapper: its stream of [name, size, mark, quantifier, summary], cut to what leads
    to marks. A mark is a number for the article's container, from 1 for that of most pages, ``x`` for boilerplate in it, else empty."""
    s, n = w.stream, max(1, w.pages)
    parent, mass, several = _weights(w)
    marks: list[int | str] = [""] * len(s)
    left, rank, first = n, 0, 0.0
    while mass[0] > 0 or not rank:
        picked = _follow(s, parent, mass, several)
        node = picked[-1]
        each = mass[node] / max(1, min(n, s[node][3]))
        # A further container is that of another template: it stands where the ones before are not.
        if rank and (s[node][3] > left * 1.05 or each < 0.25 * first or node == 0):
            break
        rank += 1
        first = max(first, each)
        for i in picked:
            marks[i] = marks[i] or rank
        if several and len(w.seen) >= 3:
            i, end = node + 1, node + s[node][1]
            while i < end:
                name, size, _, pages, *_ = s[i]
                inside = s[i : i + size]
                if tag_of(name) in CONTENT and not (tag_of(name) in ("ul", "ol") and _links(inside)):
                    i += size
                    continue
                block = tag_of(name) in BLOCKS and tag_of(name) not in HEADINGS and " " in name
                if block and pages * 2 >= n and pages > 2 and any(t[0] == TEXT for t in inside) and all(t[4] is not None for t in inside if t[0] == TEXT):
                    marks[i] = "x"
                    i += size
                else:
                    i += 1
        if node == 0:
            break
        left -= s[node][3]
        gone, up = mass[node], node
        while up >= 0:
            mass[up] -= gone
            up = parent[up]
        for i in range(node + 1, node + s[node][1]):
            mass[i] = 0.0
        if left <= 0 or not several:
            break
    needed = [bool(m) for m in marks]
    for i in range(len(s) - 1, 0, -1):
        if needed[i]:
            needed[parent[i]] = True
    inside = _summaries(s)
    out, open_, i = [], [], 0
    while i < len(s) or open_:
        while open_ and open_[-1][0] <= i:
            place = open_.pop()[1]
            out[place][1] = len(out) - place
        if i >= len(s):
            continue
        if s[i][0] == TEXT:
            i += 1
            continue
        out.append([s[i][0], 1, marks[i], s[i][2], inside[i]])
        deeper = needed[i] and any(needed[k] for k in range(i + 1, min(i + s[i][1], len(s))))
        if deeper and s[i][1] > 1:
            open_.append((i + s[i][1], len(out) - 1))
            i += 1
        else:
            i += s[i][1]
    return {"tokens": out, "pages": w.pages}


class Matcher:
    """Matches pages against a plan."""

    def __init__(self, plan: dict):
        self.tokens = plan["tokens"]
        self.kids: list[dict[str, list[int]] | None] = [None] * len(self.tokens)
        for i, (_, size, *_) in enumerate(self.tokens):
            if size > 1:
                own: dict[str, list[int]] = {}
                k = i + 1
                while k < i + size:
                    own.setdefault(self.tokens[k][0], []).append(k)
                    k += self.tokens[k][1]
                self.kids[i] = own

    def marks(self, page: Page) -> dict[int, int | str]:
        """Marks of the page's tokens that the expression gives one. Both streams are walked in parallel; what the expression
        lacks is passed over, and a part that comes out of turn goes back to its place."""
        found: dict[int, int | str] = {}
        names, ends = page.names, page.ends
        frames = [[len(names), self.kids[0] if self.kids and self.kids[0] else {}, 0]]
        if self.tokens and self.tokens[0][2]:
            found[0] = self.tokens[0][2]
        i = 1
        while i < len(names):
            while frames[-1][0] <= i:
                frames.pop()
            frame = frames[-1]
            if names[i] == TEXT:
                i += 1
                continue
            places = frame[1].get(names[i]) or frame[1].get(tag_of(names[i]) + " *")
            if not places:
                i = ends[i]
                continue
            k = bisect_left(places, frame[2])
            ahead = places[k:] or places[-1:]
            at = ahead[0]
            if names[i] in CONTAINERS and len(ahead) > 1:
                summary = page.summary(i)
                at = next((x for x in ahead if _like(summary, self.tokens[x][4])), at)
            frame[2] = max(frame[2], at + (self.tokens[at][3] in "1?"))
            if self.tokens[at][2]:
                found[i] = self.tokens[at][2]
            if self.kids[at] is None:
                i = ends[i]
            else:
                frames.append([ends[i], self.kids[at], at])
                i += 1
        return found


def _comments(name: str) -> bool:
    return " " in name and tag_of(name) in ("div", "section", "ol", "ul", "aside") and bool(COMMENT_LISTS & set(re.split(r"[ =]", name.lower())))


def extract(source: str, plan: dict | Matcher | None = None) -> str:
    """The article's blocks, each on a line. A page without its host's containers goes by its own stream alone."""
    page = parse(source)
    marks: dict[int, int | str] = {}
    if plan:
        marks = (plan if isinstance(plan, Matcher) else Matcher(plan)).marks(page)
    if not any(m != "x" for m in marks.values()):
        marks = Matcher(plan_of(Wrapper(fold(page), 1, [0]))).marks(page)
    rank = min((m for m in marks.values() if m != "x"), default=0)
    names, ends, texts = page.names, page.ends, page.texts
    tops = sorted(i for i, m in marks.items() if m == rank) or [0]
    blocks: list[list[str]] = [[]]
    past = 0
    for top in tops:
        if top < past:
            continue
        whole = tag_of(names[top]) in ("#page", "html", "body")
        past, i, open_ = ends[top], top, []
        blocks.append([])
        while i < past or open_:
            if open_ and open_[-1] <= i:
                open_.pop()
                blocks.append([])
                continue
            name = names[i]
            tag = tag_of(name)
            if name == TEXT:
                blocks[-1].append(texts[i])
            elif tag in ("br", "wbr"):
                blocks[-1].append(" " if tag == "br" else "")
            elif i != top and (tag in FURNITURE or tag in RAW or marks.get(i) == "x" or (whole and tag == "header") or _comments(name)) and not _wraps(page, i, past - top, tag):
                i = ends[i]
                continue
            elif tag in BLOCKS:
                blocks.append([])
                open_.append(ends[i])
            i += 1
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _wraps(page: Page, i: int, size: int, tag: str) -> bool:
    """A form around most of the page is no form of it."""
    return tag == "form" and 2 * (page.ends[i] - i) > size and any(x == "p" or x == "article" for x in map(tag_of, page.names[i : page.ends[i]]))


SHAPES = "host string, wrapper binary"


def _batch(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())], ["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, plan): the plan of each host of two or more pages as JSON, from all its pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    had, new = held.get(host), Wrapper.of_page(source)
                    held[host] = new if had is None else had.join(new)
                    size += len(held[host].stream) - (len(had.stream) if had is not None else 0)
                    if size > HELD:
                        yield _batch([(h, w.packed()) for h, w in held.items()])
                        held, size = {}, 0
        if held:
            yield _batch([(h, w.packed()) for h, w in held.items()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, now = None, None
        for b in batches:
            for h, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now is not None and h == host:
                    now = now.join(Wrapper.unpacked(data))
                    continue
                if now is not None:
                    yield _batch([(host, now.packed())])
                host, now = h, Wrapper.unpacked(data)
        if now is not None:
            yield _batch([(host, now.packed())])

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            (host,), (data,) = b.column(0).to_pylist(), b.column(1).to_pylist()
            wrapper = Wrapper.unpacked(data)
            if wrapper.pages > 1:
                plan = json.dumps(plan_of(wrapper), separators=(",", ":"))
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([plan])], ["host", "plan"])

    read_pages = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(read, SHAPES)
    partial = spool(read_pages.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALT))), "shapes")
    salted = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(joined, SHAPES)
    return salted.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(planned, "host string, plan string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Null html counts as empty and has empty text; a page without host belongs to the host ``''``. Repeated rows
    have a result each, and a host whose pages are all alike goes by that page. Nesting may be of any depth and pages of any
    length. Character references are decoded, white space inside a block becomes one space, blocks are joined
    by one line feed in page order. Other columns are ignored; an empty table gives an empty result. Order of
    alignment follows the input's partitions, so a host of unlike pages may get another wrapper if they are dealt otherwise.
    """
    plans = spool(wrappers(pages), "wrappers")
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # Plans go to tasks once, by host, while they are few and small; beyond, they are joined.
    n, size = plans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("plan") + F.octet_length("host")), F.lit(0))).first()
    told = pages.sparkSession.sparkContext.broadcast(dict(map(tuple, plans.select("host", "plan").collect()))) if n <= common.BROADCAST_ROWS and size <= common.BROADCAST_BYTES else None
    joined = hosted.select("page_id", "url", "html", "host") if told else lookup_join(hosted, plans, "host").select("page_id", "url", "html", "plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Matcher | None] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = []
                for source, key in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if key not in known:
                        plan = told.value.get(key) if told else key
                        known = known if len(known) < 1000 else {}
                        known[key] = Matcher(json.loads(plan)) if plan is not None else None
                    texts.append(extract(source or "", known[key]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
