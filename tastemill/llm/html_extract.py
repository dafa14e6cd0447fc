"""HTML extraction by equivalence classes: tokens that occur alike on all pages of a host are its template.

A page is a sequence of tokens: its block elements, each named by the path of
tags and class names above it, and its blocks of text. The occurrence vector of a
token says how often it stands on each page of its host. It is kept as two sums of
hashes of (page, count), so vectors meet by partial aggregation and no host, however
large, is gathered anywhere. Of pages of a host that are copies (the same blocks
outside menus and the like) one counts.

1. *Classes.* Tokens on at least ``SUPPORT`` of the host's pages with equal vectors
   are a class, if one of them is an element.
2. *Validity.* A class is valid if its tokens come in one order, as often as it
   stands on a page, on every page (else it is dropped whole). A token of it nests if
   it always lies in the same slot: between the same two tokens of the class that
   holds the next element around it. Tokens that do not nest leave the class.
3. *Template.* Valid classes nest in each other's slots; that tree is the template.
   Its slots are told by the element they lie in. Each has a verdict, from its
   elements, the tokens inside and their counts over all pages:
   * excluded: under a menu, header, footer, sidebar, notice, advert, form, script,
     style or comment section (by tag, role, class or id);
   * constant: all text inside belongs to the template (a headline is excepted);
   * list: a list whose text, over all pages, is mostly links;
   * repeated: most of its own text stands on other pages of the host too (adverts and
     teasers come from a pool), or linked: nearly all of it lies in links. Whatever
     its names, such a slot gives way where an open slot that varies holds at least as
     much text over the host;
   * article: inside an element that declares it (article, main, usual names);
   * open: anything else.
4. *Extraction.* A page's text is what lies in its article slots or, if it has none,
   in its open ones without the text tokens of the template, as long as they are the
   smaller part of their slot. (Were they the larger part, the pages would be near
   copies, which say nothing of the template.) What a page has beyond the template
   belongs to the slot around it, unless it is excluded by itself. A page none of
   whose elements is in its host's template, and that of a host of one page, is read
   by the template of that page alone, deduced in the same way; there no text is
   constant. A page of nothing but constant slots gives these.

Within article slots constant text stays where other text varies: it may be the
article's own. So markup decides which slots may be the article, and the template
which of them are read; names alone would take constant ones too.

A template is no larger than 1 / ``SUPPORT`` mean pages. Templates go to the pages by
a join; it is broadcast only if all together are small, and else hosts with more
than a thousandth of the pages, fewer than a thousand, are.

Blocks: text between block-level tags, references decoded, white space runs (and
line breaks) to one space, joined by a blank line; nothing else is dropped.

Defined results
* null or empty html, or no text: empty text, 0 characters;
* null url: such pages form a host of their own;
* markup of any depth is read in linear time and memory; very long pages as a whole;
* repeated rows give repeated results, and count as one; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column, cut, join_hot, table
from .url_filter import split_urls

#: Share of a host's pages from which on a token may belong to its template.
SUPPORT = 0.2
#: Share of a list's characters inside links from which on it is a list of links.
LINKS = 0.6
#: Share of a slot's own characters that stand on other pages too, and share of its characters inside links, from which on it may give way to a slot that varies.
REPEATED, LINKED = 0.75, 0.8
#: Bytes of all templates together up to which they are broadcast.
SMALL = 16 << 20
#: Templates that a Python worker keeps unpacked.
KEPT = 500

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements that hold no text to read; their end is looked for as it is. Without an end the first ones swallow the rest of the page, as in HTML; the others are passed over alone.
SWALLOWS = ("script", "style", "textarea", "title", "iframe")
RAW = frozenset((*SWALLOWS, "template", "svg", "select", "canvas", "button", "audio", "video"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
OUTSIDE = frozenset("nav footer aside form head dialog menu fieldset".split())
LISTS = frozenset("ul ol menu dl".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_END = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words that name what is no article, and words that say nothing of it: a class or id is bad if it has one of the first and no other words.
BAD = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar side aside ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social comment comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright disclaimer login signup search".split()
)
NEUTRAL = frozenset("site global top bottom left right primary secondary main box bar area wrap wrapper container list item items links link button buttons icons form text inner outer posts widgets".split())
#: What articles that are not the page's own stand in, or are.
OTHERS = re.compile(r"comment|disqus|repl(?:y|ies)|respond|related|recommended", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body)(?:$|[\s_-])", re.I)


def bad_name(names: str, heads: bool) -> bool:
    """Whether a class or id, as a whole, names a menu or the like; ``heads``: whether headers count."""
    for name in names.lower().split():
        words = {w for w in re.split(r"[0-9_-]+", name) if w}
        if words & BAD and words <= BAD | NEUTRAL and (heads or not words & {"header", "masthead"}):
            return True
    return False


#: Sorts of elements: plain, declares the article, holds none of it; by name only: declares one of another kind, holds none unless the page declares no other.
PLAIN, DECLARES, OUT, DECLARES_OTHER, HOLDS_NONE = range(5)
#: States of elements, as sums, by the sorts of all elements around and themselves.
DEAD, WEAK, DECLARED, CONSTANT, LISTED, COMMON = 1, 2, 4, 8, 16, 32
#: States of an element's own text, which elements inside do not take over.
OWN = CONSTANT | COMMON
#: What an element is, beyond its sort.
IS_LIST, IS_HEAD = 1, 2


def step(state: int, sort: int) -> int:
    """The state inside an element of that sort, from the state around it."""
    if sort == OUT:
        return state | DEAD
    if sort == HOLDS_NONE:
        return state | (DEAD if state & DECLARED else WEAK)
    if sort == DECLARES_OTHER:
        return state | WEAK | DECLARED
    return state | DECLARED if sort == DECLARES else state


def level(state: int) -> int:
    """How good a slot is: 4 article, 3 one of another kind, 2 open, 1 constant or a list, 0 excluded."""
    if state & DEAD or state & (WEAK | DECLARED) == WEAK:
        return 0
    if state & CONSTANT or (state & (LISTED | COMMON) and not state & DECLARED):
        return 1
    return 2 if not state & DECLARED else 3 if state & WEAK else 4


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Block elements in order, each after the one around it, and blocks of text."""

    def __init__(self):
        self.keys: list[int] = []
        self.above: list[int] = []  # place of the element around; -1: none
        self.sorts: list[int] = []
        self.states: list[int] = []
        self.kinds: list[int] = []
        self.blocks: list[tuple[str, int, int]] = []  # text, element, characters in links
        self.order: list[int] = []  # places of elements, and ~places of blocks


class Reader:
    """Reads pages. Keys of paths are kept, so each different path is hashed once."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}

    def key(self, above: int, name: str) -> int:
        found = self.known.get((above, name))
        if found is None:
            found = digest(f"{above}/{name}")
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[above, name] = found
        return found

    def read(self, html: str) -> Page:
        page = Page()
        stack: list[tuple[str, int]] = []  # open tags, each with the block element it is or lies in
        held: dict[str, int] = {}  # how many of each are open
        text: list[str] = []
        lost: set[str] = set()  # raw elements that have no end from here on
        linked = 0

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join("".join(text).split())
                if whole:
                    page.order.append(~len(page.blocks))
                    page.blocks.append((whole, stack[-1][1] if stack else -1, linked))
                text.clear()
            linked = 0

        def close(at: int) -> None:
            for tag, _ in stack[at:]:
                held[tag] -= 1
            del stack[at:]

        place, end = 0, len(html)
        while place < end:
            m = TOKEN.search(html, place)
            piece = html[place : m.start() if m else end]
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if held.get("a"):
                    linked += len(piece.strip())
            if m is None:
                break
            place = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if m[1]:
                if held.get(tag):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            close(i)
                            break
                        if tag in INLINE and stack[i][0] not in INLINE:
                            break
                continue
            if tag in RAW and not m[0].endswith("/>"):
                if tag in lost:
                    continue
                out = re.compile(rf"</{tag}\s*>", re.I).search(html, place)
                if out:
                    place = out.end()
                elif tag in SWALLOWS:
                    place = end
                else:
                    lost.add(tag)
                continue
            if tag in VOID:
                continue
            if tag in ENDS_P:
                if held.get("p"):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            close(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            elif tag in SELF_END:
                alike = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
                if any(held.get(x) for x in alike):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in alike:
                            close(i)
                            break
                        if stack[i][0] in SELF_END[tag]:
                            break
            inside = stack[-1][1] if stack else -1
            held[tag] = held.get(tag, 0) + 1
            if tag in INLINE:
                stack.append((tag, inside))
                continue
            around = page.states[inside] if inside >= 0 else 0
            sort, names = sort_of(tag, m[3], around)
            above = page.keys[inside] if inside >= 0 else 0
            page.order.append(len(page.keys))
            stack.append((tag, len(page.keys)))
            page.keys.append(self.key(above, f"{tag} {sort} {names}"))
            page.above.append(inside)
            page.sorts.append(sort)
            page.states.append(step(around, sort))
            page.kinds.append(IS_LIST if tag in LISTS else IS_HEAD if tag in HEADS else 0)
        flush()
        return page


HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def sort_of(tag: str, attributes: str | None, around: int) -> tuple[int, str]:
    """The sort of an element, and the class names that its key has (an id belongs to one page too often; it only sorts)."""
    classes = ids = role = ""
    if attributes:
        for a in ATTRIBUTE.finditer(attributes):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name == "class":
                classes = value
            elif name == "id":
                ids = value
            elif name == "role":
                role = value.lower()
    names = f"{classes} {ids}".strip()
    declared = tag in ("article", "main") or role in ("main", "article")
    kept = re.sub(r"[0-9]+", "0", classes)
    if tag in OUTSIDE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "form", "alert"):
        return OUT, kept
    if tag == "header":  # of the page, unless the article is open already
        return (PLAIN if around & DECLARED else OUT), kept
    if names and tag not in ("html", "body") and bad_name(names, not around & DECLARED):
        return (OUT if OTHERS.search(names) and tag != "main" else DECLARES_OTHER if declared else HOLDS_NONE), kept
    if declared or (names and tag in ("div", "section") and GOOD.search(names)):
        return DECLARES, kept
    return PLAIN, kept


def text_key(above: int, text: str) -> int:
    return digest(f"{above}|{text}")


def best(blocks: list, levels: list[int], least: int = 1) -> list:
    """The blocks of the best level that the page has."""
    top = max(levels, default=0)
    return [b for b, x in zip(blocks, levels, strict=True) if x == top] if top >= least else []


def clean(page: Page) -> list[str]:
    """The texts in the article of a page by its own markup."""
    return [b[0] for b in best(page.blocks, [level(page.states[e]) if e >= 0 else 2 for _, e, _ in page.blocks])]


#: A token of a page: key of the element around, is it text, sort, kind, count, its own characters, those of all inside, those in links.
def tokens_of(page: Page) -> dict[int, list]:
    own, whole, linked = [0] * len(page.keys), [0] * len(page.keys), [0] * len(page.keys)
    out: dict[int, list] = {}
    for text, e, links in page.blocks:
        above = page.keys[e] if e >= 0 else 0
        if e >= 0:
            own[e] += len(text)
            whole[e] += len(text)
            linked[e] += links
        mine = out.setdefault(text_key(above, text), [above, 1, 0, 0, 0, 0, 0, 0])
        mine[4] += 1
        mine[5] += len(text)
    for i in range(len(page.keys) - 1, -1, -1):  # what lies inside comes later, so this is one pass at any depth
        up = page.above[i]
        if up >= 0:
            whole[up] += whole[i]
            linked[up] += linked[i]
        mine = out.setdefault(page.keys[i], [page.keys[up] if up >= 0 else 0, 0, page.sorts[i], page.kinds[i], 0, 0, 0, 0])
        mine[4] += 1
        mine[5] += own[i]
        mine[6] += whole[i]
        mine[7] += linked[i]
    return out


def walk(page: Page) -> Iterator[tuple[int, int]]:
    """(key, place of the element around) of all tokens in the order of the page."""
    for at in page.order:
        if at >= 0:
            yield page.keys[at], page.above[at]
        else:
            text, e, _ = page.blocks[~at]
            yield text_key(page.keys[e] if e >= 0 else 0, text), e


STATS = "host string, key long, above long, is_text int, sort int, kind int, mark1 long, mark2 long, pages double, own long, whole long, linked long"
NAMES = [x.split()[0] for x in STATS.split(", ")]


def row_key() -> Column:
    return F.xxhash64("host", "page_id", "html")


def copies(pages: DataFrame) -> DataFrame:
    """id, host, digest of every page: rows of a host with the same digest are copies, told by the blocks of text outside menus and the like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in chunks(batches, "html"):
            digests = [digest("\0".join(clean(reader.read(html or "")))) for html in column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(digests, pa.int64())], names=["id", "host", "digest"])

    return pages.select(row_key().alias("id"), "host", "html").mapInArrow(run, "id long, host string, digest long")


def marks(page: str, count: int) -> tuple[int, int]:
    """Two hashes of 31 bits of an entry of an occurrence vector; sums of them tell vectors apart, and add up in any order."""
    both = digest(f"{page}|{count}")
    return both & 0x7FFFFFFF, (both >> 32) & 0x7FFFFFFF


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: the sums that stand for its vector, the pages it stands on (by ``weight``), characters. Summed per batch before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in chunks(batches, "html"):
            held: dict[tuple[str, int], list] = {}
            for host, page, html, weight in zip(*(column(batch, x) for x in ("host", "page_id", "html", "weight")), strict=True):
                name, seen = f"{page}|{digest(html or '')}", {}
                for key, (above, is_text, sort, kind, count, *chars) in tokens_of(reader.read(html or "")).items():
                    if count not in seen:
                        seen[count] = marks(name, count)
                    mine = held.setdefault((host, key), [above, is_text, sort, kind, 0, 0, 0.0, 0, 0, 0])
                    for i, x in enumerate((*seen[count], weight, *chars), 4):
                        mine[i] += x
            rows = [(h, k, *v) for (h, k), v in held.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)

    read = pages.select("host", "page_id", "html", "weight").mapInArrow(run, STATS)
    same = [F.min(x).alias(x) for x in ("above", "is_text", "sort", "kind")]
    return read.groupBy("host", "key").agg(*same, F.round(F.sum("pages"), 3).alias("pages"), *(F.sum(x).alias(x) for x in ("mark1", "mark2", "own", "whole", "linked")))


TOKEN_FIELDS = ("key", "above", "is_text", "sort", "kind", "mark1", "mark2", "pages", "own", "whole", "linked", "again")


def classes_of(tokens: list[dict]) -> dict[int, tuple[int, int]]:
    """Class of each token that is in one: those of equal vectors, if there is an element among them. Text needs two pages to be told from data."""
    anchored = {(t["mark1"], t["mark2"]) for t in tokens if not t["is_text"]}
    return {t["key"]: (t["mark1"], t["mark2"]) for t in tokens if (t["mark1"], t["mark2"]) in anchored and (not t["is_text"] or t["pages"] > 1.5)}


def arrangement(page: Page, classes: dict[int, tuple[int, int]]) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """How a page arranges classes: the order of each one's tokens (0: not the same each time), and the slot of each token (0: several)."""
    runs: dict[tuple[int, int], list[int]] = {}
    slots: dict[int, int] = {}
    holder: list[tuple[tuple[int, int] | None, int]] = []  # by element: the class it is of, and the place of the next element around of another class
    last: dict[tuple[int, int], int] = {}
    at = 0
    for key, up in walk(page):
        mine = classes.get(key)
        around = up
        if mine is not None:
            while around >= 0 and holder[around][0] in (None, mine):
                around = holder[around][1]
            outer = holder[around][0] if around >= 0 else None
            slot = digest(f"{outer}|{last[outer]}") if outer is not None else 1
            slots[key] = slot if slots.get(key, slot) == slot else 0
            runs.setdefault(mine, []).append(key)
            last[mine] = key
        if at < len(page.keys) and page.keys[at] == key and page.above[at] == up:  # an element; text has other keys
            holder.append((mine, up if mine is None else around))
            at += 1
    orders = {}
    for mine, run in runs.items():
        size = len(set(run))
        orders[mine] = digest(str(run[:size])) if len(run) % size == 0 and len(set(run[:size])) == size and run == run[:size] * (len(run) // size) else 0
    return orders, slots


ARRANGED = "host string, id1 long, id2 long, lo long, hi long"


def arranged(pages: DataFrame) -> DataFrame:
    """host, id1, id2, lo, hi: smallest and largest arrangement over all pages of each class (id1, id2) and token (key, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(), {}
        for batch in chunks(batches, "html"):
            held: dict[tuple, list[int]] = {}
            for at, (host, html) in enumerate(zip(column(batch, "host"), column(batch, "html"), strict=True)):
                if host not in known:
                    if len(known) > KEPT:
                        known.clear()
                    known[host] = classes_of(batch.column("tokens")[at].as_py() or [])
                if not known[host]:
                    continue
                orders, slots = arrangement(reader.read(html or ""), known[host])
                for (a, b), x in [*orders.items(), *(((key, None), x) for key, x in slots.items())]:
                    mine = held.setdefault((host, a, b), [x, x])
                    mine[0], mine[1] = min(mine[0], x), max(mine[1], x)
            rows = [(*k, *v) for k, v in held.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ARRANGED.split(", ")])

    read = pages.select("host", "html", "tokens").mapInArrow(run, ARRANGED)
    return read.groupBy("host", "id1", "id2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def valid_tokens(tokens: list[dict], found: list) -> set[int]:
    """Keys of the tokens of valid classes, from the arrangements (id1, id2, lo, hi) of all pages."""
    stable = {(a, b): lo for a, b, lo, hi in found if lo == hi != 0}
    return {key for key, mine in classes_of(tokens).items() if mine in stable and (key, None) in stable}


def deduce(tokens: list[dict], valid: set[int]) -> tuple[dict[int, int], set[int]]:
    """The template: the state of each of its elements, and its texts that open slots leave out.

    A common slot, of repeated text or of links, gives way only to an open one that holds as much text.
    """
    elements = {t["key"]: t for t in tokens if not t["is_text"]}
    fixed: dict[int, list] = {}
    for t in tokens:
        if t["is_text"] and t["key"] in valid:
            fixed.setdefault(t["above"], []).append(t)
    states: dict[int, int] = {}
    for key in elements:
        chain = []
        while key in elements and key not in states:
            chain.append(key)
            key = elements[key]["above"]
        state = states.get(key, 0) & ~OWN
        for k in reversed(chain):
            e = elements[k]
            state = step(state, e["sort"])
            if e["kind"] & IS_LIST and e["whole"] and e["linked"] >= LINKS * e["whole"]:
                state |= LISTED
            constant = e["own"] > 0 and not e["kind"] & IS_HEAD and sum(t["own"] for t in fixed.get(k, ())) >= e["own"]
            common = e["again"] >= REPEATED * e["own"] or e["linked"] >= LINKED * e["whole"]
            states[k] = state | CONSTANT if constant else state | COMMON if e["own"] > 0 and not e["kind"] & IS_HEAD and common else state
    most = max((elements[k]["own"] for k, s in states.items() if k in valid and level(s) == 2 and not elements[k]["kind"] & IS_HEAD), default=0)
    states = {k: s & ~COMMON if elements[k]["own"] > most else s for k, s in states.items()}
    mixed = [t["key"] for k, own in fixed.items() for t in own if not (k in elements and elements[k]["own"] <= 2 * sum(x["own"] for x in own))]
    return {k: s for k, s in states.items() if k in valid}, set(mixed)


def by_itself(page: Page) -> tuple[dict[int, int], set[int]]:
    """The template of one page alone."""
    tokens = [dict(zip(TOKEN_FIELDS, (key, above, is_text, sort, kind, count, count, 1.0, *chars, 0), strict=True)) for key, (above, is_text, sort, kind, count, *chars) in tokens_of(page).items()]
    orders, slots = arrangement(page, classes_of(tokens))
    return deduce(tokens, valid_tokens(tokens, [(a, b, x, x) for (a, b), x in [*orders.items(), *(((k, None), x) for k, x in slots.items())]]))


def main_text(page: Page, template: tuple[dict[int, int], set[int]] | None) -> str:
    """The text in the slots of the template that are read."""
    if not template or not any(k in template[0] for k in page.keys):
        template = by_itself(page)
    states, fixed = template
    mine: list[int] = []
    for key, up, sort in zip(page.keys, page.above, page.sorts, strict=True):
        mine.append(states[key] if key in states else step(mine[up] & ~OWN if up >= 0 else 0, sort))
    levels = [level(mine[e]) if e >= 0 else 2 for _, e, _ in page.blocks]
    if fixed and max(levels, default=0) == 2:
        levels = [1 if x == 2 and text_key(page.keys[e] if e >= 0 else 0, t) in fixed else x for x, (t, e, _) in zip(levels, page.blocks, strict=True)]
    return "\n\n".join(b[0] for b in best(page.blocks, levels))


def pack(template: tuple[dict[int, int], set[int]]) -> bytes:
    states, fixed = template
    return b"".join(x.to_bytes(8, "little", signed=True) for x in (len(states), *states.keys(), *states.values(), *sorted(fixed)))


def unpack(raw: bytes | None) -> tuple[dict[int, int], set[int]] | None:
    if raw is None:
        return None
    x = memoryview(raw).cast("q").tolist()
    return dict(zip(x[1 : 1 + x[0]], x[1 + x[0] : 1 + 2 * x[0]], strict=True)), set(x[1 + 2 * x[0] :])


def templates(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """host, template: one row for each host. ``tokens``: host, tokens; ``found``: what ``arranged`` says of its classes."""
    seen = found.groupBy("host").agg(F.collect_list(F.struct("id1", "id2", "lo", "hi")).alias("found")).withColumnRenamed("host", "_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own, rows in zip(column(batch, "tokens"), column(batch, "found"), strict=True):
                valid = valid_tokens(own, [tuple(r.values()) for r in rows or ()])
                made.append(pack(deduce(own, valid)) if valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.binary())], names=["host", "template"])

    return tokens.join(seen, F.col("host") == F.col("_host"), "left").select("host", "tokens", "found").mapInArrow(run, "host string, template binary")


def give(pages: DataFrame, known: DataFrame, name: str, size: Column) -> DataFrame:
    """``pages`` with the column ``name`` of ``known`` (host, pages, ``name``): one row for each host that matters."""
    if (known.agg(F.sum(size)).first()[0] or 0) <= SMALL:
        small = known.select(F.col("host").alias("_host"), name)
        return pages.join(F.broadcast(small), F.col("host") == F.col("_host"), "left").drop("_host")
    spare = F.concat(F.lit("\0"), F.hex(F.xxhash64("host", "page_id", "html")))
    return join_hot(pages, known.withColumnRenamed("pages", "n"), "host", [name], spare)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    named = split_urls(pages.select(F.col("page_id").cast("long"), "url", "html")).drop("path")
    seen = cut(copies(named).groupBy("host", "digest", "id").agg(F.count("*").alias("n")))
    groups = seen.groupBy("host", "digest").agg(F.min("id").alias("first"))
    hosts = cut(groups.groupBy("host").agg(F.count("*").alias("n"), F.count("*").cast("double").alias("host_pages")))
    # of copies one counts, and rows that are alike in all count as one together; all other pages count 1 and are not listed
    first = groups.select(F.col("host").alias("_host"), F.col("digest").alias("_digest"), "first")
    others = seen.join(first, F.col("host").eqNullSafe(F.col("_host")) & (F.col("digest") == F.col("_digest"))).where("id <> first OR n > 1")
    others = cut(others.select(F.col("id").alias("_id"), F.when(F.col("id") == F.col("first"), 1 / F.col("n")).otherwise(0.0).alias("_weight")).dropDuplicates(["_id"]))
    known_bytes = 24 * others.count()
    met = named.withColumn("_row", row_key()).join(F.broadcast(others) if known_bytes <= SMALL else others.hint("shuffle_hash"), F.col("_row") == F.col("_id"), "left")
    counted = met.withColumn("weight", F.coalesce("_weight", F.lit(1.0))).where("weight > 0").select("host", "page_id", "html", "weight")
    tokens = cut(host_tokens(counted, hosts))
    found = arranged(give(counted, tokens, "tokens", F.size("tokens") * 96))
    made = templates(tokens, found).withColumnRenamed("host", "_host")
    known = cut(hosts.join(made, F.col("host") == F.col("_host"), "left").select("host", F.col("n").alias("pages"), "template"))
    met = give(named, known, "template", F.coalesce(F.length("template"), F.lit(0)))
    return met.select("page_id", "url", "html", "host", "template").mapInArrow(read_pages, "page_id long, url string, text string, n_chars long")


def host_tokens(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, pages, tokens: the tokens of enough support. ``hosts``: host, n, host_pages."""
    spare = F.concat(F.lit("\0"), F.hex(F.xxhash64("host", "key")))
    every = cut(token_statistics(pages))
    enough = join_hot(every, hosts, "host", ["host_pages"], spare).where(F.col("pages") >= SUPPORT * F.col("host_pages") - 0.01)
    # characters of an element's own texts that stand on several pages, those of too little support for the template included
    again = every.where("is_text = 1 AND pages > 1.5").groupBy(F.col("host").alias("_host"), F.col("above").alias("_key")).agg(F.sum("own").alias("_again"))
    enough = enough.join(again, F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key")) & (F.col("is_text") == 0), "left").withColumn("again", F.coalesce("_again", F.lit(0)))
    return enough.groupBy("host").agg(F.max("host_pages").cast("long").alias("pages"), F.collect_list(F.struct(*TOKEN_FIELDS)).alias("tokens"))


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, known = Reader(), {}
    for batch in chunks(batches, "html"):
        texts = []
        for at, (host, html) in enumerate(zip(column(batch, "host"), column(batch, "html"), strict=True)):
            if host not in known:
                if len(known) > KEPT:
                    known.clear()
                known[host] = unpack(batch.column("template")[at].as_py())
            texts.append(main_text(reader.read(html), known[host]) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
