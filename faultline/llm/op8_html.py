"""Main text of web pages by nearest-URL page differencing.

A page is read as lines, one per block of text, in page order. Pages of one host are sorted by
their path; each is paired with the last page before it or the first one after it that has other
content, the one whose path shares the longer beginning: its nearest page. The lines of the two are
aligned by their longest common subsequence, and lines they share are what the site repeats, so
they go.

Copies and near copies tell nothing about the site and are looked past: pages whose shared lines
hold more than ``COPY_SHARE`` of the characters of the shorter one. With a near copy, the run of
copies it looked past itself is looked past as well. A page that has no page of other content on
its host keeps all its lines, also one whose menus outweigh its text so far that every page counts
as its copy.

Every page is differenced. That alone cannot give the article: menus and adverts may be unique to a
page, and an article may share a line with its neighbour. So markup checks the result: lines inside
elements that are never article text go whatever they hold. On a page with text in ``article`` or
``main`` elements the article is those of them in which the difference found a line of the page's
own, and they stay whole; one that the nearest page has line by line is what the site repeats and
goes, unless no element has a line of its own, when all stay. On other pages the lines that the
difference left are the text.

The pages are cut into blocks of consecutive URLs at rows picked by a hash of their key, at most
about ``MAX_CUTS`` of them whatever the input. A first pass over hashes of the lines finds for both
ends of every block the ``CARRIED`` last pages of different content, if need be from blocks further
away; the second pass sends their rows along to the next block, so a run of copies may cover any
number of blocks. A busy host has many blocks.

Edge cases: a NULL html is empty and has no lines; a NULL url, or one without host, has an empty
host; unclosed markup runs to the end of its parent, an unclosed comment or script to the end of
the page; names of classes, ids and roles count as whole tokens, and not on headings and
paragraphs inside a main element; repeated rows are copies of one another; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages of a block at least; up to twice ``CARRIED`` of its neighbours' rows are sent along.
MIN_BLOCK = 64
MAX_CUTS = 4_096
# Pages that share more than this part of their characters are copies of one another.
COPY_SHARE = 0.7
# So many pages of different content go along from block to block.
CARRIED = 3

# -- lines ---------------------------------------------------------------------------------------

# Element names of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template title textarea iframe noembed noframes xmp object "
          "svg math select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
             "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("head nav footer aside form button menu dialog fieldset".split())
MAIN = {"article", "main"}
# What an opening element ends if it is still open, up to the given parents.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
# Names, as a whole token of a class, an id or a role, of what is not the article.
BAD_NAMES = set("ad ads advert adverts advertisement advertising adbox banner promo promotion "
                "sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
                "masthead cookie cookies consent gdpr notice notification alert popup modal "
                "newsletter subscribe subscription signup login share sharing social related "
                "recommended comment comments reply replies disqus respond search pagination pager "
                "toolbar widget widgets copyright disclaimer complementary contentinfo "
                "dialog form skip".split())
HEADER_NAMES = {"header", "topbar"}
COMMENT_NAMES = {"comment", "comments", "reply", "replies"}
# Words that make a compound name of the above (``ad-box``, ``site-footer``). Any other word, as in
# ``no-sidebar``, ``has-comments``, ``ad-free`` or ``related-work``, says something else.
NAME_PARTS = set("area bar block body bottom box button buttons container element frame global icon "
                 "icons inner item items link links list main outer page panel placeholder post "
                 "posts primary secondary section site slot thread top unit wrap wrapper zone"
                 .split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# One attribute after the other, so that no name is looked for inside a value or a longer name.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_JOINT = re.compile(r"[-_]+|(?<=[a-z])(?=[0-9])")


def _named(tokens: set[str], names: set[str]) -> bool:
    """Whether a token is one of the names, alone or with nothing but other names and parts."""
    for token in tokens:
        if token in names:
            return True
        words = [w for w in _JOINT.split(token) if w and not w.isdigit()]
        if any(w in names for w in words) and all(
                w in BAD_NAMES or w in HEADER_NAMES or w in NAME_PARTS for w in words):
            return True
    return False


def _region(name: str, attributes: str, inside_main: bool) -> str | None:
    """``out`` for an element that holds no article text, ``main`` for one that holds it."""
    tokens: set[str] = set()
    ids: set[str] = set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return "out"
            if key == "style":
                if "display:none" in value.replace(" ", ""):
                    return "out"
            elif key == "role" and value in ("main", "article"):
                return "main"
            elif key in ("id", "class", "role"):
                (ids if key == "id" else tokens).update(value.split())
    if name in MAIN:
        return "out" if _named(tokens | ids, COMMENT_NAMES) else "main"
    if name in ("html", "body"):
        return None
    if name in NEVER:
        return "out"
    # The id of a heading is made of its text, and so may be that of a section.
    if name in HEADINGS or (inside_main and name == "p"):
        return "out" if not inside_main and _named(tokens, BAD_NAMES) else None
    bad = COMMENT_NAMES if inside_main and name == "section" else BAD_NAMES
    if _named(tokens, BAD_NAMES) or _named(ids, bad):
        return "out"
    if not inside_main and (name == "header" or _named(tokens | ids, HEADER_NAMES)):
        return "out"
    return None


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The blocks of text outside excluded elements: (text, number of the outermost main element it
    is in, 0 outside of all)."""
    html = html or ""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str | None]] = []
    open_names: Counter = Counter()
    out = main = mains = 0
    no_quote = {'"': len(html) + 1, "'": len(html) + 1}

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                lines.append((text, mains if main else 0))

    def pop() -> str:
        nonlocal out, main
        name, region = stack.pop()
        open_names[name] -= 1
        if region == "out":
            out -= 1
        elif region == "main":
            main -= 1
        return name

    def tag_end(at: int) -> int:
        """The place of the ``>`` that ends a tag, quotes skipped; -1 if there is none."""
        while True:
            end = html.find(">", at)
            if end < 0:
                return -1
            quotes = [(p, c) for c in "\"'" if (p := html.find(c, at, end)) >= 0]
            if not quotes:
                return end
            place, quote = min(quotes)
            if place >= no_quote[quote]:
                return end
            close = html.find(quote, place + 1)
            if close < 0:
                no_quote[quote] = min(no_quote[quote], place)
                return end
            at = close + 1

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not out:
            buffer.append(html[at:lt])
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = html[lt + 1:lt + 2]
        if following in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = following == "/"
        found = _NAME.match(html, lt + 1 + closing)
        end = tag_end(found.end()) if found else -1
        if end < 0:
            if not out:
                buffer.append("<")
            at = lt + 1
            continue
        name, at = found.group().lower(), end + 1
        if closing:
            if name not in INLINE:
                flush()
            if name == "br":
                flush()
            elif open_names[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in RAW:
            if html[end - 1] != "/":
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = n if end < 0 else end + 1
            if name not in ("svg", "math"):
                flush()
            continue
        if name not in INLINE:
            flush()
            if open_names["p"] > 0:
                # A block ends an open paragraph unless a container was opened inside it.
                depth = len(stack) - 1
                while stack[depth][0] in INLINE:
                    depth -= 1
                if stack[depth][0] == "p":
                    while pop() != "p":
                        pass
            if name in ENDS:
                ends, parents = ENDS[name]
                if any(open_names[e] > 0 for e in ends):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in parents:
                            break
                        if stack[depth][0] in ends:
                            while len(stack) > depth:
                                pop()
                            break
        if html[end - 1] == "/" and name not in INLINE:
            continue
        region = _region(name, html[found.end():end], main > 0)
        stack.append((name, region))
        open_names[name] += 1
        if region == "out":
            if name in INLINE:
                flush()
            out += 1
        elif region == "main":
            mains += not main
            main += 1
    flush()
    return lines


# -- difference ------------------------------------------------------------------------------------

def shared_lines(a: list, b: list) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence of ``a`` and ``b``.

    Equal beginnings and ends are taken first. The rest is a table of bit rows, one machine word
    operation per line of ``b`` and 64 lines of ``a``, of which the root of their number is held.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = range(head, len(a) - tail)
    rest = b[head:len(b) - tail]
    in_b, in_a = set(rest), {a[i] for i in middle}
    # Lines of one side alone are in no common subsequence.
    own = [i for i in middle if a[i] in in_b]
    y = [line for line in rest if line in in_a]
    places: dict = {}
    for i, at in enumerate(own):
        places[a[at]] = places.get(a[at], 0) | (1 << i)
    full = (1 << len(own)) - 1

    def after(row: int, line) -> int:
        met = row & places[line]
        return ((row + met) | (row - met)) & full

    # Of the rows only every step-th is kept; those between are computed again on the way back.
    step = math.isqrt(len(y)) + 1
    marks, row = [], full
    for j, line in enumerate(y):
        if j % step == 0:
            marks.append(row)
        row = after(row, line)
    shared = [False] * len(middle)
    i = len(own)
    for k in range(len(marks) - 1, -1, -1):
        rows = [marks[k]]
        for line in y[k * step:(k + 1) * step]:
            rows.append(after(rows[-1], line))
        j = len(rows) - 1
        while i and j:
            # A zero bit at i-1 says that the subsequence of the first i lines grew at i; see
            # whether the j-th row did it.
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                shared[own[i - 1] - head] = True
                i, j = i - 1, j - 1
    return [True] * head + shared + [True] * tail


def common_beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def is_copy(a: list, b: list, a_chars: list[int], b_chars: list[int]) -> bool:
    """Whether the shared lines hold more than ``COPY_SHARE`` of the shorter one's characters."""
    if a == b or not a or not b:
        return True
    least = COPY_SHARE * min(sum(a_chars), sum(b_chars))
    in_b = set(b)
    if sum(n for line, n in zip(a, a_chars) if line in in_b) <= least:
        return False
    return sum(n for n, shared in zip(a_chars, shared_lines(a, b)) if shared) > least


def others_before(pages: list[tuple[list, list[int]]]) -> list[int]:
    """For every page (lines, characters of the lines) the place of the last page before it that
    is no copy of it, -1 if there is none."""
    found: list[int] = []
    for i, (lines, chars) in enumerate(pages):
        if i and pages[i - 1][0] == lines:
            found.append(found[-1])
            continue
        j = i - 1
        while j >= 0 and is_copy(lines, pages[j][0], chars, pages[j][1]):
            j = found[j] if pages[j][0] else j - 1
        # The run of copies may have drifted away from its beginning.
        if j < 0 and i and not is_copy(lines, pages[0][0], chars, pages[0][1]):
            j = 0
        found.append(j)
    return found


def distinct(pages: Iterable[tuple], count: int = CARRIED) -> list[tuple]:
    """The first pages (.., lines, characters of the lines) that are no copies of one another."""
    found: list[tuple] = []
    for page in pages:
        if page[-2] and not any(is_copy(page[-2], p[-2], page[-1], p[-1]) for p in found):
            found.append(page)
            if len(found) == count:
                break
    return found


def article(lines: list[str], regions: list[int], neighbours: list[tuple[str, list[str]]],
            path: str) -> list[str]:
    """The kept lines of a page, given (path, lines) of pages of other content on its host: the
    lines that the nearest one does not share, then the check by main elements."""
    others = [(common_beginning(path, p), -i, ls) for i, (p, ls) in enumerate(neighbours)]
    shared = shared_lines(lines, max(others, key=lambda o: o[:2])[2]) if others else [False] * len(lines)
    if not any(regions):
        return [line for line, repeated in zip(lines, shared) if not repeated]
    told = {r for r, repeated in zip(regions, shared) if r and not repeated} or set(regions)
    return [line for line, r in zip(lines, regions) if r and r in told]


# -- the operator ------------------------------------------------------------------------------------

def _keyed(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, found, i), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), url.alias("url"),
                        F.col("html").cast("string"), F.lower(part(1)).alias("host"),
                        part(2).alias("path"),
                        F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("tie"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text and n_chars."""
    keyed = _keyed(pages)
    keys = keyed.select("host", "path", "tie")
    every = max(MIN_BLOCK, -(-keys.count() // MAX_CUTS))
    cuts = sorted({tuple(r) for r in keys.filter(
        F.pmod(F.xxhash64("host", "path", "tie"), F.lit(every)) == 0).distinct().collect()})

    carried = _carried(keyed, cuts)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "html", "host", "path", "tie"]
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html, host, path, tie in zip(*(batch.column(c).to_pylist() for c in names)):
                lines = page_lines(html)
                text, core = [t for t, _ in lines], [c for _, c in lines]
                key = (host, path, tie)
                home = bisect.bisect_right(cuts, key)
                rows.append((home, True, page, url, host, path, tie, text, core))
                for block in carried.get(key, ()):
                    rows.append((block, False, page, url, host, path, tie, text, core))
            yield _record(rows, _TYPES)

    def difference(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for _, part in groupby(_rows(batches), key=lambda r: (r["block"], r["host"])):
            yield from _resolve(list(part))

    schema = ("block int, home boolean, page_id bigint, url string, host string, path string, "
              "tie bigint, lines array<string>, core array<int>")
    lines = keyed.mapInArrow(read, schema).repartition("block")
    ordered = lines.sortWithinPartitions("block", "host", "path", "tie", "home")
    return ordered.mapInArrow(_batched(difference),
                              "page_id bigint, url string, text string, n_chars bigint")


_TYPES = {"block": pa.int32(), "home": pa.bool_(), "page_id": pa.int64(), "url": pa.string(),
          "host": pa.string(), "path": pa.string(), "tie": pa.int64(),
          "lines": pa.list_(pa.string()), "core": pa.list_(pa.int32())}
_HASHED = {"block": pa.int32(), "host": pa.string(), "path": pa.string(), "tie": pa.int64(),
           "asked": pa.bool_(), "hashes": pa.binary(), "chars": pa.binary()}
_ENDS = {"block": pa.int32(), "tail": pa.bool_(), "whole": pa.bool_(), "asked": pa.bool_(),
         "host": pa.string(), "path": pa.list_(pa.string()), "tie": pa.list_(pa.int64()),
         "hashes": pa.list_(pa.binary()), "chars": pa.list_(pa.binary())}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _resolve(rows: list[dict]) -> Iterator[tuple]:
    """The texts of the rows at home among the rows of one host in one block, in order."""
    asked = [r["home"] and bool(r["lines"]) for r in rows]
    before = after = [-1] * len(rows)
    if any(asked):
        pages = [(r["lines"], [len(x) for x in r["lines"]]) for r in rows]
        before = others_before(pages)
        after = [len(rows) - 1 - j if j >= 0 else -1 for j in others_before(pages[::-1])][::-1]
    for row, i, j in zip(rows, before, after):
        if row["home"]:
            near = [(rows[k]["path"], rows[k]["lines"]) for k in (i, j) if k >= 0]
            text = "\n".join(article(row["lines"], row["core"], near, row["path"]))
            yield row["page_id"], row["url"], text, len(text)


def _carried(keyed: DataFrame, cuts: list[tuple]) -> dict[tuple, list[int]]:
    """The blocks each row is sent to besides its own, by the key of the row."""
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, *key in zip(*(batch.column(c).to_pylist()
                                    for c in ("html", "host", "path", "tie"))):
                lines = page_lines(html)
                asked = bool(lines)
                hashes = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8)
                                  .digest() for t, _ in lines)
                chars = np.array([len(t) for t, _ in lines], "<u4").tobytes()
                rows.append((bisect.bisect_right(cuts, tuple(key)), *key, asked, hashes, chars))
            yield _record(rows, _HASHED)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_rows(batches), key=lambda r: r["block"]):
            first = last = None
            for host, part in groupby(rows, key=lambda r: r["host"]):
                last = host, list(part)
                first = first or last
            out = []
            for tail, (host, part) in ((False, first), (True, last)):
                facts = block, tail, first is last, any(r["asked"] for r in part), host
                pages = distinct((r["path"], r["tie"], *_unpacked(r["hashes"], r["chars"]))
                                 for r in (reversed(part) if tail else part))
                out.append((*facts, [p[0] for p in pages], [p[1] for p in pages],
                            [b"".join(p[2]) for p in pages],
                            [np.array(p[3], "<u4").tobytes() for p in pages]))
            yield _record(out, _ENDS)

    rows = (keyed.mapInArrow(hashed, "block int, host string, path string, tie bigint, "
                             "asked boolean, hashes binary, chars binary").repartition("block")
            .sortWithinPartitions("block", "host", "path", "tie")
            .mapInArrow(ends, "block int, tail boolean, whole boolean, asked boolean, host string, "
                        "path array<string>, tie array<bigint>, hashes array<binary>, "
                        "chars array<binary>").collect())
    of = {(r.block, r.tail): r for r in rows}
    sent: dict[tuple, set[int]] = defaultdict(set)
    for tail in (True, False):
        out, out_host = [], None
        for block in sorted({b for b, _ in of}, reverse=not tail):
            facing, side = of[block, not tail], of[block, tail]
            if facing.asked and facing.host == out_host:
                for path, tie, *_ in out:
                    sent[out_host, path, tie].add(block)
            pages = [(p, t, *_unpacked(h, c))
                     for p, t, h, c in zip(side.path, side.tie, side.hashes, side.chars)]
            out = distinct(pages + (out if side.whole and side.host == out_host else []))
            out_host = side.host
    return {key: sorted(blocks) for key, blocks in sent.items()}


def _unpacked(hashes: bytes, chars: bytes) -> tuple[list[bytes], list[int]]:
    return ([bytes(hashes[i:i + 8]) for i in range(0, len(hashes), 8)],
            np.frombuffer(chars, "<u4").tolist())


def _record(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types.values())],
        names=list(types))


def _batched(rows_of, size: int = 1_000):
    """A function over batches from one that yields rows."""
    def run(batches):
        def pack(rows):
            page, url, text, chars = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array(url, pa.string()),
                 pa.array(text, pa.string()), pa.array(chars, pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
        rows = []
        for row in rows_of(batches):
            rows.append(row)
            if len(rows) == size:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)
    return run
