"""Benchmark decontamination: one Aho-Corasick automaton over the test texts, one scan per text.

Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z became lower case. A window is
``window`` consecutive words of an item; an item with fewer words is one window. The automaton
reads words as symbols, so a match begins and ends at word borders.

Its keys are anchors: runs of half a window, chosen so that every window of an item holds at least
one, the rarest of the places open to each. Where an anchor occurs, the words beside it are compared
with the item's, so far as a window reaches. An item thus costs about a node per word instead of
one per word and window; the whole benchmark goes into one automaton and documents are scanned
once. Words and anchors are broadcast as numbers (about 5 bytes a word, besides the distinct words),
and each Python worker builds the automaton once for all its tasks. It holds some 0.1 KB for a word
of the benchmark, which therefore has to fit in a worker; the documents have no such bound.

Edge cases: a NULL or empty text has no words and no hits; an item without words has no windows;
the windows of an item without id hit, but there is no id to list or count; windows that several
items share count for each of them; repeated rows are judged each by itself; an empty benchmark
hits nothing; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import mix

WINDOW = 10
# Stands between two items; neither a word's symbol nor 0, the symbol of unknown words.
BORDER = (1 << 32) - 1

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def run_counts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Per position, how often the run of ``length`` symbols that begins there occurs (by hash,
    which only steers the choice of anchors)."""
    n = len(symbols) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    sums = np.zeros(n, np.uint64)
    for i in range(length):
        sums = mix(sums + symbols[i:i + n].astype(np.uint64) + np.uint64(1))
    _, place, counts = np.unique(sums, return_inverse=True, return_counts=True)
    return counts[place]


class Matcher:
    """The automaton of all items. Unknown words are symbol 0, which no window holds."""

    def __init__(self, facts: dict):
        """``facts`` from ``facts_of``; the automaton is kept there for the worker's next task."""
        self.facts = facts
        self.window, self.anchor = facts["window"], facts["anchor"]
        self.symbols, self.owners = facts["symbols"], facts["owners"]
        self.begins, self.text, self.places = facts["begins"], facts["text"], facts["places"]

    @classmethod
    def facts_of(cls, items, window: int = WINDOW) -> dict:
        """Words, borders, owners and anchors of the items, in plain types, which a worker reads
        without this module."""
        symbols: dict[bytes, int] = {}
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            ids = [symbols.setdefault(w, len(symbols) + 1) for w in words(text)]
            if ids:
                named = owners.setdefault(np.array(ids, np.uint32).tobytes(), set())
                if item is not None:
                    named.add(item)
        parts, begins, at = [np.array([BORDER], np.uint32)], [], 1
        for key in owners:
            begins.append(at)
            parts += [np.frombuffer(key, np.uint32), parts[0]]
            at += len(key) // 4 + 1
        # The words of all items, one item after the other, with a border on both sides.
        facts = {"window": window, "anchor": (window + 1) // 2, "symbols": symbols,
                 "owners": [sorted(named) for named in owners.values()], "begins": begins,
                 "text": np.concatenate(parts), "places": np.zeros(0, np.uint32)}
        facts["width"] = int(len(symbols) ** 0.5) + 1
        return facts | {"places": np.array(cls(facts)._anchors(), np.uint32)}

    def _length(self, item: int) -> int:
        end = self.begins[item + 1] if item + 1 < len(self.begins) else len(self.text)
        return end - self.begins[item] - 1

    def _anchors(self) -> list[int]:
        """Where the anchors begin. Of an item shorter than a window it is the whole item."""
        counts = run_counts(self.text, self.anchor)
        reach = self.window - self.anchor + 1
        out = []
        for item, begin in enumerate(self.begins):
            last = begin + self._length(item) - self.anchor
            if self._length(item) < self.window:
                out.append(begin)
                continue
            at = begin - 1
            while at <= last - reach:
                open_ = counts[at + 1:at + 1 + reach]
                at += reach - int(np.argmin(open_[::-1]))
                out.append(at)
        return out

    def _steps(self, ids: list[int]) -> tuple[int, ...]:
        """Two symbols for each word, of alphabets apart, so a match begins at a word. A node then
        has some square root of the number of words as children, among which the automaton looks
        one by one."""
        width = self.facts["width"]
        steps = np.empty(2 * len(ids), np.int64)
        steps[::2], steps[1::2] = np.divmod(np.array(ids, np.int64), width)
        steps[::2] += width
        return tuple(steps.tolist())

    def _automaton(self) -> ahocorasick.Automaton:
        if "automaton" not in self.facts:
            self.facts["automaton"] = self._built()
        return self.facts["automaton"]

    def _built(self) -> ahocorasick.Automaton:
        keys: dict[bytes, list[int]] = {}
        for place in self.places.tolist():
            length = self._length(bisect_right(self.begins, place) - 1)
            if length >= self.window:
                length = self.anchor
            keys.setdefault(self.text[place:place + length].tobytes(), []).append(place)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        while keys:
            key, places = keys.popitem()
            ids = np.frombuffer(key, np.uint32)
            automaton.add_word(self._steps(ids), (len(ids), places))
        automaton.make_automaton()
        return automaton

    def _run(self, ids: list[int], first: int, place: int) -> tuple[int, int] | None:
        """The words [first, end) of a text around an anchor that are windows of the item."""
        text, reach = self.text, self.window - self.anchor
        left = right = 0
        end, after = first + self.anchor, place + self.anchor
        while left < reach and left < first and ids[first - left - 1] == text[place - left - 1]:
            left += 1
        while right < reach and end + right < len(ids) and ids[end + right] == text[after + right]:
            right += 1
        return (first - left, end + right) if left + right >= reach else None

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, hit runs as [first, end) in words, items met)."""
        tokens = words(text)
        runs: list[tuple[int, int]] = []
        met: set = set()
        if len(self.places) and tokens:
            symbol = self.symbols.get
            ids = [symbol(t, 0) for t in tokens]
            for step, (length, places) in self._automaton().iter(self._steps(ids)):
                last = step // 2
                first = last - length + 1
                for place in places:
                    item = bisect_right(self.begins, place) - 1
                    whole = self._length(item) < self.window
                    if whole and self._length(item) != length:
                        continue
                    run = (first, last + 1) if whole else self._run(ids, first, place)
                    if run:
                        runs.append(run)
                        met.update(self.owners[item])
        return len(tokens), merged(runs), met


def _matcher(benchmark: DataFrame, window: int):
    """The items' words and anchors as a broadcast value."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    rows = ((row.item_id, row.text) for row in items.toLocalIterator())
    return benchmark.sparkSession.sparkContext.broadcast(Matcher.facts_of(rows, window))


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, the hit words as runs [first, end), the ids of the items
    met (as strings) and the hit passages as [start, end) code points of the original text."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    types = {"n_words": pa.int64(), "runs": span, "items": pa.list_(pa.string()),
             "passages": span}
    shared = _matcher(benchmark, window)

    def scan(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            out = {k: [] for k in types}
            for text in batch.column(1).to_pylist():
                n, runs, met = matcher.scan(text)
                places = [m.span() for m in _WORD.finditer(text)] if runs else []
                out["n_words"].append(n)
                out["runs"].append([{"first": a, "end": b} for a, b in runs])
                out["items"].append(sorted(met))
                out["passages"].append([{"first": places[a][0], "end": places[b - 1][1]}
                                        for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[k], t) for k, t in types.items())],
                names=["doc_id", *types])

    sql_span = "array<struct<first: bigint, end: bigint>>"
    schema = (f"doc_id bigint, n_words bigint, runs {sql_span}, items array<string>, "
              f"passages {sql_span}")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(scan, schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def judged(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(documents, benchmark, window)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` that no window touches, with all their columns."""
    shared = _matcher(benchmark, window)

    def scan(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = batch.column(0)
            clean_ = [not matcher.scan(text)[1]
                      for text in rows.field("text").cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(clean_, pa.bool_()))],
                                             names=["row"])

    rows = documents.select(F.struct("*").alias("row"))
    return rows.mapInArrow(scan, rows.schema).select("row.*")
