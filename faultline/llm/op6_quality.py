"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the whole text are cut into bins. Cyclic boosting goes round the features; at
each it fits a shallow tree on that feature alone to the current residual and adds it, damped, to
the feature's lookup table. Then the pairs of features whose joint tree would gain most get
two-dimensional tables the same way. A score is the sigmoid of the intercept plus one table value
per feature and pair: bin numbers and additions, vectorised over rows.

The model is fitted on the driver from ``MAX_LABELLED`` labelled rows at most, those with the
smallest hash of their id; all else covers every row. Labels, language, source and id are no
features.

Edge cases: a NULL or empty text has all features 0 and is scored by them; of several labels for
one id the smallest counts, rows without label, id or with another label than 0 and 1 train
nothing; repeated rows train once; if no label is left, every score is 0.5; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import byte_blocks, cut, word_hashes, words_of

MAX_LABELLED = 40_000
FEATURES = [
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "bars",
    "exclaims", "stops", "commas", "beyond_ascii", "distinct", "doubled", "line_words", "lines",
]


# -- features --------------------------------------------------------------------------------

def _class(characters) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"),
    "marks": _class("#$%&*+=@^_~<>\\{}[]"), "bars": _class("|"), "exclaims": _class("!?"),
    "stops": _class("."), "commas": _class(",;:"), "lines": _class("\n"),
    "beyond_ascii": np.arange(256) >= 128,
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, row = words_of(data, offsets)
    words = np.bincount(row, minlength=rows)
    per_byte = 1 / np.maximum(size, 1)
    per_word = 1 / np.maximum(words, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    found = {name: count(table[data]) for name, table in _CLASSES.items()}
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    edges = np.concatenate(([0], np.cumsum(words)))
    distinct = np.zeros(rows)
    for i in range(rows):
        own = np.sort(hashes[edges[i]:edges[i + 1]])
        distinct[i] = len(own) and 1 + np.count_nonzero(own[1:] != own[:-1])
    out = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words),
        "mean_word": np.bincount(row, length, rows) * per_word,
        "long_words": np.bincount(row, length > 14, rows) * per_word,
        # The share of distinct words falls with length; its ratio of logarithms hardly does.
        "distinct": np.log1p(distinct) / np.maximum(np.log1p(words), 1e-9),
        "doubled": np.bincount(row, same, rows) * per_word,
        "line_words": np.log1p(words / (1 + found["lines"])),
        "lines": np.log1p(found["lines"]),
    }
    for name in ("upper", "digits", "beyond_ascii"):
        out[name] = found[name] * per_byte
    for name in ("marks", "bars", "exclaims", "stops", "commas"):
        out[name] = found[name] * per_word
    return np.column_stack([out[name] for name in FEATURES])


# -- model -----------------------------------------------------------------------------------

@dataclass
class Additive:
    """Cut points and a table per feature, and a table per pair of features."""

    cuts: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right")
                                for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _step(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> tuple[np.ndarray, float]:
    """A tree over ordered bins with the sums g and h: its value per bin, and its gain."""
    gain_of = lambda a, b: a * a / (b + l2)
    whole = gain_of(g.sum(), h.sum())
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = gain_of(left_g, left_h) + gain_of(g.sum() - left_g, h.sum() - left_h) - whole
        k = int(np.argmax(gains))
        if gains[k] > 1e-9:
            left, a = _tree(g[:k + 1], h[:k + 1], depth - 1, l2)
            right, b = _tree(g[k + 1:], h[k + 1:], depth - 1, l2)
            return np.concatenate((left, right)), gains[k] + a + b
    return np.full(len(g), _step(g.sum(), h.sum(), l2)), 0.0


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts of a two-dimensional table: value per cell, and its gain."""
    def corners(t):
        c = t.cumsum(0).cumsum(1)
        a, top, left, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([a, top - a, left - a, total - top - left + a])

    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    cg, ch = corners(g), corners(h)
    gains = (cg * cg / (ch + l2)).sum(0) - g.sum() ** 2 / (h.sum() + l2)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = _step(cg[:, i, j], ch[:, i, j], l2)
    low, right = np.arange(g.shape[0]) > i, np.arange(g.shape[1]) > j
    return values[2 * low[:, None] + right[None, :]], float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_count: int = 6,
        pair_rounds: int = 40, rate: float = 0.1, depth: int = 2, l2: float = 1.0) -> Additive:
    """The model for features ``x`` and labels ``y``; the same for the same rows in any order."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0)
            for c in x.T]
    model = Additive(cuts)
    n = len(y)
    if n == 0:
        return model
    share = (y.sum() + 0.5) / (n + 1)
    model.intercept = float(np.log(share / (1 - share)))
    b = model.bins(x)
    width = [len(c) + 1 for c in cuts]
    model.tables = [np.zeros(w) for w in width]
    total = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            value, _ = _tree(np.bincount(b[:, j], g, width[j]), np.bincount(b[:, j], h, width[j]),
                             depth, l2)
            table += rate * value
            total += rate * value[b[:, j]]

    def joint(i, j, v):
        return np.bincount(b[:, i] * width[j] + b[:, j], v, width[i] * width[j]).reshape(
            width[i], width[j])

    g, h = slopes()
    gains = [(_quadrants(joint(i, j, g), joint(i, j, h), l2)[1], i, j)
             for i in range(len(cuts)) for j in range(i + 1, len(cuts))]
    chosen = sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:pair_count]
    model.pairs = [(i, j) for gain, i, j in chosen if gain > 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            value, _ = _quadrants(joint(i, j, g), joint(i, j, h), l2)
            table += rate * value
            total += rate * value[b[:, i], b[:, j]]
    return model


# -- the operator ------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows kept from training: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def feature_rows(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id and its features."""
    def compute(batches):
        for batch in batches:
            parts = [features(data, offsets) for _, _, data, offsets in byte_blocks(batch.column(1))]
            x = np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in x.T)],
                names=["doc_id", *FEATURES])

    schema = "doc_id bigint, " + ", ".join(f"{name} double" for name in FEATURES)
    return (documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(compute, schema))


def train(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
          ids: DataFrame | None = None) -> Additive:
    """The model from feature rows and labels of ids that are not held out; ``ids`` are the doc_id
    of the rows, where they can be had without the features."""
    known = (labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("double").alias("quality")))
    found = (rows if ids is None else ids).select("doc_id").join(known, "doc_id").distinct().count()
    if found > max_labelled:
        # The smallest hashes and some to spare, so that no task sends the driver more than its part.
        share = (max_labelled + 10 * max_labelled**0.5 + 100) / found
        known = known.filter(F.xxhash64("doc_id") <= min(int(share * 2**64) - 2**63, 2**63 - 1))
    sample = (rows.join(known, "doc_id").dropDuplicates(["doc_id", *FEATURES])
              .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES)
              .limit(max_labelled).select("quality", *FEATURES).toPandas())
    table = sample.to_numpy(float).reshape(-1, 1 + len(FEATURES))
    table = table[np.lexsort(table.T[::-1])]
    return fit(table[:, 1:], table[:, 0])


def score_rows(rows: DataFrame, model: Additive) -> DataFrame:
    """Per feature row: doc_id and score."""
    def compute(batches):
        for batch in batches:
            x = np.column_stack([batch.column(name).to_numpy() for name in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(x), pa.float64())],
                names=["doc_id", "score"])
    return rows.mapInArrow(compute, "doc_id bigint, score double")


def keep_good(documents: DataFrame, model: Additive, threshold: float) -> DataFrame:
    """The rows of ``documents`` whose text scores ``threshold`` or more, with all columns."""
    def filter_(batches):
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field("text").cast(pa.string())
            parts = [model.score(features(d, o)) for _, _, d, o in byte_blocks(texts)]
            good = np.concatenate(parts) >= threshold if parts else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(good))], names=["row"])
    rows = documents.select(F.struct("*").alias("row"))
    return rows.mapInArrow(filter_, rows.schema).select("row.*")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document row: doc_id, held_out, score and predicted. Texts are read once; their
    features, a few numbers a row, are kept for training and scoring."""
    rows = cut(feature_rows(documents))
    scored = score_rows(rows, train(rows, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
