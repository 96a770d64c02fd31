"""Exact top-k search by pivot-table elimination.

Vectors of whole numbers c and a query q are compared by inner product. With M the largest norm
and one further component sqrt(M^2 - |c|^2) on every candidate (0 on queries), the squared
distance is |q|^2 + M^2 - 2<q, c>: the nearest candidates are those of the highest product. Every
row keeps its distances to a set of pivots. By the triangle inequality the largest difference
between a query's and a candidate's distance to a pivot is a lower bound of their distance.

Queries and candidates are dealt into blocks of bounded size by the hash of their id, and every
block of queries meets every block of candidates in a cell. There each query evaluates candidates
in the order of their bounds, nearest first, and stops where the next bound exceeds the distance
of its k-th best; nothing beyond can enter. A cell returns k rows per query at most, which a
ranking per query merges.

Bounds are computed in floating point and widened by a margin; products are exact whole numbers.

Edge cases: vectors that are NULL or hold NULL or non-finite components take no part; of vectors
of unequal length the shorter counts as padded with zeros; rows that share their id are one
candidate with the best of their scores, and one query; a query's own id is no candidate; with
fewer than k others, all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import cut

PIVOTS = 24
# Pivots are chosen among this many rows, those with the smallest hash of their id.
PIVOT_SAMPLE = 2_000
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 16_384
FIRST_CHUNK = 256


# -- metric ------------------------------------------------------------------------------------

def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of ``sample`` far from one another: each next one is the farthest from all before."""
    if len(sample) == 0:
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Candidates with the component that gives all of them the norm sqrt(largest)."""
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x.astype(float) ** 2).sum(1), 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = ((points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


# -- one cell ------------------------------------------------------------------------------------

def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with the rows of q."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return (x.astype(kind) @ q.astype(kind).T).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, best first."""
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def search_cell(q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, ids: np.ndarray,
                x: np.ndarray, table: np.ndarray, largest: float, k: int):
    """(query id, id, score) of each query's k best candidates in this cell."""
    out_q, out_id, out_score = [], [], []
    repeated = len(np.unique(ids)) < len(ids)
    q_norms = (q.astype(float) ** 2).sum(1)
    columns = np.ascontiguousarray(table.T, np.float32)
    margin = 1e-3 + 1e-5 * float(np.abs(table).max(initial=0) + np.abs(q_table).max(initial=0))
    # One margin covers the rounding of distances, the other the room for one own row.
    need = k + 1
    wide: list[int] = []
    bounds: dict[int, np.ndarray] = {}

    def emit(i, picked, score):
        others = ids[picked] != q_ids[i]
        picked, score = picked[others], score[others]
        if repeated:
            order = np.lexsort((-score, ids[picked]))
            picked, score = picked[order], score[order]
            first = np.append(True, ids[picked][1:] != ids[picked][:-1]) if len(picked) else others[:0]
            picked, score = picked[first], score[first]
        best = _best(score, ids[picked], k)
        out_q.append(np.full(len(best), q_ids[i]))
        out_id.append(ids[picked[best]])
        out_score.append(score[best])

    for i in range(len(q_ids)):
        bound = np.abs(columns[0] - q_table[i, 0]) if len(columns) else np.zeros(len(ids), np.float32)
        for p in range(1, len(columns)):
            np.maximum(bound, np.abs(columns[p] - np.float32(q_table[i, p])), out=bound)
        if len(ids) <= FIRST_CHUNK or repeated:
            wide.append(i)
            continue
        near = np.argpartition(bound, FIRST_CHUNK)[:FIRST_CHUNK]
        score = _products(x[near], q[i:i + 1])[:, 0]
        reach = _reach(score, need, q_norms[i], largest) + margin
        rest = np.flatnonzero(bound <= reach)
        if len(rest) * 4 > len(ids):
            wide.append(i)
            continue
        # Beyond the nearest chunk: in the order of the bounds, in chunks that double.
        rest = np.setdiff1d(rest, near, assume_unique=True)
        rest = rest[np.argsort(bound[rest], kind="stable")]
        taken, scores, at, step = [near], [score], 0, FIRST_CHUNK
        while at < len(rest) and bound[rest[at]] <= reach:
            part = rest[at:at + step]
            taken.append(part)
            scores.append(_products(x[part], q[i:i + 1])[:, 0])
            at, step = at + step, 2 * step
            reach = _reach(np.concatenate(scores), need, q_norms[i], largest) + margin
        emit(i, np.concatenate(taken), np.concatenate(scores))
    # Where most candidates are within reach, the whole block is evaluated at once.
    for at in range(0, len(wide), 64):
        some = wide[at:at + 64]
        scores = _products(x, q[some])
        for j, i in enumerate(some):
            emit(i, np.arange(len(ids)), scores[:, j])
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_id), join(out_score)


def _reach(score: np.ndarray, need: int, q_norm: float, largest: float) -> float:
    """The distance of the need-th best score so far; no bound before there are so many."""
    if len(score) < need:
        return np.inf
    worst = float(np.partition(score, len(score) - need)[len(score) - need])
    return float(np.sqrt(max(q_norm + largest - 2 * worst, 0)))


# -- the operator ------------------------------------------------------------------------------

def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of every component, for the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (embeddings.select(F.col("vec_id").cast("long"), x.alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
            .select("vec_id", F.transform("embedding", lambda v: F.floor(v * scale)).alias("x")))


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), np.int64)
    for i, row in enumerate(arrays):
        out[i, :len(row)] = row
    return out


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """For each vector whose id is divisible by ``every``: query_id, rank, vec_id and score of its
    k best others."""
    vectors = cut(whole_vectors(embeddings, scale))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = vectors.agg(F.max(norm), F.max(F.size("x")), F.count(F.lit(1)),
                        F.count_if(F.col("vec_id") % every == 0)).first()
    largest, width, rows, asked = facts[0] or 0.0, facts[1] or 0, facts[2], facts[3]
    sample = (vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(PIVOT_SAMPLE).collect())
    pivots = choose_pivots(lifted(_matrix([r.x for r in sample], width), largest))
    q_blocks, c_blocks = -(-asked // QUERY_BLOCK) or 1, -(-rows // CANDIDATE_BLOCK) or 1

    def pivot_table(batches):
        for batch in batches:
            x = _matrix(batch.column("x").to_pylist(), width)
            # One query may be a pivot's equal: queries lie in the space with component 0.
            as_candidate = distances(lifted(x, largest), pivots)
            as_query = distances(np.column_stack([x, np.zeros(len(x))]), pivots)
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pack(x), pack(as_candidate), pack(as_query)],
                names=["vec_id", "x", "d", "dq"])

    if len(pivots) == 0:
        pivots = np.zeros((0, width + 1))
    prepared = cut(vectors.mapInArrow(pivot_table,
                                      "vec_id bigint, x binary, d binary, dq binary"))
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    queries = (prepared.filter(F.col("vec_id") % every == 0)
               .select(block(q_blocks).alias("qb"), every_block(c_blocks).alias("cb"),
                       "vec_id", "x", F.col("dq").alias("d")))
    candidates = prepared.select(every_block(q_blocks).alias("qb"), block(c_blocks).alias("cb"),
                                 "vec_id", "x", "d")
    n_pivots = len(pivots)

    def cell(asked_rows: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        def unpack(frame):
            n = len(frame)
            x = np.frombuffer(b"".join(frame["x"]), np.int64).reshape(n, width)
            d = np.frombuffer(b"".join(frame["d"]), np.float64).reshape(n, n_pivots)
            return frame["vec_id"].to_numpy(np.int64), x, d
        found = search_cell(*unpack(asked_rows), *unpack(rows_), largest, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = (queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
             .applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.repartition("query_id").groupBy("query_id", "vec_id")
            .agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
