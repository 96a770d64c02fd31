"""Centroid clustering with a vantage-point tree over the centroids.

Vectors and centroids are whole numbers. In every round the driver builds a vantage-point tree over
the centroids and broadcasts it; tasks assign their vectors and add up, per centroid, the number
of vectors and the sum of every component. Spark sums these parts, so the driver gets one row per
centroid and component. The new centroid is the exact floor of sum / count.

A node of the tree holds one centroid, its vantage point; the others below it are split at the
median of their distance to it, and each half knows the least and the largest of these distances.
A vector looks for its nearest centroid best-first: it takes the open node of the smallest lower
bound, evaluates the exact squared distance to its vantage point, and opens the halves with the
bounds that the triangle inequality gives. It ends when the smallest bound exceeds the best distance;
bounds that equal it are still followed (inclusive radius), so of equally near centroids the one of
the smallest number is found. The vectors of a batch take their steps together, each with a queue
of its own. Bounds are floating point and widened; distances are exact.

Edge cases: vectors that are NULL, of another length, or hold NULL or non-finite components take no
part; rows that repeat, or share an id, are vectors of their own; of equal starting hashes the
smaller vector goes first, and a NULL id starts last; with fewer vectors than centroids there are as
many centroids as vectors; a centroid without vectors stays as it is; an empty table gives no rows;
other columns are not read. Whole components beyond 2^26 would not fit a long distance and raise.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BROADCAST_BYTES, cut, finite_vectors, matrix_of

LARGEST = 1 << 26
# Entries of a batch's table of bounds.
TABLE_CELLS = 4 << 20


# -- the tree ------------------------------------------------------------------------------------

@dataclass
class VantageTree:
    """Nodes by number, the root first. ``near`` and ``far`` are the halves' roots or -1; their
    ranges are the least and largest distance of the half's centroids to the vantage point."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    far: list[int] = field(default_factory=list)
    ranges: list[tuple[float, float, float, float]] = field(default_factory=list)

    @classmethod
    def build(cls, centroids: np.ndarray) -> VantageTree:
        tree = cls(centroids)
        todo = [(np.arange(len(centroids)), -1, "")]
        while todo:
            members, parent, side = todo.pop()
            node = len(tree.vantage)
            if parent >= 0:
                getattr(tree, side)[parent] = node
            # The member farthest from the middle sees the others at the most different distances.
            middle = centroids[members].mean(0)
            at = int(np.argmax(((centroids[members] - middle) ** 2).sum(1)))
            point, others = members[at], np.delete(members, at)
            away = np.sqrt(((centroids[others] - centroids[point]) ** 2).sum(1).astype(float))
            order = np.argsort(away, kind="stable")
            others, away, half = others[order], away[order], (len(others) + 1) // 2
            span = lambda a: (a[0], a[-1]) if len(a) else (0.0, 0.0)
            tree.vantage.append(int(point))
            tree.near.append(-1)
            tree.far.append(-1)
            tree.ranges.append((*span(away[:half]), *span(away[half:])))
            for some, name in ((others[:half], "near"), (others[half:], "far")):
                if len(some):
                    todo.append((some, node, name))
        return tree

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each vector's nearest centroid, its squared distance, and how many
        distances were evaluated in all."""
        best = np.zeros(len(x), np.int64)
        least = np.zeros(len(x), np.int64)
        evaluated = 0
        step = max(1, TABLE_CELLS // max(len(self.vantage), x.shape[1], 1))
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            best[part], least[part], n = self._search(x[part])
            evaluated += n
        return best, least, evaluated

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        vantage, near, far = (np.array(a) for a in (self.vantage, self.near, self.far))
        ranges = np.array(self.ranges)
        bounds = np.full((len(x), len(vantage)), np.inf)
        bounds[:, 0] = 0
        best = np.full(len(x), len(self.centroids), np.int64)
        least = np.full(len(x), np.iinfo(np.int64).max, np.int64)
        active, evaluated = np.arange(len(x)), 0
        while len(active):
            node = bounds[active].argmin(1)
            bound = bounds[active, node]
            radius = np.sqrt(least[active].astype(float))
            # Widened by more than the rounding of roots and differences.
            go = (bound * (1 - 1e-9) - 1e-9 <= radius) & np.isfinite(bound)
            active, node = active[go], node[go]
            bound = bound[go]
            if not len(active):
                break
            bounds[active, node] = np.inf
            point = vantage[node]
            square = ((x[active] - self.centroids[point]) ** 2).sum(1)
            evaluated += len(active)
            better = (square < least[active]) | ((square == least[active]) & (point < best[active]))
            best[active[better]], least[active[better]] = point[better], square[better]
            away, span = np.sqrt(square.astype(float)), ranges[node]
            for child, low, high in ((near, 0, 1), (far, 2, 3)):
                has = np.flatnonzero(child[node] >= 0)
                lower = np.maximum(span[has, low] - away[has], away[has] - span[has, high])
                bounds[active[has], child[node[has]]] = np.maximum(lower, bound[has])
        return best, least, evaluated


# -- the operator ----------------------------------------------------------------------------

def start_centroids(vectors: DataFrame, count: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in the order of these."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (vectors.select(key.alias("key"), "x")
             .orderBy(F.col("key").asc_nulls_last(), "x").limit(count).collect())
    return np.array([r.x for r in first], np.int64)


def _assigned(batches, tree: VantageTree, width: int):
    for batch in batches:
        x = matrix_of(batch.column("x"), width)
        if np.abs(x).max(initial=0) > LARGEST:
            raise ArithmeticError(f"a component beyond {LARGEST} gives no long distance")
        yield batch, x, *tree.nearest(x)[:2]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round of assignment."""
    count, width = centroids.shape
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree.build(centroids))

    def sums(batches):
        total, rows = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for _, x, cluster, _ in _assigned(batches, tree.value, width):
            order = np.argsort(cluster, kind="stable")
            numbers, first = np.unique(cluster[order], return_index=True)
            if len(numbers):
                total[numbers] += np.add.reduceat(x[order], first, axis=0)
                rows += np.bincount(cluster, minlength=count)
        used = np.flatnonzero(rows)
        # Component -1 is the number of vectors.
        values = np.column_stack([rows[used], total[used]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int32()),
             pa.array(np.tile(np.arange(-1, width), len(used)), pa.int32()),
             pa.array(values.ravel(), pa.int64())], names=["cluster", "i", "value"])

    parts = vectors.mapInArrow(sums, "cluster int, i int, value bigint")
    total = parts.groupBy("cluster", "i").agg(F.sum("value").alias("value")).collect()
    tree.unpersist()
    values = {(r.cluster, r.i): r.value for r in total}
    out = centroids.copy()
    for c in {r.cluster for r in total}:
        out[c] = [values[c, i] // values[c, -1] for i in range(width)]
    return out


def cluster(embeddings: DataFrame, centroids: int = 16, rounds: int = 3, width: int = 64,
            scale: int = 64, seed: str = "1") -> DataFrame:
    """Per vector: vec_id, cluster, distance, the inertia of its cluster and of all, and the digest
    of its final centroid."""
    spark = embeddings.sparkSession
    if centroids * width * 8 > BROADCAST_BYTES:
        raise ValueError("so many centroids make no broadcast")
    vectors = cut(finite_vectors(embeddings, scale).filter(F.size("x") == width))
    places = start_centroids(vectors, centroids, seed)
    if not len(places):
        return spark.createDataFrame(
            [], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                "inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        places = moved(vectors, places)
    tree = spark.sparkContext.broadcast(VantageTree.build(places))

    def nearest(batches):
        for batch, _, number, distance in _assigned(batches, tree.value, width):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number, pa.int32()),
                 pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = cut(vectors.mapInArrow(nearest, "vec_id bigint, cluster int, distance bigint"))
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(
        F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in places]
    facts = spark.createDataFrame(
        [(c, s, sum(inertia.values()), digest[c]) for c, s in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid, whose number is bounded above.
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = 16, rounds: int = 3, width: int = 64, scale: int = 64,
           seed: str = "1") -> str:
    """DuckDB SQL for the same rows over the view ``embeddings``."""
    square = (f"list_sum(list_transform(range(1, {width + 1}), "
              "lambda i: (x[i] - p[i]) * (x[i] - p[i])))")
    steps = []
    for k in range(rounds + 1):
        # The least of distance and number at once; the number is the smaller part.
        steps.append(f"""a{k} as (
            select r, any_value(x) as x, min(({square})::hugeint * {centroids} + c) as m
            from kept, c{k} group by r)""")
        if k < rounds:
            steps.append(f"""s{k} as (
                select (m % {centroids})::bigint as c, i, sum(x[i]) as s, count(*) as n
                from a{k}, range(1, {width + 1}) as t(i) group by all),
            m{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as p
                     from s{k} group by c),
            c{k + 1} as (select c{k}.c, coalesce(m{k}.p, c{k}.p) as p
                         from c{k} left join m{k} using (c))""")
    return f"""
    with kept as (
        select row_number() over () as r, vec_id,
               list_transform(embedding, lambda v: floor({scale} * v::double)::bigint) as x
        from embeddings
        where len(embedding) = {width}
          and len(list_filter(embedding, lambda v: isfinite(v))) = {width}),
    first as (select x, sha256('{seed}:' || vec_id) as h from kept
              order by h nulls last, x limit {centroids}),
    c0 as (select row_number() over (order by h nulls last, x) - 1 as c, x as p from first),
    {', '.join(steps)},
    placed as (select r, (m % {centroids})::int as cluster, (m // {centroids})::bigint as distance
               from a{rounds})
    select vec_id, cluster, distance,
           (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
           (sum(distance) over ())::bigint as inertia,
           sha256(array_to_string(p, ',')) as centroid_sha256
    from placed join kept using (r) join c{rounds} on c = cluster
    """
