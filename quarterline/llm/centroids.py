"""Exact centroid clustering of integer vectors with a vantage-point tree over the centroids.

Vectors are scaled and floored to integers, so every distance and sum is exact and a result
doesn't depend on the order of rows or on lost executors. Each round the driver builds a
vantage-point tree over the centroids (a parameter's worth of rows) and broadcasts it. A task
answers its vectors by best-first branch and bound:

* an inner node holds a vantage centroid and two halves of the rest with the least and greatest
  distance of each half from the vantage centroid; a leaf holds up to LEAF centroids;
* a vector always opens the node with its least lower bound, and stops when that bound exceeds
  its best distance. The radius is inclusive (and widened by the rounding error of a square
  root), so a centroid at the same distance is still met and the smaller number wins;
* distances to vantage and leaf centroids are exact 64-bit integer sums.

The search runs for a batch of vectors at a time, each following its own order of nodes. Partial
sums are added up within a task, and only ``clusters x components`` numbers leave it.

Cases: null vectors, vectors of another length and vectors with a null, NaN or infinite component
are left out; a component whose scaled value is over ``2**27`` in size is refused with an error,
as its squared distance wouldn't fit 64 bits; repeated rows count as often as they occur; a null id is
hashed as an empty one; equal hashes (repeated ids) are taken in order of the vectors; fewer kept vectors than clusters give as many
centroids as vectors; a centroid nobody is nearest to stays; empty tables give empty results;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.llm.common import fixed, query, table

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1:"
#: Centroids in a leaf of the tree.
LEAF = 3
#: Largest scaled component: 64 * (2 * 2**27)**2 stays within 63 bits.
LARGEST = 1 << 27
#: Vectors searched together.
BLOCK = 4096


@dataclass
class Node:
    """Centroid numbers held here (the vantage first, or a leaf's) and children with their shells."""

    members: list[int]
    children: list[tuple[int, float, float]] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes of the tree; the first is the root. The vantage is the member farthest from the mean."""
    nodes: list[Node] = []

    def add(members: np.ndarray) -> int:
        at = len(nodes)
        if len(members) <= leaf:
            nodes.append(Node([int(m) for m in members]))
            return at
        points = centroids[members].astype(float)
        spread = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        vantage = int(members[int(spread.argmax())])
        rest = members[members != vantage]
        far = squared(centroids[rest], centroids[vantage][None, :])
        order = np.argsort(far, kind="stable")
        nodes.append(Node([vantage]))
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            if len(half):
                shell = np.sqrt(far[half].astype(float))
                nodes[at].children.append((add(rest[half]), float(shell.min()), float(shell.max())))
        return at

    if len(centroids):
        add(np.arange(len(centroids)))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and exact squared distance to each vector's nearest centroid, and distances computed."""
    n, work = len(vectors), 0
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, len(centroids), np.int64)
    bound = np.full((n, len(tree)), np.inf)  # lower bounds of open nodes, infinite for closed ones
    bound[:, 0] = 0.0
    active = np.arange(n)
    while len(active):
        at = bound[active].argmin(axis=1)
        low = bound[active, at]
        radius = np.sqrt(best[active].astype(float))
        go = low <= radius * (1 + 1e-9) + 1e-6  # inclusive, and safe against rounding
        active, at = active[go], at[go]
        if not len(active):
            break
        bound[active, at] = np.inf
        for i in np.unique(at):
            rows = active[at == i]
            for m in tree[i].members:
                d = squared(vectors[rows], centroids[m][None, :])
                work += len(rows)
                better = (d < best[rows]) | ((d == best[rows]) & (m < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], m
            if tree[i].children:  # ``d`` is the distance to the vantage
                away = np.sqrt(d.astype(float))
                for child, lo, hi in tree[i].children:
                    slack = 1e-9 * (away + hi) + 1e-6
                    bound[rows, child] = np.maximum(0.0, np.maximum(lo - away, away - hi) - slack)
    return number, best, work


def whole_vectors(df: DataFrame, ident: str, vector: str, size: int) -> DataFrame:
    """``id, v`` of the rows with exactly ``size`` finite components."""
    v = F.col(f"`{vector}`")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.select(F.col(f"`{ident}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == size) & ~F.exists("v", bad))


def scaled(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = np.floor(scale * x)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a scaled component is over {LARGEST} in size")
    return x.astype(np.int64)


@dataclass
class Clustering:
    """``assigned`` (id, cluster, distance) and the final centroids."""

    assigned: DataFrame
    centroids: np.ndarray


def _first(kept: DataFrame, clusters: int, size: int, scale: int, seed: str) -> np.ndarray:
    """The vectors whose seeded id hash is smallest, in order of the hash."""
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return scaled(pa.array([r.v for r in rows], pa.list_(pa.float64())), size, scale) if rows else np.zeros((0, size), np.int64)


def cluster(
    vectors: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    size: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = SEED,
) -> Clustering:
    """Assign all vectors after ``rounds`` updates; the assignment is written to the shared folder."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, ident, vector, size)
    centroids = _first(kept, clusters, size, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast((centroids, build_tree(centroids)))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, tree = sent.value
            total, count = np.zeros((len(now), size), np.int64), np.zeros(len(now), np.int64)
            for x in _blocks(batches, size, scale):
                number, _, _ = nearest(x, now, tree)
                for c in np.unique(number):
                    mine = x[number == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict(
                {"c": used.astype(np.int32), "n": count[used], "s": pa.array(list(total[used]), pa.list_(pa.int64()))}
            )

        parts = kept.select("v").mapInArrow(sums, "c int, n bigint, s array<bigint>")
        exact = "decimal(38,0)"
        each = parts.select("c", "n", F.posexplode("s").alias("p", "x")).groupBy("c", "p").agg(
            F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x")
        )
        centroids = centroids.copy()
        for r in each.collect():  # clusters x components rows
            centroids[r.c, r.p] = int(r.x) // int(r.n)
        sent.unpersist()
    sent = spark.sparkContext.broadcast((centroids, build_tree(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = sent.value
        for batch in batches:
            x = scaled(batch.column("v"), size, scale)
            found = [nearest(x[i : i + BLOCK], now, tree) for i in range(0, len(x), BLOCK)]
            number = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            best = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    return Clustering(fixed(kept.mapInArrow(assign, f"id {kind}, cluster int, distance bigint")), centroids)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = scaled(batch.column("v"), size, scale)
        for i in range(0, len(x), BLOCK):
            yield x[i : i + BLOCK]


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def with_inertia(result: Clustering, ident: str = "vec_id") -> DataFrame:
    """The assignment with its cluster's and the whole inertia and the centroid's digest."""
    spark = result.assigned.sparkSession
    each = result.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row per cluster
    whole = sum(r.s for r in each)
    rows = [(r.cluster, r.s, whole, centroid_digest(result.centroids[r.cluster])) for r in each]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return result.assigned.withColumnRenamed("id", ident).join(F.broadcast(facts), "cluster").select(
        ident, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_sql(vectors: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by brute force: all distances in every round."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM {vectors} WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v) ORDER BY h, v LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, vec_id, v, b.d AS d, b.k AS k FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(v.v) AS v,
  min(struct_pack(d := list_sum(list_transform(list_zip(v.v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := k)) AS b FROM v, c{i} GROUP BY r))""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({COMPONENTS})) AS p FROM a{i}) GROUP BY k, p)""")
            steps.append(f"""m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY p) AS c FROM s{i} GROUP BY k)""")
            steps.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


@query("op13_centroid_clustering", cluster_sql())
def op13_centroid_clustering(spark, sf_dir):
    return with_inertia(cluster(table(spark, sf_dir, "embeddings")))
