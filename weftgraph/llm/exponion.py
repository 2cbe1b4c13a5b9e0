"""Centroid clustering with exponion search.

Every vector carries its cluster, an upper bound on the distance to that cluster's centroid and a lower
bound on the distance to any other.  When centroids move, the bounds move with them.  A vector whose upper
bound is below its lower bound, or below half the way from its centroid to the nearest other one, keeps its
cluster unseen.  Else the upper bound u is made tight, and centroids are looked at only inside a ball of
radius 2 u + s around the vector's centroid, s being the way to the nearest other centroid: a prefix of that
centroid's list of the others by distance.  The ball holds the nearest and the second nearest centroid, so
the new bounds hold as well; its edge counts as inside, and bounds are rounded outwards, so ties are seen.

Distances are compared as exact squares of integers.  The centroids (k times dims numbers) are all that the
driver holds; vectors and bounds stay in a table that is written once a round.

Defined results: rows whose vector is null, has another length, or holds a null or non-finite entry are
left out.  Entries too large for squared distances within 64 bits are cut to the largest that isn't (for 64
components beyond about 2.9 million before scaling).  Fewer vectors than k: as many centroids as vectors; none: no rows.  Repeated rows are vectors
each; among equal hashes, as repeated identifiers have, the smaller vector comes first; null identifiers
come last.  A sum of distances beyond 64 bits is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import bounded_batches, checkpointed
from weftgraph.llm._vectors import integers, matrix

#: Bounds are widened by this share: far more than square roots and sums of doubles can be off.
SLACK = 1e-9
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"


def squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to one centroid each."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def up(d: np.ndarray) -> np.ndarray:
    return d * (1 + SLACK)


def down(d: np.ndarray) -> np.ndarray:
    return d * (1 - SLACK)


class Centroids:
    """Centroids, how far each has moved, and for each the others by distance."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        between = np.sqrt(np.stack([squares(now, c) for c in now]).astype(np.float64)) if k else np.empty((0, 0))
        np.fill_diagonal(between, -1)
        self.others = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.ways = down(np.take_along_axis(between, self.others, axis=1))
        self.nearest = self.ways[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = up(np.sqrt(squares(now, before).astype(np.float64))) if before is not None else np.zeros(k)
        order = np.argsort(-self.moved)
        self.moved_most = np.full(k, self.moved[order[0]] if k else 0.0)
        if k:
            self.moved_most[order[0]] = self.moved[order[1]] if k > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster and bounds by looking at every centroid, for vectors that have none yet."""
        best, second, cluster = squares(x, self.now[0]), np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for j in range(1, len(self.now)):
            self._look(x, np.arange(len(x)), j, best, second, cluster)
        return cluster, up(np.sqrt(best.astype(np.float64))), down(np.sqrt(second))

    def _look(self, x: np.ndarray, rows: np.ndarray, j: int, best: np.ndarray, second: np.ndarray, cluster: np.ndarray) -> int:
        """Take centroid j into account for some rows."""
        d = squares(x[rows], self.now[j])
        nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        second[rows] = np.where(nearer, best[rows], np.minimum(second[rows], d))
        best[rows[nearer]] = d[nearer]
        cluster[rows[nearer]] = j
        return len(rows)

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster and bounds after the move, and how many distances were computed."""
        cluster, upper, lower = cluster.copy(), up(upper + self.moved[cluster]), lower - self.moved_most[cluster]
        lower = np.where(lower > 0, down(lower), lower)
        enough = np.maximum(lower, self.nearest[cluster] / 2)
        open_ = np.flatnonzero(~(upper < enough))
        if not len(open_):
            return cluster, upper, lower, 0
        exact = squares(x[open_], self.now[cluster[open_]])
        looked = len(open_)
        upper[open_] = up(np.sqrt(exact.astype(np.float64)))
        still = ~(upper[open_] < enough[open_])
        rows, best = open_[still], exact[still]
        x, home = x[rows], cluster[rows]
        found, second = home.copy(), np.full(len(rows), np.inf)
        radius = up(2 * upper[rows] + self.nearest[home] * (1 + 4 * SLACK))
        for a in np.unique(home):
            mine = np.flatnonzero(home == a)
            inside = np.searchsorted(self.ways[a], radius[mine], side="right")
            for p in range(int(inside.max(initial=0))):
                looked += self._look(x, mine[inside > p], int(self.others[a, p]), best, second, found)
        cluster[rows], upper[rows], lower[rows] = found, up(np.sqrt(best.astype(np.float64))), down(np.sqrt(second))
        return cluster, upper, lower, looked


def _start(rows: DataFrame, k: int, salt: str, dims: int) -> np.ndarray:
    """The k vectors whose salted identifiers have the smallest hashes."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(by.asc_nulls_last(), "x").limit(k).select("x").toArrow()
    return np.array(first.column(0).to_pylist(), dtype=np.int64).reshape(-1, dims)


def _assign(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """The state of every vector under centroids that are new (no bounds yet) or have moved."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(STATE))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    fresh = "cluster" not in rows.columns

    def run(batches):
        at = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            if fresh:
                state = at.scan(x)
            else:
                state = at.search(x, *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))[:3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), *(pa.array(c, f.type) for c, f in zip(state, list(schema)[2:]))], schema=schema)

    return rows.mapInArrow(run, STATE)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; a cluster without vectors keeps its centroid."""
    k, dims = before.shape

    def add(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                cluster = b.column(0).to_numpy()
                np.add.at(sums, cluster, matrix(b.column(1)))
                counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(add, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = before.copy()
    for c, d, n, s in total.toLocalIterator():
        out[c, d] = s // n
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = df.sparkSession
    bounded_batches(spark)
    limit = math.isqrt(((1 << 63) - 1) // max(dims, 1)) // 2
    rows = checkpointed(integers(df, id_col, vec_col, scale, 0, limit, "int").where(F.size("x") == dims), "vectors")
    now = _start(rows, k, salt, dims)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = checkpointed(_assign(rows, Centroids(now)), "assigned")
    for _ in range(rounds):
        before, now = now, _means(state, now)
        state = checkpointed(_assign(state, Centroids(now, before)), "assigned")

    shared = spark.sparkContext.broadcast(now)

    def measure(batches):
        for b in batches:
            if b.num_rows:
                at = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(squares(matrix(b.column(1)), shared.value[at]))], ["vec_id", "cluster", "distance"])

    measured = checkpointed(state.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "measured")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    of = measured.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # k rows at most
    inertia = measured.agg(F.try_sum("distance")).first()[0]
    out = measured.join(F.broadcast(of), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"))


def sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:") -> str:
    """The same by plain scans of all centroids."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, v.x, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(1, {dims} + 1)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)"""
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
    )
