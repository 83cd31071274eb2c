"""Centroid clustering of integer vectors, with centroids filtered by N-simplex bounds.

The distances of a vector to a few pivots are computed once and kept as the apex coordinates of
a simplex over the pivots. Between two apexes, the Euclidean distance bounds the true one from
below, and with one apex mirrored at the base from above. In each round only centroids whose
lower bound does not exceed the least upper bound are compared, in exact integers.

Vectors are never shuffled: a task sends one partial sum per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.common import materialize, table

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 8
SCALE = 256
FLATTEST = 0.05     # a pivot's height over the others, at least, as a share of the first distance
SLACK = 1e-6        # what rounding may move a squared bound by, as a share of the squared norms
MAX_COMPONENT = 1 << 27  # beyond, a squared distance might not fit into a long
ROWS_AT_ONCE = 4096


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, v (array<int>) of the rows of ``vectors`` that hold ``dimensions`` finite components.

    A component x becomes floor(256 * x), x as double. One of more than MAX_COMPONENT fails the
    query, as its squared distances fit no long. Other columns are ignored.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # In a CASE, as Spark may not keep the order of two conditions.
    kept = F.when(F.size("embedding") == dimensions, whole).otherwise(False)

    def scaled(x):
        y = F.floor(x.cast("double") * SCALE)
        far = F.raise_error(F.lit(f"a component lies beyond {MAX_COMPONENT // SCALE}"))
        return F.when(F.abs(x.cast("double")) < MAX_COMPONENT // SCALE, y.cast("int")).otherwise(far.cast("int"))

    return vectors.where(kept).select("vec_id", F.transform("embedding", scaled).alias("v"))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two int64 matrices, exact."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


@dataclass(frozen=True)
class Simplex:
    """Pivots (int64 rows) and the base simplex over them; vertex i has i coordinates."""

    pivots: np.ndarray
    base: np.ndarray  # lower triangular: row i holds the coordinates of pivot i, its height last

    @classmethod
    def over(cls, points: np.ndarray, count: int = PIVOTS) -> Simplex:
        """Of ``points`` those that stand highest over the ones chosen before, ``count`` at most.

        Nearly flat ones would magnify rounding and are left out, so fewer than ``count``, even
        one, may remain."""
        own = cls(points[:1], np.zeros((1, 1)))
        while len(own.pivots) < min(count, len(points)):
            apex = own.project(points)
            best = int(np.argmax(apex[:, -1]))
            if apex[best, -1] < FLATTEST * max(1.0, float(np.sqrt((apex ** 2).sum(1).max()))):
                break
            n = len(own.pivots)
            base = np.zeros((n + 1, n + 1))
            base[:n, :n] = own.base
            base[n, :n] = apex[best]
            own = cls(np.vstack([own.pivots, points[best]]), base)
        return own

    def project(self, points: np.ndarray) -> np.ndarray:
        """Apex coordinates of each row: one per pivot, the last the height over the base."""
        d2 = _squared(points, self.pivots).astype(np.float64)
        n = len(self.pivots)
        out = np.zeros((len(points), n))
        for i in range(1, n):  # pivot i has coordinates base[i, :i], the last of them not 0
            s = self.base[i, :i]
            known = out[:, :i - 1] @ s[:-1]
            out[:, i - 1] = (d2[:, 0] - d2[:, i] + (s ** 2).sum() - 2 * known) / (2 * s[-1])
        out[:, n - 1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, :n - 1] ** 2).sum(1), 0))
        return out


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the squared distances, rounding included."""
    low = np.zeros((len(apexes), len(centres)))
    for j in range(apexes.shape[1]):
        low += (apexes[:, j, None] - centres[None, :, j]) ** 2
    high = low + 4 * apexes[:, -1, None] * centres[None, :, -1]
    slack = SLACK * (1 + (apexes ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :])
    return low - slack, high + slack


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray,
            simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties: the smaller number."""
    low, high = bounds(apexes, simplex.project(centroids))
    open_ = low <= high.min(1, keepdims=True)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    at = np.zeros(len(vectors), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        d = ((vectors[rows] - centroids[c]) ** 2).sum(1)
        less = d < best[rows]
        at[rows[less]], best[rows[less]] = c, d[less]
    return at, best


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def with_apexes(ints: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, v and ``apex`` (array<double>), one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            apex = simplex.project(_matrix(batch.column("v"), np.int64))
            flat = pa.array(apex.ravel())
            ends = pa.array(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "v", "apex"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    return ints.mapInArrow(run, f"vec_id {kind}, v array<int>, apex array<double>")


def sums(points: DataFrame, centroids: np.ndarray, simplex: Simplex) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (rows, componentwise sum)} of the nearest centroids; a row per cluster and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in _parts(batches):
            v = _matrix(batch.column("v"), np.int64)
            at, _ = nearest(v, _matrix(batch.column("apex"), np.float64), centroids, simplex)
            n += np.bincount(at, minlength=len(centroids))
            np.add.at(total, at, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]),
                                          "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = points.mapInArrow(run, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(centroids.shape[1]))))
    return {r[0]: (r[1], r[2]) for r in added.collect()}  # a row per centroid


def cluster(vectors: DataFrame, *, seed: int = 2, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every kept row; final centroids).

    Starting centroids are the kept rows of least sha256 of ``seed:vec_id`` (a null vec_id reads
    ``null``; ties: the smaller vector), fewer than ``clusters`` where there are fewer rows.
    Repeated rows count each. A mean is the exact floor(sum/count); a centroid without rows
    stays. Without a kept row the result is empty.
    """
    ints = integer_vectors(vectors, dimensions)
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    starts = ints.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()  # a bounded number
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not starts:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    centroids = np.array([r["v"] for r in starts], np.int64)
    simplex = Simplex.over(centroids, pivots)
    points = materialize(with_apexes(ints, simplex), "apexes")
    for _ in range(rounds):
        for c, (n, total) in sums(points, centroids, simplex).items():
            centroids[c] = [x // n for x in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            at, d = nearest(_matrix(batch.column("v"), np.int64), _matrix(batch.column("apex"), np.float64), centroids, simplex)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(d)],
                                             names=["vec_id", "cluster", "distance"])

    out = materialize(points.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    return out, centroids.tolist()


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, with each cluster's and the whole inertia."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    parts = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row per centroid
    rows = [(c, parts[c], hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids) if c in parts]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(parts.values())).cast("long").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """The rounds in DuckDB SQL, every vector against every centroid."""
    def near(centres: str) -> str:
        # 64 numbers leave room for the centroid's own below the distance.
        return f"""
  SELECT id, vec_id, v, min(d * 64 + c) // 64 AS distance, (min(d * 64 + c) % 64)::INTEGER AS cluster
  FROM (SELECT id, vec_id, k.v AS v, c, list_sum(list_transform(list_zip(k.v, z.v), lambda p: (p[1] - p[2]) ** 2))::HUGEINT AS d
        FROM kept k, {centres} z) GROUP BY ALL"""

    ctes = [r"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE CASE WHEN len(embedding) = 64 THEN
    len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 END),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1)::INTEGER AS c, v
  FROM kept QUALIFY c < 40)"""]
    for r in range(ROUNDS):
        ctes.append(f"""
a{r} AS MATERIALIZED ({near(f'c{r}')}),
m{r} AS (
  SELECT cluster AS c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) g(i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v)::BIGINT[] AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH {','.join(ctes)},
done AS MATERIALIZED ({near(f'c{ROUNDS}')})
SELECT vec_id, cluster, distance::BIGINT AS distance,
       sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM done JOIN c{ROUNDS} ON c = cluster
"""


QUERIES = {"op11_centroid_clusters": op11_centroid_clusters}
ORACLE_SQL = {"op11_centroid_clusters": _sql()}
