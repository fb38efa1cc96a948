"""Centroid clustering with Orchard search for the nearest centroid, in exact integers.

Each centroid has a list of the others in ascending distance from it. A vector begins at some centroid and goes down
that centroid's list; where it finds a nearer one it jumps to that one's list. It has found its nearest once the next
entry of a list lies strictly beyond twice its distance (four times, as distances are squared): the triangle inequality
rules out the rest, ties included. Centroids that it has met are marked and not measured again. All vectors of a slice
take their steps together. A vector begins where the centroid's length is nearest to its own.

Vectors become integers once, in a written table; each round reads it, assigns in Arrow batches and leaves one row of
sums per task and centroid, so what is shuffled and seen by the driver follows the centroids, not the vectors. Lists of
k centroids take k * k entries in each worker.

Vectors with another number of components, or with a null or non-finite one, are left out. Of those that stay, ones with
a component of `far` or more once scaled (131,072 before, at the scale of 1024) could have distances beyond a long: they
return with null cluster and distance and move no centroid. Rows are vectors: repeated rows and ids count as often as
they come, null ids pass through and are no first centroids. First centroids of equal hash are taken in order of their
components. Fewer vectors than centroids make as many centroids; an empty table gives an empty result. Equal distances
go to the smaller number. Extra columns are ignored. Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.tables import Scratch, bounded_batches, table

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
FAR = 1 << 27  # squared distances of 64 differences below 2 * FAR fit a long
SLICE = 4096  # vectors that step together
LONG = (1 << 63) - 1


class Search:
    """Nearest of some centroids (integers, one a row)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        gaps = np.stack([self.squared(centroids - c) for c in centroids])
        order = np.argsort(gaps, axis=1, kind="stable")
        self.lists = order[order != np.arange(k)[:, None]].reshape(k, k - 1)
        # gap <= 4 * distance, without the product
        self.quarter = (np.take_along_axis(gaps, self.lists, axis=1) + 3) // 4
        lengths = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
        self.by_length = np.argsort(lengths, kind="stable")
        self.between = (lengths[self.by_length][1:] + lengths[self.by_length][:-1]) / 2
        self.measured = 0

    @staticmethod
    def squared(difference: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", difference, difference)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector; of equally near ones the smaller number."""
        n, k = len(vectors), len(self.centroids)
        at = self.by_length[np.searchsorted(self.between, np.sqrt((vectors.astype(float) ** 2).sum(axis=1)))]
        distance = self.squared(vectors - self.centroids[at])
        marked = np.zeros((n, k), bool)
        marked[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n if k > 1 else 0)
        self.measured += n
        while len(live):
            live = live[self.quarter[at[live], place[live]] <= distance[live]]
            other = self.lists[at[live], place[live]]
            place[live] += 1
            new = ~marked[live, other]
            rows, other = live[new], other[new]
            marked[rows, other] = True
            found = self.squared(vectors[rows] - self.centroids[other])
            self.measured += len(rows)
            better = (found < distance[rows]) | ((found == distance[rows]) & (other < at[rows]))
            rows = rows[better]
            at[rows], distance[rows], place[rows] = other[better], found[better], 0
            live = live[place[live] < k - 1]
        return at, distance


def slices(batch: pa.RecordBatch, place: int, dims: int):
    """((first row, rows), vectors as 64-bit integers) of runs of rows."""
    for i in range(0, batch.num_rows, SLICE):
        part = batch.column(place).slice(i, SLICE)
        yield (i, len(part)), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dims)


def integers(rows: DataFrame, dims: int = DIMS, scale: float = SCALE, far: int = FAR) -> DataFrame:
    """Rows (vec_id, v) of rows (vec_id, embedding): array<int>, null where a component is too far."""
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    near = F.forall("x", lambda x: F.abs(x) * float(scale) < float(far))
    return kept.select("vec_id", F.when(near, F.transform("x", lambda x: F.floor(x * float(scale)).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.where("vec_id is not null and v is not null").orderBy(order, "v").limit(k).select("v").collect()
    return np.array([r.v for r in found], np.int64)


def means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of what each got, or the old one."""
    k, dims = centroids.shape

    def run(stream):
        search, sums, counts = Search(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in stream:
            for _, rows in slices(batch, 0, dims):
                at, _ = search.nearest(rows)
                np.add.at(sums, at, rows)
                counts += np.bincount(at, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(some)), pa.int32()), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], dims))], names=["cluster", "dim", "total", "n"])

    parts = vectors.where("v is not null").select("v").mapInArrow(run, "cluster int, dim int, total long, n long")
    out = centroids.copy()
    # A row for each component of each centroid.
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance) of rows (vec_id, v)."""
    dims = centroids.shape[1]

    def run(stream):
        search = Search(centroids)
        for batch in stream:
            for place, rows in slices(batch, 1, dims):
                at, distance = search.nearest(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*place), pa.array(at, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = "vec_id long, cluster int, distance long"
    return vectors.where("v is not null").select("vec_id", "v").mapInArrow(run, schema).unionByName(vectors.where("v is null").selectExpr("vec_id", "int(null) as cluster", "bigint(null) as distance"))


def train(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids after the rounds; once none moves, further rounds would change nothing and are left out."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = means(vectors, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def cluster(rows: DataFrame, dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: str = SEED) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid array<long>) of rows (vec_id, embedding)."""
    spark, far = rows.sparkSession, min(FAR, int((LONG // dims) ** 0.5) // 2)
    bounded_batches(spark, SLICE)
    scratch = Scratch(spark, "orchard")
    vectors = scratch.keep(integers(rows, dims, scale, far))
    centroids = train(vectors, k, rounds, seed)
    if not len(centroids):
        found = vectors.selectExpr("vec_id", "int(null) as cluster", "bigint(null) as distance")
        return found.selectExpr("*", "bigint(null) as cluster_inertia", "bigint(null) as inertia", "string(null) as centroid_sha256", "cast(null as array<bigint>) as centroid")
    found = scratch.keep(assign(vectors, centroids))
    sums = {r.cluster: int(r.s) for r in found.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x <= LONG else None
    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of([fits(sums.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.when(F.col("cluster").isNotNull(), F.lit(fits(sum(sums.values()))).cast("long")).alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
        F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<bigint>") for c in centroids.tolist()]), F.col("cluster")).alias("centroid"),
    )


def op12_orchard_clusters(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def sql_rounds(rounds: int = ROUNDS, dims: int = DIMS, k: int = CENTROIDS) -> str:
    """DuckDB: each round one step, with every distance written out."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"parts AS MATERIALIZED (SELECT row, i, v[i] AS x FROM kept, (SELECT unnest(range(1, {dims + 1})) AS i))",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, row FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM first JOIN parts USING (row))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT row, c, sum((x - y) * (x - y)) AS d FROM parts JOIN c{r} USING (i) GROUP BY row, c) GROUP BY row)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN parts USING (row) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n + n) % n)) // n END AS y FROM c{r} LEFT JOIN s{r} USING (c, i))")
    return f"""
        WITH {", ".join(steps)},
        digest AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (row) JOIN digest USING (c)
    """


QUERIES = {"op12_orchard_clusters": op12_orchard_clusters}
ORACLES = {"op12_orchard_clusters": sql_rounds()}
