"""Centroid clustering with the threshold algorithm for the nearest centroid.

Each dimension has the centroids' values in a sorted list.  For a vector every list is walked
outward from the vector's own value, one centroid a step, the nearer side first; a centroid met
for the first time has its exact distance computed.  What was not met yet is in no list nearer
than the frontier, so the sum of the squared frontier distances bounds it from below: the walk
ends when that sum strictly exceeds the best exact distance, so equal distances are all seen.

Vectors stay where they are read: a task sends the sums of its vectors for each centroid and
dimension, and what returns to the driver are these few sums added up, as many as there are
centroids times dimensions at every size of the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.scratch import Scratch

CLUSTERS, DIMENSIONS, ROUNDS = 40, 64, 5
SCALE = 256
SEED = "2:"
"""Starting centroids are the vectors with the smallest SHA-256 of this and their id."""
BOUND = 1 << 27
"""Components beyond it after scaling count as it: 64 squared differences fit a long."""
_FAR = np.int64(2**62)


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the centroids in ascending order of their value, and the values."""
    order = np.argsort(centroids, axis=0, kind="stable")
    return order, np.take_along_axis(centroids, order, axis=0)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smallest of equal ones), its squared distance,
    and how many exact distances were computed."""
    n, dims = vectors.shape
    k = len(centroids)
    order, values = sorted_lists(centroids)
    # The first place in each list at or above the vector's value; the walk goes both ways.
    right = np.empty((n, dims), dtype=np.int64)
    for d in range(dims):
        right[:, d] = np.searchsorted(values[:, d], vectors[:, d])
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max)
    which = np.full(n, k, dtype=np.int64)
    seen = np.zeros((n, k), dtype=bool)
    alive = np.arange(n)
    column = np.arange(dims)
    for _ in range(k):
        if not len(alive):
            break
        at, lo, hi = vectors[alive], left[alive], right[alive]
        below = np.where(lo >= 0, at - values[np.maximum(lo, 0), column], _FAR)
        above = np.where(hi < k, values[np.minimum(hi, k - 1), column] - at, _FAR)
        down = below <= above
        step = np.where(down, lo, hi)
        met = order[step, column]
        left[alive] = lo - down
        right[alive] = hi + ~down
        fresh = np.zeros((len(alive), k), dtype=bool)
        fresh[np.arange(len(alive))[:, None], met] = True
        fresh &= ~seen[alive]
        seen[alive] |= fresh
        row, centre = np.nonzero(fresh)
        for low in range(0, len(row), 1 << 14):
            r, c = row[low : low + (1 << 14)], centre[low : low + (1 << 14)]
            exact = ((at[r] - centroids[c]) ** 2).sum(axis=1)
            _keep_best(best, which, alive[r], c, exact)
        frontier = np.minimum(below, above)
        alive = alive[(frontier**2).sum(axis=1) <= best[alive]]
    return which, best, seen.sum(axis=1)


def _keep_best(best, which, rows, centre, exact) -> None:
    """Lower the best distance of rows; of equal ones the smallest centroid stays."""
    order = np.lexsort((centre, exact, rows))
    rows, centre, exact = rows[order], centre[order], exact[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    rows, centre, exact = rows[first], centre[first], exact[first]
    better = (exact < best[rows]) | ((exact == best[rows]) & (centre < which[rows]))
    best[rows[better]], which[rows[better]] = exact[better], centre[better]


def _vectors(batch, column: str, dims: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigner(centroids: np.ndarray):
    """Task: each vector's cluster and distance."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                which, best, _ = nearest(_vectors(batch, "v", centroids.shape[1]), centroids)
                ids = batch.column(batch.schema.get_field_index("vec_id"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(which.astype(np.int32)), pa.array(best)],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def _adder(centroids: np.ndarray):
    """Task: how many vectors each cluster has, and their sum."""
    import pyarrow as pa

    def run(batches):
        k, dims = centroids.shape
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch, "v", dims)
                which, _, _ = nearest(vectors, centroids)
                count += np.bincount(which, minlength=k)
                np.add.at(sums, which, vectors)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(sums[some]), type=pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return run


class Clustering:
    """Vectors of ``DIMENSIONS`` integers and centroids that move for some rounds."""

    def __init__(self, rows: DataFrame, clusters: int, dims: int, scratch: Scratch):
        small_batches(rows.sparkSession)
        scaled = F.transform(
            "embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
        )
        # A NaN is greater than any number for Spark; x - x is not 0 for NaN and infinities.
        whole = F.forall("embedding", lambda x: F.coalesce((x - x) == 0, F.lit(False)))
        kept = rows.where((F.size("embedding") == dims) & whole)
        self.rows = scratch.write(
            kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")), "vectors"
        )
        name = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
        first = self.rows.orderBy(name.asc_nulls_last(), "v").limit(clusters).select("v").collect()
        self.centroids = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dims)

    def move(self) -> None:
        """One round: assign every vector, then move each centroid to the floor of the mean."""
        parts = self.rows.select("v").mapInArrow(
            _adder(self.centroids), "cluster int, n long, sums array<long>"
        )
        wide = "decimal(38,0)"
        flat = parts.select("cluster", "n", F.posexplode("sums").alias("d", "x"))
        total = flat.groupBy("cluster", "d").agg(
            F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("x").cast(wide)).alias("x")
        )
        moved = self.centroids.copy()
        for r in total.collect():
            moved[r.cluster, r.d] = int(r.x) // int(r.n)
        self.centroids = moved

    def assigned(self) -> DataFrame:
        """``vec_id``, ``cluster``, ``distance`` of every vector."""
        return self.rows.mapInArrow(
            _assigner(self.centroids), "vec_id long, cluster int, distance long"
        )


def cluster_vectors(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    dims: int = DIMENSIONS,
    rounds: int = ROUNDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row per vector of ``dims`` finite components: ``vec_id``, ``cluster``, ``distance``,
    ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Other vectors (null, shorter, longer, with a null or non-finite component) are left out.
    Components are floored after scaling by 256.  With fewer vectors than ``clusters`` there are as
    many centroids as vectors; of equal centroids the later ones stay empty and where they are.
    A vector without id is assigned like any other, but starts a centroid only after all
    with one; repeated rows stay repeated; rows of one id start in the order of their
    components.  Sums beyond a long are null.  An empty table gives no row; further columns
    are ignored.
    """
    scratch = scratch or Scratch(embeddings.sparkSession)
    work = Clustering(embeddings, clusters, dims, scratch)
    for _ in range(rounds if len(work.centroids) else 0):
        work.move()
    rows = scratch.write(work.assigned(), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(total.alias("s")).collect()
    every = sum(int(r.s) for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in work.centroids.tolist()]
    fits = {r.cluster: int(r.s) if r.s < 1 << 63 else None for r in sums}
    table = rows.sparkSession.createDataFrame(
        [(r, fits[r], every if every < 1 << 63 else None, digests[r]) for r in sorted(fits)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
