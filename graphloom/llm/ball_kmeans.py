"""Ball k-means over whole-number vectors.

A cluster is a ball: its centroid and a radius that covers its members. A ball
can lose members only to neighbours, whose centroids are no farther than twice
its radius. A member nearer to its centroid than half the way to the nearest
neighbour is in the ball's stable core and stays without a comparison; the others
lie in rings, cut by half the way to each neighbour, and are compared with the
neighbours within their ring only. Distances are squared and whole, so that the
bounds are exact and every result is that of the full comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

K, ROUNDS, SCALE = 8, 10, 1024
#: Components beyond it have squared distances beyond 64 bits.
LARGEST = 1 << 26
#: Rows whose differences are held at once.
ROWS = 4096


@dataclass
class Balls:
    """Centroids, and for each a bound on the squared distance of its members (none yet: null)."""

    centroids: list[list[int]]
    radii: list[int] | None = None

    def between(self) -> np.ndarray:
        """Squared distances between centroids."""
        c = np.array(self.centroids, np.int64).reshape(len(self.centroids), -1)
        return np.stack([((c - x) ** 2).sum(1) for x in c])

    def neighbours(self) -> list[list[int]]:
        """For each ball, the others that a member may be nearer to or as near, the nearest first."""
        far = self.between()
        k = len(far)
        return [sorted((j for j in range(k) if j != i and int(far[i, j]) <= 4 * self.radii[i]), key=lambda j: (int(far[i, j]), j)) for i in range(k)]

    def moved(self, centroids: list[list[int]], radii: list[int]) -> Balls:
        """Balls about new centroids: a member's distance grows by no more than its centroid's step."""
        out = []
        for old, new, r in zip(self.centroids, centroids, radii):
            step = sum((a - b) ** 2 for a, b in zip(old, new))
            up = (math.isqrt(r) + 1 if r else 0) + (math.isqrt(step) + 1 if step else 0)
            out.append(up**2)
        return Balls(centroids, out)


def nearest(vectors: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number of equals, and the squared distance: all are compared."""
    c = np.array(balls.centroids, np.int64)
    far = np.stack([((vectors - x) ** 2).sum(1) for x in c], 1)
    best = far.argmin(1)
    return best, far[np.arange(len(far)), best]


def reassign(vectors: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for members of balls, and how many comparisons with neighbours it took."""
    c = np.array(balls.centroids, np.int64)
    far, near = balls.between(), balls.neighbours()
    best = cluster.copy()
    least = ((vectors - c[cluster]) ** 2).sum(1)
    compared = 0
    for i in np.unique(cluster).tolist():
        members = np.flatnonzero(cluster == i)
        own = least[members].copy()
        for j in near[i]:
            # what is left lies outside of the ring that ends half the way to j
            outside = 4 * own >= far[i, j]
            members, own = members[outside], own[outside]
            if not len(members):
                break
            compared += len(members)
            d = ((vectors[members] - c[j]) ** 2).sum(1)
            closer = (d < least[members]) | ((d == least[members]) & (j < best[members]))
            best[members[closer]], least[members[closer]] = j, d[closer]
    return best, least, compared


def _assign(balls: Balls):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
                if balls.radii is None:
                    best, far = nearest(v, balls)
                else:
                    best, far, _ = reassign(v, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), balls)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["id", "v", "cluster", "distance"]
                )

    return assign


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cluster's sums of components, members, radius and inertia within a task."""
    sums: dict[int, np.ndarray] = {}
    stats: dict[int, list[int]] = {}
    for batch in batches:
        cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
        far = batch.column("distance").to_numpy(zero_copy_only=False)
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
        for c in np.unique(cluster).tolist():
            mine = cluster == c
            part = v[mine].sum(0)
            sums[c] = sums[c] + part if c in sums else part
            n, top, total = stats.get(c, [0, 0, 0])
            # far from overflow: distances are below 2 ** 62, so they are added as whole numbers of any size
            stats[c] = [n + int(mine.sum()), max(top, int(far[mine].max())), total + sum(far[mine].tolist())]
    for c, total in sums.items():
        n, top, inertia = stats[c]
        size = len(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total, pa.int64()), pa.array([n] * size, pa.int64()),
                pa.array([top] * size, pa.int64()), pa.array([str(inertia)] * size),
            ],
            ["cluster", "at", "total", "n", "top", "inertia"],
        )


def _members(state: DataFrame) -> dict[int, dict]:
    """Per cluster: its members' sums, number, radius and inertia. One row for each cluster and component reaches the driver."""
    parts = state.mapInArrow(_sums, "cluster int, at int, total bigint, n bigint, top bigint, inertia string")
    whole = "decimal(38,0)"
    got = parts.groupBy("cluster", "at").agg(
        F.sum(F.col("total").cast(whole)).alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("inertia").cast(whole)).alias("inertia")
    )
    out: dict[int, dict] = {}
    for r in got.collect():
        c = out.setdefault(r.cluster, {"n": r.n, "top": r.top, "inertia": int(r.inertia), "total": {}})
        c["total"][r.at] = int(r.total)
    return out


def whole_vectors(vectors: DataFrame, key: str, vector: str, size: int, scale: int = SCALE) -> DataFrame:
    """(id, v) of vectors with exactly ``size`` finite components, each as floor(scale * x) of x as a double.

    Dropped: a null vector, one with a null, infinite or not-a-number component, of another size, or with a component beyond
    ``LARGEST`` after scaling, whose squared distances 64 bits can't hold.
    """
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    real = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale <= LARGEST))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == size)).where(F.coalesce(real, F.lit(False)))
    return kept.select(F.col(key).alias("id"), F.transform(x, lambda c: c.cast("int")).alias("v"))


def seeds(rows: DataFrame, k: int, order: Column) -> list[list[int]]:
    """The ``k`` first vectors in the given order, equals by their components."""
    return [list(r.v) for r in rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def cluster(rows: DataFrame, starts: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, Balls, dict[int, dict]]:
    """(id, v, cluster, distance) of every row of (id, v) after ``rounds`` rounds, the last balls, and what is known of each.

    Each round reads the members with their last cluster, writes them with the
    new one, and adds up sums and radii; centroids become the floor of the mean, an
    empty cluster keeps its own. Rounds end when no centroid moves, as no later
    one would change anything. Equal distances go to the smaller number. No vectors
    or no starts give an empty table. Repeated rows count as often as they are there.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, v array<int>, cluster int, distance bigint"
    state = rows.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("bigint")})
    if not starts:
        return state.limit(0), Balls([]), {}
    balls, owned = Balls(starts), []
    for i in range(rounds + 1):
        new = materialize(state.mapInArrow(_assign(balls), schema))
        known = _members(new)
        discard(*owned)
        state, owned = new, [new]
        if i == rounds:
            break
        means = [[known[c]["total"][a] // known[c]["n"] for a in range(len(x))] if c in known else x for c, x in enumerate(balls.centroids)]
        if means == balls.centroids:
            break
        balls = balls.moved(means, [known[c]["top"] if c in known else 0 for c in range(len(means))])
    return state, balls, known


def clusters(
    vectors: DataFrame, size: int, order: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Per vector kept by :func:`whole_vectors`: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Starts are the first ``k`` vectors by ``order``, an expression of ``id`` (fewer
    vectors: fewer clusters); equal ones by components. A null key stays null and
    comes last; repeated rows give repeated results; an empty table gives an empty
    result; other columns are ignored. Vectors are as long as ``size`` says, so no row is
    longer than another. Distances are squared.
    """
    rows = materialize(whole_vectors(vectors, key, vector, size, scale))
    state, balls, known = cluster(rows, seeds(rows, k, order), rounds)
    if balls.centroids:
        discard(rows)
    total = sum(c["inertia"] for c in known.values())
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in balls.centroids]
    spark = vectors.sparkSession
    # one row for each cluster
    facts = spark.createDataFrame([(c, known[c]["inertia"], total, digest[c]) for c in sorted(known)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
