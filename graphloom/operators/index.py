"""A vector index of cells: centroids fitted on a sample, every row assigned, the nearest cells probed."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import PAIRS, TILE_ROWS, matrix
from graphloom.sources.storage import materialize, shared_dir

#: Vectors that the centroids are fitted on, and the most cells there are.
SAMPLE, MOST_CELLS = 20_000, 4096
#: The share of the nearest vectors that a search is to find, as measured on the sample with so many queries of so many vectors.
RECALL, TRIED, NEAREST = 0.95, 200, 20
#: Queries that one search takes: they go to every task.
QUERIES = 10_000


@dataclass
class CellIndex:
    """Unit centroids, the rows by cell, and how many cells a query probes: a folder of the shared storage for each cell, so that a search reads the probed ones only."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int


def fitted_centroids(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of about the square root of as many cells as there are vectors, fitted by cosine on at most ``sample`` of them by their ids' hash; and that sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    share = min(1.0, 0.9 * sample / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy("vec_id").limit(sample)
    got = picked.select("vec_id", "embedding").toArrow()
    size = (pc.max(pc.list_value_length(got.column("embedding"))).as_py() or 1) if got.num_rows else 1
    x, places = matrix(got.column("embedding"), size)
    if not len(x):
        return np.zeros((0, size)), x
    cells = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, len(x)))
    rows = [(x[i].tolist(),) for i in range(len(x))]
    points = vectors.sparkSession.createDataFrame(rows, "x array<double>").select(array_to_vector("x").alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(points)
    centers = np.array(model.clusterCenters())
    return centers / np.sqrt((centers**2).sum(1, keepdims=True)), x


def tuned_probes(centroids: np.ndarray, x: np.ndarray, recall: float = RECALL, tried: int = TRIED, k: int = NEAREST) -> int:
    """The fewest cells to probe so that ``tried`` of the vectors find the share ``recall`` of their ``k`` nearest others."""
    if len(x) < 2:
        return len(centroids)
    asked = np.linspace(0, len(x) - 1, min(tried, len(x)), dtype=int)
    far = x[asked] @ x.T
    far[np.arange(len(asked)), asked] = -2
    near = np.argsort(-far, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), 1)
    # how far down a query's list of cells each of its nearest lies
    needed = np.sort(np.take_along_axis(place, (x @ centroids.T).argmax(1)[near], 1).ravel())
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)]) + 1


def _cells(centroids: np.ndarray):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, places = matrix(batch.column("embedding"), centroids.shape[1])
            cosine = np.clip(x @ centroids.T, -1, 1)
            best = cosine.argmax(1)
            kept = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, pa.int32()), pa.array(np.arccos(cosine[np.arange(len(best)), best]))], [*kept.schema.names, "cell", "angle"])

    return cells


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with a vector, with their ``cell`` and their ``angle`` to its centroid; equal ones go to the first cell."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema), "cell int, angle double"])
    return vectors.mapInArrow(_cells(centroids), schema)


def build(vectors: DataFrame, cells: int | None = None) -> CellIndex:
    """An index of all ``vectors`` (vec_id, embedding, ...). Null and zero vectors, and those of another size, have no place in it."""
    spark = vectors.sparkSession
    centroids, x = fitted_centroids(vectors, cells)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    rows = assigned(vectors, centroids)
    rows.write.partitionBy("cell").parquet(path)
    return CellIndex(centroids, spark.read.schema(rows.schema).parquet(path), tuned_probes(centroids, x))


def _probe(asked: np.ndarray, ids: pa.Array, probed: np.ndarray, k: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            x, _ = matrix(batch.column("embedding"), asked.shape[1])
            for c in np.unique(cell):
                queries, mine = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
                if not len(queries):
                    continue
                far = 1 - x[mine] @ asked[queries].T
                edge = np.partition(far, k - 1, axis=0)[k - 1] if len(mine) > k else np.full(len(queries), np.inf)
                row, q = np.nonzero(far <= edge + 1e-6)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(queries[q])), batch.column("vec_id").take(pa.array(mine[row])), pa.array(far[row, q])], ["query_id", "vec_id", "distance"])

    return probe


def search(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): about the ``k`` nearest vectors, those of each query's ``probes`` nearest cells, else as many as the index was tuned to.

    With as many probes as cells the result is exact. At most ``QUERIES`` queries
    (query_id, query) at once. Cells that no query probes are not read, and no vector is moved: a
    cell's rows lie in as many splits as they fill.
    """
    asked = queries.select("query_id", "query").limit(QUERIES + 1).toArrow()
    if asked.num_rows > QUERIES:
        raise ValueError(f"more than {QUERIES} queries at once")
    n = len(index.centroids)
    x, places = matrix(asked.column("query"), index.centroids.shape[1])
    ids = asked.column("query_id").combine_chunks().take(pa.array(places))
    probes = min(n, probes or index.probes)
    near = np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")[:, :probes]
    probed = np.zeros((len(x), n), bool)
    np.put_along_axis(probed, near, True, axis=1)
    wanted = np.flatnonzero(probed.any(0)).tolist()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.rows.schema['vec_id'].dataType.simpleString()}, distance double"
    far = index.rows.where(F.col("cell").isin(wanted)).select("vec_id", "embedding", "cell").mapInArrow(_probe(x, ids, probed, k), schema)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return far.withColumn("distance", F.round("distance", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(centroids: np.ndarray, reach: np.ndarray, most: float):
    """(left_id, right_id, distance) of two tiles: each left vector's nearest, by products with the cells in reach.

    Distances are rounded later: the least id of the nearest that surely round alike is
    handed on, and beside it those so close to a half that the rounding decides.
    """
    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        x, i = matrix(left.column("embedding"), centroids.shape[1])
        y, j = matrix(right.column("embedding"), centroids.shape[1])
        ids, cell = right.column("vec_id").take(pa.array(j)), right.column("cell").to_numpy()[j]
        order = pc.sort_indices(ids).to_numpy()
        y, ids, cell = y[order], ids.take(pa.array(order)), cell[order]
        columns = [np.flatnonzero(cell == c) for c in np.unique(cell)]
        rows, to, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        lot = max(1, PAIRS // max(1, len(y), len(centroids)))
        for lo in range(0, len(x) if len(y) else 0, lot):
            part = x[lo : lo + lot]
            met = np.arccos(np.clip(part @ centroids.T, -1, 1)) <= reach
            if met[:, cell].mean() > 0.5:
                d = 1 - part @ y.T
            else:
                d = np.full((len(part), len(y)), np.inf)
                for mine in columns:
                    some = np.flatnonzero(met[:, cell[mine[0]]])
                    d[np.ix_(some, mine)] = 1 - part[some] @ y[mine].T
            row, col = np.nonzero(d <= np.minimum(d.min(1, keepdims=True) + 2e-6, most + 1e-6))
            exact = np.concatenate([1 - (part[row[k : k + lot]] * y[col[k : k + lot]]).sum(1) for k in range(0, len(row), lot)] or [np.zeros(0)])
            whole = np.rint(exact * 1e6)
            sure = np.abs(np.abs(exact * 1e6 - whole) - 0.5) > 1e-4
            # the first of a row's sure ones by rounded distance, then id; equal doubtful ones by id
            key = np.where(sure, whole, exact * 1e6)
            first = np.lexsort((col, key, ~sure, row))
            r, s, k = row[first], sure[first], key[first]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (~s[1:] & (k[1:] != k[:-1]))
            kept = first[new]
            rows.append(row[kept] + lo)
            to.append(col[kept])
            far.append(exact[kept])
        rows, to = (pa.array(np.concatenate(v)) for v in (rows, to))
        return pa.table([left.column("vec_id").take(pa.array(i)).take(rows), ids.take(to), pa.array(np.concatenate(far))], ["left_id", "right_id", "distance"])

    return near


def within(left: DataFrame, right: DataFrame, most: float, on: str, cells: int | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """(left_id, right_id, distance): for each vector of ``left`` the nearest one of ``right`` with the same ``on`` and a cosine distance below ``most``; of equally near ones the least id.

    Both sides have (vec_id, ``on``, embedding). Exact, and no pair becomes a row: equal
    vectors of a side are one row; each value of ``on`` is dealt into tiles of about
    ``rows`` rows a side, and a task multiplies two tiles, a vector only with cells
    that its angle lets it reach: those whose centroid is no farther than the
    cell's widest member and the angle of ``most`` together.
    """
    def alike(df: DataFrame) -> DataFrame:
        return materialize(df.where("embedding IS NOT NULL").groupBy(on, "embedding").agg(F.min("vec_id").alias("vec_id")))

    a, b = alike(left), alike(right)
    centroids, _ = fitted_centroids(b, cells)
    held = materialize(assigned(b, centroids))
    widest = {r.cell: r.angle for r in held.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
    reach = np.array([widest.get(c, -10.0) for c in range(len(centroids))]) + math.acos(max(-1.0, 1 - most - 1e-6)) + 1e-6
    tiles = lambda df, name: df.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    counts = materialize(tiles(a, "_na").join(tiles(held, "_nb"), on))
    slot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    mine = a.join(counts, on).select(on, slot("_na").alias("_a"), each("_nb").alias("_b"), "vec_id", "embedding")
    other = held.join(counts, on).select(on, each("_na").alias("_a"), slot("_nb").alias("_b"), "vec_id", "embedding", "cell")
    # about a tile of each side a task
    n_tiles = counts.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0] or 0
    n = max(a.sparkSession.sparkContext.defaultParallelism, min(n_tiles, (mine.count() + other.count()) // rows))
    kind = lambda df: df.schema["vec_id"].dataType.simpleString()
    by = lambda df: df.repartition(n, on, "_a", "_b").groupBy(on, "_a", "_b")
    near = by(mine).cogroup(by(other)).applyInArrow(_nearest(centroids, reach, most), f"left_id {kind(a)}, right_id {kind(held)}, distance double")
    near = near.withColumn("distance", F.round("distance", 6)).where(F.col("distance") < most)
    best = near.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("best")).select("left_id", "best.right_id", "best.distance")
    # every row of the left side gets what its equals have
    same = left.join(a.select(on, F.col("vec_id").alias("left_id"), "embedding"), [on, "embedding"]).select(F.col("vec_id"), "left_id")
    return same.join(best, "left_id").select(F.col("vec_id").alias("left_id"), "right_id", "distance")
