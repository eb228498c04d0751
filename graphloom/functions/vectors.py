"""Vector functions in column expressions, summed in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

BROADCAST_ROWS = 10_000
TILE_ROWS = 10_000
#: Queries that a task holds where they do not go to every task, and vectors that it reads for them, about.
TILE_QUERIES, SLICE_ROWS = 50_000, 1_000_000
#: Distances that a task holds at once.
PAIRS = 1 << 21
# Fixed value: the least number that points are divided by.
LEAST_SCALE = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is null or zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def sanitized(a: Column, size: int) -> Column:
    """The vector without infinite or missing numbers; zeros where it has another size."""
    fine = F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    return F.when(F.size(a) == size, fine).otherwise(F.array_repeat(F.lit(0.0), size))


def tiled_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: tuple[str, ...] = (), rows: int = TILE_ROWS) -> DataFrame:
    """All pairs of rows that are equal in ``on``, tile by tile.

    Each side is split by its ids into slices of about ``rows`` rows and copied
    once for each slice of the other, so that a task joins two slices and a
    value of ``on`` with most rows is spread over all of them.
    """
    a, b = (1 + df.count() // rows for df in (left, right))
    mine = left.withColumn("_a", F.pmod(F.xxhash64(left_id), F.lit(a))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)).cast("array<bigint>")))
    other = right.withColumn("_b", F.pmod(F.xxhash64(right_id), F.lit(b))).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(a - 1)).cast("array<bigint>")))
    return mine.hint("merge").join(other, ["_a", "_b", *on]).drop("_a", "_b")


def whole_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, and the places of the rows that have one.

    Left out: null and zero vectors, those of another size, and those with a missing or infinite number.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    places = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(places), size)
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(1))
        fine = np.isfinite(length) & (length > 0)
    return x[fine], places[fine]


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`whole_rows`, with rows of length 1."""
    x, places = whole_rows(column, size)
    return x / np.sqrt((x * x).sum(1))[:, None], places


def _distances(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, row: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine distances of the pairs of rows, of squared lengths ``xx`` and ``yy``, some of them at a time; with whole numbers the root alone is rounded."""
    out, some = np.empty(len(row)), max(1, PAIRS // max(1, 16 * x.shape[1]))
    for lo in range(0, len(row), some):
        a, b = row[lo : lo + some], q[lo : lo + some]
        with np.errstate(all="ignore"):
            square = xx[a] * yy[b]
            length = np.where(np.isfinite(square) & (square > 0), np.sqrt(square), np.sqrt(xx[a]) * np.sqrt(yy[b]))
        out[lo : lo + some] = 1 - np.clip(np.einsum("ij,ij->i", x[a], y[b]) / length, -1, 1)
    return out


def _near(asked: np.ndarray, ids: pa.Array, k: int, within: tuple[str, ...], equals: bool = True):
    """A task's own nearest rows of each query and group: equals and near-equals of the last one are handed on too, without ``equals`` only the first ``k`` at one distance by id."""
    n = len(asked)
    rows = max(1, PAIRS // max(1, n))
    # products of single precision tell which pairs are measured: they are off by less than this
    square = (asked * asked).sum(1)
    unit, off = (asked / np.sqrt(square)[:, None]).T.astype(np.float32), 1e-6 + 1e-7 * (asked.shape[1] + 4)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        edge = np.zeros((0, n))  # for each group and query the distance of the k-th row so far
        least = np.zeros((0, n), np.float32)  # and the product of units that a nearer row has at least
        kept, held, waiting, size = None, np.zeros(0, np.int64), [], 0  # rows, and (group, query) and distance of each
        far = np.zeros(0)

        def settle():
            nonlocal kept, held, far, waiting, size, least
            table = pa.Table.from_batches([x for x, _, _ in waiting])
            kept = table if kept is None else pa.concat_tables([kept, table])
            held, far = np.concatenate([held, *(c for _, c, _ in waiting)]), np.concatenate([far, *(d for _, _, d in waiting)])
            order = np.lexsort((far, held))
            cell, nearest = held[order], far[order]
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            nth = np.arange(len(cell)) - np.repeat(start, np.diff(np.concatenate([start, [len(cell)]])))
            last = cell[nth == k - 1]
            edge.flat[last] = np.minimum(edge.flat[last], nearest[nth == k - 1])
            least = (1 - edge - off).astype(np.float32)
            run = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (nearest[1:] != nearest[:-1])]))
            length = np.diff(np.concatenate([run, [len(cell)]]))
            fits = nearest <= edge.flat[cell] + 1e-6
            if not equals and (many := np.repeat(length > k, length) & fits).any():
                same = order[many]
                name = pc.rank(kept.column("vec_id").combine_chunks().take(pa.array(same)), tiebreaker="dense").to_numpy()
                order[many] = same[np.lexsort((name, np.repeat(run, length)[many]))]
                fits &= np.arange(len(cell)) - np.repeat(run, length) < k
            take = order[fits]
            kept, held, far = kept.take(pa.array(take)).combine_chunks(), held[take], far[take]
            waiting, size = [], 0

        def rest():
            nonlocal kept, held, far
            out = pa.table([ids.take(pa.array(held % n)), *kept.columns, pa.array(far)], ["query_id", *kept.column_names, "distance"])
            kept, held, far = None, np.zeros(0, np.int64), np.zeros(0)
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                x, places = whole_rows(batch.column("embedding"), asked.shape[1])
                batch = batch.take(pa.array(places)).drop_columns(["embedding"])
                if not len(places) or not n:
                    continue
                keys = list(zip(*(batch.column(c).to_pylist() for c in within))) if within else [()] * len(places)
                group = np.array([groups.setdefault(key, len(groups)) for key in keys])
                if len(groups) > len(edge):
                    edge = np.concatenate([edge, np.full((len(groups) - len(edge), n), np.inf)])
                    least = (1 - edge - off).astype(np.float32)
                xx = (x * x).sum(1)
                likeness = (x / np.sqrt(xx)[:, None]).astype(np.float32) @ unit
                row, q = np.divmod(np.flatnonzero(likeness >= (least[group] if len(groups) > 1 else least)), n)
                d = _distances(x, asked, xx, square, row, q)
                fits = d <= edge[group[row], q] + 1e-6
                row, q, d = row[fits], q[fits], d[fits]
                if not len(row):
                    continue
                waiting.append((batch.take(pa.array(row)), group[row] * n + q, d))
                size += len(row)
                if size > max(2 * len(held), n * k, 10_000):
                    settle()
                    if len(held) > 2 * PAIRS:  # rows of many equals go on at once
                        yield from rest()
        if waiting:
            settle()
        if kept is not None:
            yield from rest()

    return near


def _near_tiles(size: int, k: int, within: tuple[str, ...], kept: list[str]):
    """As :func:`_near` for each tile of queries and slice of vectors of a task's rows, which are sorted so that a tile's queries come before its vectors."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("_a", "_b", "_side")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for lo, hi in pairwise([0, *ends.tolist(), batch.num_rows]):
                if lo < hi:
                    yield tuple(key[:, lo].tolist()), batch.slice(lo, hi - lo)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tile in groupby(parts(batches), lambda p: p[0][:2]):
            asked, first = [], []
            for (_, _, is_vector), part in tile:
                if is_vector:
                    first.append(part)
                    break
                asked.append(part.select(["_id", "_query"]))
            if asked and first:
                rows = pa.Table.from_batches(asked)
                x, places = whole_rows(rows.column("_query"), size)
                ids = rows.column("_id").combine_chunks().take(pa.array(places))
                yield from _near(x, ids, k, within, False)(p.select(kept) for p in chain(first, (p for _, p in tile)))

    return near


def _tiled(queries: DataFrame, vectors: DataFrame, k: int, within: tuple[str, ...], schema: str) -> DataFrame:
    """Near rows of each query by tiles of about ``TILE_QUERIES`` queries, each met by all vectors in slices of ``SLICE_ROWS`` at most.

    Both sides are written first, so that no vector is made twice. A task holds one tile of queries and the
    nearest so far, vectors pass by; queries are copied once for each slice, vectors once for each tile.
    """
    asked, held = materialize(queries), materialize(vectors)
    n, m = asked.count(), held.count()
    size = asked.agg(F.max(F.size("query"))).first()[0] or 1
    a = max(1, -(-n // TILE_QUERIES))
    # at least two tasks a core, if slices of TILE_ROWS are enough for them
    b = max(1, -(-m // SLICE_ROWS), min(2 * asked.sparkSession.sparkContext.defaultParallelism // a, m // TILE_ROWS))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = asked.select(slot("query_id", a).alias("_a"), each(b).alias("_b"), F.lit(0).alias("_side"), F.col("query_id").alias("_id"), F.col("query").alias("_query"))
    other = held.select(each(a).alias("_a"), slot("vec_id", b).alias("_b"), F.lit(1).alias("_side"), *held.columns)
    dealt = mine.unionByName(other, allowMissingColumns=True).repartitionById(a * b, F.col("_a") * b + F.col("_b")).sortWithinPartitions("_a", "_b", "_side")
    return dealt.mapInArrow(_near_tiles(size, k, within, held.columns), schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, within: tuple[str, ...] = (), small: int = BROADCAST_ROWS) -> DataFrame:
    """The ``k`` nearest vectors by cosine distance for each query, and for each value of ``within``.

    ``queries`` has (query_id, query); ``vectors`` has (vec_id, embedding) and
    more. Exact: the stated queries run against all vectors. Up to ``small``
    queries go to every task as one matrix, so that a batch of vectors is one product and
    only its own nearest leave it; more queries are met in tiles. Vectors that are
    null, zero, not finite or of another size than the queries are left out.
    """
    order = Window.partitionBy("query_id", *within).orderBy("distance", "vec_id")
    queries = queries.select("query_id", "query")
    asked = queries.limit(small + 1).toArrow()
    rows = vectors.select([c for c in vectors.columns if c not in ("query_id", "distance")])
    others = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding"]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *others, "distance double"])
    if asked.num_rows <= small:
        sizes = pc.list_value_length(asked.column("query"))
        x, places = whole_rows(asked.column("query"), pc.max(sizes).as_py() or 1)
        ids = asked.column("query_id").combine_chunks().take(pa.array(places))
        far = rows.mapInArrow(_near(x, ids, k, within, False), schema)
    else:
        far = _tiled(queries, rows, k, within, schema)
    far = far.withColumn("distance", F.round("distance", 6))
    kept = [c for c in vectors.columns if c not in ("query_id", "embedding", "distance")]
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", *kept, "distance", "rank")


def mean_vector(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, pos, mean): the mean of each place over a group's vectors."""
    return vectors.select(key, F.posexplode(column).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def fitted_axes(vectors: DataFrame, k: int = 3, column: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """A function to places along the vectors' first principal axes; each axis points to where its weights sum up positive.

    It maps any table (vec_id, ``column``), such as one of queries, to (vec_id, axis_1, ...).
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def raw(df: DataFrame) -> DataFrame:
        return df.select("vec_id", array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("raw"))

    centre = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=False).fit(raw(vectors))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(centre.transform(raw(vectors)))
    signs = [1.0 if s >= 0 else -1.0 for s in model.pc.toArray().sum(axis=0)]
    y = vector_to_array("y")

    def place(df: DataFrame) -> DataFrame:
        return model.transform(centre.transform(raw(df))).select("vec_id", *(F.round(y[i] * signs[i], 4).alias(f"axis_{i + 1}") for i in range(k)))

    return place


def principal_axes(vectors: DataFrame, k: int = 3, column: str = "embedding") -> DataFrame:
    """(vec_id, axis_1, ...): places of the vectors along their own first principal axes."""
    return fitted_axes(vectors, k, column)(vectors)


def scaled(points: DataFrame, *columns: str) -> DataFrame:
    """Points with all ``columns`` divided by the largest absolute number in any of them, which is a column ``scale``."""
    most = F.max(F.greatest(*(F.abs(c) for c in columns), F.lit(LEAST_SCALE)))
    one = points.agg(F.coalesce(most, F.lit(1.0)).alias("scale"))  # one row
    return points.crossJoin(F.broadcast(one)).withColumns({c: F.col(c) / F.col("scale") for c in columns})
