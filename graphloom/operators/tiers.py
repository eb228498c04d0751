"""Writes in tiers: rows of a batch go in after the rows they belong to, and a repeated batch takes the place of itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """A table with its key, and for each column that names a parent the table it is in, whose key has one column."""

    name: str
    key: tuple[str, ...]
    parents: dict[str, str] = field(default_factory=dict)


class OrphanRows(ValueError):
    """A batch has rows whose parents are neither in it nor in the tables: ``found`` has (table, column, rows, an example) of each."""

    def __init__(self, found: list[tuple]):
        super().__init__("; ".join(f"{n} rows of {t} have no parent by {c}, such as {x}" for t, c, n, x in found))
        self.found = found


def current(spark: SparkSession, path: str, tier: Tier, schema) -> DataFrame:
    """The rows of a table: of each key those of its last batch. Without any batch it is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{tier.name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/{tier.name}").parquet(f"{path}/{tier.name}/batch=*")
    return rows.withColumn("_last", F.max("batch").over(Window.partitionBy(*tier.key))).where("batch = _last").select(*schema.names)


def lacking(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` names no row of ``parent``; a null names none."""
    return rows.join(parent.select(F.col(key).alias("_parent")).distinct(), F.col(column) == F.col("_parent"), "left_anti")


def orphans(batch: dict[str, DataFrame], tiers: list[Tier], known: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, column, n_rows, example): how many rows of the batch lack a parent in the batch or in ``known``, one row for each that any lack."""
    by_name, known, out = {t.name: t for t in tiers}, known or {}, []
    for t in tiers:
        for column, parent in t.parents.items() if t.name in batch else ():
            key = by_name[parent].key[0]
            there = [df.select(key) for df in (batch.get(parent), known.get(parent)) if df is not None]
            found = lacking(batch[t.name], column, there[0].union(there[-1]), key) if there else batch[t.name]
            out.append(found.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col(column).cast("string")).alias("example")).select(F.lit(t.name).alias("table"), F.lit(column).alias("column"), "n_rows", "example"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.where("n_rows > 0")


def admitted(batch: dict[str, DataFrame], tiers: list[Tier]) -> dict[str, DataFrame]:
    """The batch without its orphans: tables come after their parents, so what belongs to an orphan goes too."""
    by_name, out = {t.name: t for t in tiers}, {}
    for t in tiers:
        rows = batch[t.name]
        for column, parent in t.parents.items():
            rows = rows.join(out[parent].select(F.col(by_name[parent].key[0]).alias("_parent")).distinct(), F.col(column) == F.col("_parent"), "left_semi")
        out[t.name] = rows
    return out


def write(batch: dict[str, DataFrame], path: str, tiers: list[Tier], number: int) -> None:
    """Write batch ``number`` of rows that replace those of their keys, parents first; one with orphans is refused whole.

    Each table has a folder for each batch. A job that fails between two tables
    leaves parents without children, never the reverse; the same batch written
    again overwrites its folders, so no row is lost or doubled. A key stands
    once in a batch, and numbers rise.
    """
    given = [t for t in tiers if t.name in batch]
    spark = next(iter(batch.values())).sparkSession
    parents = {p for t in given for p in t.parents.values()}
    known = {}
    for t in (t for t in tiers if t.name in parents):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{t.name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known[t.name] = spark.read.parquet(f"{path}/{t.name}/batch=*").select(*t.key)
    if any(t.parents for t in given):
        # a row for each column that names a parent
        found = [tuple(r) for r in orphans(batch, tiers, known).collect()]
        if found:
            raise OrphanRows(sorted(found))
    for t in given:
        batch[t.name].write.mode("overwrite").parquet(f"{path}/{t.name}/batch={number}")
