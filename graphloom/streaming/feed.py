"""A change feed: messages name the entry that changed, batches land once, and the newest message of each entry is its state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a payload may name its entry, in this order, and then the attributes that may.
PATHS = ("$.entry.name", "$.asset.name", "$.name")
ATTRIBUTES = ("entry_name", "name")

MESSAGE = "message_id bigint, data string, attributes map<string,string>, at timestamp"
_LOG = f"{MESSAGE}, entry_name string, batch bigint, outcome string"


def entry_name(data: Column, attributes: Column) -> Column:
    """The entry that a message names, else null.

    The first path of the payload with a text that isn't empty counts; numbers
    and objects there don't. A payload that names none, or an empty one, leaves
    it to the attributes; one that is no JSON object (or repeats a key) names none.
    """
    filled = lambda x: F.when(x != "", x)
    payload = F.try_parse_json(F.coalesce(filled(data), F.lit("{}")))

    def at(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(payload, path, "variant")) == "STRING"
        return F.when(is_text, filled(F.try_variant_get(payload, path, "string")))

    found = F.coalesce(*map(at, PATHS), *(filled(F.try_element_at(attributes, F.lit(a))) for a in ATTRIBUTES))
    return F.when(F.schema_of_variant(payload).startswith("OBJECT"), found)


def named(messages: DataFrame) -> DataFrame:
    """Messages with ``entry_name`` and ``outcome``: ``entry``, or ``malformed`` where none is named."""
    out = messages.withColumn("entry_name", entry_name(F.col("data"), F.col("attributes")))
    return out.withColumn("outcome", F.when(F.col("entry_name").isNull(), "malformed").otherwise("entry"))


def newest(entries: DataFrame) -> DataFrame:
    """The newest message of each entry, by time and then by number; messages delivered again change nothing."""
    kept = [c for c in entries.columns if c != "entry_name"]
    rows = entries.where("entry_name IS NOT NULL").groupBy("entry_name").agg(F.max_by(F.struct(*kept), F.struct("at", "message_id")).alias("m"))
    return rows.select("entry_name", "m.*")


def consume(source: DataFrame, path: str, checkpoint: str):
    """Land a stream of messages in ``path``, malformed ones too, and stop when all that is there has landed.

    A batch has a folder of its own, so that one repeated after a failure
    overwrites itself: no message is lost, and none counts twice.
    """

    def land(batch: DataFrame, number: int) -> None:
        named(batch).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/log/batch={number}")

    query = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def log(spark: SparkSession, path: str) -> DataFrame:
    """All messages landed, with their batch and outcome."""
    return spark.read.schema(_LOG).option("basePath", f"{path}/log").parquet(f"{path}/log")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages that name no entry."""
    return log(spark, path).where("outcome = 'malformed'")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, received, entries, malformed) of each batch with messages."""
    is_entry = F.col("outcome") == "entry"
    return log(spark, path).groupBy("batch").agg(F.count(F.lit(1)).alias("received"), F.count_if(is_entry).alias("entries"), F.count_if(~is_entry).alias("malformed"))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the last batches of whole snapshots."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/upto=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found)


def current(spark: SparkSession, path: str) -> DataFrame:
    """(entry_name, message_id, data, attributes, at): the newest message of each entry, of the last snapshot and the batches after it."""
    columns = ["entry_name", "message_id", "data", "attributes", "at"]
    upto = _snapshots(spark, path)[-1:]
    parts = [log(spark, path).where(F.col("batch") > (upto[0] if upto else -1)).select(*columns)]
    parts += [spark.read.schema(parts[0].schema).parquet(f"{path}/state/upto={n}") for n in upto]
    return newest(reduce(DataFrame.unionByName, parts))


def fold(spark: SparkSession, path: str) -> None:
    """Write the state after the last batch as a snapshot, so that readers skip the batches before.

    Call it between runs of :func:`consume`. A fold that fails leaves the
    snapshot before it in use; a second one changes nothing.
    """
    last = log(spark, path).agg(F.max("batch")).first()[0]
    if last is not None and last not in _snapshots(spark, path):
        current(spark, path).write.mode("overwrite").parquet(f"{path}/state/upto={last}")
