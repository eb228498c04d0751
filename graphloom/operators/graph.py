"""Graph operators over one ``nodes`` and one ``edges`` table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.registry import CONFIDENCE_FACTOR, LAYER_RANK, TOWARDS_ABSTRACT, TOWARDS_CONCRETE
from graphloom.sources.storage import is_written, materialize
from graphloom.sources.tables import layer_of


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: (node_id, other_id, other_type, rel_type, confidence, direction)."""
    rest = ["rel_type", "confidence"]
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), F.col("target_type").alias("other_type"), *rest, F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id"), F.col("source_type").alias("other_type"), *rest, F.lit("incoming").alias("direction"))
    return out.unionAll(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree); a loop counts twice. Edges are read once for both their ends."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """The nodes of highest degree; ids that no node has are left out."""
    return degrees(edges).join(nodes, "node_id").select("node_id", "node_type", "name", "degree").orderBy(F.desc("degree"), "node_id").limit(top_n)


def connections(edges: DataFrame, node_id: str) -> DataFrame:
    """One hop in both directions."""
    return symmetric(edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))).where(F.col("node_id") == node_id).drop("node_id")


def page(nodes: DataFrame, types: Sequence[str], offset: int, limit: int, layers: Sequence[str] = ()) -> DataFrame:
    """A page of nodes in the order of ``types`` and then of ids, with the total."""
    chosen = nodes.where(F.col("node_type").isin(*types))
    if layers:
        chosen = chosen.where(layer_of(F.col("node_type")).isin(*layers))
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("node_type"))
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    # one row of totals
    rows = chosen.orderBy(rank, "node_id").offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def internal_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes``."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids, edges["source_id"] == ids["node_id"], "left_semi").join(ids, edges["target_id"] == ids["node_id"], "left_semi")


def chain(edges: DataFrame, start: DataFrame, hops: Sequence[tuple[str | None, str, str | None]]) -> DataFrame:
    """Paths of fixed length: ``hops`` are (relation, direction, node type), None for any.

    ``start`` has a column n0; the result has n0, r1, n1, ... A hop's direction
    is outgoing, incoming or any. The edges are written once for all hops, and not again if they are a written table.
    """
    ways = symmetric(edges if is_written(edges) else materialize(edges))
    paths = start
    for i, (rel, direction, kind) in enumerate(hops, 1):
        hop = ways
        if rel:
            hop = hop.where(F.col("rel_type") == rel)
        if direction != "any":
            hop = hop.where(F.col("direction") == direction)
        if kind:
            hop = hop.where(F.col("other_type") == kind)
        hop = hop.select(F.col("node_id").alias(f"n{i - 1}"), F.col("rel_type").alias(f"r{i}"), F.col("other_id").alias(f"n{i}"))
        paths = paths.join(hop, f"n{i - 1}")
    return paths


def reachable(edges: DataFrame, start: DataFrame, least: int = 1, most: int = 3) -> DataFrame:
    """Distinct (start, end) of directed walks of ``least`` to ``most`` edges; ``start`` has a column start."""
    step = materialize(edges.select(F.col("source_id").alias("end"), F.col("target_id").alias("next")).distinct())
    at, found = start.select("start", F.col("start").alias("end")), []
    for i in range(1, most + 1):
        # reduced to distinct ends before the next join: walks do not multiply
        at = materialize(at.join(step, "end").select("start", F.col("next").alias("end")).distinct())
        if i >= least:
            found.append(at)
    return reduce(DataFrame.unionAll, found).distinct()


def factor_of(confidence: Column) -> Column:
    factors = F.create_map(*(F.lit(x) for pair in CONFIDENCE_FACTOR.items() for x in pair))
    return F.coalesce(factors[F.coalesce(confidence, F.lit("EXTRACTED"))], F.lit(1.0))


def _risen(edges: DataFrame, node_id: str, max_hops: int, least: float, traced: bool) -> list[DataFrame]:
    """For each number of hops, the nodes whose confidence rose there; ``traced`` ones tell the edge that they came by.

    The edges are written once. Only nodes whose confidence rose go on, so a hub
    is expanded once per level of confidence. Of equally sure ways to a node the first by
    (node before, relation, direction, label) counts.
    """
    label = F.coalesce("confidence", F.lit("EXTRACTED")).alias("label")
    trace = ["rel_type", "direction", "label", "other_type"] if traced else []
    plain = edges.select("source_id", "target_id", *(["source_type", "target_type", "rel_type", label] if traced else []), factor_of(F.col("confidence")).alias("factor")).where("factor > 0")
    narrow = materialize(plain)

    def way(source: str, target: str, direction: str) -> DataFrame:
        extra = ["rel_type", F.lit(direction).alias("direction"), "label", F.col(target.replace("_id", "_type")).alias("other_type")] if traced else []
        return narrow.select(F.col(source).alias("before"), F.col(target).alias("node_id"), "factor", *extra)

    ways = way("source_id", "target_id", "outgoing").unionAll(way("target_id", "source_id", "incoming"))
    start = edges.sparkSession.createDataFrame([(node_id, 1.0, 0)], "node_id string, confidence double, hops int")
    frontier = start.select("node_id", "confidence", "hops", *(F.lit(None).cast("string").alias(c) for c in (["before", *trace] if traced else [])))
    risen = [frontier]
    for h in range(1, max_hops + 1):
        sure = F.col("known_confidence") * F.col("factor")
        reached = frontier.select(F.col("node_id").alias("before"), F.col("confidence").alias("known_confidence")).join(ways, "before")
        reached = reached.where(sure >= least).groupBy("node_id").agg(F.min(F.struct((-sure).alias("less"), *(["before", *trace] if traced else []))).alias("best"))
        reached = reached.select("node_id", (-F.col("best.less")).alias("confidence"), F.lit(h).alias("hops"), *(f"best.{c}" for c in (["before", *trace] if traced else [])))
        known = reduce(DataFrame.unionByName, risen).groupBy("node_id").agg(F.max("confidence").alias("known"))
        frontier = materialize(reached.join(known, "node_id", "left").where("known IS NULL OR confidence > known").drop("known"))
        risen.append(frontier)
    return risen


def _best(risen: list[DataFrame]) -> DataFrame:
    """A node only rises, so its last row is its best."""
    rows = reduce(DataFrame.unionByName, risen)
    return rows.groupBy("node_id").agg(F.max(F.struct("confidence", "hops")).alias("best")).select("node_id", "best.confidence", "best.hops")


def impact(edges: DataFrame, node_id: str, max_hops: int = 4, least: float = 0.1) -> DataFrame:
    """(node_id, confidence, hops): what a change of ``node_id`` reaches, the start included.

    Confidence is the largest product of factors along a walk of up to
    ``max_hops`` edges that never falls below ``least``; hops are the fewest
    that attain it.
    """
    return _best(_risen(edges, node_id, max_hops, least, False))


def impact_paths(edges: DataFrame, nodes: DataFrame, node_id: str, max_hops: int = 4, least: float = 0.1, most: int = 50) -> DataFrame:
    """(node_id, name, node_type, layer, hops, confidence, path): the first ``most`` nodes of :func:`impact` by hops, the surest first, then by id.

    A path is ``name -[relation, confidence]-> (type) <-[relation, confidence]- (type)``, each edge in
    the direction it has. It is walked back from the shown nodes alone, one join for each hop.
    A node without a row is named by its id.
    """
    risen = _risen(edges, node_id, max_hops, least, True)
    shown = materialize(_best(risen).where("hops > 0").orderBy("hops", F.desc("confidence"), "node_id").limit(most))
    arrow = F.when(F.col("direction") == "outgoing", F.format_string(" -[%s, %s]-> (%s)", "rel_type", "label", "other_type")).otherwise(F.format_string(" <-[%s, %s]- (%s)", "rel_type", "label", "other_type"))
    walk = shown.select("node_id", F.col("node_id").alias("at"), F.col("hops").alias("level"), F.lit("").alias("path"), F.lit(None).cast("string").alias("node_type"))
    for h in range(max_hops, 0, -1):
        step = risen[h].select(F.col("node_id").alias("at"), F.lit(h).alias("level"), "before", arrow.alias("arrow"), "other_type")
        met = walk.join(F.broadcast(step.join(F.broadcast(walk.select("at", "level")), ["at", "level"], "left_semi")), ["at", "level"], "left")  # at most ``most`` rows
        on = F.col("before").isNotNull()
        walk = met.select(
            "node_id", F.when(on, F.col("before")).otherwise(F.col("at")).alias("at"), (F.col("level") - F.when(on, 1).otherwise(0)).alias("level"),
            F.concat(F.coalesce("arrow", F.lit("")), "path").alias("path"), F.coalesce("node_type", "other_type").alias("node_type"),
        )
    named = nodes.select("node_id", "name")
    start = named.where(F.col("node_id") == node_id).agg(F.coalesce(F.min("name"), F.lit(node_id)).alias("start"))  # one row
    rows = shown.join(walk.select("node_id", "path", "node_type"), "node_id").join(named, "node_id", "left").crossJoin(F.broadcast(start))
    return rows.select(
        "node_id", F.coalesce("name", "node_id").alias("name"), "node_type", layer_of(F.col("node_type")).alias("layer"), "hops", F.round("confidence", 3).alias("confidence"),
        F.concat("start", "path").alias("path"),
    )


def _breadth_first(edges: DataFrame, node_id: str, hops: int, per_relation: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node_id, hop) of all nodes met, and the edges walked in each hop. The edges are written once."""
    edges = materialize(edges.select("rel_type", "source_id", "target_id", "confidence"))
    seen = edges.sparkSession.createDataFrame([(node_id, 0)], "node_id string, hop int")
    frontier, walked = seen, []
    order = Window.partitionBy("rel_type").orderBy("source_id", "target_id")
    for h in range(1, hops + 1):
        ids = frontier.select(F.col("node_id").alias("at"))
        touching = edges.join(ids, F.col("source_id") == F.col("at"), "left_semi").unionByName(edges.join(ids, F.col("target_id") == F.col("at"), "left_semi"))
        one = touching.groupBy("rel_type", "source_id", "target_id").agg(F.min("confidence").alias("confidence"))
        kept = materialize(one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_relation).drop("n"))
        walked.append(kept)
        ends = kept.select(F.col("source_id").alias("node_id")).unionAll(kept.select("target_id")).distinct()
        frontier = materialize(ends.join(seen, "node_id", "left_anti").select("node_id", F.lit(h).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen, walked


def neighborhood(edges: DataFrame, node_id: str, hops: int = 2, per_relation: int = 100) -> DataFrame:
    """(node_id, hop): breadth-first, by at most ``per_relation`` edges of a relation in a hop, in the order of their ids. The centre is always there."""
    return _breadth_first(edges, node_id, hops, per_relation)[0]


def neighborhood_edges(edges: DataFrame, node_id: str, hops: int = 2, per_relation: int = 100) -> DataFrame:
    """(source_id, target_id, rel_type, confidence): the edges that :func:`neighborhood` walks, each once; no confidence counts as extracted."""
    walked = reduce(DataFrame.unionByName, _breadth_first(edges, node_id, hops, per_relation)[1])
    return walked.groupBy("source_id", "target_id", "rel_type").agg(F.coalesce(F.min("confidence"), F.lit("EXTRACTED")).alias("confidence"))


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with their ends swapped where the relation's direction between layers asks for it; ``swapped`` tells which."""
    ranks = F.create_map(*(F.lit(x) for pair in LAYER_RANK.items() for x in pair))
    s, t = ranks[layer_of(F.col("source_type"))], ranks[layer_of(F.col("target_type"))]
    swap = F.coalesce(
        (F.col("rel_type").isin(*TOWARDS_ABSTRACT) & (s < t)) | (F.col("rel_type").isin(*TOWARDS_CONCRETE) & (s > t)), F.lit(False)
    )

    def pick(a: str, b: str) -> Column:
        return F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)

    return edges.select(
        pick("source_id", "target_id"), pick("source_type", "target_type"), pick("target_id", "source_id"), pick("target_type", "source_type"),
        "rel_type", "confidence", swap.alias("swapped"),
    )


def merge_subgraph(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Union of two edge tables by (source, target, relation); a row that is there stays as it is."""
    key = ["source_id", "target_id", "rel_type"]
    return edges.unionByName(more.dropDuplicates(key).join(edges, key, "left_anti"))


def hub_connections(edges: DataFrame, hubs: DataFrame, per_relation: int = 3, most: int = 20) -> DataFrame:
    """A sample of the hubs' outgoing edges: ``per_relation`` for each hub and relation, ``most`` in all."""
    order = Window.partitionBy("source_id", "rel_type").orderBy("target_id")
    mine = edges.join(hubs.select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    kept = mine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_relation)
    return kept.select("source_id", "rel_type", "target_id").orderBy("source_id", "rel_type", "target_id").limit(most)
