"""Batches in tiers as queries, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import tiers
from graphloom.operators.tiers import Tier
from graphloom.sources.tables import table

TIERS = [
    Tier("nation", ("n_nationkey",)),
    Tier("customer", ("c_custkey",), {"c_nationkey": "nation"}),
    Tier("orders", ("o_orderkey",), {"o_custkey": "customer"}),
    Tier("lineitem", ("l_orderkey", "l_linenumber"), {"l_orderkey": "orders"}),
]
# A batch that lacks some nations, customers and orders.
_LACKS = {"nation": "n_nationkey % 9 <> 4", "customer": "c_custkey % 10 <> 3", "orders": "o_orderkey % 11 <> 5", "lineitem": "true"}


def _batch(spark, sf):
    return {t.name: table(spark, sf, t.name).where(_LACKS[t.name]) for t in TIERS}


def tier_orphans(spark, sf):
    return tiers.orphans(_batch(spark, sf), TIERS)


def tier_admitted(spark, sf):
    kept = tiers.admitted(_batch(spark, sf), TIERS)
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in kept.items()])


_PARTS = "WITH " + ", ".join(f"b_{name} AS (SELECT * FROM {name} WHERE {cut})" for name, cut in _LACKS.items())
_LINKS = (("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))
SQL = {
    "tier_orphans": _PARTS + " SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS n_rows, min({c}::VARCHAR) AS example FROM b_{t} WHERE NOT EXISTS (FROM b_{p} WHERE {k} = {c})""" for t, c, p, k in _LINKS
    ) + ") WHERE n_rows > 0",
    "tier_admitted": _PARTS + ", k_nation AS (FROM b_nation)" + "".join(f", k_{t} AS (SELECT * FROM b_{t} WHERE {c} IN (SELECT {k} FROM k_{p}))" for t, c, p, k in _LINKS) + " "
    + " UNION ALL ".join(f"""SELECT '{t.name}' AS "table", count(*) AS n_rows FROM k_{t.name}""" for t in TIERS),
}
QUERIES = {name: globals()[name] for name in SQL}
