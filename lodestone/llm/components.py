"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, remove


#: A key that so many rows share is looked up in a broadcast table, which so has a row for HUB rows at least.
HUB = 1_000_000


def _lookup(df: DataFrame, key: str, table: DataFrame, n: int) -> DataFrame:
    """df, of about n rows, joined with table, which has one row for each value of key. Keys that many rows share aren't dealt to one task."""
    if n < HUB:
        return df.join(table, key)
    hubs = df.groupBy(key).agg(F.count("*").alias("k")).where(F.col("k") >= HUB).select(key)
    told = F.broadcast(hubs)
    return df.join(F.broadcast(table.join(told, key)), key).unionByName(df.join(told, key, "left_anti").join(table, key))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root, the least node of its component, for every node of a link.

    Each round takes the least root of the neighbours, then the root's own root; the table is written to the shared
    folder, so a round neither repeats earlier ones nor depends on an executor. A hub's links are combined before they
    are dealt out, and neither a hub nor a root that many nodes share is a key of one task. Nulls link nothing; repeated
    links and self links change nothing; no links give no rows.
    """
    sides = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    both = materialise(sides.unionByName(sides.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    n = both.count()
    roots = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "roots")
    while True:
        theirs = _lookup(both, "other", roots.select(F.col("node").alias("other"), "root"), n).groupBy("node").agg(F.min("root").alias("near"))
        nearer = roots.join(theirs, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jumped = _lookup(nearer, "root", roots.select(F.col("node").alias("root"), F.col("root").alias("next")), n).select("node", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("was")).alias("moved"))
        new = materialise(jumped, "roots")
        remove(roots)
        roots = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return roots
