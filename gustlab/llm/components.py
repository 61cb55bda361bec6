"""Connected components of an edge table by repeated contraction, and the shared-folder checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; the component is the smallest node reachable.

    Each round sends every node to the smallest of itself and its neighbours and contracts the graph onto these, so
    stars end in a round and chains in about log rounds. Only edge tables move, nothing reaches the driver but a
    row count; rounds are cut by a checkpoint in the shared folder. Nulls and self-loops add nothing but a lone node
    of the loop; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    maps: list[DataFrame] = []
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = e.select("u", F.col("v").alias("m")).unionAll(e.select(F.col("v").alias("u"), F.least("u", "v").alias("m")))
        to = cut_lineage(ends.groupBy("u").agg(F.min("m").alias("m")))
        maps.append(to)
        # both ends move to their own smallest neighbour; edges inside one target vanish
        nxt = (e.join(to.select("u", F.col("m").alias("mu")), "u")
                .join(to.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
                .where("mu <> mv")
                .select(F.greatest("mu", "mv").alias("u"), F.least("mu", "mv").alias("v")).distinct())
        # an end that moved on its own: m(u) may itself have moved
        hop = (to.join(to.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m").where("mm <> m")
                 .select(F.greatest("m", "mm").alias("u"), F.least("m", "mm").alias("v")).distinct())
        e = cut_lineage(nxt.unionAll(hop).distinct())
        if e.isEmpty():
            break
    out = maps[0].select(F.col("u").alias("node"), F.col("m").alias("component"))
    for to in maps[1:]:
        out = (out.join(to.select(F.col("u").alias("component"), "m"), "component", "left")
                  .select("node", F.coalesce("m", "component").alias("component")))
    return out
