"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target in words (:func:`targets`). A source's target over its size is the number of copies each of
its documents should have; the whole part of it is taken for certain, the rest is an inclusion probability p. Every
document draws a fixed number u in (0, 1) from a hash of its id and ranks by q = (u / (1 - u)) / (p / (1 - p)), and the
documents of the source are taken in that order until the remaining words are met (the last one where that comes nearer).

No source is sorted whole. A histogram of the ranks (pre-aggregated, so a hot source shuffles sums only) shows the one
bin of a source in which its remainder ends, and only the rows of that bin are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustlab.llm.blocks import without
from gustlab.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BIN = 5_000
MAX_BROADCAST_SOURCES = 20_000  # with names of up to 1 KB, 20 MB
OUT = ["size", "source_size", "target", "taken", "copies"]


def size_of(text) -> F.Column:
    """Words of a text: maximal runs without ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(id, text, salt: str) -> F.Column:
    """A number in (0, 1) fixed by the id; by the text where the id is null."""
    name = F.concat(F.lit(salt + ":"), F.coalesce(id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` plus ``rank`` from 0 by code point, null last: a range partitioning, and an offset per partition."""
    part = cut_lineage(sources.repartitionByRange(F.col("source").asc_nulls_last())
                       .withColumn("part", F.spark_partition_id()))
    # a row a partition, whatever the number of sources
    before = part.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return part.withColumn("inside", inside).join(before.select("part", "before"), "part").withColumn(
        "rank", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Target words by source: from (source, source_size), columns ``rank`` and ``target`` are added.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all words. A target stops
    at ``limit`` times its source's size; the excess goes to the others by weight until none is above.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut_lineage(ranked(sizes).withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(limit))))
    total, level = None, None
    while True:  # a line of sums a round; the level only rises, and stops once no further source reaches its limit
        full = F.lit(False) if level is None else F.col("limit") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("limit"))).alias("full"),
                  F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        total = float(r["all"] or 0) * share
        new = (total - (r["full"] or 0.0)) / r["weight"] if r["weight"] else float("inf")
        if new == level or new == float("inf"):
            break
        level = new
    target = F.col("limit") if new == float("inf") else F.least(F.col("limit"), F.lit(new) * F.col("weight"))
    return s.withColumn("target", target).drop("weight", "limit")


def _sources_join(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Join on the source, nulls equal; the table is broadcast while it has at most MAX_BROADCAST_SOURCES rows."""
    t = table.withColumnRenamed("source", "_s")
    return df.join(F.broadcast(t) if n <= MAX_BROADCAST_SOURCES else t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
        weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0, salt: str = "mix") -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus ``size``, ``source_size`` long, ``target`` double (the source's),
    ``taken`` long (words taken, repeats counted) and ``copies`` int (0: the mix leaves the document out).

    All rows come back. A null text has size 0; null is a source of its own. Rows of one id draw the same number, so
    equal rows are taken or left together; rows with a null id draw by their text. An empty table gives an empty
    result. Input columns named like the outputs are replaced.
    """
    def measured(df, cols):
        cols = [c for c in cols if c.lower() not in OUT]
        return df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{source}`").cast("string").alias("source"),
                         size_of(F.col(f"`{text}`").cast("string")).alias("size"),
                         draw(F.col(f"`{id}`"), F.col(f"`{text}`"), salt).alias("u"), F.col(f"`{id}`").cast("string").alias("id")), cols

    slim, slim_cols = measured(docs, keep if keep is not None and text not in keep else [id])
    base = cut_lineage(slim)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sizes, weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = cut_lineage(goal.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
                       .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n, rows = goal.agg(F.count("*"), F.sum("rows")).first()
    bins = max(1, int(rows or 0) // ROWS_PER_BIN)
    # x = q / (1 + q) orders like q; where a remainder ends (q near 1) a bin holds at most about rows / bins
    x = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u")))

    def ordered(df):
        return _sources_join(df, goal.drop("rows"), n).withColumn("x", F.when(F.col("p") > 0, x)).withColumn(
            "bin", F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)))

    at = ordered(base)
    hist = at.where("p > 0").groupBy("rank", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(W.partitionBy("rank").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = cut_lineage(hist.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
                       .where("before <= rest and upto > rest").select("rank", F.col("bin").alias("end_bin"), "before"))
    # the rows of the bins where remainders end, one bin a source
    last = at.join(F.broadcast(ends) if n <= MAX_BROADCAST_SOURCES else ends, "rank").where("bin = end_bin")
    by = W.partitionBy("rank").orderBy("x", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    key = F.struct("x", F.coalesce("id", F.lit("")).alias("id"), "size")
    cut = (last.withColumn("upto", F.col("before") + F.sum("size").over(by))
           .groupBy("rank", "end_bin").agg(F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), key)).alias("cut")))
    goal2 = goal.join(cut, "rank", "left").drop("rows")
    goal2 = cut_lineage(goal2)

    def result(df, cols):
        d = _sources_join(df, goal2, n).withColumn("x", F.when(F.col("p") > 0, x)).withColumn(
            "bin", F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)))
        # no bin where the remainder ends: it takes every row (it is the whole source)
        more = F.when(F.col("p") > 0, F.when(F.col("end_bin").isNull(), F.lit(1))
                      .when((F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & F.col("cut").isNotNull()
                                                                & (key <= F.col("cut"))), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
        return (d.withColumn("copies", (F.col("whole") + more).cast("int"))
                .select(*[F.col(f"row.`{c}`") for c in cols], "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"))

    if keep is not None and text not in keep:
        return result(base, slim_cols)
    return result(*measured(docs, docs.columns if keep is None else keep))


ORACLE = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
          FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][1 + rank % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
    l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5
                     - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    v AS (SELECT min_by(level, lim / weight) AS level FROM l WHERE level * weight < lim),
    t AS (SELECT source, source_size, least(lim, (SELECT level FROM v) * weight) AS target FROM w),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
    p AS (SELECT d.doc_id, d.size, r.source_size, r.target, d.u, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS p, d.source,
          target - floor(ratio) * source_size AS rest FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
    c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING) AS upto FROM p)
    SELECT doc_id, size, source_size, target,
           ((whole + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
           (whole + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM c
"""
