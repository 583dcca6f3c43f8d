"""Mixing sources to target shares (problem 9).

Every source may fill its share of the size of all documents.  A source that is larger than its
share gives whole copies and one part of itself; the part is the documents whose hash lies under a
threshold.  Thresholds come from nested histograms: tokens are summed by source and hash bucket, the
bucket in which the budget runs out is the only one that is split into finer buckets, and so on down
to the last bits of the hash; the documents are then filtered, never sorted.  Each histogram has at
most sources x 4,096 rows, whatever the number of documents, and is pre-aggregated before its
shuffle, so a source that holds a third of all documents is no hot key.

Defined results: sources are compared trimmed and without case; documents of sources without target
count in the total only; a source without documents reaches share 0; null texts have size 0; repeated
document rows count as often as they come; a missing target share or repeat limit counts as 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import stored

BITS, LEVELS = 12, 5  # 5 histograms of 4,096 buckets use 60 bits of the hash


def source_key(c: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def plan_mix(documents: DataFrame, key: str, size: str, source: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sized documents, plan per source: budget, supply, copies, threshold, short)."""
    docs = stored(
        documents.select(F.col(key).alias("key"), source_key(F.col(source)).alias("s"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
                         F.shiftrightunsigned(F.xxhash64(key), 4).alias("h")),
        "mix-documents",
    )
    goal = targets.filter("source is not null").groupBy(source_key(F.col("source")).alias("s")).agg(
        F.min("source").alias("source"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("repeats"),
    )
    sums = docs.groupBy("s").agg(F.sum("size").alias("supply"))
    total = sums.agg(F.sum("supply")).first()[0] or 0
    plan = goal.join(sums, "s", "left").withColumn("total", F.lit(total).cast("long"))
    supply, budget = F.coalesce("supply", F.lit(0)), F.col("share") * F.col("total")
    whole = F.when(supply > 0, F.least(F.floor(budget / supply), F.col("repeats"))).otherwise(F.col("repeats"))
    plan = plan.select("s", "source", "share", "repeats", "total", supply.alias("supply"), budget.alias("budget"),
                       whole.cast("int").alias("copies"), (supply * F.col("repeats") < budget).alias("short"))
    rest = F.when(F.col("copies") < F.col("repeats"), F.col("budget") - F.col("copies") * F.col("supply")).otherwise(0.0)
    # the state of the search: how much is still to fill, below which hash, inside which bucket
    plan = stored(plan.withColumns({"left_over": rest, "prefix": F.lit(0).cast("long"), "open": rest > 0}), "mix-plan")
    boundary = docs.select("s", "h", "size")  # after the first level: the documents of the boundary buckets only, one in 4,096
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = boundary.join(F.broadcast(plan.filter("open").select("s", "prefix")), "s").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        buckets = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        buckets = buckets.withColumn("before", up_to - F.col("n")).join(F.broadcast(plan.select("s", "left_over")), "s")
        edge = buckets.filter((F.col("before") <= F.col("left_over")) & (F.col("before") + F.col("n") > F.col("left_over")))
        edge = edge.groupBy("s").agg(F.min(F.struct("bucket", "before")).alias("e"))
        plan = stored(
            plan.join(edge, "s", "left").select(
                "s", "source", "share", "repeats", "total", "supply", "budget", "copies", "short",
                F.when(F.col("e").isNotNull(), F.col("left_over") - F.col("e.before")).otherwise(F.col("left_over")).alias("left_over"),
                F.when(F.col("open"), F.coalesce(F.col("e.bucket"), F.shiftleft(F.col("prefix") + 1, BITS) - 1)).otherwise(0).alias("prefix"), "open",
            ),
            "mix-plan",
        )
        if level == 0:
            at_edge = F.shiftright("h", shift) == F.col("prefix")
            boundary = stored(boundary.join(F.broadcast(plan.filter("open").select("s", "prefix")), "s").filter(at_edge).drop("prefix"), "mix-boundary")
    return docs, plan


def mix(documents: DataFrame, key: str, size: str, source: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selection: key, source, size, n_copies; report: per source what was asked and reached).

    ``reached_share`` is the source's part of all that was selected, ``reached_of_total`` its part of
    the size of all documents, which is what the targets refer to; ``short`` marks sources that stay
    below their target although every document is used ``max_repeats`` times.
    """
    docs, plan = plan_mix(documents, key, size, source, targets)
    chosen = docs.join(F.broadcast(plan.select("s", "source", "copies", "prefix", "open")), "s")
    copies = F.col("copies") + F.when(F.col("open") & (F.col("h") < F.col("prefix")), 1).otherwise(0)
    selection = chosen.select("key", "source", "size", copies.alias("n_copies")).filter("n_copies > 0")
    reached = selection.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_copies")).alias("reached_tokens"), F.count("*").alias("n_documents"), F.max("n_copies").alias("most_copies")
    )
    report = plan.select("source", "share", "repeats", "supply", "total", "short").join(reached, "source", "left").na.fill(0)
    everything = F.sum("reached_tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
    report = report.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("supply").alias("supply_tokens"), F.col("total").alias("total_tokens"),
        "n_documents", "most_copies", "reached_tokens", F.when(everything > 0, F.col("reached_tokens") / everything).otherwise(0.0).alias("reached_share"),
        F.when(F.col("total") > 0, F.col("reached_tokens") / F.col("total")).otherwise(0.0).alias("reached_of_total"), "short",
    )
    return selection.withColumnRenamed("key", key), report
