"""Incremental maintenance: what changed between two states, and what goes with a removed file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_GONE, SMALL = 0.5, 10


def diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed or removed records between two states with one row per key."""
    a, b = before.select(F.col(key), F.col(digest).alias("_a"), F.lit(1).alias("_x")), after.select(F.col(key), F.col(digest).alias("_b"), F.lit(1).alias("_y"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def merge(base: DataFrame, fresh: DataFrame, path: str, touched: DataFrame) -> DataFrame:
    """Rows of ``base`` whose file was not touched, with the new rows of the touched files."""
    return base.join(touched.select(path).distinct(), path, "left_anti").unionByName(fresh, allowMissingColumns=True)


def prune_guard(known: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """(n_known, n_gone, refused): absent files; pruning is refused if most of a real collection is gone."""
    counts = known.select(path).distinct().join(present.select(path, F.lit(1).alias("_here")).distinct(), path, "left").agg(
        F.count("*").alias("n_known"), F.count_if(F.col("_here").isNull()).alias("n_gone")
    )
    return counts.withColumn("refused", (F.col("n_known") >= SMALL) & (F.col("n_gone") > F.col("n_known") * MOST_GONE))


def cascade(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the removed files (path); an edge goes with either end."""
    gone = nodes.join(removed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept = nodes.join(removed.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept, left


def cascade_all(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table of a collection without what belongs to removed files (path).

    Rows with a file_path go with their file, rows with a node_id with their node, edges with either end,
    references with their node; files go themselves, and entities that nothing mentions any longer.
    """
    files = removed.select(F.col("path").alias("file_path")).distinct()
    out = dict(tables)
    gone = tables["nodes"].join(files, "file_path", "left_semi").select("id").distinct()
    for name, rows in tables.items():
        if name == "files":
            out[name] = rows.join(removed.select("path").distinct(), "path", "left_anti")
        elif name == "edges":
            out[name] = rows.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        elif "file_path" in rows.columns:
            out[name] = rows.join(files, "file_path", "left_anti")
        elif "from_node_id" in rows.columns or "node_id" in rows.columns:
            key = "node_id" if "node_id" in rows.columns else "from_node_id"
            out[name] = rows.join(gone.withColumnRenamed("id", key), key, "left_anti")
        out[name] = out[name].select(*rows.columns)
    if {"entities", "entity_mentions"} <= tables.keys():
        out["entities"] = tables["entities"].join(out["entity_mentions"].select("entity_id").distinct(), "entity_id", "left_semi")
    return out
