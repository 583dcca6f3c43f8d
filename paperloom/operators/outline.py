"""Lines of an outline: where a heading ends, and which heading encloses a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import MAX_LEVEL
from paperloom.tables import Graph

BLOCK_LINES = 4096


def end_lines(g: Graph) -> DataFrame:
    """(id, last_line): the line before the next heading of the same or a smaller level, else the document's end.

    Headings without a line stand at line 0, those without a level at level 1; levels outside 1 to 10 count as the nearest.

    Blocks of lines are scanned upwards on their own; what follows a block comes from block
    summaries, so one huge file spreads over many tasks.
    """
    nodes = g.nodes("kind", "file_path", "start_line", "end_line", "level").filter("kind in ('heading', 'document')")
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(MAX_LEVEL))
    heads = nodes.filter("kind = 'heading'").withColumns({"level": level, "start_line": F.coalesce("start_line", F.lit(0))})
    heads = heads.withColumn("block", F.floor(F.col("start_line") / BLOCK_LINES).cast("int"))
    levels = range(1, MAX_LEVEL + 1)
    starts = {k: F.when(F.col("level") == k, F.col("start_line")) for k in levels}
    later = Window.partitionBy("file_path", "block").orderBy("start_line").rangeBetween(1, Window.unboundedFollowing)
    here = heads.withColumns({f"in_{k}": F.min(s).over(later) for k, s in starts.items()})
    summary = heads.groupBy("file_path", "block").agg(*[F.min(s).alias(f"first_{k}") for k, s in starts.items()])
    after = Window.partitionBy("file_path").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select("file_path", "block", *[F.min(f"first_{k}").over(after).alias(f"from_{k}") for k in levels])
    carry = carry.withColumnsRenamed({"file_path": "_file", "block": "_block"})
    joined = here.join(carry, F.col("file_path").eqNullSafe(F.col("_file")) & (F.col("block") == F.col("_block")))
    following = F.least(*[F.when(F.col("level") >= k, F.coalesce(f"in_{k}", f"from_{k}")) for k in levels])
    docs = nodes.filter("kind = 'document'").select(F.col("id").alias("file_path"), F.col("end_line").alias("doc_end"))
    return joined.withColumn("next", following).join(docs, "file_path", "left").select("id", F.coalesce(F.col("next") - 1, "doc_end").alias("last_line"))


def nearest_headings(g: Graph, lines: DataFrame) -> DataFrame:
    """(ref_id, node_id): the last heading at or above a line of a file, else the document.

    ``lines`` (id, file_path, line).  Headings and lines go through one running window per file and
    block; the heading that earlier blocks leave open comes from block summaries.
    """
    heads = g.nodes("kind", "file_path", "start_line").filter("kind = 'heading'")
    rows = heads.select("file_path", F.col("start_line").alias("line"), F.lit(0).alias("what"), F.col("id").alias("node"), F.lit(None).cast("long").alias("ref_id"))
    rows = rows.unionByName(lines.select("file_path", "line", F.lit(1).alias("what"), F.lit(None).cast("string").alias("node"), F.col("id").alias("ref_id")))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("line") / BLOCK_LINES).cast("int"), F.lit(-1)))
    w = Window.partitionBy("file_path", "block").orderBy("line", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("inside", F.last("node", ignorenulls=True).over(w)).filter("what = 1")
    summary = rows.filter("what = 0").groupBy("file_path", "block").agg(F.max(F.struct("line", "node"))["node"].alias("end"))
    # blocks that hold lines but no heading still need what came before
    places = rows.select("file_path", "block").distinct().join(summary, ["file_path", "block"], "left")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = places.select("file_path", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = here.join(carry, ["file_path", "block"])
    return found.select("ref_id", F.coalesce("inside", "carried", "file_path").alias("node_id"))
