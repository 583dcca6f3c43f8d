"""Edges of a document, impact (who refers to it, directly and through others) and shortest paths.

Traversals run level by level over edges between documents; each level is one join with the frontier
and one anti join with what has been visited, and is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut
from paperloom.tables import REFERENCES, Graph


def incoming(g: Graph, document: str) -> DataFrame:
    """Edges to any node of the document's file."""
    targets = g.nodes("file_path").filter(F.col("file_path") == document).select(F.col("id").alias("target"))
    rows = g.edges.filter(F.col("kind").isin(REFERENCES)).join(targets, "target", "left_semi")
    return rows.select("source", "target", "kind", "line").orderBy("source", "kind", "line", "target")


def outgoing(g: Graph, document: str) -> DataFrame:
    sources = g.nodes("file_path").filter(F.col("file_path") == document).select(F.col("id").alias("source"))
    rows = g.edges.filter(F.col("kind").isin([*REFERENCES, "links_external"])).join(sources, "source", "left_semi")
    return rows.select("source", "target", "kind", "line").orderBy("target", "kind", "line", "source")


def edge_summary(g: Graph) -> DataFrame:
    """Per document: incoming and outgoing edges, other documents at their ends, edges inside the file, external links."""
    nodes = g.nodes("file_path")
    ends = g.edges.filter(F.col("kind").isin([*REFERENCES, "links_external"])).select("source", "target", "kind")
    ends = ends.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("s")), "source", "left")
    ends = ends.join(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("t")), "target", "left")
    external, same = F.col("kind") == "links_external", F.col("s") == F.col("t")
    out = ends.filter("s is not null").groupBy(F.col("s").alias("file_path")).agg(
        F.count("*").alias("n_out"), F.countDistinct(F.when(~external & ~same, F.col("t"))).alias("n_out_documents"),
        F.count_if(~external & same).alias("n_same"), F.count_if(external).alias("n_external"),
    )
    into = ends.filter(~external & F.col("t").isNotNull()).groupBy(F.col("t").alias("file_path")).agg(
        F.count("*").alias("n_in"), F.countDistinct(F.when(~same, F.col("s"))).alias("n_in_documents")
    )
    docs = g.documents().select("file_path")
    return docs.join(into, "file_path", "left").join(out, "file_path", "left").na.fill(0)


def document_edges(g: Graph) -> DataFrame:
    """(src, tgt, source, kind, line, target): reference edges with the documents at their ends; unknown nodes stand for themselves."""
    nodes = g.nodes("file_path")
    rows = g.edges.filter(F.col("kind").isin(REFERENCES)).select("source", "target", "kind", "line")
    rows = rows.join(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("tgt")), "target")
    rows = rows.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("src")), "source", "left")
    return rows.select(F.coalesce("src", "source").alias("src"), "tgt", "source", "kind", "line", "target")


def impact(g: Graph, document: str, depth: int = 2) -> DataFrame:
    """(document, level, kind, via): documents that refer to ``document`` within ``depth`` steps.

    The edge that counts for a document is the first one in breadth-first order: frontier documents
    in the order they were found, then source, kind, line and target.
    """
    depth = min(max(depth, 1), 5)
    edges = cut(document_edges(g).distinct())
    start = g.spark.createDataFrame([(document,)], "document string").select("document", F.array("document").alias("place"))
    visited, frontier, levels = start.select("document"), start, []
    for level in range(1, depth + 1):
        seen = edges.join(frontier.withColumnRenamed("document", "tgt"), "tgt").join(visited.withColumnRenamed("document", "src"), "src", "left_anti")
        first = F.min(F.struct("place", "source", "kind", "line", "target", "tgt")).alias("f")
        found = cut(seen.groupBy("src").agg(first).select(
            F.col("src").alias("document"), F.lit(level).alias("level"), "f.kind", F.when(F.lit(level > 1), F.col("f.tgt")).otherwise("").alias("via"),
            F.concat("f.place", F.array("f.source")).alias("place"),
        ))
        levels.append(found)
        frontier, visited = found.select("document", "place"), visited.union(found.select("document"))
        if found.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("place")


def shortest_paths(g: Graph, document: str, most: int = 10) -> DataFrame:
    """(document, hops, path): for every document reachable by references, a shortest path (least by ids)."""
    edges = cut(document_edges(g).filter("src <> tgt").select("src", "tgt").distinct())
    start = g.spark.createDataFrame([(document,)], "document string").select("document", F.lit(0).alias("hops"), F.array("document").alias("path"))
    reached, frontier = start, start
    for hop in range(1, most + 1):
        ahead = edges.join(frontier.select(F.col("document").alias("src"), "path"), "src").join(reached.select(F.col("document").alias("tgt")), "tgt", "left_anti")
        found = cut(ahead.groupBy("tgt").agg(F.min("path").alias("p")).select(F.col("tgt").alias("document"), F.lit(hop).alias("hops"), F.concat("p", F.array("tgt")).alias("path")))
        if found.isEmpty():
            break
        reached, frontier = reached.unionByName(found), found
    return reached


def trace(g: Graph, start: str, end: str, most: int = 10) -> DataFrame:
    return shortest_paths(g, start, most).filter(F.col("document") == end)
