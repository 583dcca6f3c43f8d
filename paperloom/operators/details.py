"""What is known about single nodes: lookups, node details and the evidence behind search hits.

All of these answer for any number of nodes at once: one row per asked node, its parts as arrays of structs that
are cut to the stated limits before they are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import slug
from paperloom.operators import quality
from paperloom.operators.context import CONTENT_BYTES, cut_bytes
from paperloom.operators.search import sections
from paperloom.operators.traverse import document_edges
from paperloom.tables import GOVERNANCE, REFERENCES, RESEARCH, Graph


def resolve_names(g: Graph, asked: DataFrame) -> DataFrame:
    """(asked, id): the node each text means: an id, path or qualified name, else the document of that name without case.

    ``asked`` (asked); of several nodes a document wins, then the least id; texts that mean nothing have a null id.
    """
    nodes = g.nodes("kind", "name", "qualified_name", "file_path")
    texts = asked.select("asked").distinct()
    keys = F.explode(F.array_distinct(F.array_compact(F.array("id", "qualified_name", F.when(F.col("kind").isin("document", "code_file"), F.col("file_path"))))))
    exact = nodes.select(keys.alias("asked"), (F.col("kind") != "document").alias("later"), "id")
    named = nodes.filter("kind = 'document'").select(F.lower("name").alias("low"), "id")
    first = texts.join(exact, "asked").groupBy("asked").agg(F.min(F.struct("later", "id"))["id"].alias("exact_id"))
    second = texts.withColumn("low", F.lower(F.trim("asked"))).join(named, "low").groupBy("asked").agg(F.min("id").alias("name_id"))
    return texts.join(first, "asked", "left").join(second, "asked", "left").select("asked", F.coalesce("exact_id", "name_id").alias("id"))


def nodes_of_files(g: Graph, files: DataFrame) -> DataFrame:
    """Nodes of the files (file_path), in order of their lines."""
    w = Window.partitionBy("file_path").orderBy(F.col("start_line").asc_nulls_first(), "id")
    return g.nodes().join(files.select("file_path").distinct(), "file_path", "left_semi").withColumn("place", F.row_number().over(w))


def child_headings(g: Graph, parents: DataFrame) -> DataFrame:
    """(parent, id, name, level, start_line, place): the headings that nodes (id) contain, in order of their lines."""
    inside = g.edges.filter("kind = 'contains'").join(parents.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    heads = g.nodes("kind", "name", "level", "start_line").filter("kind = 'heading'")
    w = Window.partitionBy("parent").orderBy(F.col("start_line").asc_nulls_first(), "id")
    rows = inside.select(F.col("source").alias("parent"), F.col("target").alias("id")).distinct().join(heads, "id")
    return rows.select("parent", "id", "name", "level", "start_line", F.row_number().over(w).alias("place"))


def section_by_name(g: Graph, asked: DataFrame) -> DataFrame:
    """(file_path, section, node_id, content): the heading of a file with that name, else with that slug (a leading # does not
    count), and its indexed text cut to 2,000 bytes; ``asked`` (file_path, section).  Nothing fits: a null node."""
    heads = g.nodes("kind", "name", "file_path", "start_line").filter("kind = 'heading'").select("id", "name", "file_path", "start_line")
    wanted = asked.select("file_path", "section").distinct().withColumn("slug", slug(F.regexp_replace("section", "^#", "")))
    rows = wanted.join(heads, "file_path").withColumn("fit", F.when(F.col("name") == F.col("section"), 0).when(F.substring_index("id", "#", -1) == F.col("slug"), 1)).filter("fit is not null")
    best = rows.groupBy("file_path", "section").agg(F.min(F.struct("fit", "start_line", "id"))["id"].alias("node_id"))
    text = sections(g).select("node_id", cut_bytes("text", CONTENT_BYTES).alias("content"))
    return wanted.drop("slug").join(best, ["file_path", "section"], "left").join(text, "node_id", "left").select("file_path", "section", "node_id", "content")


def _listed(rows: DataFrame, key: str, order: list, most: int, fields: list[str], name: str) -> DataFrame:
    """(key, n_<name>, <name>): the number of rows and the first ``most`` as an array, cut before they are collected."""
    w = Window.partitionBy(key)
    first = rows.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(*order))}).filter(F.col("_k") <= most)
    items = F.transform(F.sort_array(F.collect_list(F.struct("_k", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return first.groupBy(key).agg(F.max("_n").alias(f"n_{name}"), items.alias(name))


def references(g: Graph, ids: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Incoming and outgoing edges of documents (document): edges of any node of their file."""
    members = g.nodes("file_path").join(ids.select(F.col("document").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("id").alias("member"), F.col("file_path").alias("document"))
    inner = g.edges.filter(F.col("kind").isin(REFERENCES)).join(members.withColumnRenamed("member", "target"), "target").select("document", "source", "kind", "line", "target")
    url = F.when(F.col("kind") == "links_external", F.get_json_object("metadata", "$.url")).otherwise(F.col("target"))
    outer = g.edges.filter(F.col("kind").isin([*REFERENCES, "links_external"])).withColumn("target", url)
    outer = outer.join(members.withColumnRenamed("member", "source"), "source").select("document", "source", "kind", "line", "target")
    order = lambda end: [end, "kind", "line", "source", "target"]
    return _listed(inner, "document", order("source"), most, ["source", "kind", "line"], "incoming"), _listed(outer, "document", order("target"), most, ["target", "kind", "line"], "outgoing")


def node_details(g: Graph, asked: DataFrame, as_of: str, most: int = 20) -> DataFrame:
    """One row per asked text: the document it means, its outline, edges, metadata, quality and history; ``asked`` (asked).

    A heading or tag stands for the document of its file; texts that mean nothing keep a row of nulls.
    """
    g = g.settled()
    meant = resolve_names(g, asked)
    nodes = g.nodes("kind", "name", "file_path", "start_line", "end_line", "metadata", "body_excerpt")
    rows = meant.join(nodes.select("id", "file_path"), "id", "left").withColumnRenamed("file_path", "document").select("asked", "id", "document")
    docs = nodes.filter("kind = 'document'").select(F.col("id").alias("document"), "name", "start_line", "end_line", "metadata", "body_excerpt")
    heads = g.nodes("kind", "name", "level", "start_line", "file_path").filter("kind = 'heading'")
    heads = heads.join(rows.select(F.col("document").alias("file_path")).distinct(), "file_path", "left_semi").withColumnRenamed("file_path", "document")
    outline = _listed(heads, "document", [F.col("start_line").asc_nulls_first(), "id"], 10 * most, ["name", "level", "start_line"], "headings")
    incoming, outgoing = references(g, rows, most)
    score = quality.scores(g, as_of).select(F.col("node_id").alias("document"), "score", F.col("level").alias("quality"), "issues")
    history = g.history.select(F.col("path").alias("document"), "commit_count", "last_commit_at")
    gov = g.governance.select(F.col("node_id").alias("document"), F.struct(*GOVERNANCE).alias("governance"))
    res = g.research.select(F.col("node_id").alias("document"), F.struct(*RESEARCH).alias("research"))
    for part in (docs, outline, incoming, outgoing, score, history, gov, res):
        rows = rows.join(part, "document", "left")
    return rows.na.fill(0, ["n_headings", "n_incoming", "n_outgoing"])


def pack_options(content: int = 2000, depth: int = 2, most: int = 5) -> tuple[int, int, int]:
    """Bytes of content, depth of impact and number of references of an evidence pack, within their bounds."""
    return min(max(content, 0), 6000), min(max(depth, 1), 3), min(max(most, 1), 20)


def impacted(g: Graph, ids: DataFrame, depth: int) -> DataFrame:
    """(document, impacted, level): documents that refer to each asked document (document) within ``depth`` steps, at their least level.

    All asked documents are walked together, level by level; each level is one join with the document edges.
    """
    edges = document_edges(g).select("src", "tgt").distinct()
    seen = ids.select("document").distinct().select("document", F.col("document").alias("impacted"), F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        ahead = edges.join(frontier.select("document", F.col("impacted").alias("tgt")), "tgt").select("document", F.col("src").alias("impacted")).distinct()
        frontier = ahead.join(seen.select("document", "impacted"), ["document", "impacted"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen.filter("level > 0")


def evidence_pack(g: Graph, hits: DataFrame, as_of: str, content: int = 2000, depth: int = 2, most: int = 5) -> DataFrame:
    """One row per hit (place, id): identity, indexed snapshot, metadata, quality, references and impact by level."""
    g = g.settled()
    content, depth, most = pack_options(content, depth, most)
    nodes = g.nodes("kind", "name", "qualified_name", "file_path", "start_line", "end_line")
    rows = hits.select("place", "id").join(nodes, "id", "left").withColumn("document", F.col("file_path"))
    chunks = g.table("section_chunks").select(F.col("node_id").alias("id"), "text", "heading_path", "content_hash", "section_hash")
    chunks = chunks.join(rows.select("id").distinct(), "id", "left_semi")
    last = F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "heading_path", "content_hash", "section_hash"))
    snap = chunks.groupBy("id").agg(last.alias("s")).select("id", "s.*")
    snap = snap.select("id", "heading_path", "content_hash", "section_hash", cut_bytes("text", content).alias("content"), (F.octet_length("text") > content).alias("truncated"))
    incoming, outgoing = references(g, rows, most)
    impact = impacted(g, rows.filter("document is not null"), depth).groupBy("document").pivot("level", list(range(1, depth + 1))).count()
    impact = impact.select("document", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"impact_{k}") for k in range(1, depth + 1)])
    score = quality.scores(g, as_of).select(F.col("node_id").alias("document"), "score", F.col("level").alias("quality"), "issues")
    gov = g.governance.select(F.col("node_id").alias("document"), F.struct(*GOVERNANCE).alias("governance"))
    res = g.research.select(F.col("node_id").alias("document"), F.struct(*RESEARCH).alias("research"))
    rows = rows.join(snap, "id", "left")
    for part in (incoming, outgoing, impact, score, gov, res):
        rows = rows.join(part, "document", "left")
    return rows.na.fill(0, ["n_incoming", "n_outgoing", *[f"impact_{k}" for k in range(1, depth + 1)]])
