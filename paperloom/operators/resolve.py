"""Link resolution: raw references to edges between existing nodes.

Candidates are found by equality joins on lower-cased paths, file names (only ``.md`` taken off) and
document names; of several candidates one in the folder of the referring file wins, then the shortest
id, then the first path.  Links the rules do not cover (HTML and Word links) stay unresolved, as do
same-file anchors outside the top folder, whose path doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.orphans import relative_path
from paperloom.tables import Graph


def folder(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def resolve(refs: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """(ref_id, source, target, kind, line); target null where a reference stays unresolved.

    ``documents`` (id, file_path, name), ``headings`` (id).
    """
    text, kind = F.col("reference_text"), F.col("reference_kind")
    refs = refs.select(F.col("id").alias("ref_id"), F.col("from_node_id").alias("source"), "reference_text", "reference_kind", "line", "file_path")
    links = refs.filter(kind == "markdown_link").select(
        "*", F.regexp_extract("reference_text", r"^([^#]*)", 1).alias("t"), F.regexp_extract("reference_text", r"#(.*)$", 1).alias("anchor")
    ).filter("t <> '' or anchor <> ''")
    links = links.withColumn("t", F.when(F.col("t") == "", F.col("file_path")).otherwise(F.col("t")))
    links = links.withColumn("path", relative_path(F.col("file_path"), F.regexp_replace("t", "^/+", "")))
    by_path = documents.groupBy(F.lower("file_path").alias("path")).agg(F.max("id").alias("doc"))
    at = links.join(by_path, "path").withColumn("deep", F.when(F.col("anchor") != "", F.concat("doc", F.lit("#"), "anchor")))
    at = at.join(headings.select(F.col("id").alias("deep"), F.lit(True).alias("is_heading")), "deep", "left")
    direct = at.select("ref_id", "source", F.when(F.col("is_heading"), F.col("deep")).otherwise(F.col("doc")).alias("target"), F.lit("references").alias("kind"), "line")

    name = F.trim(F.regexp_extract(text, r"^([^|#]*)", 1))
    wiki = refs.filter(kind.isin("wikilink", "embed")).withColumn("t", name).filter("t <> ''")
    extension = F.lower(F.regexp_extract("t", r"(\.[^./]*)$", 1))
    wiki = wiki.filter((kind == "wikilink") | extension.isin("", ".md"))
    wiki = wiki.withColumn("key", F.lower(F.regexp_replace("t", r"\.md$", "")))
    keys = documents.select(
        "id", "file_path",
        F.explode(F.array(
            F.struct(F.lit(0).alias("rank"), F.lower(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.md$", "")).alias("key")),
            F.struct(F.lit(1).alias("rank"), F.lower("name").alias("key")),
        )).alias("k"),
    ).select("id", F.col("file_path").alias("doc_path"), "k.*")
    # a name that many documents share is cut to its best candidates before it meets its references:
    # one per folder and one for all other folders
    near = Window.partitionBy("key", "rank", folder(F.col("doc_path"))).orderBy(F.octet_length("id"), "doc_path")
    keys = keys.withColumn("n", F.row_number().over(near)).filter("n = 1").drop("n")
    best = keys.groupBy("key", "rank").agg(F.min(F.struct(F.octet_length("id").alias("len"), "doc_path", "id")).alias("b"))
    first = keys.groupBy("key").agg(F.min("rank").alias("rank"))
    best = best.join(first, ["key", "rank"]).select("key", F.col("b.id").alias("any_id"))
    local = keys.join(first, ["key", "rank"]).select("key", folder(F.col("doc_path")).alias("dir"), F.col("id").alias("same_id"))
    found = wiki.withColumn("dir", folder(F.col("file_path"))).join(best, "key").join(local, ["key", "dir"], "left")
    edge = F.when(kind == "embed", "embeds").otherwise("wikilinks_to")
    fuzzy = found.select("ref_id", "source", F.coalesce("same_id", "any_id").alias("target"), edge.alias("kind"), "line")

    outside = refs.filter(kind == "external").select("ref_id", "source", F.col("source").alias("target"), F.lit("links_external").alias("kind"), "line")
    done = direct.unionByName(fuzzy).unionByName(outside)
    left = refs.join(done.select("ref_id"), "ref_id", "left_anti")
    return done.unionByName(left.select("ref_id", "source", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("kind"), "line"))


def resolve_graph(g: Graph) -> DataFrame:
    headings = g.nodes("kind").filter("kind = 'heading'").select("id")
    return resolve(g.table("unresolved_refs"), g.documents("name"), headings)


def cross_project(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """(ref_id, target_project, target): wikilinks of the form project/name or project/folders/name into another project."""
    parts = F.regexp_extract(F.lower(F.regexp_extract("reference_text", r"^\s*([^|#]*)", 1)), r"^[^/]+/.*[^/]\s*$", 0)
    links = refs.filter("reference_kind = 'wikilink'").select(F.col("id").alias("ref_id"), "file_path", parts.alias("p")).filter("p <> ''")
    links = links.select("ref_id", F.substring_index("file_path", "/", 1).alias("own"), F.substring_index("p", "/", 1).alias("project"),
                         F.regexp_replace(F.trim(F.substring_index("p", "/", -1)), r"\.md$", "").alias("key"))
    targets = documents.select(
        F.lower(F.substring_index("file_path", "/", 1)).alias("project"), F.lower(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.md$", "")).alias("key"), "id"
    ).groupBy("project", "key").agg(F.min("id").alias("target"))
    return links.filter(F.lower("own") != F.col("project")).join(targets, ["project", "key"]).select("ref_id", F.col("project").alias("target_project"), "target")
