"""References to records that do not exist (problem 5).

Parent keys and child keys are put into one long form (space, key, parent or child), grouped by
space and key, and the groups without a parent are the orphan keys; the child rows that carry such a
key are the orphan references, counted per table and month.  Grouping pre-aggregates before the
shuffle, so a key that holds a third of all references arrives as one row per input partition; the
child rows find their key again through a join that adaptive execution may split.

Defined results: blank or null keys are no references; repeated reference rows with their own ids
are each reported; a parent that comes back (a newer row without deletion) resolves its children;
a referring file without any index record has period ``unknown``; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.graph_tables import existing_nodes, stem
from paperloom.session import epoch_seconds


def percent_decoded(c: F.Column) -> F.Column:
    """Percent sequences to characters; '+' stays, a malformed text stays as it is."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("%"), F.coalesce(decoded, c)).otherwise(c)


def node_key(c: F.Column) -> F.Column:
    """One spelling of a node id: case, percent-encoding, leading ./ and slash direction do not count."""
    flat = F.translate(F.lower(percent_decoded(c)), "\\", "/")
    return F.when(flat.startswith("./"), F.regexp_replace(flat, r"^(?:\./)+", "")).otherwise(flat)


def relative_path(base_file: F.Column, target: F.Column) -> F.Column:
    """``target`` as seen from the folder of ``base_file``, with . and .. worked off, lower case."""
    folder = F.regexp_replace(base_file, r"[^/]*$", "")
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(F.lower(joined), "/"),
        none,
        lambda done, part: F.when(part.isin("", "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."),
              F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def orphan_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(space, key, n_references) of the keys that ``children`` use and ``parents`` lack; both (space, key)."""
    tagged = parents.select("space", "key", F.lit(1).alias("parent"), F.lit(0).alias("child")).unionByName(
        children.select("space", "key", F.lit(0).alias("parent"), F.lit(1).alias("child"))
    )
    keys = tagged.groupBy("space", "key").agg(F.max("parent").alias("parent"), F.sum("child").alias("n_references"))
    return keys.filter("parent = 0").drop("parent")


def find_orphans(edges: DataFrame, unresolved: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_table, field, ref_id, key, period) of every reference to a record that does not exist."""
    alive = existing_nodes(nodes, ["kind", "name", "file_path"])
    path, bare = F.lower("file_path"), F.lower(stem(F.col("file_path")))
    no_md = F.regexp_replace(path, r"\.md$", "")
    names = F.array(bare, path, no_md, F.lower("name"))
    parents = alive.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("node").alias("space"), node_key(F.col("id")).alias("key"))),
                F.when(
                    F.col("kind") == "document",
                    F.concat(
                        F.transform(F.array_distinct(F.array_compact(names)), lambda n: F.struct(F.lit("name").alias("space"), n.alias("key"))),
                        F.array(F.struct(F.lit("path").alias("space"), path.alias("key"))),
                    ),
                ).otherwise(F.array().cast("array<struct<space:string,key:string>>")),
            )
        ).alias("p")
    ).select("p.*")

    filled = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != ""
    targets = edges.filter(filled("target")).select(
        F.lit("edges").alias("ref_table"), F.lit("target").alias("field"), F.col("id").alias("ref_id"),
        F.lit("node").alias("space"), node_key(F.col("target")).alias("key"), F.col("source").alias("from_id"),
        F.lit(None).cast("string").alias("from_file"),
    )
    text, kind = F.col("reference_text"), F.col("reference_kind")
    wiki = F.coalesce(kind.isin("wikilink", "embed"), F.lit(False))
    bare_name = F.trim(F.regexp_extract(text, r"^([^|#]*)", 1))
    # a name counts with or without .md; names as a whole may end in .md too
    short = F.regexp_replace(F.lower(bare_name), r"\.md$", "")
    before_anchor = F.regexp_extract(text, r"^([^#]*)", 1)
    starts = F.struct(F.lit("from_node_id").alias("field"), F.lit("node").alias("space"), node_key(F.col("from_node_id")).alias("key"))
    texts = F.struct(
        F.lit("reference_text").alias("field"),
        F.when(wiki, "name").otherwise("path").alias("space"),
        F.when(wiki, short).otherwise(relative_path(F.coalesce("file_path", F.lit("")), percent_decoded(before_anchor))).alias("key"),
    )
    is_text = filled("reference_text") & ~text.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:") & (wiki | (before_anchor != ""))
    loose = unresolved.select(
        F.lit("unresolved_refs").alias("ref_table"), F.col("id").alias("ref_id"), F.col("from_node_id").alias("from_id"),
        F.col("file_path").alias("from_file"),
        F.explode(F.array_compact(F.array(F.when(filled("from_node_id"), starts), F.when(is_text, texts)))).alias("r"),
    ).select("ref_table", "r.field", "ref_id", "r.space", "r.key", "from_id", "from_file")
    children = targets.unionByName(loose)

    missing = orphan_keys(parents, children)
    found = children.join(missing.select("space", "key"), ["space", "key"])
    return _with_period(found, nodes, files)


def _with_period(found: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the month of the newest index record of the referring file."""
    indexed = files.groupBy(F.col("path").alias("from_file")).agg(F.max(epoch_seconds("indexed_at")).alias("seen"))
    of_node = nodes.groupBy(F.col("id").alias("from_id")).agg(F.max(F.struct("updated_at", "file_path")).alias("x"))
    of_node = of_node.select("from_id", F.col("x.file_path").alias("node_file"))
    from_edges = found.filter("ref_table = 'edges'").join(of_node, "from_id", "left").withColumn("from_file", F.col("node_file")).drop("node_file")
    rows = from_edges.unionByName(found.filter("ref_table <> 'edges'")).join(indexed, "from_file", "left")
    month = F.date_format(F.timestamp_seconds("seen"), "yyyy-MM")
    return rows.select("ref_table", "field", "ref_id", "space", "key", F.coalesce(month, F.lit("unknown")).alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references and distinct missing keys per table, field and month."""
    return orphans.groupBy("ref_table", "field", "period").agg(
        F.count("*").alias("n_orphans"), F.countDistinct("space", "key").alias("n_missing_keys")
    )
