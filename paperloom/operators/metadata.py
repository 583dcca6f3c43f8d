"""Metadata tuples with provenance, their projection by authority, and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import newest

#: Sources of a tuple and their authority.
AUTHORITY = {"frontmatter": 4, "docx_core_xml": 4, "html_meta": 4, "pdf_info": 4, "extractor": 3, "derived": 2, "skill_advisory": 1, "agent_inferred": 1}


def authority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair]), source), F.lit(0))


def unpivot(table: DataFrame, fields: list[str], source: Column) -> DataFrame:
    """Wide metadata rows as tuples (node_id, key, value, source, updated_at); blank values give none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in fields]))
    rows = table.select("node_id", source.alias("source"), "updated_at", pairs.alias("x")).select("node_id", "x.key", "x.value", "source", "updated_at")
    return rows.filter(F.trim("value") != "")


def upsert(tuples: DataFrame) -> DataFrame:
    """One tuple per (node_id, key, source), the newest."""
    return newest(tuples, ["node_id", "key", "source"], [F.col("updated_at").desc_nulls_last(), F.col("value").desc()])


def project(tuples: DataFrame, fields: list[str]) -> DataFrame:
    """One row per node: of each field the value of the highest authority, then the newest; '' if there is none."""
    columns = [F.coalesce(F.max(F.when(F.col("key") == f, F.struct(authority(F.col("source")).alias("a"), "updated_at", "value")))["value"], F.lit("")).alias(f) for f in fields]
    return tuples.filter(F.col("key").isin(fields)).groupBy("node_id").agg(*columns)


def value_type(value: Column) -> Column:
    """date, ref, number or string, tested in this order."""
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?\z"), "date").when(value.rlike(r"^\[\[[^\]]+\]\]\z"), "ref")
        .when(value.rlike(r"^[+\-]?\d+(?:\.\d+)?\z"), "number").otherwise("string")
    )


def digests(tuples: DataFrame) -> DataFrame:
    """(node_id, digest): one digest of all tuples of a node, whatever their order."""
    line = F.concat_ws("\t", "key", "source", "value")
    return tuples.groupBy("node_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s", " ")


def mentions(sections: DataFrame) -> DataFrame:
    """(node_id, name, n): wikilink targets named in the sections."""
    names = F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]|#\n]+)[^\[\]\n]*\]\]"), 1))
    rows = sections.select("node_id", names.alias("name")).filter(F.trim("name") != "")
    return rows.groupBy("node_id", F.trim("name").alias("name")).agg(F.count("*").alias("n"))


MOST_ALIASES = 200


def entities(found: DataFrame, kind: str = "concept", most: int | None = MOST_ALIASES) -> DataFrame:
    """(entity_id, entity_type, name, aliases, n_nodes): mentions merged by normalised name, with the ``most`` least spellings (null: all)."""
    named = found.withColumn("norm", normal_name(F.col("name")))
    spelled = _spellings(named.select(F.lit(kind).alias("entity_type"), "norm", "name"), most)
    nodes = named.groupBy("norm").agg(F.countDistinct("node_id").alias("n_nodes"))
    return spelled.join(nodes, "norm").select(entity_id("entity_type", "norm"), "entity_type", "name", F.array_join("aliases", " | ").alias("aliases"), "n_nodes")


def entity_id(kind: str, norm: str) -> Column:
    return F.sha2(F.concat_ws("|", kind, norm), 256).alias("entity_id")


def _spellings(named: DataFrame, most: int | None) -> DataFrame:
    """(entity_type, norm, name, aliases): spellings are cut to the least ``most`` before they are collected."""
    rows = named.select("entity_type", "norm", "name").distinct()
    if most is not None:
        w = Window.partitionBy("entity_type", "norm").orderBy("name")
        rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return rows.groupBy("entity_type", "norm").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("name")).alias("aliases"))


def typed_entities(mentioned: DataFrame, vocabulary: DataFrame | None = None, most: int | None = MOST_ALIASES) -> DataFrame:
    """(entity_id, entity_type, name, aliases, n_mentions, n_nodes) of mentions (node_id, name, entity_type, alias).

    A name without a stated type (``concept``) belongs to the entity that bears it as name or alias, if one has a
    type; other names are concepts.  ``vocabulary`` (entity_type) keeps the listed types only; empty keeps all.
    """
    return _entities_of(mentions_of_entities(mentioned, vocabulary), most)


def mentions_of_entities(mentioned: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(entity_id, entity_type, norm, spelling, node_id): every mention under the entity it means."""
    rows = mentioned.withColumns({"entity_type": F.lower(F.trim("entity_type")), "norm": normal_name(F.col("name"))})
    stated = rows.filter("entity_type <> 'concept'")
    known = stated.select(F.col("entity_type").alias("_type"), F.col("norm").alias("_norm"), "norm")
    known = known.unionByName(stated.filter("alias is not null").select(F.col("entity_type").alias("_type"), F.col("norm").alias("_norm"), normal_name(F.col("alias")).alias("norm")))
    owner = known.groupBy("norm").agg(F.min(F.struct("_type", "_norm")).alias("o"))
    loose = rows.filter("entity_type = 'concept'").join(owner, "norm", "left")
    loose = loose.withColumns({"entity_type": F.coalesce("o._type", "entity_type"), "norm": F.coalesce("o._norm", "norm")}).drop("o")
    every = stated.select("entity_type", "norm", F.coalesce("alias", "name").alias("spelling"), "node_id").unionByName(
        loose.select("entity_type", "norm", F.coalesce("alias", "name").alias("spelling"), "node_id")
    )
    if vocabulary is not None and not vocabulary.isEmpty():
        every = every.join(vocabulary.select(F.lower(F.trim("entity_type")).alias("entity_type")).distinct(), "entity_type", "left_semi")
    return every.select(entity_id("entity_type", "norm"), "*")


def _entities_of(every: DataFrame, most: int | None) -> DataFrame:
    spelled = _spellings(every.withColumnRenamed("spelling", "name"), most)
    counts = every.groupBy("entity_type", "norm").agg(F.count("*").alias("n_mentions"), F.countDistinct("node_id").alias("n_nodes"))
    joined = spelled.join(counts, ["entity_type", "norm"])
    return joined.select(entity_id("entity_type", "norm"), "entity_type", "name", F.array_join("aliases", " | ").alias("aliases"), "n_mentions", "n_nodes")


def orphan_entities(known: DataFrame, found: DataFrame) -> DataFrame:
    """Entities (entity_id, name) that nothing mentions."""
    return known.join(found.select(F.col("entity_id")), "entity_id", "left_anti")
