"""Records that are written one by one: vectors, enrichment runs and their summaries, domain packs, project values.

Every write takes the rows there are and the new rows and returns all rows as they are after it, so a caller stores
the result as the next version of the table; nothing is changed in place.

Defined results: of several new rows for one key the newest counts, then the one with the greatest values; rows
without a key are refused into the second result where there is one and dropped elsewhere; columns keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import newest

#: Limits of what an enrichment may write.
SUMMARY_BYTES, FIELDS_MOST = 2000, 50
VECTOR_KEY = ["node_id", "model"]


def upsert(rows: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """``rows`` with ``new`` in the place of rows of the same key."""
    others = [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys and c != at and not c.startswith("vector")]
    real = new.dropna(subset=keys).select(*rows.columns)
    last = newest(real, keys, [F.col(at).desc_nulls_last(), *others])
    return rows.join(last.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(last)


def remove(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose key is in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def store_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (node_id, model, vector, digest, updated_at), one per node and model; empty vectors and such with missing parts are not stored."""
    sound = new.filter(F.size("vector") > 0).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return upsert(vectors, sound, VECTOR_KEY)


def clear_vectors(vectors: DataFrame, edges: DataFrame, model: str = "") -> tuple[DataFrame, DataFrame]:
    """(vectors, edges) without the vectors of a model (all, if none is named) and the similarity edges they made."""
    hit = F.col("model") == model if model else F.lit(True)
    by_model = F.coalesce(F.get_json_object("metadata", "$.model") == model, F.lit(False)) if model else F.lit(True)
    made = (F.col("kind") == "similar_to") & (F.get_json_object("metadata", "$.engine") == "neural") & by_model
    return vectors.filter(~F.coalesce(hit, F.lit(False))), edges.filter(~F.coalesce(made, F.lit(False)))


def write_enrichment(ledger: DataFrame, drafts: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger after the write, refused drafts with their reason).

    ``ledger`` and ``drafts``: node_id, run_id, content_hash, summary, fields (map of name to value), model, agent,
    created_at.  ``current`` (node_id, content_hash) is what the collection holds now: a draft made from another text is
    refused, as are drafts without run, summary or known node, too long summaries and too many fields.  A run is
    written once: a draft whose (node_id, run_id) the ledger has changes nothing.
    """
    held = current.groupBy("node_id").agg(F.max("content_hash").alias("_now"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank("node_id"), "no node").when(blank("run_id"), "no run").when(F.col("_now").isNull(), "unknown node")
        .when(~F.coalesce(F.col("content_hash") == F.col("_now"), F.lit(False)), "stale text")
        .when(blank("summary") & (F.size(F.coalesce("fields", F.create_map().cast("map<string,string>"))) == 0), "nothing to write")
        .when(F.octet_length("summary") > SUMMARY_BYTES, "summary too long").when(F.size("fields") > FIELDS_MOST, "too many fields")
    )
    judged = drafts.join(held, "node_id", "left").withColumn("reason", reason)
    fresh = judged.filter("reason is null").select(*ledger.columns).dropDuplicates(["node_id", "run_id"])
    fresh = fresh.join(ledger.select("node_id", "run_id"), ["node_id", "run_id"], "left_anti").select(*ledger.columns)
    return ledger.unionByName(fresh), judged.filter("reason is not null").select(*drafts.columns, "reason")


def run_history(ledger: DataFrame, node_id: str) -> DataFrame:
    return ledger.filter(F.col("node_id") == node_id).orderBy(F.col("created_at").desc(), "run_id")


def summaries(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """The newest run of each node, with ``stale`` where its text has changed since."""
    now = current.groupBy("node_id").agg(F.max("content_hash").alias("_now"))
    last = newest(ledger, ["node_id"], [F.col("created_at").desc_nulls_last(), F.col("run_id").desc()])
    return last.join(now, "node_id", "left").withColumn("stale", ~F.col("content_hash").eqNullSafe(F.col("_now"))).drop("_now")


def enrichment_tuples(ledger: DataFrame) -> DataFrame:
    """The newest runs' fields as metadata tuples of an agent: node_id, key, value, source, updated_at."""
    last = newest(ledger, ["node_id"], [F.col("created_at").desc_nulls_last(), F.col("run_id").desc()])
    return last.select("node_id", F.explode("fields").alias("key", "value"), F.lit("agent_inferred").alias("source"), F.col("created_at").alias("updated_at")).filter("trim(value) <> ''")


def project_values(values: DataFrame, new: DataFrame) -> DataFrame:
    """Values of a project (project, key, value, updated_at), the newest per key."""
    return upsert(values, new, ["project", "key"])


def sync_packs(packs: DataFrame, shipped: DataFrame) -> DataFrame:
    """Domain packs (name, version, kinds, enabled, updated_at) brought in line with what is shipped (name, version,
    kinds, updated_at): new ones begin enabled, known ones keep their flag, packs no longer shipped are left out.

    Names are compared trimmed and without case; a pack without name or without kinds is not taken.
    """
    name = F.lower(F.trim(F.col("name")))
    real = shipped.withColumn("name", name).filter((F.col("name") != "") & (F.size("kinds") > 0))
    last = newest(real, ["name"], [F.col("updated_at").desc_nulls_last(), F.col("version").desc_nulls_last()])
    flags = packs.select(name.alias("name"), F.col("enabled").alias("_was")).groupBy("name").agg(F.max("_was").alias("_was"))
    return last.join(flags, "name", "left").select("name", "version", "kinds", F.coalesce("_was", F.lit(True)).alias("enabled"), "updated_at")


def toggle_pack(packs: DataFrame, pack: str, enabled: bool) -> DataFrame:
    return packs.withColumn("enabled", F.when(F.lower(F.trim("name")) == pack.strip().lower(), F.lit(enabled)).otherwise(F.col("enabled")))


def without_disabled(nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """Nodes whose kind no pack, or at least one enabled pack, stands for."""
    kinds = packs.select(F.explode("kinds").alias("kind"), "enabled").groupBy("kind").agg(F.max("enabled").alias("_on"))
    return nodes.join(F.broadcast(kinds), "kind", "left").filter(F.coalesce("_on", F.lit(True))).select(*nodes.columns)  # a row per kind of node


def pack_stats(nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """(name, enabled, n_nodes, n_documents): nodes of the kinds a pack stands for."""
    kinds = packs.select("name", "enabled", F.explode_outer("kinds").alias("kind"))
    per = nodes.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    return kinds.join(per, "kind", "left").groupBy("name", "enabled").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("files"), F.lit(0)).alias("n_documents"))


def stale_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model, n_vectors, n_stale, n_missing) for documents (id, digest) and vectors (id, model, digest)."""
    models = vectors.select("model").distinct()
    have = vectors.select(F.col("id").alias("_id"), "model", F.col("digest").alias("_made"))
    rows = have.join(documents, F.col("id") == F.col("_id"), "left")
    stale = F.col("id").isNull() | (F.col("_made") != F.col("digest"))
    per = rows.groupBy("model").agg(F.count("*").alias("n_vectors"), F.count_if(F.coalesce(stale, F.lit(False))).alias("n_stale"), F.countDistinct("id").alias("_known"))
    total = documents.agg(F.count("*").alias("_all"))
    return models.join(per, "model").join(F.broadcast(total), F.lit(True)).select("model", "n_vectors", "n_stale", (F.col("_all") - F.col("_known")).alias("n_missing"))


def neural_pairs(found: DataFrame, least: float, model: str) -> DataFrame:
    """Similarity edges (source, target, kind, metadata) of nearest vectors (query, neighbour, score) from ``least``; a pair once."""
    pair = found.filter(F.col("score") >= least).select(F.least("query", "neighbour").alias("source"), F.greatest("query", "neighbour").alias("target"), "score")
    best = pair.groupBy("source", "target").agg(F.max("score").alias("score"))
    meta = F.to_json(F.struct(F.lit("neural").alias("engine"), F.lit(model).alias("model"), "score"))
    return best.select("source", "target", F.lit("similar_to").alias("kind"), meta.alias("metadata"))


def grouped(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """At most ``most`` rows per key, in order, with the number there are (``n_all``): what a short report shows."""
    w = Window.partitionBy(key)
    return rows.withColumns({"n_all": F.count("*").over(w), "_n": F.row_number().over(w.orderBy(*order))}).filter(F.col("_n") <= most).drop("_n")
