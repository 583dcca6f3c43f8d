"""Listings, counts and hygiene checks of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import epoch_seconds, newest
from paperloom.tables import CITATIONS, Graph

#: Words that mark a folder or file as sensitive.
SENSITIVE = ["private", "personal", "confidential", "secret", "sensitive", "draft", "restricted", "classified"]


def current_files(g: Graph) -> DataFrame:
    """The newest record of each path."""
    rows = g.table("files").filter("path is not null").withColumn("indexed_at", epoch_seconds("indexed_at"))
    return newest(rows, ["path"], [F.col("indexed_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last(), F.col("size").desc_nulls_last()])


def files_by_prefix(g: Graph, prefix: str) -> DataFrame:
    return current_files(g).filter(F.col("path").startswith(prefix)).select("path", "size", "indexed_at").orderBy("path")


def top_folders(g: Graph) -> DataFrame:
    rows = g.table("files").select("path").distinct()
    return rows.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("n_files"))


def tag_counts(g: Graph) -> DataFrame:
    """Documents per tag, from the tagging edges."""
    tags = g.nodes("kind", "name").filter("kind = 'tag'").select(F.col("id").alias("target"), F.lower("name").alias("tag"))
    return g.edges.filter("kind = 'tagged'").join(tags, "target").groupBy("tag").agg(F.countDistinct("source").alias("n_documents"))


def tag_nodes(g: Graph) -> DataFrame:
    return g.nodes("kind", "name").filter("kind = 'tag'").groupBy("name").agg(F.count("*").alias("n_nodes"))


def documents_by_tag(g: Graph, tag: str) -> DataFrame:
    tags = g.nodes("kind", "name").filter((F.col("kind") == "tag") & (F.lower("name") == tag.lower())).select(F.col("id").alias("target"))
    docs = g.documents("name")
    tagged = g.edges.filter("kind = 'tagged'").join(tags, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return docs.join(tagged, "id").select("id", "name", "file_path").orderBy("file_path")


def index_stats(g: Graph) -> DataFrame:
    """Histogram of node kinds and edge kinds."""
    nodes = g.nodes("kind").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "kind", "n")
    edges = g.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "kind", "n")
    return nodes.unionByName(edges)


def metadata_stats(g: Graph) -> DataFrame:
    docs = g.documents().select(F.col("id").alias("node_id"))
    count = lambda df, what: df.join(docs, "node_id", "left_semi").agg(F.countDistinct("node_id").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(g.governance, "governance").unionByName(count(g.research, "research")).unionByName(count(docs, "documents"))


def status_by_project(g: Graph) -> DataFrame:
    """Per project and over all: nodes, documents, files and unresolved references."""
    project = lambda c: F.substring_index(c, "/", 1).alias("project")
    nodes = g.nodes("kind", "file_path").select(project("file_path"), F.lit("nodes").alias("what"), (F.col("kind") == "document").alias("is_doc"))
    parts = nodes.select("project", F.lit(1).alias("n_nodes"), F.col("is_doc").cast("int").alias("n_documents"), F.lit(0).alias("n_files"), F.lit(0).alias("n_unresolved"))
    files = g.table("files").select("path").distinct().select(project("path"), F.lit(0), F.lit(0), F.lit(1), F.lit(0))
    refs = g.table("unresolved_refs").select(project("file_path"), F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    rows = parts.union(files).union(refs)
    sums = [F.sum(c).alias(c) for c in ("n_nodes", "n_documents", "n_files", "n_unresolved")]
    return rows.rollup("project").agg(*sums, F.grouping("project").alias("is_total")).withColumn("project", F.when(F.col("is_total") == 1, "*").otherwise(F.col("project"))).drop("is_total")


def pending_excerpts(g: Graph) -> DataFrame:
    """Sections whose recorded content hash is not the newest one of their file, or whose file has none: work to do again."""
    usable = F.when(F.trim("content_hash") != "", F.lower(F.regexp_replace("content_hash", r"(?i)^sha256:", "")))
    rows = g.table("files").select("path", usable.alias("h"), epoch_seconds("indexed_at").alias("at")).dropna()
    now = rows.groupBy(F.col("path").alias("file_path")).agg(F.max(F.struct("at", "h"))["h"].alias("current"))
    chunks = g.table("section_chunks").select("node_id", "file_path", F.lower(F.regexp_replace("content_hash", r"(?i)^sha256:", "")).alias("h")).distinct()
    late = chunks.join(now, "file_path", "left").filter("current is null or h is null or h <> current")
    return late.select("node_id", "file_path", F.col("current").isNull().alias("never_indexed"))


def token_rollup(g: Graph) -> DataFrame:
    """Estimated tokens per first and second folder: one per East Asian character, a quarter of the rest."""
    text = F.coalesce(F.col("body_excerpt"), F.lit(""))
    east = F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    docs = g.documents("body_excerpt").select(
        F.split("file_path", "/").alias("p"), (east + F.floor((F.length(text) - east) / 4)).cast("long").alias("tokens")
    )
    top = F.when(F.size("p") > 1, F.get("p", F.lit(0))).otherwise("")
    sub = F.when(F.size("p") > 2, F.concat_ws("/", F.get("p", F.lit(0)), F.get("p", F.lit(1)))).otherwise("")
    return docs.groupBy(top.alias("top"), sub.alias("sub")).agg(F.count("*").alias("n_files"), F.sum("tokens").alias("n_tokens"))


def cost_estimate(g: Graph, rates: list[tuple[str, float]]) -> DataFrame:
    """Cost of the estimated tokens for each (model, price per million); the rates are a short parameter list."""
    total = token_rollup(g).agg(F.sum("n_tokens").alias("n_tokens"))
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(r)).alias("rate")) for m, r in rates])
    return total.select("n_tokens", F.inline(listed)).select("model", "n_tokens", (F.col("n_tokens") / 1e6 * F.col("rate")).alias("cost"))


def sensitive_folders(g: Graph, words: list[str] = SENSITIVE) -> DataFrame:
    marked = F.lower("path").rlike("|".join(words))
    rows = g.table("files").select("path").distinct().filter(marked)
    return rows.groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("n_files"))


def no_frontmatter(g: Graph) -> DataFrame:
    return current_files(g).filter(~F.coalesce("has_frontmatter", F.lit(False))).select("path")


def no_outgoing(g: Graph) -> DataFrame:
    """Paths none of whose nodes refers to anything."""
    sources = g.edges.filter(F.col("kind").isin(CITATIONS)).select(F.col("source").alias("id")).distinct()
    linking = g.nodes("file_path").join(sources, "id", "left_semi").select(F.col("file_path").alias("path")).distinct()
    return g.table("files").select("path").distinct().join(linking, "path", "left_anti")


def broken_links(g: Graph, limit: int = 20) -> DataFrame:
    counts = g.table("unresolved_refs").groupBy("reference_text", "reference_kind").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("reference_text").asc_nulls_first(), "reference_kind").limit(limit)


def no_headings(g: Graph) -> DataFrame:
    nodes = g.nodes("kind", "file_path")
    return nodes.filter("kind = 'document'").join(nodes.filter("kind = 'heading'").select("file_path"), "file_path", "left_anti").select("id", "file_path")


def islands(g: Graph) -> DataFrame:
    """Documents that no similarity edge touches."""
    near = g.edges.filter("kind = 'similar_to'")
    ends = near.select(F.col("source").alias("id")).union(near.select("target")).distinct()
    return g.documents().join(ends, "id", "left_anti").select("id", "file_path")


def owner_inference(commits: DataFrame, least: int = 3, share: float = 0.85) -> DataFrame:
    """(path, author, n, share): who made most commits to a path, if it is a clear majority of enough."""
    per = commits.groupBy("path", "author").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("path"))
    return per.withColumn("total", total).filter((F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select("path", "author", "n", "total")


def commit_history(commits: DataFrame) -> DataFrame:
    """Per path: commits, first and last time, authors, last author and subject (later author wins a tie)."""
    last = F.max(F.struct("ts", "author", "subject"))
    return commits.groupBy("path").agg(
        F.count("*").alias("commit_count"), F.min("ts").alias("first_commit_at"), F.max("ts").alias("last_commit_at"),
        F.countDistinct("author").alias("author_count"), last["author"].alias("last_author"), last["subject"].alias("last_subject"),
    )


def pending_embeddings(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents (id, digest) without a vector, or whose vector was made from another digest (null: unknown, counts as current)."""
    have = embeddings.select("id", F.col("digest").alias("_made"), F.lit(True).alias("_has"))
    rows = documents.join(have, "id", "left")
    stale = F.col("_made").isNotNull() & (F.col("_made") != F.col("digest"))
    return rows.filter(F.col("_has").isNull() | stale).select("id", F.col("_has").isNotNull().alias("stale"))


def embedding_stats(embeddings: DataFrame, model: str, vector: str) -> DataFrame:
    """Vectors, dimensions and mean length per model."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return embeddings.groupBy(F.col(model).alias("model")).agg(
        F.count("*").alias("n_vectors"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.round(F.avg(norm), 6).alias("mean_norm")
    )


def enrichment_stats(g: Graph) -> DataFrame:
    """Documents of files without front matter: how many there are, have metadata, and have metadata older than their file."""
    plain = current_files(g).filter(~F.coalesce("has_frontmatter", F.lit(False))).select(F.col("path").alias("file_path"), "indexed_at")
    docs = g.documents().join(plain, "file_path").select(F.col("id").alias("node_id"), "indexed_at")
    dated = g.table("governance_metadata").groupBy("node_id").agg(F.max("updated_at").alias("enriched_at"))
    rows = docs.join(dated, "node_id", "left")
    return rows.agg(
        F.count("*").alias("n_eligible"), F.count("enriched_at").alias("n_enriched"), F.count_if(F.col("enriched_at") < F.col("indexed_at")).alias("n_stale")
    )
