"""Metadata quality: issues of every document, its score and the spread over the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.tables import REFERENCES, RESEARCH, Graph

#: Issue -> (severity, penalty).
ISSUES = {
    "missing_status": ("warning", 12), "missing_owner": ("warning", 10), "missing_review_due": ("warning", 8), "stale_review_due": ("error", 16),
    "non_canonical": ("error", 18), "missing_evidence": ("error", 14), "stale_research_validity": ("error", 16),
    "stale_last_verified": ("warning", 6), "weak_citations": ("warning", 12), "isolated_document": ("warning", 10),
}


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _before(c: str, day: Column) -> Column:
    """The first ten characters are a date before ``day``; anything else is not."""
    head = F.substring(F.trim(F.col(c)), 1, 10)
    return F.coalesce(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd") < day), F.lit(False))


def issues(g: Graph, as_of: str) -> DataFrame:
    """(node_id, file_path, code): one row per issue of a document, and one with a null code if it has none."""
    nodes = g.nodes("file_path")
    refs = g.edges.filter(F.col("kind").isin(REFERENCES))
    at = nodes.select(F.col("id").alias("end"), "file_path")
    into = refs.select(F.col("target").alias("end")).join(at, "end").groupBy("file_path").agg(F.count("*").alias("n_in"))
    outer = g.edges.filter(F.col("kind").isin([*REFERENCES, "links_external"]))
    out = outer.select(F.col("source").alias("end")).join(at, "end").groupBy("file_path").agg(F.count("*").alias("n_out"))
    docs = g.documents().withColumnRenamed("id", "node_id").join(g.governance, "node_id", "left").join(g.research, "node_id", "left")
    docs = docs.join(into, "file_path", "left").join(out, "file_path", "left").na.fill(0, ["n_in", "n_out"])
    day = F.lit(as_of).cast("date")
    plain = ~F.lower("file_path").rlike(r"\.(pdf|docx)$")
    signal = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    retired = (
        signal("canonical_source").isin("false", "no", "duplicate", "non_canonical", "non-canonical", "noncanonical")
        | signal("status").isin("archived", "deprecated", "retired", "superseded")
        | ~_blank("superseded_by")
    )
    researched = ~(F.concat_ws("", *RESEARCH) == "")
    items = F.size(F.filter(F.split(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"""[\[\]"',;\n]""", " "), r"\s+"), lambda x: x != ""))
    found = {
        "missing_status": plain & _blank("status"), "missing_owner": plain & _blank("owner"), "missing_review_due": plain & _blank("review_due"),
        "stale_review_due": plain & _before("review_due", day), "non_canonical": retired,
        "missing_evidence": researched & _blank("evidence"), "stale_research_validity": researched & _before("valid_until", day),
        "stale_last_verified": researched & _before("last_verified", F.add_months(day, -12)),
        "weak_citations": researched & (F.col("n_out") == 0) & (items < 2), "isolated_document": (F.col("n_in") == 0) & (F.col("n_out") == 0),
    }
    codes = F.array_compact(F.array(*[F.when(condition, code) for code, condition in found.items()]))
    return docs.select("node_id", "file_path", F.explode_outer(codes).alias("code"))


def _of(column: Column, part: int) -> Column:
    out = None
    for code, facts in ISSUES.items():
        out = F.when(column == code, facts[part]) if out is None else out.when(column == code, facts[part])
    return out


def scores(g: Graph, as_of: str) -> DataFrame:
    """(node_id, score, level, issues): issues by severity, then penalty, both falling."""
    rows = issues(g, as_of).withColumn("penalty", F.coalesce(_of(F.col("code"), 1), F.lit(0)))
    rank = F.when(_of(F.col("code"), 0) == "error", 0).otherwise(1)
    listed = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct(rank.alias("r"), (-F.col("penalty")).alias("p"), "code"))))
    per = rows.groupBy("node_id", "file_path").agg(F.greatest(100 - F.sum("penalty"), F.lit(0)).cast("int").alias("score"), listed.alias("l"))
    level = F.when(F.col("score") >= 85, "good").when(F.col("score") >= 65, "warning").otherwise("poor")
    return per.select("node_id", "file_path", "score", level.alias("level"), F.array_join(F.transform("l", lambda x: x["code"]), ",").alias("issues"))


def stats(scored: DataFrame) -> DataFrame:
    return scored.groupBy("level").agg(F.count("*").alias("n_documents"), F.avg("score").alias("avg_score"))


def histogram(found: DataFrame) -> DataFrame:
    return found.filter("code is not null").groupBy("code").agg(F.count("*").alias("n_documents"))
