"""Drift findings over the document graph: stale, superseded, duplicate and conflicting records.

Every finder returns (code, node_id, file_path, related_node_id, related_path, severity, evidence),
'' where a finding has no related node.  Dates are compared as the text the author wrote, so a value
that is no date never counts as past.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.tables import CITATIONS, Graph

SIMILARITY, UNVERIFIED_DAYS, GIT_DAYS = 0.75, 180, 365
CODE_FILE = r"(?i)\.(go|py|js|ts|rs|c|cpp|java|rb|kt|cs|swift|tsx|jsx)$"


def _finding(df: DataFrame, code: str, severity: str, evidence: Column, related: bool = False) -> DataFrame:
    other = ["related_node_id", "related_path"] if related else [F.lit("").alias("related_node_id"), F.lit("").alias("related_path")]
    return df.select(F.lit(code).alias("code"), "node_id", "file_path", *other, F.lit(severity).alias("severity"), evidence.alias("evidence"))


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _governed(g: Graph) -> DataFrame:
    return g.governance.join(g.nodes("file_path").withColumnRenamed("id", "node_id"), "node_id")


def _researched(g: Graph) -> DataFrame:
    return g.research.join(g.nodes("file_path").withColumnRenamed("id", "node_id"), "node_id")


def days_before(as_of: str, days: int) -> Column:
    return F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")


def stale_review(g: Graph, as_of: str) -> DataFrame:
    due = _governed(g).filter((F.col("review_due") != "") & (F.col("review_due") < as_of))
    late = due.filter(~F.col("status").isin("archived", "superseded", "non-binding"))
    return _finding(late, "policy.stale_review", "warning", _text("owner=", F.col("owner"), ", review_due=", F.col("review_due")))


def _cited_superseded(g: Graph, superseded: DataFrame, code: str) -> DataFrame:
    """Superseded documents with a reference, to any node of their file, from a source that is still active."""
    nodes = g.nodes("file_path")
    into = g.edges.filter(F.col("kind").isin(CITATIONS)).select("source", "target").distinct()
    into = into.join(nodes.select(F.col("id").alias("target"), "file_path"), "target").select("source", "file_path").distinct()
    hits = superseded.join(into, "file_path").select("node_id", "file_path", "superseded_by", F.col("source").alias("related_node_id"))
    retired = g.governance.filter(F.col("status").isin("archived", "superseded")).select(F.col("node_id").alias("related_node_id"))
    active = hits.join(retired, "related_node_id", "left_anti")
    paths = nodes.select(F.col("id").alias("related_node_id"), F.col("file_path").alias("related_path"))
    named = active.join(paths, "related_node_id", "left").withColumn("related_path", F.coalesce("related_path", "related_node_id"))
    return _finding(named, code, "warning", _text("superseded_by=", F.col("superseded_by")), True)


def superseded_referenced(g: Graph) -> DataFrame:
    return _cited_superseded(g, _governed(g).filter("superseded_by <> ''"), "policy.superseded_referenced")


def superseded_claim(g: Graph) -> DataFrame:
    rows = _governed(g).filter("superseded_by <> ''").join(g.research.select("node_id"), "node_id", "left_semi")
    return _cited_superseded(g, rows, "research.superseded_claim")


def similar_approved(g: Graph, least: float = SIMILARITY) -> DataFrame:
    """Pairs of approved documents that an edge calls similar, with both canonical sources."""
    score = F.get_json_object("metadata", "$.score").try_cast("double")
    pairs = g.edges.filter("kind = 'similar_to' and source < target").select("source", "target", score.alias("score")).filter(F.col("score") >= least)
    approved = _governed(g).filter("status = 'approved'")
    side = lambda end, path: approved.select(F.col("node_id").alias(end), F.col("file_path").alias(path), F.col("canonical_source").alias(f"{end}_canonical"))
    found = pairs.distinct().join(side("source", "file_path"), "source").join(side("target", "related_path"), "target")
    return found.withColumnsRenamed({"source": "node_id", "target": "related_node_id"})


def duplicate(g: Graph) -> DataFrame:
    return _finding(similar_approved(g), "policy.duplicate", "warning", _text("similar_to score=", F.format_string("%.2f", "score")), True)


def non_canonical(g: Graph) -> DataFrame:
    active = F.col("status").isNull() | ~F.col("status").isin("archived", "superseded")
    claims = g.governance.filter("canonical_source <> ''").filter(active)
    several = claims.groupBy("canonical_source").agg(F.count("*").alias("n")).filter("n > 1")
    rows = _governed(g).filter("canonical_source <> ''").filter(active).join(several, "canonical_source")
    return _finding(rows, "policy.non_canonical", "warning", _text("canonical_source=", F.col("canonical_source")))


def conflicting(g: Graph) -> DataFrame:
    pairs = similar_approved(g)
    first = _finding(pairs, "policy.conflicting", "error", F.format_string("similarity=%.2f", "score"), True)
    differ = pairs.filter("source_canonical <> '' and target_canonical <> '' and source_canonical <> target_canonical")
    second = _finding(differ, "policy.conflicting", "error", _text("canonical_source: ", F.col("source_canonical"), " vs ", F.col("target_canonical")), True)
    active = (F.col("supersedes") != "") & ~F.col("status").isin("archived", "superseded")
    several = g.governance.filter(active).groupBy("supersedes").agg(F.count("*").alias("n")).filter("n > 1")
    rows = _governed(g).filter(active).join(several, "supersedes")
    third = _finding(rows, "policy.conflicting", "error", _text("supersedes=", F.col("supersedes"), ", status=", F.col("status")))
    return first.unionByName(second).unionByName(third)


def stale_assessment(g: Graph, as_of: str) -> DataFrame:
    rows = _researched(g).filter((F.col("valid_until") != "") & (F.col("valid_until") < as_of))
    return _finding(rows, "research.stale_assessment", "warning", _text("valid_until=", F.col("valid_until")))


def unverified_evidence(g: Graph, as_of: str, days: int = UNVERIFIED_DAYS) -> DataFrame:
    rows = _researched(g).filter((F.col("last_verified") != "") & (F.col("last_verified") < days_before(as_of, days)))
    return _finding(rows, "research.unverified_evidence", "info", _text("last_verified=", F.col("last_verified")))


def competing_interpretations(g: Graph) -> DataFrame:
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  values come from short vocabularies
    claims = _researched(g).filter("claim_id <> ''").groupBy("claim_id").agg(
        F.min("node_id").alias("node_id"), F.min("file_path").alias("file_path"), F.countDistinct("confidence").alias("n_c"),
        F.countDistinct("analyst_status").alias("n_s"), listed("confidence").alias("c"), listed("analyst_status").alias("s"),
    ).filter("n_c > 1 or n_s > 1")
    evidence = _text("claim_id=", F.col("claim_id"), ", confidences=", F.col("c"), ", statuses=", F.col("s"))
    return _finding(claims, "research.competing_interpretations", "warning", evidence)


def impacted_deliverable(g: Graph, as_of: str) -> DataFrame:
    rows = _researched(g)
    given = rows.filter("deliverable_id <> ''").select("node_id", "file_path", "deliverable_id")
    expired = rows.filter((F.col("valid_until") != "") & (F.col("valid_until") < as_of))
    expired = expired.select(F.col("node_id").alias("related_node_id"), F.col("file_path").alias("related_path"))
    links = g.edges.filter(F.col("kind").isin(CITATIONS)).filter("source <> target").select("source", "target").distinct()
    either = links.toDF("node_id", "related_node_id").union(links.select("target", "source")).distinct()
    hits = either.join(given, "node_id").join(expired, "related_node_id")
    return _finding(hits, "research.impacted_deliverable", "info", _text("deliverable_id=", F.col("deliverable_id"), ", stale_path=", F.col("related_path")), True).distinct()


def missing_symbol(g: Graph) -> DataFrame:
    rows = g.table("unresolved_refs").filter(F.col("reference_text").rlike(CODE_FILE)).withColumnRenamed("from_node_id", "node_id")
    return _finding(rows, "code.missing_symbol", "warning", _text("reference=", F.col("reference_text"), ", kind=", F.col("reference_kind")))


def undocumented_export(g: Graph, code_kind: str = "code_file") -> DataFrame:
    nodes = g.nodes("kind", "file_path")
    cited = g.edges.filter(F.col("kind").isin(CITATIONS)).select("source", F.col("target").alias("id"))
    cited = cited.join(nodes.filter(F.col("kind") != code_kind).select(F.col("id").alias("source")), "source", "left_semi").select("id")
    rows = nodes.filter(F.col("kind") == code_kind).join(cited, "id", "left_anti").withColumnRenamed("id", "node_id")
    return _finding(rows, "code.undocumented_export", "info", _text("file=", F.col("file_path")))


def unanchored_feature(g: Graph, code_kind: str = "code_file") -> DataFrame:
    nodes = g.nodes("kind", "file_path")
    anchored = g.edges.filter(F.col("kind").isin(CITATIONS)).select(F.col("source").alias("node_id"), F.col("target").alias("id"))
    anchored = anchored.join(nodes.filter(F.col("kind") == code_kind), "id", "left_semi").select("node_id")
    docs = nodes.filter("kind = 'document'").select(F.col("id").alias("node_id"), "file_path")
    rows = g.governance.filter(F.col("status").isin("approved", "review")).join(docs, "node_id").join(anchored, "node_id", "left_anti")
    return _finding(rows, "code.unanchored_feature", "info", _text("status=", F.col("status")))


def stale_by_git(g: Graph, as_of: str, days: int = GIT_DAYS) -> DataFrame:
    cutoff = F.unix_timestamp(F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp"))
    docs = g.documents().select(F.col("id").alias("node_id"), "file_path")
    rows = docs.join(g.history.withColumnRenamed("path", "node_id"), "node_id").filter((F.col("last_commit_at") != 0) & (F.col("last_commit_at") < cutoff))
    return _finding(rows, "doc.stale_by_git", "info", _text("last_commit_at=", F.col("last_commit_at").cast("string"), ", commits=", F.col("commit_count").cast("string")))


def all_findings(g: Graph, as_of: str) -> DataFrame:
    """Every finding, with the position of its finder as ``finder``."""
    g = g.settled()
    finders = [
        stale_review(g, as_of), superseded_referenced(g), duplicate(g), non_canonical(g), conflicting(g), stale_assessment(g, as_of),
        unverified_evidence(g, as_of), competing_interpretations(g), superseded_claim(g), impacted_deliverable(g, as_of), missing_symbol(g),
        undocumented_export(g), unanchored_feature(g), stale_by_git(g, as_of),
    ]
    return reduce(DataFrame.unionByName, [f.withColumn("finder", F.lit(i)) for i, f in enumerate(finders)])


def top_findings(g: Graph, as_of: str, limit: int) -> DataFrame:
    order = ["finder", "node_id", "related_node_id", "evidence"]
    return all_findings(g, as_of).orderBy(*order).limit(limit).drop("finder")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("node_id").alias("n_nodes"))
