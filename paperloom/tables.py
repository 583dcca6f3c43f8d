"""The document graph of one data folder: existing nodes, newest metadata, edges and files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.graph_tables import existing_nodes, newest_metadata
from paperloom.session import epoch_seconds, fingerprint, read, stored

#: Kinds of edges that refer from one text to another.
REFERENCES = ["references", "wikilinks_to", "related_to", "embeds"]
CITATIONS = ["references", "wikilinks_to", "related_to"]

GOVERNANCE = ["status", "owner", "approver", "department", "effective_date", "review_due", "supersedes", "superseded_by",
              "sensitivity", "allowed_audience", "canonical_source"]
RESEARCH = ["claim_id", "evidence", "source_type", "confidence", "event_date", "assessment_date", "last_verified", "valid_until",
            "analyst_status", "client", "deliverable_id"]
NODE = ["kind", "name", "qualified_name", "file_path", "start_line", "end_line", "level", "metadata", "body_excerpt"]


_settled: dict[tuple, Graph] = {}


class Graph:
    is_settled = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def settled(self) -> Graph:
        """The same graph with newest nodes, governance and research rows written once, for work that reads them many times.

        Requests on unchanged files share these tables; when a file changes, the next request writes them anew.
        """
        state = fingerprint(self.spark, self.folder, ["nodes", "governance_metadata", "research_metadata", "section_chunks"])
        if state not in _settled:
            _settled.clear()  # one state at a time
            _settled[state] = Settled(self)
        return _settled[state]

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    def nodes(self, *columns: str) -> DataFrame:
        """Existing nodes with the named columns only (all if none are named)."""
        return existing_nodes(self.table("nodes"), list(columns or NODE))

    def documents(self, *columns: str) -> DataFrame:
        return existing_nodes(self.table("nodes").filter("kind = 'document'"), ["file_path", *columns])

    @cached_property
    def governance(self) -> DataFrame:
        return newest_metadata(self.table("governance_metadata"), GOVERNANCE)

    @cached_property
    def research(self) -> DataFrame:
        return newest_metadata(self.table("research_metadata"), RESEARCH)

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @cached_property
    def history(self) -> DataFrame:
        """Recorded versions of each path, as a commit history: count, first and last second."""
        rows = self.table("files").filter("path is not null and indexed_at is not null").select("path", epoch_seconds("indexed_at").alias("at"))
        return rows.groupBy("path").agg(
            F.count("*").alias("commit_count"), F.min("at").alias("first_commit_at"), F.max("at").alias("last_commit_at")
        )


class Settled(Graph):
    """A graph whose newest rows are stored tables: one shuffle per table instead of one per use."""

    is_settled = True

    def __init__(self, base: Graph):
        super().__init__(base.spark, base.folder)
        self._nodes = stored(existing_nodes(base.table("nodes"), NODE), "newest-nodes")
        self._governance, self._research = stored(base.governance, "newest-governance"), stored(base.research, "newest-research")

    def settled(self) -> Graph:
        return self

    def nodes(self, *columns: str) -> DataFrame:
        return self._nodes.select("id", *[c for c in (columns or NODE) if c != "id"])

    def documents(self, *columns: str) -> DataFrame:
        return self._nodes.filter("kind = 'document'").select("id", "file_path", *[c for c in columns if c not in ("id", "file_path")])

    @property
    def governance(self) -> DataFrame:
        return self._governance

    @property
    def research(self) -> DataFrame:
        return self._research
