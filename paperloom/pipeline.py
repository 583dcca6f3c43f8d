"""From a folder of documents to the tables of the document graph, and keeping them up to date.

Every refresh lists the folder, compares content hashes with the recorded ones, parses only new and changed files
on the executors, replaces the rows of touched files in every table, drops those of removed files from all of them,
resolves the links against the nodes that exist now and writes the tables as a new version.  A version counts once
its commit file is in place; what a broken refresh has written before that is written over by the next.

Defined results: a file that cannot be read keeps a row in ``files`` with its error and has no nodes; a refresh
that would remove more than half of a collection of ten or more files keeps the missing files (``force`` rebuilds
everything and removes them); a refresh that finds nothing new writes nothing; an empty folder gives empty tables; of repeated node ids in one file the first counts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import incremental, metadata, resolve, similarity
from paperloom.session import stored
from paperloom.sources import scan
from paperloom.sources.model import CHUNK, ENTITY, LINK, NODE, TUPLE
from paperloom.tables import GOVERNANCE, RESEARCH, Graph

FILE = "path string, content_hash string, size long, modified_at long, indexed_at long, node_count int, has_frontmatter boolean, errors string"
OWNED = f"file_path string, {', '.join(('source string', 'target string', 'kind string', 'line int'))}"
#: Tables that hold rows of a file each, replaced with it; the others follow from them.
BY_FILE = {
    "nodes": f"{NODE}, updated_at long", "section_chunks": CHUNK, "links": LINK, "owned_edges": OWNED,
    "metadata_tuples": f"file_path string, {TUPLE}, updated_at long", "entity_mentions": f"file_path string, {ENTITY}",
}


@dataclass
class Refreshed:
    version: int
    added: int
    changed: int
    removed: int
    refused: bool
    seconds: float


class Index:
    """The tables of one collection below ``folder``: ``v<number>/<table>.parquet`` and ``commits/<number>.json``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        at = self._path(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def graph(self) -> Graph:
        return Graph(self.spark, f"{self.folder}/v{self.version()}")

    def table(self, name: str) -> DataFrame:
        """A table of the current version; empty before the first."""
        schema = FILE if name == "files" else BY_FILE.get(name)
        if self.version() == 0:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read
        return (rows.schema(schema) if schema else rows).parquet(f"{self.folder}/v{self.version()}/{name}.parquet")

    def refresh(self, source: str, force: bool = False, ignore: bool = True, now: int | None = None) -> Refreshed:
        """Brings the tables in line with the documents below ``source``."""
        began, now = time.time(), int(time.time()) if now is None else now
        listed = scan.list_files(self.spark, source)
        if ignore:
            listed = scan.without_ignored(listed, scan.ignore_rules(self.spark, source))
        hashed = listed.withColumn("content_hash", F.sha2("content", 256))
        present = stored(hashed.select("path", "modified", "length", "content_hash"), "present-files")
        known = self.table("files")
        if force:
            known = known.limit(0)
        digest = lambda df: df.select("path", F.coalesce("content_hash", F.lit("")).alias("h"))
        changes = stored(incremental.diff(digest(known), digest(present), "path", "h"), "changes")
        guard = incremental.prune_guard(known, present, "path").first()
        if guard["refused"]:
            changes = changes.filter("change <> 'removed'")
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if not counts and self.version() and not force:  # nothing to do: the version stays
            return Refreshed(self.version(), 0, 0, 0, bool(guard["refused"]), time.time() - began)
        fresh = changes.filter("change <> 'removed'").select("path")
        parsed = stored(scan.parse_files(listed.join(fresh, "path", "left_semi")), "parsed-files")
        version = self.version() + 1
        touched = changes.select(F.col("path").alias("file_path"))
        for name in BY_FILE:
            self._write(version, name, self._kept(name, touched, force).unionByName(self._rows(name, parsed, now)))
        read = lambda name: self.spark.read.schema(BY_FILE[name]).parquet(f"{self.folder}/v{version}/{name}.parquet")
        self._write(version, "files", self._files(known, changes, present, parsed, now))
        self._derive(version, read)
        self._commit(version, {"source": source, "at": now})
        seconds = time.time() - began
        return Refreshed(version, counts.get("added", 0), counts.get("changed", 0), counts.get("removed", 0), bool(guard["refused"]), seconds)

    def _kept(self, name: str, touched: DataFrame, force: bool) -> DataFrame:
        rows = self.table(name)
        return rows.limit(0) if force else rows.join(touched, "file_path", "left_anti").select(*rows.columns)

    def _rows(self, name: str, parsed: DataFrame, now: int) -> DataFrame:
        """The rows that newly parsed files give to a table."""
        inner = {"section_chunks": "chunks", "owned_edges": "edges", "metadata_tuples": "tuples", "entity_mentions": "entities"}.get(name, name)
        rows = parsed.select(F.col("path").alias("_from"), F.posexplode(inner).alias("_i", "x")).select("_from", "_i", "x.*")
        if name == "nodes":
            rows = rows.groupBy("id").agg(F.min(F.struct("_from", "_i", *[c for c in rows.columns if c not in ("id", "_from", "_i")])).alias("n")).select("id", "n.*")
        if "file_path" not in rows.columns:
            rows = rows.withColumn("file_path", F.col("_from"))
        rows = rows.withColumn("updated_at", F.lit(now).cast("long"))
        return rows.select(*self.table(name).columns)

    def _files(self, known: DataFrame, changes: DataFrame, present: DataFrame, parsed: DataFrame, now: int) -> DataFrame:
        kept = known.join(changes.select("path"), "path", "left_anti").select(*known.columns)
        facts = parsed.select("path", "error", F.size("nodes").alias("node_count"), F.exists("tuples", lambda t: t["source"] == "frontmatter").alias("has_frontmatter"))
        new = present.join(facts, "path").select(
            "path", "content_hash", F.col("length").alias("size"), F.col("modified").alias("modified_at"), F.lit(now).cast("long").alias("indexed_at"),
            F.col("node_count").cast("int").alias("node_count"), "has_frontmatter", F.col("error").alias("errors"),
        )
        return kept.unionByName(new)

    def _derive(self, version: int, read: Callable[[str], DataFrame]) -> None:
        """Edges, unresolved references and the metadata projections, from the tables by file."""
        nodes, links = read("nodes"), read("links")
        refs = links.select(F.abs(F.xxhash64("from_node_id", "reference_text", "reference_kind", "line", "file_path")).alias("id"), "*").distinct()
        docs = nodes.filter("kind = 'document'").select("id", "file_path", "name")
        done = stored(resolve.resolve(refs, docs, nodes.filter("kind = 'heading'").select("id")), "resolved-links")
        url = F.when(F.col("kind") == "links_external", F.to_json(F.struct(F.col("reference_text").alias("url"))))
        found = done.filter("target is not null").join(refs.select(F.col("id").alias("ref_id"), "reference_text"), "ref_id")
        found = found.select("source", "target", "kind", "line", url.alias("metadata"))
        edges = found.unionByName(read("owned_edges").select("source", "target", "kind", "line", F.lit(None).cast("string").alias("metadata")))
        self._write(version, "edges", edges.distinct().select(F.abs(F.xxhash64("source", "target", "kind", "line", "metadata")).alias("id"), "*"))
        left = refs.join(done.filter("target is null").select(F.col("ref_id").alias("id")), "id", "left_semi")
        self._write(version, "unresolved_refs", left.select("id", "from_node_id", "reference_text", "reference_kind", "line", F.lit(0).alias("col"), "file_path"))
        tuples = metadata.upsert(read("metadata_tuples").select("node_id", "key", "value", "source", "updated_at"))
        at = tuples.groupBy("node_id").agg(F.max("updated_at").alias("updated_at"))
        for name, fields in (("governance_metadata", GOVERNANCE), ("research_metadata", RESEARCH)):
            blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
            self._write(version, name, metadata.project(tuples, fields).join(at, "node_id").select("node_id", *[blank(c) for c in fields], "updated_at"))
        self._write(version, "entities", metadata.typed_entities(read("entity_mentions")))

    def refresh_similarity(self, least: float = 0.25) -> DataFrame:
        """Brings the table of similar pairs in line with the current version, scoring only what has changed since the last time."""
        feats = stored(similarity.features(self.graph()), "features")
        keyed = feats.select("id", F.sha2(F.to_json(F.struct("text", "targets", "tags")), 256).alias("h"))
        last = self._last_similarity()
        if last is None:
            pairs = similarity.composite_pairs(feats, least)
        else:
            before, made, at = last
            gone = made.join(keyed, "id", "left_anti").select("id")
            changed = stored(keyed.join(made, ["id", "h"], "left_anti").select("id").union(gone), "changed-documents")
            pairs = similarity.refresh(before, changed, feats, least, at)
        name = f"similar/{self.version()}-{int(time.time() * 1000)}"
        pairs.write.parquet(f"{self.folder}/{name}/pairs")
        keyed.write.parquet(f"{self.folder}/{name}/made")
        self._put(f"{name}/done.json", {"least": least})
        return self.spark.read.parquet(f"{self.folder}/{name}/pairs")

    def _last_similarity(self):
        at = self._path(f"{self.folder}/similar")
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(at)), key=lambda n: int(n.split("-")[1])) if self._fs.exists(at) else []
        for n in reversed(names):
            done = self._path(f"{at.toString()}/{n}/done.json")
            if self._fs.exists(done):
                stream = self._fs.open(done)
                least = json.loads(bytes(stream.readAllBytes()))["least"]
                stream.close()
                return self.spark.read.parquet(f"{self.folder}/similar/{n}/pairs"), self.spark.read.parquet(f"{self.folder}/similar/{n}/made"), least
        return None

    def _write(self, version: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}.parquet")

    def _put(self, name: str, value: dict) -> None:
        draft, target = self._path(f"{self.folder}/{name}.draft"), self._path(f"{self.folder}/{name}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"cannot write {name}")

    def _commit(self, version: int, value: dict) -> None:
        self._put(f"commits/{version}.json", value)
        for old in range(max(1, version - 4), version - 1):  # the version before stays for those who still read it
            self._fs.delete(self._path(f"{self.folder}/v{old}"), True)


def index_all(spark: SparkSession, projects: dict[str, str], target: str, at_once: int = 4, force: bool = False) -> dict[str, Refreshed | Exception]:
    """Refreshes every project (name -> folder of documents) into ``target/<name>``; a project that fails does not stop the others."""

    def one(name: str):
        try:
            return Index(spark, f"{target}/{name}").refresh(projects[name], force)
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(projects, pool.map(one, projects)))


def workspace(spark: SparkSession, target: str, names: list[str], table: str, columns: dict[str, str]) -> DataFrame:
    """A table of all projects in one, with the project before the named path columns (column -> prefix sign)."""
    parts = []
    for name in names:
        rows = Index(spark, f"{target}/{name}").graph().table(table)
        parts.append(rows.withColumns({c: F.concat(F.lit(name + sign), c) for c, sign in columns.items()}).withColumn("project", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cross_project_links(spark: SparkSession, target: str, names: list[str]) -> DataFrame:
    """(ref_id, target_project, target): unresolved wikilinks of one project that name a document of another."""
    refs = workspace(spark, target, names, "unresolved_refs", {"file_path": "/"})
    docs = workspace(spark, target, names, "nodes", {"file_path": "/", "id": "/"}).filter("kind = 'document'")
    return resolve.cross_project(refs, docs.select("id", "file_path", "name"))
