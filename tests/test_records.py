"""Records, lookups, details and evidence: small fixtures with nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import details, incremental, metadata, records, search
from tests.test_graph_operators import g  # noqa: F401  the small graph

LEDGER = "node_id string, run_id string, content_hash string, summary string, fields map<string,string>, model string, agent string, created_at long"


def test_vectors(spark):
    schema = "node_id string, model string, vector array<float>, digest string, updated_at long"
    rows = spark.createDataFrame([("a", "m", [1.0], "x", 1), ("b", "m", [1.0], "x", 1)], schema)
    new = spark.createDataFrame([("a", "m", [2.0], "y", 2), ("a", "m", [3.0], "z", 3), ("a", "n", [4.0], "y", 2), ("c", "m", [], "y", 2), (None, "m", [1.0], "y", 2), ("d", "m", [float("nan")], "y", 2)], schema)
    after = records.store_vectors(rows, new)
    assert {(r.node_id, r.model, r.vector[0]) for r in after.collect()} == {("a", "m", 3.0), ("b", "m", 1.0), ("a", "n", 4.0)}
    assert records.store_vectors(rows.limit(0), new.limit(0)).count() == 0 and records.remove(after, rows.limit(1), ["node_id"]).count() == 1
    edges = spark.createDataFrame([("a", "b", "similar_to", '{"engine": "neural", "model": "m"}'), ("a", "b", "similar_to", None), ("a", "b", "references", None), (None, None, None, None)], "source string, target string, kind string, metadata string")
    left, kept = records.clear_vectors(after, edges, "m")
    assert [r.model for r in left.collect()] == ["n"] and kept.count() == 3 and records.clear_vectors(after, edges)[0].count() == 0
    found = spark.createDataFrame([("b", "a", 0.9), ("a", "b", 0.8), ("a", "c", 0.4)], "query string, neighbour string, score double")
    assert [(r.source, r.target) for r in records.neural_pairs(found, 0.5, "m").collect()] == [("a", "b")]


def test_enrichment(spark):
    now = spark.createDataFrame([("a", "h1"), ("b", "h2")], "node_id string, content_hash string")
    draft = lambda node, run, h, s, at=1, f=None: (node, run, h, s, f, "m", "x", at)
    drafts = spark.createDataFrame([
        draft("a", "r1", "h1", "first"), draft("a", "r1", "h1", "first"), draft("a", "r2", "h1", "second", 5, {"status": "draft", "owner": " "}), draft("b", "r1", "h1", "late"),
        draft("z", "r1", "h1", "x"), draft("b", None, "h2", "x"), draft("b", "r3", "h2", " "), draft("b", "r4", "h2", "é" * 1001), draft(" ", "r", "h", "x"),
    ], LEDGER)
    ledger, refused = records.write_enrichment(drafts.limit(0), drafts, now)
    assert sorted((r.node_id, r.run_id) for r in ledger.collect()) == [("a", "r1"), ("a", "r2")]
    assert sorted(r.reason for r in refused.collect()) == sorted(["stale text", "unknown node", "no run", "nothing to write", "summary too long", "no node"])
    assert records.write_enrichment(ledger, drafts, now)[0].count() == 2 and [r.run_id for r in records.run_history(ledger, "a").collect()] == ["r2", "r1"]
    changed = spark.createDataFrame([("a", "h9")], "node_id string, content_hash string")
    assert [(r.run_id, r.stale) for r in records.summaries(ledger, changed).collect()] == [("r2", True)]
    assert [(r.key, r.value, r.source) for r in records.enrichment_tuples(ledger).collect()] == [("status", "draft", "agent_inferred")]


def test_packs_and_values(spark):
    schema = "name string, version int, kinds array<string>, enabled boolean, updated_at long"
    packs = spark.createDataFrame([("Code", 1, ["code_file"], False, 1), ("old", 1, ["x"], True, 1)], schema)
    shipped = spark.createDataFrame([(" code", 2, ["code_file"], 2), ("terms", 1, ["definition"], 2), ("", 1, ["y"], 2), ("bad", 1, [], 2)], "name string, version int, kinds array<string>, updated_at long")
    after = records.sync_packs(packs, shipped)
    assert {(r.name, r.version, r.enabled) for r in after.collect()} == {("code", 2, False), ("terms", 1, True)}
    nodes = spark.createDataFrame([("a", "code_file", "f"), ("b", "document", "f"), ("c", None, "f")], "id string, kind string, file_path string")
    assert {r.id for r in records.without_disabled(nodes, after).collect()} == {"b", "c"}
    assert records.without_disabled(nodes, records.toggle_pack(after, "CODE ", True)).count() == 3
    assert {(r.name, r.n_nodes) for r in records.pack_stats(nodes, after).collect()} == {("code", 1), ("terms", 0)}
    values = spark.createDataFrame([("p", "k", "v", 1)], "project string, key string, value string, updated_at long")
    assert records.project_values(values, values.withColumns({"value": F.lit("w"), "updated_at": F.lit(2).cast("long")})).first().value == "w"


def test_lookups(g):  # noqa: F811
    asked = g.spark.createDataFrame([("p/a.md",), ("DOC B",), ("p/a.md#Retention",), ("nothing",), (" doc c ",)], "asked string")
    assert {(r.asked, r.id) for r in details.resolve_names(g, asked).collect()} == {("p/a.md", "p/a.md"), ("DOC B", "p/b.md"), ("p/a.md#Retention", "p/a.md#h"), ("nothing", None), (" doc c ", "p/c.md")}
    wanted = g.spark.createDataFrame([("p/a.md", "Retention"), ("p/a.md", "#H"), ("p/a.md", "none")], "file_path string, section string")
    got = {(r.section, r.node_id, (r.content or "")[:3]) for r in details.section_by_name(g, wanted).collect()}
    assert got == {("Retention", "p/a.md#h", "the"), ("#H", "p/a.md#h", "the"), ("none", None, "")}
    assert details.nodes_of_files(g, g.spark.createDataFrame([("p/a.md",)], "file_path string")).count() == 3


def test_details_and_evidence(g):  # noqa: F811
    rows = {r.asked: r for r in details.node_details(g, g.spark.createDataFrame([("p/a.md#h",), ("p/b.md",), ("none",)], "asked string"), "2025-07-15").collect()}
    a = rows["p/a.md#h"]
    assert (a.document, a.n_headings, a.n_incoming, a.n_outgoing, a.governance.status) == ("p/a.md", 1, 2, 2, "approved") and [h.name for h in a.headings] == ["Retention"]
    assert rows["none"].document is None and rows["p/b.md"].research.claim_id == "k" and [e.target for e in rows["p/b.md"].outgoing] == ["https://x", "p/a.md#h"]
    hits = g.spark.createDataFrame([(1, "p/a.md#h"), (2, "p/b.md")], "place int, id string")
    pack = {r.id: r for r in details.evidence_pack(g, hits, "2025-07-15", content=5, depth=9, most=1).collect()}
    assert pack["p/a.md#h"].content == "the r" and pack["p/a.md#h"].truncated and (pack["p/a.md#h"].impact_1, pack["p/a.md#h"].impact_2, pack["p/a.md#h"].impact_3) == (1, 2, 1)
    assert len(pack["p/b.md"].incoming) == 1 and pack["p/b.md"].n_incoming == 2 and details.pack_options(9000, 0, 99) == (6000, 1, 20)
    assert details.evidence_pack(g, search.search(g, search.Request("zzz"), []), "2025-07-15").count() == 0


def test_typed_entities(spark):
    rows = [("n1", "Ada L.", "Person", "Ada"), ("n1", "Ada L.", "person", None), ("n2", "ada", "concept", None), ("n2", "Loom", "concept", None), ("n3", " loom", "concept", None)]
    said = spark.createDataFrame(rows, "node_id string, name string, entity_type string, alias string")
    got = {(r.entity_type, r.name, r.aliases, r.n_mentions, r.n_nodes) for r in metadata.typed_entities(said).collect()}
    assert got == {("person", "Ada", "Ada | Ada L. | ada", 3, 2), ("concept", " loom", " loom | Loom", 2, 2)}
    only = spark.createDataFrame([("PERSON",)], "entity_type string")
    assert [r.entity_type for r in metadata.typed_entities(said, only).collect()] == ["person"] and metadata.typed_entities(said, only.limit(0)).count() == 2


def test_cascade_over_all_tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "files": make([("a",), ("b",)], "path string"), "nodes": make([("a", "a"), ("a#1", "a"), ("b", "b")], "id string, file_path string"),
        "edges": make([("a#1", "b"), ("b", "a"), ("b", "b"), ("b", None)], "source string, target string"), "governance_metadata": make([("a", 1), ("b", 1)], "node_id string, x int"),
        "unresolved_refs": make([("a#1",), ("b",)], "from_node_id string"), "section_chunks": make([("a#1", "a"), ("b", "b")], "node_id string, file_path string"),
        "entity_mentions": make([("e1", "a"), ("e2", "b")], "entity_id string, node_id string"), "entities": make([("e1",), ("e2",)], "entity_id string"),
    }
    after = incremental.cascade_all(tables, make([("a",), ("a",), ("none",)], "path string"))
    assert {k: v.count() for k, v in after.items()} == {"files": 1, "nodes": 1, "edges": 2, "governance_metadata": 1, "unresolved_refs": 1, "section_chunks": 1, "entity_mentions": 1, "entities": 1}
    assert all(after[k].columns == tables[k].columns for k in tables)


@pytest.mark.parametrize("most", [1, 3])
def test_grouped(spark, most):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert {(r.k, r.v, r.n_all) for r in records.grouped(rows, "k", ["v"], most).collect()} == {("a", 1, 2), ("b", 5, 1)} | ({("a", 2, 2)} if most > 1 else set())
