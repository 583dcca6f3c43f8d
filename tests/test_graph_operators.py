"""Small fixtures: positive, negative and boundary cases of the graph operators."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import audit, context, incremental, listing, metadata, quality, search, traverse
from paperloom.tables import GOVERNANCE, RESEARCH, Graph

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, level int, metadata string, body_excerpt string, updated_at long"
EDGES = "id long, source string, target string, kind string, metadata string, line int"
FILES = "path string, content_hash string, size long, modified_at long, indexed_at long, node_count int, has_frontmatter boolean, errors string"
REFS = "id long, from_node_id string, reference_text string, reference_kind string, line int, col int, file_path string"
CHUNKS = "node_id string, file_path string, start_line int, end_line int, content_hash string, section_hash string, heading_path string, text string"


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    docs = ["p/a.md", "p/b.md", "p/c.md", "p/d.md", "q/e.md", "q/lone.pdf"]
    nodes = [(d, "document", f"Doc {d[2]}", d, d, 1, 20, 0, '{"tags": ["One"]}', "retention policy" if d == "p/a.md" else None, 5) for d in docs]
    nodes += [("p/a.md#h", "heading", "Retention", "p/a.md#Retention", "p/a.md", 3, 9, 1, None, "how long", 5), ("tag:one", "tag", "One", "One", "p/a.md", 0, 0, 0, None, None, 5)]
    nodes += [("p/gone.md", "document", "Gone", "p/gone.md", "p/gone.md", 1, 2, 0, '{"deleted": true}', None, 9), ("p/gone.md", "document", "Gone", "p/gone.md", "p/gone.md", 1, 2, 0, None, None, 1)]
    edges = [("p/b.md", "p/a.md#h", "references", None, 2), ("p/c.md", "p/b.md", "wikilinks_to", None, 1), ("p/d.md", "p/b.md", "embeds", None, 1), ("p/a.md#h", "p/a.md", "references", None, 4),
             ("q/e.md", "p/c.md", "references", None, 1), ("p/a.md", "p/b.md", "similar_to", '{"score": 0.75}', 0), ("p/a.md", "p/d.md", "similar_to", '{"score": 0.74}', 0),
             ("p/a.md", "tag:one", "tagged", None, 0), ("p/b.md", "p/b.md", "links_external", '{"url": "https://x"}', 1), ("p/a.md#h", None, "references", None, 4)]
    gov = {
        "p/a.md": dict(status="approved", owner="o", review_due="2025-07-14", superseded_by="[[c]]", canonical_source="x", supersedes="old"),
        "p/b.md": dict(status="approved", owner="o", review_due="2025-07-15", canonical_source="x", supersedes="old"), "p/c.md": dict(status="archived", review_due="2020-01-01", canonical_source="x"),
        "p/d.md": dict(status=None, review_due="not-a-date"), "q/e.md": dict(status="draft", owner=" ", review_due=""),
    }
    res = {"p/b.md": dict(claim_id="k", confidence="high", valid_until="2025-07-14", last_verified="2025-01-15"), "p/c.md": dict(claim_id="k", confidence="low", deliverable_id="D", last_verified="2025-01-16", evidence="[[a]], b")}
    wide = lambda rows, fields: [(n, *[v.get(f) for f in fields], 7) for n, v in rows.items()]
    schema = lambda fields: "node_id string, " + ", ".join(f"{f} string" for f in fields) + ", updated_at long"
    files = [(d, "h", 1, 0, 1_700_000_000 if d == "p/a.md" else 1_752_000_000, 1, d != "p/b.md", None) for d in docs]
    tables = {
        "nodes": (nodes, NODES), "edges": ([(i, *e) for i, e in enumerate(edges)], EDGES), "files": (files, FILES), "governance_metadata": (wide(gov, GOVERNANCE), schema(GOVERNANCE)),
        "research_metadata": (wide(res, RESEARCH), schema(RESEARCH)), "unresolved_refs": ([(1, "p/a.md", "src/Main.PY", "markdown_link", 1, 1, "p/a.md"), (2, "p/a.md", "x.pyc", "wikilink", 1, 1, "p/a.md")], REFS),
        "section_chunks": ([("p/a.md#h", "p/a.md", 3, 9, "h", "s", "Retention", "the retention policy [[Plan B|b]] and [[plan b]]")], CHUNKS),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    return Graph(spark, str(folder))


def pairs(df):
    return sorted((r.node_id, r.related_node_id) for r in df.collect())


def test_audits(g):
    day = "2025-07-15"
    assert pairs(audit.stale_review(g, day)) == [("p/a.md", "")]
    assert pairs(audit.superseded_referenced(g)) == [("p/a.md", "p/a.md#h"), ("p/a.md", "p/b.md")]
    assert pairs(audit.duplicate(g)) == [("p/a.md", "p/b.md")]
    assert pairs(audit.non_canonical(g)) == [("p/a.md", ""), ("p/b.md", "")]
    assert pairs(audit.conflicting(g)) == [("p/a.md", ""), ("p/a.md", "p/b.md"), ("p/b.md", "")]
    assert pairs(audit.stale_assessment(g, day)) == [("p/b.md", "")]
    assert pairs(audit.unverified_evidence(g, day)) == [("p/b.md", "")]
    assert pairs(audit.competing_interpretations(g)) == [("p/b.md", "")]
    assert pairs(audit.impacted_deliverable(g, day)) == [("p/c.md", "p/b.md")]
    assert pairs(audit.superseded_claim(g)) == []
    assert [r.evidence for r in audit.missing_symbol(g).collect()] == ["reference=src/Main.PY, kind=markdown_link"]
    assert pairs(audit.unanchored_feature(g)) == [("p/a.md", ""), ("p/b.md", "")]
    assert pairs(audit.stale_by_git(g, day)) == [("p/a.md", "")]
    assert audit.top_findings(g, day, 3).count() == 3


def test_quality(g):
    got = {r.node_id: (r.score, r.issues) for r in quality.scores(g, "2025-07-15").collect()}
    assert got["p/a.md"] == (66, "non_canonical,stale_review_due")
    assert got["q/lone.pdf"] == (90, "isolated_document")
    assert got["p/d.md"] == (78, "missing_status,missing_owner")
    assert got["p/b.md"] == (70, "stale_research_validity,missing_evidence")
    assert sum(r.n_documents for r in quality.stats(quality.scores(g, "2025-07-15")).collect()) == 6


def test_traversal(g):
    assert {(r.document, r.level, r.kind, r.via) for r in traverse.impact(g, "p/a.md", 3).collect()} == {
        ("p/b.md", 1, "references", ""), ("p/c.md", 2, "wikilinks_to", "p/b.md"), ("p/d.md", 2, "embeds", "p/b.md"), ("q/e.md", 3, "references", "p/c.md")
    }
    assert traverse.impact(g, "p/nowhere.md", 2).count() == 0
    assert [r.path for r in traverse.trace(g, "q/e.md", "p/a.md").collect()] == [["q/e.md", "p/c.md", "p/b.md", "p/a.md"]]
    row = traverse.edge_summary(g).filter("file_path = 'p/b.md'").first()
    assert (row.n_in, row.n_in_documents, row.n_out, row.n_out_documents, row.n_same, row.n_external) == (2, 2, 2, 1, 0, 1)
    assert traverse.incoming(g, "p/a.md").count() == 2 and traverse.outgoing(g, "p/b.md").count() == 2


def test_search_and_context(g):
    r = search.Request(' "Retention" policy! policy ')
    assert r.terms == ["retention", "policy"] and r.intent == "exact" and search.Request("a > b").intent == "section" and search.Request("ab").short
    hits = search.search(g, search.Request("retention policy"))
    rows = hits.collect()
    assert {x.id for x in rows} == {"p/a.md", "p/a.md#h"} and rows[0].place == 1 and rows[0].score > rows[1].score
    assert [(x.file_path, x.sections) for x in context.entries(hits).collect()] == [("p/a.md", "Retention")]
    assert search.search(g, search.Request("zzz qqq")).count() == 0
    assert [x.id for x in search.search(g, search.Request("lone")).collect()][0] == "q/lone.pdf"
    text = g.spark.createDataFrame([(1, "é" * 10), (2, None)], "place int, t string")
    assert [x.c for x in text.select(context.cut_bytes("t", 5).alias("c")).collect()] == ["éé", ""]
    assert [x.form for x in context.budget(text, "t", 10, 5).orderBy("place").collect()] == ["full", "omitted"]


def test_filters_drop_hits(g):
    ids = lambda **f: {x.id for x in search.search(g, search.Request("doc", filters=f), []).collect()}
    everything = ids()
    assert {"p/a.md", "p/b.md", "p/c.md", "p/d.md", "q/e.md", "q/lone.pdf"} <= everything
    assert ids(status=" Approved ") == {"p/a.md", "p/b.md"} and ids(status="approved", claim_id="K") == {"p/b.md"} and ids(status="none") == set()
    assert ids(as_of="2025-07-15") == everything - {"p/b.md"} and ids(as_of="2025-07-14") == everything and ids(status="") == everything
    assert ids(allowed_audience="staff") == set()
    with pytest.raises(ValueError):
        search.Request("doc", filters={"colour": "red"})
    assert search.Request("doc", limit=10_000).limit == search.MOST_HITS
    said = g.spark.createDataFrame([("e1", "concept", "q/lone.pdf"), ("e2", "person", "p/d.md")], "entity_id string, entity_type string, node_id string")
    found = search.search(g, search.Request("zzzz", entity_type="person"), [], said).collect()
    assert [x.id for x in found] == ["p/d.md"] and search.search(g, search.Request("zzzz", entity_id="e1"), [], said).first().id == "q/lone.pdf"


def test_audience(g):
    rows = [("a", "internal", '["Staff","legal"]'), ("b", "Public", None), ("c", None, "all"), ("d", None, None), ("e", "secret", "board; staff")]
    gov = g.spark.createDataFrame([(i, s, a, *[None] * 9) for i, s, a in rows], "node_id string, sensitivity string, allowed_audience string, " + ", ".join(f"{c} string" for c in GOVERNANCE if c not in ("sensitivity", "allowed_audience")))

    class One:
        governance, research = gov, g.research

    hit = lambda who: {r.id for r in search.matching(One, gov.select(F.col("node_id").alias("id")), search.Request("x", filters={"allowed_audience": who})).collect()}
    assert hit("STAFF") == {"a", "b", "c", "e"} and hit("legal") == {"a", "b", "c"} and hit("nobody") == {"b", "c"}


def test_listings_and_metadata(g):
    assert {(r.tag, r.n_documents) for r in listing.tag_counts(g).collect()} == {("one", 1)}
    assert {r.path for r in listing.no_frontmatter(g).collect()} == {"p/b.md"} and listing.documents_by_tag(g, "ONE").count() == 1
    assert {r.id for r in listing.islands(g).collect()} == {"p/c.md", "q/e.md", "q/lone.pdf"}
    rows = [("n", "owner", "x", "skill_advisory", 9), ("n", "owner", "y", "frontmatter", 1), ("n", "owner", "z", "html_meta", 2), ("n", "other", "w", "derived", 1)]
    tuples = g.spark.createDataFrame(rows, "node_id string, key string, value string, source string, updated_at long")
    assert metadata.project(tuples, ["owner", "status"]).first().asDict() == {"node_id": "n", "owner": "z", "status": ""}
    ents = metadata.entities(metadata.mentions(search.sections(g))).collect()
    assert [(e.name, e.aliases, e.n_nodes) for e in ents] == [("Plan B", "Plan B | plan b", 1)]
    assert metadata.orphan_entities(g.spark.createDataFrame([("1", "x")], "entity_id string, name string"), metadata.entities(metadata.mentions(search.sections(g)))).count() == 1


def test_incremental(g):
    a = g.spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "path string, h string")
    b = g.spark.createDataFrame([("x", "2"), ("z", None), ("w", "1")], "path string, h string")
    assert {(r.path, r.change) for r in incremental.diff(a, b, "path", "h").collect()} == {("x", "changed"), ("y", "removed"), ("w", "added")}
    many = g.spark.range(10).select(F.col("id").cast("string").alias("path"))
    assert incremental.prune_guard(many, many.limit(4), "path").first().refused and not incremental.prune_guard(many, many.limit(5), "path").first().refused
    assert not incremental.prune_guard(many.limit(5), many.limit(0), "path").first().refused
    nodes, edges = incremental.cascade(g.nodes("file_path"), g.edges, g.spark.createDataFrame([("p/b.md",)], "path string"))
    assert nodes.filter("file_path = 'p/b.md'").count() == 0 and edges.filter("source = 'p/b.md' or target = 'p/b.md'").count() == 0 and edges.count() == 5
