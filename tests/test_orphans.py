from pyspark.sql import functions as F

from paperloom.operators import orphans

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, level int, metadata string, body_excerpt string, updated_at long"
EDGES = "id long, source string, target string, kind string, metadata string, line int"
REFS = "id long, from_node_id string, reference_text string, reference_kind string, line int, col int, file_path string"
FILES = "path string, content_hash string, size long, modified_at long, indexed_at long, node_count int, has_frontmatter boolean, errors string"


def tables(spark, edges=(), refs=()):
    doc = lambda p, m=None: (p, "document", "The " + p[2], p, p, 1, 9, 0, m, None, 1)
    nodes = [doc("x/a.md"), doc("x/b c.docx"), doc("x/d.md", '{"deleted": true}'), ("x/a.md#h", "heading", "h", "h", "x/a.md", 2, 3, 1, None, None, 1)]
    files = [("x/a.md", "h", 1, 0, 1_735_689_600, 1, True, None), ("x/a.md", None, 1, 0, 1_738_368_000_000, 1, True, "failed")]
    return (spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(refs), REFS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(files, FILES))


def test_targets(spark):
    spelled = ["x/a.md", "X/A.MD", "./x/a.md", "x\\a.md#H", "x/b%20c.docx", "x/d.md", "nowhere", "", " ", None, "x/%zz"]
    edges = [(i, "x/a.md#h" if i % 2 else "lost", t, "references", None, 1) for i, t in enumerate(spelled)] + [(90, "x/a.md", "x/d.md", "references", None, 1)]
    got = {(r.field, r.ref_id, r.period) for r in orphans.find_orphans(*tables(spark, edges)).collect()}
    assert got == {("target", 5, "2025-02"), ("target", 6, "unknown"), ("target", 10, "unknown"), ("target", 90, "2025-02")}


def test_texts(spark):
    wiki = ["a", "A.md", " a | see", "x/a", "x/a.md#h", "b c", "The a", "d", "zzz", "", None, "mailto:x@y", "http://x/a"]
    path = ["a.md", "../x/A.md#h", "b%20c.docx", "../x/../x/a.md", "d.md", "../../x/a.md", "#h", "https://x/y", "", "/x/a.md"]
    refs = [(i, "x/a.md", t, "wikilink", 1, 1, "x/a.md") for i, t in enumerate(wiki)] + [(50 + i, None, t, "markdown_link", 1, 1, "x/a.md") for i, t in enumerate(path)]
    refs += [(80, "x/lost.md", "a", "embed", 1, 1, "y/z.md"), (81, "x/a.md", "q", "html_link", None, None, None)]
    rows = orphans.find_orphans(*tables(spark, refs=refs))
    got = {(r.field, r.ref_id) for r in rows.collect()}
    assert got == {("reference_text", i) for i in (7, 8, 54, 55, 59, 81)} | {("from_node_id", 80)}
    report = orphans.orphan_report(rows)
    assert report.agg(F.sum("n_orphans")).first()[0] == len(got)


def test_hot_missing_key_and_empty_tables(spark):
    edges = [(i, "x/a.md", "hot", "references", None, 1) for i in range(3000)]
    rows = orphans.find_orphans(*tables(spark, edges))
    assert rows.count() == 3000
    assert orphans.find_orphans(*[t.limit(0) for t in tables(spark, edges)]).count() == 0
