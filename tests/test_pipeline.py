"""A folder to tables and back again: first build, changes, removals, ignore files, broken files, many projects."""

import pytest
from pyspark.sql import functions as F

from paperloom import pipeline
from paperloom.operators import search

A = """---
title: Plan
owner: desk
status: approved
entities:
  - name: Records desk
    type: Team
    aliases: [the desk]
---
# Plan

See [part](b.md#part) and [[c]] and [[nowhere]], and ask [[the desk]].
"""


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/")
        path = path.with_name(path.name + ".md") if "." not in path.name else path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def links(index):
    return {(r.source, r.target, r.kind) for r in index.table("edges").filter("kind in ('references', 'wikilinks_to')").collect()}


def test_build_change_remove(spark, tmp_path):
    docs, out = tmp_path / "docs", pipeline.Index(spark, str(tmp_path / "index"))
    write(docs, a=A, b="# B\n\n## Part\n\ntext [a](a.md)\n", sub__c="# C\n\nretention policy\n", sub__hidden="# H\n")
    (docs / ".gitignore").write_text("*.tmp\n")
    (docs / "sub" / ".paperloomignore").write_text("hidden.md\n")
    (docs / "bad.docx").write_bytes(b"no archive")
    done = out.refresh(str(docs), now=100)
    assert (done.version, done.added, done.changed, done.removed, done.refused) == (1, 4, 0, 0, False)
    top = "a.md#plan"
    assert links(out) == {(top, "b.md#part", "references"), (top, "sub/c.md", "wikilinks_to"), ("b.md#part", "a.md", "references")}
    assert {r.reference_text for r in out.table("unresolved_refs").collect()} == {"nowhere", "the desk"}
    assert {r.path: r.errors is None for r in out.table("files").collect()} == {"a.md": True, "b.md": True, "sub/c.md": True, "bad.docx": False}
    gov = out.table("governance_metadata").collect()
    assert [(r.node_id, r.owner, r.status, r.approver) for r in gov] == [("a.md", "desk", "approved", None)]
    ents = {(r.entity_type, r.name, r.n_nodes) for r in out.table("entities").collect()}
    assert ("team", "Records desk", 2) in ents and ("concept", "nowhere", 1) in ents and len(ents) == 3
    assert [r.id for r in search.search(out.graph(), search.Request("retention"), []).collect()][0].startswith("sub/c.md")

    same = out.refresh(str(docs), now=150)
    assert (same.version, same.added, same.changed, same.removed) == (1, 0, 0, 0) and len(links(out)) == 3
    write(docs, b="# B\n\n## Other\n\n[gone](x.md)\n", d="# D\n\n[[b]]\n")
    (docs / "sub" / "c.md").unlink()
    done = out.refresh(str(docs), now=200)
    assert (done.added, done.changed, done.removed) == (1, 1, 1)
    assert links(out) == {(top, "b.md", "references"), ("d.md#d", "b.md", "wikilinks_to")}
    ages = {r.id: r.updated_at for r in out.table("nodes").collect()}
    assert ages["a.md"] == 100 and ages["b.md"] == 200 and "sub/c.md" not in ages and "b.md#part" not in ages
    assert not out.table("section_chunks").filter("file_path = 'sub/c.md'").count() and {"c", "x.md"} <= {r.reference_text for r in out.table("unresolved_refs").collect()}
    again = out.refresh(str(docs), force=True, now=300)
    assert again.added == 4 and {r.updated_at for r in out.table("nodes").collect()} == {300}


def test_a_vanished_folder_is_not_pruned(spark, tmp_path):
    docs, out = tmp_path / "docs", pipeline.Index(spark, str(tmp_path / "index"))
    write(docs, **{f"d{i}": f"# D{i}\n" for i in range(10)})
    out.refresh(str(docs))
    for i in range(6):
        (docs / f"d{i}.md").unlink()
    done = out.refresh(str(docs))
    assert done.refused and done.removed == 0 and out.table("files").count() == 10
    assert not out.refresh(str(docs), force=True).refused and out.table("files").count() == 4


def test_projects_and_similarity(spark, tmp_path):
    write(tmp_path / "p", a="# A\n\n[[q/plan]] keeps the same few words\n", b="# B\n\nkeeps the same few words\n", c="# C\n\nother text\n", d="# D\n\nnothing shared\n", e="# E\n\nalone\n")
    write(tmp_path / "q", plan="# Plan\n")
    done = pipeline.index_all(spark, {n: str(tmp_path / n) for n in ("p", "q", "none")}, str(tmp_path / "all"))
    assert done["p"].added == 5 and done["q"].added == 1 and isinstance(done["none"], Exception)
    hits = pipeline.cross_project_links(spark, str(tmp_path / "all"), ["p", "q"]).collect()
    assert [(r.target_project, r.target) for r in hits] == [("q", "q/plan.md")]
    index = pipeline.Index(spark, str(tmp_path / "all" / "p"))
    pairs = lambda: {(r.source, r.target) for r in index.refresh_similarity(0.1).collect()}
    assert pairs() == {("a.md", "b.md")}
    write(tmp_path / "p", c="# C\n\nkeeps the same few words twice\n")
    index.refresh(str(tmp_path / "p"))
    assert ("b.md", "c.md") in pairs() and pairs() == pairs()


def test_empty_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    index = pipeline.Index(spark, str(tmp_path / "index"))
    assert index.refresh(str(tmp_path / "docs")).added == 0 and index.table("edges").count() == 0 and index.graph().nodes("kind").filter(F.col("kind") == "document").count() == 0


@pytest.mark.parametrize("count", [501])
def test_cuts_are_told(count):
    from paperloom.sources import markdown

    text = "---\nentities:\n" + "".join(f"- {{name: e{i}}}\n" for i in range(count)) + "---\nx\n"
    parsed = markdown.parse("a.md", text.encode())
    assert len(parsed.entities) == 500 and "first 500" in parsed.error
