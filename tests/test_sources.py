import io
import zipfile

from paperloom.operators import resolve
from paperloom.sources import code, docx, html, markdown, pdf, scan
from paperloom.sources.model import excerpt, slug

DOC = """---
title: Team notes
tags: [Docs, testing, docs]
owner: desk
supersedes: "[[old notes]]"
skill_advisory:
  status: draft
---
# Überblick

Text with [a link](../x/b.md#part), [[other|shown]] and ![[figure]]. See <https://example.org/a> or https://example.org/b.
`[not](a.md)` and `[[nor this]]`.

## Part

**Term:** what it means

```
# no heading [[no]]
```

<!-- ## hidden -->

## Part

[ref][r]

[r]: https://example.org/c

Setext
======
"""


def test_markdown():
    p = markdown.parse("n/a.md", DOC.encode())
    kinds = {}
    for n in p.nodes:
        kinds.setdefault(n["kind"], []).append(n)
    assert [n["id"] for n in kinds["heading"]] == ["n/a.md#überblick", "n/a.md#part", "n/a.md#part-2", "n/a.md#setext"]
    assert kinds["document"][0]["name"] == "Überblick" and [n["name"] for n in kinds["tag"]] == ["Docs", "testing"]
    assert [n["id"] for n in kinds["definition"]] == ["n/a.md#def-term"]
    links = {(x["reference_text"], x["reference_kind"], x["from_node_id"]) for x in p.links}
    top = "n/a.md#überblick"
    assert links == {
        ("../x/b.md#part", "markdown_link", top), ("other|shown", "wikilink", top), ("figure", "embed", top), ("https://example.org/a", "external", top),
        ("https://example.org/b", "external", top), ("https://example.org/c", "external", "n/a.md#part-2"), ("old notes", "wikilink", "n/a.md"),
    }
    contains = [(e["source"], e["target"]) for e in p.edges if e["kind"] == "contains"]
    assert ("n/a.md#überblick", "n/a.md#part") in contains and ("n/a.md", "n/a.md#setext") in contains
    assert {(t["key"], t["value"], t["source"]) for t in p.tuples} == {("title", "Team notes", "frontmatter"), ("owner", "desk", "frontmatter"),
        ("supersedes", "[[old notes]]", "frontmatter"), ("status", "draft", "skill_advisory")}
    assert [c["heading_path"] for c in p.chunks] == ["", "Überblick", "Überblick > Part", "Überblick > Part", "Setext"]


def test_markdown_edges():
    assert markdown.parse("a.md", b"").nodes[0]["name"] == "a"
    assert "end of frontmatter" in markdown.parse("a.md", b"---\nx: 1\n").error
    assert markdown.parse("a.md", b"---\nx: [\n---\n# T").error.startswith("frontmatter") and markdown.parse("a.md", b"---\n---\n").error is None
    big = markdown.parse("a.md", b"# T\n" + b"\xc3\xa9" * 20_000)
    assert len(big.chunks[0]["text"].encode()) <= 10_240 + 20 and big.chunks[0]["text"].endswith("[...truncated]")
    assert len(excerpt("wort " * 300).encode()) <= 500 and slug(" Ä b--C! ") == "ä-b--c"


def test_html():
    page = b'<html><head><title>T &amp; x</title><meta name="author" content="me"><style>p{}</style></head><body><h1 id="top">One</h1>\n<p>text <a href="b.html">b</a></p>\n<script>no()</script><h2>Two</h2><a href="https://example.org">e</a></body></html>'
    p = html.parse("a.html", page)
    assert [(n["id"], n["name"]) for n in p.nodes] == [("a.html", "T & x"), ("a.html#top", "One"), ("a.html#h2-2", "Two")]
    assert [(x["reference_text"], x["reference_kind"]) for x in p.links] == [("b.html", "html_link"), ("https://example.org", "external")]
    assert p.tuples[0]["source"] == "html_meta" and "no()" not in p.chunks[0]["text"]
    assert html.parse("b.html", b"\xff<h1>x").nodes[0]["kind"] == "document"


def word(paragraphs, extra=()):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{x}</w:p>' for s, x in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="../b.docx"/></Relationships>')
        z.writestr("docProps/core.xml", "<c><title>The plan</title><creator>me</creator></c>")
        for name, text in extra:
            z.writestr(name, text)
    return data.getvalue()


def test_docx():
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    p = docx.parse("x/a.docx", word([("Heading1", t("First part")), ("Normal", t("see ") + f'<w:hyperlink r:id="r1">{t("b")}</w:hyperlink>')]))
    assert [n["id"] for n in p.nodes] == ["x/a.docx", "x/a.docx#heading-first-part-0"] and p.nodes[0]["name"] == "The plan"
    assert p.links[0]["reference_kind"] == "docx_hyperlink" and p.links[0]["from_node_id"].endswith("first-part-0")
    assert {x["key"] for x in p.tuples} == {"title", "creator"}
    assert "leaves" in docx.parse("a.docx", word([], [("../x", "y")])).error and docx.parse("a.docx", b"junk").error
    assert "too many" in docx.parse("a.docx", word([], [(f"e{i}", "") for i in range(600)])).error


def test_pdf_pages():
    p = pdf.pages_to_document("a.pdf", b"x", ["readable text " * 20, "�" * 50, ""], {"title": "T"})
    assert [n["id"] for n in p.nodes] == ["a.pdf", "a.pdf#page-1"] and p.error is None
    assert pdf.pages_to_document("a.pdf", b"x", ["a", "b"]).error == "image-only-pdf"


def found(path, text):
    return [(k, s) for k, s, *_ in code.entries(path, text, code.LANGUAGES[path.rsplit(".", 1)[-1]])]


def test_code_languages():
    assert found("a.go", "// Package a does.\npackage a\n\n// Run runs.\nfunc Run() {}\n\n// hidden\nfunc run() {}\n") == [("file_header", ""), ("doc_comment", "Run")]
    assert found("a_test.go", "package a\n\n// checks\nfunc TestRun(t *testing.T) {}\nfunc ExampleRun() {}\n") == [("test_func", "TestRun"), ("example_func", "ExampleRun")]
    assert found("a.py", '"""Head."""\n\ndef f():\n    """Does."""\n\ndef _g():\n    """No."""\n\ndef test_x():\n    pass\n') == [("file_header", ""), ("doc_comment", "f"), ("test_func", "test_x")]
    assert found("a.ts", "/** Head */\nimport x\n\n/** Makes. */\nexport function make() {}\n\ndescribe('all', () => {})\n") == [("file_header", ""), ("doc_comment", "make"), ("test_func", "all")]
    assert found("a.vue", "<template/>\n<script>\nimport x\n/** Makes. */\nexport const make = 1\n</script>") == [("doc_comment", "make")]
    assert found("a.rs", "use x;\n\n/// Adds.\npub fn add() {}\n\n#[test]\nfn adds() {}\n") == [("doc_comment", "add"), ("test_func", "adds")]
    assert found("A.java", "package a;\n\n/** Shop. */\npublic class Shop {\n  /** Sells. */\n  public int sell(int n) {}\n  @Test\n  void sells() {}\n}") == [("doc_comment", "Shop"), ("doc_comment", "sell"), ("test_func", "sells")]
    assert found("a.rb", "x = 1\n\n# Adds.\ndef add; end\nit 'adds' do\n") == [("doc_comment", "add"), ("test_func", "adds")]
    assert found("a.sql", "-- Head\n\nselect 1;\n\n-- Sales\nCREATE VIEW sales AS select 1;\n") == [("file_header", ""), ("doc_comment", "sales")]
    assert found("a.lua", "local x\nlocal y\nlocal z\n\n-- adds\nfunction add() end\n") == [("doc_comment", "add")]
    assert found("a.pas", "unit a;\n\n\n\n{ adds }\nprocedure Add;\n") == [("doc_comment", "Add")]
    assert found("a.cs", "using x;\n\n\n/// Sells\npublic class Shop {\n[Fact]\npublic void Sells() {}\n}") == [("doc_comment", "Shop"), ("test_func", "Sells")]
    assert found("a.liquid", "{% comment %} head {% endcomment %}\n<p>") == [("file_header", "")]
    for e in code.LANGUAGES:  # nothing crashes on odd input
        for text in ("", "\n\n", "/* open", '"""', "{% comment %}", "x" * 10_000):
            code.entries(f"a.{e}", text, code.LANGUAGES[e])


def test_ignore_rules():
    ignore = scan.Ignore([("", "*.tmp"), ("", "/drafts/"), ("", "docs/secret*"), ("", "!keep.tmp"), ("sub", "x.md"), ("", "# no")])
    assert ignore("a/b.tmp") and ignore("docs/secret.md") and ignore("sub/x.md") and not ignore("x.md") and not ignore("a/keep.tmp") and ignore("drafts/a.md")


def test_folder_to_tables(spark, tmp_path):
    root = tmp_path / "pro ject"
    for name, text in {"n/a.md": DOC, "x/b.md": "# B\n## Part\n", "n/other.md": "# Other", ".git/c.md": "# no", "node_modules/d.md": "# no", "e.txt": "no", "bad.docx": "junk", "big.md": "x" * (scan.MB + 1)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = scan.list_files(spark, str(root))
    assert {r.path for r in files.collect()} == {"n/a.md", "x/b.md", "n/other.md", "bad.docx", "big.md"}
    parsed = scan.parse_files(scan.without_ignored(files, [("", "other.md")])).cache()
    assert {r.path: bool(r.error) for r in parsed.collect()} == {"n/a.md": False, "x/b.md": False, "bad.docx": True, "big.md": True}
    nodes, links = scan.table(parsed, "nodes"), scan.table(parsed, "links")
    refs = links.selectExpr("monotonically_increasing_id() AS id", "*")
    docs, heads = nodes.filter("kind = 'document'"), nodes.filter("kind = 'heading'").select("id")
    edges = {(r.source, r.target, r.kind) for r in resolve.resolve(refs, docs, heads).filter("target is not null").collect()}
    assert ("n/a.md#überblick", "x/b.md#part", "references") in edges and sum(k == "links_external" for *_, k in edges) == 2
    assert scan.table(parsed, "chunks").count() >= 6 and scan.table(parsed, "edges").count() >= 6 and scan.table(parsed, "tuples").count() == 4
