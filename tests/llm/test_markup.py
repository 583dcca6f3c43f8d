import random
import time

import pytest

from paperloom.llm import markup as m
from paperloom.llm.rewriting import rewrite

CASES = [
    ("<b>x</b> y", {"html"}), ("a <br/> b", {"html"}), ("R&amp;D it&#8217;s", {"html"}), ("<!-- note -->", {"html"}), ("<DIV ALIGN=left>x</DIV>", {"html"}),
    ("'''bold'''", {"wiki"}), ("''l'idée'' d'un", {"wiki"}), ("{{Notice|text=x}}", {"wiki"}), ("[[a|b]]", {"wiki"}), ("[https://wiki.example/1 x]", {"wiki"}),
    ("== x ==", {"wiki"}), ('{| class="w"\n|-\n| a || b\n|}', {"wiki"}), ("x~\\cite{r1}", {"latex"}), ("\\item one", {"latex"}), ("$x_1 = y^2$", {"latex"}),
    ("$$ q = \\frac{a}{b} $$", {"latex"}), ("\\[ s = \\sum_i w_i \\]", {"latex"}), ("\\(a + b\\)", {"latex"}), ("of $40\\,\\mathrm{kg}$ now", {"latex"}),
    ("# head", {"markdown"}), ("head\n=====", {"markdown"}), ("**b** x", {"markdown"}), ("*i* x", {"markdown"}), ("_i_ x", {"markdown"}), ("__b__", {"markdown"}),
    ("[a](b.md)", {"markdown"}), ("![a](b.png)", {"markdown"}), ("`code`", {"markdown"}), ("```\nx\n```", {"markdown"}), ("> quote", {"markdown"}),
    ("text first\n- item", {"markdown"}), ("1. one\n2. two", {"markdown"}), ("| a | b |\n|---|---|\n| c | d |", {"markdown"}), ("~~gone~~", {"markdown"}), ("x[^3]", {"markdown"}),
    ("Keep it if 3 < 5 and 9 > 4.", set()), ("AT&T style names", set()), ("from $5 to $12.", set()), ("Write to C:\\shared\\notes first.", set()), ("Path a/b/c~old", set()),
    ("Ticket #42 and #7", set()), ("The field review_due_date is", set()), ("2 * 3 * 4 gives", set()), ("note [4] or {draft}", set()), ("range 3 - 5", set()),
    ("He wrote 'done' and \"checked\".", set()), ("5 % of", set()), ("", set()), (None, set()), ("`<br>` only in code", {"markdown"}), ("```\n'''raw'''\n{{x}}\n```", {"markdown"}),
    ("plain words " * 20_000, set()), ("<i>x</i> '''y''' $z$ **b**", {"html", "wiki", "latex", "markdown"}),
]


def test_families(spark):
    df = spark.createDataFrame([(i, t, "k") for i, (t, _) in enumerate(CASES)] * 2, "i int, words string, kind string")
    got = {}
    for r in m.find_residue(df, ["i"], "words", list(m.FAMILIES)).collect():
        got.setdefault(r.i, []).append(r.family)
    for i, (text, families) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(families), (text, got.get(i))


@pytest.mark.parametrize(
    "text, excerpt, want",
    [
        ("<h2>A</h2><p>x &amp; y</p>", False, "## A"), ("== A ==", False, "## A"), ("\\section{A}", False, "# A"), ("'''x''' and ''y''", False, "x and y"),
        ("[[a|b]] [[c]]", False, "b c"), ("\\(a + b\\)", False, "$a + b$"), ("\\[ s \\]", False, "$$ s $$"), ("\\begin{itemize}\n\\item one\n\\end{itemize}", False, "- one"),
        ("it&#8217;s &lt;5", False, "it’s <5"), ("`<br>` stays", False, "`<br>` stays"), ("```\n<b>'''raw'''</b>\n```", False, "```\n<b>'''raw'''</b>\n```"),
        ("text <!-- unclosed note\n\nmany paragraphs", False, "text  unclosed note"), ("a <!-- see `x` --> b", False, "a  b"), ("<h2>Use `make` now</h2>", False, "## Use `make` now"),
        ("[[page|the `x` page]]", False, "the `x` page"), ("\\begin{itemize}\\item one\\item two\\end{itemize}", False, "- one\n- two"), ("{{a|{{b|c}}}}", False, "c"),
        ('{| class="w"\n|-\n! A !! B\n|-\n| a || b\n|}', False, "| A | B |\n| a | b |"), ("&euro; &rarr; &amp;lt;i&amp;gt;x &none;", False, "€ → x none"), ("\\textbf{{x}} \\emph{a {b} c", False, "x a b c"),
        ("<ol><li>a<ul><li>b</li></ul></ol>", False, "1. a\n  - b"), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", False, "```\n<b>\n```"), ("[[a {{b]] c}}", False, "a"),
        ("Overview\n=====\nx", True, "# Overview\nx"), ("[Home](/) [Help](/h) [Up](/u) [Top](/t)", False, "- [Home](/)\n- [Help](/h)\n- [Up](/u)\n- [Top](/t)"),
        ("**b** [a](u) ~~s~~", True, "b a s"), ("# head\n- item", True, "# head\n- item"), ("**b**", False, "**b**"), ("", False, ""), (None, True, None),
    ],
)
def test_clean(spark, text, excerpt, want):
    got = m.clean(spark.createDataFrame([(text, 1)], "t string, clean_text int"), "t", excerpt).first()
    assert (got.clean_text if got.clean_text is None else got.clean_text.strip().split("\n\n")[0]) == want


def test_nothing_is_left_of_any_mixture(spark):
    """Random mixtures of marks, closed or not, leave no HTML, wiki or LaTeX in the clean text, and lose no word between them."""
    rng = random.Random(21)
    marks = ["<b>", "</b>", "<!--", "-->", "&amp;", "&lt;", "&#91;", "''", "'''", "{{", "}}", "[[", "]]", "{|", "|}", "|", "\\textbf{", "{", "}", "\\item ", "\\(", "\\)", "\\[", "\\]", "$$", "$",
             "`", "```", "\n", "\n\n", "== ", " ==", "<h2>", "</h2>", "<pre>", "</pre>", "<li>", "\\begin{itemize}", "\\end{itemize}", "https://a.example", "[https://a.example x]", "# ", "- "]
    rows = [(i, "".join(rng.choice(marks) if rng.random() < 0.6 else f" word{k} " for k in range(rng.randrange(1, 25)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, t string")
    cleaned = m.clean(df, "t", False)
    left = m.left_over(cleaned, ["i"], "clean_text", ["html", "wiki", "latex"]).collect()
    assert not left, [(r, rows[r.i][1]) for r in left[:5]]
    outer = ("-->", "{|", "|}", "<!--", "$$", "$", "<pre>", "`", "```", "''", "'''", "|")
    unclosed = [(i, f"one {mark} two\n\nthree {mark} four") for i, mark in enumerate(x for x in marks if x not in outer)]
    unclosed += [(100 + i, f"one {mark} two\n\nthree four") for i, mark in enumerate(outer)]
    for r in m.clean(spark.createDataFrame(unclosed, "i int, t string"), "t", True).collect():
        assert all(w in r.clean_text for w in ("one", "two", "three", "four")), r


def test_time_grows_with_the_length():
    for text in ["x" * 40_000 + "\n---", "word " * 40_000, "<" * 40_000, "&amp;" * 8000 + "lt;", "{{" * 20_000, "[[" * 20_000, "` `` " * 8000, "a _b " * 8000, "<!-- " * 8000, "\\( " * 13_000,
                 "\\emph{" * 6000, "'' a" * 10_000, " " * 40_000 + "<b>", "{{[[\\a{" * 5000 + "<p>]]" * 3000, "{|\n" * 13_000]:
        began = time.time()
        rewrite(text, True)
        assert time.time() - began < 3, text[:20]


def test_long_texts_and_patterns(spark):
    rows = [(i, t) for i, t in enumerate(["x" * 40_000, "a _b " * 8000, "\\( " * 13_000, "[" * 40_000, "'' a" * 10_000, "\\(" + "y " * 50_000, " " * 40_000 + "-", "<a " * 10_000])]
    df = spark.createDataFrame(rows, "i int, t string")
    began = time.time()
    assert {(r.i, r.family) for r in m.find_residue(df, ["i"], "t", ["html", "wiki", "markdown"]).collect()} == set()
    assert m.clean(df, "t", True).count() == len(rows) and time.time() - began < 60


def test_structure_and_columns_stay(spark):
    text = "# One\n\n== Two ==\n\n<h3>Three</h3>\n\n- a\n- b\n\n```\n<b>\n```\n\n\\(x\\) and $y$\n\n\\item c"
    df = spark.createDataFrame([(text, 1, None, [1]), ("", 2, None, None), (None, 3, "z", None), ("\n \n", 4, "", [2])] * 3, "t string, clean_text int, _own0 string, l array<int>")
    got = m.clean(df, "t", False)
    assert got.columns == ["t", "_own0", "l", "clean_text"]
    assert sorted(str(r.clean_text) for r in got.collect() if r.t != text) == ["", "", "", "\n \n", "\n \n", "\n \n", "None", "None", "None"]
    assert [r.l for r in got.filter("t like '#%'").collect()] == [[1]] * 3
    counts = m.structure(got, "t")
    row = got.filter("t like '#%'").select(*[c.alias(f"{k}_{n}") for k, pair in counts.items() for n, c in zip("ba", pair)]).first().asDict()
    assert row == {"heading_b": 3, "heading_a": 3, "code_b": 1, "code_a": 1, "formula_b": 2, "formula_a": 2, "list_b": 3, "list_a": 3}
    assert m.clean(df.limit(0), "t", True).count() == 0


def test_the_tree_looks_at_the_neighbours(spark):
    def used(tree):
        return set() if isinstance(tree, int) else {m.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert len({"words_after", "words_before", "density_before", "density_after"} & used(m._tree(spark)[1])) >= 2
    long = "A paragraph of the usual length that has no mark at all and goes on for a while, as paragraphs do."
    docs = spark.createDataFrame([(1, f"{long}\n\n[The board](b.md)\n\n{long}"), (2, "[Home](/)\n\n[The board](b.md)\n\n[Help](/h)")], "i int, t string")
    kinds = {(r._own0, r.block_no): r.kind for r in m.classify(docs, "t").collect()}
    assert kinds[1, 2] == "markup" and kinds[2, 2] == "links"


def test_blocks_of_the_labelled_table_are_learnt(spark):
    docs = spark.createDataFrame([(k, "\n\n".join(b for _, b in doc)) for k, doc in enumerate(m.LABELLED)], "block_no int, block string")
    rows = m.classify(docs, "block").select("_own0", "block_no", "kind").collect()
    want = {(k, n): label for k, doc in enumerate(m.LABELLED) for n, (label, _) in enumerate(doc, 1)}
    hits = sum(want[r._own0, r.block_no] == r.kind for r in rows)
    assert len(rows) == len(want) and hits >= 0.95 * len(want)


def test_empty_table(spark):
    assert m.find_residue(spark.createDataFrame([], "i int, t string"), ["i"], "t", ["html"]).count() == 0
