"""Markup residue in text documents (problem 6).

A text is taken as a flat row of blocks.  Every block gets its word count, its link density, those of
its neighbours and a few marks of its own; a decision tree trained on the small labelled table below
tells what the block is (plain prose, prose with markup, heading, list, code, formula, table, quote or
one of a run of navigation links).  A single link between long paragraphs is prose, the same link
beside other links or short lines is navigation: only the neighbours tell.  The tree is turned into one
CASE expression, so classifying takes no Python.

* :func:`find_residue` names the markup families in the blocks that the tree does not call plain; an
  exact pattern per family decides.
* :func:`clean` rewrites the texts that have other blocks than plain ones to plain Markdown structure:
  ``#`` headings, ``-`` lists, ``|`` tables, fenced code and ``$`` formulas stay apart from the prose;
  navigation becomes a list, rows of a table that its blocks tore apart become rows, code is never
  touched.  See :mod:`paperloom.llm.rewriting` for marks that are nested or never closed.

The plain class takes blocks without any mark only: word counts and link densities alone cannot tell
whether a paragraph holds one entity or one pair of stars, so they decide between the other classes.

Defined results: null and blank texts have no blocks, no residue and stay null or blank; repeated
rows give repeated rows; an unclosed fence runs to the end of its text; blank lines before the first
block are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.llm.rewriting import rewrite, tidy, wiki_rows
from paperloom.llm.splitting import SEGMENT
from paperloom.session import boxed, own, unboxed

FENCE = "|".join(rf"^{m}[^\n]*+(?:\n(?!{m})[^\n]*+)*+(?:\n{m}[^\n]*+)?+" for m in ("```", "~~~"))
CODE = rf"(?md)(?:{FENCE})|(`+)(?!`)[^\n]*?(?<!`)\1(?!`)"

#: One pattern per family; a construct belongs to one family only.  No part can try the
#: rest of a line or text from every place in it again: what repeats stops at the next opening mark.
FAMILIES = {
    "html": r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*+)?/?>|<!--|<!DOCTYPE|<\?xml|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    "wiki": (
        r"''(?=[^'\s])(?:[^'\n]|'(?!'))++''|\{\{[^{}]++\}\}|\[\[[^\[\]\n]++\]\]|\[(?:https?|ftp)://[^\s\]]++(?: [^\]\n]*+)?\](?!\()"
        r"|^[ \t]*+(={1,6})(?!=)[ \t]*+[^=\s](?:[^\n]*[^=\s])?[ \t]*+\1[ \t]*$|^[ \t]*+\{\|"
    ),
    "latex": (
        r"\\[A-Za-z]++\*?(?:\[[^\]\n]*+\])?\{|(?:^|(?<=[\s({$~]))\\[A-Za-z]++(?!\\)|\\\((?!\\\))[^\\]*+(?:\\(?![()])[^\\]*+)*+\\\)"
        r"|\\\[(?!\\\])[^\\]*+(?:\\(?![\[\]])[^\\]*+)*+\\\]|\$\$[^$]++\$\$|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*[^\s$\\])?\$(?![\d$])"
    ),
    "markdown": (
        r"^[ ]{0,3}#{1,6}[ \t]+\S|^(?=[^\n]*\S)[^\n]*+\n[ ]{0,3}(?:={2,}+|-{3,}+)[ \t]*$|\*\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*"
        r"|(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|^(?>[^\n]*?(?<![\w_])_(?=[^\s_]))[^\n]*?(?<=[^\s_])_(?![\w_])"
        r"|^(?>[^\n]*?(?<![\w_])__(?=[^\s_]))[^\n]*?(?<=[^\s_])__(?![\w_])"
        r"|!?\[[^\[\]\n]*+\]\([^()\s][^()\n]*+\)|`[^`\n]++`|^(?:```|~~~)|^[ ]{0,3}>[ \t]*+\S|^[ \t]*+[-*+][ \t]++\S|^[ \t]*+\d{1,9}[.)][ \t]++\S"
        r"|^[ \t]*+(?:\|[ \t]*+)?:?-{3,}+:?[ \t]*+(?:\|[ \t]*+:?-{3,}+:?[ \t]*+)++\|?[ \t]*$|~~(?=\S)[^~\n]++~~|\[\^[^\]\s]++\]"
    ),
}

#: Where something could begin that belongs to a family, counted as a block's marks.
_MARK = (
    r"<[/!?A-Za-z]|&[#A-Za-z]|''|\{[{|]|\[|\\[A-Za-z(\[]|\$|\*\S|(?<!\w)_|`|~~|^[ \t]*(?:[=#>|+:!]|[-*][ \t-]|\d{1,9}[.)][ \t])|\n[ ]{0,3}[=-]{2}|-{3}"
)

FEATURES = [
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "marks", "heading", "listed", "fenced", "formula", "bars", "quoted",
]

#: The labelled table, small documents as rows of (label, block).
LABELLED = [
    [("heading", "# Keeping records"), ("plain", "Records are kept for seven years after the file is closed."), ("list", "- keep the index\n- keep the log"), ("plain", "Nothing else is kept unless a reviewer asks for it.")],
    [("links", "[Home](/) [Search](/s) [Help](/h)"), ("heading", "== History =="), ("markup", "The '''old plan''' was replaced by the [[new plan|plan of May]]."), ("plain", "It was never used again."), ("links", "[[Plans]] [[Lists]] [[Index]]")],
    [("heading", "\\section{Method}"), ("markup", "We follow~\\cite{ref1} and use \\emph{two} passes."), ("formula", "$$ q = \\frac{a}{b} $$"), ("formula", "\\[ s = \\sum_i w_i \\]"), ("list", "\\item first pass\n\\item second pass"), ("plain", "Both passes read the same input.")],
    [("heading", "<h2>Contacts</h2>"), ("markup", "<p class=\"note\">Ask the desk &amp; the lead.</p>"), ("list", "<li>desk</li>\n<li>lead</li>"), ("links", "<a href=\"/a\">Back</a> <a href=\"/b\">Next</a>"), ("plain", "The desk is open on working days.")],
    [("plain", "Run the job twice a week."), ("code", "```\nfor i in range(3):\n    run(i)\n```"), ("code", "~~~\nx = load('a')\n~~~"), ("plain", "It ends without output."), ("quote", "> Keep it simple.\n> Keep it short.")],
    [("table", "| item | state |\n|---|---|\n| plan | open |"), ("table", "{| class=\"wikitable\"\n|-\n| plan || open\n|}"), ("markup", "See **the plan** and `the code`."), ("plain", "Keep it if 3 < 5 and 9 > 4."), ("markup", "The fee went from $5 to $12.")],
    [("heading", "Overview\n====="), ("plain", "An overview is given first. It says what the page is for and who keeps it up to date."), ("list", "1. read\n2. sign\n3. file"), ("plain", "The field review_due_date is optional."), ("markup", "''Note'' the limits.")],
    [("plain", "Short line"), ("markup", "R&amp;D the plan"), ("markup", "<!-- check this -->"), ("markup", "{{Notice|text=open}}"), ("formula", "$x_1 = y^2$"), ("markup", "with $x_1 = y^2$ as above")],
    [("code", "```tex\n\\textbf{x} $y_1$\n```"), ("plain", "A long paragraph explains the choice in several sentences. It has no marks at all. It goes on for a while, so that its length is that of a usual paragraph in a handbook."), ("markup", "A long paragraph has one [link](a.md) in it and goes on for a while, so that its length is that of a usual paragraph in a handbook."), ("links", "[1](a) [2](b) [3](c) [4](d)")],
    [("plain", "この文書は公開されています。"), ("markup", "''計画''を見直します。"), ("list", "- 計画\n- 記録"), ("heading", "### 概要"), ("quote", "> 記録を残す"), ("table", "| a | b |\n|---|---|")],
    [("plain", "He wrote a_b and c|d."), ("plain", "Ticket #42 stays open."), ("plain", "a/b/c~old"), ("plain", "Use the range 3 - 5."), ("plain", "\"Quoted\" words (in brackets) are plain."), ("markup", "Write to C:\\shared first.")],
    [("links", "[Home](/)"), ("links", "[Search](/s)"), ("links", "[Help](/h)"), ("plain", "The board meets once a quarter and reads every report that was filed since the last meeting."), ("markup", "[The board](board.md)"), ("plain", "It also hears the people who filed them, if they ask for it in good time before the meeting.")],
    [("plain", "Each team names one person who answers questions about its records and keeps the index in order."), ("markup", "[[Team list]]"), ("plain", "Whoever leaves a team hands the index over and tells the desk who will keep it from then on."), ("markup", "<a href=\"desk.html\">The desk</a>"), ("plain", "The desk answers within two working days and tells the team if the question needs more time.")],
    [("links", "[[Plans]]"), ("links", "[[Lists]]"), ("links", "[[Index]]"), ("links", "[[Team list]]"), ("plain", "The page was moved here from the old site together with its history and all of its links.")],
    [("heading", "# Sources"), ("markup", "[The report of the board](report.md)"), ("plain", "The report was read by two reviewers who found that most of its numbers could be checked."), ("links", "<a href=\"/x\">Next</a>"), ("links", "<a href=\"/y\">Top</a>"), ("links", "<a href=\"/z\">Print</a>")],
    [("plain", "A paragraph of the usual length ends here without any mark, as most paragraphs of a handbook do."), ("links", "[1](a.md) [2](b.md)"), ("links", "[Back](c.md)"), ("links", "[Index](d.md)")],
    [("markup", "[[The plan]]")], [("markup", "[See the plan](plan.md)")], [("markup", "[[Old plan|plan]] [[List]]")], [("links", "[Home](/) [Search](/s) [Help](/h) [Index](/i)")],
    [("table", "! name !! state"), ("table", "| plan || open"), ("table", "| list || done"), ("plain", "The table above is kept by hand and is read again before every meeting of the board.")],
]


def _once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """Adds columns through a generator of one row: computed once, never inlined into later steps."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def blocks_of(texts: DataFrame, text: str, outer: bool = False) -> DataFrame:
    """One row per block: the text's row (see ``boxed``), block_no, block and the features of the tree.

    With ``outer``, texts without blocks have one row with nulls.
    """
    link = r"!?\[[^\[\]\n]*\]\([^()\n]*\)|\[\[[^\[\]\n]+\]\]|\[https?://[^\]\n]+\]|<a\s[^>]*>[^<]*</a>"
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1  # spaces and one: no regular expression over every text
    df = _once(boxed(texts, _text=F.col(text)), _blocks=F.filter(F.regexp_extract_all(F.col("_text"), F.lit(SEGMENT), 0), lambda s: s.rlike(r"(?U)\S")))
    linked = lambda b: F.when(
        b.contains("[") | b.contains("<a"), words(F.array_join(F.regexp_extract_all(b, F.lit(link), 0), " "))
    ).otherwise(0)
    df = _once(df, _stats=F.transform("_blocks", lambda b: F.struct(words(b).alias("w"), linked(b).alias("l"))))
    df = df.select(*[own(texts, c) for c in texts.columns], "_stats", (F.posexplode_outer if outer else F.posexplode)("_blocks").alias("_i", "block"))
    near = lambda k: F.get("_stats", F.col("_i") + k)
    density = lambda s: F.coalesce(F.when(s["w"] > 0, F.least(s["l"] / s["w"], F.lit(1.0))), F.lit(0.0))
    b, start = F.col("block"), F.substring("block", 1, 60)
    # most blocks have none of these characters and need no count
    may = b.rlike(r"[<&\[{\\$*_`~=#>|!]") | b.contains("''") | b.contains("---") | b.rlike(r"(?md)^[ \t]*+[-+:\d]")
    df = _once(df, _marks=F.when(may, F.regexp_count(b, F.lit(f"(?mdU){_MARK}"))).otherwise(0))
    marked = F.col("_marks") > 0
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    values = {
        "words": near(0)["w"].cast("double"), "density": density(near(0)),
        "words_before": F.coalesce(near(-1)["w"], F.lit(0)).cast("double"), "density_before": density(near(-1)),
        "words_after": F.coalesce(near(1)["w"], F.lit(0)).cast("double"), "density_after": density(near(1)),
        "marks": F.col("_marks").cast("double"),
        "heading": flag(marked & start.rlike(r"^\s*(?:#{1,6}\s|=+[^=\n]+=|\\(?:sub)*section|\\chapter|<[hH][1-6]|[^\n]+\n=+\s*$)")),
        "listed": flag(marked & start.rlike(r"^\s*(?:[-*+]\s|\d{1,9}[.)]\s|\\item|<li)")),
        "fenced": flag(marked & start.rlike(r"^\s*(?:```|~~~|<pre)")),
        "formula": flag(marked & start.rlike(r"^\s*(?:\$\$|\\\[|\$[^$\n]+\$\s*$|\\begin\{(?:equation|align))")),
        "bars": F.when(b.contains("|") | b.contains("!"), F.length(b) - F.length(F.translate(b, "|!", ""))).otherwise(0).cast("double"),
        "quoted": flag(marked & start.rlike(r"^\s*>")),
    }
    df = _once(df, **values)
    return df.withColumn("block_no", F.col("_i") + 1).drop("_stats", "_i", "_marks")


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A decision tree by Gini impurity: (feature, threshold, left, right) or a class number."""
    counts = np.bincount(y)
    if depth == 0 or (counts > 0).sum() == 1:
        return int(counts.argmax())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            impurity = sum(part.sum() * (1 - ((np.bincount(y[part]) / part.sum()) ** 2).sum()) for part in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None:
        return int(counts.argmax())
    _, f, t, left = best
    return (f, t, _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1))


@cache
def _tree(spark: SparkSession):
    """Trains the tree on the labelled table (a fixed table of some 100 rows, which comes to the driver)."""
    docs = [(k, "\n\n".join(b for _, b in doc)) for k, doc in enumerate(LABELLED)]
    table = spark.createDataFrame(docs, "doc int, text string")
    rows = blocks_of(table, "text").select(own(table, "doc").alias("doc"), "block_no", *FEATURES).collect()
    label = {(k, n): name for k, doc in enumerate(LABELLED) for n, (name, _) in enumerate(doc, 1)}
    names = sorted(set(label.values()))
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float)
    y = np.array([names.index(label[r["doc"], r["block_no"]]) for r in rows])
    return names, _grow(x, y, depth=12)


def _as_case(tree, names: list[str]) -> F.Column:
    if isinstance(tree, int):
        return F.lit(names[tree])
    f, t, left, right = tree
    return F.when(F.col(FEATURES[f]) <= t, _as_case(left, names)).otherwise(_as_case(right, names))


def classify(texts: DataFrame, text: str, outer: bool = False) -> DataFrame:
    """One row per block with its features and its kind (see :func:`blocks_of`)."""
    names, tree = _tree(texts.sparkSession)
    return blocks_of(texts, text, outer).withColumn("kind", _as_case(tree, names))


def without_code(c: F.Column) -> F.Column:
    return F.when(c.contains("`") | c.contains("~~~"), F.regexp_replace(c, CODE, " ")).otherwise(c)


def find_residue(texts: DataFrame, keys: list[str], text: str, families: list[str]) -> DataFrame:
    """(keys, family): the families of which a text holds a construct.

    Blocks that the tree calls plain are left out; the rest is tested against each family's pattern,
    HTML, wiki and LaTeX outside of code.
    """
    slim = texts.select(*keys, F.col(text).alias("_item"))
    named = [own(slim, k).alias(f"_key{i}") for i, k in enumerate(keys)]
    blocks = classify(slim, "_item").filter("kind <> 'plain'").select(*named, "block")
    blocks = _once(blocks, _bare=without_code(F.col("block")))
    hits = [
        F.when(F.col("block" if family == "markdown" else "_bare").rlike(f"(?mdU){FAMILIES[family]}"), family) for family in families
    ]
    found = blocks.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.array_compact(F.array(*hits))).alias("family"))
    return found.distinct()


_LINK = re.compile(r"\s*(?:[|·•–>/]\s*)?(!?\[[^\[\]\n]*\]\([^()\n]*\)|\[\[[^\[\]\n]+\]\]|\[https?://[^\]\n]+\]|<a\s[^>]*>[^<]*</a>)")
_TORN = re.compile(r"[ \t]*[|!][^\n]*(?:\|\||!!)")


def _prepared(kind: str, block: str, has_tables: bool) -> str:
    """A block in the form its class asks for: links of a navigation as a list, rows of a torn wiki table as rows."""
    if kind == "links":
        return _LINK.sub(r"\n- \1", block).lstrip("\n")
    if kind == "table" and not has_tables and _TORN.match(block):
        return "\n".join(wiki_rows(block.rstrip("\n").split("\n"))) + block[len(block.rstrip("\n")) :]
    return block


def clean_blocks(kinds: list[str], blocks: list[str], excerpt: bool) -> str:
    """The clean text of the blocks of a text."""
    if kinds == ["none"]:
        return blocks[0]
    if all(k == "plain" for k in kinds):
        return tidy("".join(blocks))
    has_tables = any("{|" in b for b in blocks)
    return rewrite("".join(_prepared(k, b, has_tables) for k, b in zip(kinds, blocks)), excerpt)


def clean(texts: DataFrame, text: str, excerpt: bool) -> DataFrame:
    """Adds ``clean_text``: the text without HTML, wiki and LaTeX markup, structure kept as Markdown.

    The blocks of a text follow one another in one task, so they are put together again without a
    shuffle; the other columns travel with the first block only.
    """
    rows = classify(texts, text, outer=True)
    first = F.col("block_no") == 1
    owned = [F.when(first | F.col("block_no").isNull(), own(texts, c)).alias(f"_own{i}") for i, c in enumerate(texts.columns)]
    slim = rows.select(*owned, F.coalesce("block_no", F.lit(1)).alias("_no"), F.when(F.col("block_no").isNull(), "none").otherwise(F.col("kind")).alias("_kind"),
                       F.when(F.col("block_no").isNull(), own(texts, text)).otherwise(F.col("block")).alias("_block"))
    fields = [StructField(f"_own{i}", texts.schema[i].dataType) for i in range(len(texts.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, kinds, blocks = None, [], []  # the last text of a batch may go on in the next

        def done(heads: list[pa.RecordBatch], cleaned: list) -> pa.RecordBatch:
            whole = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(cleaned, pa.string())], [*whole.schema.names, "_clean"])

        for batch in batches:
            heads = batch.select(range(len(fields)))
            numbers, names, parts = batch["_no"].to_numpy(), batch["_kind"].to_pylist(), batch["_block"].to_pylist()
            starts = np.flatnonzero(numbers == 1).tolist()
            ready, cleaned = [], []
            if starts and starts[0] > 0 or not starts:
                until = starts[0] if starts else len(numbers)
                kinds += names[:until]
                blocks += parts[:until]
            if not starts:
                continue
            if waiting is not None:
                ready.append(waiting)
                cleaned.append(_whole(kinds, blocks, excerpt))
            for a, b in zip(starts, starts[1:]):
                cleaned.append(_whole(names[a:b], parts[a:b], excerpt))
            if len(starts) > 1:
                ready.append(heads.take(pa.array(starts[:-1])))
            waiting, kinds, blocks = heads.take(pa.array(starts[-1:])), names[starts[-1] :], parts[starts[-1] :]
            if ready:
                yield done(ready, cleaned)
        if waiting is not None:
            yield done([waiting], [_whole(kinds, blocks, excerpt)])

    found = slim.mapInArrow(run, StructType([*fields, StructField("_clean", StringType())]))
    return unboxed(found, texts, clean_text=F.col("_clean"))


def _whole(kinds: list[str], blocks: list[str | None], excerpt: bool) -> str | None:
    return None if blocks[0] is None else clean_blocks(kinds, blocks, excerpt)


def left_over(cleaned: DataFrame, keys: list[str], text: str, families: list[str]) -> DataFrame:
    """(keys, family) of what a cleaned text still holds outside of its code and formulas."""
    bare = F.regexp_replace(without_code(F.col(text)), f"(?U){_KEPT_FORMULA}", " ")
    return find_residue(cleaned.select(*keys, bare.alias("_bare_text")), keys, "_bare_text", families)


_KEPT_FORMULA = r"\$\$[^$]++\$\$|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*[^\s$\\])?\$(?![\d$])"
_FENCED = "|".join(rf"^{m}[^\n]*+(?:\n(?!{m})[^\n]*+)*+(?:\n{m}[^\n]*+)?+" for m in ("```", "~~~"))
_UNDERLINED = r"^(?=[^\n]*\S)[^\n]*+\n[ ]{0,3}(?:={2,}+|-{3,}+)[ \t]*$"
#: Constructs that clean text keeps, as they may be written before cleaning and as they are written after it.
STRUCTURE = {
    "heading": (
        _UNDERLINED + r"|^[ ]{0,3}#{1,6}[ \t]+\S|^[ \t]*+(={1,6})(?!=)[ \t]*+[^=\s](?:[^\n]*[^=\s])?[ \t]*+\1[ \t]*$|<[hH][1-6](?:\s[^<>]*+)?>|\\(?:chapter|(?:sub){0,2}section)\*?\{",
        _UNDERLINED + r"|^[ ]{0,3}#{1,6}[ \t]+\S",
    ),
    "code": (rf"{_FENCED}|<pre(?:\s[^<>]*+)?>", _FENCED),
    "formula": (
        rf"{_KEPT_FORMULA}|\\\((?!\\\))[^\\]*+(?:\\(?![()])[^\\]*+)*+\\\)|\\\[(?!\\\])[^\\]*+(?:\\(?![\[\]])[^\\]*+)*+\\\]|\\begin\{{(?:equation|align)\*?\}}",
        _KEPT_FORMULA,
    ),
    "list": (r"^[ \t]*+(?:[-*+]|\d{1,9}[.)])[ \t]++\S|<li(?:\s[^<>]*+)?>|\\item(?![A-Za-z])", r"^[ \t]*+(?:[-*+]|\d{1,9}[.)])[ \t]++\S"),
}


def structure(cleaned: DataFrame, before: str, after: str = "clean_text") -> dict[str, tuple[F.Column, F.Column]]:
    """Per construct, how often it stands in the text before and after cleaning (outside of code, but for code itself)."""
    bare = {c: without_code(F.col(c)) for c in (before, after)}
    pick = lambda name, c: F.col(c) if name == "code" else bare[c]
    return {name: (F.regexp_count(pick(name, before), F.lit(f"(?mdU){b}")), F.regexp_count(pick(name, after), F.lit(f"(?mdU){a}"))) for name, (b, a) in STRUCTURE.items()}
