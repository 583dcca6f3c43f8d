"""Queries of the text problems (3, 6 to 10) with their SQL counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.graph_tables import existing_nodes
from paperloom.llm import distinctive, language, markup, mixing, packing, splitting, tokens
from paperloom.session import own, read, spread

TEXT_LIMIT, TEXT_OVERLAP = 4000, 200
EXCERPT_LIMIT, EXCERPT_OVERLAP = 500, 50


def _split(spark, d, keep_short: bool) -> list[tuple[DataFrame, int]]:
    """Sections and excerpts as (split items with field, node_id, heading_path; limit)."""
    sections = spread(read(spark, d, "section_chunks")).select(F.lit("text").alias("field"), "node_id", "heading_path", F.col("text").alias("item"))
    nodes = existing_nodes(read(spark, d, "nodes"), ["qualified_name", "body_excerpt"])
    path = F.regexp_extract("qualified_name", r"#(.*)$", 1)
    excerpts = nodes.select(F.lit("body_excerpt").alias("field"), F.col("id").alias("node_id"), path.alias("heading_path"), F.col("body_excerpt").alias("item"))
    out = []
    for items, limit, overlap in ((sections, TEXT_LIMIT, TEXT_OVERLAP), (excerpts, EXCERPT_LIMIT, EXCERPT_OVERLAP)):
        wanted = items if keep_short else items.filter(F.octet_length("item") > limit)
        out.append((splitting.split_items(wanted, "item", limit, overlap), limit))
    return out


def p3_found(spark, d):
    parts = [splitting.oversized(split, ["field", "node_id"], limit) for split, limit in _split(spark, d, False)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p3_pieces(spark, d):
    parts = [splitting.pieces_of(split, ["field", "node_id", "heading_path"]) for split, _ in _split(spark, d, True)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p3_restored(spark, d):
    """Per field: items, those cut, bytes of all pieces without what they share, items not given back or with a piece over the limit."""
    parts = [splitting.put_together(split, "item", limit) for split, limit in _split(spark, d, True)]
    rows = reduce(DataFrame.unionByName, [p.select("field", "n_pieces", "n_bytes", "restored", "within") for p in parts])
    return rows.groupBy("field").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("n_pieces") > 1).alias("n_cut"), F.sum("n_bytes").alias("n_bytes"),
        F.count_if(~F.col("restored")).alias("n_not_restored"), F.count_if(~F.col("within")).alias("n_over_limit"),
    )


def _marked_up(spark, d):
    sections = spread(read(spark, d, "section_chunks")).select(F.lit("text").alias("field"), "node_id", F.col("text").alias("item"))
    nodes = existing_nodes(read(spark, d, "nodes").filter("id is not null"), ["body_excerpt"])
    return sections, nodes.select(F.lit("body_excerpt").alias("field"), F.col("id").alias("node_id"), F.col("body_excerpt").alias("item"))


def p6_found(spark, d):
    sections, excerpts = _marked_up(spark, d)
    keys = ["field", "node_id"]
    in_text = markup.find_residue(sections, keys, "item", ["html", "wiki", "latex"])
    return in_text.unionByName(markup.find_residue(excerpts, keys, "item", list(markup.FAMILIES)))


def p6_clean(spark, d):
    sections, excerpts = _marked_up(spark, d)
    parts = [markup.clean(sections.distinct(), "item", False), markup.clean(excerpts, "item", True)]
    return parts[0].unionByName(parts[1]).select("field", "node_id", "clean_text")


def p6_left(spark, d):
    """Per field: texts, those with HTML, wiki or LaTeX before cleaning, and those that still have some after it."""
    sections, excerpts = _marked_up(spark, d)
    families, out = ["html", "wiki", "latex"], []
    for texts, excerpt in ((sections.distinct(), False), (excerpts, True)):
        cleaned = markup.clean(texts, "item", excerpt)
        after = markup.left_over(cleaned, ["field", "node_id"], "clean_text", families).select("field", "node_id").distinct()
        before = markup.find_residue(texts, ["field", "node_id"], "item", families).select("field", "node_id").distinct()
        count = lambda df, what: df.select("field", *[F.lit(int(what == w)).alias(w) for w in ("t", "b", "a")])
        out += [count(texts, "t"), count(before, "b"), count(after, "a")]
    rows = reduce(DataFrame.unionByName, out).groupBy("field")
    return rows.agg(F.sum("t").alias("n_texts"), F.sum("b").alias("n_marked"), F.sum("a").alias("n_left"))


def p6_structure(spark, d):
    """How often each construct stands in all texts of a field before and after cleaning."""
    sections, excerpts = _marked_up(spark, d)
    out = []
    for texts, excerpt in ((sections.distinct(), False), (excerpts, True)):
        cleaned = markup.clean(texts, "item", excerpt)
        pairs = [F.struct(F.lit(k).alias("construct"), b.alias("b"), a.alias("a")) for k, (b, a) in markup.structure(cleaned, "item").items()]
        rows = cleaned.select("field", F.inline(F.array(*pairs)))
        out.append(rows.groupBy("field", "construct").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")))
    return reduce(DataFrame.unionByName, out)


def p6_blocks(spark, d):
    sections, excerpts = _marked_up(spark, d)
    texts = sections.unionByName(excerpts)
    return markup.classify(texts, "item").groupBy(own(texts, "field").alias("field"), "kind").agg(F.count("*").alias("n_blocks"))


def _scored(spark, d):
    records = existing_nodes(read(spark, d, "nodes"), ["name", "body_excerpt"])
    return distinctive.score_terms(records, "id", ["name", "body_excerpt"]).withColumnRenamed("key", "node_id")


def p7_found(spark, d):
    return _scored(spark, d).filter("tf >= 3 and df between 2 and 5").select("node_id", "term").distinct()


def p7_scores(spark, d):
    scored = _scored(spark, d)
    return scored.select("node_id", "term", "tf", "df", "cf", (F.round(F.col("score") * 1e6) / 1e6 + 0.0).alias("score"))


def _packed(spark, d, measure):
    docs = spread(read(spark, d, "documents")).select("doc_id", measure("text").alias("tokens"))
    return packing.pack(docs, "doc_id", "tokens", read(spark, d, "containers"))


def p8_found(spark, d):
    cut = _packed(spark, d, tokens.plain_tokens).filter("n_pieces > 1")
    return cut.select("container_kind", "doc_id").distinct()


def p8_assignment(spark, d):
    return _packed(spark, d, tokens.tokenizer_tokens)


def p8_fill(spark, d):
    rows = _packed(spark, d, tokens.tokenizer_tokens)
    full = rows.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    per = full.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    return per.join(F.broadcast(read(spark, d, "containers")), "container_kind").withColumn(
        "fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )


def p8_invariants(spark, d):
    """Per container kind: documents and tokens placed, containers over their capacity, documents cut without need, rests of cut documents in more than one piece."""
    kinds = F.broadcast(read(spark, d, "containers"))
    rows = _packed(spark, d, tokens.plain_tokens).join(kinds, "container_kind")
    bins = rows.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("n"))
    over = bins.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over_capacity"))
    docs = rows.groupBy("container_kind", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"))
    need = F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")), F.lit(1))
    placed = docs.groupBy("container_kind").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if(F.col("pieces") != need).alias("n_needless_cuts"))
    return placed.join(over, "container_kind")


def _mix(spark, d, measure):
    docs = spread(read(spark, d, "documents")).select("doc_id", "source", measure("text").alias("size"))
    return mixing.mix(docs, "doc_id", "size", "source", read(spark, d, "mix_targets"))


def p9_found(spark, d):
    return _mix(spark, d, tokens.plain_tokens)[1].filter("short").select("source").distinct()


def p9_selection(spark, d):
    return _mix(spark, d, tokens.tokenizer_tokens)[0]


def p9_shares(spark, d):
    return _mix(spark, d, tokens.tokenizer_tokens)[1]


def p9_reached(spark, d):
    """Per source: what it was to give, whether it fell short with every document at its limit, and whether a source that
    did not reached its target to within one document (the largest of the source)."""
    docs = spread(read(spark, d, "documents")).select("doc_id", "source", tokens.plain_tokens("text").alias("size"))
    report = mixing.mix(docs, "doc_id", "size", "source", read(spark, d, "mix_targets"))[1]
    largest = docs.groupBy(mixing.source_key(F.col("source")).alias("_s")).agg(F.max("size").alias("largest"))
    rows = report.join(largest, mixing.source_key(F.col("source")) == F.col("_s"), "left")
    gap = F.col("target_share") * F.col("total_tokens") - F.col("reached_tokens")
    full = F.col("reached_tokens") == F.col("supply_tokens") * F.col("max_repeats")
    within = F.when(F.col("short"), full).otherwise((gap >= -1e-6) & (gap < F.coalesce("largest", F.lit(0)) + 1e-6))
    return rows.select("source", "max_repeats", "supply_tokens", "short", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), within.alias("within_one_document"))


def _segments(spark, d):
    docs = spread(read(spark, d, "documents"))
    return language.segments(docs, language.fit(docs))


def p10_found(spark, d):
    return language.wrong_labels(_segments(spark, d))


def p10_segments(spark, d):
    return _segments(spark, d)


def p10_coverage(spark, d):
    """Documents in all, those with a language, and of these the ones whose segments overlap, leave the text or have a confidence outside 0 to 1."""
    docs, found = spread(read(spark, d, "documents")), _segments(spark, d)
    lines = docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.regexp_replace("text", r"(?U)[\W\d_]", "").alias("letters"))
    per = found.groupBy("doc_id").agg(
        F.sum(F.col("last_line") - F.col("first_line") + 1).alias("held"), F.max("last_line").alias("last"), F.min("first_line").alias("first"),
        F.min("confidence").alias("least"), F.max("confidence").alias("most"),
    )
    rows = lines.join(per, "doc_id", "left")
    wrong = (F.col("held") > F.col("n_lines")) | (F.col("last") > F.col("n_lines")) | (F.col("first") < 1) | (F.col("least") <= 0) | (F.col("most") > 1)
    return rows.agg(F.count("*").alias("n_documents"), F.count_if((F.col("n_lines") > 0) & (F.length("letters") == 0) & F.col("last").isNotNull()).alias("n_without_letters"),
                    F.count_if(F.coalesce(wrong, F.lit(False))).alias("n_wrong"))


def p10_languages(spark, d):
    return language.documents_languages(_segments(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_pieces, p3_restored, p6_found, p6_clean, p6_left, p6_structure, p6_blocks, p7_found, p7_scores, p8_found, p8_assignment, p8_fill, p8_invariants, p9_found, p9_selection, p9_reached,
        p9_shares, p10_found, p10_segments, p10_coverage, p10_languages,
    )
}

_SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
#: DuckDB has no class intersection: single characters are set apart by spaces first.
_COUNT = rf"""len(regexp_extract_all(regexp_replace(text, '([{_SINGLE}])', ' \1 ', 'g'), '[\pL\pN_]+|[^\pL\pN_\s\pZ]'))"""

_TERMS = r"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL),
alive AS (
  SELECT * FROM ranked WHERE rn = 1 AND coalesce(CASE WHEN json_valid(metadata)
    THEN json_extract_string(metadata, '$.deleted') END, '') <> 'true'),
words AS (
  SELECT id AS node_id, unnest(regexp_extract_all(lower(concat_ws(' ', name, body_excerpt)), '[\pL\pN]+')) AS term FROM alive),
tfs AS (SELECT node_id, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tfs GROUP BY term),
n AS (SELECT count(DISTINCT node_id)::DOUBLE AS n FROM words)
""".replace("\\", "\\")

_ITEMS = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL),
alive AS (
  SELECT * FROM ranked WHERE rn = 1 AND coalesce(CASE WHEN json_valid(metadata)
    THEN json_extract_string(metadata, '$.deleted') END, '') <> 'true'),
every_item AS (
  SELECT 'text' AS field, node_id, text AS item, {TEXT_LIMIT} AS most FROM section_chunks
  UNION ALL SELECT 'body_excerpt', id, body_excerpt, {EXCERPT_LIMIT} FROM alive),
filled AS (SELECT * FROM every_item WHERE regexp_replace(item, '[\\s\\pZ]', '', 'g') <> '')"""

#: Lines of long items one after the other: an open fence is carried until a line with its marks closes it.
_BLOCKS = f"""{_ITEMS},
over AS (SELECT DISTINCT field, node_id, item, most FROM filled WHERE strlen(item) > most),
numbered AS (SELECT row_number() OVER () AS k, * FROM over),
lines AS MATERIALIZED (SELECT k, unnest(string_split(item, chr(10))) AS line, generate_subscripts(string_split(item, chr(10)), 1) AS i FROM numbered),
fences AS (
  SELECT k, 0::BIGINT AS i, '' AS fence, false AS inside FROM numbered
  UNION ALL
  SELECT l.k, l.i, CASE WHEN f.fence = '' AND l.line[:3] IN ('```', '~~~') THEN l.line[:3] WHEN f.fence <> '' AND l.line[:3] = f.fence THEN '' ELSE f.fence END, f.fence <> ''
  FROM fences f JOIN lines l ON l.k = f.k AND l.i = f.i + 1),
kept AS (
  SELECT k, i, line, inside, regexp_replace(line, '[\\s\\pZ]', '', 'g') = '' AS blank FROM fences JOIN lines USING (k, i)),
starts AS (
  SELECT *, CASE WHEN inside OR NOT blank THEN coalesce(lag(blank AND NOT inside) OVER (PARTITION BY k ORDER BY i), true)::INTEGER ELSE 0 END AS fresh FROM kept),
blocks AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS block_no, max(i) FILTER (WHERE NOT blank) OVER (PARTITION BY k) AS last FROM starts),
sized AS (SELECT k, block_no, sum(strlen(line) + 1) - 1 AS bytes FROM blocks WHERE (inside OR NOT blank) AND i <= last GROUP BY ALL)"""

#: Code and families in DuckDB's expressions, which know no looking around: neighbours are matched instead.
_SEEN = r"""
fenceless AS (SELECT *, regexp_replace(item, '(?s)(?m:^)(?:```[^\n]*(?:\n.*?(?m:^)```[^\n]*|.*\z)|~~~[^\n]*(?:\n.*?(?m:^)~~~[^\n]*|.*\z))', ' ', 'g') AS f FROM distinct_items),
codeless AS (SELECT *, regexp_replace(regexp_replace(f, '``[^\n]+?``', ' ', 'g'), '`[^`\n]+`', ' ', 'g') AS bare FROM fenceless)"""
_DISTINCT = f"""{_ITEMS},
distinct_items AS (SELECT DISTINCT field, node_id, item FROM every_item),{_SEEN}"""
_HTML = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--|<!DOCTYPE|<\?xml|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_WIKI = (
    r"''[^'\s](?:'?[^'\n])*''|\{\{[^{}]+\}\}|\[\[[^\[\]\n]+\]\]|\[(?:https?|ftp)://[^\s\]]+(?: [^\]\n]*)?\](?:[^(]|\z)|^[ \t]*\{\|"
    + "".join(rf"|^[ \t]*={{{n}}}[ \t]*[^=\s](?:[^\n]*[^=\s])?[ \t]*={{{n}}}[ \t]*$" for n in range(1, 7))
)
_LATEX = (
    r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?:^|[\s({$~])\\[A-Za-z]+(?:[^\\A-Za-z]|\z)|(?s:\\\([^)].*?\\\)|\\\[[^\]].*?\\\])|\$\$[^$]+\$\$"
    r"|(?:^|[^\\$\pL\pN_])\$(?:[^\s$\\]|[^\s$][^$\n]*[^\s$\\])\$(?:[^\d$]|\z)"
)
_MARKDOWN = (
    r"^[ ]{0,3}#{1,6}[ \t]+\S|^[^\n]*\S[^\n]*\n[ ]{0,3}(?:={2,}|-{3,})[ \t]*$|\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|(?:^|[^\pL\pN_*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?:[^\pL\pN_*]|\z)"
    r"|(?:^|[^\pL\pN_])_[^\s_](?:[^\n]*[^\s_])?_(?:[^\pL\pN_]|\z)|(?:^|[^\pL\pN_])__[^\s_](?:[^\n]*[^\s_])?__(?:[^\pL\pN_]|\z)"
    r"|!?\[[^\[\]\n]*\]\([^()\s][^()\n]*\)|`[^`\n]+`|^(?:```|~~~)|^[ ]{0,3}>[ \t]*\S|^[ \t]*[-*+][ \t]+\S|^[ \t]*\d{1,9}[.)][ \t]+\S"
    r"|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|~~\S[^~\n]*~~|\[\^[^\]\s]+\]"
)
_has = lambda pattern, c: f"regexp_matches({c}, '(?m){pattern.replace(chr(39), chr(39) * 2)}')"
_FAMILY_ROWS = " UNION ALL ".join(
    f"SELECT field, node_id, '{name}' AS family FROM codeless WHERE {_has(pattern, c)}{extra}"
    for name, pattern, c, extra in (("html", _HTML, "bare", ""), ("wiki", _WIKI, "bare", ""), ("latex", _LATEX, "bare", ""), ("markdown", _MARKDOWN, "item", " AND field = 'body_excerpt'"))
)
_count = lambda pattern, c: f"sum(len(regexp_extract_all({c}, '(?m){pattern.replace(chr(39), chr(39) * 2)}')))::BIGINT"
_CONSTRUCTS = {
    "heading": (r"^[ ]{0,3}#{1,6}[ \t]+\S|<[hH][1-6](?:\s[^<>]*)?>|\\(?:chapter|(?:sub){0,2}section)\*?\{|^[^\n]*\S[^\n]*\n[ ]{0,3}(?:={2,}|-{3,})[ \t]*$" + _WIKI[_WIKI.index("|^[ \\t]*={1}") :], "bare"),
    "code": (r"<pre(?:\s[^<>]*)?>", "f"),
    "formula": (r"\$\$[^$]+\$\$|(?s:\\\([^)].*?\\\)|\\\[[^\]].*?\\\])|\\begin\{(?:equation|align)\*?\}" + _LATEX[_LATEX.index(r"|(?:^|[^\\$\pL") :], "bare"),
    "list": (r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S|<li(?:\s[^<>]*)?>|\\item(?:[^A-Za-z]|\z)", "bare"),
}
_STRUCTURE_ROWS = " UNION ALL ".join(
    f"SELECT field, '{k}' AS construct, {_count(pattern, c)}{extra} AS n FROM codeless GROUP BY field"
    for k, (pattern, c) in _CONSTRUCTS.items()
    for extra in [" + sum((len(item) - len(replace(item, chr(10) || '```', chr(10) || '``')) + (item LIKE '```%')::INTEGER + len(item) - len(replace(item, chr(10) || '~~~', chr(10) || '~~')) + (item LIKE '~~~%')::INTEGER + 1) // 2)::BIGINT" if k == "code" else ""]
)

ORACLE: dict[str, str] = {
    "p6_found": f"WITH {_DISTINCT} SELECT DISTINCT * FROM ({_FAMILY_ROWS})",
    "p6_left": f"""WITH {_DISTINCT}, marked AS (SELECT DISTINCT field, node_id FROM ({_FAMILY_ROWS}) WHERE family <> 'markdown')
SELECT field, count(*) AS n_texts, (SELECT count(*) FROM marked m WHERE m.field = t.field) AS n_marked, 0::BIGINT AS n_left FROM distinct_items t GROUP BY field""",
    "p6_structure": f"WITH {_DISTINCT} SELECT field, construct, n AS n_before, n AS n_after FROM ({_STRUCTURE_ROWS})",
    "p3_found": f"""WITH RECURSIVE {_BLOCKS}
SELECT field, node_id, 0::INTEGER AS block_no FROM over
UNION SELECT field, node_id, block_no::INTEGER FROM numbered JOIN sized USING (k) WHERE bytes > most""",
    "p3_restored": f"""WITH {_ITEMS} SELECT field, count(*) AS n_items, count(*) FILTER (WHERE strlen(item) > most) AS n_cut,
  sum(strlen(item))::BIGINT AS n_bytes, 0::BIGINT AS n_not_restored, 0::BIGINT AS n_over_limit FROM filled GROUP BY field""",
    "p7_found": f"WITH {_TERMS} SELECT node_id, term FROM tfs JOIN dfs USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5",
    "p7_scores": f"""WITH {_TERMS}
SELECT node_id, term, tf::INTEGER AS tf, df, cf,
       round(tf * (-log2(df / n) + log2(1 - exp(-cf / n))) * 1e6) / 1e6 + 0.0 AS score
FROM tfs JOIN dfs USING (term) CROSS JOIN n""",
    "p8_invariants": f"""WITH sized AS (SELECT doc_id, {_COUNT} AS n FROM documents)
SELECT container_kind, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens, 0::BIGINT AS n_needless_cuts, 0::BIGINT AS n_over_capacity FROM sized CROSS JOIN containers GROUP BY container_kind""",
    "p9_reached": f"""WITH sized AS (SELECT lower(trim(source)) AS s, {_COUNT} AS n FROM documents),
sums AS (SELECT s, sum(n) AS n FROM sized GROUP BY s), total AS (SELECT sum(n) AS n FROM sums)
SELECT m.source, m.max_repeats, coalesce(sums.n, 0)::BIGINT AS supply_tokens, coalesce(sums.n, 0) * m.max_repeats < m.target_share * total.n AS short, true AS within_repeats, true AS within_one_document
FROM mix_targets m CROSS JOIN total LEFT JOIN sums ON sums.s = lower(trim(m.source))""",
    "p10_coverage": "SELECT count(*) AS n_documents, 0::BIGINT AS n_without_letters, 0::BIGINT AS n_wrong FROM documents",
    "p8_found": f"SELECT container_kind, doc_id FROM documents JOIN containers ON {_COUNT} > capacity_tokens",
    "p9_found": f"""WITH sized AS (SELECT lower(trim(source)) AS s, {_COUNT} AS n FROM documents),
sums AS (SELECT s, sum(n) AS n FROM sized GROUP BY s), total AS (SELECT sum(n) AS n FROM sums)
SELECT m.source FROM mix_targets m CROSS JOIN total LEFT JOIN sums ON sums.s = lower(trim(m.source))
WHERE coalesce(sums.n, 0) * m.max_repeats < m.target_share * total.n""",
}
