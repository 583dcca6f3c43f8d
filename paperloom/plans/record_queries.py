"""Queries of the record, lookup, detail and evidence operators with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import audit, context, details, listing, metadata, records, search, traverse
from paperloom.plans.graph_queries import _CURRENT, _DOC_EDGES, _ISSUE, _RANKED, _REQUEST, _SEC_BM, _TERMS, ALIVE, AS_OF
from paperloom.tables import Graph

QUERIES, ORACLE = {}, {}
LATER, MARKED = "2026-03-01", ["research", "decisions"]


def query(sql: str | None = None, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ALIVE}{sql}"
        return f

    return register


_ASKED = """, asked AS (SELECT DISTINCT asked FROM (SELECT reference_text AS asked FROM unresolved_refs WHERE reference_text IS NOT NULL UNION ALL SELECT upper(name) FROM docs UNION ALL SELECT file_path FROM docs UNION ALL SELECT qualified_name FROM alive WHERE kind = 'heading') WHERE asked IS NOT NULL),
exact AS (SELECT a.asked, n.kind <> 'document' AS later, n.id FROM asked a JOIN alive n ON n.id = a.asked UNION SELECT a.asked, n.kind <> 'document', n.id FROM asked a JOIN alive n ON n.qualified_name = a.asked
  UNION SELECT a.asked, n.kind <> 'document', n.id FROM asked a JOIN alive n ON n.file_path = a.asked WHERE n.kind IN ('document', 'code_file')),
first AS (SELECT asked, id FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY later, id) AS k FROM exact) WHERE k = 1),
second AS (SELECT asked, min(id) AS id FROM asked JOIN docs ON lower(docs.name) = lower(trim(asked)) GROUP BY asked)"""


def _asked(g):
    docs = g.documents("name")
    parts = g.table("unresolved_refs").select(F.col("reference_text").alias("asked")).union(docs.select(F.upper("name"))).union(docs.select("file_path"))
    return parts.union(g.nodes("kind", "qualified_name").filter("kind = 'heading'").select("qualified_name")).dropna().distinct()


@query(f"{_ASKED} SELECT asked, coalesce(f.id, s.id) AS id FROM asked LEFT JOIN first f USING (asked) LEFT JOIN second s USING (asked)")
def node_resolution(g):
    return details.resolve_names(g, _asked(g))


@query(""", h AS (SELECT DISTINCT e.source AS parent, n.id, n.name, n.level, n.start_line FROM edges e JOIN alive n ON n.id = e.target AND n.kind = 'heading' WHERE e.kind = 'contains' AND e.source IN (SELECT id FROM docs))
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY start_line NULLS FIRST, id)::INTEGER AS place FROM h""")
def child_headings(g):
    return details.child_headings(g, g.documents().select("id"))


@query(""" SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, id)::INTEGER AS place FROM alive WHERE file_path IN (SELECT file_path FROM docs)""")
def nodes_of_files(g):
    return details.nodes_of_files(g, g.documents().select("file_path")).select("id", "file_path", "place")


_ENDS = """, inc AS (SELECT t.file_path AS document, count(*) AS n_incoming FROM refs e JOIN alive t ON t.id = e.target GROUP BY 1),
outg AS (SELECT s.file_path AS document, count(*) AS n_outgoing FROM edges e JOIN alive s ON s.id = e.source WHERE e.kind IN ('references', 'wikilinks_to', 'related_to', 'embeds', 'links_external') GROUP BY 1)"""


@query(f"""{_ISSUE}{_ENDS}, hd AS (SELECT file_path AS document, count(*) AS n FROM alive WHERE kind = 'heading' GROUP BY 1)
SELECT d.id AS asked, d.file_path AS document, coalesce(hd.n, 0) AS n_headings, coalesce(n_incoming, 0) AS n_incoming, coalesce(n_outgoing, 0) AS n_outgoing, l.score, l.issues, commit_count, g.status, q.confidence
FROM docs d LEFT JOIN hd ON hd.document = d.file_path LEFT JOIN inc ON inc.document = d.file_path LEFT JOIN outg ON outg.document = d.file_path
LEFT JOIN levelled l ON l.node_id = d.file_path LEFT JOIN hist ON hist.path = d.file_path LEFT JOIN gov g ON g.node_id = d.file_path LEFT JOIN res q ON q.node_id = d.file_path""")
def node_details(g):
    rows = details.node_details(g, g.documents().select(F.col("id").alias("asked")), AS_OF)
    return rows.select("asked", "document", "n_headings", "n_incoming", "n_outgoing", "score", "issues", "commit_count", "governance.status", "research.confidence")


@query(f"""{_RANKED}{_ISSUE}{_ENDS}{_DOC_EDGES}, t AS (SELECT DISTINCT file_path AS document FROM top),
reach AS (SELECT document, document AS at_doc, 0 AS level FROM t UNION SELECT r.document, de.src, r.level + 1 FROM reach r JOIN de ON de.tgt = r.at_doc WHERE r.level < 2),
near AS (SELECT document, at_doc, min(level) AS level FROM reach GROUP BY ALL)
SELECT top.place, top.id, top.file_path AS document, coalesce(n_incoming, 0) AS n_incoming, coalesce(n_outgoing, 0) AS n_outgoing, l.score,
  (SELECT count(*) FROM near WHERE near.document = top.file_path AND level = 1) AS impact_1, (SELECT count(*) FROM near WHERE near.document = top.file_path AND level = 2) AS impact_2
FROM top LEFT JOIN inc ON inc.document = top.file_path LEFT JOIN outg ON outg.document = top.file_path LEFT JOIN levelled l ON l.node_id = top.file_path""", recursive=True)
def evidence_pack(g):
    pack = details.evidence_pack(g, search.search(g, _REQUEST, []), AS_OF)
    return pack.select("place", "id", "document", "n_incoming", "n_outgoing", "score", "impact_1", "impact_2")


@query(""", c AS (SELECT node_id, upper(hex(encode(coalesce(text, '')))) AS h FROM secs),
k AS (SELECT *, CASE WHEN length(h) <= 4000 THEN length(h) ELSE list_filter([4000, 3998, 3996, 3994], lambda n: h[n + 1:n + 2] NOT BETWEEN '80' AND 'BF')[1] END AS n FROM c)
SELECT node_id, decode(unhex(h[1:n])) AS content FROM k""")
def context_content(g):
    return search.sections(g).select("node_id", context.cut_bytes("text", context.CONTENT_BYTES).alias("content"))


@query(f""", {_SEC_BM}, b AS (SELECT sb.id AS node_id, split_part(secs.file_path, '/', 1) AS project, round(sb.rank, 6) + 0.0 AS rank FROM sb JOIN secs ON secs.node_id = sb.id),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY rank, node_id) AS n FROM b) SELECT node_id, project, rank FROM k WHERE n <= 40 ORDER BY rank, node_id LIMIT 20""")
def workspace_search(g):
    ranked = search.bm25(search.sections(g).withColumn("project", F.substring_index("file_path", "/", 1)).select("node_id", "project", *search.SECTION_WEIGHTS), search.SECTION_WEIGHTS, _TERMS)
    rows = ranked.withColumn("rank", F.round("rank", 6) + 0.0)
    return search.fan_out(rows, F.col("project"), 20, [F.col("rank"), F.col("node_id")]).select("node_id", "project", "rank")


@query(""", made AS (SELECT v.vec_id AS id, CASE WHEN v.vec_id % 10 = 0 THEN 'other' ELSE sha256(d.text) END AS digest FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id)
SELECT doc_id AS id, made.id IS NOT NULL AS stale FROM documents LEFT JOIN made ON made.id = doc_id WHERE made.id IS NULL OR made.digest <> sha256(text)""")
def pending_embeddings_by_digest(g):
    docs = g.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    made = g.table("embeddings").select(F.col("vec_id").alias("id")).join(docs, "id").withColumn("digest", F.when(F.col("id") % 10 == 0, "other").otherwise(F.col("digest")))
    return listing.pending_embeddings(docs, made)


@query(""", v AS (SELECT vec_id AS id, label AS model, CASE WHEN vec_id % 10 = 0 THEN 'other' ELSE sha256(text) END AS digest FROM embeddings JOIN documents ON doc_id = vec_id)
SELECT model, count(*) AS n_vectors, count(*) FILTER (WHERE digest = 'other') AS n_stale, (SELECT count(*) FROM documents) - count(DISTINCT id) AS n_missing FROM v GROUP BY model""")
def vector_stats(g):
    docs = g.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    made = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("model")).join(docs, "id")
    return records.stale_vectors(docs, made.withColumn("digest", F.when(F.col("id") % 10 == 0, "other").otherwise(F.col("digest"))))


_DRAFTS = f"""{_CURRENT}, cur AS (SELECT path AS node_id, lower(regexp_replace(content_hash, '(?i)^sha256:', '')) AS now_hash FROM current WHERE content_hash IS NOT NULL),
drafts AS (SELECT DISTINCT node_id, updated_at::VARCHAR AS run_id, CASE WHEN updated_at % 3 = 0 THEN 'old' ELSE now_hash END AS content_hash, coalesce(owner, '') AS summary, status, updated_at FROM governance_metadata LEFT JOIN cur USING (node_id)),
judged AS (SELECT *, CASE WHEN coalesce(trim(node_id), '') = '' THEN 'no node' WHEN now_hash IS NULL THEN 'unknown node' WHEN content_hash IS DISTINCT FROM now_hash THEN 'stale text' WHEN trim(summary) = '' AND status IS NULL THEN 'nothing to write' ELSE 'written' END AS reason
  FROM drafts LEFT JOIN cur USING (node_id))"""


def _drafts(g):
    current = listing.current_files(g).select(F.col("path").alias("node_id"), F.lower(F.regexp_replace("content_hash", "(?i)^sha256:", "")).alias("content_hash")).dropna()
    none = F.create_map().cast("map<string,string>")
    rows = g.table("governance_metadata").join(current, "node_id", "left").select(
        "node_id", F.col("updated_at").cast("string").alias("run_id"), F.when(F.col("updated_at") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"),
        F.coalesce("owner", F.lit("")).alias("summary"), F.when(F.col("status").isNotNull(), F.create_map(F.lit("status"), "status")).otherwise(none).alias("fields"),
        F.lit("m").alias("model"), F.lit("a").alias("agent"), F.col("updated_at").alias("created_at"),
    )
    return rows, current


@query(f"{_DRAFTS} SELECT reason, count(DISTINCT (node_id, run_id)) AS n FROM judged GROUP BY reason")
def enrichment_writes(g):
    drafts, current = _drafts(g)
    ledger, refused = records.write_enrichment(drafts.limit(0), drafts, current)
    done = ledger.select(F.lit("written").alias("reason"), "node_id", "run_id").unionByName(refused.select("reason", "node_id", "run_id"))
    return done.distinct().groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""{_DRAFTS}, last AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC, run_id DESC) AS k FROM judged WHERE reason = 'written')
SELECT node_id, run_id, summary, false AS stale FROM last WHERE k = 1""")
def enrichment_summaries(g):
    drafts, current = _drafts(g)
    ledger, _ = records.write_enrichment(drafts.limit(0), drafts, current)
    return records.summaries(ledger, current).select("node_id", "run_id", "summary", "stale")


@query(f" SELECT source, target, kind, line FROM edges WHERE kind IN ('references', 'wikilinks_to', 'related_to', 'embeds', 'links_external') AND source IN (SELECT id FROM alive WHERE file_path = (SELECT file_path FROM edges e JOIN alive a ON a.id = e.source WHERE e.kind = 'references' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
def edges_outgoing_of_busiest(g):
    busy = g.edges.filter("kind = 'references'").join(g.nodes("file_path").withColumnRenamed("id", "source"), "source").groupBy("file_path").count()
    return traverse.outgoing(g, busy.orderBy(F.col("count").desc(), "file_path").first()["file_path"])


@query(f""" SELECT 'doc.stale_by_git' AS code, n.id AS node_id, n.file_path, '' AS related_node_id, '' AS related_path, 'info' AS severity, 'last_commit_at=' || last_commit_at || ', commits=' || commit_count AS evidence
FROM docs n JOIN hist h ON h.path = n.id WHERE last_commit_at <> 0 AND last_commit_at < epoch(DATE '{LATER}' - 365)""")
def audit_stale_by_git_later(g):
    return audit.stale_by_git(g, LATER)


@query(""" SELECT 'code.undocumented_export' AS code, n.id AS node_id, n.file_path, '' AS related_node_id, '' AS related_path, 'info' AS severity, 'file=' || n.file_path AS evidence
FROM alive n WHERE kind = 'definition' AND NOT EXISTS (SELECT 1 FROM cites c JOIN alive s ON s.id = c.source WHERE c.target = n.id AND s.kind <> 'definition')""")
def audit_undocumented_definitions(g):
    return audit.undocumented_export(g, "definition")


@query(f" SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, count(DISTINCT path) AS n_files FROM files WHERE regexp_matches(lower(path), '{'|'.join(MARKED)}') GROUP BY 1")
def marked_folders(g):
    return listing.sensitive_folders(g, MARKED)


@query(r""", m AS (SELECT node_id, trim(unnest(regexp_extract_all(text, '\[\[([^\[\]|#\n]+)[^\[\]\n]*\]\]', 1))) AS name FROM secs),
x AS (SELECT node_id, name, regexp_replace(lower(name), '\s', ' ', 'g') AS norm FROM m WHERE name <> ''),
t AS (SELECT DISTINCT lower(coalesce(d.name, '')) AS norm FROM alive d WHERE d.kind = 'tag' AND trim(d.name) <> '')
SELECT CASE WHEN t.norm IS NULL THEN 'concept' ELSE 'tag' END AS entity_type, count(DISTINCT x.norm) AS n_entities, count(*) AS n_mentions FROM x LEFT JOIN t USING (norm) GROUP BY 1""")
def entity_type_stats(g):
    """Wikilink mentions under the type a tag of that name gives them; the tags' own rows are not counted."""
    tags = g.nodes("kind", "name").filter("kind = 'tag' and trim(name) <> ''").select(F.lit(None).cast("string").alias("node_id"), "name", F.lit("tag").alias("entity_type"), F.lit(None).cast("string").alias("alias"))
    found = metadata.mentions(search.sections(g))
    said = found.select("node_id", "name", F.lit("concept").alias("entity_type"), F.lit(None).cast("string").alias("alias"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k")).drop("_k")
    every = metadata.mentions_of_entities(said.unionByName(tags)).filter("node_id is not null")
    return every.groupBy("entity_type").agg(F.countDistinct("norm").alias("n_entities"), F.count("*").alias("n_mentions"))
