"""Queries of the document-graph operators with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import audit, context, incremental, listing, metadata, quality, resolve, search, similarity, traverse
from paperloom.session import stored
from paperloom.tables import GOVERNANCE, RESEARCH, Graph

AS_OF, HUB, QUERY, TAG = "2025-07-15", "handbook/index.md", "retention policy", "security"
SIMILAR, RATES = 0.25, [("small", 0.02), ("large", 0.13)]
QUERIES, ORACLE = {}, {}

ALIVE = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL),
alive AS (SELECT * FROM ranked WHERE rn = 1 AND coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.deleted') END, '') <> 'true'),
docs AS (SELECT * FROM alive WHERE kind = 'document'),
gov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) AS gn FROM governance_metadata) WHERE gn = 1),
res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) AS gn FROM research_metadata) WHERE gn = 1),
versions AS (SELECT *, CASE WHEN indexed_at >= 100000000000 THEN indexed_at // 1000 ELSE indexed_at END AS seen_at FROM files),
hist AS (SELECT path, count(*) AS commit_count, min(seen_at) AS first_commit_at, max(seen_at) AS last_commit_at FROM versions GROUP BY path),
secs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY text DESC NULLS LAST, heading_path) AS sn FROM section_chunks) WHERE sn = 1),
cites AS (SELECT DISTINCT source, target FROM edges WHERE kind IN ('references', 'wikilinks_to', 'related_to')),
refs AS (SELECT * FROM edges WHERE kind IN ('references', 'wikilinks_to', 'related_to', 'embeds'))"""


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function (graph) -> DataFrame under its name, with its SQL after the common views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ALIVE}{sql}"
        return f

    return register


def _finding(code: str, severity: str, evidence: str, related: str = "'' AS related_node_id, '' AS related_path", node: str = "n.id", path: str = "n.file_path") -> str:
    return f"SELECT '{code}' AS code, {node} AS node_id, {path} AS file_path, {related}, '{severity}' AS severity, {evidence} AS evidence"


_REL = "r.id AS related_node_id, r.file_path AS related_path"
_PAIR = f"""pairs AS (SELECT DISTINCT source, target, json_extract_string(metadata, '$.score')::DOUBLE AS score FROM edges
  WHERE kind = 'similar_to' AND source < target AND json_extract_string(metadata, '$.score')::DOUBLE >= {audit.SIMILARITY}),
similar_approved AS (SELECT p.*, a.canonical_source AS ca, b.canonical_source AS cb FROM pairs p
  JOIN gov a ON a.node_id = source AND a.status = 'approved' JOIN gov b ON b.node_id = target AND b.status = 'approved'
  WHERE source IN (SELECT id FROM alive) AND target IN (SELECT id FROM alive))"""
_SUPERSEDED = """(SELECT DISTINCT n.id, n.file_path, g.superseded_by, c.source FROM gov g JOIN alive n ON n.id = g.node_id
  JOIN alive t ON t.file_path = n.file_path JOIN cites c ON c.target = t.id WHERE g.superseded_by <> '' {extra}
  AND NOT EXISTS (SELECT 1 FROM gov x WHERE x.node_id = c.source AND x.status IN ('archived', 'superseded'))) n LEFT JOIN alive r ON r.id = n.source"""
_SUP_REL = "n.source AS related_node_id, coalesce(r.file_path, n.source) AS related_path"
FINDINGS = {
    "audit_stale_review": _finding("policy.stale_review", "warning", "'owner=' || coalesce(g.owner, '') || ', review_due=' || g.review_due")
    + f" FROM gov g JOIN alive n ON n.id = g.node_id WHERE review_due <> '' AND review_due < '{AS_OF}' AND status NOT IN ('archived', 'superseded', 'non-binding')",
    "audit_superseded_referenced": _finding("policy.superseded_referenced", "warning", "'superseded_by=' || n.superseded_by", _SUP_REL) + " FROM " + _SUPERSEDED.format(extra=""),
    "audit_duplicate": _finding("policy.duplicate", "warning", "printf('similar_to score=%.2f', s.score)", _REL)
    + " FROM similar_approved s JOIN alive n ON n.id = s.source JOIN alive r ON r.id = s.target",
    "audit_non_canonical": _finding("policy.non_canonical", "warning", "'canonical_source=' || g.canonical_source")
    + """ FROM gov g JOIN alive n ON n.id = g.node_id WHERE canonical_source <> '' AND (status IS NULL OR status NOT IN ('archived', 'superseded'))
  AND canonical_source IN (SELECT canonical_source FROM gov WHERE status IS NULL OR status NOT IN ('archived', 'superseded') GROUP BY 1 HAVING count(*) > 1)""",
    "audit_conflicting": _finding("policy.conflicting", "error", "printf('similarity=%.2f', s.score)", _REL)
    + " FROM similar_approved s JOIN alive n ON n.id = s.source JOIN alive r ON r.id = s.target UNION ALL "
    + _finding("policy.conflicting", "error", "'canonical_source: ' || ca || ' vs ' || cb", _REL)
    + " FROM similar_approved s JOIN alive n ON n.id = s.source JOIN alive r ON r.id = s.target WHERE ca <> '' AND cb <> '' AND ca <> cb UNION ALL "
    + _finding("policy.conflicting", "error", "'supersedes=' || g.supersedes || ', status=' || g.status")
    + """ FROM gov g JOIN alive n ON n.id = g.node_id WHERE supersedes <> '' AND status NOT IN ('archived', 'superseded')
  AND supersedes IN (SELECT supersedes FROM gov WHERE status NOT IN ('archived', 'superseded') GROUP BY 1 HAVING count(*) > 1)""",
    "audit_stale_assessment": _finding("research.stale_assessment", "warning", "'valid_until=' || q.valid_until")
    + f" FROM res q JOIN alive n ON n.id = q.node_id WHERE valid_until <> '' AND valid_until < '{AS_OF}'",
    "audit_unverified_evidence": _finding("research.unverified_evidence", "info", "'last_verified=' || q.last_verified")
    + f" FROM res q JOIN alive n ON n.id = q.node_id WHERE last_verified <> '' AND last_verified < strftime(DATE '{AS_OF}' - 180, '%Y-%m-%d')",
    "audit_competing_interpretations": _finding("research.competing_interpretations", "warning", "'claim_id=' || claim_id || ', confidences=' || c || ', statuses=' || s")
    + """ FROM (SELECT claim_id, min(n.id) AS id, min(n.file_path) AS file_path, coalesce(array_to_string(list_sort(list(DISTINCT confidence) FILTER (WHERE confidence IS NOT NULL)), ','), '') AS c,
    coalesce(array_to_string(list_sort(list(DISTINCT analyst_status) FILTER (WHERE analyst_status IS NOT NULL)), ','), '') AS s
  FROM res q JOIN alive n ON n.id = q.node_id WHERE claim_id <> '' GROUP BY claim_id HAVING count(DISTINCT confidence) > 1 OR count(DISTINCT analyst_status) > 1) n""",
    "audit_superseded_claim": _finding("research.superseded_claim", "warning", "'superseded_by=' || n.superseded_by", _SUP_REL)
    + " FROM " + _SUPERSEDED.format(extra="AND n.id IN (SELECT node_id FROM res)"),
    "audit_impacted_deliverable": "SELECT DISTINCT * FROM (" + _finding("research.impacted_deliverable", "info", "'deliverable_id=' || a.deliverable_id || ', stale_path=' || r.file_path", _REL)
    + f""" FROM res a JOIN alive n ON n.id = a.node_id JOIN (SELECT source AS x, target AS y FROM cites UNION SELECT target, source FROM cites) e ON e.x = a.node_id AND e.x <> e.y
  JOIN res b ON b.node_id = e.y JOIN alive r ON r.id = e.y WHERE a.deliverable_id <> '' AND b.valid_until <> '' AND b.valid_until < '{AS_OF}')""",
    "audit_missing_symbol": _finding("code.missing_symbol", "warning", "'reference=' || reference_text || ', kind=' || coalesce(reference_kind, '')", node="from_node_id", path="file_path")
    + r" FROM unresolved_refs WHERE regexp_matches(reference_text, '(?i)\.(go|py|js|ts|rs|c|cpp|java|rb|kt|cs|swift|tsx|jsx)$')",
    "audit_undocumented_export": _finding("code.undocumented_export", "info", "'file=' || n.file_path")
    + " FROM alive n WHERE kind = 'code_file' AND NOT EXISTS (SELECT 1 FROM cites c JOIN alive s ON s.id = c.source WHERE c.target = n.id AND s.kind <> 'code_file')",
    "audit_unanchored_feature": _finding("code.unanchored_feature", "info", "'status=' || g.status")
    + """ FROM gov g JOIN docs n ON n.id = g.node_id WHERE status IN ('approved', 'review')
  AND NOT EXISTS (SELECT 1 FROM cites c JOIN alive t ON t.id = c.target WHERE c.source = n.id AND t.kind = 'code_file')""",
    "audit_stale_by_git": _finding("doc.stale_by_git", "info", "'last_commit_at=' || last_commit_at || ', commits=' || commit_count")
    + f" FROM docs n JOIN hist h ON h.path = n.id WHERE last_commit_at <> 0 AND last_commit_at < epoch(DATE '{AS_OF}' - 365)",
}
FINDERS = {
    "audit_stale_review": lambda g: audit.stale_review(g, AS_OF), "audit_superseded_referenced": audit.superseded_referenced, "audit_duplicate": audit.duplicate,
    "audit_non_canonical": audit.non_canonical, "audit_conflicting": audit.conflicting, "audit_stale_assessment": lambda g: audit.stale_assessment(g, AS_OF),
    "audit_unverified_evidence": lambda g: audit.unverified_evidence(g, AS_OF), "audit_competing_interpretations": audit.competing_interpretations,
    "audit_superseded_claim": audit.superseded_claim, "audit_impacted_deliverable": lambda g: audit.impacted_deliverable(g, AS_OF), "audit_missing_symbol": audit.missing_symbol,
    "audit_undocumented_export": audit.undocumented_export, "audit_unanchored_feature": audit.unanchored_feature, "audit_stale_by_git": lambda g: audit.stale_by_git(g, AS_OF),
}
for _name, _f in FINDERS.items():
    QUERIES[_name] = lambda spark, folder, f=_f: f(Graph(spark, folder))
    ORACLE[_name] = f"WITH {ALIVE}, {_PAIR} {FINDINGS[_name]}"
_ALL = " UNION ALL ".join(f"SELECT {i} AS finder, * FROM ({FINDINGS[n]})" for i, n in enumerate(FINDERS))


@query(f""", {_PAIR}, found AS ({_ALL})
SELECT * EXCLUDE (finder) FROM found ORDER BY finder, node_id, related_node_id, evidence LIMIT 100""")
def audit_top_findings(g):
    return audit.top_findings(g, AS_OF, 100)


@query(f""", {_PAIR}, found AS ({_ALL})
SELECT code, severity, count(*) AS n_findings, count(DISTINCT node_id) AS n_nodes FROM found GROUP BY ALL""")
def audit_summary(g):
    return audit.summary(audit.all_findings(g, AS_OF))


_SIGNAL = "lower(trim(coalesce({}, '')))"
_ISSUE = f""",
n_in AS (SELECT t.file_path, count(*) AS n FROM refs e JOIN alive t ON t.id = e.target GROUP BY 1),
n_out AS (SELECT s.file_path, count(*) AS n FROM edges e JOIN alive s ON s.id = e.source
          WHERE e.kind IN ('references', 'wikilinks_to', 'related_to', 'embeds', 'links_external') GROUP BY 1),
facts AS (SELECT d.id AS node_id, d.file_path, g.status, g.owner, g.review_due, g.superseded_by, g.canonical_source, q.evidence, q.valid_until, q.last_verified,
    concat({', '.join(f'q.{c}' for c in RESEARCH)}) <> '' AS researched, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out,
    NOT regexp_matches(lower(d.file_path), '\\.(pdf|docx)$') AS plain
  FROM docs d LEFT JOIN gov g ON g.node_id = d.id LEFT JOIN res q ON q.node_id = d.id LEFT JOIN n_in i USING (file_path) LEFT JOIN n_out o USING (file_path)),
issues AS (
  SELECT node_id, 'missing_status' AS code, 12 AS penalty, 1 AS r FROM facts WHERE plain AND coalesce(trim(status), '') = ''
  UNION ALL SELECT node_id, 'missing_owner', 10, 1 FROM facts WHERE plain AND coalesce(trim(owner), '') = ''
  UNION ALL SELECT node_id, 'missing_review_due', 8, 1 FROM facts WHERE plain AND coalesce(trim(review_due), '') = ''
  UNION ALL SELECT node_id, 'stale_review_due', 16, 0 FROM facts WHERE plain AND try_cast(CASE WHEN regexp_matches(trim(review_due)[1:10], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN trim(review_due)[1:10] END AS DATE) < DATE '{AS_OF}'
  UNION ALL SELECT node_id, 'non_canonical', 18, 0 FROM facts WHERE {_SIGNAL.format('canonical_source')} IN ('false', 'no', 'duplicate', 'non_canonical', 'non-canonical', 'noncanonical')
      OR {_SIGNAL.format('status')} IN ('archived', 'deprecated', 'retired', 'superseded') OR coalesce(trim(superseded_by), '') <> ''
  UNION ALL SELECT node_id, 'missing_evidence', 14, 0 FROM facts WHERE researched AND coalesce(trim(evidence), '') = ''
  UNION ALL SELECT node_id, 'stale_research_validity', 16, 0 FROM facts WHERE researched AND try_cast(CASE WHEN regexp_matches(trim(valid_until)[1:10], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN trim(valid_until)[1:10] END AS DATE) < DATE '{AS_OF}'
  UNION ALL SELECT node_id, 'stale_last_verified', 6, 1 FROM facts WHERE researched AND try_cast(CASE WHEN regexp_matches(trim(last_verified)[1:10], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN trim(last_verified)[1:10] END AS DATE) < DATE '{AS_OF}' - INTERVAL 12 MONTH
  UNION ALL SELECT node_id, 'weak_citations', 12, 1 FROM facts WHERE researched AND n_out = 0
      AND len(list_filter(regexp_split_to_array(regexp_replace(coalesce(evidence, ''), '[\\[\\]"'',;\\n]', ' ', 'g'), '\\s+'), lambda x: x <> '')) < 2
  UNION ALL SELECT node_id, 'isolated_document', 10, 1 FROM facts WHERE n_in = 0 AND n_out = 0),
scored AS (
  SELECT f.node_id, f.file_path, greatest(100 - coalesce(sum(penalty), 0), 0)::INTEGER AS score,
         coalesce(string_agg(code, ',' ORDER BY r, penalty DESC, code), '') AS issues
  FROM facts f LEFT JOIN issues USING (node_id) GROUP BY ALL),
levelled AS (SELECT *, CASE WHEN score >= 85 THEN 'good' WHEN score >= 65 THEN 'warning' ELSE 'poor' END AS level FROM scored)"""


@query(f"{_ISSUE} SELECT node_id, file_path, score, level, issues FROM levelled")
def quality_scores(g):
    return quality.scores(g, AS_OF)


@query(f"{_ISSUE} SELECT level, count(*) AS n_documents, avg(score) AS avg_score FROM levelled GROUP BY level")
def quality_stats(g):
    return quality.stats(quality.scores(g, AS_OF))


@query(f"{_ISSUE} SELECT code, count(*) AS n_documents FROM issues GROUP BY code")
def quality_issue_histogram(g):
    return quality.histogram(quality.issues(g, AS_OF))


_CURRENT = """, current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC NULLS LAST, content_hash DESC NULLS LAST, size DESC NULLS LAST) AS k FROM versions) WHERE k = 1)"""


@query(f"{_CURRENT} SELECT path, size, seen_at AS indexed_at FROM current WHERE path LIKE 'handbook/%'")
def files_by_prefix(g):
    return listing.files_by_prefix(g, "handbook/")


@query(" SELECT split_part(path, '/', 1) AS folder, count(DISTINCT path) AS n_files FROM files GROUP BY 1")
def top_folders(g):
    return listing.top_folders(g)


@query(" SELECT lower(t.name) AS tag, count(DISTINCT e.source) AS n_documents FROM edges e JOIN alive t ON t.id = e.target AND t.kind = 'tag' WHERE e.kind = 'tagged' GROUP BY 1")
def tag_counts(g):
    return listing.tag_counts(g)


@query(" SELECT name, count(*) AS n_nodes FROM alive WHERE kind = 'tag' GROUP BY 1")
def tag_nodes(g):
    return listing.tag_nodes(g)


@query(f""" SELECT DISTINCT d.id, d.name, d.file_path FROM docs d JOIN edges e ON e.source = d.id AND e.kind = 'tagged'
  JOIN alive t ON t.id = e.target AND t.kind = 'tag' AND lower(t.name) = '{TAG}'""")
def documents_by_tag(g):
    return listing.documents_by_tag(g, TAG)


@query(" SELECT 'nodes' AS what, kind, count(*) AS n FROM alive GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind")
def index_stats(g):
    return listing.index_stats(g)


@query(""" SELECT 'governance' AS what, count(*) AS n FROM gov WHERE node_id IN (SELECT id FROM docs)
UNION ALL SELECT 'research', count(*) FROM res WHERE node_id IN (SELECT id FROM docs) UNION ALL SELECT 'documents', count(*) FROM docs""")
def metadata_stats(g):
    return listing.metadata_stats(g)


@query(""", rows AS (SELECT split_part(file_path, '/', 1) AS project, 1 AS a, (kind = 'document')::INTEGER AS b, 0 AS c, 0 AS d FROM alive
  UNION ALL SELECT split_part(path, '/', 1), 0, 0, 1, 0 FROM (SELECT DISTINCT path FROM files) UNION ALL SELECT split_part(file_path, '/', 1), 0, 0, 0, 1 FROM unresolved_refs)
SELECT CASE WHEN grouping(project) = 1 THEN '*' ELSE project END AS project, sum(a)::BIGINT AS n_nodes, sum(b)::BIGINT AS n_documents, sum(c)::BIGINT AS n_files, sum(d)::BIGINT AS n_unresolved
FROM rows GROUP BY ROLLUP (project)""")
def status_by_project(g):
    return listing.status_by_project(g)


@query(""", hashes AS (SELECT path, seen_at, lower(regexp_replace(content_hash, '(?i)^sha256:', '')) AS h FROM versions WHERE trim(content_hash) <> ''),
now_hash AS (SELECT path, arg_max(h, seen_at) AS current FROM hashes GROUP BY path),
chunk AS (SELECT DISTINCT node_id, file_path, lower(regexp_replace(content_hash, '(?i)^sha256:', '')) AS h FROM section_chunks)
SELECT node_id, file_path, current IS NULL AS never_indexed FROM chunk LEFT JOIN now_hash ON path = file_path WHERE current IS NULL OR h IS NULL OR h <> current""")
def pending_sections(g):
    return listing.pending_excerpts(g)


_TOKENS = r""", sized AS (SELECT string_split(file_path, '/') AS p, length(coalesce(body_excerpt, '')) AS n,
  length(regexp_replace(coalesce(body_excerpt, ''), '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g')) AS east FROM docs),
tok AS (SELECT CASE WHEN len(p) > 1 THEN p[1] ELSE '' END AS top, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE '' END AS sub, (east + (n - east) // 4)::BIGINT AS t FROM sized)"""


@query(f"{_TOKENS} SELECT top, sub, count(*) AS n_files, sum(t)::BIGINT AS n_tokens FROM tok GROUP BY ALL")
def token_rollup(g):
    return listing.token_rollup(g)


@query(f"{_TOKENS} SELECT model, sum(t)::BIGINT AS n_tokens, sum(t)::BIGINT / 1e6 * rate AS cost FROM tok, (VALUES {', '.join(f"('{m}', {r}::DOUBLE)" for m, r in RATES)}) r(model, rate) GROUP BY model, rate")
def cost_estimate(g):
    return listing.cost_estimate(g, RATES)


@query(f" SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, count(DISTINCT path) AS n_files FROM files WHERE regexp_matches(lower(path), '{'|'.join(listing.SENSITIVE)}') GROUP BY 1")
def sensitive_folders(g):
    return listing.sensitive_folders(g)


@query(f"{_CURRENT} SELECT path FROM current WHERE NOT coalesce(has_frontmatter, false)")
def hygiene_no_frontmatter(g):
    return listing.no_frontmatter(g)


@query(" SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT n.file_path FROM alive n JOIN cites c ON c.source = n.id)")
def hygiene_no_outgoing(g):
    return listing.no_outgoing(g)


@query(" SELECT reference_text, reference_kind, count(*) AS n FROM unresolved_refs GROUP BY ALL ORDER BY n DESC, reference_text NULLS FIRST, reference_kind LIMIT 20")
def hygiene_broken_links(g):
    return listing.broken_links(g)


@query(" SELECT id, file_path FROM docs WHERE file_path NOT IN (SELECT file_path FROM alive WHERE kind = 'heading')")
def hygiene_no_headings(g):
    return listing.no_headings(g)


@query(""", ends AS (SELECT source AS id FROM edges WHERE kind = 'similar_to' UNION SELECT target FROM edges WHERE kind = 'similar_to' AND target IS NOT NULL)
SELECT id, file_path FROM docs WHERE id NOT IN (SELECT id FROM ends)""")
def hygiene_islands(g):
    return listing.islands(g)


_EVENTS = "SELECT user_id::VARCHAR AS path, event_type AS author, epoch_us(ts) // 1000000 AS ts, props::VARCHAR AS subject FROM events"


def _commits(g):
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return g.table("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("author"), ts.alias("ts"), F.col("props").alias("subject"))


@query(f""", commits AS ({_EVENTS}), last AS (SELECT path, ts, author, subject FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, author DESC, subject DESC) AS k FROM commits) WHERE k = 1)
SELECT c.path, count(*) AS commit_count, min(c.ts) AS first_commit_at, max(c.ts) AS last_commit_at, count(DISTINCT c.author) AS author_count, last.author AS last_author, last.subject AS last_subject
FROM commits c JOIN last USING (path) GROUP BY ALL""")
def commit_history(g):
    return listing.commit_history(_commits(g))


@query(f""", commits AS ({_EVENTS}), per AS (SELECT path, author, count(*) AS n FROM commits GROUP BY ALL), total AS (SELECT *, sum(n) OVER (PARTITION BY path)::BIGINT AS total FROM per)
SELECT path, author, n, total FROM total WHERE total >= 3 AND n / total >= 0.3""")
def owner_inference(g):
    return listing.owner_inference(_commits(g), share=0.3)


@query(f" SELECT source, target, kind, line FROM refs WHERE target IN (SELECT id FROM alive WHERE file_path = '{HUB}')")
def edges_incoming(g):
    return traverse.incoming(g, HUB)


@query(f""" SELECT source, target, kind, line FROM edges WHERE kind IN ('references', 'wikilinks_to', 'related_to', 'embeds', 'links_external')
  AND source IN (SELECT id FROM alive WHERE file_path = '{HUB}')""")
def edges_outgoing(g):
    return traverse.outgoing(g, HUB)


@query(""", ends AS (SELECT e.kind, s.file_path AS s, t.file_path AS t FROM edges e LEFT JOIN alive s ON s.id = e.source LEFT JOIN alive t ON t.id = e.target
  WHERE e.kind IN ('references', 'wikilinks_to', 'related_to', 'embeds', 'links_external')),
o AS (SELECT s AS file_path, count(*) AS n_out, count(DISTINCT t) FILTER (WHERE kind <> 'links_external' AND s <> t) AS n_out_documents,
  count(*) FILTER (WHERE kind <> 'links_external' AND s = t) AS n_same, count(*) FILTER (WHERE kind = 'links_external') AS n_external FROM ends WHERE s IS NOT NULL GROUP BY 1),
i AS (SELECT t AS file_path, count(*) AS n_in, count(DISTINCT s) FILTER (WHERE s <> t) AS n_in_documents FROM ends WHERE t IS NOT NULL AND kind <> 'links_external' GROUP BY 1)
SELECT d.file_path, coalesce(n_in, 0) AS n_in, coalesce(n_in_documents, 0) AS n_in_documents, coalesce(n_out, 0) AS n_out, coalesce(n_out_documents, 0) AS n_out_documents,
  coalesce(n_same, 0) AS n_same, coalesce(n_external, 0) AS n_external FROM docs d LEFT JOIN i USING (file_path) LEFT JOIN o USING (file_path)""")
def edge_summary(g):
    return traverse.edge_summary(g)


_DOC_EDGES = """, de AS (SELECT DISTINCT coalesce(s.file_path, e.source) AS src, t.file_path AS tgt FROM refs e JOIN alive t ON t.id = e.target LEFT JOIN alive s ON s.id = e.source)"""


@query(f"""{_DOC_EDGES}, reach AS (SELECT '{HUB}' AS document, 0 AS level UNION SELECT de.src, r.level + 1 FROM reach r JOIN de ON de.tgt = r.document WHERE r.level < 3)
SELECT document, min(level) AS level FROM reach GROUP BY document HAVING min(level) > 0""", recursive=True)
def impact_levels(g):
    return traverse.impact(g, HUB, 3).select("document", "level")


@query()
def impact_bfs(g):
    return traverse.impact(g, HUB, 2)


@query(f"""{_DOC_EDGES}, reach AS (SELECT min(src) AS document, 0 AS hops FROM de WHERE src <> tgt UNION SELECT de.tgt, r.hops + 1 FROM reach r JOIN de ON de.src = r.document WHERE r.hops < 10)
SELECT document, min(hops) AS hops FROM reach WHERE document IS NOT NULL GROUP BY document""", recursive=True)
def trace_hops(g):
    start = traverse.document_edges(g).filter("src <> tgt").agg(F.min("src")).first()[0] or ""
    return traverse.shortest_paths(g, start).select("document", "hops")


_RESOLVED = r""",
heads AS (SELECT id FROM alive WHERE kind = 'heading'),
linked AS (SELECT id AS ref_id, from_node_id AS source, line, file_path, regexp_extract(reference_text, '^([^#]*)', 1) AS t, regexp_extract(reference_text, '#(.*)$', 1) AS anchor
           FROM unresolved_refs WHERE reference_kind = 'markdown_link' AND reference_text IS NOT NULL),
joined AS (SELECT *, lower(regexp_replace(file_path, '[^/]*$', '') || CASE WHEN t = '' THEN file_path ELSE regexp_replace(t, '^/+', '') END) AS j FROM linked WHERE t <> '' OR anchor <> ''),
parts AS (SELECT *, list_filter(string_split(j, '/'), lambda x: x NOT IN ('', '.')) AS p FROM joined),
steps AS (SELECT ref_id, source, line, anchor, p, 0 AS i, []::VARCHAR[] AS done FROM parts
  UNION ALL SELECT ref_id, source, line, anchor, p, i + 1, CASE WHEN p[i + 1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[1:len(done) - 1] ELSE list_append(done, p[i + 1]) END FROM steps WHERE i < len(p)),
paths AS (SELECT *, array_to_string(done, '/') AS path FROM steps WHERE i = len(p)),
direct AS (SELECT p.ref_id, p.source, CASE WHEN p.anchor <> '' AND d.id || '#' || p.anchor IN (SELECT id FROM heads) THEN d.id || '#' || p.anchor ELSE d.id END AS target, 'references' AS kind, p.line
           FROM paths p JOIN docs d ON lower(d.file_path) = p.path),
wiki AS (SELECT id AS ref_id, from_node_id AS source, line, reference_kind, regexp_replace(file_path, '/?[^/]*$', '') AS dir, trim(regexp_extract(reference_text, '^([^|#]*)', 1)) AS t
         FROM unresolved_refs WHERE reference_kind IN ('wikilink', 'embed')),
named AS (SELECT *, lower(regexp_replace(t, '\.md$', '')) AS key FROM wiki WHERE t <> '' AND (reference_kind = 'wikilink' OR lower(regexp_extract(t, '(\.[^./]*)$', 1)) IN ('', '.md'))),
keys AS (SELECT 0 AS rank, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.md$', '')) AS key, id, file_path FROM docs UNION ALL SELECT 1, lower(name), id, file_path FROM docs),
cand AS (SELECT n.*, k.id, k.file_path AS kp, k.rank, min(k.rank) OVER (PARTITION BY n.ref_id) AS least FROM named n JOIN keys k USING (key)),
best AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY regexp_replace(kp, '/?[^/]*$', '') = dir DESC, strlen(id), kp, id) AS k FROM cand WHERE rank = least),
fuzzy AS (SELECT ref_id, source, id AS target, CASE reference_kind WHEN 'embed' THEN 'embeds' ELSE 'wikilinks_to' END AS kind, line FROM best WHERE k = 1),
done_refs AS (SELECT * FROM direct UNION ALL SELECT * FROM fuzzy)"""


@query(f"""{_RESOLVED} SELECT * FROM done_refs UNION ALL SELECT id, from_node_id, NULL, NULL, line FROM unresolved_refs WHERE id NOT IN (SELECT ref_id FROM done_refs)""", recursive=True)
def resolve_links(g):
    return resolve.resolve_graph(g)


@query(r""", l AS (SELECT id AS ref_id, split_part(file_path, '/', 1) AS own, lower(regexp_extract(reference_text, '^\s*([^|#]*)', 1)) AS p FROM unresolved_refs WHERE reference_kind = 'wikilink'),
m AS (SELECT * FROM l WHERE regexp_matches(p, '^[^/]+/.*[^/]\s*$')),
t AS (SELECT lower(split_part(file_path, '/', 1)) AS project, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.md$', '')) AS key, min(id) AS target FROM docs GROUP BY ALL)
SELECT ref_id, project AS target_project, target FROM m JOIN t ON t.project = split_part(p, '/', 1) AND t.key = regexp_replace(trim(split_part(p, '/', -1)), '\.md$', '') WHERE lower(own) <> project""")
def resolve_cross_project(g):
    return resolve.cross_project(g.table("unresolved_refs"), g.documents("name"))


_WORDS = f"""
words AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', name, body_excerpt)), '[\\pL\\p{{Nd}}]+')) AS p FROM docs),
toks AS (SELECT id, p AS term FROM words WHERE NOT regexp_matches(p, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]') AND strlen(p) >= 2 AND p NOT IN ({', '.join(f"'{w}'" for w in similarity.STOP_WORDS)})
  UNION ALL SELECT id, p[i:i+1] FROM (SELECT id, p, unnest(range(1, length(p))) AS i FROM words WHERE regexp_matches(p, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'))),
tot AS (SELECT id, count(*) AS n FROM toks GROUP BY id), tf AS (SELECT id, term, count(*) AS c FROM toks GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
w AS (SELECT tf.id, term, (c / n) * ln((SELECT count(*) FROM docs)::DOUBLE / d) AS weight FROM tf JOIN tot USING (id) JOIN df USING (term))"""
_FEATURES = f""", {_WORDS},
norm AS (SELECT id, sqrt(sum(weight * weight)) AS nrm FROM w GROUP BY id),
targets AS (SELECT source AS id, list_sort(list(DISTINCT target)) AS ts FROM refs WHERE target IS NOT NULL GROUP BY source),
feat AS (SELECT d.id, coalesce(ts, []) AS ts, list_sort(list_distinct(coalesce(list_transform(from_json(CASE WHEN json_valid(metadata) THEN json_extract(metadata, '$.tags') END, '["VARCHAR"]'), lambda x: lower(x)), []))) AS gs,
    (SELECT string_agg(term, ' ' ORDER BY term) FROM toks WHERE toks.id = d.id) AS bag FROM docs d LEFT JOIN targets USING (id)),
cls AS (SELECT id, min(id) OVER (PARTITION BY ts, gs, bag) AS class_id FROM feat)"""


@query(f", {_WORDS} SELECT id, term, round(weight * 1e9) / 1e9 + 0.0 AS weight FROM w")
def tfidf_weights(g):
    docs = g.documents("name", "body_excerpt").select("id", F.concat_ws(" ", "name", "body_excerpt").alias("text"))
    return similarity.tfidf(docs).withColumn("weight", F.round(F.col("weight") * 1e9) / 1e9 + 0.0)


@query(f"{_FEATURES} SELECT id, class_id FROM cls")
def similarity_classes(g):
    return similarity.classes(similarity.features(g))


@query(f"""{_FEATURES}, rep AS (SELECT f.* FROM feat f JOIN cls USING (id) WHERE class_id = id),
dot AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS s FROM w a JOIN w b ON a.term = b.term AND a.id < b.id
        WHERE a.id IN (SELECT id FROM rep) AND b.id IN (SELECT id FROM rep) AND a.weight > 0 GROUP BY ALL),
met AS (SELECT a, b FROM dot
  UNION SELECT x.id, y.id FROM (SELECT id, unnest(ts) AS t FROM rep) x JOIN (SELECT id, unnest(ts) AS t FROM rep) y ON x.t = y.t AND x.id < y.id
  UNION SELECT x.id, y.id FROM (SELECT id, unnest(gs) AS t FROM rep) x JOIN (SELECT id, unnest(gs) AS t FROM rep) y ON x.t = y.t AND x.id < y.id),
cs AS (SELECT a, b, coalesce(s / (x.nrm * y.nrm), 0) AS cosine FROM met LEFT JOIN dot USING (a, b) LEFT JOIN norm x ON x.id = a LEFT JOIN norm y ON y.id = b),
sc AS (SELECT a, b, cosine, CASE WHEN len(list_distinct(x.ts || y.ts)) > 0 THEN len(list_intersect(x.ts, y.ts)) / len(list_distinct(x.ts || y.ts)) ELSE 0 END AS r,
              CASE WHEN len(list_distinct(x.gs || y.gs)) > 0 THEN len(list_intersect(x.gs, y.gs)) / len(list_distinct(x.gs || y.gs)) ELSE 0 END AS t
       FROM cs JOIN rep x ON x.id = a JOIN rep y ON y.id = b)
SELECT a AS source, b AS target, round((0.5 * cosine + 0.3 * r + 0.2 * t) * 100) / 100 + 0.0 AS score, round(cosine * 100) / 100 + 0.0 AS tfidf, round(r * 100) / 100 + 0.0 AS refs, round(t * 100) / 100 + 0.0 AS tags
FROM sc WHERE round(0.5 * cosine + 0.3 * r + 0.2 * t, 6) >= {SIMILAR}""")
def composite_similarity(g):
    return similarity.composite_pairs(similarity.features(g), SIMILAR).drop("metadata")


@query(ORACLE["composite_similarity"].removeprefix(f"WITH {ALIVE}"))
def similarity_refreshed(g):
    """Nothing has really changed, so the pairs of one project scored again and the others kept are all pairs."""
    feats = stored(similarity.features(g), "features")
    before = similarity.composite_pairs(feats, SIMILAR).drop("metadata")
    return similarity.refresh(before, feats.filter("id like 'atlas/%'"), feats, SIMILAR, SIMILAR)


@query(""", s AS (SELECT least(source, target) AS a, greatest(source, target) AS b, CASE WHEN json_extract_string(metadata, '$.engine') = 'neural' THEN 'neural' ELSE 'tfidf' END AS engine,
  try_cast(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.score') AS DOUBLE) AS score FROM edges WHERE kind = 'similar_to' AND source <> target)
SELECT a, b, engine, score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY engine = 'neural' DESC, score DESC NULLS LAST) AS k FROM s) WHERE k = 1""")
def similar_merged(g):
    return similarity.merged_similar(g.edges)


_VECTORS = """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.e, r.e), 4) + 0.0 AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)"""


@query(f"{_VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM s) SELECT query, neighbour, score, place::INTEGER AS place FROM k WHERE place <= 10")
def neural_topk(g):
    return similarity.nearest_vectors(g.table("embeddings"), "vec_id", "embedding", 20, 10)


_BM25 = """
{p}_c AS (SELECT {key} AS id, {sizes} AS size, {counts} FROM {table}),
{p}_n AS (SELECT count(*) AS n, avg(size) AS avgdl, {totals} FROM {p}_c),
{p} AS (SELECT id, {rank} AS rank FROM {p}_c, {p}_n WHERE {hit})"""


def _bm25_sql(p: str, table: str, key: str, weights: dict[str, float], terms: list[str]) -> str:
    low = "lower(coalesce({}, ''))"
    count = lambda t: " + ".join(f"(length({low.format(c)}) - length(replace({low.format(c)}, '{t}', ''))) / {len(t)} * {w}" for c, w in weights.items())
    part = lambda i: f"- greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / avgdl))"
    return _BM25.format(
        p=p, table=table, key=key, sizes=" + ".join(f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in weights), counts=", ".join(f"{count(t)} AS f{i}" for i, t in enumerate(terms)),
        totals=", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms))), rank="0.0 " + " ".join(part(i) for i in range(len(terms))),
        hit=" OR ".join(f"f{i} > 0" for i in range(len(terms))),
    )


_TERMS = search.query_terms(QUERY)
_NODE_BM = _bm25_sql("nb", "alive", "id", search.NODE_WEIGHTS, _TERMS)
_SEC_BM = _bm25_sql("sb", "secs", "node_id", search.SECTION_WEIGHTS, _TERMS)
_REQUEST = search.Request(QUERY)


@query(f", {_NODE_BM} SELECT id, round(rank, 6) + 0.0 AS rank FROM nb ORDER BY round(nb.rank, 9), id LIMIT {_REQUEST.cap}")
def search_bm25_nodes(g):
    return search.node_hits(g, _REQUEST, _TERMS).select("id", (F.round("rank", 6) + 0.0).alias("rank"))


@query(f", {_SEC_BM} SELECT id, round(rank, 6) + 0.0 AS rank FROM sb WHERE id IN (SELECT id FROM alive) ORDER BY round(sb.rank, 9), id LIMIT {_REQUEST.cap}")
def search_bm25_sections(g):
    return search.section_hits(g, _REQUEST, _TERMS).select("id", (F.round("rank", 6) + 0.0).alias("rank"))


@query(" SELECT id, name FROM alive WHERE contains(lower(concat_ws(chr(10), name, qualified_name, body_excerpt, metadata)), '12') ORDER BY name, id LIMIT 160")
def search_short(g):
    return search.short_hits(g, search.Request("12")).select("id", "name")


@query(f" SELECT id, kind FROM alive WHERE id = '{HUB}' OR file_path = '{HUB}' OR qualified_name = '{HUB}' OR lower(name) = '{HUB}' ORDER BY id LIMIT 160")
def search_exact(g):
    return search.exact_hits(g, search.Request(HUB)).select("id", "kind")


@query(" SELECT id, file_path FROM docs WHERE lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')) = 'index' ORDER BY file_path LIMIT 160")
def search_filename(g):
    return search.filename_hits(g, search.Request("index")).select("id", "file_path")


@query(f" SELECT e.source AS id, count(DISTINCT lower(t.name)) AS n_terms FROM edges e JOIN alive t ON t.id = e.target AND t.kind = 'tag' WHERE e.kind = 'tagged' AND lower(t.name) IN ('{TAG}', 'policy') GROUP BY 1")
def search_tags(g):
    return search.tag_hits(g, [TAG, "policy"])


_DEFS = """defs AS (SELECT DISTINCT coalesce(e.source, d.file_path) AS id, term FROM alive d JOIN (SELECT unnest({terms}) AS term) x ON contains(lower(d.name), term)
  LEFT JOIN edges e ON e.target = d.id AND e.kind = 'contains' WHERE d.kind = 'definition')"""


@query(f", {_DEFS.format(terms=_TERMS)} SELECT id, count(*) AS n_terms FROM defs WHERE id IN (SELECT id FROM alive) GROUP BY id")
def search_definitions(g):
    return search.definition_hits(g, _REQUEST, _TERMS)


@query(""" SELECT id, name FROM docs LEFT JOIN secs ON secs.node_id = docs.id WHERE id IN (SELECT node_id FROM gov WHERE lower(trim(status)) = 'approved')
  AND ((contains(lower(concat_ws(chr(10), name, qualified_name, body_excerpt, metadata)), 'retention') AND contains(lower(concat_ws(chr(10), name, qualified_name, body_excerpt, metadata)), 'policy'))
    OR (contains(lower(coalesce(text, '')), 'retention') AND contains(lower(coalesce(text, '')), 'policy'))) ORDER BY id LIMIT 160""")
def search_metadata_filter(g):
    return search.filtered_hits(g, search.Request(QUERY, filters={"status": "approved"}))


@query(" SELECT name FROM (SELECT DISTINCT name FROM alive WHERE kind IN ('heading', 'definition', 'tag') AND contains(lower(name), 'polic')) ORDER BY length(name), name LIMIT 12")
def query_expansion(g):
    return search.expansion_names(g, "polic")


def _field_sql() -> str:
    parts = []
    for c, w in search.FIELD_WEIGHTS.items():
        low = f"lower(coalesce({c}, ''))"
        parts += [f"CASE WHEN contains({low}, '{QUERY}') THEN {3 * w} ELSE 0 END"] + [f"CASE WHEN contains({low}, '{t}') THEN {w} ELSE 0 END" for t in _TERMS]
    return " + ".join(parts)


_RANKED = f""", {_NODE_BM}, {_SEC_BM}, {_DEFS.format(terms=_TERMS)},
h1 AS (SELECT id, least(-rank, 12.0) AS score, 'node_fts' AS src FROM nb ORDER BY round(rank, 9), id LIMIT {_REQUEST.cap}),
h2 AS (SELECT id, least(-rank, 12.0) AS score, 'section_fts' AS src FROM sb WHERE id IN (SELECT id FROM alive) ORDER BY round(rank, 9), id LIMIT {_REQUEST.cap}),
tagged AS (SELECT e.source AS id, count(DISTINCT lower(t.name)) AS n FROM edges e JOIN alive t ON t.id = e.target AND t.kind = 'tag' WHERE e.kind = 'tagged' AND lower(t.name) IN ({', '.join(f"'{t}'" for t in _TERMS)}) GROUP BY 1),
h3 AS (SELECT id, n * 24.0 AS score, 'tag' AS src FROM tagged ORDER BY n DESC, id LIMIT {_REQUEST.cap}),
h4 AS (SELECT id, count(*) * 18.0 AS score, 'definition_context' AS src FROM defs WHERE id IN (SELECT id FROM alive) GROUP BY id ORDER BY count(*) DESC, id LIMIT {_REQUEST.cap}),
merged AS (SELECT id, sum(score) AS score, list(src) AS srcs FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) GROUP BY id),
members AS (SELECT m.id, n.id AS member FROM merged m JOIN alive d USING (id) JOIN alive n ON n.file_path = d.file_path WHERE d.kind = 'document' UNION ALL SELECT m.id, m.id FROM merged m JOIN alive d USING (id) WHERE d.kind <> 'document'),
gi AS (SELECT m.id, count(*) AS n_in FROM members m JOIN refs e ON e.target = m.member GROUP BY 1), go AS (SELECT m.id, count(*) AS n_out FROM members m JOIN refs e ON e.source = m.member GROUP BY 1),
ranked_hits AS (SELECT a.id, a.kind, a.name, a.file_path, a.start_line, round(m.score + {_field_sql()} + CASE WHEN a.kind = 'heading' AND list_contains(srcs, 'section_fts') THEN 8 ELSE 0 END + CASE WHEN a.kind = 'definition' THEN 5 ELSE 0 END
    + least(3 * ln(1 + coalesce(n_in, 0)), 12.0) + least(1.25 * ln(1 + coalesce(n_out, 0)), 5.0) + 8 * coalesce(t.n, 0) + least(2.5 * ln(1 + coalesce(commit_count, 0)), 7.0), 6) AS score
  FROM merged m JOIN (SELECT x.*, s.heading_path, s.text FROM alive x LEFT JOIN secs s ON s.node_id = x.id) a USING (id) LEFT JOIN gi USING (id) LEFT JOIN go USING (id) LEFT JOIN tagged t USING (id) LEFT JOIN hist ON hist.path = a.file_path),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, start_line, id)::INTEGER AS place FROM ranked_hits QUALIFY place <= {_REQUEST.limit})"""


@query(f"{_RANKED} SELECT * FROM top")
def search_ranked(g):
    return search.search(g, _REQUEST, [])


_HELD = f"""id IN (SELECT node_id FROM gov WHERE lower(trim(status)) = 'approved') AND id NOT IN (SELECT node_id FROM gov WHERE try_cast(regexp_extract(trim(effective_date), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) > DATE '{AS_OF}')
  AND id NOT IN (SELECT node_id FROM res WHERE try_cast(regexp_extract(trim(valid_until), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) < DATE '{AS_OF}')"""
_EVERY = lambda c: " AND ".join(f"contains({c}, '{t}')" for t in _TERMS)
_FILTERED = _RANKED.replace("merged AS (", f"""h5 AS (SELECT id, 16.0 AS score, 'metadata_filter' AS src FROM docs LEFT JOIN secs ON secs.node_id = docs.id WHERE {_HELD}
  AND (({_EVERY("lower(concat_ws(chr(10), name, qualified_name, body_excerpt, metadata))")}) OR ({_EVERY("lower(coalesce(text, ''))")})) ORDER BY id LIMIT {_REQUEST.cap}),
merged AS (""").replace("SELECT * FROM h4)", f"SELECT * FROM h4 UNION ALL SELECT * FROM h5) WHERE {_HELD}")


@query(f"{_FILTERED} SELECT * FROM top")
def search_filtered(g):
    return search.search(g, search.Request(QUERY, filters={"status": "approved", "as_of": AS_OF}), [])


@query()
def search_expanded(g):
    return search.search(g, _REQUEST)


@query(f"""{_RANKED} SELECT min(place) AS place, arg_min(id, place) AS id, file_path, coalesce(string_agg(name, ' | ' ORDER BY place) FILTER (WHERE kind = 'heading' AND name <> ''), '') AS sections FROM top GROUP BY file_path""")
def context_by_file(g):
    return context.entries(search.search(g, _REQUEST, []))


@query(f"""{_RANKED}, sized AS (SELECT t.id, t.place, coalesce(strlen(s.text), 0) AS b FROM top t LEFT JOIN secs s ON s.node_id = t.id),
summed AS (SELECT id, place, coalesce(sum(b) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM sized)
SELECT *, CASE WHEN bytes_before < 4000 THEN 'full' WHEN bytes_before < 6000 THEN 'stub' ELSE 'omitted' END AS form FROM summed""")
def context_budget(g):
    hits = search.search(g, _REQUEST, []).join(search.sections(g).select(F.col("node_id").alias("id"), "text"), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return context.budget(hits.select("id", "place", "text"), "text", 4000, 2000).drop("text")


@query(""", b AS (SELECT *, -length(text) AS rank, split_part(file_path, '/', 1) AS project FROM secs), k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY rank, node_id) AS n FROM b)
SELECT node_id, project, rank FROM k WHERE n <= 40 ORDER BY rank, node_id LIMIT 20""")
def workspace_fanout(g):
    rows = search.sections(g).select("node_id", F.substring_index("file_path", "/", 1).alias("project"), (-F.length("text")).alias("rank"))
    return search.fan_out(rows, F.col("project"), 20, [F.col("rank"), F.col("node_id")])


def _tuples(g):
    source = F.when(F.col("status") == "draft", "agent_inferred").when(F.col("owner").isNull(), "extractor").otherwise("frontmatter")
    return metadata.unpivot(g.table("governance_metadata"), GOVERNANCE, source)


_TUPLES = ", tuples AS (" + " UNION ALL ".join(
    f"SELECT node_id, '{f}' AS key, {f} AS value, CASE WHEN status = 'draft' THEN 'agent_inferred' WHEN owner IS NULL THEN 'extractor' ELSE 'frontmatter' END AS source, updated_at FROM governance_metadata WHERE trim({f}) <> ''"
    for f in GOVERNANCE
) + ")"
_AUTH = "CASE source WHEN 'frontmatter' THEN 4 WHEN 'extractor' THEN 3 ELSE 1 END"


@query(f"{_TUPLES} SELECT node_id, key, source, max(value) AS value, updated_at FROM tuples t WHERE updated_at = (SELECT max(updated_at) FROM tuples x WHERE x.node_id = t.node_id AND x.key = t.key AND x.source = t.source) GROUP BY ALL")
def metadata_upsert(g):
    return metadata.upsert(_tuples(g))


@query(f"""{_TUPLES}, best AS (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY {_AUTH} DESC, updated_at DESC, value DESC) AS k FROM tuples)
SELECT node_id, {', '.join(f"coalesce(max(value) FILTER (WHERE key = '{f}'), '') AS {f}" for f in GOVERNANCE)} FROM best WHERE k = 1 GROUP BY node_id""")
def metadata_projection(g):
    return metadata.project(_tuples(g), GOVERNANCE)


@query(rf"""{_TUPLES} SELECT CASE WHEN regexp_matches(value, '^\d{{4}}-\d{{2}}-\d{{2}}([T ].*)?$') THEN 'date' WHEN regexp_matches(value, '^\[\[[^\]]+\]\]$') THEN 'ref'
  WHEN regexp_matches(value, '^[+\-]?\d+(\.\d+)?$') THEN 'number' ELSE 'string' END AS value_type, key, count(*) AS n FROM tuples GROUP BY ALL""")
def metadata_value_types(g):
    return _tuples(g).groupBy(metadata.value_type(F.col("value")).alias("value_type"), "key").agg(F.count("*").alias("n"))


@query(f"{_TUPLES} SELECT node_id, sha256(string_agg(key || chr(9) || source || chr(9) || value, chr(10) ORDER BY key || chr(9) || source || chr(9) || value)) AS digest FROM tuples GROUP BY node_id")
def metadata_digests(g):
    return metadata.digests(_tuples(g))


_MENTIONS = r""", m AS (SELECT node_id, trim(unnest(regexp_extract_all(text, '\[\[([^\[\]|#\n]+)[^\[\]\n]*\]\]', 1))) AS name FROM secs), found AS (SELECT node_id, name, count(*) AS n FROM m WHERE name <> '' GROUP BY ALL)"""


@query(f"{_MENTIONS} SELECT node_id, name, n FROM found")
def entity_mentions(g):
    return metadata.mentions(search.sections(g))


@query(rf"""{_MENTIONS}, x AS (SELECT *, regexp_replace(lower(trim(name)), '\s', ' ', 'g') AS norm FROM found)
SELECT sha256('concept|' || norm) AS entity_id, 'concept' AS entity_type, min(name) AS name, array_to_string(list_sort(list(DISTINCT name)), ' | ') AS aliases, count(DISTINCT node_id) AS n_nodes FROM x GROUP BY norm""")
def entity_dedup(g):
    return metadata.entities(metadata.mentions(search.sections(g)))


_STATES = f"""{_CURRENT}, h AS (SELECT path, seen_at, lower(regexp_replace(content_hash, '(?i)^sha256:', '')) AS d FROM versions WHERE trim(content_hash) <> ''),
cuts AS (SELECT max(x) FILTER (WHERE k = 2) AS c1, max(x) FILTER (WHERE k = 1) AS c2 FROM (SELECT epoch_us(started_at) // 1000000 AS x, row_number() OVER (ORDER BY started_at DESC) AS k FROM index_runs WHERE status = 'succeeded')),
a AS (SELECT path, arg_max(d, seen_at) AS d FROM h WHERE seen_at <= (SELECT c1 FROM cuts) GROUP BY path),
b AS (SELECT path, arg_max(d, seen_at) AS d FROM h WHERE seen_at <= (SELECT c2 FROM cuts) AND path NOT IN (SELECT path FROM current WHERE errors = 'file removed') GROUP BY path)"""


def _states(g):
    """Of every path the version at the last but one and at the last succeeded run; removed files have none at the latter."""
    from paperloom.operators.change_capture import change_log

    log = change_log(g.table("files"))
    last = lambda df: df.groupBy("path").agg(F.max(F.struct("log_offset", "digest"))["digest"].alias("digest"))
    runs = g.table("index_runs").filter("status = 'succeeded'").select(F.unix_seconds(F.col("started_at").cast("timestamp")).alias("x")).orderBy(F.col("x").desc()).limit(2).collect()
    second, first = runs[-1]["x"], runs[0]["x"]
    gone = listing.current_files(g).filter("errors = 'file removed'").select("path")
    return last(log.filter(F.col("log_offset") <= second)), last(log.filter(F.col("log_offset") <= first)).join(gone, "path", "left_anti")


@query(f"""{_STATES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.d IS DISTINCT FROM b.d""")
def incremental_diff(g):
    return incremental.diff(*_states(g), "path", "digest")


@query(f"{_STATES} SELECT count(*) AS n_known, count(*) FILTER (WHERE path NOT IN (SELECT path FROM b)) AS n_gone, count(*) >= 10 AND n_gone > count(*) * 0.5 AS refused FROM a")
def prune_guard(g):
    return incremental.prune_guard(*_states(g), "path")


@query(f"""{_CURRENT}, gone AS (SELECT path FROM current WHERE errors = 'file removed'), dead AS (SELECT id FROM alive WHERE file_path IN (SELECT path FROM gone))
SELECT e.kind, count(*) AS n_edges FROM edges e WHERE source NOT IN (SELECT id FROM dead) AND (target IS NULL OR target NOT IN (SELECT id FROM dead)) GROUP BY e.kind""")
def prune_cascade(g):
    gone = listing.current_files(g).filter("errors = 'file removed'").select("path")
    _, edges = incremental.cascade(g.nodes("file_path"), g.edges, gone)
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


@query(" SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(g):
    docs = g.table("documents").groupBy(F.sha2("text", 256).alias("digest"))
    return docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(""", heads AS (SELECT id, file_path, start_line, level, end_line FROM alive WHERE kind = 'heading')
SELECT id, coalesce((SELECT min(n.start_line) - 1 FROM heads n WHERE n.file_path = h.file_path AND n.start_line > h.start_line AND n.level <= h.level),
  (SELECT d.end_line FROM docs d WHERE d.id = h.file_path)) AS last_line FROM heads h""")
def heading_end_lines(g):
    from paperloom.operators.outline import end_lines

    return end_lines(g)


@query(""", heads AS (SELECT id, file_path, start_line FROM alive WHERE kind = 'heading')
SELECT r.id AS ref_id, coalesce(h.id, r.file_path) AS node_id FROM unresolved_refs r ASOF LEFT JOIN heads h ON r.file_path = h.file_path AND r.line >= h.start_line""")
def nearest_heading(g):
    from paperloom.operators.outline import nearest_headings

    return nearest_headings(g, g.table("unresolved_refs"))


@query(r" SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{Nd}\-\s]', '', 'g'), '\s+', '-', 'g'), '-') AS slug FROM alive WHERE kind = 'heading'")
def heading_slugs(g):
    from paperloom.functions.text import slug

    return g.nodes("kind", "name").filter("kind = 'heading'").select("id", slug(F.col("name")).alias("slug"))


@query(""", e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS began, count(*) AS n_events FROM s GROUP BY user_id, k""")
def debounce_sessions(g):
    from paperloom.streaming.watch import debounce

    rows = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return debounce(rows, "user_id", "ts", "30 minutes").select("user_id", F.unix_seconds("began").alias("began"), "n_events")


@query(""" SELECT doc_id AS id, false AS stale FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def pending_embeddings(g):
    docs = g.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    made = g.table("embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("digest"))
    return listing.pending_embeddings(docs, made)


@query(""" SELECT label AS model, count(*) AS n_vectors, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
  round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label""")
def embedding_stats(g):
    return listing.embedding_stats(g.table("embeddings"), "label", "embedding")


@query(f"""{_CURRENT}, d AS (SELECT docs.id, c.seen_at FROM docs JOIN current c ON c.path = docs.file_path WHERE NOT coalesce(has_frontmatter, false)),
g AS (SELECT node_id, max(updated_at) AS enriched_at FROM governance_metadata GROUP BY node_id)
SELECT count(*) AS n_eligible, count(enriched_at) AS n_enriched, count(*) FILTER (WHERE enriched_at < seen_at) AS n_stale FROM d LEFT JOIN g ON g.node_id = d.id""")
def enrichment_stats(g):
    return listing.enrichment_stats(g)
