"""Queries of the general data problems (1, 2, 4, 5) with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.operators import change_capture, hierarchy, orphans, timestamps
from paperloom.session import read, shared_dir


def p1_found(spark, d):
    return change_capture.changed_by_run(read(spark, d, "files"), read(spark, d, "index_runs")).select("run_id", "path")


def p1_delivered_per_run(spark, d):
    changed = change_capture.changed_by_run(read(spark, d, "files"), read(spark, d, "index_runs"))
    return changed.groupBy("run_id").agg(F.count("*").alias("n_paths"), F.countDistinct("digest").alias("n_digests"))


def p1_feed(spark, d):
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    return change_capture.feed_history(read(spark, d, "files"), read(spark, d, "index_runs"), folder).select("run_id", "path")


def _dates(spark, d):
    tables = (read(spark, d, t) for t in ("governance_metadata", "research_metadata", "project_zones"))
    return timestamps.metadata_dates(*tables)


def p2_found(spark, d):
    return _dates(spark, d).filter("utc_second is not null").select("node_id", "field", "utc_second").distinct()


def p2_status_counts(spark, d):
    return _dates(spark, d).groupBy("field", "status").agg(F.count("*").alias("n_values"))


def p4_found(spark, d):
    return hierarchy.trees(read(spark, d, "nodes"), read(spark, d, "governance_metadata"), with_paths=False).select(
        "tree", "node_id", "root_id", "depth"
    )


def p4_paths(spark, d):
    rows = hierarchy.trees(read(spark, d, "nodes"), read(spark, d, "governance_metadata"))
    return rows.select("tree", "node_id", "parent", F.array_join("path", " > ").alias("path"), "n_descendants")


def p4_descendants(spark, d):
    return hierarchy.tree_descendants(read(spark, d, "nodes"), read(spark, d, "governance_metadata"))


def p4_circles(spark, d):
    links = hierarchy.supersession_links(read(spark, d, "nodes"), read(spark, d, "governance_metadata"))
    rows = hierarchy.build_hierarchy(links, with_paths=False).filter("on_cycle")
    return rows.select("component", F.col("node").alias("node_id"), F.col("parent").alias("superseded_by"))


def _orphans(spark, d):
    return orphans.find_orphans(*(read(spark, d, t) for t in ("edges", "unresolved_refs", "nodes", "files")))


def p5_found(spark, d):
    return _orphans(spark, d).select("ref_table", "field", "ref_id", "period").distinct()


def p5_report(spark, d):
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_delivered_per_run, p1_feed, p2_found, p2_status_counts, p4_found, p4_paths, p4_descendants, p4_circles, p5_found, p5_report)
}

_VERSIONS = """
versions AS (
  SELECT path,
         CASE WHEN abs(indexed_at) >= 100000000000000000 THEN indexed_at // 1000000000
              WHEN abs(indexed_at) >= 100000000000000 THEN indexed_at // 1000000
              WHEN abs(indexed_at) >= 100000000000 THEN indexed_at // 1000 ELSE indexed_at END AS seen,
         regexp_replace(lower(trim(content_hash)), '^sha-?256[:=]\\s*', '') AS digest
  FROM files WHERE path IS NOT NULL AND indexed_at IS NOT NULL AND trim(content_hash) <> ''),
cuts AS (
  SELECT run_id, epoch_us(started_at) // 1000000 AS cutoff,
         lag(epoch_us(started_at) // 1000000) OVER (ORDER BY started_at) AS earlier
  FROM index_runs WHERE status = 'succeeded'),
states AS (
  SELECT run_id, path, arg_max(digest, seen) AS now_digest,
         arg_max(digest, seen) FILTER (WHERE seen <= earlier) AS then_digest
  FROM cuts JOIN versions ON seen <= cutoff GROUP BY run_id, path),
changed AS (
  SELECT run_id, path, now_digest FROM states
  WHERE then_digest IS NULL OR then_digest <> now_digest)
"""

ORACLE = {
    "p1_found": f"WITH {_VERSIONS} SELECT run_id, path FROM changed",
    "p1_feed": f"WITH {_VERSIONS} SELECT run_id, path FROM changed",
    "p1_delivered_per_run": f"""WITH {_VERSIONS}
SELECT run_id, count(*) AS n_paths, count(DISTINCT now_digest) AS n_digests FROM changed GROUP BY run_id""",
}

_ALIVE = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL),
alive AS (
  SELECT * FROM ranked WHERE rn = 1 AND coalesce(CASE WHEN json_valid(metadata)
    THEN json_extract_string(metadata, '$.deleted') END, '') <> 'true')
"""

_CHAIN = f"""WITH RECURSIVE {_ALIVE},
docs AS (SELECT id, lower(file_path) AS path, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')) AS stem
         FROM alive WHERE kind = 'document'),
names AS (SELECT name, min(id) AS id FROM (
            SELECT path AS name, id FROM docs UNION ALL SELECT stem, id FROM docs
            UNION ALL SELECT stem || '.md', id FROM docs UNION ALL SELECT regexp_replace(path, '\\.md$', ''), id FROM docs)
          GROUP BY name),
gov AS (SELECT node_id, supersedes, superseded_by FROM (
          SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM governance_metadata)
        WHERE rn = 1 AND node_id IN (SELECT id FROM docs)),
stated AS (
  SELECT node_id, field, regexp_replace(trim(regexp_extract(lower(t), '^([^|#]*)', 1)), '^(\\./)+', '') AS name
  FROM (SELECT node_id, 'supersedes' AS field, unnest(string_split(regexp_replace(supersedes, '[\\[\\]"]', '', 'g'), ',')) AS t FROM gov
        UNION ALL
        SELECT node_id, 'superseded_by', unnest(string_split(regexp_replace(superseded_by, '[\\[\\]"]', '', 'g'), ',')) FROM gov)),
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT CASE WHEN field = 'supersedes' THEN n.id ELSE node_id END AS child,
           CASE WHEN field = 'supersedes' THEN node_id ELSE n.id END AS parent
    FROM stated JOIN names n USING (name)) GROUP BY child),
members AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
up AS (
  SELECT id, id AS top, 0 AS depth FROM members WHERE id NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, u.top, u.depth + 1 FROM up u JOIN links l ON l.parent = u.id)"""

_OUTLINE = """,
heads AS (SELECT id, file_path, start_line, level FROM alive WHERE kind = 'heading'),
above AS (SELECT h.id, p.id AS anc, p.level, p.start_line,
                 min(p.level) OVER (PARTITION BY h.id ORDER BY p.start_line DESC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least
          FROM heads h JOIN heads p ON p.file_path = h.file_path AND p.start_line < h.start_line AND p.level < h.level),
depths AS (SELECT id, count(*) AS n FROM above WHERE least IS NULL OR level < least GROUP BY id)"""

ORACLE["p4_found"] = f"""{_CHAIN}{_OUTLINE}
SELECT 'outline' AS tree, h.id AS node_id, h.file_path AS root_id, (1 + coalesce(n, 0))::INTEGER AS depth
FROM heads h LEFT JOIN depths USING (id)
UNION ALL
SELECT 'supersession', m.id, coalesce(top, ''), coalesce(depth, -1)::INTEGER FROM members m LEFT JOIN up USING (id)"""

#: Every (node, ancestor, steps): walks up that end at a root or where they would meet a node again.
_WALKS = f"""{_CHAIN}{_OUTLINE},
walk AS (SELECT id, id AS above, [id] AS path FROM members
  UNION ALL SELECT w.id, l.parent, list_prepend(l.parent, w.path) FROM walk w JOIN links l ON l.child = w.above WHERE NOT list_contains(w.path, l.parent)),
over AS (SELECT id, anc, start_line FROM above WHERE least IS NULL OR level < least),
steps AS (SELECT h.id, h.file_path, coalesce(list(anc ORDER BY over.start_line) FILTER (WHERE anc IS NOT NULL), []) AS ups FROM heads h LEFT JOIN over USING (id) GROUP BY h.id, h.file_path),
trail AS (SELECT id, file_path, list_prepend(file_path, ups) AS ups FROM steps),
pairs AS (SELECT 'outline' AS tree, file_path AS root, unnest(ups) AS node, id AS descendant, len(ups) + 1 - generate_subscripts(ups, 1) AS distance FROM trail
  UNION ALL SELECT 'supersession', coalesce(u.top, ''), w.above, w.id, len(w.path) - 1 FROM walk w LEFT JOIN up u USING (id) WHERE len(w.path) > 1)"""

ORACLE["p4_descendants"] = f"{_WALKS} SELECT tree, root, node, descendant, distance::BIGINT AS distance FROM pairs"
ORACLE["p4_paths"] = f"""{_WALKS}, n AS (SELECT tree, node, count(*) AS n FROM pairs GROUP BY ALL),
whole AS (SELECT id, max(path) AS path FROM walk JOIN up USING (id) WHERE len(path) = depth + 1 GROUP BY id),
lines AS (SELECT 'outline' AS tree, id AS node_id, ups[-1] AS parent, array_to_string(list_append(ups, id), ' > ') AS path FROM trail
  UNION ALL SELECT 'supersession', m.id, l.parent, array_to_string(w.path, ' > ') FROM members m LEFT JOIN links l ON l.child = m.id LEFT JOIN whole w ON w.id = m.id)
SELECT l.tree, node_id, parent, path, coalesce(n, 0)::BIGINT AS n_descendants FROM lines l LEFT JOIN n ON n.tree = l.tree AND n.node = l.node_id"""
ORACLE["p4_circles"] = f"""{_CHAIN},
loops AS (SELECT child AS id, parent AS reached, 1 AS k FROM links UNION SELECT c.id, l.parent, k + 1 FROM loops c JOIN links l ON l.child = c.reached WHERE c.reached <> c.id AND k < 1000),
near AS (SELECT id, id AS other FROM members UNION SELECT n.id, CASE WHEN l.child = n.other THEN l.parent ELSE l.child END FROM near n JOIN links l ON n.other IN (l.child, l.parent))
SELECT (SELECT min(other) FROM near WHERE near.id = l.child) AS component, child AS node_id, parent AS superseded_by FROM links l WHERE child IN (SELECT id FROM loops WHERE reached = id)"""
_KEY = "regexp_replace(replace(lower(CASE WHEN contains({c}, '%') THEN coalesce(try(url_decode({c})), {c}) ELSE {c} END), '\\', '/'), '^(\\./)+', '')"
_ORPHANS = f"""WITH RECURSIVE {_ALIVE},
docs AS (SELECT * FROM alive WHERE kind = 'document'),
node_keys AS (SELECT DISTINCT {_KEY.format(c='id')} AS key FROM alive),
stems AS (SELECT lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')) AS stem, lower(file_path) AS path, lower(name) AS name FROM docs),
name_keys AS (SELECT stem AS key FROM stems UNION SELECT path FROM stems UNION SELECT regexp_replace(path, '\\.md$', '') FROM stems UNION SELECT name FROM stems WHERE name IS NOT NULL),
latest AS (SELECT id, arg_max(file_path, updated_at) AS file FROM nodes GROUP BY id),
seen AS (SELECT path, strftime(make_timestamp(1000000 * max(CASE WHEN abs(indexed_at) >= 100000000000000 THEN indexed_at // 1000000 WHEN abs(indexed_at) >= 100000000000 THEN indexed_at // 1000 ELSE indexed_at END)), '%Y-%m') AS period FROM files GROUP BY path),
on_node AS (
  SELECT 'edges' AS ref_table, 'target' AS field, id AS ref_id, {_KEY.format(c='target')} AS key, source, NULL::VARCHAR AS file FROM edges WHERE trim(target, E' \\t\\n') <> ''
  UNION ALL SELECT 'unresolved_refs', 'from_node_id', id, {_KEY.format(c='from_node_id')}, NULL::VARCHAR, file_path FROM unresolved_refs WHERE trim(from_node_id, E' \\t\\n') <> ''),
texts AS (
  SELECT *, coalesce(reference_kind IN ('wikilink', 'embed'), false) AS wiki, regexp_extract(reference_text, '^([^#]*)', 1) AS t FROM unresolved_refs
  WHERE trim(reference_text, E' \\t\\n') <> '' AND NOT regexp_matches(reference_text, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*:')),
on_name AS (SELECT id, file_path, regexp_replace(lower(trim(regexp_extract(reference_text, '^([^|#]*)', 1))), '\\.md$', '') AS key FROM texts WHERE wiki),
decoded AS (SELECT id, file_path, CASE WHEN contains(t, '%') THEN coalesce(try(url_decode(t)), t) ELSE t END AS t FROM texts WHERE NOT wiki AND t <> ''),
parts AS (SELECT id, file_path, starts_with(t, '/') AS rooted, list_filter(string_split(lower(CASE WHEN starts_with(t, '/') THEN t ELSE regexp_replace(coalesce(file_path, ''), '[^/]*$', '') || t END), '/'), lambda x: x NOT IN ('', '.')) AS p FROM decoded),
walk AS (SELECT id, file_path, rooted, p, 0 AS i, []::VARCHAR[] AS done FROM parts
  UNION ALL SELECT id, file_path, rooted, p, i + 1, CASE WHEN p[i + 1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[1:len(done) - 1] ELSE list_append(done, p[i + 1]) END FROM walk WHERE i < len(p)),
on_path AS (SELECT id, file_path, CASE WHEN rooted THEN '/' ELSE '' END || array_to_string(done, '/') AS key FROM walk WHERE i = len(p)),
orphans AS (
  SELECT ref_table, field, ref_id, 'node' AS space, key, CASE WHEN ref_table = 'edges' THEN l.file ELSE o.file END AS file FROM on_node o LEFT JOIN latest l ON l.id = o.source WHERE key NOT IN (SELECT key FROM node_keys)
  UNION ALL SELECT 'unresolved_refs', 'reference_text', id, 'name', key, file_path FROM on_name WHERE key NOT IN (SELECT key FROM name_keys)
  UNION ALL SELECT 'unresolved_refs', 'reference_text', id, 'path', key, file_path FROM on_path WHERE key NOT IN (SELECT path FROM stems))"""
ORACLE["p5_found"] = f"{_ORPHANS} SELECT DISTINCT ref_table, field, ref_id, coalesce(period, 'unknown') AS period FROM orphans LEFT JOIN seen ON seen.path = orphans.file"
ORACLE["p5_report"] = f"""{_ORPHANS} SELECT ref_table, field, coalesce(period, 'unknown') AS period, count(*) AS n_orphans, count(DISTINCT (space, key)) AS n_missing_keys
FROM orphans LEFT JOIN seen ON seen.path = orphans.file GROUP BY ALL"""


_ABBREVIATED = ", ".join(f"('{k}', {v})" for k, v in timestamps.ABBREVIATIONS.items())
_MONTH_NO = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], {}[:3])"
_MON = "((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\\.?"
_DAYNAME = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,?\\s+)?"
_CLOCK = "(?:(?:t|,?\\s+)(\\d.*))?$"
#: format -> (pattern of date and rest, year, month, day) with $1.. for its groups
_FORMS = [
    ("^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})" + _CLOCK, "p[1]", "p[2]", "p[3]", 4),
    ("^(\\d{4})(\\d{2})(\\d{2})" + _CLOCK, "p[1]", "p[2]", "p[3]", 4),
    ("^(\\d{1,2})/(\\d{1,2})/(\\d{4})" + _CLOCK, "p[3]", "p[1]", "p[2]", 4),
    ("^(\\d{1,2})\\.\\s?(\\d{1,2})\\.\\s?(\\d{4})" + _CLOCK, "p[3]", "p[2]", "p[1]", 4),
    ("^" + _DAYNAME + "(\\d{1,2})(?:st|nd|rd|th|\\.)?[\\s-]+(?:of\\s+)?" + _MON + "[\\s,-]+(\\d{4})" + _CLOCK, "p[3]", "m", "p[1]", 4),
    ("^" + _DAYNAME + _MON + "[\\s-]+(\\d{1,2})(?:st|nd|rd|th)?,?[\\s-]+(\\d{4})" + _CLOCK, "p[3]", "m", "p[2]", 4),
]
_CASES = " ".join(f"WHEN regexp_matches(t, '{form}') THEN {i}" for i, (form, *_) in enumerate(_FORMS, 1))
_group = lambda g: "CASE f " + " ".join(f"WHEN {i} THEN regexp_extract(t, '{form}', {g})" for i, (form, *_) in enumerate(_FORMS, 1)) + " END"
_YMD = lambda at: "CASE f " + " ".join(f"WHEN {i} THEN {'mon' if x[at] == 'm' else x[at].replace('p[', 'g[')}" for i, x in enumerate(_FORMS, 1)) + " END"

ORACLE["p2_found"] = f"""WITH vals AS (
  SELECT node_id, unnest(['review_due', 'effective_date']) AS field, unnest([review_due, effective_date]) AS v FROM governance_metadata
  UNION ALL SELECT node_id, unnest(['last_verified', 'valid_until']), unnest([last_verified, valid_until]) FROM research_metadata),
texts AS (SELECT DISTINCT node_id, field, lower(regexp_replace(v, '^[\\s\\x{{a0}}\\x{{feff}}"''`‘’“”„«»]+|[\\s\\x{{a0}}\\x{{feff}}"''`‘’“”„«»]+$', '', 'g')) AS t FROM vals WHERE v IS NOT NULL),
formed AS (SELECT *, CASE WHEN regexp_matches(t, '^-?\\d{{10,}}(?:[.,]\\d*)?$') THEN 0 WHEN regexp_matches(t, '^\\d{{4}}-?w\\d{{2}}-?[1-7]{_CLOCK[:-1]}$') THEN 8 WHEN regexp_matches(t, '^\\d{{4}}-?\\d{{3}}{_CLOCK[:-1]}$') THEN 9 {_CASES} END AS f FROM texts),
grouped AS (SELECT *, [{_group(1)}, {_group(2)}, {_group(3)}] AS g,
    CASE f WHEN 8 THEN regexp_extract(t, '^\\d{{4}}-?w\\d{{2}}-?[1-7]{_CLOCK[:-1]}$', 1) WHEN 9 THEN regexp_extract(t, '^\\d{{4}}-?\\d{{3}}{_CLOCK[:-1]}$', 1) ELSE {_group(4)} END AS clock FROM formed WHERE f IS NOT NULL),
named AS (SELECT *, CASE f WHEN 5 THEN {_MONTH_NO.format('g[2]')} WHEN 6 THEN {_MONTH_NO.format('g[1]')} END::VARCHAR AS mon FROM grouped),
days AS (SELECT *, CASE f
    WHEN 8 THEN try_cast(t[1:4] || '-01-04' AS DATE) - (isodow(try_cast(t[1:4] || '-01-04' AS DATE))::INTEGER - 1) + (regexp_extract(t, 'w(\\d\\d)', 1)::INTEGER - 1) * 7 + regexp_extract(t, 'w\\d\\d-?([1-7])', 1)::INTEGER - 1
    WHEN 9 THEN CASE WHEN regexp_extract(t, '^\\d{{4}}-?(\\d{{3}})', 1)::INTEGER BETWEEN 1 AND dayofyear(try_cast(t[1:4] || '-12-31' AS DATE)) THEN try_cast(t[1:4] || '-01-01' AS DATE) + regexp_extract(t, '^\\d{{4}}-?(\\d{{3}})', 1)::INTEGER - 1 END
    ELSE try_cast(lpad({_YMD(1)}, 4, '0') || '-' || lpad({_YMD(2)}, 2, '0') || '-' || lpad({_YMD(3)}, 2, '0') AS DATE) END AS d FROM named),
weeks AS (SELECT * FROM days WHERE f = 0 OR (d IS NOT NULL AND (f <> 8 OR (regexp_extract(t, 'w(\\d\\d)', 1)::INTEGER >= 1 AND isoyear(d) = t[1:4]::INTEGER)))),
clocks AS (SELECT *, regexp_extract(clock, '^(\\d{{1,2}})(?::(\\d{{2}})(?::(\\d{{2}})(?:[.,]\\d+)?)?|(\\d{{2}})(\\d{{2}})?(?:[.,]\\d+)?)(?:\\s*([ap])\\.?m(?:\\.|\\b))?\\s*(z|[a-z]{{2,5}}|(?:utc|gmt)?[+\\-−]\\d{{1,2}}(?::?\\d{{2}})?|\\[?[a-z_]+(?:/[a-z0-9_+\\-]+)+\\]?|\\[(?:utc|gmt|z)\\])?$', ['h', 'm', 's', 'm2', 's2', 'half', 'zone']) AS c FROM weeks),
timed AS (SELECT *, clock <> '' AS has_time, try_cast(c.h AS INTEGER) AS hour, coalesce(try_cast(c.m AS INTEGER), try_cast(c.m2 AS INTEGER), 0) AS minute, coalesce(try_cast(c.s AS INTEGER), try_cast(c.s2 AS INTEGER), 0) AS sec, replace(regexp_replace(c.zone, '[\\[\\]]', '', 'g'), '−', '-') AS zone FROM clocks),
hours AS (SELECT *, CASE WHEN c.half = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE c.half WHEN 'p' THEN 12 ELSE 0 END END AS h24 FROM timed),
locals AS (SELECT *, epoch(d)::BIGINT + CASE WHEN NOT has_time THEN 0 WHEN (h24 <= 23 OR (h24 = 24 AND minute = 0 AND sec = 0)) AND minute <= 59 AND sec <= 60 THEN h24 * 3600 + minute * 60 + sec END AS l FROM hours),
offsets AS (SELECT x.*, a.o AS abbreviated, CASE WHEN regexp_matches(zone, '^(?:utc|gmt)?[+-]\\d') THEN (CASE WHEN contains(zone, '-') THEN -1 ELSE 1 END) * (regexp_extract(zone, '[+-](\\d\\d?)', 1)::INTEGER * 3600 + coalesce(try_cast(regexp_extract(zone, '[+-]\\d\\d?:?(\\d\\d)$', 1) AS INTEGER), 0) * 60) END AS stated,
    (SELECT min(time_zone) FROM project_zones p WHERE p.project = split_part(node_id, '/', 1)) AS home FROM locals x LEFT JOIN (VALUES {_ABBREVIATED}) a(z, o) ON a.z = zone),
zoned AS (SELECT *, CASE WHEN contains(zone, '/') THEN (SELECT min(name) FROM pg_timezone_names() z WHERE lower(z.name) = zone) ELSE coalesce(home, 'UTC') END AS tz FROM offsets WHERE f = 0 OR l IS NOT NULL),
guesses AS (SELECT *, make_timestamp(l * 1000000) AS lt, CASE WHEN f > 0 AND has_time AND stated IS NULL AND abbreviated IS NULL AND (zone = '' OR contains(zone, '/')) THEN epoch(timezone(tz, make_timestamp((l - 86400) * 1000000)))::BIGINT + 86400 END AS before_guess FROM zoned),
both_guesses AS (SELECT *, CASE WHEN before_guess IS NOT NULL THEN epoch(timezone(tz, lt))::BIGINT END AS plain_guess FROM guesses),
judged AS (SELECT *, epoch(timezone(tz, to_timestamp(before_guess)))::BIGINT = l AS before_fits, epoch(timezone(tz, to_timestamp(plain_guess)))::BIGINT = l AS plain_fits FROM both_guesses)
SELECT DISTINCT node_id, field, CASE WHEN f = 0 THEN (CASE WHEN length(regexp_extract(t, '(\\d+)', 1)) >= 18 THEN floor(regexp_extract(t, '^(-?\\d+)', 1)::HUGEINT / 1000000000) WHEN length(regexp_extract(t, '(\\d+)', 1)) >= 15 THEN floor(regexp_extract(t, '^(-?\\d+)', 1)::HUGEINT / 1000000)
    WHEN length(regexp_extract(t, '(\\d+)', 1)) >= 12 THEN floor(regexp_extract(t, '^(-?\\d+)', 1)::HUGEINT / 1000) ELSE regexp_extract(t, '^(-?\\d+)', 1)::HUGEINT END)::BIGINT
  WHEN NOT has_time THEN l WHEN stated IS NOT NULL THEN l - stated WHEN abbreviated IS NOT NULL THEN l - abbreviated WHEN before_fits THEN before_guess WHEN plain_fits THEN plain_guess ELSE before_guess END AS utc_second
FROM judged WHERE f = 0 OR NOT has_time OR stated IS NOT NULL OR abbreviated IS NOT NULL OR (zone = '' OR contains(zone, '/')) AND tz IS NOT NULL AND h24 IS NOT NULL"""
