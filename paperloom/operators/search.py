"""Ranked search over nodes and sections.

The request is normalised on the driver (terms, intent, caps).  Collectors find candidates, each cut
to the candidate cap by a top-k plan; candidates are merged by id, joined with their own rows and
their graph and history signals only, scored and cut to the limit.  Scores of owners, statuses and
other governance rules are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import newest, stored
from paperloom.tables import GOVERNANCE, REFERENCES, RESEARCH, Graph

#: Column weights of the text index and of the field ranking.
NODE_WEIGHTS = {"name": 8.0, "qualified_name": 5.0, "body_excerpt": 2.0, "metadata": 3.0}
SECTION_WEIGHTS = {"heading_path": 6.0, "text": 1.0}
FIELD_WEIGHTS = {"name": 12.0, "heading_path": 10.0, "qualified_name": 6.0, "metadata": 5.0, "body_excerpt": 3.0, "text": 2.0}
EXPANSION_WEIGHTS = {"name": 2.0, "heading_path": 2.0, "text": 0.75}
K1, B, IDF_FLOOR, BOOST_CAP, MOST_HITS = 1.2, 0.75, 1e-6, 12.0, 100
#: Fields of the metadata that hits can be held to; the last two are an audience and a day.
EQUAL_FILTERS = {"status": "g", "sensitivity": "g", "canonical_source": "g", "claim_id": "r", "source_type": "r", "confidence": "r", "analyst_status": "r"}
FILTERS = {*EQUAL_FILTERS, "allowed_audience", "as_of"}


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words without punctuation around them."""
    words = (re.sub(r"^(?:[^\w\-/.]|_(?!\w))+|[^\w\-/.]+$", "", w.lower()) for w in query.split())
    return list(dict.fromkeys(w for w in words if w))


@dataclass(frozen=True)
class Request:
    query: str
    kind: str = ""
    limit: int = 20
    include_code: bool = False
    filters: dict[str, str] = field(default_factory=dict)
    entity_id: str = ""
    entity_type: str = ""
    candidates: int | None = None

    def __post_init__(self):
        unknown = set(self.filters) - FILTERS
        if unknown:
            raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
        object.__setattr__(self, "limit", min(max(self.limit, 1), MOST_HITS))

    @property
    def text(self) -> str:
        return self.query.strip().encode()[:1000].decode(errors="ignore")

    @property
    def terms(self) -> list[str]:
        return query_terms(self.text)

    @property
    def cap(self) -> int:
        """Candidates of each collector: the reference's rule, or as many as ``candidates`` says."""
        return min(max(self.limit * 8, 40), 200) if self.candidates is None else self.candidates

    @property
    def short(self) -> bool:
        return len(self.text.encode()) < 3 or (bool(self.terms) and all(len(t) < 3 for t in self.terms))

    @property
    def intent(self) -> str:
        q = self.text
        if self.kind == "heading" or "#" in q or " > " in q:
            return "section"
        return "exact" if q.endswith(".md") or ".md#" in q or q.startswith('"') else "topic"


def sections(g: Graph) -> DataFrame:
    """One section row per node id; a settled graph stores them once."""
    made = g.__dict__.get("_sections")
    if made is None:
        rows = g.table("section_chunks").select("node_id", "file_path", "start_line", "heading_path", "text")
        made = newest(rows, ["node_id"], [F.col("text").desc_nulls_last(), "heading_path"])
        if g.is_settled:
            made = g.__dict__["_sections"] = stored(made, "newest-sections")
    return made


def visible(nodes: DataFrame, request: Request) -> DataFrame:
    """Nodes of the asked kind, without those of code files unless they are asked for."""
    rows = nodes.filter(F.col("kind") == request.kind) if request.kind else nodes
    if request.include_code or request.kind == "code_file":
        return rows
    code = nodes.filter("kind = 'code_file'").select("file_path").distinct()
    return rows.join(code, "file_path", "left_anti")


def _count(column: str, term: str) -> Column:
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term))


def bm25(rows: DataFrame, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """Rows that contain a term, with ``rank`` (negative, least is best), without the weighted columns.

    Substring counts over weighted columns; lengths in character triples.  The texts are read once: their counts
    are stored, and give the statistics (one row for at most 32 terms, read to the driver) and the ranks.
    """
    terms = [t for t in terms if len(t) >= 3][:32]
    kept = [c for c in rows.columns if c not in weights]
    if not terms:
        return rows.select(*kept, F.lit(0.0).alias("rank")).limit(0)
    size = reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in weights])
    found = [reduce(lambda a, b: a + b, [_count(c, t) * w for c, w in weights.items()]) for t in terms]
    counted = stored(rows.select(*kept, size.alias("_size"), *[f.alias(f"_f{i}") for i, f in enumerate(found)]), "term-counts")
    facts = counted.agg(F.count("*").alias("n"), F.avg("_size").alias("size"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()
    if not facts["n"]:
        return counted.select(*kept, F.lit(0.0).alias("rank"))
    import math

    rank = F.lit(0.0)
    for i in range(len(terms)):
        n = facts[f"n{i}"]
        idf = max(math.log((facts["n"] - n + 0.5) / (n + 0.5)), IDF_FLOOR)
        f = F.col(f"_f{i}")
        rank = rank - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_size") / F.lit(float(facts["size"] or 1.0))))
    hit = reduce(lambda a, b: a | b, [F.col(f"_f{i}") > 0 for i in range(len(terms))])
    return counted.filter(hit).select(*kept, rank.alias("rank"))


def _candidates(df: DataFrame, source: str, score: Column, rank: Column | None = None) -> DataFrame:
    return df.select("id", F.lit(source).alias("source"), score.cast("double").alias("score"), (rank if rank is not None else F.lit(0.0)).alias("rank"))


def node_hits(g: Graph, request: Request, terms: list[str]) -> DataFrame:
    ranked = bm25(g.nodes("kind", "file_path", *NODE_WEIGHTS), NODE_WEIGHTS, terms)
    return visible(ranked, request).orderBy(F.round("rank", 9), "id").limit(request.cap)


def section_hits(g: Graph, request: Request, terms: list[str]) -> DataFrame:
    ranked = bm25(sections(g).select("node_id", *SECTION_WEIGHTS), SECTION_WEIGHTS, terms)
    nodes = visible(g.nodes("kind", "file_path"), request).select("id")
    return ranked.withColumnRenamed("node_id", "id").join(nodes, "id").orderBy(F.round("rank", 9), "id").limit(request.cap)


def short_hits(g: Graph, request: Request) -> DataFrame:
    """Too short for the index: every term must occur in one of the columns."""
    nodes = visible(g.nodes("kind", "file_path", *NODE_WEIGHTS), request)
    terms = request.terms or [request.text.lower()]
    whole = F.lower(F.concat_ws("\n", *NODE_WEIGHTS))
    hit = reduce(lambda a, b: a & b, [whole.contains(t) for t in terms])
    return nodes.filter(hit).orderBy("name", "id").limit(request.cap)


def exact_hits(g: Graph, request: Request) -> DataFrame:
    q = request.text.strip('"')
    nodes = visible(g.nodes("kind", "name", "file_path", "qualified_name"), request)
    hit = (F.col("id") == q) | (F.col("file_path") == q) | (F.col("qualified_name") == q) | (F.lower("name") == q.lower())
    return nodes.filter(hit).orderBy("id").limit(request.cap)


def filename_hits(g: Graph, request: Request) -> DataFrame:
    q = request.text.strip('"').strip().lower()
    docs = visible(g.nodes("kind", "file_path"), request).filter("kind = 'document'")
    if not q or re.search(r"\s", q):
        return docs.limit(0)
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    return docs.filter(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "") == q).orderBy("file_path").limit(request.cap)


def tag_hits(g: Graph, terms: list[str]) -> DataFrame:
    """(id, n_terms): documents tagged with the terms."""
    tags = g.nodes("kind", "name").filter(F.col("kind") == "tag").select(F.col("id").alias("target"), F.lower("name").alias("tag"))
    tags = tags.filter(F.col("tag").isin(terms) if terms else F.lit(False))
    return g.edges.filter("kind = 'tagged'").join(tags, "target").groupBy(F.col("source").alias("id")).agg(F.countDistinct("tag").alias("n_terms"))


def definition_hits(g: Graph, request: Request, terms: list[str]) -> DataFrame:
    """(id, n_terms): where matching definitions stand: the definition, its document or its parent, by the asked kind."""
    nodes = g.nodes("kind", "name", "file_path")
    matching = nodes.filter("kind = 'definition'").select(
        "id", "file_path", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.lower("name").contains(t), t) for t in terms]))).alias("term")
    )
    if request.kind == "definition":
        place = matching.select("id", "term")
    elif request.kind == "document":
        place = matching.select(F.col("file_path").alias("id"), "term")
    else:
        parents = g.edges.filter("kind = 'contains'").select(F.col("target").alias("id"), "source")
        place = matching.join(parents, "id", "left").select(F.coalesce("source", "file_path").alias("id"), "term")
    real = visible(nodes, request).select("id")
    return place.distinct().groupBy("id").agg(F.count("*").alias("n_terms")).join(real, "id")


def _day(c: str) -> Column:
    return F.try_to_date(F.regexp_extract(F.trim(F.col(c)), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def matching(g: Graph, ids: DataFrame, request: Request) -> DataFrame:
    """The rows of ``ids`` whose own governance and research rows meet every filter of the request.

    A value must be equal but for case and surrounding blanks, and a node without the row fails.  An audience passes where the
    node is public or its list names it, ``all``, ``*`` or ``public``.  As of a day, what takes effect later and
    research that has lapsed drop out; nodes without dates stay.
    """
    if not request.filters:
        return ids
    gov, res = g.governance.select(F.col("node_id").alias("id"), *GOVERNANCE), g.research.select(F.col("node_id").alias("id"), *RESEARCH)
    rows = ids.join(gov, "id", "left").join(res, "id", "left")
    signal = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for name, value in request.filters.items():
        wanted = value.strip().lower()
        if not wanted:
            continue
        if name in EQUAL_FILTERS:
            rows = rows.filter(signal(F.col(name)) == wanted)
        elif name == "allowed_audience":
            listed = F.transform(F.split(F.regexp_replace("allowed_audience", r"""[\[\]"']""", ""), r"[,;\n]"), signal)
            rows = rows.filter((signal(F.col("sensitivity")) == "public") | F.coalesce(F.arrays_overlap(listed, F.array(*map(F.lit, (wanted, "all", "*", "public")))), F.lit(False)))
        else:
            day = F.lit(wanted).cast("date")
            rows = rows.filter(~F.coalesce(_day("effective_date") > day, F.lit(False)) & ~F.coalesce(_day("valid_until") < day, F.lit(False)))
    return rows.select(*ids.columns)


def entity_hits(g: Graph, request: Request, mentioned: DataFrame) -> DataFrame:
    """(id): nodes that mention the asked entity, or any entity of the asked type; ``mentioned`` (entity_id, entity_type, node_id)."""
    asked = F.col("entity_id") == request.entity_id if request.entity_id else F.col("entity_type") == request.entity_type
    return mentioned.filter(asked).select(F.col("node_id").alias("id")).distinct()


def filtered_hits(g: Graph, request: Request) -> DataFrame:
    """Documents that meet the filters and hold every term."""
    docs = g.nodes("kind", *NODE_WEIGHTS).filter("kind = 'document'")
    kept = docs.join(matching(g, docs.select("id"), request), "id", "left_semi")
    kept = kept.join(sections(g).select(F.col("node_id").alias("id"), "text"), "id", "left")
    own, text = F.lower(F.concat_ws("\n", *NODE_WEIGHTS)), F.lower(F.coalesce("text", F.lit("")))
    every = lambda c: reduce(lambda a, b: a & b, [c.contains(t) for t in request.terms], F.lit(True))
    return kept.filter(every(own) | every(text)).select("id", "name").orderBy("id").limit(request.cap)


def expansion_names(g: Graph, term: str, most: int = 12) -> DataFrame:
    rows = g.nodes("kind", "name").filter(F.col("kind").isin("heading", "definition", "tag") & F.lower("name").contains(term))
    return rows.select("name").distinct().orderBy(F.length("name"), "name").limit(most)


def expand(g: Graph, request: Request, most: int = 32) -> list[str]:
    """Further terms from the names that contain a term: twelve names per term come to the driver."""
    seen, out = set(request.terms), []
    if not request.terms:
        return out
    parts = [expansion_names(g, term).select(F.lit(i).alias("i"), "name") for i, term in enumerate(request.terms)]  # one job for all terms
    for row in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda r: (r["i"], len(r["name"] or ""), r["name"] or "")):
        for more in query_terms(row["name"] or ""):
            if more not in seen and len(out) < most:
                seen.add(more)
                out.append(more)
    return out


def candidates(g: Graph, request: Request, expanded: list[str], mentioned: DataFrame | None = None) -> DataFrame:
    """(id, score, rank, sources, filename) of all collectors, merged by id and held to the filters."""
    terms = [*request.terms, *expanded]
    boost = F.when(F.col("rank") < 0, F.least(-F.col("rank"), F.lit(BOOST_CAP))).otherwise(1 / (1 + F.col("rank")))
    parts = []
    if request.short:
        parts.append(_candidates(short_hits(g, request), "node_like", F.lit(4.0)))
    else:
        parts.append(_candidates(node_hits(g, request, terms), "node_fts", boost, F.col("rank")))
        parts.append(_candidates(section_hits(g, request, terms), "section_fts", boost, F.col("rank")))
    if request.intent in ("exact", "section"):
        parts.append(_candidates(exact_hits(g, request), "exact", F.lit(80.0)))
    if request.kind in ("", "document"):
        parts.append(_candidates(filename_hits(g, request), "filename", F.lit(0.0)))
        parts.append(_candidates(tag_hits(g, terms).orderBy(F.col("n_terms").desc(), "id").limit(request.cap), "tag", F.col("n_terms") * 24))
    if request.kind in ("", "definition", "heading", "document"):
        hits = definition_hits(g, request, request.terms).orderBy(F.col("n_terms").desc(), "id").limit(request.cap)
        parts.append(_candidates(hits, "definition_context", F.col("n_terms") * 18))
    if request.filters:
        parts.append(_candidates(filtered_hits(g, request), "metadata_filter", F.lit(16.0)))
    if mentioned is not None and (request.entity_id or request.entity_type):
        parts.append(_candidates(entity_hits(g, request, mentioned).orderBy("id").limit(request.cap), "entity_filter", F.lit(16.0)))
    merged = reduce(DataFrame.unionByName, parts).groupBy("id")
    found = merged.agg(F.sum("score").alias("score"), F.min("rank").alias("rank"), F.sort_array(F.collect_set("source")).alias("sources"))
    return matching(g, found, request)


def graph_signals(g: Graph, ids: DataFrame, terms: list[str]) -> DataFrame:
    """(id, n_in, n_out, n_tags): of a document over all nodes of its file, of other nodes their own."""
    nodes = g.nodes("kind", "file_path")
    asked = nodes.join(F.broadcast(ids), "id", "left_semi")  # candidates: at most the cap times the number of collectors
    members = nodes.select(F.col("id").alias("member"), "file_path").join(F.broadcast(asked.filter("kind = 'document'").select("id", "file_path")), "file_path")
    watched = members.select("id", "member").union(asked.filter("kind <> 'document'").select("id", F.col("id").alias("member")))
    refs = g.edges.filter(F.col("kind").isin(REFERENCES)).select("source", "target")
    into = refs.join(watched, refs["target"] == watched["member"]).groupBy("id").agg(F.count("*").alias("n_in"))
    out = refs.join(watched, refs["source"] == watched["member"]).groupBy("id").agg(F.count("*").alias("n_out"))
    tags = tag_hits(g, terms).select("id", F.col("n_terms").alias("n_tags"))
    return asked.select("id").join(into, "id", "left").join(out, "id", "left").join(tags, "id", "left").na.fill(0)


def _hits(c: str, terms: list[str], weight: float) -> Column:
    low = F.lower(F.coalesce(F.col(c), F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(low.contains(t), weight).otherwise(0.0) for t in terms], F.lit(0.0))


def field_score(request: Request, expanded: list[str]) -> Column:
    q, total = request.text.lower(), F.lit(0.0)
    for c, w in FIELD_WEIGHTS.items():
        low = F.lower(F.coalesce(F.col(c), F.lit("")))
        total = total + (F.when(low.contains(q), 3 * w).otherwise(0.0) if q else F.lit(0.0)) + _hits(c, request.terms, w)
    for c, w in EXPANSION_WEIGHTS.items():
        total = total + _hits(c, expanded, w)
    heading = F.col("kind") == "heading"
    total = total + F.when(heading & F.array_contains("sources", "section_fts"), 8.0).otherwise(0.0)
    total = total + F.when(F.col("kind") == "definition", 5.0).otherwise(0.0)
    if request.intent == "exact":
        bare = request.text.strip('"').lower()
        total = total + F.when((F.lower("name") == bare) | (F.lower("file_path") == bare) | (F.lower("qualified_name") == bare), 40.0).otherwise(0.0)
    if request.intent == "section":
        total = total + F.when(heading, 12.0).otherwise(0.0)
    return total


def search(g: Graph, request: Request, expanded: list[str] | None = None, mentioned: DataFrame | None = None) -> DataFrame:
    """The ranked hits: place, id, kind, name, file_path, start_line, score.

    The collectors share one stored table of newest nodes; the candidates, a few hundred, are stored before they
    meet their rows, their edges and their history.
    """
    g = g.settled()
    expanded = expand(g, request) if expanded is None else expanded
    found = stored(candidates(g, request, expanded, mentioned), "search-candidates")
    rows = g.nodes("kind", "name", "qualified_name", "file_path", "start_line", "metadata", "body_excerpt").join(F.broadcast(found), "id")
    rows = rows.join(sections(g).select(F.col("node_id").alias("id"), "heading_path", "text"), "id", "left")
    rows = rows.join(graph_signals(g, found.select("id"), request.terms), "id", "left").na.fill(0, ["n_in", "n_out", "n_tags"])
    rows = rows.join(g.history.select(F.col("path").alias("file_path"), "commit_count"), "file_path", "left")
    graph = F.least(3 * F.log1p("n_in"), F.lit(12.0)) + F.least(1.25 * F.log1p("n_out"), F.lit(5.0)) + 8 * F.col("n_tags")
    history = F.when(F.col("commit_count") > 0, F.least(2.5 * F.log1p("commit_count"), F.lit(7.0))).otherwise(0.0)
    score = F.round(F.col("score") + field_score(request, expanded) + graph + history, 6)
    first = F.array_contains("sources", "filename")
    top = rows.select("id", "kind", "name", "file_path", "start_line", score.alias("score"), first.alias("by_name"))
    top = top.orderBy(F.col("by_name").desc(), F.col("score").desc(), "file_path", "start_line", "id").limit(request.limit)
    w = Window.orderBy(F.col("by_name").desc(), F.col("score").desc(), "file_path", "start_line", "id")  # no more than `limit` rows
    return top.withColumn("place", F.row_number().over(w)).drop("by_name")


def fan_out(hits: DataFrame, project: Column, limit: int, order: list) -> DataFrame:
    """The best 2 x limit hits of each project, merged and cut to ``limit``."""
    w = Window.partitionBy(project).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * limit).drop("_n").orderBy(*order).limit(limit)
