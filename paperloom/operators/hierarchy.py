"""Parent-child links of unknown depth to full hierarchies (problem 4).

Connected components of the links are found first, each component is co-located, and an iterative
depth-first traversal with node colouring walks it once: white nodes are unseen, grey ones lie on
the current branch, black ones are done; an edge into a grey node is a back edge and names a cycle.
Components with more than ``MAX_COMPONENT`` nodes are not brought into one task: they are solved by
pointer doubling, which gives the same root, depth, descendant count and cycle (and the same path)
from logarithmically many equality joins.

Defined results: a node without parent is a root of depth 0; a node given several parents keeps the
least one (``further_parents`` gives them all); a name that fits several documents means the least id
(``ambiguous_names`` gives them all); a parent that never occurs as child is a root; nodes on or below a cycle have root '' and
depth -1; null and blank ids are no nodes; repeated links count once; no links give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.graph_tables import existing_nodes, newest_metadata, running, stem
from paperloom.session import cut

MAX_COMPONENT = 200_000
MAX_LEVEL = 10
BLOCK_LINES = 4096

_OUT = "component string, node string, parent string, root string, depth long, path array<string>, n_descendants long, on_cycle boolean"


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``links`` (a, b); the component is its least node.

    Alternating large-star and small-star rounds: each needs two pre-aggregated shuffles, and the
    number of rounds grows with the logarithm of the longest path.  Every round is cut by a
    checkpoint, and the loop stops when a round changes no link.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = cut(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select("v", "m").union(least.select(F.col("u"), "m"))
        edges = cut(small.toDF("u", "v").filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _walk(component: str, parents: dict[str, str | None], with_paths: bool) -> list[tuple]:
    """Iterative depth-first traversal of one component; ``parents`` has every node of it."""
    children: dict[str, list[str]] = {}
    for node, parent in parents.items():
        if parent is not None:
            children.setdefault(parent, []).append(node)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(parents, white)
    out, cyclic = {}, set()

    def descend(start: str, root: str | None) -> None:
        stack, path, size = [(start, iter(children.get(start, ())))], [start], {start: 0}
        colour[start] = grey
        while stack:
            node, rest = stack[-1]
            below = next(rest, None)
            if below is None:
                stack.pop()
                colour[node] = black
                out[node] = (root or "", len(path) - 1 if root is not None else -1, list(path) if with_paths and root is not None else None, size[node])
                path.pop()
                if stack:
                    size[stack[-1][0]] += size[node] + 1
            elif colour[below] == grey:  # back edge: the branch from `below` down to `node` is a circle
                cyclic.update(path[path.index(below) :])
            elif colour[below] == white:
                colour[below] = grey
                size[below] = 0
                path.append(below)
                stack.append((below, iter(children.get(below, ()))))

    for node in sorted(n for n, p in parents.items() if p is None):
        descend(node, node)
    for node in sorted(parents):  # what no root reaches lies on or below a circle: start on the circle
        if colour[node] == white:
            seen, at = set(), node
            while at not in seen:
                seen.add(at)
                at = parents[at]
            circle, step = [at], parents[at]
            while step != at:
                circle.append(step)
                step = parents[step]
            descend(min(circle), None)
    reached = max((out[n][3] for n in cyclic), default=0)
    for node in cyclic:  # every node of a circle reaches all that the circle reaches
        out[node] = (*out[node][:3], reached)
    return [(component, n, parents[n], r, d, p, s, n in cyclic) for n, (r, d, p, s) in out.items()]


def _walk_all(with_paths: bool):
    names = ["component", "node", "parent", "root", "depth", "path", "n_descendants", "on_cycle"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parents, rows = None, {}, []
        for batch in batches:
            for component, node, parent in zip(batch["component"], batch["node"], batch["parent"]):
                if component != current:
                    rows += _walk(current, parents, with_paths) if parents else []
                    current, parents = component, {}
                parents[node] = parent
                if parent is not None:
                    parents.setdefault(parent, None)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        rows += _walk(current, parents, with_paths) if parents else []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _jump(links: DataFrame, rounds: int, with_paths: bool) -> DataFrame:
    """(node, up, steps, above): pointers after 2**rounds steps towards the root, or at the root."""
    at_root = F.col("parent").isNull()
    above = F.when(at_root, F.array().cast("array<string>")).otherwise(F.array("parent"))
    state = cut(links.select("node", F.coalesce("parent", "node").alias("up"), F.when(at_root, 0).otherwise(1).cast("long").alias("steps"),
                             (above if with_paths else F.lit(None).cast("array<string>")).alias("above")))
    for _ in range(rounds):
        jump = state.toDF("up", "up2", "steps2", "above2")
        state = cut(state.join(jump, "up").select("node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"),
                                                  F.concat("above2", "above").alias("above")))
    return state


def _below(forest: DataFrame, rounds: int) -> DataFrame:
    """(node, _below): the number of nodes under each node that has some.

    Weights are pushed up by steps of doubling length: before a round a node's weight counts the nodes up to
    2**k - 1 steps below it; it then adds the weights of those whose pointer of 2**k steps ends at it.
    """
    state = cut(forest.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("w")))
    for _ in range(rounds):
        sums = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("w").alias("more"))
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        state = cut(state.join(sums, "node", "left").join(jump, "up", "left").select("node", F.col("up2").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
    return state.filter("w > 1").select("node", (F.col("w") - 1).alias("_below"))


def _doubling(links: DataFrame, with_paths: bool) -> DataFrame:
    """Components too large for one task: jump pointers of doubling length until all end at a root."""
    rounds = math.ceil(math.log2(max(2, links.count()))) + 1
    roots = links.filter("parent is null").select(F.col("node").alias("up"), F.lit(True).alias("_ends"))
    ended = cut(_jump(links, rounds, False).drop("above").join(roots, "up", "left"))
    # after that many steps whatever has not ended stands on a circle, and circle nodes cover it
    circle = ended.filter("_ends is null").select(F.col("up").alias("node"), F.lit(True).alias("_circle")).distinct()
    done = links.join(ended, "node").join(circle, "node", "left")
    done = done.select(
        "component", "node", "parent", F.when(F.col("_ends"), F.col("up")).otherwise("").alias("root"),
        F.when(F.col("_ends"), F.col("steps")).otherwise(-1).alias("depth"), F.coalesce("_circle", F.lit(False)).alias("on_cycle"),
    )
    done = cut(done)
    opened = done.select("node", F.when(~F.col("on_cycle"), F.col("parent")).alias("parent"))  # circles cut open: a forest
    size = done.groupBy("component").agg((F.count("*") - 1).alias("_others"))
    done = done.join(_below(opened, rounds), "node", "left").join(size, "component")
    if with_paths:
        done = done.join(cut(_jump(opened, rounds, True).select("node", F.concat("above", F.array("node")).alias("path"))), "node")
    else:
        done = done.withColumn("path", F.lit(None).cast("array<string>"))
    return done.select(
        "component", "node", "parent", "root", "depth", F.when(F.col("depth") >= 0, F.col("path")).alias("path"),
        F.when(F.col("on_cycle"), F.col("_others")).otherwise(F.coalesce("_below", F.lit(0))).alias("n_descendants"), "on_cycle",
    )


def build_hierarchy(
    links: DataFrame, component: str | None = None, with_paths: bool = True, max_component: int = MAX_COMPONENT
) -> DataFrame:
    """(component, node, parent, root, depth, path, n_descendants, on_cycle) of links (node, parent).

    ``component`` names a column that already tells components apart (say, the file of a heading);
    without it they are computed.  Of a node with several parents the least is its parent here;
    :func:`further_parents` lists the others.
    """
    real = links.filter("trim(node) <> ''")
    given = [F.col(component).alias("component")] if component else []
    clean = real.select("node", F.when(F.trim("parent") != "", F.col("parent")).alias("parent"), *given)
    keys = ["node", *(["component"] if component else [])]
    clean = clean.groupBy(*keys).agg(F.min("parent").alias("parent"))
    if component is None:
        clean = cut(clean)
        parts = connected_components(clean.filter("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")))
        clean = clean.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # parents that are nobody's child become roots of the same component
    extra = clean.filter("parent is not null").select("component", F.col("parent").alias("node")).distinct()
    extra = extra.join(clean.select("component", "node"), ["component", "node"], "left_anti").withColumn("parent", F.lit(None).cast("string"))
    everything = cut(clean.select("component", "node", "parent").unionByName(extra))
    sizes = everything.groupBy("component").count()
    large = sizes.filter(F.col("count") > max_component).select("component")
    small = everything
    if not large.isEmpty():
        large = cut(large)
        small = everything.join(large, "component", "left_anti")
    placed = small.repartition("component").sortWithinPartitions("component", "node")
    walked = placed.mapInPandas(_walk_all(with_paths), _OUT)
    if small is everything:
        return walked
    return walked.unionByName(_doubling(everything.join(large, "component", "left_semi"), with_paths))


def further_parents(links: DataFrame) -> DataFrame:
    """(node, parent, n_parents): every stated parent of the nodes that have more than one, the one that counts included."""
    real = links.filter("trim(node) <> '' and trim(parent) <> ''").select("node", "parent").distinct()
    several = real.groupBy("node").agg(F.count("*").alias("n_parents")).filter("n_parents > 1")
    return real.join(several, "node")


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(root, node, descendant, distance) for every node above another; from the paths, no join.

    Nodes on or below a circle have no path; :func:`circle_descendants` lists theirs.
    """
    pairs = hierarchy.filter("path is not null and depth > 0").select(
        "root", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node")
    )
    return pairs.filter("at < depth").select("root", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def circle_descendants(hierarchy: DataFrame) -> DataFrame:
    """(root, node, descendant, distance) of nodes on or below a circle; root is ''.

    Each circle is cut open above its least node, and pointer doubling gives every node the path from
    there.  The path holds some of the nodes above; the others are the circle's nodes after the point
    where the path leaves it, and reach the node by way of the cut.  A node is not below itself.
    """
    looped = cut(hierarchy.filter("depth = -1").select("component", "node", "parent", "on_cycle"))
    circles = looped.filter("on_cycle").groupBy("component").agg(F.min("node").alias("node"), F.count("*").alias("length"))
    most = looped.groupBy("component").count().agg(F.max("count")).first()[0]
    opened = looped.join(circles.select("node", F.lit(True).alias("_cut")), "node", "left").select("node", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"))
    rounds = math.ceil(math.log2(max(2, most or 0)))
    paths = _jump(opened, rounds, True).select("node", F.concat("above", F.array("node")).alias("path"))
    paths = cut(looped.join(paths, "node").select("component", F.col("node").alias("descendant"), "on_cycle", "path", (F.size("path") - 1).alias("at")))
    on_path = paths.select("descendant", "at", F.posexplode("path").alias("above", "node")).filter("above < at")
    on_path = on_path.select("node", "descendant", (F.col("at") - F.col("above")).alias("distance"))
    around = paths.filter("on_cycle").select("component", F.col("descendant").alias("node"), F.col("at").alias("place")).join(circles.select("component", "length"), "component")
    by_cut = paths.join(around, "component").filter(~F.array_contains("path", F.col("node")))
    by_cut = by_cut.select("node", "descendant", (F.col("length") - F.col("place") + F.col("at")).alias("distance"))
    return on_path.unionByName(by_cut).select(F.lit("").alias("root"), "node", "descendant", F.col("distance").cast("long").alias("distance"))


def outline_links(nodes: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(node, parent, file_path): each existing heading under the nearest smaller level above it.

    Files are cut into blocks of lines.  Within a block a running window keeps the last heading of
    each level; what earlier blocks leave open is carried in from per-block summaries, so one huge
    file spreads over many tasks.  Levels outside 1..10 count as the nearest of these.
    """
    heads = existing_nodes(nodes.filter("kind = 'heading' or kind = 'document'"), ["kind", "file_path", "start_line", "level"])
    heads = heads.filter("kind = 'heading'").select(
        "id", "file_path", F.coalesce("start_line", F.lit(0)).alias("line"),
        F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(MAX_LEVEL)).alias("level"),
    )
    heads = heads.withColumn("block", F.floor(F.col("line") / block_lines).cast("int"))
    levels = range(1, MAX_LEVEL)
    own = {f"in_{k}": F.when(F.col("level") == k, F.struct("line", "id")) for k in levels}
    within = running(["file_path", "block"], "line")
    here = heads.withColumns({c: F.last(x, ignorenulls=True).over(within) for c, x in own.items()})
    summary = heads.groupBy("file_path", "block").agg(*[F.max(x).alias(c.replace("in", "end")) for c, x in own.items()])
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("file_path", "block", *[F.last(f"end_{k}", ignorenulls=True).over(earlier).alias(f"from_{k}") for k in levels])
    joined = here.join(carry, ["file_path", "block"])
    nearest = F.array_max(F.array_compact(F.array(*[F.when(F.col("level") > k, F.coalesce(f"in_{k}", f"from_{k}")) for k in levels])))
    return joined.select(F.col("id").alias("node"), F.coalesce(nearest["id"], "file_path").alias("parent"), "file_path")


def supersession_links(nodes: DataFrame, governance: DataFrame) -> DataFrame:
    """(node, parent): each existing document under the existing document that supersedes it.

    Both ends of the relation are read; names are paths or file stems, any case, bare or as
    wikilinks, one or several in a value.
    """
    docs = existing_nodes(nodes.filter("kind = 'document'"), ["file_path"])
    path, bare = F.lower("file_path"), F.lower(stem(F.col("file_path")))
    names = docs.select("id", F.explode(F.array_distinct(F.array(path, bare, F.concat(bare, F.lit(".md")), F.regexp_replace(path, r"\.md$", "")))).alias("name"))
    # a name that fits several documents means the one with the least id
    names = names.groupBy("name").agg(F.min("id").alias("id"))
    rows = newest_metadata(governance, ["supersedes", "superseded_by"])

    def named(field: str) -> DataFrame:
        flat = F.regexp_replace(F.col(field), r'[\[\]"]', "")
        texts = rows.filter(F.trim(flat) != "").select(F.col("node_id").alias("own"), F.explode(F.split(flat, r"[,;\n]")).alias("t"), F.lit(field).alias("field"))
        name = F.regexp_replace(F.trim(F.regexp_extract(F.lower("t"), r"^([^|#]*)", 1)), r"\\", "/")
        return texts.select("own", "field", F.regexp_replace(name, r"^(?:\./)+", "").alias("name")).filter("name <> ''")

    stated = named("supersedes").union(named("superseded_by"))
    stated = stated.join(names, "name").join(docs.select(F.col("id").alias("own")), "own", "left_semi")
    by_other = F.col("field") == "superseded_by"
    return stated.select(
        F.when(by_other, F.col("own")).otherwise(F.col("id")).alias("node"),
        F.when(by_other, F.col("id")).otherwise(F.col("own")).alias("parent"),
    ).distinct()


def ambiguous_names(nodes: DataFrame) -> DataFrame:
    """(name, id, n_documents): names by which a supersession could mean more than one document."""
    docs = existing_nodes(nodes.filter("kind = 'document'"), ["file_path"])
    names = docs.select(F.lower(stem(F.col("file_path"))).alias("name"), "id").distinct()
    several = names.groupBy("name").agg(F.count("*").alias("n_documents")).filter("n_documents > 1")
    return names.join(several, "name")


def trees(nodes: DataFrame, governance: DataFrame, with_paths: bool = True) -> DataFrame:
    """Both trees of the collection: tree, node_id, parent, root_id, depth, path, n_descendants, on_cycle."""
    outline = build_hierarchy(outline_links(nodes), "file_path", with_paths).filter("depth > 0")
    chain = build_hierarchy(supersession_links(nodes, governance), None, with_paths)
    columns = ["parent", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path", "n_descendants", "on_cycle"]
    named = lambda df, tree: df.select(F.lit(tree).alias("tree"), F.col("node").alias("node_id"), *columns)
    return named(outline, "outline").unionByName(named(chain, "supersession"))


def tree_descendants(nodes: DataFrame, governance: DataFrame) -> DataFrame:
    """(tree, root, node, descendant, distance) of both trees; the outline has the document above its headings."""
    outline = build_hierarchy(outline_links(nodes), "file_path")
    chain = cut(build_hierarchy(supersession_links(nodes, governance)))
    named = lambda df, tree: df.select(F.lit(tree).alias("tree"), "root", "node", "descendant", "distance")
    below = descendants(chain).unionByName(circle_descendants(chain))
    return named(descendants(outline), "outline").unionByName(named(below, "supersession"))
