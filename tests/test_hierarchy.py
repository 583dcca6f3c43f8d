import random

import pytest

from paperloom.operators import hierarchy as h
from paperloom.operators import outline
from paperloom.tables import Graph


def brute(links):
    parent = {}
    for n, p in links:
        if not n or not n.strip():
            continue
        p = p if p and p.strip() else None
        if p is None:
            parent.setdefault(n, None)
        elif parent.get(n) is None or p < parent[n]:
            parent[n] = p
    for p in list(parent.values()):
        if p is not None:
            parent.setdefault(p, None)
    out = {}
    for n in parent:
        path, at = [n], parent[n]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        below = {x for x in parent if x != n and n in _ups(parent, x)}
        out[n] = (path[-1], len(path) - 1, tuple(reversed(path)), len(below)) if at is None else ("", -1, None, len(below))
    return out, {n for n in parent if n in _ups(parent, n)}


def _ups(parent, n):
    seen, at = [], parent[n]
    while at is not None and at not in seen:
        seen.append(at)
        at = parent[at]
    return seen


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_brute_force(spark, most):
    rng = random.Random(most)
    links = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 25)] + [(f"m{i}", f"m{i + 1}") for i in range(12)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d", "c2"), ("e", "d"), ("s", "s"), ("t", "s"), ("x", None), ("", "y"), (None, "y"), ("z", " ")] + links[:5]
    df = spark.createDataFrame(links, "node string, parent string")
    rows = h.build_hierarchy(df, max_component=most).collect()
    want, circle = brute(links)
    got = {r.node: (r.root, r.depth, tuple(r.path) if r.path else None, r.n_descendants) for r in rows}
    assert got == want
    assert {r.node for r in rows if r.on_cycle} == circle
    slim = {r.node: (r.root, r.depth, r.n_descendants) for r in h.build_hierarchy(df, with_paths=False, max_component=most).collect()}
    assert slim == {n: (w[0], w[1], w[3]) for n, w in want.items()}
    pairs = h.descendants(h.build_hierarchy(df, max_component=most))
    assert pairs.count() == sum(w[1] for w in want.values() if w[1] > 0)


def test_every_parent_is_told(spark):
    links = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "p"), ("c", None), ("a", " ")], "node string, parent string")
    assert {tuple(r) for r in h.further_parents(links).collect()} == {("a", "p", 2), ("a", "q", 2)}
    docs = [node(f"{d}/x.md", "document", f"{d}/X.md") for d in "pq"] + [node("p/y.md", "document", "p/y.md")]
    assert {tuple(r) for r in h.ambiguous_names(spark.createDataFrame(docs, NODES)).collect()} == {("x", "p/x.md", 2), ("x", "q/x.md", 2)}


def test_heading_ends_with_nulls_and_deep_levels(spark, tmp_path):
    rows = [node("f.md", "document", "f.md", 1, 0)[:6] + (40,) + node("f.md", "document", "f.md")[7:]]
    rows += [node("h0", "heading", "f.md", None, 2), node("h1", "heading", "f.md", 5, 11), node("h2", "heading", "f.md", 9, 11), node("h3", "heading", "f.md", 12, None), node("h4", "heading", None, 3, 1)]
    spark.createDataFrame(rows, NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    got = {r.id: r.last_line for r in outline.end_lines(Graph(spark, str(tmp_path))).collect()}
    assert got == {"h0": 11, "h1": 8, "h2": 11, "h3": 40, "h4": None}


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"v{rng.randrange(300):03d}", f"v{rng.randrange(300):03d}") for _ in range(180)] + [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)]
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if group[a] is not group[b]:
            joined = group[a] | group[b]
            for x in joined:
                group[x] = joined
    got = {r.node: r.component for r in h.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: min(g) for x, g in group.items() if len(g) > 1}


def test_empty(spark):
    assert h.build_hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, level int, metadata string, body_excerpt string, updated_at long"


def node(i, kind, file, line=1, level=0, metadata=None, at=1):
    return (i, kind, i, i, file, line, line, level, metadata, None, at)


def test_outline_spread_over_blocks(spark):
    rng = random.Random(7)
    rows, want = [node("f.md", "document", "f.md")], {}
    heads = [(f"f.md#{i}", i * 3 + 1, rng.randrange(1, 7)) for i in range(200)]
    for k, (i, line, level) in enumerate(heads):
        rows.append(node(i, "heading", "f.md", line, level))
        above = [x for x in heads[:k] if x[2] < level]
        want[i] = above[-1][0] if above else "f.md"
    rows += [node("f.md#gone", "heading", "f.md", 5, 1, '{"deleted": true}', 9), node("f.md#gone", "heading", "f.md", 5, 1), rows[3]]
    df = spark.createDataFrame(rows, NODES)
    for size in (4096, 10):
        got = {r.node: r.parent for r in h.outline_links(df, size).collect()}
        assert got == want


def test_supersession_spellings(spark):
    docs = [node(f"p/{x}.md", "document", f"p/{x}.md") for x in ("a", "b", "c", "d", "e")] + [node("p/gone.md", "document", "p/gone.md", metadata='{"deleted": true}')]
    gov = [("p/a.md", "[[B]]", None, 1), ("p/c.md", None, "./p/b.md", 1), ("p/d.md", '["[[p/e.md|old]]", " [[nowhere]] "]', " ", 5), ("p/d.md", "[[a]]", None, 4),
           ("p/e.md", "", "[[e#x]]", 1), ("p/gone.md", "[[a]]", None, 1), (None, "[[a]]", None, 1)]
    df = spark.createDataFrame(gov, "node_id string, supersedes string, superseded_by string, updated_at long")
    got = {(r.node, r.parent) for r in h.supersession_links(spark.createDataFrame(docs, NODES), df).collect()}
    assert got == {("p/b.md", "p/a.md"), ("p/c.md", "p/b.md"), ("p/e.md", "p/d.md"), ("p/e.md", "p/e.md")}
    assert h.trees(spark.createDataFrame([], NODES), df.limit(0)).count() == 0


def test_descendants_of_both_trees(spark):
    docs = [node(f"p/{x}.md", "document", f"p/{x}.md") for x in "ab"]
    heads = [node("h1", "heading", "p/a.md", 1, 1), node("h2", "heading", "p/a.md", 5, 2), node("h3", "heading", "p/a.md", 9, 1)]
    gov = spark.createDataFrame([("p/a.md", None, "b", 1)], "node_id string, supersedes string, superseded_by string, updated_at long")
    got = {tuple(r) for r in h.tree_descendants(spark.createDataFrame(docs + heads, NODES), gov).collect()}
    assert got == {
        ("outline", "p/a.md", "p/a.md", "h1", 1), ("outline", "p/a.md", "p/a.md", "h2", 2), ("outline", "p/a.md", "p/a.md", "h3", 1),
        ("outline", "p/a.md", "h1", "h2", 1), ("supersession", "p/b.md", "p/b.md", "p/a.md", 1),
    }


@pytest.mark.parametrize("most", [200_000, 3])
def test_descendants_on_and_below_circles(spark, most):
    links = [("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c4", "c1"), ("d", "c2"), ("e", "d"), ("f", "d"), ("g", "c4"), ("s", "s"), ("t", "s"), ("u", "t"), ("q1", "q2"), ("q2", "q1"), ("x", "y")]
    parent, want = {**dict(links), "y": None}, {}
    for n in parent:
        for steps, above in enumerate(_ups(parent, n), 1):
            if above != n and n not in ("x", "y"):
                want[above, n] = steps
    made = h.build_hierarchy(spark.createDataFrame(links, "node string, parent string"), max_component=most)
    rows = h.circle_descendants(made).collect()
    assert {(r.node, r.descendant): r.distance for r in rows} == want and len(rows) == len(want)
    counted = {r.node: r.n_descendants for r in made.filter("depth = -1").collect()}
    assert counted == {n: sum(a == n for a, _ in want) for n in counted}
