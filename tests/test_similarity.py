import math
import random

import pytest

from paperloom.operators import similarity as s


def vectors(rng, n):
    words = [f"common{i}" for i in range(3)] + [f"w{i}" for i in range(40)]
    return {i: {w: rng.random() for w in words[:3] + rng.sample(words[3:], rng.randrange(1, 6))} for i in range(n)} | {n: {"common0": 1.0}, n + 1: {"common0": 1.0, "common1": 0.1}}


@pytest.mark.parametrize("least", [0.2, 0.6, 0.9])
def test_cosine_pairs_against_brute_force(spark, least):
    data = vectors(random.Random(int(least * 10)), 80)
    df = spark.createDataFrame([(i, t, w) for i, v in data.items() for t, w in v.items()], "id long, term string, weight double")
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in data.items()}
    want = {}
    for a in data:
        for b in data:
            if a < b:
                c = sum(w * data[b].get(t, 0) for t, w in data[a].items()) / norm[a] / norm[b]
                if round(c, 6) >= least:
                    want[a, b] = c
    got = {(r.a, r.b): r.cosine for r in s.cosine_pairs(df, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_composite(spark, least):
    rng = random.Random(5)
    words = "plan report audit table review index notes".split()
    rows = [(f"d{i}", " ".join(rng.choices(words, k=5)), [f"t{rng.randrange(4)}"] if i % 3 else [], [rng.choice("xy")]) for i in range(30)]
    rows += [("z1", rows[0][1], rows[0][2], rows[0][3]), ("z2", None, [], [])]
    feats = spark.createDataFrame(rows, "id string, text string, targets array<string>, tags array<string>")
    got = {(r.source, r.target): r.score for r in s.composite_pairs(feats, least).collect()}
    weights = {}
    for r in s.tfidf(feats.select("id", "text")).collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    cls = {r.id: r.class_id for r in s.classes(feats).collect()}
    assert cls["z1"] == "d0"
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and cls[a[0]] == a[0] and cls[b[0]] == b[0]:
                va, vb = weights.get(a[0], {}), weights.get(b[0], {})
                na, nb = (math.sqrt(sum(w * w for w in v.values())) for v in (va, vb))
                c = sum(w * vb.get(t, 0) for t, w in va.items()) / (na * nb) if na and nb else 0.0
                score = 0.5 * c + 0.3 * jac(a[2], b[2]) + 0.2 * jac(a[3], b[3])
                if round(score, 6) >= least:
                    want[a[0], b[0]] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.005 + 1e-9 for k in want)


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "The Plan, é ist 監査報告 x a1")], "id int, text string")
    assert df.select(s.tokens(df.text).alias("t")).first().t == ["plan", "é", "ist", "監査", "査報", "報告", "a1"]
    empty = spark.createDataFrame([], "id string, text string, targets array<string>, tags array<string>")
    assert s.composite_pairs(empty, 0.7).count() == 0


def test_nearest_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    data[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(400, None), (None, [1.0] * 8), (500, [])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {(r.query, r.place): (r.neighbour, r.score) for r in s.nearest_vectors(df, "i", "v", 20, 5, block=64).collect()}
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)
    for q in range(0, 300, 20):
        scores = np.round(unit[q] @ unit.T, 4)
        order = [j for j in sorted(range(300), key=lambda j: (-scores[j], j)) if j not in (q, 7)][:5]
        assert [got[q, k + 1][0] for k in range(5)] == order


@pytest.mark.parametrize("block", [4096, 7])
def test_block_pairs_against_brute_force(spark, block):
    rng = random.Random(block)
    data = {}
    for i in range(60):
        terms = {t: rng.random() for t in ["hot"] * (i % 2) + rng.sample([f"w{k}" for k in range(12)], rng.randrange(0, 5))}
        norm = math.sqrt(sum(w * w for w in terms.values()))
        data[f"d{i:02d}"] = ({t: w / norm for t, w in terms.items()}, {"hub"} if i % 3 else {f"t{i % 4}", "hub"} if i % 2 else set(), {rng.choice("xyz")} if i % 4 else set())
    df = spark.createDataFrame([(i, list(w), list(w.values()), sorted(t), sorted(g)) for i, (w, t, g) in data.items()],
                               "id string, terms array<string>, weights array<double>, targets array<string>, tags array<string>")
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {}
    for a, (wa, ta, ga) in data.items():
        for b, (wb, tb, gb) in data.items():
            score = 0.5 * sum(w * wb.get(t, 0) for t, w in wa.items()) + 0.3 * jac(ta, tb) + 0.2 * jac(ga, gb)
            if a < b and score >= 0.25 - 5e-7:
                want[a, b] = score
    rows = s.block_pairs(df, 0.25, block, 5).collect()
    got = {(r.a, r.b): r.score for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = {f"d{i:02d}" for i in range(0, 60, 7)}
    rows = s.block_pairs(df, 0.25, block, 5, spark.createDataFrame([(i,) for i in some], "id string")).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(k for k in want if some & set(k))


def test_refresh_scores_only_what_changed(spark, monkeypatch):
    schema = "id string, text string, targets array<string>, tags array<string>"
    docs = [(f"d{i:02d}", " ".join(f"w{(i * k) % 11}" for k in range(1, 6)), ["t"] if i % 2 else [], ["x"] if i % 3 else []) for i in range(30)]
    before = s.composite_pairs(spark.createDataFrame(docs, schema), 0.25).cache()
    docs[3], docs[8] = ("d03", "new words here", [], []), ("d08", docs[9][1] + " w1", ["t"], ["x"])
    feats, changed = spark.createDataFrame(docs, schema), spark.createDataFrame([("d03",), ("d08",), ("gone",)], "id string")
    pairs = lambda df: {(r.source, r.target) for r in df.collect()}
    full, asked, make = pairs(s.composite_pairs(feats, 0.25)), [], s.composite_pairs
    monkeypatch.setattr(s, "composite_pairs", lambda f, least, ids=None: asked.append(ids is None) or make(f, least, ids))
    got = pairs(s.refresh(before, changed, feats, 0.25, 0.25))
    assert asked == [False] and {p for p in got if {"d03", "d08"} & set(p)} == {p for p in full if {"d03", "d08"} & set(p)}
    assert {p for p in got if not {"d03", "d08"} & set(p)} == {p for p in pairs(before) if not {"d03", "d08"} & set(p)}
    assert pairs(s.refresh(before, changed, feats, 0.25, 0.3)) == full and asked[-1]
    assert s.refresh(before, changed.limit(0), feats, 0.25, 0.25) is before


def shuffled(spark, work):
    """Bytes that ``work`` writes to shuffle files."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    work()
    return written() - before


def test_shuffle_does_not_grow_with_blocks_or_pairs(spark, tmp_path):
    rng = random.Random(1)
    terms = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(600)]
    rows = spark.createDataFrame([(f"d{i:03d}", t, [1.0] * 30, [], ["x"]) for i, t in enumerate(terms)], "id string, terms array<string>, weights array<double>, targets array<string>, tags array<string>").cache()
    one, twenty = (shuffled(spark, s.block_pairs(rows, 0.9, block).count) for block in (600, 30))
    assert 0 < twenty < 3 * one
    few = spark.createDataFrame([(f"d{i}", f"w{i} w{i + 1}", [], ["x"]) for i in range(20)], "id string, text string, targets array<string>, tags array<string>").cache()
    n = 300_000
    spark.range(n).selectExpr("sha2(string(id), 256) as source", "sha2(string(-id), 256) as target", "0.5 as score").write.parquet(f"{tmp_path}/pairs")
    changed = few.limit(2).select("id").cache()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        got = shuffled(spark, lambda: out.append(s.refresh(spark.read.parquet(f"{tmp_path}/pairs"), changed, few, 0.9, 0.9).count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert out == [n] and got < 5_000_000


def test_refresh_replaces_pairs_of_a_changed_class(spark):
    schema = "id string, text string, targets array<string>, tags array<string>"
    docs = [(f"d{i:02d}", " ".join(f"w{(i * k) % 11}" for k in range(1, 6)), ["t"] if i % 2 else [], ["x"] if i % 3 else []) for i in range(10)]
    before = s.composite_pairs(spark.createDataFrame(docs, schema), 0.25)
    stale = before.limit(1).withColumns({"source": s.F.lit("d01"), "target": s.F.lit("d99")})
    docs[7] = ("d07", *docs[1][1:])
    feats, changed = spark.createDataFrame(docs, schema), spark.createDataFrame([("d07",)], "id string")
    of = lambda df: sorted((r.source, r.target, r.score) for r in df.collect() if {"d01", "d07"} & {r.source, r.target})
    got = of(s.refresh(before.unionByName(stale), changed, feats, 0.25, 0.25))
    assert got and got == of(s.composite_pairs(feats, 0.25))


def test_similarity_edges_are_deleted_by_document_and_engine(spark):
    rows = [("a", "b", "similar_to", None), ("c", "a", "similar_to", '{"engine": "neural"}'), ("b", "c", "similar_to", None), ("a", "b", "references", None), ("a", None, None, None)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, metadata string")
    ids = spark.createDataFrame([("a",)], "id string")
    left = lambda *engine: sorted((r.source, str(r.target), str(r.kind)) for r in s.without(edges, ids, *engine).collect())
    rest = [("a", "None", "None"), ("a", "b", "references"), ("b", "c", "similar_to")]
    assert left() == rest and left("neural") == sorted([*rest, ("a", "b", "similar_to")])


def test_registered_threshold_is_that_of_the_reference():
    from paperloom.plans import graph_queries

    assert graph_queries.SIMILAR == 0.25
