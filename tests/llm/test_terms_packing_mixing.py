import math
import random
from collections import Counter

import pytest

from paperloom.llm import distinctive, mixing, packing, tokens


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_scores_against_brute_force(spark, frequent):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha Beta ГАММА δ 7x 監査 l'eau".split()) for _ in range(rng.randrange(40))), rng.choice([None, "Name-x", ""]), 9) for i in range(50)]
    rows += [(90, None, None, 9), (91, "", "", 9), (92, "word " * 30_000 + "rare", "x", 9)]
    df = spark.createDataFrame(rows, "tf int, body string, name string, term int")
    got = {(r.key, r.term): r for r in distinctive.score_terms(df, "tf", ["name", "body"], frequent).collect()}
    tf = {i: Counter(t for x in (n, b) if x for t in _words(x)) for i, b, n, _ in rows}
    tf = {i: c for i, c in tf.items() if c}
    df_, cf = Counter(t for c in tf.values() for t in c), Counter()
    for c in tf.values():
        cf.update(c)
    assert set(got) == {(i, t) for i, c in tf.items() for t in c}
    for (i, t), r in got.items():
        want = -math.log2(df_[t] / len(tf)) + math.log2(-math.expm1(-cf[t] / len(tf)))
        assert (r.tf, r.df, r.cf) == (tf[i][t], df_[t], cf[t]) and abs(r.score - r.tf * want) < 1e-9


def _words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def test_no_terms(spark):
    assert distinctive.score_terms(spark.createDataFrame([(1, None)], "i int, t string"), "i", ["t"]).count() == 0


def test_plain_tokens(spark):
    rows = [("a_b 12, c", 4), ("監査をする", 5), ("x監y", 3), ("", 0), (None, 0), (" \u3000\n", 0), ("é!é", 3), ("e\u0301", 2), ("w " * 50_000, 50_000)]
    df = spark.createDataFrame([(t, n) for t, n in rows], "t string, n long").withColumn("got", tokens.plain_tokens("t"))
    assert all(r.got == r.n for r in df.collect())


def test_best_fit_is_exact():
    rng = random.Random(6)
    for most in (4, 64):
        fit, left, open_ = packing.BestFit(100, most), {}, {}
        for _ in range(3000):
            size = rng.randrange(0, 101)
            fits = [(space, b) for b, space in open_.items() if space >= size]
            chosen = fit.place(size)
            if fits:
                assert open_[chosen] == min(fits)[0]
            else:
                assert chosen not in left
            left[chosen] = left.get(chosen, 100) - size
            assert left[chosen] >= 0
            open_ = {b: s for s, bins in fit.free.items() for b in bins}
            assert len(open_) <= most and all(left[b] == s for b, s in open_.items())


def test_packing_keeps_everything(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 30, 99, 100, 101, 250, 1000]) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "tokens int, n long, container_kind string").repartition(3)
    kinds = spark.createDataFrame([("a", 100), ("b", 512), ("bad", None), ("none", 0)], "container_kind string, capacity_tokens int")
    rows = packing.pack(df.withColumnRenamed("tokens", "id"), "id", "n", kinds).toPandas()
    assert set(rows.container_kind) == {"a", "b"}
    for kind, capacity in (("a", 100), ("b", 512)):
        own = rows[rows.container_kind == kind]
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert own.groupby("id").tokens.sum().to_dict() == {i: n or 0 for i, n in enumerate(sizes)}
        assert (own[own.n_pieces > 1].id.unique() == [i for i in own[own.n_pieces > 1].id.unique() if sizes[i] > capacity]).all()
        assert own.tokens.sum() / (own.container_id.nunique() * capacity) > 0.8
    assert packing.pack(df.limit(0).withColumnRenamed("tokens", "id"), "id", "n", kinds).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big", "big", "big", " BIG", "mid", "tiny" if i % 50 == 0 else "other", None]), rng.randrange(1, 200)) for i in range(6000)] + [(6001, "mid", None)]
    df = spark.createDataFrame(rows, "size int, source string, h long").withColumnRenamed("size", "id")
    targets = spark.createDataFrame([("Big", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, "id", "h", "source", targets)
    got = {r.source: r for r in report.collect()}
    total = sum(n or 0 for _, _, n in rows)
    supply = Counter()
    for _, s, n in rows:
        supply[(s or "").strip().lower()] += n or 0
    for name, share, most in (("Big", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("none", 0.1, 2)):
        r = got[name]
        assert r.short == (supply[name.lower()] * most < share * total) and r.most_copies <= most
        if r.short:
            assert r.reached_tokens == supply[name.lower()] * most
        else:  # within one document of the target
            assert share * total - 400 < r.reached_tokens <= share * total + 1e-6
    assert abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
    assert selection.count() == selection.select("id").distinct().count()
    empty = mixing.mix(df.limit(0), "id", "h", "source", targets)[1].collect()
    assert len(empty) == 4 and all(r.reached_tokens == 0 for r in empty)
