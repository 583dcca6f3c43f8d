import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import change_capture as cc

FILES = "path string, content_hash string, size long, modified_at long, indexed_at long, extra int"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def runs_of(spark, rows):
    return spark.sql("SELECT 1 AS run_id").limit(0) if not rows else spark.createDataFrame(
        [(r, None, s, t) for r, t, s in rows], "run_id int, finished_at timestamp, status string, at long"
    ).selectExpr("run_id", "timestamp_seconds(at) AS started_at", "finished_at", "status")


def expected(files, runs):
    def state(path, cutoff):
        seen = [(t, h) for p, h, t in files if p == path and h and t <= cutoff]
        return max(seen)[1] if seen else None

    out, before = set(), None
    for r, t, s in sorted(runs, key=lambda x: x[1]):
        if s != "succeeded":
            continue
        for path in {f[0] for f in files}:
            now = state(path, t)
            if now and now != (state(path, before) if before is not None else None):
                out.add((r, path))
        before = t
    return out


def test_history_against_brute_force(spark):
    rng = random.Random(3)
    files = [(f"p{rng.randrange(30)}", rng.choice("abc") * 64 if rng.random() > 0.1 else None, 10_000 + i * 7) for i in range(600)]
    files += files[:20]
    runs = [(i, 10_000 + i * 450, rng.choice(["succeeded", "succeeded", "failed", "aborted"])) for i in range(10)]
    notations = [lambda h: h, str.upper, lambda h: f"sha256:{h}", lambda h: f" {h} "]
    rows = [(p, h and rng.choice(notations)(h), 1, 0, t * rng.choice([1, 1]), 5) for p, h, t in files]
    got = cc.changed_by_run(spark.createDataFrame(rows, FILES), runs_of(spark, runs))
    assert {(r.run_id, r.path) for r in got.collect()} == expected(files, runs)
    assert got.count() == got.select("run_id", "path").distinct().count()


def test_units_of_offsets(spark):
    rows = [("a", "1" * 64, 1, 0, 1_735_432_274_679, 0), ("a", "2" * 64, 1, 0, 1_735_432_275, 0), ("b", "3" * 64, 1, 0, 1_735_432_276_000_000, 0)]
    log = {(r.path, r.log_offset) for r in cc.change_log(spark.createDataFrame(rows, FILES)).collect()}
    assert log == {("a", 1_735_432_274), ("a", 1_735_432_275), ("b", 1_735_432_276)}


def test_nulls_and_empty_tables(spark):
    rows = [(None, "1" * 64, 1, 0, 5, 0), ("a", None, 1, 0, 5, 0), ("a", " ", 1, 0, 5, 0), ("a", "1" * 64, 1, 0, None, 0)]
    one = runs_of(spark, [(1, 100, "succeeded")])
    assert cc.changed_by_run(spark.createDataFrame(rows, FILES), one).count() == 0
    assert cc.changed_by_run(spark.createDataFrame([], FILES), one).count() == 0
    full = spark.createDataFrame([("a", "1" * 64, 1, 0, 5, 0)], FILES)
    assert cc.changed_by_run(full, runs_of(spark, [(1, 100, "failed")])).count() == 0


def test_feed_survives_failures(spark, tmp_path):
    rng = random.Random(5)
    files = [(f"p{rng.randrange(9)}", rng.choice("abc") * 64, 100 + i) for i in range(200)]
    log = cc.change_log(spark.createDataFrame([(p, h, 1, 0, t, 0) for p, h, t in files], FILES), 4)
    feed = cc.ChangeFeed(spark, str(tmp_path / "feed"), 4)
    got, runs = set(), []
    for i, cutoff in enumerate((150, 200, 240, 300)):
        name = f"r{i}"
        if i == 1:
            with pytest.raises(RuntimeError):
                feed.run(name, log, cutoff, work=lambda batch: (_ for _ in ()).throw(RuntimeError("lost")))
            runs.append((i, cutoff, "failed"))
            continue
        got |= {(i, r.path) for r in feed.run(name, log, cutoff).collect()}
        again = {(i, r.path) for r in feed.run(name, log, cutoff).collect()}  # a committed run is not repeated
        assert again <= got
        runs.append((i, cutoff, "succeeded"))
    assert got == expected(files, runs)


def entries(spark, rows):
    """A log of (path, arrival, version, digest) in two partitions."""
    df = spark.createDataFrame(rows, "path string, log_offset long, version long, digest string")
    return df.withColumn("log_partition", F.pmod(F.xxhash64("path"), F.lit(2)).cast("int"))


def fail(batch):
    raise RuntimeError("lost")


def test_late_records_and_plans_are_replayed(spark, tmp_path):
    feed = cc.ChangeFeed(spark, str(tmp_path / "feed"), 2)
    log = [("a", 10, 10, "x"), ("b", 12, 12, "y")]
    assert {r.path for r in feed.run("1", entries(spark, log), 20).collect()} == {"a", "b"}
    # late: a new key with an old version, an old version of a known key, and a change; the run dies before its commit
    log += [("c", 31, 15, "z"), ("a", 32, 5, "old"), ("b", 33, 33, "y2")]
    with pytest.raises(RuntimeError):
        feed.run("2", entries(spark, log), 40, work=fail)
    log += [("d", 38, 38, "w"), ("e", 50, 50, "v")]
    got = feed.run("3", entries(spark, log), 35).collect()  # an earlier end than the plan that is replayed
    assert {(r.path, r.digest) for r in got} == {("c", "z"), ("b", "y2"), ("d", "w")} and not feed.pending(feed.state()["number"])
    feed.plan("4", entries(spark, log), 60)  # dies after its plan
    again = cc.ChangeFeed(spark, str(tmp_path / "feed"), 2)
    assert {r.path for r in again.run("5", entries(spark, log)).collect()} == {"e"}
    assert again.run("6", entries(spark, log)).count() == 0 and {r.path for r in again.delivered("3").collect()} == {"b", "c", "d"}
    assert {(r.path, r.version) for r in again.held().collect()} == {("a", 10), ("b", 33), ("c", 15), ("d", 38), ("e", 50)}


def test_failure_between_sink_and_commit(spark, tmp_path, monkeypatch):
    feed = cc.ChangeFeed(spark, str(tmp_path / "feed"), 2)
    log = entries(spark, [("a", 1, 1, "x"), ("b", 2, 2, "y")])
    put = feed._put
    monkeypatch.setattr(feed, "_put", lambda kind, *rest: fail(None) if kind == "commits" else put(kind, *rest))
    with pytest.raises(RuntimeError):
        feed.run("1", log, 5)
    monkeypatch.undo()
    assert {r.path for r in feed.run("1", log, 5).collect()} == {"a", "b"} and feed.committed() == ["1"]


def test_state_stays_small(spark, tmp_path):
    feed = cc.ChangeFeed(spark, str(tmp_path / "feed"), 2, compact=2)
    log = entries(spark, [(f"p{i % 3}", i, i, str(i)) for i in range(8)])
    for i in range(8):
        assert [r.path for r in feed.run(str(i), log, i).collect()] == [f"p{i % 3}"]
        assert len(feed.state()["held"]) <= 2 and not feed._names("plans")
    folders = [p.name for p in (tmp_path / "feed" / "held").iterdir() if p.is_dir()]
    assert len(folders) <= 3 and feed.held().count() == 3
