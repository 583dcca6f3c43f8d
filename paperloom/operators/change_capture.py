"""Processing only new or changed records (problem 1).

The table of recorded versions is read as a change log.  A log entry has a key (``path``), a
partition (a hash of the key, fixed number of partitions) and an offset (``indexed_at`` in whole
seconds).  A run takes the entries of each partition after the last committed offset up to its own
cutoff.  Before it works it writes that batch as a plan (write-ahead); a plan without a commit is
replayed by the next run that succeeds, together with that run's own plan.  The sink keeps, per key,
the entry with the greatest offset, so an entry that is delivered again changes nothing, and emits
the key only if its digest differs from the digest the sink already holds.

Two forms share these rules:

* :func:`plan_batches` and :func:`replay` evaluate a whole history of runs in one pass.
* :class:`ChangeFeed` performs one run at a time with plan, sink, held and commit files on shared storage.

Defined results: rows without key, offset or digest are no versions; of versions with the same key
and offset the greatest digest counts; repeated rows count once; an empty log or no succeeded run
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import epoch_seconds, stored

PARTITIONS, COMPACT = 32, 8
_ENTRY = "path string, version long, digest string"


def digest(column: str = "content_hash") -> F.Column:
    """Notations of one SHA-256 digest (case, spaces, algorithm prefix) to bare lower-case hex."""
    bare = F.regexp_replace(F.lower(F.trim(F.col(column))), r"^sha-?256[:=]\s*|\s+", "")
    return F.when(F.length(bare) > 0, bare)


def change_log(files: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """(log_partition, path, log_offset, version, digest): one entry per recorded version.

    A record arrives when it is recorded, so its second is its offset as well as its version; a source that
    numbers its records as they arrive gives ``log_offset`` itself.
    """
    at = epoch_seconds("indexed_at")
    entries = files.select(F.col("path"), at.alias("log_offset"), at.alias("version"), digest("content_hash").alias("digest")).dropna()
    return entries.withColumn("log_partition", F.pmod(F.xxhash64("path"), F.lit(partitions)).cast("int"))


def plan_batches(runs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """(log_partition, from_offset exclusive, to_offset inclusive, plan_run, run_id).

    Every run that began writes a plan from the previous plan's end to its own cutoff; ``run_id`` is
    the succeeded run that commits it: the run itself, or the next success after a failure.  Plans
    no success ever reaches are not returned.  The runs table is a small fixed table.
    """
    began = runs.filter("started_at is not null").select(
        "run_id", "status", F.unix_seconds(F.col("started_at").cast("timestamp")).alias("cutoff")
    )
    by_time = Window.orderBy("cutoff", "run_id")
    plans = began.select(
        F.lag("cutoff", 1).over(by_time).alias("from_offset"),
        F.col("cutoff").alias("to_offset"),
        F.col("run_id").alias("plan_run"),
        F.first(F.when(F.col("status") == "succeeded", F.col("run_id")), ignorenulls=True)
        .over(by_time.rowsBetween(0, Window.unboundedFollowing))
        .alias("run_id"),
    ).filter("run_id is not null")
    return plans.select(
        F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("log_partition"), "*"
    )


def replay(log: DataFrame, plans: DataFrame) -> DataFrame:
    """(run_id, path, log_offset, digest): what each succeeded run delivers.

    ``plans`` has runs x partitions rows (14 x 32 here) and is broadcast; it grows with the number of
    runs, never with the log.  The log is shuffled once, after per-(run, key) pre-aggregation.
    """
    taken = log.join(
        F.broadcast(plans),
        (log["log_partition"] == plans["log_partition"])
        & (F.col("log_offset") <= F.col("to_offset"))
        & (F.col("from_offset").isNull() | (F.col("log_offset") > F.col("from_offset"))),
    ).select("run_id", F.col("to_offset").alias("reached"), "path", "log_offset", "digest")
    delivered = taken.groupBy("path", "run_id").agg(
        F.max(F.struct("log_offset", "digest")).alias("entry"), F.max("reached").alias("reached")
    )
    held = F.lag("entry.digest").over(Window.partitionBy("path").orderBy("entry.log_offset"))
    return (
        delivered.withColumn("held", held)
        .filter(F.col("held").isNull() | (F.col("held") != F.col("entry.digest")))
        .select("run_id", "path", "entry.log_offset", "entry.digest")
    )


def changed_by_run(files: DataFrame, runs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """All runs of a history: plans are written ahead, read back and replayed over the log."""
    plans = stored(plan_batches(runs, partitions), "change-plans")
    return replay(change_log(files, partitions), plans)


class ChangeFeed:
    """One incremental run at a time over a change log, exactly once, with state on shared storage.

    The offset of an entry is its place in the order of arrival within its partition; ``version`` tells
    which entry of a key is the newest.  An entry that arrives late has a new offset and an old version:
    it is taken once and changes nothing if a newer version is held already.

    ``folder`` holds

    * ``plans/<number>-<run>.json``, the batch of a run, written before it works: a range of offsets per partition;
    * ``sink/run=<run>``, what a run delivers: the keys whose digest the run changes, with their newest entry;
    * ``held/<number>``, the entries that a run took, newest per key; every ``COMPACT`` commits they are
      put together with all before them, so a run reads one full table and a few small ones;
    * ``commits/<number>-<run>.json``: the offsets reached and the tables that are held from here on.

    A run that dies leaves its plan behind without a commit.  The next run replays every such plan as it
    was written, whatever its own end is, then its own; what the dead run left in sink or held is written
    over.  A run that is committed is not repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = PARTITIONS, compact: int = COMPACT):
        self.spark, self.folder, self.partitions, self.compact = spark, folder.rstrip("/"), partitions, compact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.endswith(".json")) if self._fs.exists(at) else []

    def _put(self, kind: str, name: str, value: dict) -> None:
        target, draft = self._path(f"{self.folder}/{kind}/{name}.json"), self._path(f"{self.folder}/{kind}/{name}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"cannot write {target}")

    def _get(self, kind: str, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{kind}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def state(self) -> dict:
        """The last commit: number, run, offsets by partition (a fixed number of them), held tables."""
        names = self._names("commits")
        return self._get("commits", names[-1]) if names else {"number": 0, "run": None, "offsets": {}, "held": []}

    def committed(self) -> list[str]:
        return [n.removesuffix(".json").split("-", 1)[1] for n in self._names("commits")]

    def pending(self, number: int) -> list[dict]:
        """Plans after commit ``number``, in the order they were written."""
        return [self._get("plans", n) for n in self._names("plans") if int(n.split("-", 1)[0]) > number]

    def held(self, state: dict | None = None) -> DataFrame:
        """(path, version, digest): per key the newest entry of all committed runs."""
        folders = [f"{self.folder}/{name}" for name in (state or self.state())["held"]]
        rows = self.spark.read.schema(_ENTRY).parquet(*folders) if folders else self.spark.createDataFrame([], _ENTRY)
        return rows.groupBy("path").agg(F.max(F.struct("version", "digest")).alias("entry")).select("path", "entry.*")

    def plan(self, run: str, log: DataFrame, upto: int | None) -> list[dict]:
        """Plans to replay and, behind them, the one for ``run`` up to ``upto`` (or all that has arrived)."""
        state = self.state()
        plans = self.pending(state["number"])
        start = {**state["offsets"], **{p: b for plan in plans for p, (_, b) in plan["ranges"].items()}}
        if upto is None:
            ends = {str(r["log_partition"]): r["n"] for r in log.groupBy("log_partition").agg(F.max("log_offset").alias("n")).collect()}
        else:
            ends = {str(p): upto for p in range(self.partitions)}
        ranges = {p: [start.get(p), end] for p, end in ends.items() if start.get(p) is None or end > start[p]}
        own = {"number": state["number"] + len(plans) + 1, "run": run, "ranges": ranges}
        self._put("plans", f"{own['number']:08d}-{run}", own)
        return [*plans, own]

    def run(self, run: str, log: DataFrame, upto: int | None = None, work=None) -> DataFrame:
        """Deliver what is new or changed up to ``upto``; ``work(batch)`` may raise to fail the run.

        ``log`` is as made by :func:`change_log`: log_partition, path, log_offset, version, digest.
        """
        if run in self.committed():
            return self.delivered(run)
        plans, state = self.plan(run, log, upto), self.state()
        number = plans[-1]["number"]
        rows = [(int(p), a, b) for plan in plans for p, (a, b) in plan["ranges"].items()]
        bounds = self.spark.createDataFrame(rows, "log_partition int, from_offset long, to_offset long")
        inside = (F.col("log_offset") <= F.col("to_offset")) & (F.col("from_offset").isNull() | (F.col("log_offset") > F.col("from_offset")))
        batch = log.join(F.broadcast(bounds), "log_partition").filter(inside)  # plans x partitions rows
        taken = batch.groupBy("path").agg(F.max(F.struct("version", "digest")).alias("entry")).select("path", "entry.*")
        delta = f"held/{number:08d}"
        taken.write.mode("overwrite").parquet(f"{self.folder}/{delta}")
        taken = self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/{delta}")
        before = self.held(state).select("path", F.col("version").alias("_version"), F.col("digest").alias("_digest"))
        newer = F.col("_digest").isNull() | ((F.col("version") >= F.col("_version")) & (F.col("digest") != F.col("_digest")))
        fresh = taken.join(before, "path", "left").filter(newer).select("path", "version", "digest")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/sink/run={run}")
        if work:
            work(self.delivered(run))
        held = [*state["held"], delta]
        if len(held) > self.compact:
            whole = f"held/{number:08d}-all"
            self.held({"held": held}).write.mode("overwrite").parquet(f"{self.folder}/{whole}")
            held = [whole]
        reached = {**state["offsets"], **{p: b for plan in plans for p, (_, b) in plan["ranges"].items()}}
        self._put("commits", f"{number:08d}-{run}", {"number": number, "run": run, "offsets": reached, "held": held})
        for plan in plans:
            self._drop(f"plans/{plan['number']:08d}-{plan['run']}.json")
        for name in {*state["held"], delta} - set(held):
            self._drop(name)
        return self.delivered(run)

    def delivered(self, run: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/sink/run={run}")


def feed_history(files: DataFrame, runs: DataFrame, folder: str, partitions: int = PARTITIONS) -> DataFrame:
    """(run_id, path, version, digest): the runs of a small fixed table, one after the other, through a feed.

    Runs that did not succeed fail after they have written their batch, as theirs did.
    """
    log = change_log(files, partitions)
    feed, parts = ChangeFeed(files.sparkSession, folder, partitions), []
    began = runs.filter("started_at is not null").select("run_id", "status", F.unix_seconds(F.col("started_at").cast("timestamp")).alias("cutoff"))
    for r in sorted(began.collect(), key=lambda r: (r["cutoff"], r["run_id"])):
        if r["status"] == "succeeded":
            parts.append(feed.run(str(r["run_id"]), log, r["cutoff"]).select(F.lit(r["run_id"]).alias("run_id"), "*"))
        else:
            feed.plan(str(r["run_id"]), log, r["cutoff"])
    empty = files.sparkSession.createDataFrame([], f"run_id int, {_ENTRY}")
    return reduce(DataFrame.unionByName, parts, empty)
