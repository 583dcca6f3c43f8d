"""Live update: watching a folder, coalescing bursts of changes and refreshing tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.scan import Ignore

#: Files that are read.
EXTENSIONS = ("md", "markdown", "html", "htm", "docx", "pdf")


def watch(spark: SparkSession, folder: str, per_trigger: int = 8192, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """A stream of (path, modificationTime, length, content) of new or rewritten files below ``folder``.

    ``rules`` are ignore rules as :func:`paperloom.sources.scan.ignore_rules` reads them; what they match is left out.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    files = source.load(folder).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    if not rules:
        return files
    ignore, root = Ignore(rules), folder.rstrip("/") + "/"

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not ignore(p.split(root, 1)[-1]))

    return files.filter(kept("path"))


def debounce(events: DataFrame, key: str, at: str, gap: str = "2 seconds") -> DataFrame:
    """(key, began, ended, n_events): bursts of events per key with pauses of at most ``gap`` inside.

    Works on batches and, given a watermark on ``at``, on streams.
    """
    session = F.session_window(at, gap)
    per = events.groupBy(key, session.alias("s")).agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count("*").alias("n_events"))
    return per.drop("s")


def refresh_on_change(stream: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None], every: str = "2 seconds", once: bool = False):
    """Starts the query that hands every batch of changed files to ``refresh(batch, number)``.

    The batch number repeats when a batch is replayed after a failure, so a refresh that writes under
    it is idempotent.  An error of one batch stops the query; it resumes from the checkpoint.
    """
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def isolated(refresh: Callable[[DataFrame, int], None], project: Column, on_error: Callable[[str, Exception], None]) -> Callable[[DataFrame, int], None]:
    """A refresh that handles every project of a batch on its own: an error of one is reported and the others go on.

    The projects of a batch come to the driver; there are as many as a workspace has folders.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_project", project).persist()
        try:
            for row in sorted(batch.select("_project").distinct().collect(), key=str):
                try:
                    refresh(batch.filter(F.col("_project").eqNullSafe(row[0])).drop("_project"), number)
                except Exception as e:  # noqa: BLE001
                    on_error(row[0], e)
        finally:
            batch.unpersist()

    return each


def removed_files(known: DataFrame, present: DataFrame) -> DataFrame:
    """File sources do not report deletions: known paths that a listing no longer has."""
    return known.select("path").distinct().join(present.select("path"), "path", "left_anti")
