"""Session plumbing shared by all operators: table access, shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Application -> how often its stored tables were removed.
released: dict[str, int] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  ``spark.checkpoint.dir`` names it on a cluster; only where
    Spark runs on this machine alone (tests, a laptop) a temporary folder takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("paperloom.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("paperloom.shared.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget its lineage (survives the loss of any executor)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back; :func:`release` removes it."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove every table this application has stored; what was read from them can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    released[spark.sparkContext.applicationId] = released.get(spark.sparkContext.applicationId, 0) + 1


def fingerprint(spark: SparkSession, folder: str, tables: list[str]) -> tuple:
    """What tells one state of the files of some tables from another: names, sizes and times."""
    out: list = [spark.sparkContext.applicationId, released.get(spark.sparkContext.applicationId, 0)]
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((t, *[(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(path) if fs.exists(path) else [])]))
    return tuple(out)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if its input comes in fewer than half as many parts (a single small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 < cores else df


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``.  The row limit is applied before the shuffle as
    well, so a key that holds a third of all rows sends one row per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def epoch_seconds(column) -> F.Column:
    """Epoch numbers of unknown unit (s, ms, us, ns told apart by size) to whole seconds."""
    c = F.col(column) if isinstance(column, str) else column
    size = F.abs(c)
    return (
        F.when(size >= 10**17, F.floor(c / F.lit(10**9)))
        .when(size >= 10**14, F.floor(c / F.lit(10**6)))
        .when(size >= 10**11, F.floor(c / F.lit(1000)))
        .otherwise(c)
        .cast("long")
    )


def own(original: DataFrame, name: str) -> F.Column:
    """A column of ``original`` inside :func:`boxed`."""
    return F.col(f"_own{original.columns.index(name)}")


def boxed(df: DataFrame, **columns: F.Column) -> DataFrame:
    """All columns of ``df`` under neutral names beside working columns, so that names cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(df.columns)], *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, original: DataFrame, **columns: F.Column) -> DataFrame:
    """The original columns again with result columns, which replace originals of the same name."""
    kept = [own(original, c).alias(c) for c in original.columns if c not in columns]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])
