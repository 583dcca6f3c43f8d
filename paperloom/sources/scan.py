"""Folders of documents: listing with ignore rules, and parsing every file on the executors."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import code, docx, html, markdown, pdf
from paperloom.sources.model import RESULT, Parsed

MB = 1 << 20
#: Extension -> (reader, largest size).
FORMATS: dict[str, tuple[Callable[[str, bytes], Parsed], int]] = {
    "md": (markdown.parse, MB), "docx": (docx.parse, 10 * MB), "html": (html.parse, 5 * MB), "htm": (html.parse, 5 * MB), "pdf": (pdf.parse, 50 * MB),
}
#: Folders that are never entered.
SKIPPED = ("node_modules", ".git", "target", "dist", "build", ".codegraph", ".paperloom", ".next", ".cache", "vendor", "__pycache__", ".obsidian")


def register(extension: str, reader: Callable[[str, bytes], Parsed], most: int = MB) -> None:
    """Adds a format, or code files by ``register(e, code.parse)``."""
    FORMATS[extension.lower()] = (reader, most)


def register_code() -> None:
    for extension in code.LANGUAGES:
        register(extension, code.parse)


class Ignore:
    """Rules of ignore files: the last match wins, ``!`` takes back, a pattern without slash matches at any depth."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = []
        for base, line in rules:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.lstrip("!")
            anchored = "/" in line.rstrip("/")
            self.rules.append((base.strip("/"), line.strip("/"), keep, anchored))

    def __call__(self, path: str) -> bool:
        ignored = False
        for base, pattern, keep, anchored in self.rules:
            if base and not path.startswith(base + "/"):
                continue
            inner = path[len(base) + 1 :] if base else path
            parts = inner.split("/")
            heads = ["/".join(parts[: i + 1]) for i in range(len(parts))]
            if anchored:
                hit = any(fnmatch.fnmatchcase(h, pattern.replace("**/", "*")) or h == pattern for h in heads)
            else:
                hit = any(fnmatch.fnmatchcase(p, pattern) for p in parts) or pattern in inner
            ignored = (not keep) if hit else ignored
        return ignored


#: Names of the files whose lines are ignore rules for their folder.
IGNORE_FILES = (".gitignore", ".paperloomignore")


def ignore_rules(spark: SparkSession, folder: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, str]]:
    """(folder of the ignore file, line) of every ignore file below ``folder``, upper folders first.

    Spark's own listing passes over names that begin with a dot, so the names are walked on the driver, folder by
    folder; only ignore files are opened.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out, waiting = [], [(top, "")]
    while waiting:
        at, base = waiting.pop(0)
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in SKIPPED and not status.isSymlink():
                    waiting.append((status.getPath(), f"{base}/{name}".strip("/")))
            elif name in names:
                stream = fs.open(status.getPath())
                out += [(base, line) for line in bytes(stream.readAllBytes()).decode(errors="replace").splitlines()]
                stream.close()
    return out


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, modified, length, content) of the files below ``folder`` in a known format.

    Hidden tool folders are skipped; a file over the size of its format keeps its row without content
    and is reported as an error by :func:`parse_files`.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^" + re.escape(re.sub("^file:/+", "file:/", root)).replace("file:/", "file:/+"), "")
    known = F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1))
    most = F.create_map(*[F.lit(x) for e, (_, size) in FORMATS.items() for x in (e, size)])
    rows = raw.select(F.try_url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.unix_seconds("modificationTime").alias("modified"), "length",
                      F.when(F.col("length") <= F.try_element_at(most, known), F.col("content")).alias("content"), known.alias("_e"))
    skip = "|".join(re.escape(s) for s in SKIPPED)
    return rows.filter(F.col("_e").isin(list(FORMATS))).filter(~F.col("path").rlike(rf"(?:^|/)(?:{skip})/|(?:^|/)\.[a-z]+/worktrees/")).drop("_e")


def without_ignored(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Drops ignored paths; ``rules`` are (folder of the ignore file, line), a short list."""
    ignore = Ignore(rules)

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not ignore(p))

    return files.filter(kept("path"))


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (path, content): nodes, edges, links, chunks and tuples as arrays, error if any.

    A reader that fails gives a row with its error; the job goes on.
    """
    formats = dict(FORMATS)

    def one(path: str, content) -> Parsed:
        reader, most = formats.get(path.rsplit(".", 1)[-1].lower(), (None, 0))
        if reader is None:
            return Parsed(path, "", 0, "unsupported format")
        if content is None or len(content) > most:
            return Parsed(path, "", 0, "file exceeds size limit")
        try:
            return reader(path, bytes(content))
        except Exception as e:  # noqa: BLE001
            return Parsed(path, "", len(content), f"{type(e).__name__}: {str(e)[:200]}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [vars(one(p, c)) for p, c in zip(batch["path"], batch["content"])]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, RESULT)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of the arrays (nodes, edges, links, chunks, tuples) as a table; tag nodes once per id, by path."""
    rows = parsed.select(F.col("path").alias("_from"), F.explode(name).alias("x")).select("_from", "x.*")
    if name != "nodes":
        return rows.drop("_from")
    first = rows.groupBy("id").agg(F.min("_from").alias("_from"))
    return rows.join(first, ["id", "_from"]).drop("_from")
