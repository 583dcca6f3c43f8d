from pyspark.sql import functions as F

from paperloom.sources import scan
from paperloom.streaming import watch


def test_changed_files_reach_the_tables_once(spark, tmp_path):
    docs, out, state = tmp_path / "docs", tmp_path / "out", str(tmp_path / "state")
    docs.mkdir()
    (docs / "a.md").write_text("# A")
    (docs / "skip.txt").write_text("no")

    def refresh(batch, number):
        parsed = scan.parse_files(batch.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))
        scan.table(parsed, "nodes").write.mode("overwrite").parquet(f"{out}/batch={number}")

    for text in ("# A", "# B"):
        (docs / f"{text[-1].lower()}.md").write_text(text)
        watch.refresh_on_change(watch.watch(spark, str(docs)), state, refresh, once=True).awaitTermination()
    rows = spark.read.parquet(str(out))
    assert sorted(r.id for r in rows.filter("kind = 'document'").collect()) == ["a.md", "b.md"]
    known, present = rows.select(F.col("file_path").alias("path")), spark.createDataFrame([("a.md",)], "path string")
    assert [r.path for r in watch.removed_files(known, present).collect()] == ["b.md"]


def test_debounce(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 10), ("b", 1)], "root string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.root, r.n_events) for r in watch.debounce(rows, "root", "at", "2 seconds").collect()}
    assert got == {("a", 2), ("a", 1), ("b", 1)}
    assert watch.debounce(rows.limit(0), "root", "at").count() == 0


def test_projects_are_isolated_and_rules_hold(spark, tmp_path):
    for name in ("p/a.md", "p/skip.md", "q/b.md", "r/c.md"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text("x")
    done, failed = set(), []

    def refresh(batch, number):
        names = {r.path.rsplit("/", 1)[-1] for r in batch.select("path").collect()}
        if "b.md" in names:
            raise RuntimeError("broken")
        done.update(names)

    from pyspark.sql import functions as F

    project = F.element_at(F.split("path", "/"), -2)
    stream = watch.watch(spark, str(tmp_path / "docs"), rules=[("p", "skip.md")])
    watch.refresh_on_change(stream, str(tmp_path / "at"), watch.isolated(refresh, project, lambda p, e: failed.append(p)), once=True).awaitTermination(120)
    assert done == {"a.md", "c.md"} and failed == ["q"]
