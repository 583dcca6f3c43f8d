"""Views of the document-graph tables that several operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import newest


def deleted(metadata: str = "metadata") -> F.Column:
    """True where the JSON metadata says ``"deleted": true``; blank or broken JSON says nothing."""
    m = F.col(metadata)
    return F.coalesce(
        F.when(m.contains("deleted"), F.get_json_object(m, "$.deleted") == "true"),
        F.lit(False),
    )


def existing_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row of each node id that is not marked deleted, with ``columns`` (ids not null).

    Rows of one id with the same ``updated_at`` are ordered by their other selected values, so the
    result is the same on every run.
    """
    kept = list(dict.fromkeys(["id", *columns]))
    rows = nodes.filter("id is not null").select(*kept, "updated_at", deleted().alias("_deleted"))
    order = [F.col("updated_at").desc_nulls_last(), F.col("_deleted"), *[F.col(c).desc_nulls_last() for c in kept[1:]]]
    return newest(rows, ["id"], order).filter("not _deleted").select(*kept)


def newest_metadata(table: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row of each node_id of a metadata table."""
    rows = table.filter("node_id is not null").select("node_id", *columns, "updated_at")
    order = [F.col("updated_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns]]
    return newest(rows, ["node_id"], order).select("node_id", *columns)


def stem(path: F.Column) -> F.Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def running(partition: list[str], order: str):
    return Window.partitionBy(*partition).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
