"""Context assembly from ranked hits: one entry per file, cut to a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FULL_BYTES, STUB_BYTES, CONTENT_BYTES = 20 * 1024, 4 * 1024, 2000


def entries(hits: DataFrame) -> DataFrame:
    """(place, id, file_path, sections): the best hit of each file, with the names of all headings hit there in order.

    ``hits`` (place, id, kind, name, file_path) are the hits of a limited search.
    """
    named = F.when((F.col("kind") == "heading") & (F.col("name") != ""), F.struct("place", "name"))
    per = hits.groupBy("file_path").agg(F.min(F.struct("place", "id")).alias("best"), F.sort_array(F.collect_list(named)).alias("s"))
    return per.select("best.place", "best.id", "file_path", F.array_join(F.transform("s", lambda x: x["name"]), " | ").alias("sections"))


def cut_bytes(text: str, most: int) -> F.Column:
    """The longest prefix within ``most`` bytes that ends with a whole character."""
    raw = F.decode(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), "ISO-8859-1")
    head = F.when(F.length(raw) <= most, raw).otherwise(F.regexp_extract(raw, rf"^([\s\S]{{0,{most}}})(?![\x80-\xBF])", 1))
    return F.decode(F.encode(head, "ISO-8859-1"), "UTF-8")


def budget(listed: DataFrame, text: str, full: int = FULL_BYTES, stub: int = STUB_BYTES) -> DataFrame:
    """Adds ``form``: full while less than ``full`` bytes are used before the entry, then stub for
    ``stub`` more bytes, then omitted.  ``listed`` has a place per entry of one limited answer."""
    before = F.coalesce(F.sum(F.octet_length(text)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    form = F.when(before < full, "full").when(before < full + stub, "stub").otherwise("omitted")
    return listed.withColumn("bytes_before", before).withColumn("form", form)
