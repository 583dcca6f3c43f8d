"""How distinctive a term is for a record (problem 7).

A term's residual inverse document frequency is the observed one, -log2(df / N), minus the one a
Poisson spread of its occurrences would give, -log2(1 - exp(-cf / N)); times the count in the record
it rewards terms that are concentrated in few records.

Counts within a record are taken inside its row (sorted terms, run lengths), so the only shuffles are
the pre-aggregated collection counts per term and the join that brings them back to the records.  A
term that stands in a great part of all records would make that join skewed: terms with at least
``postings / FREQUENT_TERMS`` records, of which there can be no more than ``FREQUENT_TERMS``, are
therefore joined by broadcast, and only the postings of the rarer rest are shuffled.

Defined results: null texts are empty; records without any term give no rows; of repeated record ids
every row counts as a record of its own (give distinct ids); ties need no order; columns of other
names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import stored

FREQUENT_TERMS = 50_000


def terms(*columns: str) -> F.Column:
    """Maximal runs of letters and digits, lower-cased, of the texts one after the other."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_counts(records: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, counts): per record the array of (term, tf), counted inside the row."""
    once = lambda df, **c: df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in c.items()]))))
    df = once(records.select(F.col(key).alias("key"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(texts)]),
              _sorted=F.array_sort(terms(*[f"t{i}" for i in range(len(texts))])))
    df = df.select("key", "_sorted").filter("size(_sorted) > 0")
    first = F.filter(
        F.transform("_sorted", lambda t, i: F.when((i == 0) | (t != F.get("_sorted", i - 1)), i)), lambda i: i.isNotNull()
    )
    df = once(df, _first=first)
    runs = F.transform(
        "_first",
        lambda at, i: F.struct(
            F.get("_sorted", at).alias("term"), (F.coalesce(F.get("_first", i + 1), F.size("_sorted")) - at).alias("tf")
        ),
    )
    return df.select("key", runs.alias("counts"))


def score_terms(records: DataFrame, key: str, texts: list[str], frequent_terms: int = FREQUENT_TERMS) -> DataFrame:
    """(key, term, tf, df, cf, residual_idf, score) of every term of every record."""
    counted = stored(term_counts(records, key, texts), "term-counts")
    sizes = counted.agg(F.count("*").alias("n"), F.sum(F.size("counts")).alias("p")).first()
    n, postings = sizes["n"], sizes["p"] or 0
    flat = counted.select("key", F.inline("counts"))
    totals = flat.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    per = F.lit(float(max(n, 1)))
    residual = -F.log2(F.col("df") / per) + F.log2(-F.expm1(-F.col("cf") / per))
    totals = stored(totals.withColumn("residual_idf", residual), "term-totals")
    floor = max(2, -(-postings // frequent_terms))
    frequent, rare = totals.filter(F.col("df") >= floor), totals.filter(F.col("df") < floor)
    names = F.broadcast(frequent.withColumnRenamed("term", "_t"))
    tagged = flat.join(names, flat["term"] == F.col("_t"), "left")
    common = tagged.filter("_t is not null").drop("_t")
    others = tagged.filter("_t is null").select("key", "term", "tf").join(rare, "term")
    both = common.unionByName(others.select(common.columns))
    return both.withColumn("score", F.col("tf") * F.col("residual_idf"))
