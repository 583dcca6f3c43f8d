"""Similarity of documents: TF-IDF cosine, shared targets and tags, their weighted sum, and vectors.

The composite score is half the TF-IDF cosine plus 0.3 and 0.2 times the Jaccard similarity of
reference targets and tags, so a score of ``least`` needs a cosine of (least - 0.5) / 0.5;
see :func:`cosine_pairs` for how such pairs are found without joining very common terms.  Documents
with equal features are collapsed first; pairs join class representatives, and membership tells the
copies.  For ``least`` <= 0.5 a pair may qualify without any shared term, and hot terms and targets
bring most pairs together anyway, so blocks of documents meet as matrices; see :func:`block_pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import stored
from paperloom.tables import REFERENCES, Graph

#: Words that do not count.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could of "
    "in to for with on at by from as or and but not this that it its"
).split()
#: Parts of a side of the cartesian product of blocks; changed documents whose ids are sent to all tasks.
MOST_PARTS, MOST_BROADCAST = 128, 1_000_000
_EAST = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more, without stop words; runs with East
    Asian characters give their pairs of neighbouring characters."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")
    pairs = lambda p: F.when(F.length(p) > 1, F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    plain = lambda p: F.when((F.octet_length(p) >= 2) & ~p.isin(STOP_WORDS), F.array(p)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(_EAST), pairs(p)).otherwise(plain(p))))


def tfidf(docs: DataFrame) -> DataFrame:
    """(id, term, weight) of docs (id, text): term share times ln(N / document frequency)."""
    words = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    n = docs.count()
    counts = words.select("id", F.size("w").alias("total"), F.explode("w").alias("term")).groupBy("id", "term", "total").agg(F.count("*").alias("tf"))
    freq = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(freq, "term").select("id", "term", ((F.col("tf") / F.col("total")) * F.log(F.lit(float(max(n, 1))) / F.col("df"))).alias("weight"))


def features(g: Graph) -> DataFrame:
    """(id, text, targets, tags) of every document; targets are those of the document node itself."""
    docs = g.documents("name", "metadata", "body_excerpt")
    linked = g.edges.filter(F.col("kind").isin(REFERENCES)).filter("target is not null").select(F.col("source").alias("id"), "target").distinct()
    sets = linked.groupBy("id").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    tags = F.transform(F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>"), lambda t: F.lower(t))
    none = F.array().cast("array<string>")
    return docs.join(sets, "id", "left").select(
        "id", F.concat_ws(" ", "name", "body_excerpt").alias("text"), F.coalesce("targets", none).alias("targets"),
        F.sort_array(F.array_distinct(F.coalesce(tags, none))).alias("tags"),
    )


def jaccard(a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def classes(feats: DataFrame) -> DataFrame:
    """(id, class_id): documents with the same words, targets and tags; the class is its least id."""
    same = F.sha2(F.to_json(F.struct(F.array_sort(tokens("text")).alias("w"), "targets", "tags")), 256)
    keyed = feats.select("id", same.alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("class_id")), "k").select("id", "class_id")


def cosine_pairs(weights: DataFrame, least: float) -> DataFrame | None:
    """(a, b, cosine) of all pairs a < b with a cosine of at least ``least`` (over 0); null if no document frequency
    splits the terms well enough, which leaves the pairs to :func:`block_pairs`.

    Terms are split at one document frequency into rare and common ones, so that few documents have a
    common part of length ``least`` or more.  The dot product over rare terms is summed by joining
    rare postings; what the common parts can add is at most the product of their lengths, and two
    documents without a shared rare term can only qualify if both have a long common part.  Pairs
    that pass this bound get their common terms added; a very common term is thus never joined for
    all of its documents.
    """
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = weights.join(norms.filter("norm > 0"), "id").select("id", "term", (F.col("weight") / F.col("norm")).alias("w")).filter("w > 0")
    freq = unit.groupBy("term").agg(F.count("*").alias("df"))
    unit = stored(unit.join(freq, "term"), "unit-weights")
    marks = sorted({int(x) for x in unit.approxQuantile("df", [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99], 0.005)})
    length = lambda m: F.sum(F.when(F.col("df") > m, F.col("w") * F.col("w")).otherwise(0.0))
    heavy = unit.groupBy("id").agg(*[length(m).alias(f"c{m}") for m in marks]) if marks else None
    shares = heavy.agg(*[F.avg((F.col(f"c{m}") >= least * least * 0.999999).cast("double")).alias(f"c{m}") for m in marks]).first() if marks else {}
    split = next((m for m in marks if (shares[f"c{m}"] or 0) <= 0.05), None)
    if split is None and marks:
        return None
    is_rare = F.lit(True) if split is None else F.col("df") <= split
    common = unit.groupBy("id").agg(F.sqrt(F.sum(F.when(is_rare, 0.0).otherwise(F.col("w") * F.col("w")))).alias("c"))
    posts = stored(unit.withColumn("rare", is_rare).join(common, "id").select("id", "term", "w", "rare", "c"), "postings")
    meets = lambda p: p.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"), F.col("c").alias("ca")).join(
        p.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"), F.col("c").alias("cb")), "term"
    ).filter("a < b")
    rare = meets(posts.filter("rare")).select("a", "b", "ca", "cb", (F.col("wa") * F.col("wb")).alias("x"))
    long = meets(posts.filter(~F.col("rare") & (F.col("c") >= least * 0.999999))).select("a", "b", "ca", "cb", F.lit(0.0).alias("x"))
    sums = rare.unionByName(long).groupBy("a", "b").agg(F.sum("x").alias("s"), F.max("ca").alias("ca"), F.max("cb").alias("cb"))
    likely = stored(sums.filter(F.col("s") + F.col("ca") * F.col("cb") >= least - 1e-6).select("a", "b", "s"), "likely-pairs")
    rest = posts.filter(~F.col("rare"))
    more = likely.select("a", "b").join(rest.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), "a")
    more = more.join(rest.select(F.col("id").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("x"))
    both = likely.join(more, ["a", "b"], "left").select("a", "b", (F.col("s") + F.coalesce("x", F.lit(0.0))).alias("cosine"))
    return both.filter(F.round("cosine", 6) >= least)


def _meeting(n_left: int, left: tuple, n_right: int, right: tuple, tile: int) -> Iterator[np.ndarray]:
    """Dot products of sparse rows, (row, code, value) sorted by row on either side, in tiles of left rows.

    Codes that many right rows hold are multiplied as dense columns, the others by their postings.
    """
    (lr, lc, lv), (rr, rc, rv) = left, right
    codes = int(max(lc.max(initial=-1), rc.max(initial=-1))) + 1
    held = np.bincount(rc, minlength=codes)
    hot = np.flatnonzero(held > max(8.0, 0.07 * n_right))
    place = np.full(codes, -1)
    place[hot] = np.arange(len(hot))
    dense = np.zeros((len(hot), n_right))
    often = place[rc] >= 0
    dense[place[rc[often]], rr[often]] = rv[often]
    order = np.argsort(rc, kind="stable")
    pr, pv, start = rr[order], rv[order], np.cumsum(held) - held
    for at in range(0, n_left, tile):
        height = min(tile, n_left - at)
        a, b = np.searchsorted(lr, [at, at + height])
        r, c, v = lr[a:b] - at, lc[a:b], lv[a:b]
        often = place[c] >= 0
        here = np.zeros((height, len(hot)))
        here[r[often], place[c[often]]] = v[often]
        sums = here @ dense
        rest = ~often & (held[c] > 0)
        r, c, v = r[rest], c[rest], v[rest]
        ends = np.cumsum(held[c])
        for part in np.split(np.arange(len(c)), np.searchsorted(ends, np.arange(2_000_000, ends[-1] if len(ends) else 0, 2_000_000))):
            times = held[c[part]]
            at_post = np.repeat(start[c[part]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cells = np.repeat(r[part] * n_right, times) + pr[at_post]
            sums += np.bincount(cells, np.repeat(v[part], times) * pv[at_post], height * n_right).reshape(height, n_right)
        yield sums


def block_pairs(rows: DataFrame, least: float, block: int = 4096, tile: int = 256, changed: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine, refs, tags, score) of all pairs a < b of rows (id, terms, weights, targets, tags) whose score reaches ``least``.

    With ``changed`` (id), only the pairs that touch one of these: blocks of changed rows meet blocks of all rows.

    Rows are packed into blocks, one binary each, that are written once; the tasks of a cartesian product
    fetch two of them each and give the exact scores of their pairs.  No posting list is paired between
    tasks, so a hot term, target or tag costs no more than any other, and the disk grows with the rows,
    not with the pairs of blocks.
    """
    n = rows.count()
    blocks = max(1, -(-n // block), min(8, n // 256))
    place = lambda k, *seed: F.pmod(F.xxhash64("id", *seed), F.lit(k)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as stream:
            stream.write_table(t)
        yield pa.RecordBatch.from_arrays([t["own"].chunk(0)[:1], pa.array([sink.getvalue().to_pybytes()])], ["own", "packed"])

    def packed(placed: DataFrame, k: int) -> DataFrame:
        return placed.groupBy("own").applyInArrow(pack, "own int, packed binary").repartitionById(min(k, MOST_PARTS), F.pmod("own", F.lit(min(k, MOST_PARTS))))

    if changed is None:
        first = every = packed(rows.withColumn("own", place(blocks)).withColumn("hot", F.lit(False)), blocks)
    else:
        ids = changed.select("id").distinct()
        n_hot = max(1, -(-ids.count() // block))
        marked = stored(rows.join(ids.withColumn("hot", F.lit(True)), "id", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "marked-rows")
        # blocks of changed rows are numbered behind those of all rows
        first = packed(marked.filter("hot").withColumn("own", place(n_hot, F.lit(1)) + blocks), n_hot)
        every = packed(marked.withColumn("own", place(blocks)), blocks)
    meetings = first.select(F.col("own").alias("lo"), F.col("packed").alias("x")).hint("shuffle_replicate_nl").crossJoin(every.select(F.col("own").alias("hi"), F.col("packed").alias("y")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lo, hi = batch["lo"][i].as_py(), batch["hi"][i].as_py()
                yield from both(lo, hi, [pa.ipc.open_stream(batch[c][i].as_buffer()).read_all() for c in ("x", "y")[: 1 + (lo != hi)]])

    def both(lo: int, hi: int, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        ids, own = pa.concat_arrays(t["id"].chunks), t["own"].to_numpy()
        rank = np.empty(len(own), dtype=np.int64)
        rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(own))
        code, hot = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False), t["hot"].to_numpy()
        sides = [np.flatnonzero(own == lo), np.flatnonzero(own == hi)]

        def sparse(items: str, values: str | None = None) -> list[tuple]:
            lists = pa.concat_arrays(t[items].chunks)
            row = np.repeat(np.arange(len(own)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            value = pa.concat_arrays(t[values].chunks).flatten().to_numpy(zero_copy_only=False) if values else np.ones(len(row))
            out = []
            for side in sides:
                local = np.full(len(own), -1)
                local[side] = np.arange(len(side))
                keep = local[row] >= 0
                out.append((local[row[keep]], code[keep].astype(np.int64), value[keep]))
            return out

        left, right = sides
        words, targets, tags = sparse("terms", "weights"), sparse("targets"), sparse("tags")
        tiles = [_meeting(len(left), x[0], len(right), x[1], tile) for x in (words, targets, tags)]
        norms = [np.sqrt(np.bincount(r, v * v, len(side))) for (r, _, v), side in zip(words, sides)]
        sizes = [[np.bincount(x[k][0], minlength=len(sides[k])) for k in (0, 1)] for x in (targets, tags)]
        for at, (dot, shared_targets, shared_tags) in zip(range(0, len(left), tile), zip(*tiles)):
            length = norms[0][at : at + tile, None] * norms[1][None, :]
            cosine = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
            jac = []
            for shared, (of_left, of_right) in zip((shared_targets, shared_tags), sizes):
                union = of_left[at : at + tile, None] + of_right[None, :] - shared
                jac.append(np.divide(shared, union, out=np.zeros_like(shared), where=union > 0))
            score = 0.5 * cosine + 0.3 * jac[0] + 0.2 * jac[1]
            fits = (score >= least - 5e-7) & (score > 0)
            if lo == hi:  # a block with itself: each pair once
                fits &= np.arange(len(right))[None, :] > np.arange(at, at + len(score))[:, None]
            i, j = np.nonzero(fits)
            if lo > hi:  # changed rows with all rows: not with themselves, and two changed ones once
                a, b = left[at + i], right[j]
                keep = (code[a] != code[b]) & (~hot[b] | (rank[a] < rank[b]))
                i, j = i[keep], j[keep]
            if len(i):
                a, b = left[at + i], right[j]
                first = rank[a] < rank[b]
                pair = [ids.take(pa.array(np.where(first, a, b))), ids.take(pa.array(np.where(first, b, a)))]
                columns = pair + [pa.array(x[i, j]) for x in (cosine, *jac, score)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "cosine", "refs", "tags", "score"])

    meetings = meetings.filter("lo <= hi") if changed is None else meetings
    return meetings.mapInArrow(meet, "a string, b string, cosine double, refs double, tags double, score double")


def composite_pairs(feats: DataFrame, least: float, changed: DataFrame | None = None) -> DataFrame:
    """(source, target, score, tfidf, refs, tags, metadata) of class representatives whose score reaches ``least``.

    With ``changed`` (id), only the pairs that touch the class of one of these documents.
    """
    feats = stored(feats, "document-features")
    member = classes(feats)
    reps = feats.join(member.filter("id = class_id").select("id"), "id", "left_semi").withColumnRenamed("id", "name")
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "similarity-features")  # short keys for the pair joins
    weights = tfidf(feats.select("id", "text")).withColumnRenamed("id", "name").join(reps.select("id", "name"), "name").select("id", "term", "weight")
    weights = stored(weights, "similarity-weights")
    scored = cosine_pairs(weights, (least - 0.5) / 0.5) if least > 0.5 and changed is None else None
    if scored is not None:
        left = reps.select(F.col("id").alias("a"), F.col("name").alias("na"), F.col("targets").alias("ta"), F.col("tags").alias("ga"))
        right = reps.select(F.col("id").alias("b"), F.col("name").alias("nb"), F.col("targets").alias("tb"), F.col("tags").alias("gb"))
        both = scored.join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "cosine", jaccard("ta", "tb").alias("refs"), jaccard("ga", "gb").alias("tags"))
        both = both.withColumn("score", 0.5 * F.col("cosine") + 0.3 * F.col("refs") + 0.2 * F.col("tags")).filter(F.round("score", 6) >= least)
    else:
        lists = weights.filter("weight > 0").groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
        rows = reps.join(lists, "id", "left").select(
            F.col("name").alias("id"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
            F.coalesce("weights", F.array().cast("array<double>")).alias("weights"), "targets", "tags",
        )
        touched = changed and member.join(changed.select("id").distinct(), "id", "left_semi").select(F.col("class_id").alias("id")).distinct()
        both = block_pairs(stored(rows, "similarity-rows"), least, changed=touched)
    two = lambda c: F.round(F.col(c) * 100) / 100 + 0.0
    rounded = both.select(F.col("a").alias("source"), F.col("b").alias("target"), two("score").alias("score"), two("cosine").alias("tfidf"), two("refs").alias("refs"), two("tags").alias("tags"))
    return rounded.withColumn("metadata", F.to_json(F.struct("refs", "score", "tags", "tfidf")))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (source, target) with either end in ``ids`` (id)."""
    ends = ids.select("id").distinct()
    first = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi")
    rest = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_anti").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return first.select(*edges.columns).unionByName(rest.select(*edges.columns))


def without(edges: DataFrame, ids: DataFrame, engine: str = "") -> DataFrame:
    """Edges without the similarity edges that touch ``ids`` (of one engine, if named)."""
    made_by = F.when(F.get_json_object("metadata", "$.engine") == "neural", "neural").otherwise("tfidf")
    similar = (F.col("kind") == "similar_to") & (made_by == engine if engine else F.lit(True))
    similar = F.coalesce(similar, F.lit(False))
    ends = ids.select("id").distinct()
    stay = edges.filter(similar).join(ends.withColumnRenamed("id", "source"), "source", "left_anti").join(ends.withColumnRenamed("id", "target"), "target", "left_anti")
    return edges.filter(~similar).unionByName(stay.select(*edges.columns))


def refresh(existing: DataFrame, changed: DataFrame, feats: DataFrame, least: float, made_at: float) -> DataFrame:
    """Incremental form: pairs that touch no changed document or its class are kept, only the others are scored again.

    ``existing`` was made at ``made_at``; at another threshold, or if more than half of the documents changed, all
    pairs are made anew.  Weights of unchanged pairs stay those of the run that made them, as in the reference.
    """
    n_changed, n = changed.select("id").distinct().count(), feats.count()
    if n_changed == 0:
        return existing
    if made_at != least or n_changed > n / 2:
        return composite_pairs(feats, least).select(*existing.columns)
    ids = changed.select("id").distinct()
    ends = ids.union(classes(feats).join(ids, "id", "left_semi").select("class_id")).distinct()
    ends = F.broadcast(ends) if n_changed <= MOST_BROADCAST else ends  # else all pairs would be shuffled
    kept = existing.join(ends.withColumnRenamed("id", "source"), "source", "left_anti").join(ends.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.select(*existing.columns).unionByName(composite_pairs(feats, least, changed).select(*existing.columns))


def merged_similar(edges: DataFrame, engine: str = "") -> DataFrame:
    """(a, b, engine, score): one row per pair in either direction, vectors preferred over words."""
    score = F.get_json_object("metadata", "$.score").try_cast("double")
    kind = F.when(F.get_json_object("metadata", "$.engine") == "neural", "neural").otherwise("tfidf")
    rows = edges.filter("kind = 'similar_to' and source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), kind.alias("engine"), score.alias("score"))
    rows = rows.filter(F.col("engine") == engine) if engine else rows
    best = F.max(F.struct((F.col("engine") == "neural").cast("int").alias("n"), "score", "engine"))
    return rows.groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.engine", "x.score")


def nearest_vectors(rows: DataFrame, key: str, vector: str, every: int, k: int, least: float = -1.0, block: int = 2048) -> DataFrame:
    """(query, neighbour, score): the ``k`` best other rows by cosine of each row whose key is divisible
    by ``every``.

    Queries and rows are packed into blocks of at most about ``block`` vectors; each query block meets each
    row block once, in one task, a matrix product gives the block's best, and the best of all blocks are merged.  Zero and missing vectors
    match nothing; scores are rounded to four digits and ties go to the least key.
    """
    slim = rows.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).filter("i is not null and size(v) > 0")
    asked = slim.filter(F.col("i") % every == 0)
    sizes = slim.agg(F.count("*").alias("n"), F.count_if(F.col("i") % every == 0).alias("q")).first()
    blocks, query_blocks = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // block))
    place = lambda k, seed: F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select("i", "v", place(query_blocks, 1).alias("q"), all_of(blocks).alias("b"), F.lit(True).alias("asks"))
    right = slim.select("i", "v", all_of(query_blocks).alias("q"), place(blocks, 2).alias("b"), F.lit(False).alias("asks"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        lists = pa.concat_arrays(t["v"].chunks)
        length, flat = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        start, all_ids, all_asks = np.cumsum(length) - length, t["i"].to_numpy(), t["asks"].to_numpy()
        for dim in np.unique(length):
            of = np.flatnonzero(length == dim)
            unit = np.nan_to_num(flat[start[of][:, None] + np.arange(dim)])
            norm = np.linalg.norm(unit, axis=1, keepdims=True)
            unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
            ids, asks = all_ids[of], all_asks[of]
            own, ok = ids[~asks], norm[~asks, 0] > 0
            queries, found = np.flatnonzero(asks), []
            for at in range(0, len(queries), 256):
                scores = np.round(unit[queries[at : at + 256]] @ unit[~asks].T, 4) + 0.0
                for row, i in zip(scores, ids[queries[at : at + 256]]):
                    fit = (row >= least) & (own != i) & ok
                    if k < len(row):  # only what reaches the k-th best is sorted
                        fit &= row >= np.partition(np.where(fit, row, -2.0), len(row) - k)[len(row) - k]
                    fit = np.flatnonzero(fit)
                    top = fit[np.lexsort((own[fit], -row[fit]))][:k]
                    found.append((np.full(len(top), i), own[top], row[top]))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "neighbour", "score"])

    dealt = left.unionByName(right).repartition(min(blocks * query_blocks, 400), "q", "b")
    parts = dealt.groupBy("q", "b").applyInArrow(best, "query long, neighbour long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "neighbour")
    return parts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
