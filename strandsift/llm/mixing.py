"""Mixing sources to target weights by systematic sampling (operator 4, DataFrame functions only).

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words. A
target stops at ``most`` times the words of its source; what is cut there goes to the others by
weight, until none is above. Within a source every document is expected target / words times; the
running sum of these expectations plus one random offset passes whole numbers, and a document is
emitted once for each number that its step passes.

The running sum is distributed: documents fall into hash buckets of about ``per_bucket`` rows, in
each (source, bucket) they are ranked by size (so large and small documents are hit alike), and
buckets are chained by their row counts. Only per-source and per-bucket counts meet in a window.

Defined cases: a null text has size 0; a source without words has target 0 and emits nothing; a null
source is the last one; equal rows are interchangeable; an empty table gives an empty table. All
numbers are exact integers up to one division, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def _uniform(*parts: Column) -> Column:
    """A number below 2**32 from md5, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From rows (source, size): source, n_docs, source_size, target. One row a source; the window sees only those rows."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    # water level: sources reach their cap in the order of cap / weight; the first k capped ones leave the rest its level
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    weigh = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_left", left).withColumn("_weigh", weigh)
    # a source is capped when its cap is not above its share of what those before it leave
    capped = F.col("source_size") * most * F.col("_weigh") <= F.col("_left") * F.col("weight")
    per = per.withColumn("_capped", capped)
    per = per.withColumn("_k", F.row_number().over(by_cap))
    first = F.min(F.when(~F.col("_capped"), F.struct("_k", "_left", "_weigh"))).over(whole)
    target = F.when(F.col("_capped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("_f._left").cast("double") * F.col("weight") / F.col("_f._weigh"))
    return per.withColumn("_f", first).select("source", "n_docs", "source_size", target.alias("target"))


def copies(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", seed: int = 7, per_bucket: int = 8192, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies for each row of ``docs``."""
    sizes = C.materialize(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), C.n_words(text).alias("size"), F.xxhash64(F.col(text)).alias("text_key")), "mix-sizes")
    per = targets(sizes, weights, most).withColumn("k", F.ceil(F.col("n_docs") / per_bucket))
    rows = sizes.alias("d").join(per.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "n_docs", "source_size", "target", (_uniform(F.lit(seed), F.col("doc_id")) % F.col("k")).alias("bucket"))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("size", F.col("doc_id").asc_nulls_last(), "text_key")))
    placed = ranked.join(counts, ranked["source"].eqNullSafe(counts["b_source"]) & (ranked["bucket"] == counts["b_bucket"]))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = _uniform(F.lit(seed), F.lit("offset"), F.col("source")) / F.lit(4294967296.0)
    upto = lambda k: F.floor((F.col("before") + k) * F.col("step") + F.col("start"))
    placed = placed.withColumn("step", step).withColumn("start", start)
    # one whole number can be passed twice by no step; rounding of the sum never exceeds ``most``
    taken = F.least(upto(F.col("rank")) - upto(F.col("rank") - 1), F.lit(most).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "text_key", taken.alias("n_copies"))


def mix_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns as they are."""
    n = copies(docs, text, id, source, **how)
    # rows that agree in id, source and text share out the copies of their group; only those need a window
    n = n.groupBy("doc_id", "source", "text_key").agg(F.sum("n_copies").alias("all"), F.count(F.lit(1)).alias("rows")).where("all > 0")
    d, s, k, a, r, t = C.free_name(docs, "_id", "_source", "_key", "_all", "_rows", "_times")
    n = C.materialize(n.toDF(d, s, k, a, r), "mix-copies")
    same = F.col(id).cast("long").eqNullSafe(F.col(d)) & F.col(source).cast("string").eqNullSafe(F.col(s)) & (F.xxhash64(F.col(text)) == F.col(k))
    single = docs.join(n.where(F.col(r) == 1), same).withColumn(t, F.col(a))
    nth = F.row_number().over(Window.partitionBy(d, s, k).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns)))))
    many = docs.join(n.where(F.col(r) > 1), same).withColumn(t, F.floor(F.col(a) / F.col(r)) + (nth <= F.col(a) % F.col(r)).cast("long"))
    return _repeat(single.unionByName(many), t).select(*docs.columns)


def _repeat(rows: DataFrame, times: str) -> DataFrame:
    return rows.where(F.col(times) > 0).withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int"))))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS ss FROM d GROUP BY 1),
q AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY ss / w, source NULLS LAST) AS k FROM q),
c AS (SELECT *, (sum(ss) OVER () - coalesce(sum(ss * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
  (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wgh FROM o),
t AS (SELECT source, n_docs, ss, CASE WHEN ss * 3 * wgh <= lft * w THEN (ss * 3)::DOUBLE
  ELSE (SELECT arg_min(lft, k) FROM c WHERE ss * 3 * wgh > lft * w)::DOUBLE * w::DOUBLE / (SELECT arg_min(wgh, k) FROM c WHERE ss * 3 * wgh > lft * w)::DOUBLE END AS target FROM c),
r AS (SELECT d.doc_id, d.source, d.size, t.ss, t.target,
  ('0x' || substr(md5('7/' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % ceil(t.n_docs / 8192)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, size, doc_id NULLS LAST) AS rk FROM r),
s AS (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS step,
  ('0x' || substr(md5('7/offset/' || coalesce(source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM n)
SELECT doc_id, size, ss AS source_size, target,
  (size * least((floor(rk * step + start) - floor((rk - 1) * step + start))::BIGINT, 3))::BIGINT AS taken FROM s
"""
