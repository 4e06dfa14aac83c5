"""Target-distribution importance resampling with segment deduplication (operator 13).

A document's features are its runs of 1 to ``n`` consecutive words, hashed into buckets. A bucket's gain is the log of its
share among the target's features over its share among all documents; a document weighs the sum of its features' gains,
and the documents with the highest weight plus Gumbel noise are a draw without replacement by those weights.

Line breaks separate words, so they cut texts into segments. A line that thousands of documents share is stored once: the
features of each distinct line are counted once and multiplied by the line's occurrences, both for the bucket totals and
for the weights. Runs that span a line break belong to no line and are added document by document.

Scale: distinct lines are found by one aggregation over (two hashes of) lines, with partial sums before the shuffle. Lines
of at least ``1 / 2**16`` of all occurrences are at most 2**16, so their weights are broadcast; every other line is joined
with its documents, and none of those has more rows than that share. Ranks come from a range partitioning and its counts.

Defined cases: a null text has no words; a null id counts as the text ``null`` for the noise and comes last among ties; rows
that repeat (id and text) are documents each, with equal scores and ranks of their own; without features in the target, or
in the documents, gains follow from the formula with that total 0; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # eight steps of the reflected polynomial
    _TABLE = (_TABLE >> 1) ^ np.where(_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0))
SUMS = "weight long, n_features long, n_words long"


# ---------------------------------------------------------------- features of words
def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of many stretches at once, each continued from ``before``; stretches over 64 bytes are done one by one."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    size = ends - starts
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(out[i]))
    todo = np.flatnonzero(size <= 64)
    todo = todo[np.argsort(-size[todo], kind="stable")]
    state, at, size = ~out[todo], starts[todo], size[todo]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # those longer than k come first
        state[:n] = (state[:n] >> np.uint32(8)) ^ _TABLE[(state[:n] ^ buf[at[:n] + k]) & np.uint32(255)]
    out[todo] = ~state
    return out


def runs(buf: np.ndarray, offsets: np.ndarray, n: int, buckets: int, lines_apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every run of 1 to ``n`` words, and the words of each row; ``lines_apart``: only runs that span a line break."""
    buf = C.lower(buf)
    starts, ends, first = C.words(buf, offsets, C.LETTER)
    row = C.row_of(first)
    line = np.concatenate([[0], np.cumsum(buf == 10)])[starts] if lines_apart else None
    space, states, found = np.array([32], np.uint8), None, []
    for k in range(n):
        at = np.arange(max(0, len(starts) - k))
        at = at[row[at] == row[at + k]] if len(at) else at
        if k == 0:
            states = crc32(buf, starts, ends)
        else:
            joined = crc32(space, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), states[at])
            states[at] = crc32(buf, starts[at + k], ends[at + k], joined)
        if lines_apart:
            at = at[line[at] != line[at + k]]
        found.append((states[at] % np.uint32(buckets), row[at]))
    of = np.concatenate([r for _, r in found])
    order = np.argsort(of, kind="stable") if n > 1 else slice(None)
    return np.concatenate([b for b, _ in found]).astype(np.int32)[order], of[order], np.diff(first)


# ---------------------------------------------------------------- segments
def _rows(docs: DataFrame, text: str, id: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("t1"), F.xxhash64(t, F.lit(1)).alias("t2"))


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.split("t", "\n", -1)).alias("line")).where("line <> ''")


def segments(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """Written table of the distinct lines: k1, k2 (their hashes), times, n_words, buckets (of their runs)."""
    distinct = _lines(rows).groupBy("line").agg(F.count(F.lit(1)).alias("times"))

    def count(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("line"))
            for i, j in C.pieces(offsets):
                b, row, words = runs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, buckets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("k1", "k2", "times")), pa.array(words, pa.int64()), C.lists(b, np.searchsorted(row, np.arange(j - i + 1)), pa.int32())], names=["k1", "k2", "times", "n_words", "buckets"])

    keyed = distinct.select(F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"), "times", "line")
    return C.materialize(keyed.mapInArrow(count, "k1 long, k2 long, times long, n_words long, buckets array<int>"), "segments")


def totals(rows: DataFrame, lines: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, total: features of all rows, from the distinct lines times their occurrences and the runs across lines."""

    def add(batches):  # one array of ``buckets`` numbers a task
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            b = batch.column("buckets")
            sizes = np.diff(b.offsets.to_numpy())
            times = np.repeat(batch.column("times").to_numpy(), sizes)
            np.add.at(sums, b.flatten().to_numpy(), times)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "total"])

    def across(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            for i, j in C.pieces(offsets):
                sums += np.bincount(runs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, buckets, True)[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "total"])

    out = lines.select("times", "buckets").mapInArrow(add, "bucket long, total long")
    if n > 1:
        out = out.unionByName(rows.select("t").mapInArrow(across, "bucket long, total long"))
    return out.groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(docs_totals: DataFrame, target_totals: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket: ``buckets`` numbers, whatever the input."""
    spark = docs_totals.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(docs_totals.withColumnRenamed("total", "s"), "bucket", "left").join(target_totals.withColumnRenamed("total", "t"), "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1).cast("double") * (all_s + buckets) / ((F.col("s") + 1).cast("double") * (all_t + buckets))))
    return both.select("bucket", gain.alias("gain")).orderBy("bucket").toArrow()["gain"].to_numpy().astype(np.int64)


# ---------------------------------------------------------------- weights and the draw
def weights(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", n: int = 1, buckets: int = 10_000, often: int = 1 << 16) -> DataFrame:
    """doc_id, n_features, n_words, weight for each row of ``docs``; ``often``: lines with at least this part of all occurrences are broadcast."""
    spark = docs.sparkSession
    rows, wanted = _rows(docs, text, id), _rows(target.select(target_text).withColumn("_no", F.lit(0)), target_text, "_no")
    lines = segments(rows, n, buckets)
    sent = spark.sparkContext.broadcast(gains(totals(rows, lines, n, buckets), totals(wanted, segments(wanted, n, buckets), n, buckets), buckets))

    def weigh(batches):
        for batch in batches:
            b = batch.column("buckets")
            offsets = b.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(sent.value[b.flatten().to_numpy()])])
            offsets = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("times"), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]), pa.array(np.diff(offsets), pa.int64()), batch.column("n_words")], names=["k1", "k2", "times", "weight", "n_features", "n_words"])

    def across(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            for i, j in C.pieces(offsets):
                b, row, _ = runs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, buckets, True)
                at = np.searchsorted(row, np.arange(j - i + 1))
                sums = np.concatenate([[0], np.cumsum(sent.value[b])])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "t1", "t2")), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(np.diff(at), pa.int64()), pa.array(np.zeros(j - i, np.int64))], names=["doc_id", "t1", "t2", "weight", "n_features", "n_words"])

    weighed = C.materialize(lines.mapInArrow(weigh, f"k1 long, k2 long, times long, {SUMS}"), "segment-weights")
    share = (weighed.agg(F.sum("times")).first()[0] or 0) / often
    hot, rest = weighed.where(F.col("times") >= share).drop("times"), weighed.where(F.col("times") < share).drop("times")
    doc, sums = ("doc_id", "t1", "t2"), ("weight", "n_features", "n_words")
    links = _lines(rows, *doc).select(*doc, F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"))
    parts = [rows.select(*doc, *(F.lit(0).cast("long").alias(c) for c in sums), F.lit(1).cast("long").alias("rows"))]
    parts += [links.join(F.broadcast(hot), ["k1", "k2"]).select(*doc, *sums, F.lit(0).cast("long").alias("rows"))]
    parts += [links.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(rest.hint("shuffle_hash"), ["k1", "k2"]).select(*doc, *sums, F.lit(0).cast("long").alias("rows"))]
    if n > 1:
        parts += [rows.mapInArrow(across, f"doc_id long, t1 long, t2 long, {SUMS}").withColumn("rows", F.lit(0).cast("long"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # rows that repeat are summed together and told apart again
    every = every.groupBy(*doc).agg(*(F.sum(c).alias(c) for c in (*sums, "rows")))
    return every.select("doc_id", *((F.col(c) / F.col("rows")).cast("long").alias(c) for c in sums), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy")


def draw(weighed: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of ``weighed``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = C.materialize(weighed.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise).cast("long").alias("score")), "resampling-scores")
    able = scored.where(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    placed = C.materialize(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-order")
    counts = placed.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = placed.join(F.broadcast(counts), "part").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    out = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*out, "rank").unionByName(scored.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards ``benchmark``."""
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return draw(weights(docs, target))


OP13_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM w UNION ALL SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda p: ('0x' || substr(hex(encode(w)), p, 2))::BIGINT),
  lambda c, x: xor(tab.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS b FROM v, tab),
s AS (SELECT b, count(*) AS s FROM w JOIN b USING (w) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM g JOIN b USING (w) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT b.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
d AS (SELECT doc_id, count(w) AS n_features, coalesce(sum(gain), 0)::BIGINT AS weight FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN b USING (w) LEFT JOIN gain USING (b) GROUP BY 1),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM r) THEN r END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
