"""Variable-capacity best-fit packing (operator 5).

Documents, measured in words, are cut into pieces no longer than the longest permitted sequence and
packed into sequences of several permitted lengths. Pieces go in decreasing length to the open bin
with the least room that still holds them. Where none does, a bin is opened in the size that costs
least for each word expected in it: ``cost(c) = c + c * c / attention`` over the piece itself plus
what the shorter pieces still to come can fill of the rest. At the end each bin is downsized to the
shortest permitted length that holds its contents.

Pieces are dealt by hash into shards of about ``shard_rows`` pieces that are packed independently,
so no task sees more than a bounded number of pieces and a rerun gives the same bins.

Defined cases: null and empty texts have no words, so they get no piece and no row; equal rows are separate pieces, dealt
to shards like others; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def pack(lengths: list[int] | np.ndarray, capacities: tuple[int, ...] = CAPACITIES, attention: float = 8192.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length (decreasing): its bin, its start in the bin; and the final capacity of each bin."""
    lengths = np.asarray(lengths, np.int64)
    sizes = sorted(capacities)
    if len(lengths) and (lengths.max() > sizes[-1] or (np.diff(lengths) > 0).any() or lengths.min() < 1):
        raise ValueError("lengths must be decreasing, positive and no longer than the largest capacity")
    cost = {c: c + c * c / attention for c in sizes}
    left_words = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # words of a piece and all after it
    up = -lengths  # ascending, for the first piece no longer than some room
    bins, starts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    fill: list[int] = []
    for k, n in enumerate(lengths.tolist()):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            best = None
            for c in sizes:
                if c >= n:
                    first = max(k + 1, int(np.searchsorted(up, -(c - n), side="left")))
                    words = n + min(c - n, int(left_words[first])) if c > n else n
                    if best is None or cost[c] / words < best[0]:
                        best = (cost[c] / words, c)
            free, b = best[1], len(fill)
            fill.append(0)
        bins[k], starts[k] = b, fill[b]
        fill[b] += n
        if free > n:
            insort(room, (free - n, b))
    ends = np.asarray(sizes)[np.searchsorted(sizes, fill)] if fill else np.zeros(0, np.int64)
    return bins, starts, ends


def pack_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, attention: float = 8192.0, shard_rows: int = 20_000) -> DataFrame:
    """A row for each piece: doc_id, piece, from_word, n_words, shard, bin, at (its start in the bin), bin_words, capacity."""
    longest = max(capacities)
    sizes = C.materialize(docs.select(F.col(id).cast("long").alias("doc_id"), C.n_words(text).alias("words"), F.xxhash64(F.col(text)).alias("key")), "pack-sizes")
    each = sizes.where("words > 0").groupBy("doc_id", "key", "words").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = each.select("doc_id", "key", "copy", F.posexplode(F.sequence(F.lit(0), F.col("words") - 1, F.lit(longest))).alias("piece", "from_word"), "words")
    rows = rows.select("doc_id", "key", "copy", "piece", "from_word", F.least(F.lit(longest), F.col("words") - F.col("from_word")).alias("n_words"))
    n = int(sizes.agg(F.sum(F.ceil(F.col("words") / longest))).first()[0] or 0)
    shards = max(1, -(-n // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece", "copy"), F.lit(shards)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "doc_id", "piece", "key"], ascending=[False, True, True, True], na_position="last").reset_index(drop=True)
        bins, starts, ends = pack(part["n_words"].to_numpy(), capacities, attention)
        used = np.bincount(bins, part["n_words"], minlength=len(ends)).astype(np.int64)
        return part.assign(bin=bins, at=starts, bin_words=used[bins], capacity=ends[bins])[["doc_id", "piece", "from_word", "n_words", "shard", "bin", "at", "bin_words", "capacity"]].astype({"doc_id": "Int64"})

    return rows.groupBy("shard").applyInPandas(run, "doc_id long, piece long, from_word long, n_words long, shard long, bin long, at long, bin_words long, capacity long")


def op5_best_fit(spark, sf_dir: str) -> DataFrame:
    """The placement of every piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
