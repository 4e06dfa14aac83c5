"""Quality rules from cross-document line frequency (operator 1).

Lines are normalised (words with A-Z lower-cased, joined by one blank) and hashed; within each host
the number of *distinct* documents holding a line is counted, where exact copies of a text count
once. A line held by more than ``max(min_docs, share * documents of the host)`` is boilerplate: it
stays in the document with the smallest doc_id that holds it and is removed everywhere else. A
document is rejected when it fails the base rules, or when less than ``min_left`` of its words stay.

Defined cases: a null text is an empty one (no words: rejected by the base rules); a null host is a
host of its own; rows that repeat (same id, host, text) get equal verdicts and each stays a row; a
null doc_id never owns a line unless all holders are null; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

PROFILE = (
    "doc_id long, host string, key1 long, key2 long, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"
)


def _profile_piece(buf: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Counts for each row, and hash and words of each line, of a slice of whole rows."""
    n_rows = len(offsets) - 1
    starts, ends, first = C.words(buf, offsets)
    counts = np.diff(first)
    exact, small = C.PrefixHash(buf), C.PrefixHash(C.lower(buf))
    out = {"n_words": counts, "n_symbols": C.per_row(_SYMBOL[buf], offsets)}
    out["word_chars"] = C.per_row(~C._SPACE[buf] & ((buf & 0xC0) != 0x80), offsets)

    # lines: cut at every \n and at every row
    breaks = np.flatnonzero(buf == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n_lines = 1 + np.bincount(row_of_break, minlength=n_rows)
    line_off = np.concatenate([[0], np.cumsum(n_lines)])
    line_start = np.empty(line_off[-1], np.int64)
    line_start[line_off[:-1]] = offsets[:-1]
    later = np.ones(line_off[-1], bool)
    later[line_off[:-1]] = False
    line_start[later] = breaks + 1
    line_end = np.empty_like(line_start)
    line_end[:-1] = np.where(later[1:], line_start[1:] - 1, line_start[1:])
    if len(line_end):
        line_end[-1] = len(buf)
    line_row = C.row_of(line_off)
    a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    line_words = b - a
    # a normalised line is the sequence of its words' hashes
    hashes = small(starts, ends)
    up, down = C._powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, C.U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    line_hash = C.mix((sums[b] - sums[a]) * down[a] + line_words.astype(C.U64))
    line_hash[line_words == 0] = 0
    out |= {"line_hash": line_hash.view(np.int64), "line_words": line_words, "line_off": line_off}

    # lines with a word that equal an earlier one, byte for byte
    worded = line_words > 0
    raw = exact(line_start, line_end)[worded]
    rows = line_row[worded]
    order = np.lexsort((raw, rows))
    same = np.zeros(len(raw), bool)
    same[1:] = (raw[order][1:] == raw[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out["n_dup_lines"] = np.bincount(rows[order][same], minlength=n_rows)

    # words inside a window of words that the same row holds twice or more
    grams = C.chain(exact(starts, ends), window)
    row = C.row_of(first)
    at = np.flatnonzero(first[1:][row[: len(grams)]] - np.arange(len(grams)) >= window) if len(grams) else np.zeros(0, np.int64)
    keys = C.mix(grams[at] + row[at].astype(C.U64) * C.U64(0xD6E8FEB86659FD93))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    edge = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[spot] == keys]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
    out["n_repeat_words"] = C.per_row(np.cumsum(edge)[:-1] > 0, first)
    return out


def line_profile(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", window: int = 5) -> DataFrame:
    """Base counts of every row and hash and word count of each of its lines (schema PROFILE)."""
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text)).alias("key1"), F.xxhash64(F.col(text), F.lit(1)).alias("key2"),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def profile(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("text"))
            for i, j in C.pieces(offsets):
                part = _profile_piece(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in ("doc_id", "host", "key1", "key2")]
                    + [pa.array(part[c], pa.int64()) for c in names]
                    + [C.lists(part["line_hash"], part["line_off"], pa.int64()), C.lists(part["line_words"], part["line_off"], pa.int32())],
                    names=["doc_id", "host", "key1", "key2", *names, "line_hash", "line_words"],
                )

    return rows.mapInArrow(profile, PROFILE)


_KEY = ("doc_id", "host", "key1", "key2")


def _by_parts(each: DataFrame, often: DataFrame, at: Column, most: int) -> DataFrame:
    """Join of lines with frequent ones. A hot line is one key of a shuffle, so lines that make up 1 / ``most`` of all places or more,
    ``most`` at most, are sent to all tasks (hosts of up to 1 KiB, so 64 MB); rarer ones are joined unless all can be sent."""
    n, places, longest = often.agg(F.count(F.lit(1)), F.sum("n_docs"), F.max(F.octet_length("o_host"))).first()
    if n <= most and (longest or 0) <= 1024:
        return each.join(F.broadcast(often), at)
    hot = F.coalesce((F.col("n_docs") * most >= places) & (F.octet_length("o_host") <= 1024), F.col("n_docs") * most >= places)
    return each.join(F.broadcast(often.where(hot)), at).unionByName(each.join(often.where(~hot), at))


def line_verdicts(profile: DataFrame, many: int = 50, few: int = 3, share: float = 0.05, min_left: float = 0.3, min_words: int = 10, repeat_percent: int = 20, broadcast_lines: int = 1 << 16) -> DataFrame:
    """A row for each row of ``profile``: the base counts, removed_lines (positions), removed_words, base_failed, kept."""
    texts = profile.groupBy("host", "key1", "key2").agg(F.min("doc_id").alias("owner"), F.first("line_hash").alias("lines"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts"))
    hosts = hosts.withColumnRenamed("host", "h_host")
    lines = (
        texts.select("host", "owner", F.explode(F.array_distinct("lines")).alias("line")).where("line != 0")
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("owner").alias("owner"))
        .where(F.col("n_docs") > few)
    )
    often = lines.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).where((F.col("n_docs") > many) | (F.col("n_docs") > F.col("n_texts") * share)).select(F.col("host").alias("o_host"), F.col("line").alias("o_line"), "owner", "n_docs")
    often = C.materialize(often, "often-lines")
    each = profile.dropDuplicates(list(_KEY)).select(*_KEY, F.posexplode(F.arrays_zip("line_hash", "line_words")).alias("pos", "x")).select(*_KEY, "pos", F.col("x.line_hash").alias("line"), F.col("x.line_words").alias("words"))
    at = (F.col("line") == F.col("o_line")) & F.col("host").eqNullSafe(F.col("o_host")) & ~F.col("doc_id").eqNullSafe(F.col("owner"))
    removed = (
        _by_parts(each, often, at, broadcast_lines)
        .groupBy(*_KEY).agg(F.sum("words").cast("long").alias("removed_words"), F.collect_list("pos").alias("removed_lines"))
    )
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    removed = removed.toDF(*(f"r_{c}" for c in _KEY), "removed_words", "removed_lines")
    same = F.lit(True)
    for k in _KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return (
        profile.join(removed, same, "left")
        .select(*(c for c in profile.columns if not c.startswith("line_")), F.coalesce("removed_words", F.lit(0)).alias("removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), base.alias("base_failed"), (~base & (left >= F.col("n_words") * min_left)).alias("kept"))
    )


def clean_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns, the text without its removed lines."""
    verdicts = line_verdicts(C.materialize(line_profile(docs, text, id, host), "line-profile"), **limits)
    verdicts = verdicts.where("kept").dropDuplicates(list(_KEY)).select(*_KEY, "removed_lines")
    d, h, k1, k2, lines = C.free_name(docs, "_doc_id", "_host", "_key1", "_key2", "_removed_lines")
    same = (
        F.col(id).cast("long").eqNullSafe(F.col(d)) & F.col(host).cast("string").eqNullSafe(F.col(h))
        & (F.xxhash64(F.col(text)) == F.col(k1)) & (F.xxhash64(F.col(text), F.lit(1)) == F.col(k2))
    )
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(lines), i)), "\n")
    return docs.join(verdicts.toDF(d, h, k1, k2, lines), same).select(*(F.when(F.size(lines) == 0, F.col(c)).otherwise(left).alias(c) if c == text else docs[c] for c in docs.columns))


def op1_line_frequency(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    profile = C.materialize(line_profile(spark.read.parquet(f"{sf_dir}/documents.parquet")), "line-profile")
    return line_verdicts(profile).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, p, ws[p : p + 4] AS g FROM win),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
  SELECT g.doc_id, unnest([p, p + 1, p + 2, p + 3, p + 4]) AS q FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (SELECT w.doc_id, w.source, w.text, len(ws)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dl USING (doc_id)),
ln AS (SELECT doc_id, source, text, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
texts AS (SELECT source, text, min(doc_id) AS owner FROM d GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n_texts FROM texts GROUP BY 1),
held AS (SELECT t.source, l, count(*) AS n_docs, min(owner) AS owner FROM texts t
  JOIN (SELECT DISTINCT source, text, l FROM ln WHERE len(l) > 0) USING (source, text) GROUP BY ALL),
often AS (SELECT h.* FROM held h JOIN hosts USING (source) WHERE n_docs > 50 OR (n_docs > 3 AND n_docs > n_texts * 0.05)),
rem AS (SELECT doc_id, sum(len(l)) AS n FROM ln JOIN often USING (source, l) WHERE doc_id <> owner GROUP BY 1),
v AS (SELECT base.*, coalesce(rem.n, 0)::BIGINT AS removed_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base LEFT JOIN rem USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_words - removed_words >= n_words * 0.3) AS kept, removed_words FROM v
"""
