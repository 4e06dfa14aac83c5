r"""Ranked lexical search over bit-sliced Bloom signatures (operator 12).

Every document has a Bloom signature of its terms, and of (term, level) for the levels of frequency that a term reaches.
Documents of like signature lengths stand together in blocks of up to 512; a block is stored by slices: for each bit of the
signature the bitmap of the documents that have it set. The slices of a term's bits, anded, give the documents that may hold it and
the most often they may: a Bloom filter errs to one side only, and scores grow with frequency. So the sum over an item's terms of
weight times the largest part is an upper bound of a document's score, here an exact integer.

A search reads the slices twice. First each item's documents with the highest bounds are scored exactly; the lowest of their
best ``limit`` scores is a floor under the result. Then every document whose bound reaches its item's floor is scored
exactly: no other can be in the result. Documents with equal texts have equal scores, so of these only the ``limit`` smallest ids
can be in it, and the text is scored once.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its part (10**9 tf) div (1000 tf + 20 m) with
m = 50 + (50 n N) div L. Terms are told apart by 64-bit hashes.

Scale: the index is built in one pass without a shuffle. Items are searched in groups of about ``most_terms`` (item, term) pairs, which
bounds what is sent to tasks; each task keeps ``limit`` bounds an item. Candidates are few unless documents tie.

Defined cases: a null or empty text has no terms and is never found; items with equal ids are one item with all their terms; an item
without terms finds nothing; a null item id is an id; null document ids come last among ties; rows that repeat are documents each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

HASHES, BITS = 8, 24
DOCUMENTS = 512
#: Frequencies from which a level holds: 1 to 5, then each a quarter above the last, up to 2**38.
LEVELS = np.unique([1, 2, 3, 4, *(int(4 * 1.25**k) for k in range(113))]).astype(np.int64)
INDEX = "doc_id array<long>, t1 array<long>, t2 array<long>, n array<long>, bits long, levels int, slices binary, term array<long>, df array<long>"


# ---------------------------------------------------------------- terms and signatures
def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row as (row, hash, times), sorted by row, and the number of terms of each row with repeats."""
    buf = C.lower(buf)
    starts, ends, first = C.words(buf, offsets, C.LETTER)
    hashes, row = C.PrefixHash(buf)(starts, ends), C.row_of(first)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row))), np.diff(first)


def positions(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The HASHES bits of each (term, level) in a signature of ``bits``."""
    h = C.mix(hashes + np.asarray(level, C.U64) * C.U64(0x9E3779B97F4A7C15))
    one, two = h & C.U64(0xFFFFFFFF), h >> C.U64(32) | C.U64(1)
    return ((one + two * np.arange(HASHES, dtype=C.U64)[:, None]) % C.U64(bits)).astype(np.int64)


def sign(row: np.ndarray, hashes: np.ndarray, times: np.ndarray, rows: int):
    """Blocks of rows with like signatures: (rows, bits, levels, slices), slices a bit matrix with a bitmap of the rows for each bit."""
    reach = np.searchsorted(LEVELS, times, side="right")
    entries = np.bincount(row, weights=reach, minlength=rows)
    kind = np.ceil(2 * np.log2(np.maximum(entries, 16))).astype(np.int64)
    first = np.searchsorted(row, np.arange(rows + 1))
    for k in np.unique(kind):
        bits = int(np.ceil(BITS * 2 ** (k / 2)))
        wide = max(8, min(DOCUMENTS, (1 << 26) // bits))
        members = np.flatnonzero(kind == k)
        for i in range(0, len(members), wide):
            group = members[i : i + wide]
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in group])
            column = np.repeat(np.arange(len(group)), first[group + 1] - first[group])
            flags = np.zeros((bits, len(group)), bool)
            levels = int(reach[at].max(initial=1))
            for level in range(levels):
                has = reach[at] > level
                flags[positions(hashes[at[has]], level, bits), column[has]] = True
            yield group, bits, levels, np.packbits(flags, axis=1)


def build_index(docs: DataFrame, wanted: np.ndarray | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Written table INDEX: a row a block, with the document frequencies there of the ``wanted`` (sorted) terms, or of all."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def build(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            for i, j in C.pieces(offsets, 4 << 20):
                row, hashes, times, n = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = [batch.column(c).slice(i, j - i) for c in ("doc_id", "t1", "t2")]
                held = hashes if sent.value is None else hashes[np.isin(hashes, sent.value)]
                for group, bits, levels, slices in sign(row, hashes, times, j - i):
                    term, df = np.unique(held, return_counts=True)
                    held = held[:0]  # the piece's frequencies go with its first block
                    cells = [[c.take(pa.array(group)).to_pylist()] for c in ids] + [[n[group]], [bits], [levels], [slices.tobytes()], [term.view(np.int64)], [df]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)

    return C.materialize(rows.mapInArrow(build, INDEX), "signatures")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.list_(pa.int64())] * 4 + [pa.int64(), pa.int32(), pa.binary()] + [pa.list_(pa.int64())] * 2


# ---------------------------------------------------------------- searching
class Items:
    """A group of items: sorted term hashes, their weights, and for each item the places of its terms."""

    def __init__(self, ids: list, item_terms: list[np.ndarray], df: dict[int, int], n_docs: int, all_terms: int):
        self.ids, self.n_docs, self.all_terms = ids, n_docs, max(1, all_terms)
        self.hashes = np.unique(np.concatenate([*item_terms, np.zeros(0, C.U64)]).astype(C.U64))
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(int(h), 0) + 1))) for h in self.hashes.view(np.int64)], np.int64)
        self.places = np.concatenate([*(np.searchsorted(self.hashes, t) for t in item_terms), np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in item_terms])]).astype(np.int64)

    def measure(self, n: np.ndarray) -> np.ndarray:
        return 50 + 50 * n.astype(np.int64) * self.n_docs // self.all_terms

    @staticmethod
    def part(times: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * times // (1000 * times + 20 * m)

    def bounds(self, slices: np.ndarray, levels: int, n: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, a row an item and a column a document of the block."""
        may = np.arange(len(self.hashes))
        most, bits = np.zeros((len(may), len(n)), np.int64), None
        for level in range(levels):
            ands = np.bitwise_and.reduce(slices[positions(self.hashes[may], level, len(slices))], axis=0)
            bits = ands if bits is None else bits & ands
            some = bits.any(axis=1)
            may, bits = may[some], bits[some]
            if not len(may):
                break
            upto = n if level == levels - 1 else np.minimum(n, LEVELS[level + 1] - 1)
            most[may] = np.where(np.unpackbits(bits, axis=1, count=len(n)), upto, most[may])
        parts = self.part(most, self.measure(n)) * self.weights[:, None]
        # one more row of zeros, so an item without terms sums to zero
        return np.stack([parts[self.places[a:b]].sum(axis=0) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]) if len(self.ids) else np.zeros((0, len(n)), np.int64)

    def score(self, items: np.ndarray, hashes: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Exact scores of one document, given its distinct terms."""
        tf = np.zeros(len(self.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        tf[at[hit]] = times[hit]
        value = np.where(tf > 0, self.part(tf, self.measure(np.array([n]))), 0) * self.weights
        return np.array([value[self.places[self.first[k] : self.first[k + 1]]].sum() for k in items], np.int64)


def _blocks(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            cell = {c: batch.column(c)[k] for c in ("doc_id", "t1", "t2", "n", "bits", "levels", "slices")}
            n = cell["n"].values.to_numpy()
            slices = np.frombuffer(cell["slices"].as_buffer(), np.uint8).reshape(cell["bits"].as_py(), -1)
            yield cell["doc_id"].values, cell["t1"].values.to_numpy(), cell["t2"].values.to_numpy(), n, slices, cell["levels"].as_py()


PAIRS = "item int, doc_id long, t1 long, t2 long, bound long"


def _pairs(item, ids, t1, t2, doc, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(doc)).cast(pa.int64()), pa.array(t1[doc]), pa.array(t2[doc]), pa.array(bound)], names=["item", "doc_id", "t1", "t2", "bound"])


def highest_bounds(index: DataFrame, sent, limit: int) -> DataFrame:
    """PAIRS: the ``limit`` documents with the highest bounds of each item in each task."""

    def best(batches):
        q = sent.value
        kept: list[list] = [[] for _ in q.ids]
        for ids, t1, t2, n, slices, levels in _blocks(batches):
            bounds = q.bounds(slices, levels, n)
            for item, b in enumerate(bounds):
                least = kept[item][-1][0] if len(kept[item]) >= limit else 0
                at = np.flatnonzero(b > least)
                if len(at):
                    at = at[np.argsort(-b[at], kind="stable")[:limit]]
                    kept[item] = sorted(kept[item] + [(int(b[k]), ids[int(k)].as_py(), int(t1[k]), int(t2[k])) for k in at], key=lambda x: -x[0])[:limit]
        rows = [(item, x[1], x[2], x[3], x[0]) for item, xs in enumerate(kept) for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c == 0 else pa.int64()) for c in range(5)], names=["item", "doc_id", "t1", "t2", "bound"])

    found = index.drop("term", "df").mapInArrow(best, PAIRS)
    first = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last(), "t1", "t2")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= limit).drop("r")


def reaching(index: DataFrame, sent, floors, limit: int) -> DataFrame:
    """PAIRS: every document whose bound reaches its item's floor; of equal texts in a block the ``limit`` smallest ids."""

    def reach(batches):
        q = sent.value
        for ids, t1, t2, n, slices, levels in _blocks(batches):
            item, doc = np.nonzero(q.bounds(slices, levels, n) >= floors.value[:, None])
            if not len(item):
                continue
            number = ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((number, t2[doc], t1[doc], item))
            item, doc = item[order], doc[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (t1[doc[1:]] != t1[doc[:-1]]) | (t2[doc[1:]] != t2[doc[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(item)), 0))
            few = np.arange(len(item)) - begin < limit
            yield _pairs(item[few], ids, t1, t2, doc[few], np.zeros(int(few.sum()), np.int64))

    found = index.drop("term", "df").mapInArrow(reach, PAIRS)
    same = Window.partitionBy("item", "t1", "t2").orderBy(F.col("doc_id").asc_nulls_last())
    return found.withColumn("r", F.row_number().over(same)).where(F.col("r") <= limit).drop("r", "bound")


def exact(docs: DataFrame, pairs: DataFrame, sent, text: str, id: str, broadcast_rows: int) -> DataFrame:
    """item, t1, t2, score: the exact score of each pair's text, read once from the text's first document among the pairs."""
    texts = pairs.groupBy("t1", "t2").agg(F.collect_set("item").alias("items"), F.min("doc_id").alias("owner"))
    texts = C.materialize(texts.withColumnsRenamed({"t1": "k1", "t2": "k2"}), "search-texts")
    if texts.count() <= broadcast_rows:
        texts = F.broadcast(texts)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), F.col(text).cast("string").alias("t"))
    rows = rows.join(texts, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("owner"))).select("t", "t1", "t2", "items")

    def rescore(batches):
        q = sent.value
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for i, j in C.pieces(offsets):
                row, hashes, times, n = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    items = batch.column("items")[i + k].values.to_numpy()
                    a, b = first[k], first[k + 1]
                    s = q.score(items, hashes[a:b], times[a:b], int(n[k]))
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(np.full(len(s), t1[i + k])), pa.array(np.full(len(s), t2[i + k])), pa.array(s)], names=["item", "t1", "t2", "score"])

    return C.materialize(rows.mapInArrow(rescore, "item int, t1 long, t2 long, score long").distinct(), "search-scores")


def item_terms(items: DataFrame, text: str = "text", id: str = "item_id") -> DataFrame:
    """Written table item_id, term: the distinct terms of each item (a null term for an item without any)."""
    kind = dict(items.select(F.col(id).alias("item_id")).dtypes)["item_id"]

    def split(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            row, hashes, _, _ = terms(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    return C.materialize(items.select(F.col(id).alias("item_id"), F.col(text).cast("string").alias("t")).mapInArrow(split, f"item_id {kind}, term long").distinct(), "item-terms")


def search(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", limit: int = 50, most_terms: int = 16_384, wanted_terms: int = 1 << 22, broadcast_rows: int = 1 << 18) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` best documents of each item. ``wanted_terms``: up to so many terms are sent to all tasks to
    count their documents; with more, all terms are counted and joined."""
    spark = docs.sparkSession
    asked = item_terms(items, item_text, item_id)
    distinct = asked.select("term").distinct()
    few = distinct.count() <= wanted_terms
    index = build_index(docs, np.sort(distinct.toArrow()["term"].to_numpy().view(C.U64)) if few else None, text, id)
    df = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"))
    asked = C.materialize(asked.join(df, "term", "left").fillna(0, ["df"]), "asked-terms")
    n = F.explode("n").alias("n")
    n_docs, all_terms = index.select(n).where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, -(-asked.count() // most_terms))
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs")).toArrow()
        own = [np.sort(np.array(t, np.int64).view(C.U64)) for t in rows["terms"].to_pylist()]
        dfs = dict(zip(rows["terms"].combine_chunks().flatten().to_pylist(), rows["dfs"].combine_chunks().flatten().to_pylist(), strict=True)) if rows.num_rows else {}
        sent = spark.sparkContext.broadcast(Items(rows["item_id"].to_pylist(), own, dfs, n_docs, all_terms))
        top = C.materialize(highest_bounds(index, sent, limit), "highest-bounds")
        known = exact(docs, top, sent, text, id, broadcast_rows).where("score > 0")
        # the floor of an item is the score its result's last document has at least: 1 where fewer than ``limit`` are known
        nth = Window.partitionBy("item").orderBy(F.col("score").desc())
        known = top.join(known, ["item", "t1", "t2"]).withColumn("r", F.row_number().over(nth)).where(F.col("r") == limit).select("item", "score").toArrow()
        floors = np.ones(rows.num_rows, np.int64)
        floors[known["item"].to_numpy()] = known["score"].to_numpy()
        pairs = C.materialize(reaching(index, sent, spark.sparkContext.broadcast(floors), limit), "reaching")
        scored = pairs.join(exact(docs, pairs, sent, text, id, broadcast_rows), ["item", "t1", "t2"]).where("score > 0")
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        scored = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int32()), "item_id": rows["item_id"]}))
        found = scored.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
st AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tok WHERE w IN (SELECT w FROM q) GROUP BY ALL),
wt AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, st GROUP BY w, nn),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // ll) AS m FROM len, st),
s AS (SELECT item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (w) JOIN wt USING (w) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
