"""Toxicity from class-conditional Kneser-Ney models (operator 11).

Texts are read as the bytes of their words (ASCII letters and digits, A-Z lower-cased, and all that is not ASCII), a space behind
each and ``order - 1`` spaces before the first. For each class a Kneser-Ney model gives the probability of a byte after the bytes before it: counts at the highest order,
numbers of distinct bytes in front at lower orders, absolute discounts, and below both classes the same lowest orders,
whose counts are shared, so an expression that either class has hardly seen has nearly equal probabilities in both. A
text's evidence is its toxic log-likelihood less its ordinary one, by the number of its bytes (and ``steady`` more, so a
few bytes prove little). A logistic curve that allows for wrong labels turns evidence into a score from 0 to 1.

Models learn from at most ``max_rows`` texts of each label, the first by hash, none over ``max_chars`` characters, and keep
at most ``max_grams`` strings, rare ones go first (documented bounds of the fit only: they bound what is sent to all
tasks). A third of these texts are kept back to fit the curve and to choose the order with the better likelihood; then
the models learn from all. Every whole text of the table is scored.

Defined cases: a null or empty text is scored by its end alone; a document with several labels is toxic if one says so; null
ids and null labels are not learned from; rows that repeat are scored each, equal texts equally; if one label is missing,
nothing can be learned and every score is the share of toxic labels (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TOP = 5
SCORED = "doc_id long, score double, predicted int, evidence double, n_bytes long"


# ---------------------------------------------------------------- strings of a text
def symbols(buf: np.ndarray, offsets: np.ndarray, order: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Words of the rows with a space behind each and ``order - 1`` in front of a row, and the row of each predicted byte (-1: context only)."""
    n, row = len(offsets) - 1, C.row_of(offsets)
    spelled = C.LETTER[buf]
    kept = spelled.copy()
    kept[1:] |= spelled[:-1] & (row[1:] == row[:-1])  # the first byte behind a word becomes its space
    sym, row, last = np.where(spelled, C.lower(buf), np.uint8(32))[kept], row[kept], np.ones(n, bool)
    size = np.bincount(row, minlength=n)
    ends = np.cumsum(size)
    last[size > 0] = sym[ends[size > 0] - 1] != 32  # a row that ends in its word, or is empty, gets one space more
    size, lead = size + last, order - 1
    starts = np.concatenate([[0], np.cumsum(size + lead)])
    out, owner = np.full(starts[-1], 32, np.uint8), np.repeat(np.arange(n), size + lead)
    at = np.arange(len(sym)) - np.concatenate([[0], ends])[row] + starts[row] + lead
    out[at] = sym
    owner[(starts[:-1, None] + np.arange(lead)).ravel()] = -1
    return out, owner


def strings(sym: np.ndarray, order: int = TOP) -> np.ndarray:
    """The ``order`` bytes that end at each position, the last one lowest."""
    out, wide = np.zeros(len(sym), C.U64), sym.astype(C.U64)
    for k in range(order):
        out[k:] |= wide[: len(sym) - k] << C.U64(8 * k)
    return out


def _tail(keys: np.ndarray, k: int) -> np.ndarray:
    return keys & C.U64((1 << 8 * k) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


# ---------------------------------------------------------------- the models
@dataclass
class Models:
    """For each order: sorted strings with log(toxic / ordinary probability of the last byte), and contexts with that of their backoff."""

    order: int
    keys: list[np.ndarray] = field(default_factory=list)
    ratio: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    steady: float = 100.0
    slope: float = 1.0
    bias: float = 0.0

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """log(toxic / ordinary probability) of the last byte of each string."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            now = _tail(keys[todo], k)
            at, hit = _find(self.keys[k - 1], now)
            out[todo[hit]] += self.ratio[k - 1][at[hit]]
            todo, now = todo[~hit], now[~hit] >> C.U64(8)
            at, hit = _find(self.contexts[k - 1], now)
            out[todo[hit]] += self.backoff[k - 1][at[hit]]
        return out

    def rows(self, buf: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Evidence by length and number of predicted bytes of each row; a long row is read in blocks."""
        sym, owner = symbols(buf, offsets, self.order)
        n = len(offsets) - 1
        total = np.zeros(n)
        for i in range(0, len(sym), block):
            lead = min(i, self.order - 1)
            mine = owner[i : i + block]
            keys, where = np.unique(strings(sym[i - lead : i + block], self.order)[lead:][mine >= 0], return_inverse=True)
            total += np.bincount(mine[mine >= 0], weights=self.evidence(keys)[where], minlength=n)
        size = np.bincount(owner[owner >= 0], minlength=n)
        return total / (size + self.steady), size

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -700, 700)))


def discount(counts: np.ndarray) -> float:
    """Kneser and Ney's estimate from the numbers of counts of one and two."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def fit_models(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, shared: int = 1) -> Models:
    """Models of ``order`` from distinct strings of at least that length and their counts; orders up to ``shared`` pool both classes."""
    keys, at = np.unique(_tail(keys, order), return_inverse=True)
    counts = [np.bincount(at, weights=c, minlength=len(keys)) for c in (toxic, ordinary)]
    levels = [(keys, counts)]
    for k in range(order - 1, 0, -1):
        above, c = levels[0]
        tails, at = np.unique(_tail(above, k), return_inverse=True)
        fronts = [np.bincount(at, weights=x > 0, minlength=len(tails)) for x in c]
        if k <= shared:
            fronts = [np.bincount(at, minlength=len(tails)).astype(float)] * 2
        levels.insert(0, (tails, fronts))
    out, lower, lower_p = Models(order), None, None
    for k, (keys, counts) in enumerate(levels, 1):
        contexts, of = np.unique(keys >> C.U64(8), return_inverse=True)
        probability, left = [], []
        for j, c in enumerate(counts):
            d = discount(c)
            total = np.bincount(of, weights=c, minlength=len(contexts))
            free = np.where(total > 0, d * np.bincount(of, weights=c > 0, minlength=len(contexts)) / np.maximum(total, 1), 1.0)
            below = np.full(len(keys), 1 / 256) if k == 1 else lower_p[j][np.searchsorted(lower, _tail(keys, k - 1))]
            probability.append(np.maximum(c - d, 0) / np.maximum(total, 1)[of] + free[of] * below)
            left.append(free)
        lower, lower_p = keys, probability
        out.keys.append(keys)
        out.ratio.append(np.log(probability[0] / probability[1]))
        out.contexts.append(contexts)
        out.backoff.append(np.log(left[0] / left[1]))
    return out


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """slope, bias and mean log-likelihood of a logistic curve. The slope allows for wrong labels, at the rates that explain them
    best; the middle is where the fewest labels are wrong, which labels that are wrong at random do not move."""
    if len(set(label.tolist())) < 2:
        return 0.0, float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))) if len(label) else 0.0, -np.inf
    mean, spread = evidence.mean(), evidence.std() or 1.0
    x, best = (evidence - mean) / spread, None
    for up in (0.0, 0.01, 0.02, 0.05, 0.1):
        for down in (0.0, 0.02, 0.05):
            w = np.array([1.0, np.log(label.mean() / (1 - label.mean()))])
            for _ in range(100):  # Fisher scoring with a light prior on the slope
                s = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
                p = np.clip(up + (1 - up - down) * s, 1e-9, 1 - 1e-9)
                ds = (1 - up - down) * s * (1 - s)
                g, f = (label - p) / (p * (1 - p)) * ds, ds * ds / (p * (1 - p))
                grad = np.array([(g * x).sum() - w[0] * 0.01, g.sum()])
                info = np.array([[(f * x * x).sum() + 0.01, (f * x).sum()], [(f * x).sum(), f.sum()]]) + np.eye(2) * 1e-6
                step = np.linalg.solve(info, grad)
                w = w + step / max(1.0, np.abs(step).max())
            s = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
            p = np.clip(up + (1 - up - down) * s, 1e-9, 1 - 1e-9)
            fits = np.log(np.where(label == 1, p, 1 - p)).mean()
            if w[0] > 0 and (best is None or fits > best[2] + 1e-6):
                best = (w[0] / spread, w[1] - w[0] * mean / spread, fits)
    if best is None:
        return 0.0, float(np.log(label.mean() / (1 - label.mean()))), -np.inf
    slope, _, fits = best
    return slope, -slope * fewest_wrong(evidence, label), fits


def fewest_wrong(evidence: np.ndarray, label: np.ndarray) -> float:
    """The evidence to call toxic from on with the fewest wrong labels; of equally good ones the middle of the widest gap."""
    order = np.argsort(evidence, kind="stable")
    e, wrong = evidence[order], np.concatenate([[0], np.cumsum(np.where(label[order] == 1, 1, -1))])
    edges = np.concatenate([[e[0] - 1e-6], e, [e[-1] + 1e-6]])
    gap = np.diff(edges)
    k = max(np.flatnonzero(wrong == wrong[gap > 0].min()), key=lambda i: gap[i])
    return float((edges[k] + edges[k + 1]) / 2)


# ---------------------------------------------------------------- on Spark
def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", max_rows: int = 8000, max_chars: int = 100_000) -> DataFrame:
    """Written table (t, label, kept_back): the bounded sample that the models learn from."""
    ids = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    keys = rows.where(F.length("t") <= max_chars).select("doc_id", F.xxhash64("doc_id", "t").alias("h")).join(ids, "doc_id").distinct()
    keys = C.materialize(keys, "toxic-keys")
    chosen = [C.smallest(keys.where(k), F.col("h"), max_rows) for k in ("label > 0", "label <= 0")]
    chosen = chosen[0].unionByName(chosen[1])
    found = rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "c_id")), (F.col("doc_id") == F.col("c_id")) & (F.xxhash64("doc_id", "t") == F.col("h"))).dropDuplicates(["doc_id", "h"])
    return C.materialize(found.select("t", (F.col("label") > 0).cast("int").alias("label"), (F.pmod("h", F.lit(3)) == 0).alias("kept_back")), "toxic-sample")


def _count(sample: DataFrame, max_grams: int) -> pa.Table:
    """key and its counts in toxic / ordinary texts, learned from / kept back."""

    def count(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            group = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column("kept_back").to_numpy(zero_copy_only=False)
            for i, j in C.pieces(offsets):
                sym, owner = symbols(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                mine = owner >= 0
                both, n = np.unique(strings(sym)[mine] << C.U64(2) | group[i:j][owner[mine]].astype(C.U64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both >> C.U64(2)).view(np.int64)), *(pa.array(np.where(both & C.U64(3) == g, n, 0)) for g in range(4))], names=["key", "o", "t", "bo", "bt"])

    counts = sample.mapInArrow(count, "key long, o long, t long, bo long, bt long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("o", "t", "bo", "bt")))
    counts = C.materialize(counts, "toxic-counts")
    least = 1
    while counts.where(F.expr("o + t + bo + bt") >= least).count() > max_grams:
        least += 1
    return counts.where(F.expr("o + t + bo + bt") >= least).toArrow()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", orders: tuple[int, ...] = (3, 4, 5), max_grams: int = 4_000_000, steady: float = 100.0, **bounds) -> Models:
    """Models and curve from a bounded sample of ``docs`` that ``labels`` marks; ``docs`` are those that may be learned from."""
    sample = labelled_sample(docs, labels, text, id, label, **bounds)
    have = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(have) < 2:
        share = 1.0 if 1 in have else 0.0
        return Models(0, slope=0.0, bias=700.0 if share else -700.0, steady=steady)
    table = _count(sample, max_grams)
    key = table["key"].to_numpy().view(C.U64)
    o, t, bo, bt = (table[c].to_numpy().astype(float) for c in ("o", "t", "bo", "bt"))
    parts = []
    for order in orders:
        m = fit_models(key, t, o, order)
        m.steady = steady
        parts.append(m)
    # the texts kept back get their evidence on executors; what returns is three numbers a text, of at most 2 * max_rows texts
    sent = sample.sparkSession.sparkContext.broadcast(parts)

    def judge(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            for i, j in C.pieces(offsets):
                got = [m.rows(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] for m in sent.value]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i).cast(pa.int64()), *map(pa.array, got)], names=["label", *(f"e{k}" for k in orders)])

    seen = sample.where("kept_back").select("t", "label").mapInArrow(judge, "label long, " + ", ".join(f"e{k} double" for k in orders)).toArrow()
    y = seen["label"].to_numpy().astype(float)
    curves = [fit_curve(seen[f"e{k}"].to_numpy(), y) for k in orders]
    best = max(range(len(orders)), key=lambda k: curves[k][2])
    out = fit_models(key, t + bt, o + bo, orders[best])
    out.steady, out.slope, out.bias = steady, *curves[best][:2]
    return out


def score(docs: DataFrame, models: Models, text: str = "text", id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """SCORED for every row of ``docs``."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches):
        m = sent.value
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("t"))
            for i, j in C.pieces(offsets):
                part = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                evidence, size = m.rows(*part) if m.order else (np.zeros(j - i), np.diff(part[1]))
                s = m.score(evidence)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence), pa.array(size)], names=["doc_id", "score", "predicted", "evidence", "n_bytes"])

    return rows.mapInArrow(judge, SCORED)


def held_out(id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels whose documents are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return score(docs, models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "n_bytes")
