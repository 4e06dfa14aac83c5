"""Language identification (operator 3): averaged hashed subword embeddings and a linear softmax.

A text's features are the hashed runs of 2 and 3 code units (UTF-8 bytes, words lower-cased and
framed by blanks); its vector is the average of their embeddings, and a linear layer with softmax
gives the languages. Training is plain stochastic gradient descent in numpy on a bounded sample
(``max_rows`` labelled rows, drawn by hash of doc_id); every row's text is used whole and again line
by line, so short texts are learned too. A temperature is fitted on rows kept out of training, and
``reject_below`` is the score that only ``reject_rate`` of those rows fall below: a prediction under it is flagged.

Since averaging and the linear layer commute, prediction adds one row of a (buckets x languages)
table for each subword: that table, of a size fixed by parameters, is all that is sent to tasks.

Defined cases: null text or a text without a letter gives ``und`` and score 0; labels that are null
are not learned from; without any labelled row every prediction is ``und`` with score 0; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: each subword's part of the logits
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 2- and 3-byte run that is not just blanks, and its row; rows do not mix."""
    buf = C.lower(np.where(C._SPACE[buf], 0x20, buf).astype(np.uint8))
    n = len(offsets) - 1
    # a blank before and after every row
    framed = np.full(len(buf) + 2 * n, 0x20, np.uint8)
    row = C.row_of(offsets)
    framed[np.arange(len(buf)) + 2 * row + 1] = buf
    rows = C.row_of(offsets + 2 * np.arange(n + 1))
    wide = framed.astype(np.uint32)
    two = wide[:-1] << np.uint32(8) | wide[1:]
    three = two[:-1] << np.uint32(8) | wide[2:]
    out, where = [], []
    for g, size in ((two, 2), (three, 3)):
        ok = (rows[size - 1 :] == rows[: len(g)]) & (g & np.uint32(0xFFFF) != 0x2020)
        key = (g + np.uint32(0x01000000 * size)) * np.uint32(0x9E3779B1)
        out.append((key >> np.uint32(32 - int(np.log2(buckets)))).astype(np.int32)[ok])
        where.append(rows[: len(g)][ok])
    return np.concatenate(out), np.concatenate(where)


def _bags(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    bags = []
    for i, j in C.pieces(offsets):
        buf = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        ids, rows = subwords(buf, offsets[i : j + 1] - offsets[i], buckets)
        order = np.argsort(rows, kind="stable")
        ids, bounds = ids[order], np.searchsorted(rows[order], np.arange(j - i + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            u, c = np.unique(ids[a:b], return_counts=True)
            bags.append((u, (c / max(1, b - a)).astype(np.float32)))
    return bags


def fit(texts: list[bytes], labels: list[str], buckets: int = 1 << 15, width: int = 12, epochs: int = 6, rate: float = 0.5, reject_rate: float = 0.01, lines: int = 4, seed: int = 1) -> LanguageModel:
    """Train on whole texts and on up to ``lines`` of each one's lines; every tenth text calibrates."""
    languages = sorted(set(labels))
    y_of = {x: k for k, x in enumerate(languages)}
    held = [k for k in range(len(texts)) if k % 10 == 9]
    some, y = [], []
    for k, (t, lab) in enumerate(zip(texts, labels, strict=True)):
        if k % 10 != 9:
            parts = [x for x in t.split(b"\n") if len(x) > 8]
            for x in [t, *parts[:: max(1, -(-len(parts) // lines))]]:
                some.append(x)
                y.append(y_of[lab])
    rng = np.random.default_rng(seed)
    bags, m = _bags(some, buckets), len(languages)
    embed = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (width, m)).astype(np.float32), np.zeros(m, np.float32)
    step, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            if len(ids) == 0:
                continue
            lr, step = rate * (1 - step / total), step + 1
            v = share @ embed[ids]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= lr * np.outer(v, p)
            bias -= lr * 0.1 * p
            embed[ids] -= (lr * len(ids) ** 0.5) * np.outer(share, back)
    table = embed @ out
    temperature, below = 1.0, 0.0
    if held:
        z = np.stack([(c @ table[u] if len(u) else np.zeros(m)) + bias for u, c in _bags([texts[k] for k in held], buckets)])
        t = np.array([y_of[labels[k]] for k in held])
        losses = []
        for temp in (grid := np.geomspace(0.2, 5, 33)):
            s = z / temp
            s = s - s.max(1, keepdims=True)
            losses.append(-(s[np.arange(len(t)), t] - np.log(np.exp(s).sum(1))).mean())
        temperature = float(grid[int(np.argmin(losses))])
        s = np.exp((z - z.max(1, keepdims=True)) / temperature)
        below = float(np.quantile((s / s.sum(1, keepdims=True)).max(1), reject_rate))
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, below)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ANY_LETTER = re.compile(r"[^\W\d_]")


def predict_column(model: LanguageModel | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    buf, offsets = C.text_bytes(column)
    n = len(offsets) - 1
    lang, score = np.full(n, "und", object), np.zeros(n)
    if model is None:
        return list(lang), score
    buckets, m = model.table.shape
    for i, j in C.pieces(offsets, 1 << 19):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ids, rows = subwords(part, off, buckets)
        z = np.stack([np.bincount(rows, model.table[ids, k], minlength=j - i) for k in range(m)], 1)
        z = (z / np.maximum(1, np.bincount(rows, minlength=j - i))[:, None] + model.bias) / model.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        letters = C.per_row(_LETTER[part], off) > 0
        for r in np.flatnonzero(~letters & (C.per_row(part >= 0x80, off) > 0)):
            letters[r] = bool(_ANY_LETTER.search(part[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")))
        best = p.argmax(1)
        lang[i:j] = np.where(letters, np.array(model.languages, object)[best], "und")
        score[i:j] = np.where(letters, np.minimum(1.0, p.max(1)), 0.0)
    return list(lang), score


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", max_rows: int = 3000, **how) -> LanguageModel | None:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hash of doc_id."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    key = F.xxhash64(F.col(id), F.lit(17))
    rows = C.smallest(rows, key, max_rows)
    sample = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), key.alias("k"), F.col(id).alias("id")).orderBy("k", "id", "text").limit(max_rows).collect()
    if not sample:
        return None
    return fit([r["text"].encode("utf-8", "replace") for r in sample], [r["lang"] for r in sample], **how)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row with lang_pred, score and rejected (score under the calibrated bound); where one of
    ``keep`` has such a name, the new column's gets underscores in front."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats: bounded by parameters
    kept = docs.select(*keep)
    t, *names = C.free_name(kept, "text", "lang_pred", "score", "rejected")
    rows = docs.select(*keep, F.col(text).cast("string").alias(t))

    def run(batches):
        model = shared.value
        for batch in batches:
            lang, score = predict_column(model, batch.column(t))
            low = score < (model.reject_below if model else 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return rows.mapInArrow(run, ", ".join([schema] * bool(keep) + [f"`{c}` {k}" for c, k in zip(names, ("string", "double", "boolean"), strict=True)]))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those with crc32(doc_id) mod 3 other than 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
