"""Language-model scoring with a probabilistic suffix tree (operator 2).

The model reads a text as its tokens (words with A-Z lower-cased, then one end), spelled as bytes:
each word's bytes and a blank, at last a newline. States are contexts of up to ``depth`` bytes. The
next-symbol distribution of a context is smoothed with that of the context one byte shorter,

    P(c | s) = (n(s, c) + T(s) * P(c | parent)) / (n(s) + T(s)),   T(s): distinct symbols seen after s,

down to the uniform one. A context is retained when it was seen ``min_count`` times and its symbols'
log-likelihood gains at least ``cut`` nats over its parent (n(s) times the divergence); otherwise
its parent's distribution stands in, so every byte is scored by its longest retained suffix.

How it is spread: texts fall into blocks of about ``block_bytes`` by hash. Each block sends the
distinct byte runs and words it holds, with training counts, packed; these meet in shards of runs (by the
last three context bytes, so that a state's relatives are together), get their probabilities, and
each block gets back the values it asked for, in the order it asked. No table of the model is whole anywhere but contexts
of up to two bytes (at most 2**24 counts, a bound of the alphabet); counts cover all training texts.

Defined cases: a null text is empty (one token, the end); a null doc_id is learned from; repeated
rows count as often as they occur; without training texts all symbols are equally likely; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 6  # bytes of context at most in the query (the operator takes up to 7: with its symbol a run fills 64 bits then)
_END = 1  # the key of the end token
LOW = 2  # contexts up to this many bytes are known to all tasks


def _spell(buf: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs of depth + 1 bytes, n+1 offsets of rows in them, word keys, n+1 offsets of rows in these)."""
    buf = C.lower(buf)
    starts, ends, first = C.words(buf, offsets)
    keys = C.PrefixHash(buf)(starts, ends) | C.U64(2)  # never _END
    lens, n = ends - starts, len(offsets) - 1
    row = C.row_of(first)
    inside = buf[~C._SPACE[buf]]
    bytes_before = np.concatenate([[0], np.cumsum(lens)])
    row_len = (bytes_before[first[1:]] - bytes_before[first[:-1]]) + np.diff(first) + 1
    off = np.concatenate([[0], np.cumsum(row_len)])
    padded = off + depth * np.arange(n + 1)
    text = np.full(int(padded[-1]), 0x0A, np.uint8)
    k = np.arange(len(lens))
    shift = k + row * (depth + 1) + depth
    text[np.arange(len(inside)) + np.repeat(shift, lens)] = inside
    text[bytes_before[1:] + shift] = 0x20
    wide = text.astype(np.uint64)
    runs = np.zeros(max(0, len(text) - depth), np.uint64)
    for i in range(depth + 1):
        runs = (runs << np.uint64(8)) | wide[i : i + len(runs)]
    if n:
        keep = np.ones(len(runs), bool)
        keep[(padded[1:-1, None] + np.arange(-depth, 0)[None, :]).ravel()] = False  # those that end in a row's padding
        runs = runs[keep]
    return runs, off, keys, first


def _sums(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = np.concatenate(keys), np.concatenate(n).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class _Counts:
    """Distinct keys with counts, merged as they come."""

    def __init__(self):
        self.keys, self.n, self.held = [], [], 0

    def add(self, values: np.ndarray, learn: bool) -> None:
        if len(values):
            values = np.sort(values)
            at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            n = np.diff(np.append(at, len(values))) if learn else np.zeros(len(at), np.int64)
            self.keys.append(values[at])
            self.n.append(n.astype(np.int32))
            self.held += len(at)
            if self.held > 2_000_000 and len(self.keys) > 1:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = _sums(self.keys, self.n)
        self.keys, self.n, self.held = [keys], [n], 0
        return keys, n


class _Index:
    """Values by 64-bit key: open addressing, placed in slot order, looked up array-wise."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        k = np.arange(len(keys))
        place = np.maximum.accumulate(slot[order] - k) + k if len(keys) else slot
        size = (1 << bits) + len(keys) + 1
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, values.dtype)  # no key is 0
        self.keys[place], self.values[place] = keys[order], values[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            if not self.keys[at[wrong]].all():
                raise KeyError("a block lacks a value it asked for")
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def _smooth(ctx: np.ndarray, n: np.ndarray, parent: np.ndarray, min_count: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (context, symbol) rows sorted by context: the probability (the parent's where the context is not retained), and whether it is."""
    at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    size = np.diff(np.append(at, len(ctx)))
    total, kinds = np.add.reduceat(n, at), np.add.reduceat((n > 0).astype(np.int64), at)
    t, k = np.repeat(total, size), np.repeat(kinds, size)
    p = np.where(t > 0, (n + k * parent) / np.maximum(1, t + k), parent)
    gain = np.add.reduceat(n * np.log(p / parent), at)
    keep = np.repeat((total >= min_count) & (gain >= cut), size)
    return np.where(keep, p, parent), keep


def low_model(keys: np.ndarray, n: np.ndarray, min_count: int, cut: float) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """From counts of (two context bytes, symbol): P without context, and levels 1 and 2 as (keys, n, P, retained) sorted by key."""
    levels: list[tuple[np.ndarray, ...]] = []
    dense = np.bincount((keys & np.uint64(0xFF)).astype(np.int64), n, minlength=256)
    kinds = (dense > 0).sum()
    base = (dense + max(1, kinds) / 256) / (dense.sum() + max(1, kinds))
    for k in (1, 2):
        key = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        u, inv = np.unique(key, return_inverse=True)
        m = np.bincount(inv, n, minlength=len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
        if len(u):
            levels.append((u, m, *_smooth(u >> np.uint64(8), m, _low(base, levels, u, k - 1), min_count, cut)))
    return base, levels


def _low(base: np.ndarray, levels, keys: np.ndarray, upto: int) -> np.ndarray:
    """P(symbol | last ``upto`` context bytes) of any runs, seen or not (an unseen symbol keeps its state's share of the parent)."""
    p = base[(keys & np.uint64(0xFF)).astype(np.int64)]
    for k, (u, m, q, retained) in enumerate(levels[:upto], 1):
        key = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(u, key), len(u) - 1)
        seen = u[at] == key
        ctx = u >> np.uint64(8)
        lo, hi = np.searchsorted(ctx, key >> np.uint64(8)), np.searchsorted(ctx, key >> np.uint64(8), side="right")
        total, kinds = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m > 0)])
        t, d = total[hi] - total[lo], kinds[hi] - kinds[lo]
        share = np.where(t > 0, d / np.maximum(1, t + d), 1.0) * p
        kept = retained[np.minimum(lo, len(u) - 1)] & (hi > lo)
        p = np.where(seen, q[at], np.where(kept, share, p))
    return p


def run_probabilities(runs: np.ndarray, n: np.ndarray, base: np.ndarray, levels, depth: int, min_count: int, cut: float) -> np.ndarray:
    """P(symbol | longest retained context) of distinct sorted runs that hold all relatives of their last three context bytes."""
    p = None
    for k in range(LOW + 1, depth + 1):
        key = runs & np.uint64((1 << 8 * (k + 1)) - 1)
        u, inv = np.unique(key, return_inverse=True)
        m = np.bincount(inv, n, minlength=len(u)).astype(np.int64)
        if p is None:
            parent = _low(base, levels, u, LOW)
        else:
            parent = np.zeros(len(u))
            parent[inv] = p  # runs that share a key share their shorter context too
        p = _smooth(u >> np.uint64(8), m, parent, min_count, cut)[0][inv]
    return p if p is not None else _low(base, levels, runs, LOW)


def _near(runs: np.ndarray) -> np.ndarray:
    """The last three context bytes: a run's relatives share them."""
    return (runs >> np.uint64(8)) & np.uint64(0xFFFFFF)


def _dealt(keys: np.ndarray, by: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys' order by shard, and where each shard begins."""
    shard = (C.mix(by) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, all first bytes before all second ones: of sorted keys, small counts and
    probabilities that lets a shuffle's compression leave little."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()


def _from_planes(data, n: int, at: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


def _contents(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs and words of a block's texts, sorted, with their training counts (the end token is always asked for)."""
    buf, offsets = C.text_bytes(table.column("text"))
    teach = np.asarray(table.column("learn"))
    r, w = _Counts(), _Counts()
    for i, j in C.pieces(offsets, 1 << 19):
        runs, off, keys, first = _spell(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth)
        for learn in (True, False):
            mine = teach[i:j] == learn
            if mine.any():
                whole = mine.all()
                r.add(runs if whole else runs[np.repeat(mine, np.diff(off))], learn)
                w.add(keys if whole else keys[np.repeat(mine, np.diff(first))], learn)
    w.add(np.array([_END], np.uint64), False)
    words, n = w.merge()
    return *r.merge(), words, n + (words == _END) * int(teach.sum())


def score_documents(docs: DataFrame, learn: Column, text: str = "text", id: str = "doc_id", depth: int = DEPTH, min_count: int = 3, cut: float = 4.0, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; ``learn`` says which rows teach."""
    if not LOW < depth < 8:
        raise ValueError("depth is from 3 to 7")
    spark, width = docs.sparkSession, depth + 1
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col(text).cast("string").alias("text"))
    three = np.uint64(0xFFFFFF)

    def sizes(batches):
        counts, total = _Counts(), 0
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("text"))
            teach = np.asarray(batch.column("learn"))
            total += len(buf)
            for i, j in C.pieces(offsets, 1 << 19):
                runs, off, _, _ = _spell(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth)
                counts.add((runs & three)[np.repeat(teach[i:j], np.diff(off))], True)
        keys, n = counts.merge()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), -1)), pa.array(np.append(n, total))], names=["run", "n"])

    low = rows.select("learn", "text").mapInArrow(sizes, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    run, n = low.column("run").to_numpy(), low.column("n").to_numpy()
    total = int(n[run < 0].sum())
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    order = np.argsort(run[run >= 0])
    base, levels = low_model(run[run >= 0][order].astype(np.uint64), n[run >= 0][order].astype(np.int64), min_count, cut)
    shared = spark.sparkContext.broadcast((base, levels))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        runs, n, words, m = _contents(table.drop_columns(["block"]), depth)
        (a, a_at), (b, b_at) = _dealt(runs, _near(runs), shards), _dealt(words, words, shards)
        out = []
        for s in range(shards):
            x, y = a[a_at[s] : a_at[s + 1]], b[b_at[s] : b_at[s + 1]]
            head = np.array([len(x), len(y)], "<i8").tobytes()
            out.append(b"".join([head, _planes(runs[x], width), _planes(n[x].astype("<u4"), 4), _planes(words[y], 8), _planes(m[y].astype("<u4"), 4)]))
        return pa.table({"shard": pa.array(range(shards), pa.int32()), "block": pa.array([block] * shards, pa.int32()), "asked": pa.array(out, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = []
        for x in table.column("asked"):
            data = x.as_buffer()
            i, j = np.frombuffer(data, "<i8", 2).tolist()
            at = 16 + i * width
            asked.append((_from_planes(data, i, 16, width, "<u8"), _from_planes(data, i, at, 4, "<u4"), _from_planes(data, j, at + 4 * i, 8, "<u8"), _from_planes(data, j, at + 4 * i + 8 * j, 4, "<u4")))
        base, levels = shared.value
        runs, n = _sums([x[0] for x in asked], [x[1] for x in asked])
        p = np.log10(run_probabilities(runs, n, base, levels, depth, min_count, cut)).astype("<f4") if len(runs) else np.zeros(0, "<f4")
        words, m = _sums([x[2] for x in asked], [x[3] for x in asked])
        out = [_planes(p[np.searchsorted(runs, x[0])], 4) + _planes(m[np.searchsorted(words, x[2])].astype("<i8"), 8) for x in asked]
        # the shard's part of N and V, for block -1
        out.append(np.array([m.sum(), (m > 0).sum()], "<i8").tobytes())
        block = [*table.column("block").to_pylist(), -1]
        return pa.table({"block": pa.array(block, pa.int32()), "shard": pa.array(table.column("shard").to_pylist()[:1] * len(out), pa.int32()), "answer": pa.array(out, pa.binary())})

    names = ("doc_id", "learn", "n_tokens", "n_known", "base", "score", "tokens", "distinct")
    kinds = {"doc_id": pa.int64(), "learn": pa.bool_(), "base": pa.float64(), "score": pa.float64()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the shards' totals
            both = np.array([np.frombuffer(x.as_buffer(), "<i8") for x in right.column("answer")]).reshape(-1, 2).sum(0)
            none = {c: pa.nulls(1, schema.field(c).type) for c in names}
            return pa.table(none | {"tokens": pa.array(both[:1]), "distinct": pa.array(both[1:])}).select(list(names)).cast(schema)
        left = left.drop_columns(["block"])
        answers = dict(zip(right.column("shard").to_pylist(), right.column("answer"), strict=True))
        runs, _, words, _ = _contents(left, depth)  # in the order they were asked for
        (a, a_at), (b, b_at) = _dealt(runs, _near(runs), shards), _dealt(words, words, shards)
        p, m = np.zeros(len(runs), np.float32), np.zeros(len(words), np.int64)
        for s, x in answers.items():
            data, i, j = x.as_buffer(), int(a_at[s + 1] - a_at[s]), int(b_at[s + 1] - b_at[s])
            p[a[a_at[s] : a_at[s + 1]]] = _from_planes(data, i, 0, 4, "<f4")
            m[b[b_at[s] : b_at[s + 1]]] = _from_planes(data, j, 4 * i, 8, "<i8")
        del answers, right, a, b
        run_of, word_of = _Index(runs, p), _Index(words, np.log10(m + 0.1))
        end = float(word_of(np.array([_END], np.uint64))[0])
        del runs, words, p, m
        buf, offsets = C.text_bytes(left.column("text"))
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("n_tokens", "n_known", "base", "score")}
        for i, j in C.pieces(offsets, 1 << 19):
            runs, off, keys, first = _spell(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth)
            w = word_of(keys)
            sums = np.bincount(C.row_of(first), w, minlength=j - i)
            out["n_tokens"].append(np.diff(first) + 1)
            out["n_known"].append(C.per_row(w > -0.5, first) + (end > -0.5))
            out["base"].append(sums + end)
            out["score"].append(np.add.reduceat(run_of(runs).astype(np.float64), off[:-1]))
        done = {c: pa.array(np.concatenate(v)) for c, v in out.items()}
        return pa.table({"doc_id": left.column("doc_id"), "learn": left.column("learn")} | done | {c: pa.nulls(left.num_rows, pa.int64()) for c in ("tokens", "distinct")}).select(list(names)).cast(schema)

    answers = dealt.select("block", "learn", "text").groupBy("block").applyInArrow(ask, "shard int, block int, asked binary").groupBy("shard").applyInArrow(answer, "block int, shard int, answer binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, learn boolean, n_tokens long, n_known long, base double, score double, tokens long, distinct long")
    scored = C.materialize(scored, "lm-scores")
    total = scored.where("tokens IS NOT NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("all_distinct"))
    whole = F.col("n_tokens") * F.log10(F.col("all_tokens") + (F.col("all_distinct") + 1) * F.lit(0.1))
    return scored.where("n_tokens IS NOT NULL").crossJoin(F.broadcast(total)).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.col("all_tokens").alias("train_tokens"), (F.col("base") - whole).alias("base_score"), "score")


def op2_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; those with crc32(doc_id) mod 10 other than 0 are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
