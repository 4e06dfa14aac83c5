"""N-gram Jaccard join by parity sketches (operator 10).

A document is its set of distinct word shingles; documents link when Jaccard similarity reaches
``percent`` / 100 (default 75). With similarity t the symmetric difference of two sets is at most
d = (1 - t) / (1 + t) * (|A| + |B|).

1. Documents with equal sets form one class (grouped by a 64-bit sum of scrambled shingle hashes);
   all further work is on classes.
2. Sizes fall into bands of ratio 1 / t. For each band a set's hash range is cut into P parts, about one
   for each shingle, and each part keeps the XOR of its shingles' hashes: a bit sketch of parities. One
   differing shingle spoils one part, so linked sets agree in all but d of their non-empty parts, and under
   any order of sketches that all sets follow, the first d + 1 of either have one in common: the pigeonhole
   join. Rare ones come first (how often shingles occur is counted over all rows), so passages that many
   documents share, and large groups of copies, make few keys. A set joins its own band and the next
   one where that is in reach. Sets with d parts or fewer (P makes them practically absent) meet under one more key.
3. Groups under one key are not expanded into pairs. Each class asks the group's pivots (the classes that meet
   most others) that most of its keys agree on; what the sketches allow is verified on the full sets, and verified links
   give first components. Then the classes outside a group's largest component are compared with all others of
   their groups by sketch, whose Hamming distance never exceeds the symmetric difference. Each class's nearest is
   verified and components grow; at last all such pairs between the components left are verified. Links
   inside one component cannot change it, so no link between components is lost.

Defined cases: null text and texts without words have no shingle and link with nothing; fewer words
than the shingle length are one shingle; rows that repeat or share a text are one class; a null
doc_id is never a component's id unless all of it are null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import graph

BROADCAST_ROWS = 500_000  # a list of classes up to this long is sent to all tasks; a longer one is joined
FREQUENT, OFTEN = 8, 1 << 20  # a shingle is frequent in so many rows; at most so many of them, the most frequent, are sent to all tasks
ASKED = 3  # pivots that each class asks at first


# ---------------------------------------------------------------- bands
@lru_cache(maxsize=None)
def band_start(k: int, percent: int) -> int:
    """Least size of band k; a set reaches from one band into the next at most."""
    return 1 if k == 0 else band_start(k - 1, percent) * 100 // percent + 1


@lru_cache(maxsize=None)
def band_of(n: int, percent: int) -> int:
    k = 0
    while band_start(k + 1, percent) <= n:
        k += 1
    return k


def most_differing(n: int, partner: int, percent: int) -> int:
    """Most shingles by which linked sets of n and up to ``partner`` shingles differ."""
    return (n + min(partner, n * 100 // percent)) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def band_parts(k: int, percent: int) -> int:
    """Parts of band k: about one for each shingle, and so many that practically every set fills more of them than may differ."""
    low, high = band_start(k, percent), band_start(k + 1, percent) - 1
    if most_differing(high, high, percent) == 0:
        return 1
    p = max(high, 1024 if high < 64 else 0)
    for n in (-(-low * percent // 100), low, high):
        need = most_differing(n, high, percent) + 1
        while p < 16 * need:
            c = n / p
            full, spread = p * -math.expm1(-c), p * math.exp(-c) * (1 - (1 + c) * math.exp(-c))
            if full - 6 * math.sqrt(max(0.0, spread)) >= need:
                break
            p += max(1, p // 20)
    return p


def part_keys(keys: np.ndarray, offsets: np.ndarray, percent: int, often: np.ndarray | None = None, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sorted shingle sets, and the row of each.

    A set's keys in a band are the sketches of its non-empty parts. Linked sets differ in d parts at most, so under any order
    of sketches that all sets follow, the first d + 1 of each have one in common; no more are kept. The order is
    rare before frequent: by the least ``level`` of a part's shingles (``often``, sorted, has the frequent ones; others are 0), then by hash.
    """
    n = np.diff(offsets)
    bands = np.zeros(len(n), np.int64)
    for size in np.unique(n[n > 0]).tolist():
        bands[n == size] = band_of(size, percent)
    rows = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(keys), C.U64)
    if often is not None and len(often):
        six = keys & ~C.U64(0xFFFF)
        at = np.minimum(np.searchsorted(often, six), len(often) - 1)
        rank = np.where(often[at] == six, level[at], 0).astype(C.U64)
    scrambled = C.mix(keys)
    out, whose = [], []
    for up in (0, 1):
        high = np.array([band_start(b + up + 1, percent) - 1 for b in bands.tolist()], np.int64)
        reach = n * 100 // percent
        joins = (n > 0) & (reach >= (np.array([band_start(b + 1, percent) for b in bands.tolist()], np.int64) if up else 0))
        d = (n + np.minimum(high, reach)) * (100 - percent) // (100 + percent)
        plans = {b: band_parts(b + up, percent) for b in np.unique(bands).tolist()}
        parts = np.array([plans[b] for b in bands.tolist()], np.int64)
        take = joins[rows]
        h, r = keys[take], rows[take]
        part = ((h >> C.U64(32)) * parts[r].astype(C.U64)) >> C.U64(32)  # grows with h, so parts lie together
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        if len(first):
            table = (bands + up + 1)[r[first]].astype(C.U64) << C.U64(32)
            key = C.mix(np.bitwise_xor.reduceat(scrambled[take], first) ^ C.mix(table | part[first]))
            order = np.minimum.reduceat(rank[take], first) << C.U64(58) | key >> C.U64(6)
            r = r[first]
            by = np.lexsort((order, r))
            key, r = key[by], r[by]
            begin = np.searchsorted(r, np.arange(len(n)))
            kept = np.arange(len(r)) - begin[r] <= d[r]
            out.append(key[kept])
            whose.append(r[kept])
        # sets that fill d parts or fewer: their links to others are found, those among themselves need one more key
        few = np.flatnonzero(joins & (np.bincount(r, minlength=len(n)) <= d))
        out.append(C.mix((bands[few] + up + 1).astype(C.U64) << C.U64(40)))
        whose.append(few)
    return np.concatenate(out), np.concatenate(whose)


def sketch_bits(n: int) -> int:
    """Parities kept for a set of n shingles: a power of two from 2 n on, 64 at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


def parity_sketches(keys: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One bit for each shingle, by parity. Sketches of different lengths fold onto each other."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        bits = sketch_bits(b - a)
        spot = keys[a:b] & C.U64(bits - 1)
        out.append(np.packbits(np.bincount(spot.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes())
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """XOR a sketch (rows x words) down to fewer words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def set_keys(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set (0 for the empty one)."""
    sums = np.zeros(len(keys) + 1, C.U64)
    np.cumsum(C.mix(keys ^ C.U64(0xA0761D6478BD642F)), out=sums[1:])
    n = np.diff(offsets)
    named = C.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ C.mix(n.astype(C.U64)))
    return np.where(n > 0, named | C.U64(1), C.U64(0)).view(np.int64)


# ---------------------------------------------------------------- passes over the text
def _each_piece(batches, size: int, *columns: str):
    """Shingle sets and their names of each piece of the batches' texts, with those rows of ``columns``."""
    for batch in batches:
        buf, offsets = C.text_bytes(batch.column("text"))
        for i, j in C.pieces(offsets):
            keys, off = C.shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            yield keys, off, set_keys(keys, off), [batch.column(c).slice(i, j - i) for c in columns]


class _Unseen:
    """Leaves out sets that the task had lately: copies of a text are one class anyway."""

    def __init__(self):
        self.names: set[int] = set()

    def __call__(self, keys, off, names):
        fresh = np.array([v not in self.names and not self.names.add(v) for v in names.tolist()], bool)
        if len(self.names) > 1 << 17:
            self.names.clear()
        if fresh.all():
            return keys, off, names
        n = np.diff(off)
        return keys[np.repeat(fresh, n)], np.concatenate([[0], np.cumsum(n[fresh])]), names[fresh]


def document_sets(docs: DataFrame, text: str, id: str, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (name of its set) of each row."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for _, off, nodes, columns in _each_piece(batches, size, "doc_id", "text_key"):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(off), pa.int64()), pa.array(nodes)], names=["doc_id", "text_key", "n_shingles", "node"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long")


def class_sets(docs: DataFrame, chosen: DataFrame, text: str, id: str, size: int) -> DataFrame:
    """node, n_shingles, sketch, shingles (hashes) of each class, from the row that ``chosen`` (node, c_id, c_key, n_rows) names for it."""
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    t = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    t = t.join(chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))).select("node", "n_rows", "text")

    def run(batches):
        for keys, off, _, columns in _each_piece(batches, size, "node", "n_rows"):
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(off), pa.int64()), pa.array(parity_sketches(keys, off), pa.binary()), pa.array([keys[i:j].tobytes() for i, j in spans], pa.binary())], names=["node", "n_rows", "n_shingles", "sketch", "shingles"])

    found = C.materialize(t.mapInArrow(run, "node long, n_rows long, n_shingles long, sketch binary, shingles binary"), "class-sets")
    once = found.where("n_rows = 1").unionByName(found.where("n_rows > 1").dropDuplicates(["node"]))  # rows that repeat
    return once.drop("n_rows")


def _six(keys: np.ndarray) -> bytes:
    """Six bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _eight(data, n: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return wide.view("<u8").ravel()


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by shard, and where each shard begins."""
    shard = ((keys >> C.U64(16)) % C.U64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def frequent_shingles(docs: DataFrame, text: str, size: int, shards: int, least: int, flush: int = 1 << 20) -> DataFrame:
    """shingle (six bytes of its hash), n: how many rows hold it, for those in ``least`` or more; counted over all rows but copies that one
    task meets."""

    def emit(batches):
        held, n, unseen = [], 0, _Unseen()

        def out():
            keys = np.concatenate(held)
            order, bounds = _by_shard(keys, shards)
            some = np.flatnonzero(np.diff(bounds)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_six(keys[order[bounds[s] : bounds[s + 1]]]) for s in some], pa.binary())], names=["shard", "keys"])

        for keys, off, names, _ in _each_piece(batches, size):
            held.append(unseen(keys, off, names)[0])
            n += len(held[-1])
            if n >= flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_eight(x.as_buffer(), len(x.as_buffer()) // 6) for x in table.column("keys")]))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(keys)))
        return pa.table({"shingle": keys[at[n >= least]].view(np.int64), "n": n[n >= least]})

    blobs = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(emit, "shard int, keys binary")
    return blobs.groupBy("shard").applyInArrow(count, "shingle long, n long")


def order_of_shingles(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (sorted) and the level of each, at most ``most``: as many halvings of the frequency as fit come first."""
    by_level = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()
    low, room = 64, most
    for level, n in sorted(((r["level"], r["count"]) for r in by_level), reverse=True):
        room -= n
        if room < 0:
            break
        low = level
    t = counts.where(F.col("n") >= F.lit(1 << min(low, 62))).toArrow()
    keys, n = t.column("shingle").to_numpy().view(C.U64), t.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.minimum(63, np.log2(np.maximum(1, n[order])).astype(np.uint8) + 1)


def key_groups(docs: DataFrame, text: str, size: int, percent: int, shards: int, often: tuple[np.ndarray, np.ndarray], flush: int = 1 << 20) -> DataFrame:
    """group, node, pivot, weight (keys with just these nodes), for groups of two nodes or more. The pivot is the group's
    node that meets most others under the keys of the shard: of edited copies, the original."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def emit(batches):
        held, n, unseen = [], 0, _Unseen()

        def out():
            keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            order, bounds = _by_shard(keys, shards)
            ids, blobs = [], []
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[s] : bounds[s + 1]]
                x = nodes[at]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                ids.append(s)
                blobs.append(b"".join([np.array([len(first), len(at)], "<u8").tobytes(), x[first].astype("<i8").tobytes(), np.diff(np.append(first, len(x))).astype("<u4").tobytes(), _six(keys[at])]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "keys"])

        for sets, off, names, _ in _each_piece(batches, size):
            sets, off, names = unseen(sets, off, names)
            keys, rows = part_keys(sets, off, percent, *shared.value)
            held.append((keys, names[rows]))
            n += len(keys)
            if n >= flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        keys, nodes = [], []
        for x in table.column("keys"):
            data = x.as_buffer()
            k, m = np.frombuffer(data, "<u8", 2).tolist()
            keys.append(_eight(data, m, 16 + 12 * k))
            nodes.append(np.repeat(np.frombuffer(data, "<i8", k, 16), np.frombuffer(data, "<u4", k, 16 + 8 * k)))
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        near = np.zeros(len(keys), bool)
        near[1:] = keys[1:] == keys[:-1]
        near[:-1] |= near[1:]
        keys, nodes = keys[near], nodes[near]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(at, len(keys)))
        # groups of the same nodes are one
        name = np.add.reduceat(C.mix(nodes.view(C.U64)), at) if len(at) else np.zeros(0, C.U64)
        name, where, weight = np.unique(np.where(sizes > 1, name, C.U64(0)), return_index=True, return_counts=True)
        keep = sizes[where] > 1
        where, weight, name = where[keep], weight[keep], name[keep]
        n = sizes[where]
        begin = np.cumsum(n) - n
        pick = np.repeat(at[where] - begin, n) + np.arange(n.sum())
        nodes = nodes[pick]
        _, who = np.unique(nodes, return_inverse=True)
        met = np.bincount(who, np.repeat((n - 1) * weight, n))[who] if len(who) else np.zeros(0)
        best = np.flatnonzero(met == np.repeat(np.maximum.reduceat(met, begin), n)) if len(n) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if len(best) else best
        return pa.table({"group": np.repeat(name.view(np.int64), n), "node": nodes, "pivot": np.repeat(nodes[best], n), "weight": np.repeat(weight.astype(np.int64), n)})

    blobs = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(emit, "shard int, keys binary")
    return blobs.groupBy("shard").applyInArrow(meet, "group long, node long, pivot long, weight long")


# ---------------------------------------------------------------- verification
def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. AQE splits classes with very many partners."""
    pairs = C.materialize(pairs.select("a", "b"), "pairs")
    nodes = C.materialize(pairs.select(F.explode(F.array("a", "b")).alias("pn")).distinct(), "paired")
    if nodes.count() <= BROADCAST_ROWS:  # the other sets need not be shuffled
        sets = sets.join(F.broadcast(nodes), F.col("node") == F.col("pn"), "left_semi")
    left = sets.select(F.col("node").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            ok = np.zeros(len(sa), bool)
            for k in range(len(sa)):
                x, y = np.frombuffer(sa[k].as_buffer(), "<u8"), np.frombuffer(sb[k].as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                z = np.concatenate([x, y])
                z.sort()
                inter = int((z[1:] == z[:-1]).sum())
                ok[k] = 100 * inter >= percent * (len(x) + len(y) - inter)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _allowed(asks: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``asks`` whose sizes and sketches allow the similarity."""
    left = info.select(F.col("node").alias("na"), F.col("n_shingles").alias("ka"), F.col("sketch").alias("sa"))
    right = info.select(F.col("node").alias("nb"), F.col("n_shingles").alias("kb"), F.col("sketch").alias("sb"))
    both = asks.select("a", "b").join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb")).where(F.least("ka", "kb") * 100 >= F.greatest("ka", "kb") * percent).select("a", "b", "ka", "kb", "sa", "sb")

    def run(batches):
        for batch in batches:
            ka, kb = batch.column("ka").to_numpy(), batch.column("kb").to_numpy()
            ok = np.zeros(len(ka), bool)
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                w = min(len(x), len(y))
                far = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum())
                ok[k] = far * (100 + percent) <= (100 - percent) * int(ka[k] + kb[k])
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_pairs(groups: DataFrame, comps: DataFrame, info: DataFrame, percent: int, deal_rows: int = 1 << 17) -> DataFrame:
    """a, b, far: the pairs of one group in different components whose sketches allow the similarity, with the sketches' distance.

    In each group only the classes outside its largest component ask; each asks all others once for all its groups of a
    deal. Groups of one pivot share most of their classes and are dealt together; a pivot with more than ``deal_rows``
    rows is dealt to several tasks, each with a part of those that ask.
    """
    c = comps.withColumnRenamed("node", "fn")
    members = groups.select("group", "pivot", "node").join(c, F.col("node") == F.col("fn"), "left").select("group", "pivot", "node", F.coalesce("component", "node").alias("component"))
    members = C.materialize(members, "members")
    mixed = members.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(F.col("group").alias("mg"))
    members = C.materialize(members.join(mixed, F.col("group") == F.col("mg"), "left_semi"), "mixed-members")
    deals = max(4, -(-members.count() // deal_rows))
    big = members.groupBy(F.col("pivot").alias("bp")).agg(F.ceil(F.count(F.lit(1)) / deal_rows).cast("int").alias("slices")).where("slices > 1")  # at most one for each deal_rows rows
    members = members.join(F.broadcast(big), F.col("pivot") == F.col("bp"), "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("deal", F.pmod(F.xxhash64("pivot", "slice"), F.lit(deals))).drop("bp", "pivot")
    members = C.materialize(members, "dealt-members")
    held = members.select("deal", "node").distinct().join(info.select(F.col("node").alias("i_node"), "n_shingles", "sketch"), F.col("node") == F.col("i_node")).select(F.col("deal").alias("h_deal"), F.col("node").alias("h_node"), "n_shingles", "sketch")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("h_node").to_numpy()
        rank = np.argsort(names)
        names, sizes = names[rank], right.column("n_shingles").to_numpy()[rank]
        raw = right.column("sketch").combine_chunks().take(pa.array(rank))
        words = np.array([len(x.as_buffer()) // 8 for x in raw], np.int64)
        folded: dict[tuple[int, int], np.ndarray] = {}  # the sketches of one length, folded to another
        row = np.zeros(len(names), np.int64)
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            row[own] = np.arange(len(own))
            folded[w, w] = np.stack([np.frombuffer(raw[k].as_buffer(), "<u8") for k in own.tolist()])

        def sketches(who: np.ndarray, w: int, to: int) -> np.ndarray:
            if (w, to) not in folded:
                folded[w, to] = fold(folded[w, w], to)
            return folded[w, to][row[who]]

        who = np.searchsorted(names, left.column("node").to_numpy())
        part, parts = left.column("slice").to_numpy(), left.column("slices").to_numpy()
        label, group = left.column("component").to_numpy(), left.column("group").to_numpy()
        component = np.zeros(len(names), np.int64)
        component[who] = label
        order = np.lexsort((label, part, group))
        who, part, parts, label, group = who[order], part[order], parts[order], label[order], group[order]
        edge = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
        gid = np.concatenate([[0], np.cumsum(edge)]) if len(group) else np.zeros(0, np.int64)
        at = np.flatnonzero(np.concatenate([[True], edge])) if len(group) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(group))
        run_at = np.flatnonzero(np.concatenate([[True], edge | (label[1:] != label[:-1])])) if len(group) else np.zeros(0, np.int64)
        run_n = np.diff(np.append(run_at, len(group)))
        best = np.lexsort((run_n, gid[run_at]))
        largest = np.zeros(len(at), np.int64)
        largest[gid[run_at][best]] = label[run_at][best]  # the last one of each group stays
        turn = (C.mix(names.view(C.U64))[who] % parts.astype(C.U64)).astype(np.int64) == part
        asks = np.flatnonzero((label != largest[gid]) & turn)
        asks = asks[np.argsort(who[asks], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], who[asks][1:] != who[asks][:-1]])) if len(asks) else np.zeros(0, np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(asks)).tolist(), strict=True):
            u = int(who[asks[lo]])
            mark = np.zeros(len(names), bool)
            for g in gid[asks[lo:hi]].tolist():
                mark[who[at[g] : ends[g]]] = True
            v = np.flatnonzero(mark)
            n, m = int(sizes[u]), sizes[v]
            v = v[(component[v] != component[u]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
            for w in np.unique(words[v]).tolist():
                x = v[words[v] == w]
                to = min(w, int(words[u]))
                for k in range(0, len(x), max(1, (1 << 20) // to)):
                    y = x[k : k + max(1, (1 << 20) // to)]
                    far = np.bitwise_count(sketches(y, w, to) ^ sketches(np.array([u]), int(words[u]), to)).sum(1, dtype=np.int64)
                    near = far * (100 + percent) <= (100 - percent) * (n + sizes[y])
                    if near.any():
                        y, far = names[y[near]], far[near]
                        out.append((np.minimum(y, names[u]), np.maximum(y, names[u]), far))
        a, b, far = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((b, a))
        new = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])] if len(a) else order
        return pa.table({"a": a[new], "b": b[new], "far": far[new]})

    pairs = members.select("deal", "group", "node", "component", "slice", "slices").groupBy("deal").cogroup(held.groupBy("h_deal")).applyInArrow(run, "a long, b long, far long")
    return pairs.groupBy("a", "b").agg(F.min("far").alias("far"))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = 5, percent: int = 75, shard_keys: int = 1 << 20) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of each row."""
    rows = C.materialize(document_sets(docs, text, id, size), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    shards = max(4, -(-total // shard_keys))
    counts = C.materialize(frequent_shingles(docs, text, size, shards, FREQUENT), "shingle-counts")
    groups = C.materialize(key_groups(docs, text, size, percent, shards, order_of_shingles(counts, OFTEN)), "key-groups")
    # one row for each class that met another
    classes = C.materialize(rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("x"), F.min("doc_id").alias("own_id")), "classes")
    each = rows.where("n_shingles > 0").groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows")).toDF("en", "ei", "ek", "n_rows")
    met = classes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("x.doc_id").alias("c_id"), F.col("x.text_key").alias("c_key"))
    chosen = met.join(each, (F.col("node") == F.col("en")) & F.col("c_id").eqNullSafe(F.col("ei")) & (F.col("c_key") == F.col("ek"))).select("node", "c_id", "c_key", "n_rows")
    sets = class_sets(docs, C.materialize(chosen, "chosen"), text, id, size)

    # each class asks the pivots that most of its keys agree on
    asks = groups.where("node <> pivot").groupBy("node", "pivot").agg(F.sum("weight").alias("w"))
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "pivot"))
    asks = asks.withColumn("nth", first).where(F.col("nth") <= ASKED).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = C.materialize(_verify(_allowed(asks, sets, percent), sets, percent), "links")
    comps = graph.components(links)

    near = C.materialize(near_pairs(groups, comps, sets, percent), "near")
    # each class's nearest first; then all pairs between the components that are left
    both = near.select("a", "b", F.col("a").alias("of"), "far").unionByName(near.select("a", "b", F.col("b").alias("of"), "far"))
    nearest = both.groupBy("of").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    links = C.materialize(links.unionByName(_verify(nearest, sets, percent)), "links")
    comps = graph.components(links)
    ca, cb = comps.toDF("na", "ca"), comps.toDF("nb", "cb")
    rest = near.join(ca, F.col("a") == F.col("na"), "left").join(cb, F.col("b") == F.col("nb"), "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = C.materialize(links.unionByName(_verify(rest, sets, percent)), "links")
    comps = graph.components(links)

    least = C.materialize(comps.join(classes.select("node", "own_id"), "node").groupBy("component").agg(F.min("own_id").alias("least")), "component-ids")
    ids = C.materialize(comps.join(least, "component").select("node", "least"), "class-ids")
    ids = classes.select("node", "own_id").join(ids, "node", "left").select(F.col("node").alias("in_node"), F.coalesce("least", "own_id").alias("component_id"))
    ids = C.materialize(ids, "all-ids")
    found = rows.join(ids, (F.col("node") == F.col("in_node")) & (F.col("n_shingles") > 0), "left")
    return found.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", **how) -> DataFrame:
    """One row of each component: that with the least doc_id (ties: the least text hash); all columns stay."""
    found = C.materialize(near_duplicates(docs, text, id, **how), "components")
    a, b, c = C.free_name(docs, "_id", "_key", "_rows")
    # without shingles a row links with nothing: it stays unless the very row repeats
    own = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.struct("doc_id", "text_key"))
    each = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"))
    best = each.groupBy("component_id", own.alias("own")).agg(F.min(F.struct("doc_id", "text_key", "n_rows")).alias("x")).select("x.*").toDF(a, b, c)
    best = C.materialize(best, "kept-ids")
    same = F.col(id).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col(text)) == F.col(b))
    single = docs.join(best.where(F.col(c) == 1), same).select(*docs.columns)
    many = docs.join(best.where(F.col(c) > 1), same).dropDuplicates([a, b]).select(*docs.columns)
    return single.unionByName(many)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
"""
