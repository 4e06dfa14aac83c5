"""Suffix-array deduplication by column-wise multi-document construction (operator 8).

Every byte covered by a string of ``size`` bytes that also starts in a document with a smaller doc_id
is removed; strings never cross documents.

``collection_bwt`` builds the Burrows-Wheeler transform and the common prefixes of a collection
column by column: each round puts one symbol of every document (from its end) into the transform of
all suffixes so far, at places found by ranks in the last round's transform, and updates the common
prefixes next to them. Transform, common prefixes and suffix names are files that each round
reads and rewrites from front to back; rounds are as many as the longest document has bytes.

Whole documents would need as many rounds as the longest one has bytes, each over the whole collection. So the
collection is cut at content-defined places first: all strings of ``size`` bytes whose least
``gram``-byte hash agrees meet under that hash, in segments of consecutive strings (about 63
bytes, 76 at most). Equal strings always share the hash, so nothing is lost; hashes that only one text holds are
left out. Equal segments are one, with the places they occur at, and a hash with one segment has nothing
to compare. Shards of about ``shard_keys`` hashes then go through ``collection_bwt``; suffixes whose common prefix reaches ``size`` bytes are
equal strings, and the least doc_id among them tells which of their places are removed.

Texts that repeat whole are handled once: the copy with the least doc_id counts, the others are
removed entirely (from ``size`` bytes on). Defined cases: a null text is empty; a null doc_id comes
after all others; rows with the same doc_id do not remove each other; texts shorter than ``size``
keep every byte; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE, GRAM = 50, 24
KEY_SHIFT = 17  # bits of a hash that a key leaves out, and that number rows while keys are counted
BROADCAST_KEYS = 8_000_000  # so many shared hashes are sent to all tasks; beyond, segments are joined with them
BROADCAST_ROWS = 500_000
_LAST = (1 << 63) - 1


# ---------------------------------------------------------------- external files
#: A suffix: the symbol in front of it, its common prefix with the suffix before, its length, its document.
SUFFIX = np.dtype([("bwt", "u1"), ("lcp", "u1"), ("size", "<u2"), ("doc", "<u4")])
BLOCK = 1 << 19


class _File:
    """Suffixes in an unlinked temporary file of the task, read and rewritten from front to back."""

    def __init__(self, rows: np.ndarray):
        self.n = len(rows)
        self.file, self.spare = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.file.write(rows.data)

    def blocks(self):
        self.file.seek(0)
        for at in range(0, self.n, BLOCK):
            yield at, np.frombuffer(self.file.read(SUFFIX.itemsize * min(BLOCK, self.n - at)), SUFFIX)

    def whole(self) -> np.ndarray:
        return np.concatenate([part for _, part in self.blocks()]) if self.n else np.zeros(0, SUFFIX)

    def insert(self, places: np.ndarray, rows: np.ndarray, changed: np.ndarray, common: np.ndarray) -> None:
        """Rewrite with ``rows`` at ``places`` and the common prefixes ``common`` at ``changed`` (both ascending, counted in the new file)."""
        done, total = 0, self.n + len(rows)
        before = places - np.arange(len(places))  # old rows in front of each new one
        self.spare.seek(0)
        for at, part in self.blocks():
            # the new file's range that this block fills, with what is put between
            end = len(places) if at + len(part) == self.n else int(np.searchsorted(before, at + len(part), side="left"))
            mine = places[done:end] - at - done
            block = np.empty(len(part) + len(mine), np.uint64)
            old = np.ones(len(block), bool)
            old[mine] = False
            block[mine] = rows[done:end].view(np.uint64)
            block[old] = part.view(np.uint64)
            i, j = np.searchsorted(changed, [at + done, at + done + len(block)])
            block.view(SUFFIX)["lcp"][changed[i:j] - at - done] = common[i:j]
            self.spare.write(block.data)
            done = end
        if not self.n:
            self.spare.write(rows.data)
        self.file, self.spare, self.n = self.spare, self.file, total


class _RangeMin:
    """Least values of stretches [a, b) of bytes, 255 for empty ones."""

    def __init__(self, values: np.ndarray):
        self.levels, n = [values], 1
        while 2 * n <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - n], last[n:]))
            n *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), 255, np.uint8)
        some = np.flatnonzero(b > a)
        level = np.log2((b - a)[some]).astype(np.int64) if len(some) else some
        for k in np.unique(level).tolist():
            x = some[level == k]
            out[x] = np.minimum(self.levels[k][a[x]], self.levels[k][b[x] - (1 << k)])
        return out


def collection_bwt(text: np.ndarray, offsets: np.ndarray, longest: int = 254) -> _File:
    """All suffixes in order: the symbol in front (0 at a document's front, else 1.. by byte), the common prefix with
    the suffix before (at most ``longest``), length and document; ends of documents come in document order.

    A round's new suffix is a symbol c in front of one of the last round's. The suffix before it is c in front of the
    last suffix above that has c in front, and what the two have in common is one more than the least common prefix between
    those; likewise for the suffix behind it. Both come from one pass over the file.
    """
    m = len(offsets) - 1
    lengths = np.diff(offsets)
    used = np.unique(text)
    if len(used) > 255:
        raise ValueError("at most 255 different bytes")  # UTF-8 never holds them all
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    symbols = len(used) + 1
    text = code[text]

    def suffixes(docs, length):
        rows = np.zeros(len(docs), SUFFIX)
        front = lengths[docs] - length
        if len(text):
            rows["bwt"] = np.where(front > 0, text[np.maximum(0, offsets[docs] + front - 1)], 0)
        rows["size"], rows["doc"] = length, docs
        return rows

    docs = np.arange(m)
    out = _File(suffixes(docs, 0))
    at = np.arange(m)  # where each document's last suffix is, ascending
    none = np.int64(-1)
    for length in range(1, int(lengths.max(initial=0)) + 1):
        go = lengths[docs] >= length
        docs, at = docs[go], at[go]
        first = text[offsets[docs] + lengths[docs] - length]
        rank, above, below = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.uint8), np.zeros(len(docs), np.uint8)
        linked, follows = np.zeros(len(docs), bool), np.zeros(len(docs), bool)  # has one before; the one behind is old
        counts = np.zeros(symbols, np.int64)  # of each symbol so far
        since = np.full(symbols, 255, np.uint8)  # least common prefix since its last occurrence
        open_query, open_least = np.full(symbols, none), np.full(symbols, 255, np.uint8)  # a query whose next occurrence is still to come
        for start, part in out.blocks():
            bwt, least = part["bwt"].copy(), _RangeMin(part["lcp"].copy())
            n = len(part)
            order = np.argsort(bwt, kind="stable")
            nth = np.empty(n, np.int32)
            nth[order] = np.arange(n, dtype=np.int32)
            here = np.bincount(bwt, minlength=symbols)
            begin = np.cumsum(here) - here
            i, j = np.searchsorted(at, [start, start + n])
            p, c = at[i:j] - start, first[i:j]
            asked = np.zeros(n, bool)
            asked[p] = True
            whole = int(least(np.zeros(1, np.int64), np.array([n]))[0])
            some = np.flatnonzero(here)
            lead, last = order[begin[some]], order[begin[some] + here[some] - 1]
            # queries of earlier blocks whose next occurrence is here
            q = open_query[some]
            w = q >= 0
            below[q[w]] = np.minimum(open_least[some[w]], least(np.zeros(int(w.sum()), np.int64), lead[w] + 1))
            follows[q[w]] = ~asked[lead[w]]
            open_query[some] = none
            k = nth[p].astype(np.int64)
            local = k - begin[c]
            rank[i:j] = counts[c] + local
            inside = local > 0
            a = np.where(inside, order[np.maximum(k - 1, 0)] + 1, 0)
            above[i:j] = np.minimum(least(a, p + 1), np.where(inside, 255, since[c]))
            linked[i:j] = inside | (counts[c] > 0)
            more = local + 1 < here[c]
            b = np.where(more, order[np.minimum(k + 1, n - 1)], n - 1)
            rest = least(p + 1, b + 1)
            below[i:j] = rest
            follows[i:j] = more & ~asked[b]
            ends = np.flatnonzero(~more)  # the last of its symbol in this block
            open_query[c[ends]], open_least[c[ends]] = i + ends, rest[ends]
            waiting = np.ones(symbols, bool)
            waiting[some] = False
            open_least[waiting] = np.minimum(open_least[waiting], whole)
            since[waiting] = np.minimum(since[waiting], whole)
            since[some] = least(last + 1, np.full(len(some), n))
            counts += here
        base = m + np.concatenate([[0, 0], np.cumsum(counts[1:])])[:symbols]
        place = base[first] + rank
        order = np.argsort(place)
        docs, at = docs[order], place[order]
        rows = suffixes(docs, length)
        rows["lcp"] = np.where(linked, np.minimum(above.astype(np.int64) + 1, longest), 0)[order]
        behind = follows[order]
        out.insert(at, rows, at[behind] + 1, np.minimum(below[order][behind].astype(np.int64) + 1, longest).astype(np.uint8))
    return out


# ---------------------------------------------------------------- segments
def segments(buf: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """key, row, start and number of strings of each run of strings that share their least hash; a run has as many strings
    as a string has grams at most (only text that repeats itself would make longer ones)."""
    if len(buf) < size:
        return (np.zeros(0, C.U64),) + (np.zeros(0, np.int64),) * 3
    low, have, width = C.gram_hashes(buf, gram), 1, size - gram + 1
    while have < width:  # least hash of ever longer stretches
        more = min(have, width - have)
        low = np.minimum(low[: len(low) - more], low[more:])
        have += more
    cut = np.ones(len(low), bool)
    cut[1:] = low[1:] != low[:-1]
    ends = offsets[1:]
    for edge in (offsets[:-1], ends - size + 1):  # a row's first string, and the first place whose string would leave the row
        cut[edge[(edge >= 0) & (edge < len(low))]] = True
    first = np.flatnonzero(cut)
    runs = np.diff(np.append(first, len(low)))
    row = np.searchsorted(offsets, first, side="right") - 1
    own = first + size <= ends[row]
    first, runs, row = first[own], runs[own], row[own]
    if len(runs) and runs.max() > width:
        parts = -(-runs // width)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        runs = np.minimum(width, np.repeat(runs, parts) - nth * width)
        first, row = np.repeat(first, parts) + nth * width, np.repeat(row, parts)
    return low[first] >> C.U64(KEY_SHIFT), row, first - offsets[row], runs


def _texts(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.col(text)).alias("key1"), F.xxhash64(F.col(text), F.lit(1)).alias("key2"), F.col(text).cast("string").alias("text"))


def shared_keys(texts: DataFrame, size: int, gram: int, shards: int, flush: int = 1 << 20) -> DataFrame:
    """key: hashes that two texts or more hold."""
    bits = C.U64(KEY_SHIFT)

    def collect(batches):
        held, n, rows = [], 0, 0

        def out():
            # keys with their row in the low bits: equal keys of several rows lie together
            k = np.sort(np.concatenate(held))
            k = k[np.concatenate([[True], k[1:] != k[:-1]])]
            plain = k >> bits
            first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
            k = plain[first] << C.U64(1) | (np.diff(np.append(first, len(plain))) > 1).astype(C.U64)
            shard = ((k >> C.U64(1)) % C.U64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(bounds)).tolist()
            six = k[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([six[bounds[s] : bounds[s + 1]].tobytes() for s in some], pa.binary())], names=["shard", "keys"])

        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("text"))
            for i, j in C.pieces(offsets):
                if n and (n >= flush or rows + j - i > 1 << KEY_SHIFT):
                    yield out()
                    held, n, rows = [], 0, 0
                key, row, _, _ = segments(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, gram)
                held.append(key << bits | ((row + rows) & ((1 << KEY_SHIFT) - 1)).astype(C.U64))
                rows += j - i
                n += len(key)
        if n:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        parts = []
        for x in table.column("keys"):
            wide = np.zeros((len(x.as_buffer()) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
            parts.append(wide.view("<u8").ravel())
        k = np.sort(np.concatenate(parts))
        plain = k >> C.U64(1)
        first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(k)))
        many = np.maximum.reduceat(k & C.U64(1), first) if len(k) else n
        return pa.table({"key": plain[first][(n > 1) | (many > 0)].view(np.int64)})

    return texts.select("text").mapInArrow(collect, "shard int, keys binary").groupBy("shard").applyInArrow(meet, "key long")


def shared_segments(texts: DataFrame, keys: DataFrame, n_keys: int, size: int, gram: int) -> DataFrame:
    """key, segment (bytes), places (doc_id, key1, start as longs) of each segment under a shared key, per task."""
    spark = texts.sparkSession
    small = n_keys <= BROADCAST_KEYS
    shared = spark.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy().view(C.U64)) if small else None)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("text"))
            ids = np.stack([batch.column("doc_id").to_numpy(), batch.column("key1").to_numpy()], 1)
            for i, j in C.pieces(offsets, 4 << 20):
                part = buf[offsets[i] : offsets[j]]
                off = offsets[i : j + 1] - offsets[i]
                key, row, start, n = segments(part, off, size, gram)
                if wanted is not None:
                    hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key if len(wanted) else np.zeros(len(key), bool)
                    key, row, start, n = key[hit], row[hit], start[hit], n[hit]
                if not len(key):
                    continue
                a = off[row] + start
                b = a + n + size - 1
                name = C.PrefixHash(part)(a, b)
                order = np.argsort(name, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
                head = order[first]
                where = np.concatenate([ids[i:j][row[order]], start[order][:, None]], 1).astype("<i8")
                raw, cuts = part.tobytes(), np.append(first, len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[head].view(np.int64)), pa.array([raw[x:y] for x, y in zip(a[head].tolist(), b[head].tolist(), strict=True)], pa.binary()), pa.array([where[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())],
                    names=["key", "segment", "places"],
                )

    rows = texts.select("doc_id", "key1", "text").mapInArrow(run, "key long, segment binary, places binary")
    return rows if small else rows.join(keys, "key", "left_semi")


def removed_spans(found: DataFrame, size: int, shards: int, buckets: int) -> DataFrame:
    """bucket, spans (packed: see ``_pack_spans``): stretches to remove, by bucket of their document, from each shard's transform."""

    def run(table: pa.Table) -> pa.Table:
        # equal segments of several tasks become one
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(x.as_py(), len(index)) for x in table.column("segment")], np.int64)
        parts = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 3) for x in table.column("places")]
        where, seg = np.concatenate(parts), np.repeat(of, [len(p) for p in parts])
        who, start = where[:, 0], where[:, 2]
        least = np.full(len(index), _LAST)
        np.minimum.at(least, seg, who)
        names = list(index)
        sizes = np.array([len(x) for x in names], np.int64)
        key = np.zeros(len(names), np.int64)
        key[of] = table.column("key").to_numpy()
        _, same, count = np.unique(key, return_inverse=True, return_counts=True)
        # a hash with one segment has nothing to compare; all others go through the transform
        many = np.flatnonzero(count[same] > 1)
        text = np.frombuffer(b"".join(names[k] for k in many.tolist()), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes[many])])
        order = collection_bwt(text, offsets, size).whole()
        # consecutive suffixes that share ``size`` bytes are one string: its least doc_id
        first = np.full(int(offsets[-1]) + 1, _LAST)  # by place of the string in ``text``
        order = order[order["size"] >= size]  # a shorter suffix between two of them would cut their common prefix
        d, n, c = order["doc"].astype(np.int64), order["size"].astype(np.int64), order["lcp"]
        group = np.flatnonzero(c < size)
        owner = np.minimum.reduceat(least[many[d]], group) if len(group) else np.zeros(0, np.int64)
        first[offsets[d] + sizes[many[d]] - n] = np.repeat(owner, np.diff(np.append(group, len(d))))
        # segments whose strings have one owner give whole stretches; in the others each string decides
        low, high = least.copy(), least.copy()
        if len(many):
            cuts = np.stack([offsets[:-1], offsets[1:] - size + 1], 1).ravel()
            low[many], high[many] = np.minimum.reduceat(first, cuts)[::2], np.maximum.reduceat(first, cuts)[::2]
        place = np.full(len(names), -1)
        place[many] = np.arange(len(many))
        even = (low == high)[seg]
        pick = np.flatnonzero(even & (low[seg] < who))
        spots, begins, ends = [pick], [start[pick]], [start[pick] + sizes[seg[pick]]]
        uneven = np.flatnonzero(~even & (low[seg] < who))
        for i in range(0, len(uneven), 1 << 14):
            k = uneven[i : i + (1 << 14)]
            n = sizes[seg[k]] - size + 1
            cum = np.cumsum(n) - n
            nth = np.arange(n.sum()) - np.repeat(cum, n)
            hit = first[np.repeat(offsets[place[seg[k]]], n) + nth] < np.repeat(who[k], n)
            inner = nth > 0
            opens = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & inner))
            closes = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([inner[1:], [False]])))
            own = np.repeat(k, n)[opens]
            spots.append(own)
            begins.append(nth[opens] + start[own])
            ends.append(nth[closes] + size + start[own])
        k, a, b = (np.concatenate(x) for x in (spots, begins, ends))
        return _pack_spans(where[k, 0], where[k, 1], a, b, buckets)

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    return found.select(shard.alias("shard"), "key", "segment", "places").groupBy("shard").applyInArrow(run, "bucket int, spans binary")


def _bucket(doc: np.ndarray, key: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc ^ key, buckets)


def _pack_spans(doc: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket: number of documents and spans, the documents (doc_id, key1), spans of each, and the spans' ends."""
    if not len(doc):
        return pa.table({"bucket": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
    bucket = _bucket(doc, key, buckets)
    order = np.lexsort((begin, key, doc, bucket))
    bucket, doc, key, begin, end = bucket[order], doc[order], key[order], begin[order], end[order]
    # spans that touch become one
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + (group << 40)) - (group << 40)
    new[1:] |= begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    end = reach[np.append(first[1:] - 1, len(doc) - 1)]
    bucket, doc, key, begin = bucket[first], doc[first], key[first], begin[first]
    some, at = np.unique(bucket, return_index=True)
    blobs = []
    for i, j in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True):
        d, k = doc[i:j], key[i:j]
        head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
        n = np.diff(np.append(head, j - i))
        blobs.append(b"".join([np.array([len(head), j - i], "<i8").tobytes(), d[head].astype("<i8").tobytes(), k[head].astype("<i8").tobytes(), n.astype("<i4").tobytes(), begin[i:j].astype("<u4").tobytes(), end[i:j].astype("<u4").tobytes()]))
    return pa.table({"bucket": pa.array(some, pa.int32()), "spans": pa.array(blobs, pa.binary())})


def _unpack_spans(data) -> tuple[np.ndarray, ...]:
    """doc_id, key1, number of spans of each document; begin and end of each span."""
    m, n = np.frombuffer(data, "<i8", 2).tolist()
    at, out = 16, []
    for kind, count in (("<i8", m), ("<i8", m), ("<i4", m), ("<u4", n), ("<u4", n)):
        out.append(np.frombuffer(data, kind, count, at).astype(np.int64))
        at += count * int(kind[2])
    return tuple(out)


def _kept(buf: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """What the rows keep without the stretches given. Callers pass a few rows at a time: this takes many times their bytes."""
    edge = np.zeros(len(buf) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge[:-1], dtype=np.int8) == 0
    cuts = np.concatenate([[0], np.cumsum(C.per_row(kept, offsets))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(buf[kept])])


def cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans, kept of the rows of a bucket (doc_id, key1, copy, text), from its spans."""
    buf, offsets = C.text_bytes(left.column("text"))
    length, copy = np.diff(offsets), np.asarray(left.column("copy"))
    row: dict[tuple[int, int], list[int]] = {}
    for k, who in enumerate(zip(left.column("doc_id").to_pylist(), left.column("key1").to_pylist(), strict=True)):
        if not copy[k]:
            row.setdefault(who, []).append(k)
    begins, ends = [offsets[:-1][copy]], [offsets[1:][copy]]  # copies go entirely
    for x in right.column("spans"):
        doc, key, n, begin, end = _unpack_spans(x.as_buffer())
        at = np.cumsum(n) - n
        rows = [(k, i) for i, who in enumerate(zip(doc.tolist(), key.tolist(), strict=True)) for k in row.get(who, ())]  # rows that repeat share their spans
        if rows:
            k, i = np.array(rows).T
            pick = np.repeat(at[i] - (np.cumsum(n[i]) - n[i]), n[i]) + np.arange(n[i].sum())
            base = np.repeat(offsets[k], n[i])
            begins.append(begin[pick] + base)
            ends.append(end[pick] + base)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    of = np.searchsorted(offsets, begin, side="right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    begin, end, of = begin[first], reach[np.append(first[1:] - 1, len(reach) - 1)] if len(first) else reach, of[first]
    kept = [_kept(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], begin[a:b] - offsets[i], end[a:b] - offsets[i]) for i, j in C.pieces(offsets) for a, b in (np.searchsorted(of, [i, j]).tolist(),)]
    removed = np.bincount(of, end - begin, minlength=len(length)).astype(np.int64)
    return pa.table({
        "doc_id": left.column("doc_id"), "n_bytes": pa.array(length), "n_removed": pa.array(removed), "n_spans": pa.array(np.bincount(of, minlength=len(length)).astype(np.int64)),
        "kept": pa.chunked_array(kept, pa.binary()),
    })


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SIZE, gram: int = GRAM, shard_keys: int = 40_000, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of each row."""
    texts = _texts(docs, text, id)
    owners = texts.groupBy("key1", "key2").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = C.materialize(owners, "copies").toDF("o1", "o2", "owner", "n")
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    copy = (F.col("owner") < F.col("doc_id")) & (F.octet_length("text") >= size)
    marked = texts.join(owners, (F.col("key1") == F.col("o1")) & (F.col("key2") == F.col("o2")), "left").withColumn("copy", F.coalesce(copy, F.lit(False))).drop("o1", "o2", "owner", "n")
    single = marked.where("NOT copy")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    keys = C.materialize(shared_keys(single, size, gram, max(4, total >> 24)), "shared-keys")
    n_keys, buckets = keys.count(), max(4, -(-total // bucket_bytes))
    spans = removed_spans(shared_segments(single, keys, n_keys, size, gram), size, max(4, -(-n_keys // shard_keys)), buckets)
    spans = C.materialize(spans, "spans")
    rows = marked.withColumn("bucket", F.pmod(F.col("doc_id").bitwiseXOR(F.col("key1")), F.lit(buckets)).cast("int"))

    dealt = rows.select("bucket", "doc_id", "key1", "copy", "text").groupBy("bucket").cogroup(spans.groupBy("bucket"))
    done = dealt.applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))


def op8_column_bwt(spark, sf_dir: str) -> DataFrame:
    """What each document loses to those before it."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, bytes]], size: int = SIZE) -> dict[int, tuple[int, int, bytes]]:
    """doc_id -> (removed bytes, spans, kept bytes), straight from the definition (for tests)."""
    first: dict[bytes, int] = {}
    for who, t in sorted(docs):
        for i in range(len(t) - size + 1):
            first.setdefault(t[i : i + size], who)
    out = {}
    for who, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < who:
                gone[i : i + size] = b"\x01" * size
        spans = sum(g and not p for g, p in zip(gone, [0, *gone], strict=False))
        out[who] = (sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out
