"""Insertions and deletions against a master sequence of the same virus type."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import code_points, insert_gaps
from ..runtime import shared

NORMAL_LENGTH = {"A(H1N1)": 549, "A(H3N2)": 550, "B": 570}
REACH, GOOD = 5, 0.7
GAPS = "array<struct<pos:int,n:int>>"


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common residues of the overlap: equal, not X, no gap."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return (a == b) & (a != ord("X")) & (a != ord("-"))


def place_gaps(master: str, own: str, virus_type: str = "") -> list[tuple[int, int]] | None:
    """Runs of gaps (position from 0, length) for ``own``, each the best one so far; None if the fit stays bad.

    Candidates are all mismatches with 1 to 5 gaps; the score is what is common before plus what is common behind
    the shift; best is the highest score, then the first position, then the fewest gaps. For B, single gaps at
    164 to 166 move to 163 and a triple one at 164 moves to 162 (positions from 1), by convention.
    """
    m, gaps, start = _codes(master), [], 0
    text = own
    best_fit = int(_equal(m, _codes(text)).sum())
    while start < len(text):
        t = _codes(text)
        same = _equal(m, t)
        now, n = int(same.sum()), len(same)
        before = np.concatenate([[0], np.cumsum(same)])
        open_ = ~same & (t[:n] != ord("-")) & (m[:n] != ord("-"))
        at = np.flatnonzero(open_)
        at = at[(at >= start) & (at + REACH < n)]
        best = None
        for k in range(1, REACH + 1):
            shifted = _equal(m[k:], t)  # how t fits k residues further on
            after = np.concatenate([np.cumsum(shifted[::-1])[::-1], [0]])
            ok = at[shifted[at]] if len(at) else at
            if len(ok):
                score = before[ok] + after[ok]
                i = int(np.argmax(score))
                found = (-int(score[i]), int(ok[i]), k)
                best = found if best is None or found < best else best
        start = len(text)
        if best and -best[0] > now:
            score, pos, k = -best[0], best[1], best[2]
            moved = 162 if virus_type == "B" and k == 1 and 162 < pos <= 165 else 161 if virus_type == "B" and k == 3 and pos == 163 else pos
            text = text[:moved] + "-" * k + text[moved:]
            if moved != pos:
                score = int(_equal(m, _codes(text)).sum())
            start = moved + k + 1
            gaps.append((moved, k))
            best_fit = max(best_fit, score)
    return None if best_fit < int(len(master) * GOOD) else gaps


def _matrix(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a row each, zeros behind them, and their lengths."""
    points, at = code_points(pd.Series(texts, dtype=object))
    size = np.diff(at)
    out = np.zeros((len(texts), width), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(points)) - np.repeat(at[:-1], size)] = points
    return out, size


def place_all(masters: list[str], texts: list[str], kinds: list[str], rows: int = 128) -> list[list[tuple[int, int]] | None]:
    """``place_gaps`` of many pairs at once, ``rows`` of them in step: the matches at every shift are one array each, their running sums
    give every candidate's score, and rows whose last gap was their best so far take part in the next round."""
    out: list[list[tuple[int, int]] | None] = []
    for i in range(0, len(texts), rows):
        out += _place(masters[i : i + rows], texts[i : i + rows], kinds[i : i + rows])
    return out


def _place(masters: list[str], texts: list[str], kinds: list[str]) -> list[list[tuple[int, int]] | None]:
    n = len(texts)
    width = max([len(x) for x in (*masters, *texts)], default=0) + REACH
    m, m_size = _matrix(masters, width)
    t, t_size = _matrix(texts, width)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    is_b = np.array([k == "B" for k in kinds])
    best_fit, start, open_rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    column = np.arange(width)

    def matches(a, b, size):
        return (a == b) & (a != ord("X")) & (a != ord("-")) & (np.arange(a.shape[1]) < size[:, None])

    first = True
    while len(open_rows):
        r = open_rows
        a, b = m[r], t[r]
        n_over = np.minimum(m_size[r], t_size[r])
        same = matches(a, b, n_over)
        now = same.sum(axis=1)
        if first:
            best_fit[r] = now
            first = False
        before = np.cumsum(same, axis=1, dtype=np.int32) - same
        may = ~same & (b != ord("-")) & (a != ord("-")) & (column >= start[r][:, None]) & (column + REACH < n_over[:, None])
        score, pos, width_of = np.full(len(r), -1), np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for k in range(1, REACH + 1):
            shifted = matches(a[:, k:], b[:, : width - k], np.minimum(m_size[r] - k, t_size[r]))
            after = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]
            s = np.where(may[:, : width - k] & shifted, before[:, : width - k] + after, np.int32(-1))
            p = np.argmax(s, axis=1)
            s = s[np.arange(len(r)), p]
            better = (s > score) | ((s == score) & (s >= 0) & (p < pos))
            score, pos, width_of = np.where(better, s, score), np.where(better, p, pos), np.where(better, k, width_of)
        go = score > now
        r, score, pos, k = r[go], score[go], pos[go], width_of[go]
        moved = np.where(is_b[r] & (k == 1) & (pos > 162) & (pos <= 165), 162, np.where(is_b[r] & (k == 3) & (pos == 163), 161, pos))
        grown = t_size[r] + k
        if len(r) and grown.max() + REACH > width:  # room for the longest row
            more = int(grown.max()) + 8 * REACH - width
            m, t = np.pad(m, ((0, 0), (0, more))), np.pad(t, ((0, 0), (0, more)))
            width += more
            column = np.arange(width)
        source = np.where(column < moved[:, None], column, np.maximum(column - k[:, None], 0))
        inside = (column >= moved[:, None]) & (column < (moved + k)[:, None])
        t[r] = np.where(inside, ord("-"), np.take_along_axis(t[r], source, axis=1))
        t_size[r] = grown
        other = moved != pos
        score[other] = matches(m[r[other]], t[r[other]], np.minimum(m_size[r[other]], grown[other])).sum(axis=1)
        best_fit[r] = np.maximum(best_fit[r], score)
        start[r] = moved + k + 1
        for row, p, w in zip(r.tolist(), moved.tolist(), k.tolist(), strict=True):
            gaps[row].append((p, w))
        open_rows = r[start[r] < t_size[r]]
    good = best_fit >= np.array([int(x * GOOD) for x in m_size], np.int64)
    return [g if ok else None for g, ok in zip(gaps, good.tolist(), strict=True)]


def masters(seqs: DataFrame) -> DataFrame:
    """Per virus type the first aligned sequence of normal length, else the first one (then ``fixed`` is false). One row a type."""
    rows = seqs.where("align_status = 'aligned'").select("virus_type", "name", "seq_no", F.col("aligned_aa").alias("master"))
    normal = F.lit(False)
    for kind, n in NORMAL_LENGTH.items():
        normal = normal | ((F.col("virus_type") == kind) & (F.length("master") == n))
    key = F.struct((~normal).alias("odd"), "name", "seq_no")
    return rows.groupBy("virus_type").agg(F.min_by("master", key).alias("master"), F.min(key)["odd"].alias("odd")).select("virus_type", "master", (~F.col("odd")).alias("fixed"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType())])))
def _gaps(master: pd.Series, own: pd.Series, kind: pd.Series) -> pd.Series:
    rows = [k for k, (m, o) in enumerate(zip(master, own, strict=True)) if m and o]
    out: list[list[dict]] = [[] for _ in range(len(own))]
    for k, found in zip(rows, place_all(master.iloc[rows].tolist(), own.iloc[rows].tolist(), kind.iloc[rows].tolist()), strict=True):
        out[k] = [{"pos": p, "n": n} for p, n in found or []]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BooleanType())
def _takes_over(master: pd.Series, own: pd.Series, kind: pd.Series) -> pd.Series:
    """Whether a row fits the master badly, is long enough, and fits well the other way round."""
    m, o, k = master.tolist(), own.tolist(), kind.tolist()
    bad = [i for i, found in enumerate(place_all(m, o, k)) if found is None]
    back = place_all([o[i] for i in bad], [m[i] for i in bad], [k[i] for i in bad])
    out = np.zeros(len(o), bool)
    out[[i for i, found in zip(bad, back, strict=True) if found is not None]] = True
    return pd.Series(out)


def settled_masters(seqs: DataFrame, turns: int = 100, written: bool = False) -> DataFrame:
    """virus_type, master of all types. In a type without a sequence of normal length the first row that takes over becomes the
    master, and all rows are looked at again, until none does; a master that was replaced never comes back. The rows of such types are
    written once, unless ``seqs`` is ``written`` already; each turn is a pass over what is written, and only one row for each type is held by the driver. More
    than ``turns`` passes are an error: such a type has no master that its rows agree on."""
    spark = seqs.sparkSession
    rows = masters(seqs).collect()
    now, loose, gone = {r["virus_type"]: r["master"] for r in rows}, {r["virus_type"] for r in rows if not r["fixed"]}, set()
    if loose:
        pool = seqs.where("align_status = 'aligned'").where(F.col("virus_type").isin(*loose) & (F.col("aligned_aa") != "")).select("virus_type", "name", "seq_no", "aligned_aa")
        pool = pool if written else shared(pool)
    while loose:
        table = spark.createDataFrame([(k, now[k]) for k in sorted(loose)], "virus_type string, master string")
        able = (F.col("aligned_aa") != F.col("master")) & (F.length("aligned_aa") > F.rint(F.length("master") * F.lit(0.9))) & (F.col("master") != "")
        hits = pool.join(F.broadcast(table), "virus_type").where(able)
        if gone:
            hits = hits.join(F.broadcast(spark.createDataFrame(sorted(gone), "virus_type string, aligned_aa string")), ["virus_type", "aligned_aa"], "left_anti")
        hits = hits.where(_takes_over("master", "aligned_aa", "virus_type"))
        first = hits.groupBy("virus_type").agg(F.min_by("aligned_aa", F.struct("name", "seq_no")).alias("master")).collect()
        loose = {r["virus_type"] for r in first}
        gone |= {(k, now[k]) for k in loose}
        now |= {r["virus_type"]: r["master"] for r in first}
        turns -= 1
        if turns < 0 and loose:
            raise ValueError(f"no settled master for {sorted(loose)}")
    return spark.createDataFrame(sorted(now.items()), "virus_type string, master string")


def detect(seqs: DataFrame) -> DataFrame:
    """``seqs`` (with ``aligned_aa``) and ``gaps`` of each row against its type's master, without a shuffle. ``seqs`` is written once: what it is
    computed from is heavier than the passes over it."""
    seqs = shared(seqs)
    rows = seqs.join(F.broadcast(settled_masters(seqs, written=True)), "virus_type", "left")  # a row for each virus type
    gaps = F.when(F.col("align_status") == "aligned", _gaps("master", "aligned_aa", "virus_type"))
    return rows.withColumn("gaps", F.coalesce(gaps, F.array().cast(GAPS))).drop("master")


def apply(seqs: DataFrame) -> DataFrame:
    """Put the gaps into amino acids and nucleotides (positions count from the aligned start)."""
    moved = lambda shift, width: F.transform("gaps", lambda g: F.struct(F.greatest(F.lit(0), g["pos"] - shift).cast("int").alias("pos"), g["n"].alias("n")))
    return seqs.withColumn("aa", F.when(F.size("gaps") > 0, insert_gaps(F.col("aa"), moved(F.col("aa_shift"), 1))).otherwise(F.col("aa"))).withColumn(
        "nuc", F.when((F.size("gaps") > 0) & (F.col("nuc") != ""), insert_gaps(F.col("nuc"), moved(F.col("aa_shift"), 3), 3)).otherwise(F.col("nuc"))
    )
