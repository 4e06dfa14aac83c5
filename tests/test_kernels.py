"""Batch kernels against their definitions row by row."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandsift.functions import align, sequence
from strandsift.operators import filters, indels, lookups

LETTERS = "ACDEFGHIKLMNPQRSTVWYX-é漢"


def pairs(n, seed):
    """Masters and rows made of them by deletions, insertions and changes; some rows have nothing in common with theirs."""
    rng = np.random.default_rng(seed)
    some = lambda k, m=20: "".join(LETTERS[i] for i in rng.integers(0, m, k))
    for _ in range(n):
        master = some(int(rng.integers(0, 90)) if rng.random() < 0.5 else 200)
        row = list(master)
        for _ in range(int(rng.integers(0, 4))):
            if len(row) > 8:
                at, size = int(rng.integers(0, len(row) - 6)), int(rng.integers(1, 6))
                if rng.random() < 0.6:
                    del row[at : at + size]
                else:
                    row[at:at] = list(some(size, len(LETTERS)))
        for _ in range(int(rng.integers(0, 6))):
            if row:
                row[int(rng.integers(0, len(row)))] = LETTERS[int(rng.integers(0, len(LETTERS)))]
        yield master, some(60, len(LETTERS)) if rng.random() < 0.05 else "".join(row), "B" if rng.random() < 0.5 else "A(H3N2)"


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_of_a_batch(seed):
    m, t, k = map(list, zip(*pairs(5000, seed), strict=True))
    got = indels.place_all(m, t, k)
    assert got == [indels.place_gaps(*x) for x in zip(m, t, k, strict=True)]
    assert sum(bool(x) for x in got) > 500 and sum(x is None for x in got) > 100
    assert indels.place_all([], [], []) == []


def test_gaps_at_places_fixed_for_b():
    master = "".join(LETTERS[(k * 7 + k // 20) % 20] for k in range(570))
    rows = [master[:at] + master[at + n :] for at in range(155, 172) for n in (1, 2, 3)]
    for kind in ("B", "A(H1N1)"):
        assert indels.place_all([master] * len(rows), rows, [kind] * len(rows)) == [indels.place_gaps(master, r, kind) for r in rows]
    assert indels.place_all([master], [master[:163] + master[166:]], ["B"]) == [[(161, 3)]]


def test_no_master_that_settles(spark):
    rows = [("X", f"n{k}", 0, "aligned", "".join(LETTERS[(j * (k + 3) + j // 7) % 20] for j in range(100))) for k in range(5)]
    df = spark.createDataFrame(rows, "virus_type string, name string, seq_no int, align_status string, aligned_aa string")
    assert indels.settled_masters(df).collect() == [("X", rows[0][4])]


def test_distances_in_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("ACX-é"), int(n))), "".join(rng.choice(list("ACX-é"), int(m)))) for n, m in rng.integers(0, 40, (200, 2))] + [(None, "A"), ("A", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sequence.hamming("a", "b"), sequence.common(F.col("a"), F.col("b")), sequence.against_master(F.col("a"), F.col("b")), sequence.translate(F.col("a"), 1)).collect()
    for (a, b), r in zip(rows, got, strict=True):
        if a is not None and b is not None:
            both = list(zip(a, b, strict=False))
            shown = "".join("·" if x == y else x for x, y in both) + a[len(b) :]
            assert tuple(r) == (sum(x != y for x, y in both), sum(x == y and x not in "X-" for x, y in both), shown, sequence.translate_text(a, 1))


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_names_to_extract(spark, most):
    rng = np.random.default_rng(6)
    word = lambda a, b: "".join(rng.choice(list("ab/"), int(rng.integers(a, b))))
    records = [(k, word(0, 12), f"s{k}") for k in range(400)] + [(1000, None, "s")]
    wanted = [(k, word(1, 5)) for k in range(12)] + [(12, None), (None, "a"), (50, "zzz")]
    best = {}
    for no, name, s in records:
        hit = min(((k, w) for k, w in wanted if k is not None and w is not None and name is not None and w in name), default=None)
        if hit:
            best[hit] = (name, s)
    got = filters.extract(spark.createDataFrame(records, "record_no long, name string, sequence string").repartition(3), spark.createDataFrame(wanted, "want_no int, want string"), most)
    assert {(r["want_no"], r["want"]): (r["name"], r["sequence"]) for r in got.collect()} == best and got.schema["want_no"].dataType.simpleString() == "int"


def test_many_names_to_extract(spark):
    wanted = spark.range(100_000).select(F.col("id").alias("want_no"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/")).alias("want"))
    records = spark.range(5000).select(F.col("id").alias("record_no"), F.concat(F.lit("A/X/"), (F.col("id") * 7).cast("string"), F.lit("/2015")).alias("name"), F.lit("").alias("sequence"))
    assert filters.extract(records, wanted).count() == 5000


def test_sequence_of_an_entry_by_laboratory_name(spark):
    from strandsift.operators import lookups

    rows = [("a", [(0, ["h1"]), (1, ["h2", "h3"]), (2, ["h3"])]), ("b", [(0, [])]), ("c", [])]
    df = spark.createDataFrame(rows, "name string, seqs array<struct<seq_no:int,hi_names:array<string>>>")
    got = {r["name"]: r["s"] and r["s"]["seq_no"] for r in df.select("name", lookups.in_entry(F.col("seqs"), "h3").alias("s")).collect()}
    assert got == {"a": 1, "b": None, "c": None}


def motif_hits(aa):
    """Each rule that fits, by the expressions themselves: subtype, lineage, gene, shift."""
    hits = []
    for subtype, lineage, gene, shift, motif, end in align.RULES:
        if m := re.search(motif, aa[:end]):
            hits.append((subtype, lineage, gene, -m.end() if shift == "signal" else (shift or 0) - m.start()))
    return hits


def test_motifs_of_a_batch():
    rnd = random.Random(5)
    texts = ["", "A", "é\n" * 30, "M" * 500]
    for k in range(3000):
        text = "".join(rnd.choices("ACDEFGHIKLMNPQRSTVWYX", k=rnd.randrange(0, 250)))
        for rule in rnd.sample(range(len(align.RULES)), k=rnd.randrange(0, 3)):
            places = re.findall(r"\[[A-Z]+\]|.", align.RULES[rule][4])
            at = rnd.randrange(0, len(text) + 1)
            text = text[:at] + "".join(rnd.choice(x.strip("[]").replace(".", "AWX")) for x in places) + text[at:]
        texts.append(text)
    for text, got in zip(texts, align.align_texts(texts).to_dict("records"), strict=True):
        want = motif_hits(text)
        assert got["found"] == bool(want), text
        if want:
            assert (got["subtype"], got["lineage"], got["gene"], got["aa_shift"]) == want[0], text
            assert (got["warning"] != "") == (len({h[0] for h in want}) > 1 or len({h[3] for h in want}) > 1), text
    assert {r["gene"] for r in align.align_texts(texts).to_dict("records")} >= {"HA", "NA", "M1", "NS1", ""}
    assert not len(align.align_texts([])) and not len(align.translate_and_align_texts([]))


def test_frames_of_a_batch_are_those_of_each_text():
    rnd = random.Random(6)
    codons = [c for c, a in sequence.CODONS.items() if a != "*" and "U" not in c]
    texts = []
    for k in range(60):
        body = "".join(rnd.choices(codons, k=420))
        motif = "".join(next(c for c, a in sequence.CODONS.items() if a == x) for x in "ATLCLGHHAV")
        texts.append("A" * (k % 3) + "".join(rnd.choices(codons, k=k)) + (motif if k % 4 else "") + ("TAA" if k % 5 == 0 else "") + body)
    texts += ["", "ACGT"]
    got = align.translate_and_align_texts(texts)
    assert set(got["status"]) == {"aligned", "failed"}
    for k, text in enumerate(texts):
        pd.testing.assert_frame_equal(got.iloc[[k]].reset_index(drop=True), align.translate_and_align_texts([text]))
        found = []
        for frame in range(3 if len(text) >= 1200 else 0):
            hits = [h for p in sequence.translate_text(text, frame).split("*") if len(p) >= 400 and (h := motif_hits(p))]
            found += [(frame, hits[0][0][0])] if hits else []
        assert (got["status"][k] == "aligned") == bool(found)
        if found:
            assert (got["frame"][k], got["subtype"][k]) == found[0] and (got["warning"][k] == "several frames align") == (len(found) > 1)


@pytest.mark.parametrize("rounds", [0, 1, 30])
def test_antigens_assigned_in_rounds(spark, rounds):
    rnd = random.Random(8)
    rows = [(name, rnd.randrange(6), f"f{rnd.randrange(9)}", rnd.choice((10, 20, 30, 100))) for name in ("A", "B", None) for _ in range(60)]
    rows += [("chain", k + d, f"c{k:02}", 200 - 2 * k - d) for k in range(12) for d in (0, 1)]
    want = []
    for name in {r[0] for r in rows}:
        taken, best = set(), {}
        for _, seq, antigen, score in sorted({r for r in rows if r[0] == name}, key=lambda r: (-r[3], r[2], r[1])):
            if antigen not in taken and (seq not in best or best[seq] == score):
                taken.add(antigen)
                best[seq] = score
                want.append((name, seq, antigen, score))
    got = lookups.assign_antigens(spark.createDataFrame(rows, "name string, seq_no int, full_name string, score int"), rounds).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
