"""FASTA as a data source, entries as a stream, numbering, reports of batches without residues, tables beside FASTA files."""

import gzip
import json
import lzma
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift import schema
from strandsift.functions import sequence
from strandsift.operators import aggregates, lookups, merge, ordering
from strandsift.sources import database, fasta, fasta_source, sinks
from strandsift.streaming import entry_stream, fasta_stream

MOTIF = "GCTACTCTTTGTCTTGGTCATCATGCTGTT"


def text_of(n):
    return "; comment\n\nAC\n" + "".join(f">r{i} a>b\r\nACGT\r\n; note\r\nAC/t\r\n\r\n" for i in range(n)) + ">bad\nAC1\n>only name\n>\nAC\n"


# ---------------------------------------------------------------- the source
@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_source_reads_what_read_fasta_reads(spark, tmp_path, block):
    (tmp_path / "x.fas").write_text(text_of(40))
    got = fasta_source.register(spark).read.format("fasta").option("block", block).load(str(tmp_path / "x.fas")).orderBy("offset").collect()
    want = fasta.read_fasta(spark, str(tmp_path / "x.fas"), strict=False).orderBy("record_no").collect()
    assert [(r["name"], r["sequence"]) for r in got] == [(r["name"], r["sequence"]) for r in want] and len(got) == 44
    assert [bool(r["error"]) for r in got] == [bool(r["error"]) for r in want]
    raw = (tmp_path / "x.fas").read_bytes()
    assert all(raw[r["offset"] : r["offset"] + 1] == b">" for r in got[1:]) and raw[got[0]["offset"] :].startswith(b"AC")


def test_source_folders_filters_and_compression(spark, tmp_path):
    (tmp_path / "a.fas").write_text(text_of(5))
    (tmp_path / "b.fas.gz").write_bytes(gzip.compress(b">z1\nAC\n>z2\nGT\n"))
    (tmp_path / ".hidden").write_text(">no\nAC\n")
    (tmp_path / "empty.fas").write_text("")
    df = fasta_source.register(spark).read.format("fasta").load(str(tmp_path))
    assert df.count() == 9 + 2
    picked = df.where("name = 'z2' OR name = 'r3 a>b'")
    assert {r["name"] for r in picked.collect()} == {"z2", "r3 a>b"}
    for where, names in (("name = 'z2'", {"z2"}), ("name IN ('z1', 'r1 a>b') AND length(sequence) > 2", {"r1 a>b"}), ("name LIKE 'r%' AND name <> 'r0 a>b'", {f"r{k} a>b" for k in range(1, 5)})):
        rows = df.where(where)
        assert {r["name"] for r in rows.collect()} == names
    plan = df.where("name = 'z2'")._jdf.queryExecution().executedPlan().toString()
    assert "= z2" not in plan  # the source has taken the filter
    reader = fasta_source.FastaReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([fasta_source.EqualTo(("name",), "z2"), fasta_source.EqualTo(("file",), "q")])) == [fasta_source.EqualTo(("file",), "q")]
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    with pytest.raises(Exception, match="none"):
        spark.read.format("fasta").load(str(tmp_path / "none")).collect()


def test_source_as_a_stream(spark, tmp_path):
    """New files and files that grew are read once, from the offsets of the checkpoint."""
    (tmp_path / "in").mkdir()

    def run():
        rows = fasta_source.register(spark).readStream.format("fasta").option("block", 50).load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.fas").write_text(">a1\nAC\n>a2 x>y\nGT\n")
    assert run() == ["a1", "a2 x>y"]
    (tmp_path / "in" / "b.fas").write_text("".join(f">b{k}\nACGTACGT\n" for k in range(9)))
    with (tmp_path / "in" / "a.fas").open("a") as f:
        f.write(">a3\nAC\n")
    assert run() == ["a1", "a2 x>y", "a3", *(f"b{k}" for k in range(9))] == run()


def test_stream_of_odd_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fas").write_text(f"; c\n>A/X->Y/1/2015 (x>y)\n; note\n{MOTIF}{'GCT' * 400}\n>bad\n12\n")
    rows = fasta_stream.stream_records(spark, str(tmp_path / "in"), strict=False)
    q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["name"], len(r["sequence"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A/X->Y/1/2015 (x>y)", 1230)]


# ---------------------------------------------------------------- entries as a stream
def test_entries_from_a_stream_are_those_of_the_merge(spark, tmp_path):
    """Three batches, each by a query that starts from the checkpoint, then records that belong before all of them; a name with records too short alone."""
    folder = tmp_path / "in"
    folder.mkdir()
    files = [
        ("b1.fas", f">A/X/1/2015 lab:C1\n{MOTIF}{'GCT' * 400}\n>A/Y/2/2015\n{MOTIF}{'GAT' * 400}\n"),
        ("b2.fas", f">A/X/1/2015 lab:C2\n{MOTIF}{'GCT' * 420}\n"),
        ("b3.fas", f">A/Z/1/2015\nACGT\n>A/X/1/2015 lab:C5\n{MOTIF}{'GTT' * 420}\n"),
        ("a0.fas", f">A/X/1/2015 lab:C7\n{MOTIF}{'GCT' * 410}\n>A/Y/2/2015\nACGT\n>A/V/3/2015\n{MOTIF}{'GAA' * 410}\n"),
    ]
    rows = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())
    seen = []
    for name, text in files:
        (folder / name).write_text(text)
        q = entry_stream.ingest(entry_stream.stream_records(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        log = spark.read.parquet(str(tmp_path / "log"))
        assert rows(entry_stream.latest(log)) == rows(merge.merge(entry_stream.table_records(spark, str(folder))))
        seen.append({r["name"]: r["v"] for r in log.groupBy("name").agg(F.max("version").alias("v")).collect()})
    x, y = "A(H3N2)/X/1/2015", "A(H3N2)/Y/2/2015"
    assert [s.get(x) for s in seen] == [1, 2, 3, 4] and [s.get(y) for s in seen] == [1, 1, 1, 1]  # an entry that does not change is not logged again
    got = {r["seq_no"]: r["passages"] for r in entry_stream.latest(log).where(F.col("name") == x).collect()}
    assert got == {0: ["MDCK7", "MDCK1", "MDCK2"], 1: ["MDCK5"]}


# ---------------------------------------------------------------- numbering
def test_numbers_without_a_whole_task(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{int(k)}", int(v)) for k, v in zip(rng.integers(0, 50, 500), rng.permutation(500), strict=True)] + [("n1", None), ("n1", None)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(7)
    got = [(r["name"], r["v"], r["k"]) for r in ordering.numbered(df, "name", "v").orderBy("k").collect()]
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert got == [(*r, k) for k, r in enumerate(want, 1)] and ordering.numbered(df.limit(0), "name").count() == 0
    lines = [r["value"] for r in sinks.bioseq_lines(df.select("name", F.lit("AC").alias("sequence"), "v"), "name", "v").collect()]
    assert len(lines) == 1004 and lines[0].startswith("001>n0") and lines[501].startswith("502>") and lines[502] == "001>AC"


# ---------------------------------------------------------------- reports
def test_reports_of_batches_without_residues(spark):
    for rows in ([("",)], [(None,)], [("",), (None,)], []):
        df = spark.createDataFrame(rows, "aa string")
        for report in (aggregates.composition(df, "aa"), aggregates.profile(aggregates.composition(df, "aa")), aggregates.shannon(aggregates.composition(df, "aa")), aggregates.weak_positions(df, "aa"), sinks.positions_json(df, "aa"), aggregates.variable_codons(df, "aa"), aggregates.codon_report(df, "aa")):
            assert report.collect() == []
    df = spark.createDataFrame([("AC",), ("",), ("AG",), (None,)], "aa string")
    assert [json.loads(r["value"]) for r in sinks.positions_json(df, "aa").orderBy("pos").collect()] == [{"pos": 1, "shannon": 0, "counts": {"A": 2}}, {"pos": 2, "shannon": 69, "counts": {"C": 1, "G": 1}}]


def test_codons_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("abx"[int(g)], "".join(rng.choice(list("ACé"), int(n)))) for g, n in zip(rng.integers(0, 3, 60), rng.integers(0, 12, 60), strict=True)] + [(None, "ACG"), ("a", None), ("a", ""), ("a", "TTTACA"), ("b", "GGGACAT")]
    df = spark.createDataFrame(rows, "g string, nuc string")
    want = Counter((g, k // 3 + 1, s[k : k + 3]) for g, s in rows if s for k in range(0, len(s) - 2, 3))
    assert {(r["g"], r["pos"], r["codon"]): r["n"] for r in aggregates.codon_counts(df, "nuc", "g").collect()} == want
    pair = spark.createDataFrame([("a", "TTTACA"), ("a", "TTCACA"), ("b", "GGGACA"), ("c", "TTTTTT"), (None, "GGG")], "g string, nuc string")
    assert [(r["pos"], r["codons_1"], r["codons_2"]) for r in aggregates.separating(pair, "g", "a", "b").collect()] == [(1, ["TTC", "TTT"], ["GGG"])]


# ---------------------------------------------------------------- tables beside FASTA files, and what had no test
def test_csv_beside_fasta(spark):
    records = spark.createDataFrame([("X_4", "AC"), ("YEG1F_4", "GT"), ("ZR_4", "TT"), ("ZR_4", "TA"), ("none", "A"), (None, "C")], "name string, sequence string")
    table = spark.createDataFrame([("X", "short"), ("X", "short 2"), ("X_4", "whole"), ("Y", "y"), ("Z", "old"), ("Z", "z"), (None, "null")], "fasta_id string, name string").coalesce(1)
    got = sorted((r["sequence"], r["name"], r["csv_name"]) for r in fasta.with_csv(records, table).collect())
    assert got == [("A", "none", None), ("AC", "X_4", "whole"), ("C", None, None), ("GT", "YEG1F_4", "y"), ("TA", "ZR_4", "z"), ("TT", "ZR_4", "z")]


def test_template_left_part_and_clades_of_antigens(spark):
    df = spark.createDataFrame([("A/X", 3, -4), (None, 5, 2), ("B", None, None)], "name string, n int, shift int")
    got = [r[0] for r in df.select(sequence.name_from_template("{name}|{n} end{name}", {"name": F.col("name"), "n": F.col("n")})).collect()]
    assert got == ["A/X|3 endA/X", "|5 end", "B| endB"]
    assert ordering.left_part(df, "shift").first()["left"] == 4 and ordering.left_part(df.where("shift > 0"), "shift").first()["left"] == 0 == ordering.left_part(df.limit(0), "shift").first()["left"]
    seqs = spark.createDataFrame([("a", ["h1", "h2"]), ("b", [])], "name string, hi_names array<string>")
    assert {r["name"]: r["hi_names"] for r in merge.remove_hi_names(seqs).collect()} == {"a": [], "b": []}


def test_database_files_of_other_versions(spark, tmp_path):
    good = {"  version": "sequence-database-v2", "data": [{"N": "A/X [\"q\"]", "s": [{"a": "QK"}, {"a": "M", "s": 2, "t": 6}]}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"  version": "other"}))
    with pytest.raises(Exception, match="version"):
        database.read_database(spark, str(tmp_path)).collect()
    rows = database.read_database(spark, str(tmp_path), ignore_errors=True).collect()
    assert [r["name"] for r in rows] == ['A/X ["q"]'] and [(s["aa_shift"], s["align_status"]) for s in rows[0]["seqs"]] == [(None, "untried"), (2, "aligned")]
    again = database.read_database(spark, str(tmp_path / "a.json"), compatible=True).first()
    assert [(s["aa_shift"], s["nuc_shift"], s["align_status"]) for s in again["seqs"]] == [(0, 0, "aligned"), (2, 6, "aligned")]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_database_file_read_in_pieces(size):
    entries = [{"N": f'A/"{{[,]}}" \\ {k}', "s": [{"a": "Q" * (k * 7 % 50), "s": -k}], "d": []} for k in range(40)]
    for doc in ({"  version": database.VERSION, "data": entries, "n": 12}, {"data": entries, "  version": database.VERSION}, {"  version": database.VERSION, "data": []}):
        for text in (json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False)):
            for content in (text.encode(), lzma.compress(text.encode()[:50]) + lzma.compress(text.encode()[50:])):
                got = list(database._members(content, size))
                assert [json.loads(v) for k, v in got if k == "data"] == doc["data"]
                assert {k: json.loads(v) for k, v in got if k != "data"} == {k: v for k, v in doc.items() if k != "data"}
    for broken in ("", "[]", '{"data": [{"N": "A"', '{"data": [{} {}]}', '{"data": 1}', '{"a" 1}', '{"a": 1'):
        with pytest.raises(ValueError):
            list(database._members(broken.encode(), size))


def test_broken_database_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"  version": database.VERSION, "data": [{"N": f"A/{k}", "s": [{"a": "QK"}]} for k in range(3)]})[:-20])
    with pytest.raises(Exception, match="Expecting|Unterminated|database"):
        database.read_database(spark, str(tmp_path)).collect()
    assert [r["name"] for r in database.read_database(spark, str(tmp_path), ignore_errors=True).orderBy("name").collect()] == ["A/0", "A/1"]


def test_annotations_and_gisaid_are_exchanged(spark, tmp_path):
    doc = {"  version": database.VERSION, "data": [{"N": "A/X", "s": [{"a": "QK", "A": "note", "G": {"i": ["EPI_1"], "D": ["2015"]}}, {"a": "M"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = database.read_database(spark, str(tmp_path / "a.json"))
    database.export_database(rows, str(tmp_path / "b"))
    assert database.read_database(spark, str(tmp_path / "b")).collect() == rows.collect()
    assert [(s["annotations"], s["gisaid"]) for s in schema.flatten(rows).orderBy("seq_no").collect()] == [("note", ["EPI_1", "2015"]), ("", [])]
