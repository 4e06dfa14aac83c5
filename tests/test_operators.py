"""Operators on hand-made rows, and every driver query against its SQL."""

import lzma
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandsift import schema
from strandsift.operators import filters, indels, lookups, merge, ordering
from strandsift.plans.database import SequenceDB
from strandsift.sources import fasta, sinks

from .helpers import compare


def record(name, nuc="", aa="", no=1, file=0, **more):
    base = {"name": name, "virus_type": "", "lineage": "", "gene": "HA", "date": "", "lab": "", "lab_id": "", "passage": "", "reassortant": "", "nuc": nuc, "aa": aa, "nuc_shift": 0, "aa_shift": 0, "align_status": "aligned", "warning": "", "file_no": file, "record_no": no}
    return base | more


LONG = "ACGT" * 400


def test_fold_merges_and_replaces():
    rows = [record("N", LONG, "A" * 500, 1, passage="E1"), record("N", LONG[4:-4], "A" * 490, 2, passage="E2", date="2015-01-01"), record("N", "GG" + LONG, "A" * 510, 3), record("N", "T" * 1300, "C" * 433, 4)]
    out = merge.fold_name(pd.DataFrame(rows))
    assert out["nuc"].tolist() == ["GG" + LONG, "T" * 1300] and out["passages"][0] == ["E1", "E2"] and out["dates"][0] == ["2015-01-01"]
    short = merge.fold_name(pd.DataFrame([record("N", "ACGT", "A", 1), record("N", LONG, "A" * 500, 2, file=1)]))
    assert short["nuc"].tolist() == [LONG]
    late = merge.fold_name(pd.DataFrame([record("N", "", "A" * 450, 1), record("N", LONG, "A" * 500, 2)]))
    assert late["nuc"].tolist() == [LONG] and "without nucleotides" in " ".join(late["warnings"][0])


def test_place_gaps():
    master = "".join("ACDEFGHIKLMNPQRSTVWY"[(k * 7 + k // 20) % 20] for k in range(570))
    assert indels.place_gaps(master, master) == []
    assert indels.place_gaps(master, master[:100] + master[102:]) == [(100, 2)]
    assert indels.place_gaps(master, "W" * 570) is None
    assert indels.place_gaps(master, master[:164] + master[165:], "B") == [(162, 1)]
    assert indels.place_gaps(master, master[:163] + master[166:], "B") in ([(161, 3)], [(163, 3)])


def db_rows(spark):
    data = [
        {"name": "A/X/1/2015", "virus_type": "A(H3N2)", "dates": ["2015-02-03"], "country": "C", "continent": "ASIA", "seqs": [{"passages": ["E1"], "nuc": "ACGT", "aa": "QK", "aa_shift": 0, "nuc_shift": 0, "align_status": "aligned", "lab_ids": {"CDC": ["1"]}, "hi_names": ["HI 1"], "clades": ["3C"], "gisaid": ["g"], "annotations": "note"}, {"passages": ["E1"], "nuc": "ACGA", "aa": "", "align_status": "failed"}]},
        {"name": "B/Y/2/2016", "virus_type": "B", "lineage": "VICTORIA", "dates": [], "seqs": [{"passages": [], "aa": "DR", "align_status": "untried"}]},
    ]
    return schema.fill(spark.read.schema(schema.ENTRY).json(spark.sparkContext.parallelize([json.dumps(d) for d in data])), schema.ENTRY)


def test_filters_and_lookups(spark):
    db = SequenceDB(schema.flatten(db_rows(spark)))
    assert db.number_of_entries() == 2 and db.number_of_seqs() == 3
    n = lambda x: x.seqs.count()
    assert n(db.filter_lab("CDC")) == n(db.filter_labid("CDC", "1")) == n(db.filter_clade("3C")) == n(db.filter_hi_name()) == n(db.filter_aligned()) == 1
    assert n(db.filter_date_range("2015-02-03", "2015-02-04")) == 2 and n(db.filter_date_range(end="2015-02-03")) == 1
    assert n(db.filter_date_prefix("2015-02")) == 2 and n(db.filter_name_regex("hi 1")) == 1 and n(db.filter_lab("")) == 3
    with pytest.raises(ValueError):
        db.filter_date_prefix("20")
    ids = spark.createDataFrame([("A/X/1/2015__E1__1",), ("HI 1",), ("A/X/1/2015 E1",), ("none",)], "seq_id string")
    got = {r["seq_id"]: r["seq_no"] for r in db.find_by_seq_id(ids).collect()}
    assert got == {"A/X/1/2015__E1__1": 1, "HI 1": 0, "A/X/1/2015 E1": 0, "none": None}
    with pytest.raises(ValueError):
        lookups.only_one(db.seqs)


def test_match_antigens(spark):
    db = SequenceDB(schema.flatten(db_rows(spark)))
    ags = spark.createDataFrame([(1, "HI 1", "", "x", "E1", "", "A(H3N2)", ""), (2, "none", "HI 1", "x", "E1", "", "A(H3N2)", ""), (3, "none", "", "A/X/1/2015", "", "", "A(H3N2)", ""), (4, "HI 1", "", "x", "", "", "B", ""), (5, "none", "", "B/Y/2/2016", "", "", "B", "YAMAGATA")], "ag_no int, full_name string, alt_name string, name string, passage string, reassortant string, virus_type string, lineage string")
    got = {r["ag_no"]: (r["matched_name"], r["matched_no"]) for r in db.match_antigens(ags).collect()}
    assert got == {1: ("A/X/1/2015", 0), 2: ("A/X/1/2015", 0), 3: ("A/X/1/2015", 1), 4: (None, None), 5: (None, None)}
    c = {r["ag_no"]: r["clades"] for r in merge.antigen_clades(ags, db.match_antigens(ags), db.seqs).collect()}
    assert c[1] == ["3C"] and c[3] == ["SEQUENCED"] and c[5] == []


def test_save_and_open(spark, tmp_path):
    db = SequenceDB(schema.flatten(db_rows(spark)))
    db.save(str(tmp_path / "db"))
    again = SequenceDB.open(spark, str(tmp_path / "db"))
    rows = lambda d: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in d.seqs.collect())
    assert rows(db) == rows(again)


def test_xz_database(spark, tmp_path):
    doc = {"  version": "sequence-database-v2", "data": [{"N": "A/X", "v": "B", "C": "ASIA", "c": "CHINA", "s": [{"a": "QK", "A": "note", "c": ["1A"], "h": ["H"], "l": {"CDC": ["1"]}, "s": 3, "G": {"i": ["x"], "D": ["y"]}}]}]}
    (tmp_path / "db.json.xz").write_bytes(lzma.compress(json.dumps(doc).encode()))
    r = SequenceDB.load(spark, str(tmp_path / "db.json.xz")).seqs.first()
    assert (r["country"], r["continent"], r["aa"], r["annotations"], r["aa_shift"], r["gene"], r["gisaid"], r["align_status"]) == ("CHINA", "ASIA", "QK", "note", 3, "HA", ["x", "y"], "aligned")


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fas"
    path.write_text("; c\n>one\nAC\n\ngt/\n>two\nAA\n")
    rows = fasta.read_fasta(spark, str(path)).orderBy("record_no").collect()
    assert [(r["name"], r["sequence"], r["line_no"]) for r in rows] == [("one", "ACGT-", 2), ("two", "AA", 6)]
    path.write_text(">one\nAC1\n")
    assert "invalid characters" in fasta.read_fasta(spark, str(path), strict=False).first()["error"]
    with pytest.raises(Exception, match="invalid characters"):
        fasta.read_fasta(spark, str(path)).collect()


def test_sinks(spark):
    df = spark.createDataFrame([("a", "ACGTA"), ("bcd", "AC")], "name string, sequence string")
    assert [r["value"] for r in sinks.fasta_lines(df, wrap=2).collect()] == [">a\nAC\nGT\nA", ">bcd\nAC"]
    assert [r["value"] for r in sinks.phylip_lines(df, "name").collect()] == ["2 5", "a    ACGTA", "bcd  AC---"]
    assert [r["value"] for r in sinks.bioseq_lines(df, "name").collect()] == ["001>a", "002>bcd", "001>ACGTA", "002>AC"]
    assert "&middot;" in sinks.alignment_html(df, "ACGTA")


def test_create_pipeline(spark, tmp_path):
    nuc = "GCTACTCTTTGTCTTGGTCATCATGCTGTT" + "GCT" * 400
    (tmp_path / "in.fas").write_text(f">A/X/1/2015 | 2015-03-07 | C1 | 2015123456 | Centers for Disease Control and Prevention\n{nuc}\n>A/X/1/2015 | 2015-03-08 | C2 | 2015123457 | Centers for Disease Control and Prevention\n{nuc[:-3]}\n>short/1/2015\nACGT\n")
    rows = SequenceDB.create(spark, str(tmp_path / "in.fas"), virus_type="").seqs.collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["name"], r["virus_type"], r["aa_shift"], r["passages"], r["dates"]) == ("A(H3N2)/X/1/2015", "A(H3N2)", 10, ["MDCK1", "MDCK2"], ["2015-03-07", "2015-03-08"])


def test_order_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, k int")
    assert sorted(r["name"] for r in ordering.unique_names(df, "name", "k").collect()) == ["a__1", "a__2", "b"]
    s = ordering.sample(df, 2, 7).collect()
    assert len(s) == 2 and s == ordering.sample(df, 2, 7).collect()
    assert filters.select(df).count() == 3


def test_stream(spark, tmp_path):
    from strandsift.streaming import fasta_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fas").write_text(">A/X/1/2015\n" + "GCTACTCTTTGTCTTGGTCATCATGCTGTT" + "GCT" * 400 + "\n")
    q = fasta_stream.ingest(fasta_stream.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = merge.merge(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [r["virus_type"] for r in rows] == ["A(H3N2)"]


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    from strandsift.plans import queries

    bad = compare(spark, queries.QUERIES, queries.ORACLES, "/root/testdata/sf0.001")
    assert not bad, bad



# ---------------------------------------------------------------- FASTA files, bulk functions, exchange
def test_fasta_numbers_of_paths_and_records(spark, tmp_path):
    """Paths that end alike keep their numbers; a file read in many blocks numbers its records and lines as in one."""
    for k, (folder, name) in enumerate([("1", "x.fas"), ("2", "x.fas"), ("1", "ax.fas")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"; comment {k}\n\n" + "".join(f">r{k}.{i}\r\nACGT\r\n; note\r\nAC/T\r\n\r\n" for i in range(300)))
    paths = [str(tmp_path / p) for p in ("1/x.fas", "2/x.fas", "1/ax.fas")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = fasta.read_fasta(spark, paths).orderBy("file_no", "record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["file_no"], r["record_no"], r["line_no"], r["name"], r["sequence"]) for r in rows] == [(k, i + 1, 3 + 5 * i, f"r{k}.{i}", "ACGTAC-T") for k in range(3) for i in range(300)]
    (tmp_path / "bad.fas").write_text("ACGT\n>\nAC\n>only name\n>ok\nAC\n")
    got = {r["line_no"]: (r["name"], (r["error"] or "").rpartition(": ")[2]) for r in fasta.read_fasta(spark, str(tmp_path / "bad.fas"), strict=False).collect()}
    assert got == {1: ("", "no name"), 2: ("", "no name"), 4: ("only name", "no sequence"), 5: ("ok", "")}


def test_bulk_functions(spark):
    from strandsift.functions import sequence

    rows = [("ACGT", "ACCTT"), (None, "A"), ("A", None), ("", ""), ("Aé漢", "Aè字"), ("TARUARTT", "TARUARTT")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sequence.hamming_bulk("a", "b").alias("d"), sequence.translate_frames("a").alias("f")).collect()
    assert [r["d"] for r in got] == [1, None, None, 0, 2, 0]
    assert [r["f"] if r["f"] is None else [x["aa"] for x in r["f"]] for r in got] == [[sequence.translate_text(a, k) for k in range(3)] if a is not None else None for a, _ in rows]
    one = spark.createDataFrame([("QKABCDEF", 2)], "aa string, shift int").select(*(x.alias(f"c{k}") for k, x in enumerate((sequence.residues_from(F.col("aa"), F.col("shift"), 5), sequence.residues_from(F.col("aa"), F.col("shift"), 5, 2), sequence.residues_before(F.col("aa"), F.col("shift"), 5))))).first()
    assert list(one) == ["ABCDEF", "AB", "QK"]


def test_exchange_files(spark, tmp_path):
    """Written, read and written again: the same files but for their date."""
    db = SequenceDB(schema.flatten(db_rows(spark).withColumn("seqs", F.transform("seqs", lambda s: s.withField("gene", F.lit("HA"))))))
    db.export_database(str(tmp_path / "a"))
    again = SequenceDB.load(spark, str(tmp_path / "a"))
    again.export_database(str(tmp_path / "b"))
    read = lambda d: sorted((json.loads(p.read_text()) for p in (tmp_path / d).glob("part-*") if p.stat().st_size), key=lambda x: x["data"][0]["N"])
    a, b = read("a"), read("b")
    for doc in (*a, *b):
        assert doc["  version"] == "sequence-database-v2" and doc.pop("  date")
    assert a == b and [e["N"] for doc in a for e in doc["data"]] == ["A/X/1/2015", "B/Y/2/2016"]
    first = a[0]["data"][0]
    assert (first["C"], first["c"], first["s"][0]["s"], "s" in first["s"][1]) == ("ASIA", "C", 0, False)
    with pytest.raises(Exception, match="(?i)exist"):
        db.export_database(str(tmp_path / "a"))


# ---------------------------------------------------------------- insertions, matching
def switching(rows):
    """The definition, row by row: gaps of each row, with the master that is left when no row takes over."""
    rows = sorted(rows)
    normal = [s for k, _, s in rows if len(s) == indels.NORMAL_LENGTH.get(k, 0)]
    master, fixed, gone = (normal or [rows[0][2]])[0], bool(normal), set()
    while not fixed:
        fixed = True
        for k, _, s in rows:
            if s != master and s not in gone and len(s) > round(len(master) * 0.9) and indels.place_gaps(master, s, k) is None and indels.place_gaps(s, master, k) is not None:
                gone.add(master)
                master, fixed = s, False
                break
    return {n: [(p, m) for p, m in indels.place_gaps(master, s, k) or []] for k, n, s in rows}


def test_indels_of_all_types(spark):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    base = "".join(letters[(k * 7 + k // 20) % 20] for k in range(570))
    other = "".join(letters[(k * 11 + k // 7 + 3) % 20] for k in range(500))
    rows = [("A(H3N2)", "a", base[:550]), ("A(H3N2)", "b", base[:99] + base[102:550]), ("A(H3N2)", "c", "W" * 300)]
    rows += [("X", "d", "W" * 20 + other[60:400]), ("X", "e", other[:480]), ("X", "f", other[:200] + other[203:480]), ("X", "g", other[:90] + other[91:])]
    df = spark.createDataFrame([(k, n, 0, s, "aligned") for k, n, s in rows] + [("X", "z", 0, "", "failed")], "virus_type string, name string, seq_no int, aligned_aa string, align_status string")
    got = {r["name"]: [(g["pos"], g["n"]) for g in r["gaps"]] for r in indels.detect(df).collect()}
    want = {}
    for kind in ("A(H3N2)", "X"):
        want |= switching([r for r in rows if r[0] == kind])
    assert got == want | {"z": []} and got["b"] == [(99, 3)]
    moved = indels.apply(df.withColumns({"gaps": F.when(F.col("name") == "b", F.expr("array(named_struct('pos', 99, 'n', 3))")).otherwise(F.expr("cast(array() as array<struct<pos:int,n:int>>)")), "aa": F.col("aligned_aa"), "nuc": F.lit(""), "aa_shift": F.lit(0)})).where("name = 'b'").first()
    assert moved["aa"] == base[:99] + "---" + base[102:550]


def test_antigens_of_entries(spark):
    seqs = spark.createDataFrame([("N", 0, ["E3"], []), ("N", 1, ["MDCK2"], []), ("N", 2, ["MDCK1"], []), ("N", 3, ["E3"], ["R1"])], "name string, seq_no int, passages array<string>, reassortants array<string>")
    ags = spark.createDataFrame([("N", "f1", "MDCK2", ""), ("N", "f2", "E2", ""), ("N", "f3", "E3", "R1"), ("N", "f4", "MDCK1", ""), ("M", "f5", "E1", "")], "name string, full_name string, passage string, reassortant string")
    best = {r["full_name"]: (r["seq_no"], r["score"]) for r in lookups.best_by_antigen(seqs, ags).collect()}
    assert best == {"f1": (1, 100), "f2": (0, 1), "f3": (3, 100), "f4": (2, 100)}
    pairs = spark.createDataFrame([("N", 0, "a", 90), ("N", 0, "b", 90), ("N", 0, "c", 50), ("N", 1, "b", 95), ("N", 1, "d", 60), ("P", 0, "a", 7), ("P", 0, "b", 5)], "name string, seq_no int, full_name string, score int")
    got = sorted((r["name"], r["seq_no"], r["full_name"]) for r in lookups.assign_antigens(pairs).collect())
    assert got == [("N", 0, "a"), ("N", 1, "b"), ("P", 0, "a")]


def test_match_hidb(spark):
    db = SequenceDB(schema.flatten(db_rows(spark)))
    hi = spark.createDataFrame([("HI full", "A/X/1/2015", "E1", "", ["9"], "", "2015-09-09"), ("B full", "B/Y/2/2016", "", "", [], "YAMAGATA", "2016-01-01")], "full_name string, name string, passage string, reassortant string, hi_ids array<string>, lineage string, date string")
    rows = {(r["name"], r["seq_no"]): r for r in db.match_hidb(hi).seqs.collect()}
    assert rows["A/X/1/2015", 0]["hi_names"] == ["HI full"] and rows["A/X/1/2015", 0]["dates"] == ["2015-02-03", "2015-09-09"]
    assert rows["B/Y/2/2016", 0]["lineage"] == "VICTORIA" and rows["B/Y/2/2016", 0]["dates"] == ["2016-01-01"]
    names = spark.createDataFrame([("A/B/C/7/2009",), ("A/B/7/2009",), ("x",)], "n string")
    assert [r[0] for r in names.select(lookups.fallback_name(F.col("n"))).collect()] == ["A/B/C-7/2009", "A/B/7/2009", "x"]


def test_many_rows_make_no_page(spark):
    with pytest.raises(ValueError):
        sinks.alignment_html(spark.createDataFrame([("a", "AC"), ("b", "AC")], "name string, sequence string"), "AC", rows=1)


def test_matched_antigens_and_backup(spark, tmp_path):
    db = SequenceDB(schema.flatten(db_rows(spark)))
    ags = spark.createDataFrame([(1, "HI 1", "", "x", "E1", "", "A(H3N2)", ""), (2, "none", "", "x", "E1", "", "A(H3N2)", "")], "ag_no int, full_name string, alt_name string, name string, passage string, reassortant string, virus_type string, lineage string")
    got = {r["ag_no"]: (r["seq_id"], r["sequence"]) for r in db.antigen_sequences(ags).collect()}
    assert got == {1: ("A/X/1/2015__E1", "ACGT"), 2: (None, None)}
    layout = spark.createDataFrame([(1, [0.5, 2.0]), (2, [1.0, 1.0])], "ag_no int, coordinates array<double>")
    sinks.write_csv(db.antigen_layout(ags, layout), str(tmp_path / "csv"), "coordinates")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert [(r["full_name"], r["sequence"], r["coord_0"], r["coord_1"]) for r in rows] == [("HI 1", "QK", "0.5", "2.0")]
    sinks.write_fasta(db.antigen_fasta(ags), str(tmp_path / "fas"), "ag_no")
    assert [r["name"] for r in fasta.read_fasta(spark, str(tmp_path / "fas")).collect()] == ["HI 1"]
    db.save(str(tmp_path / "db"))
    db.save(str(tmp_path / "db"), mode="backup")
    assert sum(p.name.startswith("db") for p in tmp_path.iterdir()) == 2
    hi = spark.createDataFrame([("B full", "B/Y/2/2016", "", "", [])], "full_name string, name string, passage string, reassortant string, hi_ids array<string>")
    where = spark.createDataFrame([("Y", "YLAND", "EUROPE"), ("X", "XLAND", "ASIA")], "location string, country string, continent string")
    assert {r["name"]: r["country"] for r in db.match_hidb(hi, where).seqs.collect()} == {"A/X/1/2015": "C", "B/Y/2/2016": "YLAND"}


def test_clades_kept_by_all(spark):
    rows = spark.createDataFrame([("N", 0, ["a", "b"]), ("N", 1, ["b", "c"]), ("M", 0, ["a"]), ("M", 1, [])], "name string, seq_no int, clades array<string>")
    from strandsift.operators import aggregates

    got = {r["name"]: r["clades"] for r in aggregates.clades_of_names(rows, False).collect()}
    assert got == {"N": ["b"], "M": []} and aggregates.clades_of_name(rows, "N", True).first()["clades"] == ["a", "b", "c"]
