"""Column functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from strandsift.functions import align, clades, derived, sequence, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_codons_all_known(spark):
    assert len(sequence.CODONS) == 105
    nuc = "ATGTTTTAATARNNNAT"
    assert sequence.translate_text(nuc) == "MF**XX"
    assert one(spark, sequence.translate(F.lit(nuc)))[0] == "MF**XX"
    assert one(spark, sequence.translate(F.lit("AUGUUU"), 1))[0] == sequence.translate_text("AUGUUU", 1) == "CX"
    assert one(spark, sequence.translate(F.lit("")))[0] == ""


@pytest.mark.parametrize(("shift", "want"), [(-2, "CD"), (0, "ABCD"), (3, "XXXABCD"), (-9, "")])
def test_shifts(spark, shift, want):
    assert one(spark, sequence.left_shift(F.lit("ABCD"), F.lit(shift), "X"))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("AB*CDE*F", "XXXCDE"), ("AB*CD", "AB"), ("ABC", "ABC"), ("*A", "XA"), ("", "")])
def test_longest_open_part(spark, raw, want):
    assert one(spark, sequence.longest_open_part(F.lit(raw)))[0] == want


def test_residue_at_bounds(spark):
    at = lambda p, s: one(spark, sequence.residue_at(F.lit("ABC"), F.lit(s), p))[0]
    assert (at(1, 0), at(3, 0), at(4, 0), at(0, 0), at(3, 2), at(2, 2), at(1, -1)) == ("A", "C", "?", "?", "A", "?", "B")
    assert one(spark, sequence.aa_at(F.lit("ABC"), F.lit(0), 9))[0] == " "


def test_hamming_twins(spark):
    rows = [("ABCD", "ABXD", 1), ("", "ABC", 0), ("AB", "ABCD", 0), ("AAAA", "BBBB", 4)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    got = df.select(sequence.hamming(F.col("a"), F.col("b")).alias("x"), sequence.hamming_bulk("a", "b").alias("y"), "n").collect()
    assert all(r["x"] == r["y"] == r["n"] for r in got)


def test_gaps_and_master(spark):
    gaps = F.array(F.struct(F.lit(1).alias("pos"), F.lit(2).alias("n")), F.struct(F.lit(99).alias("pos"), F.lit(1).alias("n")))
    assert one(spark, sequence.insert_gaps(F.lit("ABC"), gaps))[0] == "A--BC-"
    assert one(spark, sequence.against_master(F.lit("ABC"), F.lit("AXC")))[0] == "·B·"
    base = "ACG" * 20
    bad = base[:-12] + "T" * 12
    assert one(spark, sequence.mask_damaged_end(F.lit(bad), F.lit(base)))[0].endswith("-")
    assert one(spark, sequence.mask_damaged_end(F.lit(base), F.lit(base)))[0] == base


def test_dates_and_passages(spark):
    d = lambda x: one(spark, text.date(F.lit(x)))[0]
    assert (d("2015"), d("201503"), d("2015-03-07"), d("")) == ("2015-01-01", "2015-03-01", "2015-03-07", "")
    with pytest.raises(Exception, match="Invalid date"):
        d("15/3")
    p = lambda x: one(spark, text.passage(F.lit(x)))[0]
    assert (p("ORIGINAL (swab)".replace(" (", "(")), p("C2/S3"), p("CX"), p("EX , M1"), p("MDCK1")) == ("OR", "MDCK2/SIAT3", "MDCK?", "E?/MK1", "MDCK1")


def test_names(spark):
    f = lambda x: one(spark, text.fix_name(F.lit(x)))[0]
    assert f("A/EGYPT/1323/2016 (96)") == "A/EGYPT/1323/2016" and f("B/BELGIUM/G668/2014 (VS0246)") == "B/BELGIUM/G668/2014"
    assert f("A/WUHAN/395/95_LIKE") == "A/WUHAN/395/95" and f("NYMC X-181") == "A/CALIFORNIA/7/2009 NYMC-181"
    r = one(spark, text.split_reassortant(F.lit("A/TEXAS/50/2012 NYMC X-223")).alias("r"))["r"]
    assert r["name"] == "A/TEXAS/50/2012 NYMC X-223" or r["reassortant"]
    r = one(spark, text.split_reassortant(F.lit("A/TEXAS/50/2012 X-223")).alias("r"))["r"]
    assert (r["name"], r["reassortant"]) == ("A/TEXAS/50/2012", "X-223")
    assert one(spark, text.reassortant(F.lit("X-181A")))[0] == "NYMC-181A"
    with pytest.raises(Exception, match="Unrecognized lab"):
        one(spark, text.lab(F.lit("NOWHERE")))
    r = one(spark, text.flu_code(F.lit("BVic")).alias("r"))["r"]
    assert (r["virus_type"], r["lineage"]) == ("B", "VICTORIA")


HEADERS = [
    ("A/X/1/2015 | 2015-03-07 | C1 | 2015123456_v1 | Centers for Disease Control and Prevention | A / H3N2 | ", {"name": "A/X/1/2015", "date": "2015-03-07", "lab": "CDC", "virus_type": "A(H3N2)"}),
    ("A/X/1/2015 | 2015-03 (day unknown) | C1 | id | Crick Worldwide Influenza Centre", {"date": "2015-03-01", "lab": "NIMR", "lab_id": "id"}),
    ("A/X/1/2015 | 2015 (month and day unknown) | C1 | id | x/y", {"date": "2015-01-01", "passage": "C1"}),
    ("A/X/1/2015 | 2015-03-07 |  | id", {"date": "2015-03-07", "lab_id": "id"}),
    ("EPI123 | HA | A/X/1/2015 | EPI_ISL_1 | C1 | B", {"name": "EPI_ISL_1", "gene": "HA"}),
    ("a/x/1 PileUp of", {"name": "A/X/1"}),
    ("A/X/1/2015 | C1 | 2015123456", {"name": "2015123456", "passage": "C1"}),
    ("A/X/1/2015 | C1 | other", {"name": "A/X/1/2015", "passage": "C1", "lab_id": "other"}),
    ("a/x/1/2015  01/02/2015  C1", {"name": "A/X/1/2015", "date": "01/02/2015", "passage": "C1"}),
    ('12S34 "Contig 1" (1,900)', {"name": "12S34"}),
    ("a/x/1/2015 n:E3", {"name": "A/X/1/2015", "passage": "E3"}),
    ("a/x/1/2015_Mar", {"name": "A/X/1/2015"}),
    ("abc_4", {"name": "ABC_4"}),
    ("a/x/12_rest", {"name": "A/X/12"}),
    ("a/x/1/2015E3", {"name": "A/X/1/2015", "passage": "E3"}),
    ("plain", {"name": "plain"}),
]


@pytest.mark.parametrize(("header", "want"), HEADERS)
def test_header_shapes(spark, header, want):
    got = one(spark, text.parse_header(F.lit(header)).alias("h"))["h"].asDict()
    assert {k: got[k].strip() for k in want} == want


def test_derived(spark):
    rows = spark.createDataFrame([("A/X", ["E1", "E2"], {"B": ["2"], "A": ["1", "9"]}, [], ["2015-01-01", "2014"]), ("A/Y", [], {}, ["H"], [])], "name string, passages array<string>, lab_ids map<string,array<string>>, hi array<string>, dates array<string>")
    got = rows.select(
        derived.lab(F.col("lab_ids")).alias("lab"), derived.lab_id(F.col("lab_ids")).alias("id"), derived.all_lab_ids(F.col("lab_ids")).alias("all"), derived.latest_date(F.col("dates")).alias("date"),
        derived.seq_id(F.col("name"), F.col("passages")).alias("sid"), derived.make_name(F.col("name"), F.col("passages"), F.col("hi")).alias("made"),
    ).collect()
    assert got[0].asDict() == {"lab": "A", "id": "1", "all": ["A#1", "A#9", "B#2"], "date": "2015-01-01", "sid": "A/X__E1", "made": "A/X E1"}
    assert got[1].asDict() == {"lab": "", "id": "", "all": [], "date": "", "sid": "A/Y__", "made": "H"}


def protein(**at):
    s = ["A"] * 520
    for k, v in at.items():
        s[int(k[1:]) - 1] = v
    return "".join(s)


def test_clades(spark):
    def of(f, aa, shift=0):
        return one(spark, f(F.lit(aa), F.lit(shift)))[0]

    assert of(clades.h3, protein(p158="N", p159="Y")) == ["2A", "159Y"]
    assert of(clades.h3, protein(p158="N", p159="F")[:158]) == []
    assert of(clades.h1, protein(p163="Q", p162="N", p152="T")) == ["6B", "6B1", "6B2"]
    assert of(clades.b_victoria, protein(p75="K", p172="P")) == ["1A"]
    assert of(clades.b_victoria, protein(p58="P")) == ["1B"]
    assert of(clades.b_victoria, protein(p162="-", p163="-", p164="-")) == ["1", "TRIPLEDEL2017"]
    assert of(clades.b_victoria, protein(p162="-", p163="-")) == ["1", "DEL2017"]
    assert of(clades.b_yamagata, protein(p166="N")) == ["Y2"] and of(clades.b_yamagata, protein(p166="Y")) == ["Y3"]
    assert of(clades.b_lineage, protein(p163="-")) == "YAMAGATA" and of(clades.b_lineage, protein(p162="-", p163="-")) == "VICTORIA"
    assert of(clades.b_lineage, "AAAA") is None


def test_alignment():
    assert align.align_text("GG" + "ATLCLGHHAV" + "A" * 50)["aa_shift"] == 8
    assert align.align_text("MKTIIALSYILCLVFA" + "QKLPG")["aa_shift"] == -16
    assert align.align_text("AAAA") is None
    nuc = "TGC" * 2 + "GCTACTCTTTGTCTTGGTCATCATGCTGTT" + "GCT" * 400
    got = align.translate_and_align_text(nuc)
    assert got["status"] == "aligned" and got["aa_shift"] == 8 and got["frame"] == 0
    assert align.translate_and_align_text("C" + nuc)["frame"] == 1
    assert align.translate_and_align_text(nuc[:1199])["status"] == "failed"
    behind = align.translate_and_align_text("TAA" + nuc)
    assert behind["aa_shift"] == 7
