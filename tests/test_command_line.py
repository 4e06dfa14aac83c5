"""The command line and the export verbs over a small database."""

import pytest
from pyspark.sql import functions as F

from strandsift.__main__ import main
from strandsift.functions.sequence import CODONS
from strandsift.plans.database import SequenceDB

MOTIF = "".join(next(c for c, a in CODONS.items() if a == x) for x in "QKIPGNDNSTATLCLGHHAVPNGTIVKTI")
BODY = "GCTGGTTCA" * 140
NAMES = ("A/LYON/1/2015", "A/PARIS/2/2016", "A/ROME/3/2017", "A/OSLO/4/2018")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    bodies = (BODY, BODY[:-3] + "GCA", BODY[:-39] + "TTT" * 13, "C" * len(BODY))
    (at / "a.fas").write_text("".join(f">{n} | 201{5 + k}-02-0{k + 1} | E{k} | {k} | CDC\n{MOTIF}{b}\n" for k, (n, b) in enumerate(zip(NAMES, bodies, strict=True))))
    main(["create", str(at / "a.fas"), "--db", str(at / "db"), "--report-all-passages"], spark)
    return at


def typed(name):
    return name.replace("A/", "A(H3N2)/", 1)


def test_list(spark, folder, capsys):
    main(["list", "--db", str(folder / "db"), "--all"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[0].split() == ["Entries:", "4", "Seqs:", "4"] and out[1:] == sorted(f"{typed(n)}__E{k}" for k, n in enumerate(NAMES))
    main(["list", "--db", str(folder / "db"), "--flu", "h3", "--start-date", "2016", "--end-date", "2018"], spark)
    out = capsys.readouterr().out
    assert "2 sequences listed" in out and "PARIS" in out and "OSLO" not in out
    main(["list", "--db", str(folder / "db"), "--name", "A/NONE"], spark)
    main(["list", "--db", str(folder / "db"), "--seq-id", f"{typed(NAMES[1])}__E1"], spark)
    assert capsys.readouterr().out.splitlines() == ["NOT FOUND: A/NONE", f"{typed(NAMES[1])} 0"]


def test_identical_sequences_are_listed(spark, tmp_path, capsys):
    (tmp_path / "a.fas").write_text("".join(f">{n} | 2015-02-01 | E{k} | {k} | CDC\n{MOTIF}{BODY[:-1] + 'AC'[k == 2]}\n" for k, n in enumerate(NAMES)))
    main(["create", str(tmp_path / "a.fas"), "--no-save", "--report-identical", "--db", str(tmp_path / "db")], spark)
    out = capsys.readouterr().out.splitlines()
    cut = out.index("Identical amino-acids:")
    said = [sorted((x.split()[0], x.split()[2]) for x in part) for part in (out[1:cut], out[cut + 1 :])]
    assert out[0] == "Identical nucleotides:" and said[0] == sorted(("3", f"{typed(NAMES[k])}__E{k}") for k in (0, 1, 3))
    assert said[1] == sorted(("4", f"{typed(n)}__E{k}") for k, n in enumerate(NAMES)) and len({x.split()[1] for x in out[cut + 1 :]}) == 1


def test_export(spark, folder):
    read = lambda d: spark.read.text(str(folder / d)).where("value LIKE '>%'").collect()
    main(["export", "--db", str(folder / "db"), str(folder / "x"), "--start-date", "2016", "--base-seq", "lyon", "--include", "PARIS", "--include", "LYON", "--recent", "2", "--sort", "name", "--name-format", "{name}"], spark)
    names = [r["value"][1:] for r in read("x")]
    assert names == [typed(NAMES[k]) for k in (0, 3, 2, 1)]  # base, the two latest by name, what is included and not yet there
    main(["export", "--db", str(folder / "db"), str(folder / "y"), "--base-seq", "LYON", "--tree-maker"], spark)
    assert sorted(r["value"] for r in read("y")) == sorted(f">A%28H3N2%29{n[1:].replace('/', '%2F')}__E{k}" for k, n in enumerate(NAMES[:3]))
    with pytest.raises(ValueError, match="several"):
        main(["export", "--db", str(folder / "db"), str(folder / "z"), "--base-seq", "A"], spark)


def test_tree(spark, folder):
    db = SequenceDB.open(spark, str(folder / "db"))
    rows = db.export_tree("H3", "LYON", recent=10).collect()
    assert [(r["part"], r["name"].split("%2F")[1]) for r in rows] == [(0, "LYON"), (1, "ROME"), (1, "PARIS")]  # Oslo is too far
    assert {len(r["nuc"]) for r in rows} == {3 * len(rows[0]["aa"])} and rows[1]["nuc"].endswith(BODY[:-39] + "-" * 39) and rows[1]["aa"].endswith("AGSAG" + "X" * 13) and rows[2]["aa"].endswith("AGA")
    assert len(db.export_tree("H3", "LYON", recent=1).collect()) == 2
    near = db.export(template="{name}", common_length=True)
    far = SequenceDB.report_hamming(near, typed(NAMES[0])).collect()
    assert [r["name"] for r in far][:2] == [typed(NAMES[3]), typed(NAMES[2])] and far[-1]["distance"] == 1
    assert db.report_identical().select(F.col("n")).collect() == []
    for code in ("H5", "B", ""):
        with pytest.raises(ValueError, match="flu"):
            db.export_tree(code, "LYON")
