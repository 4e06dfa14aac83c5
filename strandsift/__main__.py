"""Command line: ``python -m strandsift create | list | export``. Databases are the folders that ``SequenceDB.save`` writes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import derived, text
from .plans.database import SequenceDB
from .runtime import ship
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandsift", description="Annotated virus-sequence collections on Spark.")
    verbs = out.add_subparsers(dest="verb", required=True)
    create = verbs.add_parser("create", help="a database from FASTA files")
    create.add_argument("input", nargs="+")
    create.add_argument("--db", required=True)
    create.add_argument("--no-save", action="store_true")
    create.add_argument("--lab", default="")
    create.add_argument("--flu", default="", help="virus type of records that do not say theirs")
    create.add_argument("--lineage", default="")
    create.add_argument("--hidb", help="Parquet table of laboratory antigens to match names with")
    create.add_argument("--report-identical", action="store_true")
    create.add_argument("--report-not-aligned-prefixes", type=int, metavar="N")
    create.add_argument("--report-all-passages", action="store_true")
    listing = verbs.add_parser("list", help="sequences and reports of a database")
    listing.add_argument("--all", action="store_true")
    listing.add_argument("--re", help="expression for names")
    listing.add_argument("--name")
    listing.add_argument("--seq-id")
    listing.add_argument("--report", action="store_true")
    export = verbs.add_parser("export", help="sequences of a database as FASTA or PHYLIP")
    export.add_argument("output")
    for sub in (listing, export):
        sub.add_argument("--db", required=True)
        for name in ("--lab", "--flu", "--lineage", "--start-date", "--end-date"):
            sub.add_argument(name, default="")
    for name in ("--continent", "--country", "--gene", "--clade", "--name-match"):
        export.add_argument(name, default="")
    export.add_argument("--with-hi-name", action="store_true")
    for name in ("--random", "--recent", "--hamming-distance-threshold"):
        export.add_argument(name, type=int, default=0)
    export.add_argument("--most-common-length", action="store_true")
    export.add_argument("--base-seq", help="expression for the name of one sequence")
    export.add_argument("--include", action="append", default=[], help="expression for names of more sequences")
    export.add_argument("--sort", default="date", choices=("date", "name"))
    export.add_argument("--format", default="fasta", choices=("fasta", "phylip"))
    export.add_argument("--name-format", default="{hi_name_or_seq_name_with_passage}")
    export.add_argument("--name-encode", action="store_true")
    export.add_argument("--amino-acids", action="store_true")
    export.add_argument("--no-wrap", action="store_true")
    export.add_argument("--tree-maker", action="store_true", help="common length, names by id, encoded, within 140 of the base")
    return out


def _selected(db: SequenceDB, spark: SparkSession, a: argparse.Namespace) -> SequenceDB:
    kind = spark.range(1).select(text.virus_type(F.lit(a.flu))).first()[0] if a.flu else ""
    dates = {k: spark.range(1).select(text.date(F.lit(v))).first()[0] for k, v in (("begin", a.start_date), ("end", a.end_date))}
    return db.filter(lab=a.lab.upper(), virus_type=kind, lineage=a.lineage.upper(), **dates)


def _said(rows: DataFrame) -> None:
    """Lines (column value) to the screen, partition by partition."""
    for r in rows.toLocalIterator():
        print(r["value"])


def create(spark: SparkSession, a: argparse.Namespace) -> None:
    kind = spark.range(1).select(text.virus_type(F.lit(a.flu))).first()[0] if a.flu else ""
    db = SequenceDB.create(spark, a.input, a.lab.upper(), kind, a.lineage.upper()).cleanup()
    if a.hidb:
        db = db.match_hidb(spark.read.parquet(a.hidb))
    if not a.no_save:
        db.save(a.db, mode="backup")
        db = SequenceDB.open(spark, a.db)
    if a.report_identical:
        for column, title in (("nuc", "Identical nucleotides:"), ("aa", "Identical amino-acids:")):
            print(title)
            _said(db.report_identical(column).orderBy("key", "item").select(F.concat_ws(" ", F.col("n").cast("string"), F.substring(F.sha2("key", 256), 1, 12), "item").alias("value")))
    if a.report_not_aligned_prefixes:
        _said(db.report_not_aligned(a.report_not_aligned_prefixes).select(F.col("prefix").alias("value")))
    if a.report_all_passages:
        _said(db.all_passages().select(F.col("item").alias("value")))


def listing(spark: SparkSession, a: argparse.Namespace) -> None:
    db = SequenceDB.open(spark, a.db)
    own = derived.seq_id(F.col("name"), F.col("passages"))
    full = F.concat_ws("\n", derived.make_name(F.col("name"), F.col("passages"), F.col("hi_names")), F.concat(F.lit("  Seq_id: "), own), F.transform("hi_names", lambda h: F.concat(F.lit("    "), h)))
    if a.report:
        _said(db.report().orderBy("virus_type").select(F.to_json(F.struct("*")).alias("value")))
    elif a.all:
        print("Entries:", db.number_of_entries(), " Seqs:", db.number_of_seqs())
        _said(db.seqs.orderBy("name", "seq_no").select(own.alias("value")))
    elif a.re:
        _said(db.filter_name_regex(a.re).seqs.orderBy("name", "seq_no").select(full.alias("value")))
    elif a.name:
        found = db.find_by_name(a.name)
        _said(found.orderBy("seq_no").select(own.alias("value")))
        if found.isEmpty():
            print("NOT FOUND:", a.name)
    elif a.seq_id:
        _said(db.find_by_seq_id(spark.createDataFrame([(a.seq_id,)], "seq_id string")).select(F.coalesce(F.concat_ws(" ", "name", F.col("seq_no").cast("string")), F.lit("NOT FOUND")).alias("value")))
    else:
        rows = _selected(db, spark, a).seqs
        _said(rows.orderBy("name", "seq_no").select(full.alias("value")))
        print(rows.count(), "sequences listed")


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.tree_maker:
        a.most_common_length, a.name_format, a.hamming_distance_threshold, a.name_encode = True, "{seq_id}", 140, True
    db = SequenceDB.open(spark, a.db)
    chosen = _selected(db, spark, a).filter(continent=a.continent.upper(), country=a.country.upper(), gene=a.gene.upper(), clade=a.clade, hi_name=a.with_hi_name, name_regex=a.name_match, aligned=True)
    rows = chosen.export(
        amino_acids=a.amino_acids, template=a.name_format, recent=a.recent, random=a.random, base=a.base_seq, include=a.include, hamming=a.hamming_distance_threshold, common_length=a.most_common_length,
        sort=a.sort, source=db,
    )
    if a.format == "phylip":
        sinks.phylip_lines(rows, "date", "name").select("value").write.text(a.output)
    else:
        sinks.write_fasta(rows, a.output, wrap=0 if a.no_wrap else 60, encode=a.name_encode)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName("strandsift").getOrCreate())
    {"create": create, "list": listing, "export": export}[a.verb](spark, a)


if __name__ == "__main__":
    main()
