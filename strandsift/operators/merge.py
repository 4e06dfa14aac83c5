"""Ingest: folding records of one name into an entry, clean-up, warnings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align, text
from ..functions.derived import MINIMUM_AA, MINIMUM_NUC
from ..functions.sequence import is_nucleotides

RECORD = "name string, virus_type string, lineage string, gene string, date string, lab string, lab_id string, passage string, reassortant string, nuc string, aa string, nuc_shift int, aa_shift int, align_status string, warning string, file_no int, record_no long"
MERGED = (
    "name string, virus_type string, lineage string, country string, continent string, dates array<string>, seq_no int, passages array<string>, nuc string, aa string, nuc_shift int, aa_shift int,"
    " align_status string, lab_ids map<string,array<string>>, gene string, hi_names array<string>, annotations string, reassortants array<string>, clades array<string>, gisaid array<string>, warnings array<string>"
)


def normalize_records(records: DataFrame) -> DataFrame:
    """Names, passages, reassortants and dates of parsed records in their accepted spelling."""
    name = text.split_reassortant(text.fix_name(F.upper("name")))
    return records.withColumns({
        "_n": name, "passage": text.strip_passage_prefix(text.passage(F.upper(F.coalesce("passage", F.lit(""))))), "date": text.date(F.coalesce("date", F.lit(""))),
    }).withColumns({
        "name": F.col("_n.name"), "reassortant": text.reassortant(F.coalesce(F.nullif(F.col("reassortant"), F.lit("")), F.col("_n.reassortant"))),
    }).drop("_n")


def align_records(records: DataFrame) -> DataFrame:
    """Translate and align each record's sequence; what the motif says fills virus type, lineage and gene."""
    nuc = is_nucleotides(F.col("sequence"))
    a = F.when(nuc, align.translate_and_align(F.when(nuc, F.col("sequence")))).otherwise(align.align(F.when(~nuc, F.col("sequence"))))  # both functions see every row
    rows = records.withColumn("_a", a)
    plain = ~F.col("_a.subtype").startswith("*") & (F.col("_a.subtype") != "")
    kind = F.when((F.col("virus_type") == "") & plain, F.col("_a.subtype")).otherwise(F.col("virus_type"))
    return rows.select(
        F.when(plain, text.fix_subtype(F.col("name"), kind)).otherwise(F.col("name")).alias("name"), kind.alias("virus_type"),
        F.when(F.col("lineage") == "", F.col("_a.lineage")).otherwise(F.col("lineage")).alias("lineage"), F.coalesce(F.nullif(F.col("_a.gene"), F.lit("")), F.nullif(F.col("gene"), F.lit("")), F.lit("HA")).alias("gene"),
        "date", "lab", "lab_id", "passage", "reassortant", F.when(nuc, F.col("sequence")).otherwise("").alias("nuc"), F.coalesce("_a.aa", F.lit("")).alias("aa"),
        F.when(nuc, align.nuc_shift(F.col("_a.aa_shift"), F.col("_a.frame"))).cast("int").alias("nuc_shift"), F.col("_a.aa_shift").alias("aa_shift"), F.col("_a.status").alias("align_status"), F.col("_a.warning").alias("warning"), "file_no", "record_no",
    )


def _short(r) -> bool:
    return len(r["nuc"]) < MINIMUM_NUC if not r["aa"] else len(r["aa"]) < MINIMUM_AA


_MERGED_NAMES = [
    "name", "virus_type", "lineage", "country", "continent", "dates", "seq_no", "passages", "nuc", "aa", "nuc_shift", "aa_shift", "align_status", "lab_ids", "gene",
    "hi_names", "annotations", "reassortants", "clades", "gisaid", "warnings",
]


class Fold:
    """The entry of one name, record by record in arrival order. A record joins the first sequence that equals, holds or is held by its own;
    the longer one is kept. After each file short and untranslated sequences go. Only the sequences are held, not the records."""

    def __init__(self, name: str | None):
        self.name, self.file, self.seqs, self.dates, self.warnings = name, None, [], set(), []
        self.known = {"virus_type": "", "lineage": ""}

    def add(self, r: dict) -> None:
        if r["file_no"] != self.file:
            self._end_of_file()
            self.file = r["file_no"]
        for field, value in self.known.items():
            if r[field] and value and r[field] != value:
                self.warnings.append(f"{field} {r[field]} against {value}")
            self.known[field] = value or r[field]
        if r["date"]:
            self.dates.add(r["date"])
        if r["warning"]:
            self.warnings.append(r["warning"])
        key = "nuc" if r["nuc"] else "aa"
        own = next((s for s in self.seqs if r[key] in s[key] or s[key] in r[key]), None)
        if own is None:
            own = {c: r[c] for c in ("nuc", "aa", "nuc_shift", "aa_shift", "align_status", "gene")} | {"passages": [], "reassortants": [], "lab_ids": {}}
            self.seqs.append(own)
        elif r[key] not in own[key]:
            if key == "nuc" and not own["nuc"]:
                self.warnings.append("a sequence without nucleotides is replaced")
            own.update({c: r[c] for c in ("nuc", "aa", "nuc_shift", "aa_shift", "align_status")})
        if r["gene"] and own["gene"] != r["gene"]:
            self.warnings.append(f"gene {r['gene']} against {own['gene']}")
        for field, value in (("passages", r["passage"]), ("reassortants", r["reassortant"])):
            if value and value not in own[field]:
                own[field].append(value)
        if r["lab"]:
            ids = own["lab_ids"].setdefault(r["lab"], [])
            if r["lab_id"] and r["lab_id"] not in ids:
                ids.append(r["lab_id"])

    def _end_of_file(self) -> None:
        self.seqs = [s for s in self.seqs if s["aa"] and not _short(s)]

    def rows(self) -> list[list]:
        """What ``MERGED`` says of each sequence."""
        self._end_of_file()
        whole = lambda v: None if v is None or v != v else int(v)
        return [
            [self.name, self.known["virus_type"], self.known["lineage"], "", "", sorted(self.dates), k, s["passages"], s["nuc"], s["aa"], whole(s["nuc_shift"]), whole(s["aa_shift"]), s["align_status"], s["lab_ids"], s["gene"], [], "", s["reassortants"], [], [], self.warnings]
            for k, s in enumerate(self.seqs)
        ]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_MERGED_NAMES).astype({"nuc_shift": "Int64", "aa_shift": "Int64"})


def fold_name(part: pd.DataFrame) -> pd.DataFrame:
    """The entry of the records of one name, in any order."""
    part = part.sort_values(["file_no", "record_no"])
    fold = Fold(part["name"].iloc[0])
    for r in part.to_dict("records"):
        fold.add(r)
    return _frame(fold.rows())


def _fold_sorted(batches, most: int = 2000):
    """Records by name, file and number to sequences; a name may go over from batch to batch, and results leave by ``most`` rows or so."""
    fold, out = None, []
    for batch in batches:
        for r in batch.to_dict("records"):
            if fold is None or r["name"] != fold.name:
                out += fold.rows() if fold else []
                fold = Fold(r["name"])
                if len(out) >= most:
                    yield _frame(out)
                    out = []
            fold.add(r)
    out += fold.rows() if fold else []
    if out:
        yield _frame(out)


def merge(records: DataFrame) -> DataFrame:
    """The flattened view of all entries. The only shuffle is by name; Spark sorts each partition (and spills), so a name of any number of
    records is read as a stream and only its sequences are in memory."""
    columns = [c.split()[0] for c in RECORD.split(", ")]
    return records.select(*columns).repartition("name").sortWithinPartitions("name", "file_no", "record_no").mapInPandas(_fold_sorted, MERGED)


def not_aligned(records: DataFrame) -> DataFrame:
    """Records without alignment that are long enough to have one."""
    long = (F.length("aa") > MINIMUM_AA) | (F.length("nuc") > 3 * MINIMUM_AA)
    return records.where((F.col("align_status") != "aligned") & long).select("virus_type", F.concat_ws(" ", "name", "passage").alias("name"), "nuc", "aa", "file_no", "record_no")


def remove_hi_names(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("hi_names", F.array().cast("array<string>"))


def antigen_clades(antigens: DataFrame, matches: DataFrame, seqs: DataFrame) -> DataFrame:
    """Each antigen with its clades; SEQUENCED where it has a sequence but no clade."""
    s = seqs.select(F.col("name").alias("matched_name"), F.col("seq_no").alias("matched_no"), "clades")
    rows = antigens.join(matches.select("ag_no", "matched_name", "matched_no"), "ag_no", "left").join(s, ["matched_name", "matched_no"], "left")
    return rows.select("ag_no", F.when(F.col("matched_name").isNull(), F.array().cast("array<string>")).when(F.size("clades") == 0, F.array(F.lit("SEQUENCED"))).otherwise(F.col("clades")).alias("clades"))
