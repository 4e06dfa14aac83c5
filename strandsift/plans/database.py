"""SequenceDB: the database as an immutable object over DataFrames. Every verb returns a new object or a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import clades, derived, sequence, text
from ..operators import aggregates, filters, indels, lookups, merge, ordering
from ..runtime import shared
from ..sources import database, fasta


class SequenceDB:
    """``seqs`` is the flattened view (``schema.flatten``)."""

    def __init__(self, seqs: DataFrame):
        self.seqs = seqs

    # ------------------------------------------------------------ reading and writing
    @classmethod
    def load(cls, spark: SparkSession, path: str, **how) -> SequenceDB:
        return cls(schema.flatten(database.read_database(spark, path, **how)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SequenceDB:
        return cls(schema.flatten(database.read_database_lines(spark, path)))

    @classmethod
    def create(cls, spark: SparkSession, paths: str | list[str], lab: str = "", virus_type: str = "", lineage: str = "") -> SequenceDB:
        """The ingest pipeline: read, parse headers, normalize, align, merge by name, gaps, B lineage, clades."""
        records = fasta.with_headers(fasta.read_fasta(spark, paths), lab, virus_type, lineage)
        return cls(merge.merge(merge.align_records(merge.normalize_records(records)))).detect_insertions_deletions().detect_b_lineage().update_clades()

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """``mode`` is Spark's, or ``backup``: what is there is renamed, with the time of its last change."""
        database.write_database(schema.nest(self.seqs), path, mode)

    def export_database(self, path: str, mode: str = "errorifexists") -> None:
        database.export_database(schema.nest(self.seqs), path, mode)

    def entries(self) -> DataFrame:
        return schema.nest(self.seqs)

    def number_of_entries(self) -> int:
        return self.seqs.select("name").distinct().count()

    def number_of_seqs(self) -> int:
        return self.seqs.count()

    # ------------------------------------------------------------ filters
    def filter(self, **how) -> SequenceDB:
        return SequenceDB(filters.select(self.seqs, **how))

    def filter_lab(self, lab: str) -> SequenceDB:
        return self.filter(lab=lab)

    def filter_labid(self, lab: str, id: str) -> SequenceDB:
        return self.filter(lab_id=(lab, id))

    def filter_subtype(self, virus_type: str) -> SequenceDB:
        return self.filter(virus_type=virus_type)

    def filter_lineage(self, lineage: str) -> SequenceDB:
        return self.filter(lineage=lineage)

    def filter_continent(self, continent: str) -> SequenceDB:
        return self.filter(continent=continent)

    def filter_country(self, country: str) -> SequenceDB:
        return self.filter(country=country)

    def filter_aligned(self, aligned: bool = True) -> SequenceDB:
        return self.filter(aligned=aligned)

    def filter_gene(self, gene: str) -> SequenceDB:
        return self.filter(gene=gene)

    def filter_clade(self, clade: str) -> SequenceDB:
        return self.filter(clade=clade)

    def filter_date_range(self, begin: str = "", end: str = "") -> SequenceDB:
        return self.filter(begin=begin, end=end)

    def filter_hi_name(self, present: bool = True) -> SequenceDB:
        return self.filter(hi_name=present)

    def filter_name_regex(self, pattern: str) -> SequenceDB:
        return self.filter(name_regex=pattern)

    def filter_date_prefix(self, prefix: str) -> SequenceDB:
        return SequenceDB(self.seqs.where(filters.date_prefix(F.col("dates"), prefix)))

    def filter_residues(self, wanted: str) -> SequenceDB:
        return SequenceDB(filters.residues(self.seqs, wanted))

    # ------------------------------------------------------------ lookups
    def find_by_name(self, name: str) -> DataFrame:
        return lookups.by_name(self.seqs, name)

    def find_by_seq_id(self, ids: DataFrame) -> DataFrame:
        return lookups.by_seq_id(self.seqs, ids)

    def find_hi_name(self, names: DataFrame) -> DataFrame:
        return lookups.by_hi_name(self.seqs, names)

    def match_antigens(self, antigens: DataFrame) -> DataFrame:
        return lookups.match_antigens(self.seqs, antigens)

    def all_hi_names(self) -> DataFrame:
        return aggregates.distinct_items(self.seqs, "hi_names")

    def all_passages(self) -> DataFrame:
        return aggregates.distinct_items(self.seqs, "passages")

    # ------------------------------------------------------------ reports
    def report(self) -> DataFrame:
        return aggregates.entry_flags(self.seqs)

    def info(self) -> DataFrame:
        return aggregates.info(self.seqs)

    def info_periods(self) -> DataFrame:
        return aggregates.info_periods(self.seqs, derived.latest_date(F.col("dates")))

    def info_clades(self) -> DataFrame:
        return aggregates.info_clades(self.seqs)

    def report_clade(self, clade: str = "all") -> DataFrame:
        name = derived.make_name(F.col("name"), F.col("passages"), F.col("hi_names"))
        return aggregates.clade_report(self.seqs, clade, derived.latest_date(F.col("dates")), derived.lab(F.col("lab_ids")), name)

    def report_identical(self, column: str = "aa") -> DataFrame:
        """key, n, item of each member of each group of equal sequences."""
        made = sequence.amino_acids(F.col("aa"), F.col("aa_shift")) if column == "aa" else sequence.nucleotides(F.col("nuc"), F.col("nuc_shift"))
        return aggregates.identical(self.seqs.where("align_status = 'aligned'"), made, derived.seq_id(F.col("name"), F.col("passages")).alias("item"))

    def report_not_aligned(self, size: int = 40) -> DataFrame:
        return aggregates.prefixes(self.seqs.where("align_status <> 'aligned'"), "aa", size)

    def aa_at_positions(self, positions: list[int], matches: DataFrame) -> DataFrame:
        """Residues at the positions -> numbers of the matched antigens."""
        s = self.seqs.select(F.col("name").alias("matched_name"), F.col("seq_no").alias("matched_no"), "aa", "aa_shift")
        aa = F.concat(*(sequence.residue_at(F.col("aa"), F.col("aa_shift"), p) for p in positions))
        return aggregates.residues_to_indexes(matches.join(s, ["matched_name", "matched_no"]), aa, "ag_no")

    # ------------------------------------------------------------ matched antigens
    def antigen_sequences(self, antigens: DataFrame, amino_acids: bool = False) -> DataFrame:
        """ag_no, full_name, seq_id, passage, date, sequence (aligned) of each antigen's sequence; antigens without one have nulls."""
        made = sequence.amino_acids(F.col("aa"), F.col("aa_shift")) if amino_acids else sequence.nucleotides(F.col("nuc"), F.col("nuc_shift"))
        own = self.seqs.select(F.col("name").alias("matched_name"), F.col("seq_no").alias("matched_no"), derived.seq_id(F.col("name"), F.col("passages")).alias("seq_id"), derived.first(F.col("passages")).alias("passage"), derived.latest_date(F.col("dates")).alias("date"), made.alias("sequence"))
        return self.match_antigens(antigens).join(own, ["matched_name", "matched_no"], "left").select("ag_no", "full_name", "seq_id", "passage", "date", "sequence")

    def antigen_layout(self, antigens: DataFrame, layout: DataFrame, amino_acids: bool = True) -> DataFrame:
        """The sequences of a chart's antigens with their coordinates (``layout``: ag_no, coordinates), for ``sinks.write_csv``."""
        return self.antigen_sequences(antigens, amino_acids).where("sequence IS NOT NULL").join(layout.select("ag_no", "coordinates"), "ag_no")

    def antigen_fasta(self, antigens: DataFrame, amino_acids: bool = False) -> DataFrame:
        """name (the antigen's), sequence of all matched antigens, for ``sinks.write_fasta``."""
        return self.antigen_sequences(antigens, amino_acids).where("sequence IS NOT NULL").select(F.col("full_name").alias("name"), "sequence", "ag_no")

    # ------------------------------------------------------------ updates
    def cleanup(self) -> SequenceDB:
        return SequenceDB(filters.drop_short(self.seqs))

    def detect_insertions_deletions(self) -> SequenceDB:
        rows = self.seqs.withColumn("aligned_aa", sequence.amino_acids(F.col("aa"), F.col("aa_shift")))
        return SequenceDB(indels.apply(indels.detect(rows)).select(*self.seqs.columns))

    def detect_b_lineage(self) -> SequenceDB:
        """Only an empty lineage of type B is filled, from the entry's first sequence that tells."""
        own = F.when(F.col("virus_type") == "B", clades.b_lineage(F.col("aa"), F.col("aa_shift")))
        w = Window.partitionBy("name").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self.seqs.withColumn("_l", own).withColumn("_l", F.first("_l", ignorenulls=True).over(w))
        return SequenceDB(rows.withColumn("lineage", F.when(F.col("lineage") == "", F.coalesce("_l", F.lit(""))).otherwise(F.col("lineage"))).select(*self.seqs.columns))

    def update_clades(self) -> SequenceDB:
        c = F.when(F.col("align_status") == "aligned", clades.clades(F.col("virus_type"), F.col("lineage"), F.col("aa"), F.col("aa_shift"), F.col("clades"))).otherwise(F.col("clades"))
        return SequenceDB(self.seqs.withColumn("clades", c))

    def remove_hi_names(self) -> SequenceDB:
        return SequenceDB(merge.remove_hi_names(self.seqs))

    def match_hidb(self, hi: DataFrame, locations: DataFrame | None = None) -> SequenceDB:
        """Laboratory names from HI antigens (full_name, name, passage, reassortant, hi_ids, and if there are such columns lineage and
        date): entries that have a match also take its dates, and a B entry without lineage the first one's. With
        ``locations`` (location, country, continent) a matched entry without country takes those of its name's second part."""
        entries = self.seqs.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list(derived.ids_of(F.col("lab_ids"), "CDC")))).alias("cdc_ids"))
        pairs = lookups.entry_antigens(entries, hi)
        ags = pairs.join(hi.select("full_name", "passage", "reassortant"), "full_name")
        scored = shared(lookups.best_by_antigen(self.seqs, ags))  # counted and gone through
        found = lookups.assign_antigens(scored).groupBy("name", "seq_no").agg(F.array_sort(F.collect_set("full_name")).alias("_h"))
        rows = self.seqs.join(found, ["name", "seq_no"], "left").withColumn("hi_names", F.coalesce("_h", "hi_names"))
        if {"lineage", "date"} <= set(hi.columns):
            more = pairs.join(hi.select("full_name", F.col("lineage").alias("_l"), F.col("date").alias("_d")), "full_name").groupBy("name").agg(F.min_by("_l", "full_name").alias("_l"), F.collect_set("_d").alias("_d"))
            rows = rows.join(more, "name", "left").withColumn("dates", text.add_dates(F.col("dates"), F.coalesce("_d", F.array().cast("array<string>"))))
            rows = rows.withColumn("lineage", F.when((F.col("virus_type") == "B") & (F.col("lineage") == ""), F.coalesce("_l", F.lit(""))).otherwise(F.col("lineage")))
        if locations is not None:
            at = locations.select(F.col("location").alias("_at"), F.col("country").alias("_c"), F.col("continent").alias("_k")).dropDuplicates(["_at"])
            hit = pairs.select("name").distinct().withColumn("_m", F.lit(True))
            rows = rows.join(hit, "name", "left").join(at, (F.get(F.split("name", "/"), F.lit(1)) == F.col("_at")) & (F.col("country") == "") & F.col("_m"), "left")
            rows = rows.withColumns({"country": F.coalesce("_c", "country"), "continent": F.coalesce("_k", "continent")})
        return SequenceDB(rows.select(*self.seqs.columns))

    # ------------------------------------------------------------ export
    def export(
        self, amino_acids: bool = False, template: str = "{seq_id}", recent: int = 0, random: int = 0, seed: int = 1, base: DataFrame | str | None = None, include: list[str] | None = None, hamming: int = 0,
        common_length: bool = False, sort: str = "date", source: SequenceDB | None = None,
    ) -> DataFrame:
        """name, sequence, date of the selection, in export order: names, left part, suffixes, latest or random rows, order by date or name,
        base first, what is included last, common length, distance to the first row.

        ``base`` is rows (name, sequence, date) or an expression for the name of one sequence, ``include`` expressions for names; both are looked
        for in ``source`` (the whole database; this selection if there is none)."""
        if sort not in ("date", "name"):
            raise ValueError(f"unrecognized order: {sort}")
        source = source or self
        shift = "aa_shift" if amino_acids else "nuc_shift"
        left = F.broadcast(ordering.left_part(self.seqs, shift))
        rows = self._exported(self.seqs, left, amino_acids, template)
        rows = ordering.recent(rows, recent) if recent else rows
        rows = ordering.sample(rows, random, seed) if random else rows
        if isinstance(base, str):
            found = filters.select(source.seqs, aligned=True, name_regex=base)
            lookups.only_one(found.select("name", "seq_no"))
            base = self._exported(found, left, amino_acids, template)
        if base is not None or include:
            more = [self._exported(filters.select(source.seqs, aligned=True, name_regex=x), left, amino_acids, template) for x in include or []]
            included = reduce(DataFrame.unionByName, more).dropDuplicates(["name"]) if more else rows.limit(0)
            rows = ordering.with_base(base.select("name", "sequence", "date") if base is not None else rows.limit(0), rows, included)
        else:
            rows = rows.withColumn("part", F.lit(1))
        rows = ordering.to_common_length(rows, "sequence", "X" if amino_acids else "-") if common_length else rows
        order = ("part", "date", "name") if sort == "date" else ("part", "name", "date")
        if hamming:
            first = rows.orderBy(*order).limit(1).select(F.col("sequence").alias("_first"))
            rows = rows.crossJoin(F.broadcast(first)).where((sequence.hamming(F.col("sequence"), F.col("_first")) < hamming) | (F.col("part") == 0)).drop("_first")
        return rows.orderBy(*order).drop("part")

    @staticmethod
    def _exported(seqs: DataFrame, left: DataFrame, amino_acids: bool, template: str) -> DataFrame:
        """name, sequence, date of the aligned sequences; repeated names are numbered."""
        f = {"name": F.col("name"), "date": derived.latest_date(F.col("dates")), "passage": derived.first(F.col("passages")), "lab": derived.lab(F.col("lab_ids")), "lab_id": derived.lab_id(F.col("lab_ids")), "virus_type": F.col("virus_type"), "gene": F.col("gene"), "seq_id": derived.seq_id(F.col("name"), F.col("passages"))}
        f["hi_name_or_seq_name_with_passage"] = derived.make_name(F.col("name"), F.col("passages"), F.col("hi_names"))
        made = sequence.longest_open_part(sequence.left_shift(F.col("aa"), F.col("aa_shift") + F.col("left"), "X")) if amino_acids else sequence.left_shift(F.col("nuc"), F.col("nuc_shift") + F.col("left"), "-")
        rows = seqs.where("align_status = 'aligned'").crossJoin(left).select(sequence.name_from_template(template, f).alias("name"), made.alias("sequence"), f["date"].alias("date"), F.struct(F.col("name"), "seq_no").alias("_o")).where("sequence <> ''")
        return ordering.unique_names(rows, "name", "_o").drop("_o")

    def export_tree(self, flu: str, base: str, recent: int = 4000, hamming: int = 160) -> DataFrame:
        """The preset for trees: name (encoded id), nuc, aa, date, in the order part, date (latest first), name; part 0 is the base.

        ``base`` is an expression for the name of one sequence. Of the aligned HA sequences of the virus the latest ``recent`` ones nearer than
        ``hamming`` to the base are taken, one for each id, all of the length most common among the latest; ends that look damaged are blanked."""
        virus_type, lineage = text.flu_selection(flu)
        all_rows = filters.select(self.seqs, virus_type=virus_type, lineage=lineage, aligned=True, gene="HA")
        root = lookups.only_one(filters.select(all_rows, name_regex=base).select("name", "seq_no"))
        rows = all_rows.select(
            derived.seq_id(F.col("name"), F.col("passages"), encode=True).alias("name"), sequence.nucleotides(F.col("nuc"), F.col("nuc_shift")).alias("nuc"), sequence.amino_acids(F.col("aa"), F.col("aa_shift")).alias("aa"),
            derived.latest_date(F.col("dates")).alias("date"), ((F.col("name") == root["name"]) & (F.col("seq_no") == root["seq_no"])).alias("root"), F.struct(F.col("name"), "seq_no").alias("_o"),
        )
        others = ordering.first_of(rows.where("NOT root"), "name", "_o")
        latest = others.orderBy(F.desc("date"), "name").limit(recent)
        size = lookups.only_one(ordering.common_length(latest, "aa"), "common length")["n"]
        cut = lambda df: df.withColumns({"nuc": sequence.resize(F.col("nuc"), size * 3, "-"), "aa": sequence.resize(F.col("aa"), size, "X")})
        first = cut(rows.where("root"))
        by = first.select(F.col("nuc").alias("_base"))  # one row
        near = ordering.walk_recent(cut(others).crossJoin(F.broadcast(by)), sequence.hamming(F.col("nuc"), F.col("_base")) < hamming, recent, key="name")
        out = first.crossJoin(F.broadcast(by)).withColumn("part", F.lit(0)).unionByName(near.withColumn("part", F.lit(1)))
        bad = out.withColumn("_n", sequence.damaged_codons(F.col("nuc"), F.col("_base")))
        return bad.select("name", sequence.blank_end(F.col("nuc"), F.col("_n") * 3, "-").alias("nuc"), sequence.blank_end(F.col("aa"), F.col("_n"), "X").alias("aa"), "date", "part").orderBy("part", F.desc("date"), "name")

    @staticmethod
    def report_hamming(exported: DataFrame, first: str) -> DataFrame:
        """name, distance of exported rows to the one of name ``first``, farthest first."""
        base = exported.where(F.col("name") == first).select(F.col("sequence").alias("_first")).limit(1)
        rows = exported.where(F.col("name") != first).crossJoin(F.broadcast(base))
        return rows.select("name", sequence.hamming(F.col("sequence"), F.col("_first")).alias("distance")).orderBy(F.desc("distance"), "name")
