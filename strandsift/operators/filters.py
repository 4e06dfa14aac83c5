"""Predicates over the flattened view; an empty argument does not restrict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derived, sequence
from ..functions.clades import has_residues


def has_lab(lab_ids: Column, lab: str) -> Column:
    return F.map_contains_key(lab_ids, lab)


def has_lab_id(lab_ids: Column, lab: str, id: str) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(lab_ids, F.lit(lab)), id), F.lit(False))


def in_dates(dates: Column, begin: str = "", end: str = "") -> Column:
    """Latest date in [begin, end); no date is 0000-00-00."""
    latest = F.coalesce(F.array_max(dates), F.lit("0000-00-00"))
    cond = F.lit(True)
    if begin:
        cond = cond & (latest >= begin)
    return cond & (latest < end) if end else cond


def date_prefix(dates: Column, prefix: str) -> Column:
    if len(prefix) not in (4, 7, 10):
        raise ValueError("a date prefix has 4, 7 or 10 characters")
    return derived.latest_date(dates).startswith(prefix)


def name_matches(name: Column, pattern: str) -> Column:
    return name.rlike("(?i)" + pattern)


def matches_or_empty(items: Column, value: str) -> Column:
    """An empty list agrees with an empty value only."""
    return F.when(F.size(items) == 0, F.lit(value == "")).otherwise(F.array_contains(items, value))


def residues(df: DataFrame, wanted: str) -> DataFrame:
    """Aligned rows with all of ``142N 283Q``."""
    return df.where(F.col("aa_shift").isNotNull() & has_residues(F.col("aa"), F.col("aa_shift"), wanted))


def hamming_below(df: DataFrame, base: str, threshold: int, column: str = "nuc") -> DataFrame:
    """Rows nearer to ``base`` than the threshold, over the shorter length."""
    return df.where(sequence.hamming_bulk(F.col(column), F.lit(base)) < threshold)


def select(df: DataFrame, lab: str = "", lab_id: tuple[str, str] | None = None, virus_type: str = "", lineage: str = "", continent: str = "", country: str = "", aligned: bool = False, gene: str = "", clade: str = "", begin: str = "", end: str = "", hi_name: bool = False, name_regex: str = "") -> DataFrame:
    """The conjunction of all predicates given: equalities first, so they reach the scan, the regex last."""
    conds = [F.col(c) == v for c, v in (("virus_type", virus_type), ("lineage", lineage), ("continent", continent), ("country", country), ("gene", gene)) if v]
    if begin or end:
        conds.append(in_dates(F.col("dates"), begin, end))
    if aligned:
        conds.append(F.col("align_status") == "aligned")
    if hi_name:
        conds.append(F.size("hi_names") > 0)
    if lab:
        conds.append(has_lab(F.col("lab_ids"), lab))
    if lab_id:
        conds.append(has_lab_id(F.col("lab_ids"), *lab_id))
    if clade:
        conds.append(F.array_contains("clades", clade))
    if name_regex:
        conds.append(name_matches(derived.make_name(F.col("name"), F.col("passages"), F.col("hi_names")), name_regex))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def drop_short(df: DataFrame) -> DataFrame:
    """Without short and untranslated sequences."""
    return df.where(~derived.is_short(F.col("nuc"), F.col("aa")) & (F.col("aa") != ""))


def extract(records: DataFrame, wanted: DataFrame, most: int = 1 << 20) -> DataFrame:
    """FASTA records (record_no, name, sequence) whose name holds a wanted one (want_no, want): a record serves its first wanted name only, the last record wins.

    The wanted names go to all tasks as one automaton, ``most`` of them at a time, and a record's name is read once for each automaton, however
    many names it holds."""
    kind = dict(wanted.dtypes)["want_no"]
    asked = wanted.select(F.col("want_no").cast("long").alias("want_no"), F.col("want").cast("string").alias("want")).where("want_no IS NOT NULL AND want IS NOT NULL")
    groups = max(1, -(-asked.count() // most))
    schema = f"record_no {dict(records.dtypes)['record_no']}, want_no long, want string, name string, sequence string"
    parts = []
    for g in range(groups):
        own = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("want_no", "want"), F.lit(groups)) == g)
        sent = records.sparkSession.sparkContext.broadcast([(r["want_no"], r["want"]) for r in own.collect()])
        parts.append(records.select("record_no", "name", "sequence").where("name IS NOT NULL").mapInPandas(_finder(sent), schema))
    hits = reduce(DataFrame.unionByName, parts)
    if groups > 1:
        hits = hits.groupBy("record_no").agg(F.min_by(F.struct("want_no", "want", "name", "sequence"), "want_no").alias("x")).select("record_no", "x.*")
    last = hits.groupBy("want_no", "want").agg(F.max_by(F.struct("name", "sequence"), "record_no").alias("x"))
    return last.select(F.col("want_no").cast(kind).alias("want_no"), "want", "x.*")


def _finder(sent):
    """The first wanted name in each record's name."""

    def find(batches):
        import ahocorasick

        numbers: dict[str, int] = {}
        for number, want in sent.value:
            numbers[want] = min(number, numbers.get(want, number))
        everywhere = numbers.pop("", None)  # an empty name is in every name
        automaton = ahocorasick.Automaton()
        for want, number in numbers.items():
            automaton.add_word(want, (number, want))
        if numbers:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for name in batch["name"]:
                hits = [hit for _, hit in automaton.iter(name)] if numbers else []
                if everywhere is not None:
                    hits.append((everywhere, ""))
                found.append(min(hits) if hits else None)
            keep = [k for k, hit in enumerate(found) if hit]
            if keep:
                out = batch.iloc[keep]
                yield out.assign(want_no=[found[k][0] for k in keep], want=[found[k][1] for k in keep])[["record_no", "want_no", "want", "name", "sequence"]]

    return find
