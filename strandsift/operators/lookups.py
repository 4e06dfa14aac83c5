"""Lookups by name, laboratory name and sequence id; antigen and serum matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived
from ..runtime import shared


def by_name(seqs: DataFrame, name: str) -> DataFrame:
    return seqs.where(F.col("name") == name)


def hi_index(seqs: DataFrame) -> DataFrame:
    """hi_name -> its first sequence by (name, seq_no)."""
    rows = seqs.select(F.explode("hi_names").alias("hi_name"), *seqs.columns)
    first = rows.groupBy("hi_name").agg(F.min(F.struct("name", "seq_no")).alias("k")).select("hi_name", F.col("k.name").alias("name"), F.col("k.seq_no").alias("seq_no"))
    return first


def by_hi_name(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (hi_name) with name, seq_no of their sequence; null where there is none."""
    return names.join(hi_index(seqs), "hi_name", "left")


def in_entry(seqs: Column, hi_name: str) -> Column:
    """The first sequence of an entry's array that has a laboratory name."""
    return F.get(F.filter(seqs, lambda s: F.array_contains(s["hi_names"], hi_name)), F.lit(0))


def by_seq_id(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (seq_id) resolved: ``name__passage[__n]`` to the n-th (from 0) sequence of that passage; without ``__``
    a laboratory name, else name and passage around a year."""
    parts = ids.select("seq_id", F.url_decode("seq_id").alias("plain")).select(
        "seq_id", "plain", F.split_part("plain", F.lit("__"), F.lit(1)).alias("want"), F.split_part("plain", F.lit("__"), F.lit(2)).alias("passage"),
        F.coalesce(F.expr("try_cast(nullif(split_part(plain, '__', 3), '') AS int)"), F.lit(0)).alias("nth"), F.col("plain").contains("__").alias("is_id"),
    )
    parts = shared(parts)  # read twice
    year = r"^(.*/[12]\d{3}) (.*)$"
    named = seqs.select("name", "seq_no", derived.first(F.col("passages")).alias("first_passage"))
    nth = named.withColumn("n2", F.row_number().over(Window.partitionBy("name", "first_passage").orderBy("seq_no")) - 1)
    placed = lambda want: want.join(nth, (F.col("want") == F.col("name")) & (F.col("passage") == F.col("first_passage")) & (F.col("nth") == F.col("n2")), "left")
    found = placed(parts.where("is_id").select("seq_id", "want", "passage", "nth")).select("seq_id", "name", "seq_no")
    loose = parts.where("is_id IS NOT TRUE")
    if loose.isEmpty():  # laboratory names need not be indexed
        return found
    loose = loose.select("seq_id", F.col("plain").alias("hi_name"), F.regexp_extract("plain", year, 1).alias("want"), F.regexp_extract("plain", year, 2).alias("passage"), F.lit(0).alias("nth"))
    by_hi = hi_index(seqs).select("hi_name", F.col("name").alias("h_name"), F.col("seq_no").alias("h_no"))
    rest = placed(loose).select("seq_id", "hi_name", "name", "seq_no").join(by_hi, "hi_name", "left")
    return found.unionByName(rest.select("seq_id", F.coalesce("h_name", "name").alias("name"), F.coalesce("h_no", "seq_no").alias("seq_no")))


def match_antigens(seqs: DataFrame, antigens: DataFrame) -> DataFrame:
    """One row for each antigen (ag_no, full_name, alt_name, name, passage, reassortant, virus_type, lineage) with name and
    seq_no of its sequence: by full name, by the alternative, or, without passage, by name and reassortant (the
    last one); a match of another virus type, or of another known lineage, is none."""
    keys = antigens.select(F.col("ag_no").alias("a_no"), F.posexplode(F.array("full_name", "alt_name")).alias("way", "hi_name"))
    by_key = keys.join(hi_index(seqs), "hi_name").select("a_no", "way", F.struct("name", "seq_no").alias("m"))
    bare = antigens.where("passage = ''").select(F.col("ag_no").alias("a_no"), F.col("name").alias("n3"), F.col("reassortant").alias("r3"))
    same = F.when(F.size("reassortants") == 0, F.col("r3") == "").otherwise(F.array_contains(F.col("reassortants"), F.col("r3")))
    by_name = bare.join(seqs.select("name", "seq_no", "reassortants"), F.col("n3") == F.col("name")).where(same).groupBy("a_no").agg(F.max(F.struct("name", "seq_no")).alias("m")).select("a_no", F.lit(2).alias("way"), "m")
    first = by_key.unionByName(by_name).groupBy("a_no").agg(F.min_by("m", "way").alias("m"))
    found = antigens.join(first, F.col("ag_no") == F.col("a_no"), "left").select(*(antigens[c] for c in antigens.columns), "m")
    info = seqs.select(F.col("name").alias("s_name"), F.col("seq_no").alias("s_no"), F.col("virus_type").alias("s_type"), F.col("lineage").alias("s_lineage"))
    joined = found.join(info, (F.col("m.name") == F.col("s_name")) & (F.col("m.seq_no") == F.col("s_no")), "left")
    good = (F.col("virus_type") == F.col("s_type")) & ((F.col("lineage") == "") | (F.col("lineage") == F.col("s_lineage")))
    return joined.select("ag_no", "full_name", F.when(good, F.col("m.name")).alias("matched_name"), F.when(good, F.col("m.seq_no")).alias("matched_no"))


def serum_clades(sera: DataFrame, matches: DataFrame, seqs: DataFrame) -> DataFrame:
    """Clades of each serum's homologous antigens, sorted."""
    rows = sera.select("sr_no", F.explode("homologous").alias("ag_no")).join(matches, "ag_no")
    s = seqs.select(F.col("name").alias("matched_name"), F.col("seq_no").alias("matched_no"), "clades")
    return rows.join(s, ["matched_name", "matched_no"]).groupBy("sr_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("clades")))).alias("clades"))


def unmatched(seqs: DataFrame) -> DataFrame:
    """Entries none or only some of whose sequences have laboratory names: name, n_seqs, n_matched."""
    per = seqs.groupBy("name").agg(F.count(F.lit(1)).alias("n_seqs"), F.count_if(F.size("hi_names") > 0).alias("n_matched"))
    return per.where("n_matched < n_seqs")


def only_one(df: DataFrame, what: str = "base sequence") -> dict:
    """The single row of ``df`` as a dict; an error if there is none or more (reads two rows at most)."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{what}: {'none' if not rows else 'several'} found")
    return rows[0].asDict()


def without_present(df: DataFrame, present: DataFrame) -> DataFrame:
    return df.join(present.select("name").distinct(), "name", "left_anti")


# ---------------------------------------------------------------- laboratory database
def passage_class(passage: Column) -> Column:
    """egg, cell, or '' (unknown) from a passage's last step."""
    last = F.element_at(F.split(passage, "/"), -1)
    return F.when(last.rlike(r"^\s*E"), "egg").when(last.rlike(r"^\s*(MDCK|SIAT|MK|QMC|HCK|CACO)"), "cell").otherwise("")


def compatible(a: Column, b: Column) -> Column:
    """Egg and cell do not go together; unknown goes with anything."""
    return (a == "") | (b == "") | (a == b)


def match_score(a: Column, b: Column) -> Column:
    """100 for equal passages, else the length of the common beginning."""
    return F.when(a == b, 100).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)) & (F.length(a) > 0) & (F.length(b) > 0))))


def fallback_name(name: Column) -> Column:
    """With exactly four slashes (an isolation written with a slash), parts three and four joined by a hyphen; else the name."""
    p = F.split(name, "/", -1)
    part = lambda k: F.get(p, F.lit(k))
    return F.when(F.size(p) == 5, F.concat_ws("/", part(0), part(1), F.concat_ws("-", part(2), part(3)), part(4))).otherwise(name)


def entry_antigens(entries: DataFrame, hi: DataFrame) -> DataFrame:
    """(name, full_name) pairs by CDC id or by name (or its fallback), once each."""
    ids = entries.select("name", F.explode("cdc_ids").alias("id")).join(hi.select("full_name", F.explode("hi_ids").alias("id")), "id").select("name", "full_name")
    keys = entries.select("name", F.explode(F.array_distinct(F.array(F.col("name"), fallback_name(F.col("name"))))).alias("key"))
    names = keys.join(hi.select("full_name", F.col("name").alias("key")), "key").select("name", "full_name")
    return ids.unionByName(names).distinct()


def best_by_antigen(seqs: DataFrame, antigens: DataFrame) -> DataFrame:
    """For each (name, full_name) the compatible sequence with the highest score (ties: seq_no)."""
    a = antigens.select("name", "full_name", F.col("passage").alias("ag_passage"), F.col("reassortant").alias("ag_reassortant"))
    s = seqs.select("name", "seq_no", derived.first(F.col("passages")).alias("passage"), "reassortants")
    ok = F.when(F.size("reassortants") == 0, F.col("ag_reassortant") == "").otherwise(F.array_contains(F.col("reassortants"), F.col("ag_reassortant")))
    pairs = a.join(s, "name").where(ok & compatible(passage_class(F.col("passage")), passage_class(F.col("ag_passage")))).withColumn("score", match_score(F.col("passage"), F.col("ag_passage")))
    w = Window.partitionBy("name", "full_name").orderBy(F.desc("score"), "seq_no")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "full_name", "seq_no", "score")


def assign_antigens(pairs: DataFrame, rounds: int = 30, most: int = 1 << 16) -> DataFrame:
    """Greedy assignment inside each entry: pairs (name, seq_no, full_name, score) by score, ties by full_name and seq_no; each antigen goes
    to one sequence and each sequence takes what ties with its best.

    Entries of up to ``most`` pairs are shuffled once by name and gone through pair by pair as sorted streams. Larger ones are decided in rounds: a pair is
    decided by earlier pairs of its antigen and higher ones of its sequence alone. So each round takes, everywhere at once, the pairs that are the
    first open ones of their antigen and among the highest open ones of their sequence, and closes what they rule out; the result is that
    of going through the pairs one by one. No round needs an entry in one place. Pairs of chains longer than ``rounds`` are gone through as a stream.
    """
    columns = ["name", "seq_no", "full_name", "score"]
    pairs = pairs.select(*columns)
    large = shared(pairs.groupBy(F.col("name").alias("_large")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_large"))
    if large.isEmpty():
        return _in_order(pairs)
    of_large = F.col("name").eqNullSafe(F.col("_large"))  # few names: each has over ``most`` pairs
    left, taken = pairs.join(F.broadcast(large), of_large, "left_semi"), [_in_order(pairs.join(F.broadcast(large), of_large, "left_anti"))]
    of_antigen, of_seq = Window.partitionBy("name", "full_name"), Window.partitionBy("name", "seq_no")
    for _ in range(rounds):
        rows = left.withColumn("_first", F.row_number().over(of_antigen.orderBy(F.desc("score"), "seq_no")) == 1)
        rows = rows.withColumn("_top", F.max("score").over(of_seq)).withColumn("_take", F.col("_first") & (F.col("score") == F.col("_top")))
        rows = rows.withColumn("_has", F.max("_take").over(of_seq)).where(F.col("_take") | ~F.col("_has") | (F.col("score") == F.col("_top")))
        rows = rows.withColumn("_gone", F.max("_take").over(of_antigen)).where(F.col("_take") | ~F.col("_gone"))
        rows = shared(rows.select(*columns, "_take"))
        taken.append(rows.where("_take").select(*columns))
        left = rows.where("NOT _take").select(*columns)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, taken)
    return reduce(DataFrame.unionAll, [*taken, _in_order(left)])


def _in_order(pairs: DataFrame) -> DataFrame:
    """Open pairs, entry by entry in their order; of an entry only its antigens and sequences are held. A sequence that has its best already has only
    pairs of that score open."""

    def values(column) -> list:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def keep(batches):
        import pyarrow as pa

        now, taken, best = object(), set(), {}
        for batch in batches:
            kept = []
            for k, (name, seq, antigen, score) in enumerate(zip(*(values(c) for c in batch.columns), strict=True)):
                if name != now:
                    now, taken, best = name, set(), {}
                if antigen not in taken and best.get(seq, score) == score:
                    taken.add(antigen)
                    best[seq] = score
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return pairs.repartition("name").sortWithinPartitions("name", F.desc("score"), "full_name", "seq_no").mapInArrow(keep, pairs.schema)
