"""Reports by grouping: counts, composition per position, diversity, separation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import CODONS, code_points


def entry_flags(seqs: DataFrame) -> DataFrame:
    """Per virus type: entries, and those with an aligned, matched, dated, clade sequence."""
    has = lambda c: F.max(c.cast("int"))
    per = seqs.groupBy("virus_type", "name").agg(has(F.col("align_status") == "aligned").alias("aligned"), has(F.size("hi_names") > 0).alias("matched"), has(F.size("dates") > 0).alias("dated"), has(F.size("clades") > 0).alias("clade"))
    return per.groupBy("virus_type").agg(F.count(F.lit(1)).alias("entries"), *(F.sum(c).alias(c) for c in ("aligned", "matched", "dated", "clade")))


def info(seqs: DataFrame) -> DataFrame:
    """Entries, sequences and matched ones in all, per type, and per type and lineage."""
    counts = (F.countDistinct("name").alias("entries"), F.count(F.lit(1)).alias("seqs"), F.count_if(F.size("hi_names") > 0).alias("matched"))
    return seqs.rollup("virus_type", "lineage").agg(*counts)


def by_month(seqs: DataFrame, date: Column) -> DataFrame:
    """Sequences by year and month, with subtotals."""
    rows = seqs.select(F.substring(date, 1, 4).alias("year"), F.substring(date, 1, 7).alias("month"))
    return rows.rollup("year", "month").agg(F.count(F.lit(1)).alias("seqs"))


def clade_counts(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.explode("clades").alias("clade")).groupBy("clade").agg(F.count(F.lit(1)).alias("seqs"))


def clade_sets(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy(F.array_join("clades", " ").alias("clades")).agg(F.count(F.lit(1)).alias("seqs"))


def identical(df: DataFrame, key: Column, *items: Column) -> DataFrame:
    """All members of the groups of two or more rows with an equal, non-empty key, a row each: key, n (of the group), items. Groups are counted
    by themselves and joined with the rows, so the members of a large one may be dealt over tasks."""
    rows = df.where(key != "").select(key.alias("key"), *items)
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups.hint("shuffle_hash"), "key").select("key", "n", *rows.columns[1:])


def prefixes(df: DataFrame, column: str, size: int) -> DataFrame:
    return df.select(F.substring(column, 1, size).alias("prefix")).distinct().orderBy("prefix")


def distinct_items(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("item")).distinct().orderBy("item")


def residues(df: DataFrame, column: str) -> DataFrame:
    """A row for each residue: the other columns, pos (from 1), aa."""
    rest = [c for c in df.columns if c != column]
    return df.where(F.length(column) > 0).select(*rest, F.posexplode(F.split(F.col(column), "")).alias("p", "aa")).where("aa <> ''").select(*rest, (F.col("p") + 1).alias("pos"), "aa")


def composition(df: DataFrame, column: str) -> DataFrame:
    """pos, aa, n: residue counts at each position. Batches count what they hold, so a few rows each are shuffled."""

    def count(batches):
        for batch in batches:
            points, at = code_points(batch[column])
            pos = np.arange(1, len(points) + 1) - np.repeat(at[:-1], np.diff(at))
            key, n = np.unique(pos << 21 | points, return_counts=True)
            if len(key):  # a batch without residues has nothing to say
                yield pd.DataFrame({"pos": (key >> 21).astype("int32"), "aa": [chr(k) for k in (key & 0x1FFFFF).tolist()], "n": n})

    return df.select(column).mapInPandas(count, "pos int, aa string, n long").groupBy("pos", "aa").agg(F.sum("n").alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """pos, kinds, top residue and its count (ties: the first letter), total, residues by falling count."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "aa")))
    return counts.groupBy("pos").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), items.alias("i")).select("pos", "kinds", "total", F.col("i")[0]["aa"].alias("top"), (-F.col("i")[0]["m"]).alias("top_n"), F.array_join(F.transform("i", lambda x: F.concat(x["aa"], F.lit(":"), (-x["m"]).cast("string"))), " ").alias("residues"))


def variable(profiles: DataFrame) -> DataFrame:
    return profiles.where("kinds > 1").orderBy("top_n", "pos")


def compare_periods(first: DataFrame, second: DataFrame) -> DataFrame:
    """Positions that vary in either period or have another top residue."""
    b = second.select("pos", *(F.col(c).alias(f"{c}_2") for c in ("kinds", "top", "residues")))
    return first.join(b, "pos").where("kinds > 1 OR kinds_2 > 1 OR top <> top_2").select("pos", "residues", "residues_2", "top", "top_2")


def shannon(counts: DataFrame) -> DataFrame:
    """round(-100 * sum(p ln p)) at each position."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    return counts.withColumn("p", p).groupBy("pos").agg(F.round(-F.sum(F.col("p") * F.log("p")) * 100).cast("long").alias("shannon"))


def codons(df: DataFrame, column: str = "nuc") -> DataFrame:
    """A row for each whole codon: the other columns, pos (from 1), codon."""
    rest = [c for c in df.columns if c != column]
    n = F.floor(F.length(column) / 3).cast("int")
    rows = df.where(F.length(column) >= 3).select(*rest, column, F.explode(F.sequence(F.lit(1), n)).alias("pos"))
    return rows.select(*rest, "pos", F.substr(F.col(column), (F.col("pos") - 1) * 3 + 1, F.lit(3)).alias("codon"))


def codon_counts(df: DataFrame, column: str = "nuc", group: str | None = None) -> DataFrame:
    """[the group as text,] pos (from 1), codon, n: whole codons at each position. Batches count what they hold, so a few rows each are shuffled."""

    def count(batches):
        for batch in batches:
            points, at = code_points(batch[column])
            letters, small = np.unique(points, return_inverse=True)
            size = np.diff(at) // 3
            row = np.repeat(np.arange(len(size)), size)
            if not len(row):
                continue
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            begin, k = at[row] + 3 * pos, len(letters)
            codes, names = pd.factorize(batch[group], use_na_sentinel=False) if group else (np.zeros(len(size), np.int64), [None])
            key = (((codes[row] * (int(size.max()) + 1) + pos) * k + small[begin]) * k + small[begin + 1]) * k + small[begin + 2]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            b = begin[first]
            out = pd.DataFrame({"pos": (pos[first] + 1).astype("int32"), "codon": ["".join(map(chr, x)) for x in zip(points[b].tolist(), points[b + 1].tolist(), points[b + 2].tolist(), strict=True)], "n": n})
            if group:
                out.insert(0, group, pd.Series([None if names[c] is None or names[c] != names[c] else str(names[c]) for c in codes[row[first]]], dtype=object))
            yield out

    by = [group] if group else []
    rows = df.select(*(F.col(g).cast("string").alias(g) for g in by), column)
    return rows.mapInPandas(count, ", ".join([*(f"{g} string" for g in by), "pos int, codon string, n long"])).groupBy(*by, "pos", "codon").agg(F.sum("n").alias("n"))


def separating(df: DataFrame, group: str, a: str, b: str, column: str = "nuc") -> DataFrame:
    """Codon positions where two groups share no codon."""
    rows = codon_counts(df.where(F.col(group).isin(a, b)), column, group)
    sets = rows.groupBy("pos").agg(*(F.array_sort(F.collect_set(F.when(F.col(group) == g, F.col("codon")))).alias(f"codons_{k}") for k, g in ((1, a), (2, b))))
    return sets.where((F.size("codons_1") > 0) & (F.size("codons_2") > 0) & ~F.arrays_overlap("codons_1", "codons_2"))


def variable_codons(df: DataFrame, column: str = "nuc") -> DataFrame:
    return codon_counts(df, column).groupBy("pos").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where("kinds > 1")


def weak_positions(df: DataFrame, column: str, percent: float = 95.0) -> DataFrame:
    """Variable positions, X aside, whose top residue is in less than ``percent`` of all rows."""
    counts = composition(df, column).where("aa <> 'X'")
    total = df.agg(F.count(F.lit(1)).alias("entries"))
    rows = profile(counts).where("kinds > 1").crossJoin(F.broadcast(total))
    return rows.withColumn("share", F.col("top_n") * 100.0 / F.col("entries")).where(F.col("share") < percent).drop("entries")


def codon_report(df: DataFrame, column: str = "nuc") -> DataFrame:
    """pos, codons and amino acids with their counts, most frequent first, at positions with more than one codon."""
    counts = codon_counts(df, column)
    table = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    counts = counts.withColumn("aa", F.coalesce(F.try_element_at(table, F.col("codon")), F.lit("X")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(c).alias("x")))), lambda i: F.concat(i["x"], F.lit(":"), (-i["m"]).cast("string"))), " ")
    acids = counts.groupBy("pos", "aa").agg(F.sum("n").alias("n")).groupBy(F.col("pos").alias("aa_pos")).agg(listed("aa").alias("aas"))
    return counts.groupBy("pos").agg(listed("codon").alias("codons"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").join(acids, F.col("pos") == F.col("aa_pos")).select("pos", "codons", "aas")


def residues_to_indexes(df: DataFrame, aa: Column, index: str) -> DataFrame:
    """Which rows have which residues."""
    return df.groupBy(aa.alias("residues")).agg(F.sort_array(F.collect_list(index)).alias("indexes"))


def clades_of_names(seqs: DataFrame, inclusive: bool) -> DataFrame:
    """name, clades of each entry: the union of its sequences'; not inclusive: those of each sequence kept only where the next
    one has them too, so a sequence without clades leaves none."""
    own = seqs.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq_no", "clades"))).alias("s"))
    each = F.transform("s", lambda x: x["clades"])
    union = F.array_sort(F.array_distinct(F.flatten(each)))
    both = F.aggregate(F.slice(each, F.lit(2), F.size(each)), F.get(each, F.lit(0)), lambda a, c: F.array_intersect(a, c))
    return own.select("name", (union if inclusive else F.array_sort(both)).alias("clades"))


def clades_of_name(seqs: DataFrame, name: str, inclusive: bool) -> DataFrame:
    return clades_of_names(seqs.where(F.col("name") == name), inclusive)


def _cells(codes: np.ndarray, texts: pd.Series) -> tuple[np.ndarray, ...]:
    """Of texts and the group each is in: the distinct letters of each (group, position) in order, where each such cell begins among them, and
    the cells' groups and positions (from 0)."""
    points, at = code_points(texts)
    size = np.diff(at)
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    letters, number = np.flatnonzero(there), np.cumsum(there) - 1
    width, k = int(size.max(initial=0)) + 1, max(len(letters), 1)
    pos = np.arange(len(points)) - np.repeat(at[:-1], size)
    key = (np.repeat(codes, size) * width + pos) * k + number[points]
    span = (int(codes.max(initial=0)) + 1) * width * k
    if span <= 1 << 26:  # a flag for each that may be; texts of very unequal length are sorted
        seen = np.zeros(span, bool)
        seen[key] = True
        key = np.flatnonzero(seen)
    else:
        key = np.unique(key)
    cell = key // k
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    cell = cell[first]
    return letters[key % k], first, cell // width, cell % width


def _few(codes: np.ndarray, texts: pd.Series) -> tuple[np.ndarray, list[str]]:
    """Groups and texts that have the same letters at each position as those given: of each group as many as its largest cell has letters."""
    letters, first, group, _ = _cells(codes, texts)
    if not len(first):
        return np.zeros(0, np.int64), []
    kinds = np.diff(np.append(first, len(letters)))
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size, n = np.diff(np.append(begin, len(group))), np.maximum.reduceat(kinds, begin)
    row = np.repeat(np.arange(len(begin)), n)  # the group of each text made
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    ends = np.cumsum(size[row])
    cell = np.arange(ends[-1]) - np.repeat(ends - size[row], size[row]) + np.repeat(begin[row], size[row])
    turn = np.repeat(turn, size[row])
    made = letters[first[cell] + np.where(turn < kinds[cell], turn, 0)].astype(np.uint32).tobytes().decode("utf-32-le")
    return group[begin][row], [made[j - i : j] for i, j in zip(size[row].tolist(), ends.tolist(), strict=True)]


def _by_group(df: DataFrame, column: str, by: tuple[str, ...], finish, out: str, most: int = 1 << 20) -> DataFrame:
    """``finish(codes, texts)``, an index of group codes and columns, over the whole groups of ``by``. Pieces of ``most`` letters that hold a group more than
    eight times are first reduced to ``_few``, so a group of any size is shuffled as a few texts for each piece; sorted partitions are then read as a stream that holds one group's few texts."""
    import pyarrow as pa

    rows = df.select(*by, F.col(column).alias("_text")).where(F.length("_text") > 0)
    keys = ", ".join(f"`{c}` {t}" for c, t in rows.select(*by).dtypes)
    names = list(by)

    def coded(batch) -> np.ndarray:
        codes = np.zeros(batch.num_rows, np.int64)
        for c in names:
            of = batch.column(c).dictionary_encode(null_encoding="encode")
            codes = np.unique(codes * len(of.dictionary) + of.indices.to_numpy(), return_inverse=True)[1]
        return codes

    def pieces(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("_text").to_pandas().str.len().to_numpy(np.int64))
            cuts = np.flatnonzero(np.diff(ends // most)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if j > i:
                    yield batch.slice(i, j - i)

    def few(batch):
        """The piece reduced, groups in order of their codes."""
        codes = coded(batch)
        group, texts = _few(codes, batch.column("_text").to_pandas())
        at = np.unique(codes, return_index=True)[1]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at[group])) for c in names), pa.array(texts, batch.schema.field("_text").type)], schema=batch.schema)

    def reduce(batches):
        for batch in pieces(batches):
            yield few(batch) if np.bincount(coded(batch)).max() > 8 else batch  # little to gain where groups are scattered

    def whole(batches):
        held = None
        for batch in pieces(batches):
            if held is not None:
                batch = pa.concat_batches([held, batch])
            codes = coded(batch)
            cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
            held = few(batch.slice(cut))  # the last group may go on
            if cut:
                yield batch.slice(0, cut)
        if held is not None:
            yield held

    def last(batches):
        for batch in whole(batches):
            codes = coded(batch)
            group, columns = finish(codes, batch.column("_text").to_pandas())
            at = np.unique(codes, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at[group])) for c in names), *columns.values()], names=[*names, *columns])

    reduced = rows.mapInArrow(reduce, rows.schema)
    sorted_rows = reduced.repartition(*by).sortWithinPartitions(*by) if by else reduced.mapInArrow(whole, rows.schema).repartition(1)
    return sorted_rows.mapInArrow(last, ", ".join(filter(None, [keys, out])))


def conserved(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Positions with a single residue, X and gaps aside; within each group of ``by`` (columns of plain types)."""

    def single(codes, texts):
        import pyarrow as pa

        letters, first, group, pos = _cells(codes, texts)
        cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(letters))))
        keep = (letters != ord("X")) & (letters != ord("-"))
        letters, cell = letters[keep], cell[keep]
        alone = np.bincount(cell, minlength=len(first))[cell] == 1
        letters, cell = letters[alone], cell[alone]
        return group[cell], {"pos": pa.array((pos[cell] + 1).astype(np.int32)), "aa": pa.array(letters.astype(np.uint32).view("<U1") if len(letters) else [], pa.string())}

    return _by_group(df, column, by, single, "pos int, aa string")


def class_regex(df: DataFrame, column: str, *by: str) -> DataFrame:
    """A regex that fits all strings (of each group of ``by``, columns of plain types): the letter, or the sorted class, at each position."""

    def regex(codes, texts):
        import pyarrow as pa

        letters, first, group, _ = _cells(codes, texts)
        text, ends = letters.astype(np.uint32).tobytes().decode("utf-32-le"), [*first[1:].tolist(), len(letters)]
        parts = [text[i:j] if j - i == 1 else f"[{text[i:j]}]" for i, j in zip(first.tolist(), ends, strict=True)]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        return group[begin], {"regex": pa.array(["".join(parts[i:j]) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(parts)], strict=True)], pa.string())}

    rows = _by_group(df, column, by, regex, "regex string")
    return rows if by else rows.agg(F.coalesce(F.max("regex"), F.lit("")).alias("regex"))


# ---------------------------------------------------------------- the whole info report
def labelled(seqs: DataFrame) -> DataFrame:
    """A row of each sequence for everything it counts in: ``Total``, its type, and a B type with its lineage."""
    labels = F.array_compact(F.array(F.lit("Total"), F.col("virus_type"), F.when((F.col("virus_type") == "B") & (F.col("lineage") != ""), F.concat("virus_type", "lineage"))))
    return seqs.select(F.explode(labels).alias("label"), *seqs.columns)


def info_periods(seqs: DataFrame, date: Column) -> DataFrame:
    """label, period (a month, or a year and ``all``): sequences and matched ones; undated ones are left out."""
    rows = labelled(seqs).where(date != "").select("label", (F.size("hi_names") > 0).alias("hit"), F.explode(F.array(F.substring(date, 1, 7), F.concat(F.substring(date, 1, 4), F.lit("all")))).alias("period"))
    return rows.groupBy("label", "period").agg(F.count(F.lit(1)).alias("seqs"), F.count_if("hit").alias("matched"))


def info_clades(seqs: DataFrame) -> DataFrame:
    """label, kind (``clade`` or ``set``), value: sequences of each clade, and of each set of clades."""
    each = F.transform("clades", lambda c: F.struct(F.lit("clade").alias("kind"), c.alias("value")))
    whole = F.array(F.struct(F.lit("set").alias("kind"), F.array_join("clades", " ").alias("value")))
    rows = labelled(seqs).where(F.size("clades") > 0).select("label", F.explode(F.concat(each, whole)).alias("x"))
    return rows.groupBy("label", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("seqs"))


def clade_report(seqs: DataFrame, clade: str, date: Column, lab: Column, name: Column) -> DataFrame:
    """name, date, lab of the sequences of a clade (``all``: of every one), by date."""
    rows = seqs if clade == "all" else seqs.where(F.array_contains("clades", clade))
    return rows.select(name.alias("name"), date.alias("date"), lab.alias("lab")).orderBy("date", "name")
