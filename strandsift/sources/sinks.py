"""Exports: FASTA, PHYLIP, bioseq, CSV, per-position JSON, an HTML table."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, ordering


def fasta_lines(df: DataFrame, wrap: int = 0, encode: bool = False) -> DataFrame:
    """``name, sequence`` rows as FASTA text (column value), order kept by the caller's sort."""
    name = F.url_encode("name") if encode else F.col("name")
    seq = F.rtrim(F.regexp_replace("sequence", f"(.{{{wrap}}})", "$1\n"), F.lit("\n")) if wrap else F.col("sequence")
    return df.withColumn("value", F.concat(F.lit(">"), name, F.lit("\n"), seq))


def write_fasta(df: DataFrame, path: str, *order: str, wrap: int = 0, encode: bool = False) -> None:
    rows = fasta_lines(df, wrap, encode)
    (rows.orderBy(*order) if order else rows).select("value").write.text(path)


def phylip_lines(df: DataFrame, *order: str) -> DataFrame:
    """ord, value: a header line ``n longest``, then padded names and sequences."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sequence")).alias("m"), F.max(F.length("name")).alias("w"))
    rows = df.crossJoin(F.broadcast(total)).select(F.struct(F.lit(1).alias("part"), *order).alias("ord"), F.concat(F.rpad("name", F.col("w"), F.lit(" ")), F.lit("  "), F.rpad("sequence", F.col("m"), F.lit("-"))).alias("value"))
    head = total.select(F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.concat_ws(" ", F.col("n").cast("string"), F.col("m").cast("string")).alias("value"))
    return head.unionByName(rows).orderBy(F.col("ord").asc_nulls_first())


def bioseq_lines(df: DataFrame, *order: str) -> DataFrame:
    """Numbered names, then numbered sequences."""
    rows = ordering.numbered(df, *order)
    block = lambda part, c: rows.select(F.lit(part).alias("part"), "k", F.format_string("%03d>%s", "k", F.col(c)).alias("value"))
    return block(0, "name").unionByName(block(1, "sequence")).orderBy("part", "k").select("value")


def write_csv(df: DataFrame, path: str, coordinates: str | None = None, dimensions: int = 2) -> None:
    """Rows as CSV with a header; an array of coordinates becomes one column for each dimension."""
    if coordinates:
        df = df.select(*(c for c in df.columns if c != coordinates), *(F.get(coordinates, F.lit(k)).alias(f"coord_{k}") for k in range(dimensions)))
    df.write.option("header", True).csv(path)


def positions_json(df: DataFrame, column: str) -> DataFrame:
    """One JSON object a position: residue counts and Shannon index."""
    counts = aggregates.composition(df, column)
    per = counts.groupBy("pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aa", "n")))).alias("counts"))
    return per.join(aggregates.shannon(counts), "pos").select("pos", F.to_json(F.struct("pos", "shannon", "counts")).alias("value"))


def alignment_html(df: DataFrame, master: str, rows: int = 500) -> str:
    """An HTML table of at most ``rows`` (name, sequence) rows, a middle dot where the residue is the master's; more rows are an error."""
    found = df.select("name", "sequence").orderBy("name").limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows: a page is for few")
    ruler = "".join(f"{k:<10}" for k in range(1, len(master) + 1, 10))[: max(len(master), 1)]
    shown = lambda c: f"<span class='aa{ord(c)}'>{html.escape(c)}</span>"
    colours = "".join(f".aa{ord(c)}{{color:hsl({k * 360 // 26},70%,35%)}}" for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    out = [f"<style>.alignment td{{font-family:monospace;white-space:pre}}{colours}</style>", "<table class='alignment'>", f"<tr><th></th><td>{ruler}</td></tr>", f"<tr><th>master</th><td>{''.join(map(shown, master))}</td></tr>"]
    for r in found:
        cells = "".join("&middot;" if k < len(master) and c == master[k] else shown(c) for k, c in enumerate(r["sequence"]))
        out.append(f"<tr><th>{html.escape(r['name'])}</th><td>{cells}</td></tr>")
    return "\n".join([*out, "</table>"])
