"""The data model: entries that own sequences, and the flattened view of one row a sequence.

Absent values are '' and empty arrays, never null (nulls are filled on reading). ``shift`` is null
unless ``align_status`` is ``aligned``; the other states are ``failed`` and ``untried``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
SEQ = T.StructType([
    T.StructField("passages", STRINGS), T.StructField("nuc", T.StringType()), T.StructField("aa", T.StringType()),
    T.StructField("nuc_shift", T.IntegerType()), T.StructField("aa_shift", T.IntegerType()), T.StructField("align_status", T.StringType()),
    T.StructField("lab_ids", T.MapType(T.StringType(), STRINGS)), T.StructField("gene", T.StringType()), T.StructField("hi_names", STRINGS),
    T.StructField("annotations", T.StringType()), T.StructField("reassortants", STRINGS), T.StructField("clades", STRINGS), T.StructField("gisaid", STRINGS),
])
ENTRY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("virus_type", T.StringType()), T.StructField("lineage", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("continent", T.StringType()), T.StructField("dates", STRINGS), T.StructField("seqs", T.ArrayType(SEQ)),
])


def _empty(kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def fill(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, absent ones and nulls empty."""
    return df.select(*(F.coalesce(F.col(f.name).cast(f.dataType), _empty(f.dataType)).alias(f.name) if f.name in df.columns else _empty(f.dataType).alias(f.name) for f in schema))


def flatten(entries: DataFrame) -> DataFrame:
    """A row for each sequence: the entry's columns, seq_no (from 0) and the sequence's columns."""
    rows = entries.select("name", "virus_type", "lineage", "country", "continent", "dates", F.posexplode("seqs").alias("seq_no", "seq"))
    return fill(rows.select("name", "virus_type", "lineage", "country", "continent", "dates", "seq_no", "seq.*"), T.StructType([*ENTRY.fields[:-1], T.StructField("seq_no", T.IntegerType()), *SEQ.fields]))


def nest(seqs: DataFrame) -> DataFrame:
    """Entries from the flattened view: sequences by seq_no, dates united."""
    item = F.struct("seq_no", *(f.name for f in SEQ))
    out = seqs.groupBy("name").agg(
        *(F.max(c).alias(c) for c in ("virus_type", "lineage", "country", "continent")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("dates"), F.array_sort(F.collect_list(item), lambda a, b: a["seq_no"] - b["seq_no"]).alias("seqs"),
    )
    return out.withColumn("seqs", F.transform("seqs", lambda s: F.struct(*(s[f.name].alias(f.name) for f in SEQ))))
