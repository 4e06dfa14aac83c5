"""FASTA as a data source, and records made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

_LETTERS = r"^[A-Za-z\-~:*.]+$"


def read_fasta(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """file_no (of the path in ``paths``), record_no, line_no (of the header), name, sequence of each record.

    A record is a row of Spark's text reader, which splits plain files at ``>`` (any store, any compression it knows); blank
    lines and ``;`` comments are skipped, sequence lines joined, upper-cased, ``/`` becomes ``-``. Records are numbered within
    the reader's blocks, and the blocks' totals add up, so a large file is read by many tasks. A record without name or
    sequence, or with other characters, is an error that names file and line; with ``strict=False`` it gets an ``error`` text.
    """
    parts = [paths] if isinstance(paths, str) else list(paths)
    raw = reduce(DataFrame.unionByName, [spark.read.option("lineSep", "\n>").text(p).select(F.lit(k).alias("file_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value") for k, p in enumerate(parts)])
    raw = raw.withColumn("nth", F.monotonically_increasing_id())
    own = ["file_no", "file", "block"]
    w = Window.partitionBy(*own).orderBy("nth")
    rows = raw.withColumn("row", F.row_number().over(w)).withColumn("opens", (F.col("block") > 0) | (F.col("row") > 1) | F.ltrim("value").startswith(">"))
    # what comes before the first header holds comments, or is a record without a name
    rows = rows.withColumn("lines", F.transform(F.split("value", "\n", -1), lambda t: F.trim(F.rtrim(t, F.lit("\r")))))
    rows = rows.withColumn("skip", F.when(F.col("opens"), F.lit(0)).otherwise(F.size(F.filter("lines", lambda t: (t == "") | t.startswith(";")))))
    rows = rows.withColumn("is_record", F.col("opens") | (F.col("skip") < F.size("lines")))
    rows = rows.withColumns({"k": F.sum(F.col("is_record").cast("long")).over(w), "upto": F.sum(F.size("lines").cast("long")).over(w) - F.size("lines")})
    blocks = rows.groupBy(*own).agg(F.sum(F.col("is_record").cast("long")).alias("n"), F.sum(F.size("lines").cast("long")).alias("m"))
    before = Window.partitionBy("file_no", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(c).alias(f"b_{c}") for c in own), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    rows = rows.where("is_record").join(blocks, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"b_{c}") for c in own]))
    # a header after the first line of its text: comments of the file's beginning
    at = F.array_position(F.transform("lines", lambda t: t.startswith(">")), True)
    head_at = F.when((F.col("block") == 0) & (F.col("row") == 1), at).otherwise(F.lit(1)).cast("int")
    name = F.when(F.col("opens") & (head_at > 0), F.trim(F.regexp_replace(F.element_at("lines", F.greatest(head_at, F.lit(1))), "^>", ""))).otherwise("")
    body = F.filter(F.slice("lines", head_at + 1, F.size("lines")), lambda t: (t != "") & ~t.startswith(";"))
    made = rows.select(
        "file_no", "file", (F.col("n0") + F.col("k")).alias("record_no"), (F.col("m0") + F.col("upto") + F.greatest(head_at, F.lit(1))).cast("long").alias("line_no"),
        name.alias("name"), F.upper(F.replace(F.array_join(body, ""), F.lit("/"), F.lit("-"))).alias("sequence"),
    )
    error = F.when(F.col("name") == "", "no name").when(F.col("sequence") == "", "no sequence").when(~F.col("sequence").rlike(_LETTERS), "invalid characters")
    made = made.withColumn("error", F.when(error.isNotNull(), F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), error)))
    if strict:
        made = made.withColumn("sequence", F.when(F.col("error").isNull(), F.col("sequence")).otherwise(F.raise_error(F.col("error"))))
    return made.select("file_no", "record_no", "line_no", "name", "sequence", *([] if strict else ["error"]))


def with_reassortants(records: DataFrame) -> DataFrame:
    """Upper-cased names, reassortants split off."""
    return records.withColumn("_n", text.split_reassortant(F.upper("name"))).withColumns({"name": F.col("_n.name"), "reassortant": F.col("_n.reassortant")}).drop("_n")


def with_headers(records: DataFrame, lab: str = "", virus_type: str = "", lineage: str = "") -> DataFrame:
    """Records with the fields their headers hold; the arguments fill what is missing."""
    rows = records.withColumn("_h", text.parse_header(F.col("name"), F.lit(lab)))
    field = lambda f, other="": F.coalesce(F.nullif(F.col(f"_h.{f}"), F.lit("")), F.lit(other))
    rows = rows.withColumns({"name": F.col("_h.name"), "date": field("date"), "passage": field("passage"), "lab_id": field("lab_id"), "lab": field("lab", lab), "virus_type": field("virus_type", virus_type), "lineage": field("lineage", lineage), "gene": field("gene")}).drop("_h")
    return with_reassortants(rows)


def with_csv(records: DataFrame, table: DataFrame) -> DataFrame:
    """Records joined to a table by fasta_id, tried as written, without ``_4``, without ``EG.[FR]?_4``, without ``[FR]_4``: each record once, with
    the first of these that the table has; of the table's rows for an id the last counts."""
    rest = [c for c in table.columns if c != "fasta_id"]
    values = table.select("fasta_id", F.struct(F.monotonically_increasing_id().alias("_nth"), F.struct(*rest).alias("_v")).alias("x"))
    values = values.where("fasta_id IS NOT NULL").groupBy("fasta_id").agg(F.max_by("x._v", "x._nth").alias("_v"))
    keys = F.array(F.col("name"), F.regexp_replace("name", "_4$", ""), F.regexp_replace("name", r"EG\d[FR]?_4$", ""), F.regexp_replace("name", "[FR]_4$", ""))
    tried = records.select("name").distinct().select(F.col("name").alias("_name"), F.posexplode(keys).alias("_rank", "fasta_id"))
    hits = tried.join(values, "fasta_id").groupBy("_name").agg(F.min_by("_v", "_rank").alias("_v"))
    out = records.join(hits, F.col("name") == F.col("_name"), "left")
    return out.select(*(records[c] for c in records.columns), *(F.col(f"_v.{c}").alias(c if c not in records.columns else f"csv_{c}") for c in rest))
