"""Ingest of FASTA files as they arrive in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources import fasta_source


def stream_records(spark: SparkSession, directory: str, strict: bool = True) -> DataFrame:
    """A streaming frame of name, sequence from new files, parsed as ``read_fasta`` does; a bad record is an error, or left out."""
    raw = fasta_source.register(spark).readStream.format("fasta").load(directory)
    if not strict:
        return raw.where("error IS NULL").select("name", "sequence")
    message = F.concat_ws(" ", "file", F.col("offset").cast("string"), "error")
    return raw.select("name", F.when(F.col("error").isNull(), F.col("sequence")).otherwise(F.raise_error(message)).alias("sequence"))


def ingest(records: DataFrame, table: str, checkpoint: str, lab: str = "", virus_type: str = "") -> StreamingQuery:
    """Align each batch and append it to a Parquet table of records; the merge by name runs over that table when it is read."""
    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.withColumns({c: F.lit(v) for c, v in (("date", ""), ("passage", ""), ("reassortant", ""), ("lab", lab), ("lab_id", ""), ("virus_type", virus_type), ("lineage", ""), ("gene", ""))})
        rows = rows.withColumns({"file_no": F.lit(epoch).cast("int"), "record_no": F.monotonically_increasing_id()})
        merge.align_records(merge.normalize_records(rows)).write.mode("append").parquet(table)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
