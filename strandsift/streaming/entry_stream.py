"""Entries as a stream: records of a name are folded into its entry as they arrive, and every change of an entry goes to a log.

The state of an entry is its records, each under its place (file, offset), in RocksDB; the fold runs over them in the order of
their places, as the merge of a table does, so a record that comes late is put where it belongs and a record that comes twice counts once. A
change is the entry's whole new state under the next version; ``latest`` reads the entries from the log. The state of one name is
folded by one task, as its batch of records is in ``merge.fold_name``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import derived
from ..operators import merge
from ..operators.merge import fold_name
from ..sources import fasta, fasta_source

LOG = merge.MERGED + ", version long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(v):
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


class Entries(StatefulProcessor):
    """Keyed by name: its records, and the number and digest of its last version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "file string, offset long", "record string")
        self.last = handle.getValueState("last", "version long, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.to_dict("records"):
                self.records.updateValue((str(r["file_no"]), int(r["record_no"])), (json.dumps({k: _plain(v) for k, v in r.items()}),))
        entry = fold_name(pd.DataFrame([json.loads(v[0]) for _, v in self.records.iterator()]))
        if not len(entry):  # an entry without sequences: a row that says so
            gone = {"name": key[0], "seq_no": -1}
            entry = pd.DataFrame([[gone.get(c) for c in entry.columns]], columns=entry.columns).astype({"nuc_shift": "Int64", "aa_shift": "Int64"})
        digest = entry.to_json(orient="values")
        version, before = self.last.get() if self.last.exists() else (0, "")
        if digest != before:
            self.last.update((version + 1, digest))
            yield entry.assign(version=version + 1)

    def close(self) -> None:
        pass


def stream_records(spark: SparkSession, directory: str, lab: str = "", virus_type: str = "", lineage: str = "", strict: bool = True) -> DataFrame:
    """Normalised and aligned records of the FASTA files in a directory, placed by file and offset; a bad record is an error, or left out."""
    return _records(fasta_source.register(spark).readStream.format("fasta").load(directory), lab, virus_type, lineage, strict)


def table_records(spark: SparkSession, directory: str, lab: str = "", virus_type: str = "", lineage: str = "", strict: bool = True) -> DataFrame:
    """The same records read as a table."""
    return _records(fasta_source.register(spark).read.format("fasta").load(directory), lab, virus_type, lineage, strict)


def _records(raw: DataFrame, lab: str, virus_type: str, lineage: str, strict: bool) -> DataFrame:
    if strict:
        raw = raw.withColumn("sequence", F.when(F.col("error").isNull(), F.col("sequence")).otherwise(F.raise_error(F.concat_ws(" ", "file", F.col("offset").cast("string"), "error"))))
    else:
        raw = raw.where("error IS NULL")
    rows = fasta.with_headers(raw.select(F.col("file").alias("file_no"), F.col("offset").alias("record_no"), "name", "sequence"), lab, virus_type, lineage)
    return merge.align_records(merge.normalize_records(rows))


def changes(records: DataFrame) -> DataFrame:
    """A row for each sequence of each new version of an entry (schema LOG)."""
    for module in (sys.modules[__name__], merge, derived):  # the driver's state runner is a process without the package
        cloudpickle.register_pickle_by_value(module)
    return records.groupBy("name").transformWithStateInPandas(statefulProcessor=Entries(), outputStructType=LOG, outputMode="Append", timeMode="None")


def ingest(records: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append the changes that new records make to the log (Parquet); a restart goes on from the checkpoint."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changes(records).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """The entries (``merge.MERGED``): each name's last version, entries without sequences left out."""
    last = log.groupBy("name").agg(F.max("version").alias("version"))
    return log.join(last, ["name", "version"]).where("seq_no >= 0").select(*merge._MERGED_NAMES)
