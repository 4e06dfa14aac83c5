"""The nested JSON database (xz or plain): one object with a version and an array of entries under one-letter keys."""

from __future__ import annotations

import io
import json
import lzma
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

VERSION = "sequence-database-v2"
# The file's keys.
_SEQ = (
    "struct<a:string,A:string,c:array<string>,g:string,h:array<string>,l:map<string,array<string>>,n:string,p:array<string>,r:array<string>,s:int,t:int,st:string,"
    "G:struct<i:array<string>,S:array<string>,s:array<string>,m:array<string>,o:array<string>,n:array<string>,t:array<string>,D:array<string>,d:array<string>>>"
)
_ENTRY = f"struct<N:string,d:array<string>,C:string,c:string,l:string,v:string,s:array<{_SEQ}>>"


class _Text:
    """A text read piece by piece, of which JSON values are taken from the front; only what the next value needs is held."""

    def __init__(self, content: bytes, size: int):
        raw = io.BytesIO(content)
        self.source = io.TextIOWrapper(lzma.open(raw) if content[:6] == b"\xfd7zXZ\x00" else raw, "utf-8")
        self.size, self.held, self.at, self.decoder = size, "", 0, json.JSONDecoder()

    def _more(self, n: int) -> bool:
        piece = self.source.read(n)
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def peek(self) -> str:
        """The next character behind blanks; '' at the end."""
        while True:
            rest = _BLANKS.match(self.held, self.at).end()
            self.at = rest
            if rest < len(self.held):
                return self.held[rest]
            if not self._more(self.size):
                return ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if got not in wanted or not got:
            raise ValueError(f"not a database file: {got!r} instead of {' or '.join(wanted)}")
        self.at += 1
        return got

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        n = self.size
        while True:
            try:
                end = self.decoder.raw_decode(self.held, self.at)[1]
                if end < len(self.held) or not self._more(n):  # a number may go on
                    begin, self.at = self.at, end if end <= len(self.held) else len(self.held)
                    return self.held[begin : self.at]
            except json.JSONDecodeError:
                if not self._more(n):
                    raise
            n *= 2


_BLANKS = re.compile(r"[ \t\r\n]*")


def _members(content: bytes, size: int = 1 << 20) -> Iterator[tuple[str, str]]:
    """(key, JSON text) of the file's members; ``data`` comes entry by entry."""
    text = _Text(content, size)
    text.take("{")
    while text.peek() != "}":
        key = json.loads(text.value())
        text.take(":")
        if key == "data":
            text.take("[")
            while text.peek() != "]":
                yield key, text.value()
                if text.peek() != "]":
                    text.take(",")
            text.take("]")
        else:
            yield key, text.value()
        if text.peek() != "}":
            text.take(",")
    text.take("}")


def _entries(ignore_errors: bool, most: int = 500):
    """The entries of whole files, ``most`` at a time. The version is looked for first, wherever in the file it stands."""

    def read(batches):
        for batch in batches:
            for content in map(bytes, batch["content"]):
                lines = []
                try:
                    version = next((json.loads(v) for k, v in _members(content) if k == "  version"), None)
                    if version != VERSION:
                        raise ValueError(f"unsupported database version: {version}")
                    for key, value in _members(content):
                        lines += [value] if key == "data" else []
                        if len(lines) >= most:
                            yield pd.DataFrame({"value": lines})
                            lines = []
                except (ValueError, EOFError, lzma.LZMAError):
                    if not ignore_errors:
                        raise
                if lines:
                    yield pd.DataFrame({"value": lines})

    return read


def read_database(spark: SparkSession, path: str, ignore_errors: bool = False, compatible: bool = False) -> DataFrame:
    """Entries of all database files under ``path``. A file is unpacked and cut into entries piece by piece, so its size in memory is that of the packed file.
    A file of another version or with broken JSON is an error; with ``ignore_errors`` the one gives nothing, the other the entries before the break.

    Keys differ by case only, so they are decoded under a case-sensitive session and renamed at once. ``compatible``
    reads an absent shift as 0 (aligned), as files without ``st`` mean it; otherwise it is untried.
    """
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_entries(ignore_errors), "value string")
        e = lines.select(F.from_json("value", _ENTRY).alias("e"))
        shift = lambda s, k: F.coalesce(s[k], F.lit(0)) if compatible else s[k]
        status = lambda s: F.coalesce(s["st"], F.when(shift(s, "s").isNotNull(), "aligned").otherwise("untried"))
        gisaid = lambda s: F.flatten(F.array_compact(F.array(*(s["G"][k] for k in "iSsmontDd"))))
        seq = lambda s: F.struct(
            s["p"].alias("passages"), s["n"].alias("nuc"), s["a"].alias("aa"), shift(s, "t").alias("nuc_shift"), shift(s, "s").alias("aa_shift"), status(s).alias("align_status"), s["l"].alias("lab_ids"),
            F.coalesce(s["g"], F.lit("HA")).alias("gene"), s["h"].alias("hi_names"), s["A"].alias("annotations"), s["r"].alias("reassortants"), s["c"].alias("clades"), gisaid(s).alias("gisaid"),
        )
        out = e.select(F.col("e.N").alias("name"), F.col("e.v").alias("virus_type"), F.col("e.l").alias("lineage"), F.col("e.c").alias("country"), F.col("e.C").alias("continent"), F.col("e.d").alias("dates"), F.transform("e.s", seq).alias("seqs"))
        return schema.fill(out, schema.ENTRY)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def keep_backup(spark: SparkSession, path: str) -> None:
    """Rename what is at ``path`` to ``path`` with the time of its last change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place):
        changed = datetime.fromtimestamp(store.getFileStatus(place).getModificationTime() / 1000)
        if not store.rename(place, spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{changed:%Y%m%d-%H%M%S}")):
            raise OSError(f"{path} can't be renamed")


def write_database(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines of entries in name order under the same keys, empty values left out; ``read_database_lines`` reads them.
    With ``mode`` backup what is there is renamed first."""
    if mode == "backup":
        keep_backup(entries.sparkSession, path)
        mode = "errorifexists"
    empty = lambda c: F.when(F.size(c) > 0, c)
    said = lambda c: F.nullif(c, F.lit(""))
    seq = lambda s: F.struct(
        said(s["aa"]).alias("a"), said(s["annotations"]).alias("A"), empty(s["clades"]).alias("c"), said(s["gene"]).alias("g"), empty(s["hi_names"]).alias("h"), empty(s["lab_ids"]).alias("l"),
        said(s["nuc"]).alias("n"), empty(s["passages"]).alias("p"), empty(s["reassortants"]).alias("r"), s["aa_shift"].alias("s"), s["nuc_shift"].alias("t"), s["align_status"].alias("st"), empty(s["gisaid"]).alias("gi"),
    )
    rows = entries.select("name", F.to_json(F.struct(
        F.col("name").alias("N"), said(F.col("virus_type")).alias("v"), said(F.col("lineage")).alias("l"), said(F.col("country")).alias("co"), said(F.col("continent")).alias("ct"),
        empty(F.col("dates")).alias("d"), F.transform("seqs", seq).alias("s"),
    ), {"ignoreNullFields": "true"}).alias("value"))
    rows.repartitionByRange("name").sortWithinPartitions("name").select("value").write.mode(mode).option("compression", "gzip").text(path)


def export_database(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Database files for exchange, each an object with version, date and entries in name order (as many files as partitions; ``coalesce(1)``
    before makes one). Shifts are written where aligned, annotations and gisaid values (all as one list, under ``i``) where there are any; ``read_database`` reads them."""
    spark = entries.sparkSession
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        some = lambda c: F.when(F.size(c) > 0, c)
        said = lambda c: F.nullif(c, F.lit(""))
        aligned = lambda s, c: F.when(s["align_status"] == "aligned", s[c])
        seq = lambda s: F.struct(
            some(s["passages"]).alias("p"), said(s["nuc"]).alias("n"), said(s["aa"]).alias("a"), aligned(s, "nuc_shift").alias("t"), aligned(s, "aa_shift").alias("s"), some(s["lab_ids"]).alias("l"),
            said(s["gene"]).alias("g"), some(s["hi_names"]).alias("h"), some(s["reassortants"]).alias("r"), some(s["clades"]).alias("c"),
            said(s["annotations"]).alias("A"), F.when(F.size(s["gisaid"]) > 0, F.struct(s["gisaid"].alias("i"))).alias("G"),
        )
        line = F.to_json(F.struct(
            F.col("name").alias("N"), said(F.col("continent")).alias("C"), said(F.col("country")).alias("c"), some(F.col("dates")).alias("d"), said(F.col("lineage")).alias("l"),
            said(F.col("virus_type")).alias("v"), F.transform("seqs", seq).alias("s"),
        ), {"ignoreNullFields": "true"})
        rows = entries.select("name", line.alias("value")).repartitionByRange("name").sortWithinPartitions("name").select("value")
        head = f'{{"  version": "{VERSION}", "  date": "{datetime.now():%Y-%m-%d %H:%M:%S}", "data": ['

        def wrap(batches):
            last = None
            for batch in batches:
                lines = batch["value"].tolist()
                if lines:
                    opened = [head] if last is None else [last + ","]
                    yield pd.DataFrame({"value": [*opened, *(x + "," for x in lines[:-1])]})
                    last = lines[-1]
            if last is not None:
                yield pd.DataFrame({"value": [last, "]}"]})

        rows.mapInPandas(wrap, "value string").write.mode(mode).text(path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def read_database_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_database`` wrote."""
    seq = "struct<a:string,A:string,c:array<string>,g:string,h:array<string>,l:map<string,array<string>>,n:string,p:array<string>,r:array<string>,s:int,t:int,st:string,gi:array<string>>"
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        e = spark.read.text(path).select(F.from_json("value", f"struct<N:string,v:string,l:string,co:string,ct:string,d:array<string>,s:array<{seq}>>").alias("e"))
        made = lambda s: F.struct(
            s["p"].alias("passages"), s["n"].alias("nuc"), s["a"].alias("aa"), s["t"].alias("nuc_shift"), s["s"].alias("aa_shift"), s["st"].alias("align_status"), s["l"].alias("lab_ids"), s["g"].alias("gene"),
            s["h"].alias("hi_names"), s["A"].alias("annotations"), s["r"].alias("reassortants"), s["c"].alias("clades"), s["gi"].alias("gisaid"),
        )
        out = e.select(F.col("e.N").alias("name"), F.col("e.v").alias("virus_type"), F.col("e.l").alias("lineage"), F.col("e.co").alias("country"), F.col("e.ct").alias("continent"), F.col("e.d").alias("dates"), F.transform("e.s", made).alias("seqs"))
        return schema.fill(out, schema.ENTRY)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
