"""Queries over the driver's tables, and their SQL.

The star schema is read as a sequence collection: an order is an entry, its lines are its sequences
(64 nucleotides made from md5 digests), nations and regions are places, and priorities stand for
virus types and lineages. Longer made-up proteins come from parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, clades, derived, sequence, text
from ..operators import aggregates, filters, indels, lookups, merge, ordering
from .. import schema
from ..runtime import shared, sized, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- the collection, on both engines
_TYPE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A(H1N1)' WHEN '2' THEN 'A(H3N2)' ELSE 'B' END"
_LINEAGE = "CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'VICTORIA' WHEN '4' THEN 'YAMAGATA' ELSE '' END"
ISO = f"""
iso AS (SELECT o.o_orderkey AS entry_id, concat('A(H3N2)/', n.n_name, '/', cast(o.o_orderkey AS varchar(20)), '/', cast(year(o.o_orderdate) AS varchar(4))) AS name,
  n.n_name AS country, r.r_name AS continent, cast(cast(o.o_orderdate AS date) AS varchar(10)) AS iso_date, l.l_linenumber AS seq_no, concat(l.l_returnflag, l.l_linestatus) AS passage,
  translate(concat(md5(cast(l.l_partkey AS varchar(20))), md5(cast(l.l_suppkey AS varchar(20)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS nuc,
  {_TYPE} AS virus_type, {_LINEAGE} AS lineage, l.l_partkey AS partkey, l.l_suppkey AS suppkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"""
# a protein of 512 letters for each part; the letter - occurs
PROT = """
prot AS (SELECT p_partkey AS id, translate(concat({}), '0123456789abcdef', 'KNYS-RQDTGEVHPIL') AS aa FROM part)""".format(
    ", ".join(f"md5(concat(cast(p_partkey AS varchar(20)), '/{k}'))" for k in range(16))
)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _nuc():
    text_of = lambda x: F.md5(F.col(x).cast("string").cast("binary"))
    return F.translate(F.concat(text_of("l_partkey"), text_of("l_suppkey")), "0123456789abcdef", "ACGTACGTACGTACGT")


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r, l = _tables(spark, sf_dir, "orders", "customer", "nation", "region", "lineitem")
    sized(spark, l.count())
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).join(l, l["l_orderkey"] == o["o_orderkey"])
    text_of = lambda x: F.col(x).cast("string")
    return rows.select(
        F.col("o_orderkey").alias("entry_id"), F.concat(F.lit("A(H3N2)/"), "n_name", F.lit("/"), text_of("o_orderkey"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("name"),
        F.col("n_name").alias("country"), F.col("r_name").alias("continent"), F.to_date("o_orderdate").cast("string").alias("iso_date"), F.col("l_linenumber").alias("seq_no"),
        F.concat("l_returnflag", "l_linestatus").alias("passage"), _nuc().alias("nuc"),
        F.expr(_TYPE).alias("virus_type"), F.expr(_LINEAGE).alias("lineage"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
    )


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection in the flattened schema: even parts have a laboratory name, one lab each by supplier."""
    i = isolates(spark, sf_dir)
    lab = F.when(F.col("suppkey") % 3 == 0, "CDC").when(F.col("suppkey") % 3 == 1, "NIMR").otherwise("MELB")
    made = i.withColumns({
        "dates": F.array("iso_date"), "passages": F.array("passage"), "lab_ids": F.create_map(lab, F.array(F.col("partkey").cast("string"))), "aa": F.lit(""), "gene": F.lit("HA"),
        "hi_names": F.when(F.col("partkey") % 2 == 0, F.array(F.concat_ws(" ", "name", "passage"))).otherwise(F.array().cast("array<string>")), "clades": F.array_distinct(F.array(F.substring("passage", 1, 1), F.substring("passage", 2, 1))),
        "align_status": F.when(F.col("partkey") % 5 == 0, "failed").otherwise("aligned"), "nuc_shift": (F.col("partkey") % 3 - 1).cast("int"),
    })
    keep = [f.name for f in schema.ENTRY if f.name != "seqs"] + ["seq_no"] + [f.name for f in schema.SEQ]
    from pyspark.sql import types as T

    full = schema.fill(made, T.StructType([*schema.ENTRY.fields[:-1], T.StructField("seq_no", T.IntegerType()), *schema.SEQ.fields]))
    return full.select(*keep)


SEQS = f"""{ISO},
seqs AS (SELECT *, CASE suppkey % 3 WHEN 0 THEN 'CDC' WHEN 1 THEN 'NIMR' ELSE 'MELB' END AS lab, cast(partkey AS varchar(20)) AS lab_id, partkey % 2 = 0 AS has_hi,
  concat(name, ' ', passage) AS full_name, CASE WHEN partkey % 5 = 0 THEN 'failed' ELSE 'aligned' END AS align_status, partkey % 3 - 1 AS nuc_shift FROM iso)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- filters
@query("isolates_by_year", f"WITH {ISO} SELECT continent, substr(iso_date, 1, 4) AS year, count(*) AS n FROM iso WHERE iso_date >= '1996-01-01' AND iso_date < '2000-01-01' GROUP BY ALL ORDER BY year DESC, continent")
def _by_year(spark, d):
    """Sequences per continent and year, latest first."""
    rows = isolates(spark, d).where((F.col("iso_date") >= "1996-01-01") & (F.col("iso_date") < "2000-01-01"))  # a plain column, so it is filtered before the joins
    return rows.groupBy("continent", F.substring("iso_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year"), "continent")


_SHOW = ("name", "seq_no", "nuc")


def _filter(name: str, where: str, **how):
    query(name, f"WITH {SEQS} SELECT name, seq_no, nuc FROM seqs WHERE {where}")(lambda spark, d: filters.select(seqs(spark, d), **how).select(*_SHOW))


_filter("filter_type", "virus_type = 'B'", virus_type="B")
_filter("filter_lineage", "lineage = 'YAMAGATA'", lineage="YAMAGATA")
_filter("filter_continent_country", "continent = 'ASIA' AND country = 'NATION_2'", continent="ASIA", country="NATION_2")
_filter("filter_date_range", "iso_date >= '1996-03-01' AND iso_date < '1997-01-01'", begin="1996-03-01", end="1997-01-01")
_filter("filter_lab", "lab = 'CDC'", lab="CDC")
_filter("filter_lab_id", "lab = 'NIMR' AND lab_id = '100'", lab_id=("NIMR", "100"))
_filter("filter_aligned_gene", "align_status = 'aligned'", aligned=True, gene="HA")
_filter("filter_clade", "contains(passage, 'R')", clade="R")
_filter("filter_hi_name", "has_hi", hi_name=True)
_filter("filter_name_regex", "regexp_matches(concat(name, ' ', passage), '/1[0-9]*5/.*r', 'i')", name_regex="/1[0-9]*5/.*r")


@query("filter_date_prefix", f"WITH {SEQS} SELECT name, seq_no, nuc FROM seqs WHERE iso_date LIKE '1998-07%'")
def _date_prefix(spark, d):
    return seqs(spark, d).where(filters.date_prefix(F.col("dates"), "1998-07")).select(*_SHOW)


@query("filter_list_contains", f"WITH {SEQS} SELECT name, count(*) AS n FROM seqs GROUP BY name HAVING bool_or(passage = 'RF') AND bool_or(passage = 'AF')")
def _list(spark, d):
    per = seqs(spark, d).groupBy("name").agg(F.collect_set(derived.first(F.col("passages"))).alias("p"), F.count(F.lit(1)).alias("n"))
    return per.where(filters.matches_or_empty(F.col("p"), "RF") & filters.matches_or_empty(F.col("p"), "AF")).select("name", "n")


@query("filter_residue_at", f"WITH {PROT} SELECT id, substr(aa, 158, 2) AS aa FROM prot WHERE substr(aa, 158, 1) = 'N' AND substr(aa, 159, 1) = 'Y'")
def _residue(spark, d):
    return filters.residues(proteins(spark, d).withColumn("aa_shift", F.lit(0)), "158N 159Y").select("id", F.substring("aa", 158, 2).alias("aa"))


def proteins(spark, d) -> DataFrame:
    part = spread(_tables(spark, d, "part")[0].select("p_partkey"), "p_partkey")  # 10 MB of keys are 600 MB of letters
    return part.select(F.col("p_partkey").alias("id"), _letters("p_partkey").alias("aa"))


def _letters(part: str) -> Column:
    """The protein of a part."""
    key = F.col(part).cast("string")
    return F.translate(F.concat(*(F.md5(F.concat(key, F.lit(f"/{k}")).cast("binary")) for k in range(16))), "0123456789abcdef", "KNYS-RQDTGEVHPIL")


@query("hamming_below", f"WITH {ISO}, b AS (SELECT min(nuc) AS base FROM iso), h AS (SELECT name, seq_no, nuc, base FROM iso, b) SELECT name, seq_no, hamming(nuc, base)::INT AS hd FROM h WHERE hamming(nuc, base) < 40")
def _hamming(spark, d):
    least = _tables(spark, d, "lineitem")[0].agg(F.min(_nuc()).alias("base"))  # every line is in the collection: no need to join for this
    rows = isolates(spark, d).select("name", "seq_no", "nuc").crossJoin(F.broadcast(least))
    return rows.select("name", "seq_no", sequence.hamming_bulk("nuc", "base").alias("hd")).where("hd < 40")


@query("hamming_report", f"WITH {ISO}, b AS (SELECT min(nuc) AS base FROM iso) SELECT DISTINCT nuc, hamming(nuc, base)::INT AS hd FROM iso, b ORDER BY hd DESC, nuc LIMIT 100")
def _hamming_report(spark, d):
    i = isolates(spark, d).select("nuc").distinct()
    rows = i.crossJoin(F.broadcast(i.agg(F.min("nuc").alias("base"))))
    return rows.select("nuc", sequence.hamming_bulk(F.col("nuc"), F.col("base")).alias("hd")).orderBy(F.desc("hd"), "nuc").limit(100)


@query("drop_short", f"WITH {PROT} SELECT id FROM prot WHERE length(replace(aa, '-', '')) >= 480")
def _short(spark, d):
    rows = proteins(spark, d).withColumns({"aa": F.when(F.length(F.replace("aa", F.lit("-"), F.lit(""))) >= 480, F.col("aa")).otherwise(F.substring("aa", 1, 399)), "nuc": F.lit("")})
    return filters.drop_short(rows).select("id")


@query("extract_names", "WITH w AS (SELECT n_nationkey AS want_no, n_name AS want FROM nation), r AS (SELECT c_custkey AS record_no, concat(n_name, ' ', c_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT record_no, name, min(want_no) AS want_no FROM r JOIN w ON contains(name, want) GROUP BY ALL) SELECT want_no::INT AS want_no, arg_max(name, record_no) AS name FROM f GROUP BY want_no")
def _extract(spark, d):
    c, n = _tables(spark, d, "customer", "nation")
    records = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("record_no"), F.concat_ws(" ", "n_name", "c_name").alias("name"), F.lit("").alias("sequence"))
    return filters.extract(records, F.broadcast(n.select(F.col("n_nationkey").alias("want_no"), F.col("n_name").alias("want")))).select("want_no", "name")


# ---------------------------------------------------------------- lookups and joins
@query("lookup_name", f"WITH {SEQS} SELECT name, seq_no, nuc FROM seqs WHERE name = (SELECT min(name) FROM seqs)")
def _lookup(spark, d):
    s = seqs(spark, d)
    return s.join(F.broadcast(s.agg(F.min("name").alias("name"))), "name").select(*_SHOW)


@query("lookup_seq_id_nth", f"WITH {SEQS}, k AS (SELECT name, passage, min(seq_no) AS a, count(DISTINCT seq_no) AS kinds, count(*) AS n FROM seqs GROUP BY ALL) SELECT concat(name, '__', passage, '__0') AS seq_id, name, a::INT AS seq_no FROM k")
def _nth(spark, d):
    s = seqs(spark, d)
    ids = s.select(F.concat(F.col("name"), F.lit("__"), derived.first(F.col("passages")), F.lit("__0")).alias("seq_id")).distinct()
    return lookups.by_seq_id(s, ids)


@query("hi_name_lookup", f"WITH {SEQS}, x AS (SELECT full_name AS hi_name, min(seq_no)::INT AS seq_no FROM seqs WHERE has_hi GROUP BY 1), w AS (SELECT DISTINCT concat(name, ' NF') AS hi_name FROM seqs) SELECT w.hi_name, seq_no FROM w LEFT JOIN x USING (hi_name)")
def _hi(spark, d):
    s = seqs(spark, d)
    return lookups.by_hi_name(s, s.select(F.concat("name", F.lit(" NF")).alias("hi_name")).distinct()).select("hi_name", "seq_no")


_ANTIGENS = """ag AS (SELECT c_custkey AS ag_no, o_orderkey, concat('A(H3N2)/', n_name, '/', cast(o_orderkey AS varchar(20)), '/', cast(year(o_orderdate) AS varchar(4))) AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'RF' WHEN 1 THEN 'NO' ELSE '' END AS passage, CASE c_custkey % 2 WHEN 0 THEN 'B' ELSE 'A(H3N2)' END AS virus_type, CASE c_custkey % 5 WHEN 0 THEN 'VICTORIA' ELSE '' END AS lineage
  FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY 1) ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def antigens(spark, d) -> DataFrame:
    c, o, n = _tables(spark, d, "customer", "orders", "nation")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderdate", "o_orderkey").alias("o_orderdate"))
    rows = c.join(last, c["c_custkey"] == last["o_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    k = F.col("c_custkey")
    rows = rows.select(k.alias("ag_no"), F.concat(F.lit("A(H3N2)/"), "n_name", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("name"), F.when(k % 3 == 0, "RF").when(k % 3 == 1, "NO").otherwise("").alias("passage"), F.when(k % 2 == 0, "B").otherwise("A(H3N2)").alias("virus_type"), F.when(k % 5 == 0, "VICTORIA").otherwise("").alias("lineage"), F.lit("").alias("reassortant"))
    return rows.withColumns({"full_name": F.concat_ws(" ", "name", "passage"), "alt_name": F.concat_ws(" ", F.col("name"), F.lit("AF"))})


_MATCH = f"""{SEQS}, {_ANTIGENS},
hix AS (SELECT full_name AS h, min(struct_pack(name := name, seq_no := seq_no)) AS m FROM seqs WHERE has_hi GROUP BY 1),
info AS (SELECT DISTINCT name, virus_type, lineage FROM seqs),
m3 AS (SELECT ag_no, max(struct_pack(name := s.name, seq_no := s.seq_no)) AS m FROM ag JOIN seqs s ON s.name = ag.name WHERE ag.passage = '' GROUP BY 1),
mm AS (SELECT ag.*, coalesce(a.m, b.m, c.m) AS m FROM ag LEFT JOIN hix a ON a.h = concat(ag.name, ' ', ag.passage) LEFT JOIN hix b ON b.h = concat(ag.name, ' AF') LEFT JOIN m3 c ON c.ag_no = ag.ag_no),
matched AS (SELECT mm.ag_no, CASE WHEN i.virus_type = mm.virus_type AND (mm.lineage = '' OR mm.lineage = i.lineage) THEN mm.m.name END AS matched_name,
  CASE WHEN i.virus_type = mm.virus_type AND (mm.lineage = '' OR mm.lineage = i.lineage) THEN mm.m.seq_no END AS matched_no FROM mm LEFT JOIN info i ON i.name = mm.m.name)"""


@query("match_priority", f"WITH {_MATCH} SELECT ag_no, matched_name, matched_no FROM matched")
def _match(spark, d):
    s = seqs(spark, d)
    whole = s.groupBy("name", "seq_no").agg(F.first("virus_type").alias("virus_type"), F.first("lineage").alias("lineage"), F.flatten(F.collect_list("hi_names")).alias("hi_names"), F.flatten(F.collect_list("reassortants")).alias("reassortants"))
    return lookups.match_antigens(whole, antigens(spark, d)).select("ag_no", "matched_name", "matched_no")


@query("serum_clades", f"WITH {_MATCH}, cl AS (SELECT name, seq_no, unnest([substr(passage, 1, 1), substr(passage, 2, 1)]) AS c FROM seqs) SELECT (ag_no % 100)::BIGINT AS sr_no, array_to_string(list_sort(list(DISTINCT c)), ' ') AS clades FROM matched JOIN cl ON cl.name = matched_name AND cl.seq_no = matched_no GROUP BY 1")
def _sera(spark, d):
    s = seqs(spark, d)
    whole = s.groupBy("name", "seq_no").agg(F.first("virus_type").alias("virus_type"), F.first("lineage").alias("lineage"), F.flatten(F.collect_list("hi_names")).alias("hi_names"), F.flatten(F.collect_list("reassortants")).alias("reassortants"), F.array_distinct(F.flatten(F.collect_list("clades"))).alias("clades"))
    a = antigens(spark, d)
    sera = a.groupBy((F.col("ag_no") % 100).alias("sr_no")).agg(F.collect_list("ag_no").alias("homologous"))
    return lookups.serum_clades(sera, lookups.match_antigens(whole, a), whole).select("sr_no", F.array_join("clades", " ").alias("clades"))


@query("anti_unmatched", f"WITH {SEQS} SELECT name, count(*) AS n_seqs FROM seqs GROUP BY name HAVING count(*) FILTER (has_hi) = 0")
def _anti(spark, d):
    return lookups.unmatched(seqs(spark, d)).where("n_matched = 0").select("name", "n_seqs")


@query("partial_matched", f"WITH {SEQS} SELECT name, count(*) AS n_seqs, count(*) FILTER (has_hi) AS n_matched FROM seqs GROUP BY name HAVING count(*) FILTER (has_hi) BETWEEN 1 AND count(*) - 1")
def _partial(spark, d):
    return lookups.unmatched(seqs(spark, d)).where("n_matched > 0")


@query("orders_without_lines", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _empty_entries(spark, d):
    o, l = _tables(spark, d, "orders", "lineitem")
    return lookups.without_present(o.select(F.col("o_orderkey").alias("name")), l.select(F.col("l_orderkey").alias("name"))).select(F.col("name").alias("o_orderkey"))


@query("fallback_names", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN concat('A/', n_name, '/', c_mktsegment, '-', cast(c_custkey AS varchar(20)), '/2009') ELSE concat('A/', n_name, '/', cast(c_custkey AS varchar(20)), '/2009') END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _fallback(spark, d):
    c, n = _tables(spark, d, "customer", "nation")
    number = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("/", F.col("c_mktsegment"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.select("c_custkey", lookups.fallback_name(F.concat(F.lit("A/"), "n_name", F.lit("/"), number, F.lit("/2009"))).alias("name"))


@query("greedy_match", f"WITH {SEQS}, a AS (SELECT DISTINCT name, passage, full_name FROM seqs WHERE has_hi) SELECT a.name, min(s.seq_no)::INT AS seq_no, a.full_name, 100 AS score FROM a JOIN seqs s ON s.name = a.name AND s.passage = a.passage GROUP BY ALL")
def _greedy(spark, d):
    s = seqs(spark, d)
    ags = s.where(F.size("hi_names") > 0).select("name", F.col("hi_names")[0].alias("full_name"), derived.first(F.col("passages")).alias("passage"), F.lit("").alias("reassortant")).distinct()
    return lookups.assign_antigens(shared(lookups.best_by_antigen(s, ags)))  # counted and gone through


@query("assign_scores", """WITH RECURSIVE p AS (SELECT l_orderkey AS name, l_linenumber::INT AS seq_no, concat('F', k) AS full_name, ((l_partkey * (k + 3) + l_suppkey) % 6 * 10)::INT AS score FROM lineitem, (SELECT unnest(range(0, 5)) AS k)),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, full_name, seq_no) AS n FROM p),
f AS (SELECT name, n, [full_name] AS taken, [seq_no] AS seqs, [score] AS scores, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT name, n, CASE WHEN kept THEN list_append(taken, full_name) ELSE taken END, CASE WHEN kept THEN list_append(seqs, seq_no) ELSE seqs END, CASE WHEN kept THEN list_append(scores, score) ELSE scores END, kept
  FROM (SELECT f.name, o.n, taken, seqs, scores, o.full_name, o.seq_no, o.score, NOT list_contains(taken, o.full_name) AND (NOT list_contains(seqs, o.seq_no) OR scores[list_position(seqs, o.seq_no)] = o.score) AS kept
    FROM f JOIN o ON o.name = f.name AND o.n = f.n + 1))
SELECT cast(o.name AS VARCHAR) AS name, o.seq_no, o.full_name, o.score FROM f JOIN o ON o.name = f.name AND o.n = f.n WHERE f.kept""")
def _assign_scores(spark, d):
    """Five antigens for each order, whose lines have unequal scores with many ties."""
    rows = _tables(spark, d, "lineitem")[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.array(*(F.lit(k) for k in range(5)))).alias("k"))
    score = ((F.col("l_partkey") * (F.col("k") + 3) + F.col("l_suppkey")) % 6 * 10).cast("int")
    return lookups.assign_antigens(rows.select(F.col("l_orderkey").cast("string").alias("name"), F.col("l_linenumber").cast("int").alias("seq_no"), F.concat(F.lit("F"), F.col("k").cast("string")).alias("full_name"), score.alias("score")))


# ---------------------------------------------------------------- aggregations
@query("entry_flags", f"WITH {SEQS}, e AS (SELECT virus_type, name, max((align_status = 'aligned')::INT) AS a, max(has_hi::INT) AS m FROM seqs GROUP BY ALL) SELECT virus_type, count(*) AS entries, sum(a)::BIGINT AS aligned, sum(m)::BIGINT AS matched, count(*) AS dated, count(*) AS clade FROM e GROUP BY 1")
def _flags(spark, d):
    return aggregates.entry_flags(seqs(spark, d))


@query("info_grouping_sets", f"WITH {SEQS} SELECT virus_type, lineage, count(DISTINCT name) AS entries, count(*) AS seqs, count(*) FILTER (has_hi) AS matched FROM seqs GROUP BY ROLLUP (virus_type, lineage)")
def _info(spark, d):
    return aggregates.info(seqs(spark, d))


@query("info_rollup_month", f"WITH {ISO} SELECT year, month, count(*) AS seqs FROM (SELECT substr(iso_date, 1, 4) AS year, substr(iso_date, 1, 7) AS month FROM iso) GROUP BY ROLLUP (year, month)")
def _months(spark, d):
    return aggregates.by_month(seqs(spark, d), derived.latest_date(F.col("dates")))


_LABELS = "lab AS (SELECT unnest(list_filter(['Total', virus_type, CASE WHEN virus_type = 'B' AND lineage <> '' THEN concat(virus_type, lineage) END], lambda x: x IS NOT NULL)) AS label, * FROM seqs)"


@query("info_periods", f"WITH {SEQS}, {_LABELS}, p AS (SELECT label, has_hi, unnest([substr(iso_date, 1, 7), concat(substr(iso_date, 1, 4), 'all')]) AS period FROM lab) SELECT label, period, count(*) AS seqs, count(*) FILTER (has_hi) AS matched FROM p GROUP BY ALL")
def _info_periods(spark, d):
    return aggregates.info_periods(seqs(spark, d), derived.latest_date(F.col("dates")))


@query("info_clades", f"WITH {SEQS}, {_LABELS}, c AS (SELECT label, 'clade' AS kind, unnest(list_distinct([substr(passage, 1, 1), substr(passage, 2, 1)])) AS value FROM lab UNION ALL SELECT label, 'set', concat(substr(passage, 1, 1), ' ', substr(passage, 2, 1)) FROM lab) SELECT label, kind, value, count(*) AS seqs FROM c GROUP BY ALL")
def _info_clades(spark, d):
    return aggregates.info_clades(seqs(spark, d))


@query("clade_report", f"WITH {SEQS} SELECT CASE WHEN has_hi THEN full_name ELSE concat(name, ' ', passage) END AS name, iso_date AS date, lab FROM seqs WHERE contains(passage, 'R') ORDER BY date, name")
def _clade_report(spark, d):
    s = seqs(spark, d)
    return aggregates.clade_report(s, "R", derived.latest_date(F.col("dates")), derived.lab(F.col("lab_ids")), derived.make_name(F.col("name"), F.col("passages"), F.col("hi_names")))


@query("clade_counts", f"WITH {ISO} SELECT clade, count(*) AS seqs FROM (SELECT unnest(list_distinct([substr(passage, 1, 1), substr(passage, 2, 1)])) AS clade FROM iso) GROUP BY 1")
def _clade_counts(spark, d):
    return aggregates.clade_counts(seqs(spark, d))


@query("clade_sets", f"WITH {ISO} SELECT concat(substr(passage, 1, 1), ' ', substr(passage, 2, 1)) AS clades, count(*) AS seqs FROM iso GROUP BY 1")
def _clade_sets(spark, d):
    return aggregates.clade_sets(seqs(spark, d))


@query("clades_of_name", f"WITH {SEQS}, f AS (SELECT min(name) AS name FROM seqs) SELECT name, array_to_string(list_sort(list(DISTINCT c)), ' ') AS clades FROM (SELECT name, unnest([substr(passage, 1, 1), substr(passage, 2, 1)]) AS c FROM seqs JOIN f USING (name)) GROUP BY 1")
def _clades_of(spark, d):
    s = seqs(spark, d)
    own = s.join(F.broadcast(s.agg(F.min("name").alias("name"))), "name")
    return aggregates.clades_of_names(own, True).select("name", F.array_join("clades", " ").alias("clades"))


@query("identical_sequences", f"WITH {ISO} SELECT nuc AS key, count(*) OVER (PARTITION BY nuc) AS n, name, seq_no FROM iso QUALIFY count(*) OVER (PARTITION BY nuc) > 1")
def _identical(spark, d):
    return aggregates.identical(isolates(spark, d), F.col("nuc"), F.col("name"), F.col("seq_no"))


@query("distinct_passages", f"WITH {ISO} SELECT DISTINCT passage AS item FROM iso ORDER BY 1")
def _passages(spark, d):
    return aggregates.distinct_items(seqs(spark, d), "passages")


@query("prefixes", f"WITH {ISO} SELECT DISTINCT substr(nuc, 1, 6) AS prefix FROM iso WHERE partkey % 5 = 0 ORDER BY 1")
def _prefixes(spark, d):
    return aggregates.prefixes(seqs(spark, d).where("align_status <> 'aligned'"), "nuc", 6)


_COMP = "comp AS (SELECT p::INT AS pos, substr(nuc, p, 1) AS aa, count(*) AS n FROM {src}, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL)"


@query("residue_composition", f"WITH {ISO}, {_COMP.format(src='iso')} SELECT * FROM comp")
def _composition(spark, d):
    return aggregates.composition(isolates(spark, d), "nuc")


@query("variable_positions", f"WITH {ISO}, {_COMP.format(src='iso')} SELECT pos, count(*) AS kinds, sum(n)::BIGINT AS total, max(n) AS top_n, arg_min(aa, struct_pack(m := -n, a := aa)) AS top, string_agg(concat(aa, ':', cast(n AS varchar(20))), ' ' ORDER BY n DESC, aa) AS residues FROM comp GROUP BY pos HAVING count(*) > 1")
def _variable(spark, d):
    return aggregates.variable(aggregates.profile(aggregates.composition(isolates(spark, d), "nuc"))).select("pos", "kinds", "total", "top_n", "top", "residues")


@query("shannon", f"WITH {ISO}, {_COMP.format(src='iso')}, p AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS p FROM comp) SELECT pos, round(-sum(p * ln(p)) * 100)::BIGINT AS shannon FROM p GROUP BY pos")
def _shannon(spark, d):
    return aggregates.shannon(aggregates.composition(isolates(spark, d), "nuc"))


_HALF = "h{k} AS (SELECT p::INT AS pos, substr(nuc, p, 1) AS aa, count(*) AS n FROM iso, (SELECT unnest(range(1, 65)) AS p) WHERE iso_date {w} GROUP BY ALL), t{k} AS (SELECT pos, count(*) AS kinds, arg_min(aa, struct_pack(m := -n, a := aa)) AS top FROM h{k} GROUP BY 1)"


@query("two_period_diff", f"WITH {ISO}, {_HALF.format(k=1, w=chr(60) + chr(39) + '1998-01-01' + chr(39))}, {_HALF.format(k=2, w='>= ' + chr(39) + '1998-01-01' + chr(39))} SELECT t1.pos, t1.top, t2.top AS top_2 FROM t1 JOIN t2 USING (pos) WHERE t1.kinds > 1 OR t2.kinds > 1 OR t1.top <> t2.top")
def _periods(spark, d):
    i = isolates(spark, d)
    one, two = (aggregates.profile(aggregates.composition(i.where(w), "nuc")) for w in ("iso_date < '1998-01-01'", "iso_date >= '1998-01-01'"))
    return aggregates.compare_periods(one, two).select("pos", "top", "top_2")


_CODONS = "cod AS (SELECT {g}, p::INT AS pos, substr(nuc, (p - 1) * 3 + 1, 3) AS codon FROM iso, (SELECT unnest(range(1, 22)) AS p))"


@query("variable_codons", f"WITH {ISO}, {_CODONS.format(g='name')} SELECT pos, count(DISTINCT codon) AS kinds, count(*) AS n FROM cod GROUP BY pos HAVING count(DISTINCT codon) > 1")
def _codons(spark, d):
    return aggregates.variable_codons(isolates(spark, d))


@query("separating_codons", f"WITH {ISO}, x AS (SELECT suppkey % 2 AS g, concat(CASE suppkey % 2 WHEN 0 THEN 'AAACCG' ELSE 'CCCAAG' END, nuc) AS nuc FROM iso), c AS (SELECT g, p::INT AS pos, substr(nuc, (p - 1) * 3 + 1, 3) AS codon FROM x, (SELECT unnest(range(1, 24)) AS p)), s AS (SELECT pos, list(DISTINCT codon) FILTER (g = 0) AS a, list(DISTINCT codon) FILTER (g = 1) AS b FROM c GROUP BY 1) SELECT pos, array_to_string(list_sort(a), ' ') AS codons_1, array_to_string(list_sort(b), ' ') AS codons_2 FROM s WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)")
def _separating(spark, d):
    even = F.col("suppkey") % 2 == 0
    rows = isolates(spark, d).select(F.when(even, "0").otherwise("1").alias("g"), F.concat(F.when(even, "AAACCG").otherwise("CCCAAG"), "nuc").alias("nuc"))
    return aggregates.separating(rows, "g", "0", "1").select("pos", F.array_join("codons_1", " ").alias("codons_1"), F.array_join("codons_2", " ").alias("codons_2"))


@query("codon_report", f"WITH {ISO}, {_CODONS.format(g='name')}, n AS (SELECT pos, codon, count(*) AS n FROM cod GROUP BY ALL), t(codon, aa) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in sequence.CODONS.items())}), a AS (SELECT pos, aa, sum(n)::BIGINT AS n FROM n JOIN t USING (codon) GROUP BY ALL), l AS (SELECT pos, string_agg(concat(aa, ':', cast(n AS varchar(20))), ' ' ORDER BY n DESC, aa) AS aas FROM a GROUP BY 1) SELECT pos, string_agg(concat(codon, ':', cast(n AS varchar(20))), ' ' ORDER BY n DESC, codon) AS codons, any_value(aas) AS aas FROM n JOIN l USING (pos) GROUP BY 1 HAVING count(*) > 1")
def _codon_report(spark, d):
    return aggregates.codon_report(isolates(spark, d))


@query("weak_positions", f"WITH {ISO}, x AS (SELECT translate(nuc, 'T', 'X') AS nuc FROM iso), {_COMP.format(src='x')}, t AS (SELECT pos, count(*) AS kinds, max(n) AS top_n FROM comp WHERE aa <> 'X' GROUP BY 1) SELECT pos, top_n FROM t WHERE kinds > 1 AND top_n * 100.0 / (SELECT count(*) FROM iso) < 26")
def _weak(spark, d):
    """Every fourth residue is an X, which is in no count but in the number of entries."""
    return aggregates.weak_positions(isolates(spark, d).select(F.translate("nuc", "T", "X").alias("nuc")), "nuc", 26.0).select("pos", "top_n")


@query("mode_length", "WITH c AS (SELECT length(text) AS n, count(*) AS k FROM documents GROUP BY 1) SELECT min(n)::INT AS n FROM c WHERE k = (SELECT max(k) FROM c)")
def _mode(spark, d):
    return ordering.common_length(_tables(spark, d, "documents")[0], "text")


@query("residues_to_indexes", f"WITH {PROT} SELECT concat(substr(aa, 158, 1), substr(aa, 159, 1)) AS residues, count(*) AS n, min(id) AS first FROM prot GROUP BY 1")
def _indexes(spark, d):
    rows = proteins(spark, d)
    aa = F.concat(*(sequence.residue_at(F.col("aa"), F.lit(0), p) for p in (158, 159)))
    return aggregates.residues_to_indexes(rows, aa, "id").select("residues", F.size("indexes").cast("long").alias("n"), F.col("indexes")[0].alias("first"))


@query("conserved_positions", f"WITH {ISO}, x AS (SELECT partkey, p::INT AS pos, substr(nuc, p, 1) AS aa FROM iso, (SELECT unnest(range(1, 65)) AS p)) SELECT partkey, pos, min(aa) AS aa FROM x WHERE aa NOT IN ('X', '-') GROUP BY 1, 2 HAVING count(DISTINCT aa) = 1")
def _conserved(spark, d):
    return aggregates.conserved(isolates(spark, d), "nuc", "partkey")


@query("class_regex", f"WITH {ISO}, x AS (SELECT partkey, p AS pos, list_sort(list(DISTINCT substr(nuc, p, 1))) AS s FROM iso, (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2) SELECT partkey, string_agg(CASE WHEN len(s) = 1 THEN s[1] ELSE concat('[', array_to_string(s, ''), ']') END, '' ORDER BY pos) AS regex FROM x GROUP BY 1")
def _class_regex(spark, d):
    return aggregates.class_regex(isolates(spark, d), "nuc", "partkey")


# ---------------------------------------------------------------- projections, order, sets
@query("pad_to_common", "WITH c AS (SELECT length(p_name) AS n, count(*) AS k FROM part GROUP BY 1), m AS (SELECT min(n) AS n FROM c WHERE k = (SELECT max(k) FROM c)) SELECT p_partkey, substr(rpad(p_name, greatest(n, length(p_name))::INT, '-'), 1, n) AS p_name FROM part, m")
def _pad(spark, d):
    return ordering.to_common_length(_tables(spark, d, "part")[0].select("p_partkey", "p_name"), "p_name")


@query("aligned_shift", f"WITH {SEQS} SELECT name, seq_no, rpad(CASE WHEN nuc_shift < 0 THEN substr(nuc, 1 - nuc_shift) ELSE concat(repeat('-', nuc_shift::INT), nuc) END, 70, '-') AS nuc FROM seqs")
def _shift(spark, d):
    return seqs(spark, d).select("name", "seq_no", sequence.nucleotides(F.col("nuc"), F.col("nuc_shift"), size=70).alias("nuc"))


@query("longest_open_part", f"WITH {PROT}, s AS (SELECT id, replace(aa, 'K', '*') AS t FROM prot), x AS (SELECT id, string_split(t, '*') AS parts FROM s), y AS (SELECT id, parts, list_position(list_transform(parts, lambda p: length(p)), list_max(list_transform(parts, lambda p: length(p)))) AS k FROM x) SELECT id, concat(repeat('X', coalesce(list_sum(list_transform(parts[1 : k - 1], lambda p: length(p) + 1)), 0)::INT), parts[k]) AS aa FROM y")
def _open(spark, d):
    return proteins(spark, d).select("id", sequence.longest_open_part(F.replace("aa", F.lit("K"), F.lit("*"))).alias("aa"))


@query("unique_names", f"WITH {ISO}, k AS (SELECT name, entry_id, seq_no, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY seq_no, partkey, suppkey) AS r FROM iso) SELECT CASE WHEN n > 1 THEN concat(name, '__', cast(r AS varchar(20))) ELSE name END AS name, entry_id, seq_no FROM k")
def _unique(spark, d):
    return ordering.unique_names(isolates(spark, d), "name", "seq_no", "partkey", "suppkey").select("name", "entry_id", "seq_no")


@query("recent_n", f"WITH {ISO}, e AS (SELECT DISTINCT name, iso_date FROM iso) SELECT * FROM e ORDER BY iso_date DESC, name DESC LIMIT 500")
def _recent(spark, d):
    return ordering.recent(isolates(spark, d).select("name", "iso_date").distinct(), 500, "iso_date")


@query("walk_recent", f"WITH {ISO}, b AS (SELECT min(nuc) AS base FROM iso), e AS (SELECT DISTINCT nuc, iso_date FROM iso) SELECT nuc, iso_date FROM e, b WHERE hamming(nuc, base) < 45 ORDER BY iso_date DESC, nuc LIMIT 300")
def _walk(spark, d):
    i = isolates(spark, d)
    rows = i.select("nuc", "iso_date").distinct().crossJoin(F.broadcast(i.agg(F.min("nuc").alias("base"))))
    return ordering.walk_recent(rows, sequence.hamming_bulk("nuc", "base") < 45, 300, "iso_date", "nuc").select("nuc", "iso_date")


@query("dedup_seq_id", f"WITH {ISO} SELECT concat(name, '__', passage) AS seq_id, min(nuc) AS nuc FROM iso GROUP BY 1")
def _dedup(spark, d):
    s = seqs(spark, d).select(derived.seq_id(F.col("name"), F.col("passages")).alias("seq_id"), "nuc")
    return ordering.first_of(s, "seq_id", "nuc")


@query("base_and_included", f"WITH {ISO}, e AS (SELECT DISTINCT name, continent, iso_date FROM iso), b AS (SELECT min(name) AS name FROM e) SELECT name, CASE WHEN name = (SELECT name FROM b) THEN 0 WHEN continent = 'ASIA' THEN 1 ELSE 2 END AS part FROM e WHERE continent = 'ASIA' OR iso_date LIKE '1997%' OR name = (SELECT name FROM b)")
def _base(spark, d):
    e = isolates(spark, d).select("name", "continent", "iso_date").distinct()
    base = e.agg(F.min("name").alias("name"))
    return ordering.with_base(base, e.where("continent = 'ASIA'").select("name"), e.where("iso_date LIKE '1997%'").select("name")).select("name", "part")


@query("gaps_inserted", f"WITH {PROT} SELECT id, concat(substr(aa, 1, 10), '--', substr(aa, 11, 88), '-', substr(aa, 99)) AS aa FROM prot")
def _gaps(spark, d):
    gaps = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(n).alias("n")) for p, n in ((10, 2), (100, 1))))
    return proteins(spark, d).select("id", sequence.insert_gaps(F.col("aa"), gaps).alias("aa"))


@query("master_rows", f"WITH {PROT}, m AS (SELECT min(aa) AS m FROM prot) SELECT id, array_to_string(list_transform(range(1, 513), lambda k: CASE WHEN substr(aa, k, 1) = substr(m, k, 1) THEN '·' ELSE substr(aa, k, 1) END), '') AS aa FROM prot, m")
def _master(spark, d):
    p = proteins(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.min("aa").alias("m")))).select("id", sequence.against_master(F.col("aa"), F.col("m")).alias("aa"))


# ---------------------------------------------------------------- scalar functions
@query("normalize_passage", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'MDCK2' WHEN 2 THEN 'MDCK?' WHEN 3 THEN 'E4/SIAT3' WHEN 4 THEN 'MK1/MDCK1' ELSE 'E?' END AS passage FROM customer")
def _passage(spark, d):
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "ORIGINAL (throat)").when(k == 1, "C2").when(k == 2, "CX").when(k == 3, "E4 , S3").when(k == 4, "M1,C1").otherwise("EX")
    return _tables(spark, d, "customer")[0].select("c_custkey", text.passage(F.when(k == 0, "ORIGINAL").otherwise(raw)).alias("passage"))


@query("normalize_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def _date(spark, d):
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyyMM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return _tables(spark, d, "orders")[0].select("o_orderkey", text.date(raw).alias("date"))


@query("normalize_names", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A(H1N1)' WHEN 1 THEN 'B' ELSE 'A(H3N2)' END AS virus_type, CASE c_custkey % 2 WHEN 0 THEN 'MELB' ELSE 'NIMR' END AS lab, concat('A/MANAGUA/1.', cast(c_custkey AS varchar(20)), '/2015') AS name FROM customer")
def _names(spark, d):
    k = F.col("c_custkey")
    return _tables(spark, d, "customer")[0].select(
        "c_custkey", text.virus_type(F.when(k % 3 == 0, "h1pdm").when(k % 3 == 1, "B/Vic").otherwise("H3")).alias("virus_type"), text.lab(F.when(k % 2 == 0, " vidrl").otherwise("Crick")).alias("lab"),
        text.fix_name(F.concat(F.lit(" A/MANAGUA/1_"), k.cast("string"), F.lit("/2015 (15-02274)"))).alias("name"),
    )


@query("header_parse", "SELECT c_custkey, concat('A/', replace(n_name, '_', ' '), '/', cast(c_custkey AS varchar(20)), '/2015') AS name, CASE c_custkey % 4 WHEN 0 THEN '2015-03-07' WHEN 1 THEN '2015-03-01' WHEN 2 THEN '2015-01-01' ELSE '' END AS date, CASE WHEN c_custkey % 4 = 3 THEN 'E3' ELSE 'MDCK1' END AS passage, CASE c_custkey % 4 WHEN 0 THEN 'CDC' WHEN 1 THEN 'NIMR' ELSE '' END AS lab, CASE WHEN c_custkey % 4 = 0 THEN 'A(H3N2)' ELSE '' END AS virus_type, CASE WHEN c_custkey % 4 = 0 THEN cast(2015000000 + c_custkey AS varchar(20)) WHEN c_custkey % 4 = 1 THEN 'X1' ELSE '' END AS lab_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _header(spark, d):
    c, n = _tables(spark, d, "customer", "nation")
    k = F.col("c_custkey")
    name = F.concat(F.lit("A/"), F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("/"), k.cast("string"), F.lit("/2015"))
    raw = (
        F.when(k % 4 == 0, F.concat(name, F.lit(" | 2015-03-07 | MDCK1 | "), (k + 2015000000).cast("string"), F.lit(" | Centers for Disease Control and Prevention | A / H3N2 | ")))
        .when(k % 4 == 1, F.concat(name, F.lit(" | 2015-03 (day unknown) | MDCK1 | X1 | Crick Worldwide Influenza Centre")))
        .when(k % 4 == 2, F.concat(name, F.lit(" | 2015 (month and day unknown) | MDCK1 | ")))
        .otherwise(F.concat(name, F.lit(" lab:E3")))
    )
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", text.parse_header(raw).alias("h"))
    return rows.select("c_custkey", "h.name", "h.date", F.trim("h.passage").alias("passage"), "h.lab", "h.virus_type", "h.lab_id")


_CODON_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in sequence.CODONS.items())


@query("translate_frames", f"WITH {ISO}, t(codon, aa) AS (VALUES {_CODON_ROWS}), u AS (SELECT DISTINCT nuc FROM iso), f AS (SELECT nuc, frame, k, substr(nuc, (frame + 3 * k)::INT + 1, 3) AS codon FROM u, (SELECT unnest([0, 1, 2]) AS frame), (SELECT unnest(range(0, 22)) AS k) WHERE frame + 3 * k < 64) SELECT nuc, frame::INT AS frame, string_agg(coalesce(aa, 'X'), '' ORDER BY k) AS aa FROM f LEFT JOIN t USING (codon) GROUP BY ALL")
def _translate(spark, d):
    u = isolates(spark, d).select("nuc").distinct()
    return u.select("nuc", F.inline(sequence.translate_frames("nuc")))


@query("clades_h3", f"WITH {PROT} SELECT id, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' AND '.join(f'substr(aa, {r[:-1]}, 1) = {chr(39)}{r[-1]}{chr(39)}' for r in rule.split()) + f' THEN {chr(39)}{name}{chr(39)} END' for name, rule in clades.H3_CLADES)}], lambda x: x IS NOT NULL), ' ') AS clades FROM prot")
def _h3(spark, d):
    return proteins(spark, d).select("id", F.array_join(clades.h3(F.col("aa"), F.lit(0)), " ").alias("clades"))


@query("clades_b_vic", f"WITH {PROT}, a AS (SELECT id, substr(aa, 58, 1) AS a58, substr(aa, 75, 1) AS a75, substr(aa, 172, 1) AS a172, substr(aa, 162, 3) AS g FROM prot) SELECT id, concat(CASE WHEN a75 = 'K' AND a172 = 'P' AND a58 <> 'P' THEN '1A' WHEN a58 = 'P' THEN '1B' ELSE '1' END, CASE WHEN g = '---' THEN ' TRIPLEDEL2017' WHEN g LIKE '--%' THEN ' DEL2017' ELSE '' END) AS clades FROM a")
def _vic(spark, d):
    return proteins(spark, d).select("id", F.array_join(clades.b_victoria(F.col("aa"), F.lit(0)), " ").alias("clades"))


@query("b_lineage", f"WITH {PROT} SELECT id, CASE WHEN substr(aa, 162, 1) <> '-' AND contains(substr(aa, 163, 4), '-') THEN 'YAMAGATA' ELSE 'VICTORIA' END AS lineage FROM prot")
def _lineage(spark, d):
    return proteins(spark, d).select("id", clades.b_lineage(F.col("aa"), F.lit(0)).alias("lineage"))


@query("common_residues", f"WITH {PROT}, m AS (SELECT min(aa) AS m FROM prot) SELECT id, len(list_filter(range(1, 513), lambda k: substr(aa, k, 1) = substr(m, k, 1) AND substr(aa, k, 1) NOT IN ('X', '-')))::INT AS n FROM prot, m")
def _common(spark, d):
    p = proteins(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.min("aa").alias("m")))).select("id", sequence.common(F.col("aa"), F.col("m")).alias("n"))


# ---------------------------------------------------------------- pipelines
def _records(spark, d) -> DataFrame:
    """Made-up FASTA records of parts: a motif in front of the protein, several records for each name."""
    p = proteins(spark, d).withColumn("aa", F.translate("aa", "-*", "GG"))
    motif = F.when(F.col("id") % 3 == 0, "QKIPGNDNSTATLCLGHHAVPNGTIVKTI").when(F.col("id") % 3 == 1, "DTLCIGYHANNSTDTV").otherwise("CTDLDVALGRP")
    name = F.concat(F.lit("A/PLACE/"), F.expr("id div 4").cast("string"), F.lit("/2015"))
    return p.select(
        name.alias("name"), F.concat(motif, F.when(F.col("id") > 1000, F.substring("aa", 1, 440)).otherwise(F.col("aa"))).alias("sequence"), F.lit("2015").alias("date"), F.lit("C1").alias("passage"), F.lit("").alias("reassortant"),
        F.lit("CDC").alias("lab"), F.col("id").cast("string").alias("lab_id"), F.lit("").alias("virus_type"), F.lit("").alias("lineage"), F.lit("HA").alias("gene"), F.lit(0).alias("file_no"), F.col("id").alias("record_no"),
    )


def _motif_texts(spark, d) -> DataFrame:
    """Proteins that each hold an instance of one of the motifs (a letter of each class, by the part), some past its window, some two."""
    rules = spark.createDataFrame([(k, [x.strip("[]").replace(".", "GAVW") for x in re.findall(r"\[[A-Z]+\]|[A-Z.]", r[4])]) for k, r in enumerate(align.RULES)], "k int, places array<string>")
    made = lambda c, by: F.array_join(F.transform(c, lambda x, k: F.substr(x, ((F.col("id") * by + k * k) % F.length(x) + 1).cast("int"), F.lit(1))), "")
    second = rules.select(F.col("k").alias("k2"), F.col("places").alias("p2"))
    p = proteins(spark, d).withColumns({"aa": F.translate("aa", "-*", "GG"), "k": (F.col("id") % len(align.RULES)).cast("int"), "k2": (F.col("id") * 7 % len(align.RULES)).cast("int")})
    p = p.join(F.broadcast(rules), "k").join(F.broadcast(second), "k2")
    front = F.substring("aa", 300, (F.col("id") % 23).cast("int"))
    return p.select("id", F.concat(front, made(F.col("places"), 1), F.when(F.col("id") % 5 == 0, made(F.col("p2"), 3)).otherwise(""), F.substring("aa", 1, 400)).alias("aa"))


_RULE_ROWS = ", ".join(f"({k}, '{r[0]}', '{r[2]}', {r[3] == 'signal'}, {0 if r[3] in (None, 'signal') else r[3]}, '{r[4]}', {r[5]})" for k, r in enumerate(align.RULES))
_RULE_LETTERS = ", ".join("({}, [{}])".format(k, ", ".join(f"'{x.strip('[]').replace('.', 'GAVW')}'" for x in re.findall(r"\[[A-Z]+\]|[A-Z.]", r[4]))) for k, r in enumerate(align.RULES))
_MADE = "array_to_string(list_transform(range(0, len({p})), lambda k: substr({p}[k + 1], ((p.id * {by} + k * k) % length({p}[k + 1]) + 1)::INT, 1)), '')"


@query("align", f"""WITH {PROT}, l(k, places) AS (VALUES {_RULE_LETTERS}), r(k, subtype, gene, signal, shift, motif, size) AS (VALUES {_RULE_ROWS}),
p AS (SELECT id, translate(aa, '-*', 'GG') AS aa FROM prot),
t AS (SELECT p.id, concat(substr(p.aa, 300, (p.id % 23)::INT), {_MADE.format(p="a.places", by=1)}, CASE WHEN p.id % 5 = 0 THEN {_MADE.format(p="b.places", by=3)} ELSE '' END, substr(p.aa, 1, 400)) AS aa
  FROM p JOIN l a ON a.k = p.id % {len(align.RULES)} JOIN l b ON b.k = p.id * 7 % {len(align.RULES)}),
m AS (SELECT id, k, subtype, gene, signal, shift, substr(aa, 1, size) AS x, regexp_extract(substr(aa, 1, size), motif) AS found FROM t, r),
h AS (SELECT id, k, subtype, gene, CASE WHEN signal THEN 1 - strpos(x, found) - length(found) ELSE shift + 1 - strpos(x, found) END AS s FROM m WHERE found <> ''),
g AS (SELECT id, min_by(subtype, k) AS subtype, min_by(gene, k) AS gene, min_by(s, k) AS s, count(DISTINCT subtype) > 1 OR count(DISTINCT s) > 1 AS warned FROM h GROUP BY 1)
SELECT t.id, coalesce(subtype, '') AS subtype, coalesce(gene, '') AS gene, s::INT AS aa_shift, coalesce(warned, false) AS warned FROM t LEFT JOIN g USING (id)""")
def _align(spark, d):
    rows = _motif_texts(spark, d).select("id", align.align(F.col("aa")).alias("a"))
    return rows.select("id", "a.subtype", "a.gene", "a.aa_shift", (F.col("a.warning") != "").alias("warned"))


@query("align_records", f"WITH {PROT} SELECT id AS record_no, CASE id % 3 WHEN 0 THEN 'A(H3N2)' WHEN 1 THEN 'A(H1N1)' ELSE 'B' END AS virus_type, CASE id % 3 WHEN 2 THEN 59 ELSE 0 END::INT AS aa_shift FROM prot")
def _align_records(spark, d):
    return merge.align_records(merge.normalize_records(_records(spark, d))).select("record_no", "virus_type", "aa_shift")


def _pieces(spark, d) -> DataFrame:
    """FASTA records of parts, four for each name, in four files: pieces of the name's least protein that hold one another or not, by part; every
    seventh record is its own part's protein, and every eleventh is too short. The least part of a name is found by the keys: proteins are made from
    them after that, as a table of proteins looks small to the planner, by its file of keys, and would be sent through the driver."""
    keys = _tables(spark, d, "part")[0].select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 4").alias("g")).where("g IS NOT NULL")
    p = spread(keys.withColumn("least", F.min("id").over(Window.partitionBy("g"))), "id")
    motif = F.when(F.col("g") % 3 == 0, "GGQKIPGNDNSTATLCLGHHAVPNGTIVKTI").when(F.col("g") % 3 == 1, "GGDTLCIGYHANNSTDTV").otherwise("GGCTDLDVALGRP")
    own = F.translate(_letters("of"), "-*", "GG")
    size = F.when(F.col("id") % 11 == 0, 300).otherwise(420 + F.col("id") * 37 % 100)
    return p.withColumn("of", F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("least"))).select(
        F.concat(F.lit("A/PLACE/"), F.col("g").cast("string"), F.lit("/2015")).alias("name"), F.substr(F.concat(motif, own), (F.col("id") * 5 % 3 + 1).cast("int"), size.cast("int")).alias("sequence"),
        F.concat(F.lit("201"), (F.col("id") % 3).cast("string")).alias("date"), F.concat(F.lit("E"), (F.col("id") % 2).cast("string")).alias("passage"), F.lit("").alias("reassortant"), F.lit("CDC").alias("lab"),
        F.col("id").cast("string").alias("lab_id"), F.lit("").alias("virus_type"), F.lit("").alias("lineage"), F.lit("HA").alias("gene"), (F.col("id") % 2).cast("int").alias("file_no"), F.col("id").alias("record_no"),
    )


@query("merge", f"""WITH RECURSIVE {PROT}, p AS (SELECT id, id // 4 AS g, translate(aa, '-*', 'GG') AS aa FROM prot), b AS (SELECT g, min_by(aa, id) AS base FROM p GROUP BY 1),
r AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id % 2, id) AS n, id % 2 AS file, concat('201', id % 3, '-01-01') AS d, concat('E', id % 2) AS passage, (1 - strpos(aa, w)) + CASE g % 3 WHEN 2 THEN 59 ELSE 0 END AS shift, aa FROM
  (SELECT g, id, w, substr(concat('GG', m, CASE WHEN id % 7 = 0 THEN aa ELSE base END), (id * 5 % 3 + 1)::INT, CASE WHEN id % 11 = 0 THEN 300 ELSE (420 + id * 37 % 100)::INT END) AS aa
   FROM p JOIN b USING (g), (SELECT unnest([0, 1, 2]) AS kind, unnest(['QKIPGNDNSTATLCLGHHAVPNGTIVKTI', 'DTLCIGYHANNSTDTV', 'CTDLDVALGRP']) AS m, unnest(['QKIPGND', 'DTLCIGYHANN', 'CTDLDVALGRP']) AS w) WHERE kind = g % 3)),
f AS (SELECT g, n, file, [d] AS dates, [{{aa: aa, shift: shift, passages: [passage], ids: [id]}}] AS seqs FROM r WHERE n = 1
  UNION ALL SELECT g, n, file, dates, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(seqs, {{aa: aa, shift: shift, passages: [passage], ids: [id]}})
    ELSE list_transform(seqs, lambda s, i: CASE WHEN i <> hit THEN s ELSE {{aa: CASE WHEN contains(s.aa, aa) THEN s.aa ELSE aa END, shift: CASE WHEN contains(s.aa, aa) THEN s.shift ELSE shift END,
      passages: CASE WHEN list_contains(s.passages, passage) THEN s.passages ELSE list_append(s.passages, passage) END, ids: list_append(s.ids, id)}} END) END
  FROM (SELECT g, n, file, dates, seqs, aa, shift, passage, id, list_position(list_transform(seqs, lambda s: contains(s.aa, aa) OR contains(aa, s.aa)), true) AS hit
    FROM (SELECT f.g, r.n, r.file, list_append(f.dates, r.d) AS dates, CASE WHEN f.file = r.file THEN f.seqs ELSE list_filter(f.seqs, lambda s: length(s.aa) >= 400) END AS seqs, r.aa, r.shift, r.passage, r.id FROM f JOIN r ON r.g = f.g AND r.n = f.n + 1))),
l AS (SELECT g, max_by(dates, n) AS dates, max_by(list_filter(seqs, lambda s: length(s.aa) >= 400), n) AS seqs FROM f GROUP BY 1),
x AS (SELECT g, dates, unnest(seqs) AS s, unnest(range(0, len(seqs))) AS k FROM l)
SELECT concat(CASE g % 3 WHEN 0 THEN 'A(H3N2)' WHEN 1 THEN 'A(H1N1)' ELSE 'A' END, '/PLACE/', g, '/2015') AS name, k::INT AS seq_no, array_to_string(list_sort(list_distinct(dates)), ' ') AS dates, array_to_string(s.passages, ' ') AS passages, array_to_string(s.ids, ' ') AS lab_ids, s.aa AS aa, s.shift::INT AS aa_shift FROM x""")
def _merge(spark, d):
    rows = merge.merge(merge.align_records(merge.normalize_records(_pieces(spark, d))))
    return rows.select("name", "seq_no", F.array_join("dates", " ").alias("dates"), F.array_join("passages", " ").alias("passages"), F.array_join(F.col("lab_ids")["CDC"], " ").alias("lab_ids"), "aa", "aa_shift")


@query("indels")
def _indels(spark, d):
    """Three types; the first two have rows of normal length, B has none. Every protein is the least one's with its own residues at
    the end, and three residues cut out at 100 for half of them."""
    p = proteins(spark, d).select("id", F.translate("aa", "-", "G").alias("aa"))
    kind = F.when(F.col("id") % 3 == 0, "A(H3N2)").when(F.col("id") % 3 == 1, "A(H1N1)").otherwise("B")
    size = F.when(F.col("id") % 3 == 0, 520).when(F.col("id") % 3 == 1, 519).otherwise(450)
    long = F.concat("m", "m")
    cut = F.when(F.col("id") % 2 == 0, F.concat(F.substring("m", 1, 100), F.substr(long, F.lit(104), size - 103))).otherwise(F.substr(long, F.lit(1), size))
    rows = p.crossJoin(F.broadcast(p.agg(F.min("aa").alias("m")))).select(kind.alias("virus_type"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("seq_no"), F.lit("aligned").alias("align_status"), F.concat(cut, F.substring("aa", 1, 30)).alias("aligned_aa"))
    return indels.detect(rows).select("name", "aligned_aa", F.to_json("gaps").alias("gaps"))
