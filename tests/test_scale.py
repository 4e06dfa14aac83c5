"""Jobs of this collection at size: what is shuffled, how many tasks share the work, and results by brute force on odd rows."""

import random

from pyspark.sql import functions as F

from strandsift import runtime
from strandsift.operators import aggregates, indels, lookups
from strandsift.plans import queries
from tests.helpers import compare


def written(df):
    """Rows of ``df`` and the rows its plan's exchanges have written, all together."""
    rows = df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return rows, total


def test_classes_and_single_residues_by_brute_force(spark):
    random.seed(5)
    made = lambda: "".join(random.choice("ACGTX-é😀") for _ in range(random.choice((0, 1, 3, 9, 40))))
    rows = [(random.choice((None, 1, 2, 3, 2**53 + 1, 2**53)), random.choice("pq"), random.choice((made(), None, "ACGT"))) for _ in range(3000)]
    rows += [(k, "alone", "AC") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "a long, b string, s string").repartition(5)
    cells = {}
    for a, b, s in rows:
        for p, x in enumerate(s or "", 1):
            cells.setdefault((a, b), {}).setdefault(p, set()).add(x)
    regex = {g: "".join(next(iter(x)) if len(x) == 1 else f"[{''.join(sorted(x))}]" for _, x in sorted(c.items())) for g, c in cells.items()}
    single = {(*g, p, min(x - {"X", "-"})) for g, c in cells.items() for p, x in c.items() if len(x - {"X", "-"}) == 1}
    with_small_batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("10000", "7"):
        spark.conf.set(with_small_batches, size)
        try:
            assert {(r["a"], r["b"]): r["regex"] for r in aggregates.class_regex(df, "s", "a", "b").collect()} == regex
            got = [tuple(r) for r in aggregates.conserved(df, "s", "a", "b").collect()]
            assert len(got) == len(single) and set(got) == single
            whole = aggregates.class_regex(df.where("a = 2"), "s").collect()
            both = {}
            for a, _, s in rows:
                for p, x in enumerate((s or "") if a == 2 else "", 1):
                    both.setdefault(p, set()).add(x)
            assert [r["regex"] for r in whole] == ["".join(next(iter(x)) if len(x) == 1 else f"[{''.join(sorted(x))}]" for _, x in sorted(both.items()))]
        finally:
            spark.conf.unset(with_small_batches)
    none = df.where("s = 'no such'")
    assert [r["regex"] for r in aggregates.class_regex(none, "s").collect()] == [""] and aggregates.class_regex(none, "s", "a").collect() == [] and aggregates.conserved(none, "s", "a").collect() == []


def test_classes_shuffle_texts_not_letters(spark):
    rows = spark.range(4000).select((F.col("id") % 2000).alias("g"), F.rpad(F.md5(F.col("id").cast("string").cast("binary")), 64, "x").alias("s"))
    for f in (aggregates.class_regex, aggregates.conserved):
        assert 0 < written(f(rows, "s", "g"))[1] <= 4000
    one = spark.range(20000).select(F.lit(1).alias("g"), F.translate(F.md5(F.col("id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"))
    assert 0 < written(aggregates.class_regex(one, "s", "g"))[1] <= 100  # a large group comes as a few texts a batch


def test_a_small_file_of_keys_is_dealt_over_tasks(spark, tmp_path):
    spark.range(1, 20001).select(F.col("id").alias("p_partkey"), F.lit("name").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    busy = queries.proteins(spark, str(tmp_path)).where(F.length(F.replace("aa", F.lit("-"), F.lit(""))) >= 0).groupBy(F.spark_partition_id()).count().collect()
    assert len(busy) == 5 and max(r["count"] for r in busy) < 6000
    where = queries.proteins(spark, str(tmp_path)).where("aa <> ''")  # a filter on letters stays behind the exchange
    assert where.rdd.getNumPartitions() == 5
    assert queries.QUERIES["drop_short"](spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_records_to_merge_are_made_without_a_broadcast(spark, tmp_path):
    """Proteins of the least parts went through the driver: their table looks as small as its file of keys."""
    spark.range(5000, 9800).selectExpr("CASE WHEN id % 50 <> 3 THEN id END AS p_partkey", "'name' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = queries._pieces(spark, str(tmp_path))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() and rows.rdd.getNumPartitions() == 2
    assert compare(spark, {"merge": queries.QUERIES["merge"]}, {"merge": queries.ORACLES["merge"]}, str(tmp_path)) == []


def test_rows_for_gaps_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(x):
        seen.add(1)
        return x

    letters = "".join("ACDEFGHIKLMNPQRSTVWY"[(k * 7 + k // 20) % 20] for k in range(500))
    rows = [("B", f"n{k}", 0, "aligned", letters[: 300 + k] + letters[302 + k :]) for k in range(20)]
    df = spark.createDataFrame(rows, "virus_type string, name string, seq_no int, align_status string, t string").withColumn("aligned_aa", made("t")).drop("t")
    assert len(indels.detect(df).collect()) == 20 and seen.value == 20


def test_small_entries_are_assigned_in_one_pass_and_large_ones_in_rounds(spark):
    rnd = random.Random(3)
    rows = [(name, rnd.randrange(9), f"f{rnd.randrange(12)}", rnd.choice((10, 20, 30, 100))) for name, n in (("A", 90), (None, 80), ("B", 30), ("C", 9)) for _ in range(n)]
    want = []
    for name in ("A", None, "B", "C"):
        taken, best = set(), {}
        for _, seq, antigen, score in sorted({r for r in rows if r[0] == name}, key=lambda r: (-r[3], r[2], r[1])):
            if antigen not in taken and best.get(seq, score) == score:
                taken.add(antigen)
                best[seq] = score
                want.append((name, seq, antigen, score))
    df = spark.createDataFrame(rows, "name string, seq_no int, full_name string, score int")
    for rounds, most in ((30, 0), (1, 0), (0, 0), (30, 40), (30, 1000)):
        got = lookups.assign_antigens(df, rounds, most).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), (rounds, most)
    many = spark.range(5000).select(F.expr("string(id div 10)").alias("name"), F.expr("int(id % 3)").alias("seq_no"), F.expr("concat('F', id % 7)").alias("full_name"), F.expr("int(id % 4)").alias("score"))
    assert 0 < written(lookups.assign_antigens(many))[1] <= 5000  # each pair is shuffled once


def test_large_tables_are_shuffled_in_more_and_smaller_partitions(spark):
    names = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    tasks = lambda: spark.range(400000).select(F.col("id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("s")).groupBy("s").agg(F.max("id")).groupBy(F.spark_partition_id()).count().count()
    try:
        runtime.sized(spark, 300, each=100)
        assert [spark.conf.get(n, None) for n in names] == [None, None] and tasks() <= 4  # small ones keep the session's
        runtime.sized(spark, 1600, each=100, size=1 << 20)
        assert tasks() > 6
        runtime.sized(spark, 500, each=100, size=1 << 30)  # never fewer or larger ones
        assert [spark.conf.get(n) for n in names] == ["16", str(1 << 20)]
    finally:
        for n in names:
            spark.conf.unset(n)


def test_sequence_ids_asked_twice_give_a_row_each(spark):
    s = spark.createDataFrame([("A/X/1/2001", 1, ["E1"], ["A/X/1/2001 E1"]), ("A/X/1/2001", 2, ["E1"], []), ("B/Y/2/2002", 1, ["C1"], [])], "name string, seq_no int, passages array<string>, hi_names array<string>")
    want = {"A/X/1/2001__E1__1": 2, "A/X/1/2001__E1": 1, "A/X/1/2001 E1": 1, "B/Y/2/2002 C1": 1, "B/Y/2/2002__E1": None, "none": None, None: None}
    for ids in (list(want) * 2, ["A/X/1/2001__E1__1"] * 3):
        got = lookups.by_seq_id(s, spark.createDataFrame([(i,) for i in ids], "seq_id string")).collect()
        assert sorted(((r["seq_id"], r["seq_no"]) for r in got), key=str) == sorted(((i, want[i]) for i in ids), key=str)


def test_identical_rows_are_all_reported(spark):
    rows = [("AC", f"n{k}", k) for k in range(300)] + [("GT", "x", 1), ("GT", "x", 1), ("GG", "alone", 1), ("", "e", 1), ("", "e", 2), (None, "e", 3), (None, "e", 4)]
    df = spark.createDataFrame(rows, "s string, name string, seq_no int").repartition(5)
    got = aggregates.identical(df, F.col("s"), F.col("name"), F.col("seq_no"))
    assert got.columns == ["key", "n", "name", "seq_no"]
    assert sorted(map(tuple, got.collect())) == sorted((s, 300 if s == "AC" else 2, name, k) for s, name, k in rows if s in ("AC", "GT"))
    assert aggregates.identical(df.where("s = 'none'"), F.col("s"), F.col("name")).collect() == []


def test_identical_sequences_name_every_member(spark):
    assert compare(spark, {"q": queries.QUERIES["identical_sequences"]}, {"q": queries.ORACLES["identical_sequences"]}, "/root/testdata/sf0.01") == []
    assert queries.QUERIES["identical_sequences"](spark, "/root/testdata/sf0.01").columns == ["key", "n", "name", "seq_no"]
