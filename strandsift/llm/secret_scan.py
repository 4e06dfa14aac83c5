"""Secret scans with a random forest against false positives (operator 9, DataFrame functions only).

A candidate is a run of 12 or more of ``[A-Za-z0-9+/_-]`` (with up to two closing ``=``) that holds a
digit, begins like an issuer's format or follows an equals sign; and whatever follows a credential's name and a
separator, of any length and any characters but blanks: to the closing quote, or else up to a next ``&name=``, a tag or
closing punctuation. The forest sees its length, its character classes and the transitions between them, the share
that dictionary words cover, its path (the source column) and the neighbouring words; it learns from labelled
findings and removes false positives: candidates scored under ``threshold`` are no secrets.

Labelled findings are a DataFrame (value, path, before, after, label). Without one they are made of the corpus by
planting (``planted_findings``): labels say where a value comes from, not what it looks like. Fitting takes at
most ``max_labelled`` of each label, by hash order (a documented bound that concerns the model only): every
candidate of every whole text is scored. Dictionary words are counted over all documents; how often a word must
occur is relative to their number.

Defined cases: a null text has no findings; a null path is an empty one; rows that repeat report
their findings each; if one label is missing nothing can be learned and all findings score 0.5; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CANDIDATE = r"""(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*[0-9])|(?=A[KS]IA|gh[pousr]_|xox[abprs]-|AIza|[sr]k_)|(?<==["' ]{0,2}))[A-Za-z0-9+/_\-]{12,}={0,2}"""
MARK = "[SECRET]"
# Public formats of issued credentials.
ISSUERS = {
    "aws_access_key": r"^(AKIA|ASIA)[A-Z0-9]{16}$",
    "github_token": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "slack_token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "google_api_key": r"^AIza[A-Za-z0-9_\-]{35}$",
    "stripe_key": r"^(sk|rk)_(live|test)_[A-Za-z0-9]{16,}$",
}
_WORDS = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)s?"
_NAMES = rf"(?i){_WORDS}"
_ASSIGNED = _NAMES + r"""["']?\s*(:=|=>|=|:|\s)\s*["']?$"""
_SEPARATED = _NAMES + r"""["']?\s*(:=|=>|=|:)\s*["']?$"""
# What comes before an assigned value; \\G: the name may have been the end of the last candidate, with the equals signs.
_PREFIX = rf"""(?:(?:(?i:{_WORDS})|\G(?<=(?i:{_WORDS})))["']?(?:\s*(?::=|=>|=|:)\s*|\s+)|\G(?<=(?i:{_WORDS})={{1,2}})\s*)["']?"""
# Loops over whole characters are possessive: Java walks back over others by recursion, a frame a character.
_QUOTED = r"""(?<=")(?:(?!(?<!\\)")\S)++(?=")|(?<=')(?:(?!(?<!\\)')\S)++(?=')"""
_STOP = r"""["'`](?:[\s,;:)\]}&]|\z)|[&,;]["']?[\w.\-]{1,64}["']?\s{0,8}[=:]|</?[A-Za-z]"""
_CLOSING = r""".,;:?)\]}>"'`"""
# Characters up to a stop; those that close a sentence or bracket belong to the value only if more of it follows.
_BARE = rf"""(?!["'`]|[=:>]+(?:\s|\z))(?:(?:(?!{_STOP})[{_CLOSING}])*+(?!{_STOP})[^\s{_CLOSING}])++"""
# Group 1 is the name and separator in front of an assigned value; the rest of the match is the value.
FINDING = rf"({_PREFIX})(?:{_QUOTED}|{_BARE})|{CANDIDATE}"
_WEB = r"(?i)(https?:|www\.|@|\.)[^\s]*$"
FEATURES = (
    "length", "runs", "lower_digit", "upper_digit", "digit_letter", "case_changes", "digits", "uppers", "hex", "symbols", "distinct", "covered",
    "path_code", "path_sample", "named", "assigned", "separated", "quoted", "after_space", "before_words",
)


def _cut(text: str) -> tuple[Column, Column]:
    """``values`` of a text, and ``gaps`` around them (one more)."""
    whole, prefix = F.regexp_extract_all(F.col(text), F.lit(FINDING), 0), F.regexp_extract_all(F.col(text), F.lit(FINDING), 1)
    values = F.zip_with(whole, prefix, lambda w, p: F.substr(w, F.length(p) + 1))
    gaps = F.zip_with(F.split(F.col(text), FINDING, -1), prefix, lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return values.alias("values"), gaps.alias("gaps")


def candidates(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str = "source") -> DataFrame:
    """doc_id, text_key, path, nth (from 0), value, before (up to 48 characters), after (up to 24), skip (characters since the last candidate)."""
    t = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("t"))
    t = t.withColumn("whole", F.regexp_extract_all("t", F.lit(FINDING), 0)).where(F.size("whole") > 0)
    t = t.select("doc_id", "text_key", "path", *_cut("t"))
    # the last value counts as context too: a name may be its end
    last = lambda i: F.concat(F.when(i > 0, F.get("values", i - 1)).otherwise(F.lit("")), F.get("gaps", i))
    around = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.right(last(i), F.lit(48)).alias("before"), F.substring(F.get("gaps", i + 1), 1, 24).alias("after"), F.length(F.get("gaps", i)).alias("skip")))
    return t.select("doc_id", "text_key", "path", F.posexplode(around).alias("nth", "x")).select("doc_id", "text_key", "path", "nth", "x.*")


def dictionary(docs: DataFrame, text: str = "text", min_docs: int = 3, word_share: float = 0.001) -> DataFrame:
    """Written table ``w``: the words of 4 to 12 letters that at least ``word_share`` of all documents hold, and at least ``min_docs``."""
    rows = docs.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    found = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(?<![\w])\p{L}{4,12}(?![\w])"), 0))).alias("w")).groupBy("w").count()
    return C.materialize(found.where(F.col("count") >= max(min_docs, rows.count() * word_share)).select("w"), "dictionary")


BROADCAST_WORDS = 1 << 20  # beyond, the words are joined by a shuffle


def _value_key(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value).alias("v1"), F.xxhash64(value, F.lit(1)).alias("v2")


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """v1, v2 (hashes of a value), n_covered: characters of the value that lie in a dictionary word; values without one are left out."""
    values = found.select("value").distinct().select(*_value_key(F.col("value")), F.lower("value").alias("v"))
    # the letters that begin at each position: one pass over the value for each length, no matter how long it is, one at a time
    lengths = values.select("v1", "v2", "v", F.explode(F.sequence(F.lit(4), F.lit(12))).alias("k"))
    begins = F.regexp_extract_all("v", F.concat(F.lit(r"(?=(\p{L}{"), F.col("k").cast("string"), F.lit("})?)")), F.lit(1))
    parts = lengths.select("v1", "v2", "k", F.posexplode(begins).alias("pos", "w")).where("w <> ''")
    if words.count() <= BROADCAST_WORDS:  # the commonest words are hot keys; a word has 12 letters at most, so this is 48 MB or less
        words = F.broadcast(words)
    hits = parts.join(words, "w").select("v1", "v2", F.explode(F.sequence("pos", F.col("pos") + F.col("k") - 1)).alias("at"))
    return hits.groupBy("v1", "v2").agg(F.countDistinct("at").alias("n_covered"))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES; ``words`` is a dictionary."""
    v, before = F.col("value"), F.col("before")
    covered = F.least(F.lit(1.0), F.coalesce("n_covered", F.lit(0)) / F.length(v))
    flag = lambda c: c.cast("double")
    made = {
        "length": F.length(v).cast("double"),
        "runs": F.regexp_count(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / F.length(v),
        "lower_digit": _share(v, "(?<=[a-z])(?=[0-9])"), "upper_digit": _share(v, "(?<=[A-Z])(?=[0-9])"), "digit_letter": _share(v, "(?<=[0-9])(?=[A-Za-z])"), "case_changes": _share(v, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "digits": _share(v, "[0-9]"), "uppers": _share(v, "[A-Z]"), "hex": _share(v, "[0-9a-f]"), "symbols": _share(v, "[^A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v), "covered": covered,
        "path_code": flag(F.col("path").rlike(r"(?i)(\.env|\.ya?ml|\.json|\.ini|\.cfg|\.conf|\.properties|\.py|\.js|\.sh|secret|credential)")), "path_sample": flag(F.col("path").rlike(r"(?i)(test|example|sample|mock|fixture|docs?/)")),
        "named": flag(before.rlike(_NAMES)), "assigned": flag(before.rlike(_ASSIGNED)), "separated": flag(before.rlike(_SEPARATED)), "quoted": flag(before.rlike("[\"'`]$")), "after_space": flag(F.col("after").rlike(r"^(\s|$)")), "before_words": F.regexp_count(before, F.lit(r"\p{L}{2,}")).cast("double"),
    }
    columns = found.columns
    found = found.select("*", *_value_key(v)).join(coverage(found, words), ["v1", "v2"], "left")
    return found.withColumns(made).select(*columns, *FEATURES)


def _issued(value: Column, pattern: str) -> Column:
    """A value, or a run inside of it, that has the issuer's format."""
    edge = "[^A-Za-z0-9+/_-]"
    return value.rlike(f"(?:^|{edge}){pattern[1:-1]}(?:$|{edge})")


def kind(value: Column, before: Column) -> Column:
    out = F.when(before.rlike(_ASSIGNED), "assigned_value")
    case = None
    for name, pattern in ISSUERS.items():
        case = F.when(_issued(value, pattern), name) if case is None else case.when(_issued(value, pattern), name)
    return F.coalesce(case, out, F.lit("unknown"))


def planted_findings(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str = "source", documents: int = 300) -> DataFrame:
    """value, path, before, after, label: findings of known origin, planted in the middle of up to ``documents`` texts (by hash order).

    Label 1 has values nobody could guess, drawn from hashes: behind names of credentials with several separators, and in the
    formats of issuers. Label 0 has what looks alike: numbers, dates, web paths and slugs and names made of the text's own
    words, words behind a credential's name, and digests of commits.
    """
    rows = docs.select(F.xxhash64(id, text).alias("h"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    rows = C.smallest(rows, F.col("h"), documents).dropDuplicates(["h"])
    middle = F.floor(F.length("t") / 2).cast("int")
    rows = rows.select(
        "h", "path", F.right(F.substr("t", F.lit(1), middle), F.lit(24)).alias("lead"), F.substr(F.col("t"), middle + 1, F.lit(20)).alias("tail"),
        F.filter(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(?<![\w])\p{L}{4,12}(?![\w])"), 0)), lambda w: ~w.rlike(_NAMES)).alias("ws"),
    )

    def hexes(k: int) -> Column:
        return F.sha2(F.concat(F.col("h").cast("string"), F.lit(f"/{k}")), 256)

    def mixed(k: int) -> Column:
        return F.translate(F.base64(F.unhex(hexes(k))), "+/=", "xYz")

    size = lambda low, high: F.pmod(F.col("h"), F.lit(high - low + 1)).cast("int") + low
    cut = lambda c, n: F.substr(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    with_front = lambda front, c: F.concat(F.lit(front), c)
    word = lambda k: F.get("ws", F.pmod(F.shiftright("h", k), F.greatest(F.lit(1), F.size("ws"))).cast("int"))
    digits = lambda k: F.translate(hexes(k), "abcdef", "147258")
    slug = F.concat_ws("-", word(1), word(9), word(17))
    secrets = [
        ('token = "', cut(hexes(1), size(16, 40)), '"'), ("password=", cut(mixed(2), size(8, 16)), " "), ("api_key: ", cut(mixed(3), size(20, 32)), "\n"), ('"secret": "', cut(F.translate(mixed(4), "0123456789", "bdfhjlnprt"), size(10, 20)), '"'),
        ("pwd: ", F.concat(cut(mixed(5), 5), F.lit("!"), F.right(mixed(6), F.lit(4)), F.lit("#")), " "), ("Authorization: Bearer ", cut(mixed(7), 40), " "), ("secret => '", cut(mixed(8), size(12, 24)), "'"), ("access_key=", cut(hexes(9), 32), "&x=1"),
        ("", with_front("AKIA", cut(F.upper(mixed(10)), 16)), " "), ("see ", with_front("ghp_", cut(mixed(11), 36)), " "), ("", with_front("xoxb-", cut(hexes(12), 24)), ","), ('"', with_front("AIza", cut(mixed(13), 35)), '"'), ("", with_front("sk_live_", cut(mixed(14), 24)), " "),
    ]
    others = [
        ("order ", cut(digits(20), size(12, 19)), " "), ("", cut(digits(21), 16), "."), ("item ", F.concat(F.lit("20"), cut(digits(22), 2), F.lit("-01-02-"), cut(digits(23), 6)), " "), ("page ", F.concat(slug, F.lit("-"), cut(digits(24), 1)), " "),
        ("https://example.org/", F.concat(word(3), F.lit("/2015/"), slug), " "), ("see ", F.concat(F.initcap(word(5)), F.initcap(word(11)), F.initcap(word(19)), cut(digits(25), 1)), " "), ("the password ", word(7), " "), ("a secret ", word(13), " "),
        ("commit ", hexes(26).substr(1, 40), " "), ("checksum ", cut(hexes(27), 32), "\n"), ("token ", word(21), " "), ("x=", F.concat(word(2), F.lit("_"), word(10), cut(digits(28), 1)), " "), ("bearer ", word(23), ","),
    ]
    made = [F.struct(F.lit(front).alias("front"), value.alias("value"), F.lit(back).alias("back"), F.lit(label).alias("label")) for label, group in ((1.0, secrets), (0.0, others)) for front, value, back in group]
    rows = rows.select("path", "lead", "tail", F.explode(F.array(*made)).alias("x")).where("length(x.value) >= 4")
    return rows.select("x.value", "path", F.right(F.concat("lead", F.lit(" "), "x.front"), F.lit(48)).alias("before"), cut(F.concat("x.back", "tail"), 24).alias("after"), "x.label")


def fit(labelled: DataFrame, max_labelled: int = 5000, trees: int = 20, depth: int = 6, seed: int = 7):
    """A forest from rows with FEATURES and ``label``, or None where one label is missing."""
    w = Window.partitionBy("label", "salt").orderBy("h", "value", "before")
    rows = labelled.where("label IS NOT NULL").select(*FEATURES, "label", "value", "before", F.xxhash64("value", "before").alias("h")).withColumn("salt", F.pmod("h", F.lit(64)))
    # at most max_labelled / 64 of each label and salt: a bound of the sample that no hot label breaks
    sample = C.materialize(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, max_labelled // 64)), "labelled-findings")
    if {r["label"] for r in sample.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.orderBy("label", "h", "value", "before").coalesce(1))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows.select("features", "label"))


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5, **how) -> DataFrame:
    """Every finding: doc_id, text_key, nth, start (character, from 0), value, kind, score, is_secret."""
    words = dictionary(docs, text)
    found = C.materialize(candidates(docs, text, id, path), "candidates")
    found = C.materialize(features(found, words), "findings")
    labelled = C.materialize(planted_findings(docs, text, id, path) if labelled is None else labelled, "labelled")
    model = fit(features(labelled, words), **how)
    if model is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)).withColumn("score", vector_to_array("probability")[1])
    before = Window.partitionBy("doc_id", "text_key", "copy").orderBy("nth")
    # rows that repeat have equal findings: number them apart before summing lengths
    copy = Window.partitionBy("doc_id", "text_key", "nth").orderBy(F.lit(1))
    scored = scored.select("doc_id", "text_key", "nth", "value", "skip", kind(F.col("value"), F.col("before")).alias("kind"), "score").withColumn("copy", F.row_number().over(copy))
    start = F.sum(F.col("skip") + F.length("value")).over(before) - F.length("value")
    return scored.select("doc_id", "text_key", "nth", start.cast("long").alias("start"), "value", "kind", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str = "source", **how) -> DataFrame:
    """``docs`` with every secret's characters replaced by MARK; all rows and columns stay."""
    hits = scan(docs, text, id, path, **how).where("is_secret").groupBy("doc_id", "text_key").agg(F.collect_set("nth").alias("nths"))
    d, k, n = C.free_name(docs, "_id", "_key", "_nths")
    hits = C.materialize(hits.toDF(d, k, n), "secret-hits")
    values, gaps = _cut(text)
    cleaned = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(F.array_contains(F.col(n), i), F.lit(MARK)).otherwise(F.coalesce(F.get(values, i), F.lit(""))))), "")
    same = F.col(id).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(k))
    return docs.join(hits, same, "left").select(*(F.when(F.col(n).isNotNull(), cleaned).otherwise(F.col(c)).alias(c) if c == text else docs[c] for c in docs.columns))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every finding of every document; values by digest only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).select("doc_id", "nth", "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "kind", "score", "is_secret")
