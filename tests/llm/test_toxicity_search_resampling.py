"""Operators 11 to 13 against SQL, brute force and held-out labels; long texts of operator 9."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandsift.llm import common, feature_resampling, lexical_search, secret_scan, toxicity
from tests.helpers import compare

SCHEMA = "doc_id long, text string, lang string, source string, `_KEY` int, T string"
ODD = [(1, None, None, None, 1, "x"), (2, "", "en", "a", 1, "x"), (3, " \n\n ", "en", "a", 1, "x"), (None, "no id\nbut words", "en", "a", 1, "x"), (5, "one", "en", "a", 1, "x"), (5, "one", "en", "a", 1, "x"), (6, "One!\none", "en", "b", 2, "y"), (7, "été là " * 30000, "fr", None, 1, "x")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


# ---------------------------------------------------------------- 9, long values
def test_long_values_of_wide_characters(spark):
    """A megabyte of characters of one and two units in turn, quoted and bare; Java's recursion ended in a stack overflow."""
    rows = [(1, "x password=" + "a😀" * 250_000 + " end.", "s"), (2, 'token = "' + "a😀é" * 170_000 + '" tail', "s"), (3, "é😀" * 300_000, "s"), (4, 'pwd: abc!d).) and "secret": "ab\\"cd"', "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["nth"]): (r["start"], len(r["value"]), r["value"][:4]) for r in secret_scan.scan(df).collect()}
    assert got == {(1, 0): (11, 500_000, "a😀a😀"), (2, 0): (9, 510_000, "a😀éa"), (4, 0): (5, 5, "abc!"), (4, 1): (29, 6, 'ab\\"')}
    left = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, threshold=0.0).collect()}
    assert left[1] == "x password=[SECRET] end." and left[2] == 'token = "[SECRET]" tail' and left[3] == rows[2][1]


# ---------------------------------------------------------------- 11 toxicity
def naive_ratio(toxic, ordinary, order, text):
    """log(toxic / ordinary probability) of every byte of ``text``: Kneser-Ney written out with dictionaries."""

    def spell(t):
        return b" " * (order - 1) + (" ".join(terms(t)).encode() + b" " if terms(t) else b" ")

    grams = [Counter(s[i : i + order] for t in side for s in [spell(t)] for i in range(len(s) - order + 1)) for side in (toxic, ordinary)]
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = [Counter(g[1:] for g, c in side.items() if c > 0) for side in counts[k + 1]]
        if k == 1:
            counts[k] = [Counter(g[1:] for g in set(counts[2][0]) | set(counts[2][1]))] * 2

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    def p(side, gram):
        if not gram:
            return 1 / 256
        c = counts[len(gram)][side]
        d, same = discount(c), [v for g, v in c.items() if g[:-1] == gram[:-1]]
        below = p(side, gram[1:])
        return (max(c[gram] - d, 0) + d * len(same) * below) / sum(same) if same else below

    s = spell(text)
    return [math.log(p(0, s[i : i + order]) / p(1, s[i : i + order])) for i in range(len(s) - order + 1)]


def test_models_against_naive_kneser_ney():
    toxic, ordinary = ["you IDIOT, you moron!", "idiot idiot", "what a moron"], ["a nice day you have", "what a day", "", "the moon is nice"]
    for order in (2, 3, 4):
        both = []
        for side in (toxic, ordinary):
            buf, offsets = common.text_bytes(pa.array(side))
            sym, owner = toxicity.symbols(buf, offsets, order)
            both.append(np.unique(toxicity.strings(sym, order)[owner >= 0], return_counts=True))
        keys = np.union1d(both[0][0], both[1][0])
        counts = [np.zeros(len(keys)), np.zeros(len(keys))]
        for c, (k, n) in zip(counts, both, strict=True):
            c[np.searchsorted(keys, k)] = n
        m = toxicity.fit_models(keys, *counts, order)
        texts = ["an idiot's day", "moon", "", "zzz! ???", "It is nice; MORON"]
        buf, offsets = common.text_bytes(pa.array(texts))
        for block in (7, 1 << 20):
            got, size = m.rows(buf, offsets, block)
            want = [naive_ratio(toxic, ordinary, order, t) for t in texts]
            assert size.tolist() == [len(w) for w in want]
            assert np.allclose(got * (size + m.steady), [sum(w) for w in want], atol=1e-9)


def test_symbols():
    texts = ["a--B", "", "c!", "?d", "é e", "--"]
    buf, offsets = common.text_bytes(pa.array(texts))
    sym, owner = toxicity.symbols(buf, offsets, 3)
    assert [sym[owner == k].tobytes().decode() for k in range(len(texts))] == ["a b ", " ", "c ", "d ", "é e ", " "]
    assert (owner == -1).sum() == 2 * len(texts)


@pytest.fixture(scope="module")
def rude(spark):
    """Ordinary words of two languages; toxic documents have rare words of a root each that ordinary ones never have."""
    rng, rows, labels = np.random.default_rng(5), [], []
    parts = (["an", "er", "th", "ing", "ou", "st"], ["que", "la", "ie", "ment", "oi", "de"])
    word = lambda lang: "".join(rng.choice(parts[lang], rng.integers(1, 4)))
    for k in range(1200):
        lang, bad = int(rng.integers(2)), k % 6 == 0
        ws = [word(lang) for _ in range(rng.integers(30, 120))]
        if bad:
            for at in range(0, len(ws), 12):
                ws[at] = ("zgrob", "vlurp")[lang] + word(lang)
        rows.append((k, " ".join(ws)))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_documents_it_has_not_seen(rude):
    docs, labels = rude
    m = toxicity.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = toxicity.score(docs, m).toPandas().set_index("doc_id")
    unseen = got[(got.index % 5 == 0) | (got.index % 2 == 1)]
    right = (unseen.predicted == 1) == (unseen.index % 6 == 0)
    assert right.mean() > 0.98 and unseen.score.between(0, 1).all()
    few = toxicity.fit(docs, labels, max_rows=40, max_grams=500)
    assert sum(len(k) for k in few.keys[-1:]) <= 500


def test_toxicity_odd(spark, odd, none, rude):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(odd, labels)
    got = toxicity.score(odd, m).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert toxicity.score(none, m).count() == 0
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(odd, labels.where("toxic = 1"))).collect()} == {1}


def test_toxicity_query(spark):
    r = toxicity.op11_toxicity(spark, SMALL).toPandas()
    assert len(r) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and (r.predicted == (r.score >= 0.5)).all()
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


# ---------------------------------------------------------------- 12 lexical search
def naive_search(docs, items, limit):
    ds = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(bool(c) for _, c in ds), sum(sum(c.values()) for _, c in ds)
    df, out = Counter(w for _, c in ds for w in c), []
    for item in sorted({i for i, _ in items}):
        ws, scored = {w for i, t in items if i == item for w in terms(t)}, []
        for i, c in ds:
            m = 50 + (50 * sum(c.values()) * n_docs // all_terms if all_terms else 0)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:limit], 1)]
    return out


def test_search_against_sql(spark):
    assert not compare(spark, {"q": lexical_search.op12_lexical_search}, {"q": lexical_search.OP12_SQL}, SMALL)


@pytest.mark.parametrize("how", [{}, {"most_terms": 4, "wanted_terms": 0, "broadcast_rows": 0}])
def test_search_against_brute_force(spark, how):
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    docs = [(k, " ".join(word() for _ in range(int(rng.integers(1, 200))))) for k in range(300)]
    docs += [(1000 + k, docs[3][1]) for k in range(90)] + [(2000, "W7 w7-w7 w9"), (2000, "W7 w7-w7 w9"), (None, docs[3][1]), (3000, None), (3001, ""), (3002, " ".join(f"w{k}" for k in range(400)) * 60)]
    items = [(1, docs[3][1][:60]), (2, "w7 w9"), (3, "w398 nowhere"), (3, "w11"), (4, "!!"), (5, None)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string"), limit=20, **how)
    got = [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=lambda r: r[:2]) == naive_search(docs, items, 20)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x) % 300}" for x in rng.zipf(1.2, int(rng.integers(0, 900)))) for _ in range(200)]
    buf, offsets = common.text_bytes(pa.array(texts))
    row, hashes, times, n = lexical_search.terms(buf, offsets)
    own = [np.sort(rng.choice(np.unique(hashes), 12, replace=False)) for _ in range(9)]
    df = dict(zip(*(x.tolist() for x in np.unique(hashes.view(np.int64), return_counts=True)), strict=True))
    q, seen, near = lexical_search.Items(list(range(9)), own, df, len(texts), int(n.sum())), 0, 0
    for group, _, levels, slices in lexical_search.sign(row, hashes, times, len(texts)):
        bounds = q.bounds(slices, levels, n[group])
        for k, r in enumerate(group):
            mine = row == r
            s = q.score(np.arange(9), hashes[mine], times[mine], int(n[r]))
            assert (bounds[:, k] >= s).all()
            seen, near = seen + len(s), near + int((bounds[:, k] <= 1.3 * s + 1).sum())
    assert seen == 9 * len(texts) and near > 0.9 * seen


def test_search_odd(odd, none, spark):
    items = spark.createDataFrame([(None, "one words"), (2, "été")], "item_id int, text string")
    got = [tuple(r) for r in lexical_search.search(odd, items).select("item_id", "rank", "doc_id").collect()]
    assert sorted(got, key=str) == sorted([(None, 1, None), (None, 2, 5), (None, 3, 5), (None, 4, 6), (2, 1, 7)], key=str) or len(got) == 5
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(odd, items.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 importance resampling
def test_resampling_against_sql(spark):
    assert not compare(spark, {"q": feature_resampling.op13_importance_resampling}, {"q": feature_resampling.OP13_SQL}, SMALL)


def test_crc_of_many_stretches():
    words = [b"", b"a", "é".encode(), b"x" * 63, b"y" * 64, b"z" * 65, b"q" * 5000, b"ab"]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert feature_resampling.crc32(buf, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    before = np.arange(len(words), dtype=np.uint32) * 77
    assert feature_resampling.crc32(buf, starts, ends, before).tolist() == [zlib.crc32(w, int(b)) for w, b in zip(words, before, strict=True)]


@pytest.mark.parametrize("n,often", [(1, 1 << 16), (2, 3), (3, 1)])
def test_resampling_against_brute_force(spark, n, often):
    rng = np.random.default_rng(n)
    line = lambda: " ".join(f"w{int(x)}" for x in rng.integers(0, 30, int(rng.integers(0, 5))))
    shared = [line() for _ in range(6)]
    docs = [(k, "\n".join(line() if rng.random() < 0.6 else shared[rng.integers(6)] for _ in range(int(rng.integers(1, 12))))) for k in range(150)]
    docs += [(7, docs[7][1]), (None, "w1 w2\nW3\n\nw4 w5"), (500, None), (501, "")]
    target = ["w1 w2 w3\nw4", "w2 w3\nw3 w2", None]
    features = lambda t: [" ".join(ws[i : i + k]) for ws in [terms(t)] for k in range(1, n + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 50
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 50) / ((s[b] + 1) * (total_t + 50))))
    want = Counter((i, len(features(x)), len(terms(x)), sum(gain(bucket(f)) for f in features(x))) for i, x in docs)
    got = feature_resampling.weights(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=50, often=often)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "n_words", "weight").collect()) == want
    drawn = [r for r in feature_resampling.draw(got, percent=30, min_words=5).collect() if r["rank"]]
    able = [x for x in want.elements() if x[2] >= 5]
    noise = lambda i: math.floor(-1000 * math.log(-math.log((int(__import__("hashlib").sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    best = sorted(((-x[3] - noise(x[0]), x[0] is None, x[0] or 0) for x in able))[: len(able) * 30 // 100]
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted(drawn, key=lambda r: r["rank"])] == best and sorted(r["rank"] for r in drawn) == list(range(1, len(best) + 1))


def test_resampling_odd(odd, none, spark):
    target = spark.createDataFrame([("one",)], "text string")
    got = feature_resampling.draw(feature_resampling.weights(odd, target), min_words=1, percent=100).collect()
    assert len(got) == len(ODD) and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert feature_resampling.draw(feature_resampling.weights(none, target)).count() == 0
    assert feature_resampling.weights(odd, target.limit(0)).count() == len(ODD)
