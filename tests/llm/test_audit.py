"""Source divergence, quality and centroids against plain versions, and their defined results."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import centroids, divergence, quality, queries

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def twin(name, **tables):
    """The rows of a query's twin over given pandas tables or over SMALL."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        if t in tables:
            con.register(t, tables[t])
        else:
            con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cols = sorted(con.sql(queries.oracle_sql()[name]).columns)
    return cols, con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()


def rows(df, cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_centroids"])
def test_query_and_twin_agree(spark, name):
    cols, want = twin(name)
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == cols and rows(df, cols) == sorted(map(repr, want)) and want


# --- source divergence ----------------------------------------------------------------------------

DOCS = [
    (1, "One TWO two Ärger Ärger", "en", "a"), (2, "one two; three_one 4one", "en", "a"), (2, "one two", "en", "b"), (None, "ONE two ärger", "en", None), (5, None, "en", "c"), (6, "", None, "a"),
    (7, "solo", "xx", "a"), (8, "solo solo", "xx", "b"), (9, "one", None, None), (9, "one", "", ""), (10, "one one", "", "z"), (11, "ſharp K one", "en", "b"), (12, "\x00one\x7ftwo\n", "en", "\U0001f600"), (13, "two", "en", "￿"),
]


def plain_divergence(docs, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        words = re.findall(divergence.WORD, (text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, d in df[lang].items() if d >= least]
        count = {s: {w: counts[lang, s][w] for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 2)])
def test_divergence_against_a_plain_version(spark, least, top):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").repartition(3)
    got = divergence.report(docs, least, top)
    assert sorted(map(tuple, got.collect())) == sorted(plain_divergence(DOCS, least, top))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_of_clashing_names_long_texts_and_no_rows(spark):
    long = [(1, "word " * 300_000 + "end", "en", "a"), *((i, "word end other", "en", "b") for i in range(4))]
    docs = spark.createDataFrame(long, "doc_id long, text string, lang string, source string")
    odd = docs.withColumns({c: F.lit(7) for c in ("term", "n", "counts", "ws", "p", "q", "rank", "value", "groups")})
    assert sorted(map(tuple, divergence.report(odd).collect())) == sorted(plain_divergence(long, 3, 200))
    assert divergence.report(docs.limit(0)).collect() == []


def test_shares_are_exact_for_counts_of_any_size(spark):
    total, kinds = 3 * 10**13 + 7, 10**9 + 9
    counts = [0, 1, 9_223_372_034, 9_223_372_035, 9_223_372_036, 9_223_372_037, 9 * 10**12]
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", divergence.share(F.col("n"), F.lit(total), F.lit(kinds)).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 1) // (total + kinds) for r in got]
    assert spark.range(1).select(divergence.surprise(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first().f == 10**18


# --- centroids ------------------------------------------------------------------------------------


def plain_clusters(vectors, k, rounds):
    """Every vector by itself, in Python's whole numbers. vectors: (id, components)."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        c = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if mine[j] else old for j, old in enumerate(c)]
    out = [(i, *near(v)) for i, v in kept]
    spent = Counter()
    for _, d, j in out:
        spent[j] += d
    return [(i, j, d, spent[j], spent.total(), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out]


def cases():
    rng = np.random.default_rng(5)
    near = [(int(i), [float(x) for x in rng.normal(0, 0.2, 64).round(2)]) for i in range(120)]
    hot = [(1000 + i, near[3][1]) for i in range(150)]
    broken = [(500, None), (501, [0.1] * 63), (502, [0.1] * 65), (503, [None] + [0.1] * 63), (504, [float("nan")] + [0.1] * 63), (505, [float("-inf")] + [0.1] * 63), (506, [])]
    return near + hot + broken + [(7, [0.5] * 64), (7, [0.5] * 64), (7, [-0.5] * 64), (None, [1.0] * 64), (8, [-1e-9] * 64), (9, [1e6] * 64)]


@pytest.mark.parametrize("k", [16, 3, 1000])
def test_clusters_against_a_plain_version(spark, k):
    df = spark.createDataFrame(cases(), "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "n": F.lit("x"), "cluster": F.lit(2), "copy": F.lit(3), "copies": F.lit(3)}).repartition(5)
    got = centroids.cluster(df, k=k)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_clusters(cases(), k, 3)))


def test_a_vector_that_many_rows_have_is_dealt_to_many_tasks(spark):
    kept = spark.range(4000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 3000, F.array(F.lit(1))).otherwise(F.array(F.col("id").cast("int"))).alias("q"))
    assigned = kept.groupBy("q").agg(F.count("*").alias("n")).withColumn("cluster", F.lit(0))
    out = centroids.back(kept, assigned)
    assert out.count() == 4000 and out.groupBy("q", "copy").count().agg(F.max("count")).first()[0] < 200


def test_sums_beyond_64_bits_and_components_beyond_the_limit(spark):
    v, n = np.full((3, 2), 2**26), np.full(3, 2**40)
    assert centroids.weighted_sums(v, n, np.zeros(3, int), 2).tolist() == [[3 * 2**66, 3 * 2**66, 3 * 2**40], [0, 0, 0]]
    assert centroids.moved(np.array([[1, 1], [5, 5]]), np.array([[-7, 7, 2], [0, 0, 0]], dtype=object)).tolist() == [[-4, 3], [5, 5]]
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_no_vectors_give_no_rows(spark):
    out = centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- quality --------------------------------------------------------------------------------------


def plain_grams(text):
    """Words and pairs of a text, as the features stand for them: runs of word bytes or of signs, and every repeated word as one pair."""
    data = (text or "").encode()
    words = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", data)]
    return set(words) | {"again" if a == b else (a, b) for a, b in zip(words, words[1:], strict=False)}


def test_features_are_the_distinct_grams_whatever_the_batch_and_window(monkeypatch):
    rng = np.random.default_rng(3)
    pool = ["a", "bb", "Bb", "ä", "!!", "%%%", "x1", "\n", "  ", "\U0001f600", "w" * 90, "\x00"]
    texts = [None, "", " ", "a", "a a", "!!a!!", "w" * 1000 + " " + "v" * 900 + " a", *("".join(rng.choice([*pool, " ", " "], n)) for n in rng.integers(1, 60, 40))]
    texts += [" ".join(rng.choice(pool, 400)) for _ in range(5)]
    ends, at = quality.features(pa.array(texts))
    whole = np.split(at, ends[:-1])
    assert [len(x) for x in whole] == [len(plain_grams(t)) for t in texts]
    names = {}
    for t, x in zip(texts, whole, strict=True):
        assert (np.diff(x) > 0).all()
        for g in plain_grams(t):  # the same gram has the same bucket everywhere
            one = names.setdefault(g, set(x.tolist()))
            names[g] = one & set(x.tolist())
    assert all(names.values())
    for window in (1, 7, 64, 300):
        monkeypatch.setattr(quality, "WINDOW", window)
        ends_2, at_2 = quality.features(pa.array(texts))
        assert ends_2.tolist() == ends.tolist() and at_2.tolist() == at.tolist()
    sliced = pa.array(["zz", *texts]).slice(1)
    assert quality.features(sliced)[1].tolist() == at.tolist()


def test_ratios_and_descent():
    n = np.zeros((2, quality.BUCKETS + 1), np.int64)
    n[0, :3], n[1, :3] = [10, 0, 5], [0, 100, 50]
    r = quality.ratios(n)
    assert r[0] < -1 and r[1] > 1 and abs(r[2]) < 1e-9 and abs(r[3:]).max() < 1e-9
    # the dual solution of a small problem is that of a plain projected gradient method
    rng = np.random.default_rng(1)
    x = [(np.array([0, 1, 2]), rng.normal(size=3)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    w = quality.descend(x, y, np.ones(40), epochs=400)[[0, 1, 2, quality.BUCKETS]]
    m = np.array([[*v, 1.0] for _, v in x]) * y[:, None]
    dual = np.zeros(40)
    for _ in range(60_000):
        dual = np.clip(dual - 0.005 * (m @ (dual @ m) - 1), 0, 1)
    primal = lambda u: u @ u / 2 + np.maximum(1 - m @ u, 0).sum()
    assert abs(primal(w) - primal(dual @ m)) < 1e-2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    out = queries.op12_quality(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    got = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got.score[got.quality == 1], got.score[got.quality == 0]
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.97
    assert out.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0
    assert {r.doc_id for r in out.where("held_out").collect()} == {r.doc_id for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_quality_of_nulls_labels_and_no_rows(spark):
    texts = [(i, ["fine plain words here", "JUNK!! JUNK!!"][i % 2] + f" {i}") for i in range(60)]
    docs = spark.createDataFrame([*texts, (None, None), (None, "fine plain"), (61, ""), (62, None), (61, "JUNK!! " * 400_000)], "doc_id long, text string").withColumns({c: F.lit("?") for c in ("label", "quality", "score", "n0", "at", "lot")})
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(0, 0, 0), (2, 1, 1), (4, 7, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.learnable(docs, labels).collect()} == {i for i in range(60) if i and zlib.crc32(str(i).encode()) % 5}
    model = quality.fit(docs, labels)
    got = quality.predict(docs, model).collect()
    assert len(got) == 65 and not any(r.held_out for r in got if r.doc_id is None)
    assert all((r.predicted == 1) == (r.doc_id % 2 == 0) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in got if r.doc_id == 62} | {min(r.score for r in got if r.doc_id is None)}) <= 2
    again = quality.predict(docs.repartition(7), quality.fit(docs.repartition(5), labels)).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in again) == sorted((repr(r.doc_id), round(r.score, 9)) for r in got)
    only = quality.predict(docs, quality.fit(docs, labels.where("quality = 1 and doc_id > 6")))
    assert only.where("score < 0.99").count() == 0
    none = quality.predict(docs, quality.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.predict(docs.limit(0), model).collect() == []
