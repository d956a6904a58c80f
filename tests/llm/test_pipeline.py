"""The pipeline's stages and the registered queries on the small tables."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tallyframe.llm import decontaminate, line_dedup, minhash, queries

from .test_dedup import brute_groups, changed, lines_alike, prose, reworded, words_alike
from .test_operators import holds

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language"](spark, docs, DATA)
    assert told.columns == docs.columns and told.count() >= 0.98 * docs.count()
    lined = stage["lines"](spark, docs, DATA)
    assert lined.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    assert line_dedup.removals(lined).count() == 0  # nothing is left to take out
    near = stage["near"](spark, docs, DATA)
    assert near.columns == docs.columns and all(r["class_size"] == 1 for r in minhash.groups(near).collect())
    clean = stage["benchmark"](spark, docs, DATA)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert clean.columns == docs.columns and decontaminate.matches(clean, bench).count() == 0
    gone = {r["doc_id"] for r in decontaminate.matches(docs, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - gone


def test_language_keeps_documents_where_none_is_labelled(spark):
    docs = spark.createDataFrame([(1, "clean prose", None), (2, "ελληνικά", None), (3, "12 !?", None), (4, "", None), (5, None, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, DATA).collect()} == {1, 2}


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert out and {r["doc_id"] for r in out} < docs and all(r["length"] <= 4096 for r in out)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, language string, lines_gone array<int>, id int, label string"


def planted():
    """Documents with junk, repeated and reworded lines, near copies, benchmark items and repeated rows; and the benchmark."""
    rng = random.Random(31)
    items = [prose(rng, 16) for _ in range(3)] + ["alpha beta gamma delta epsilon zeta"]
    common = [prose(rng, 14) for _ in range(3)]
    texts = ["\n".join([prose(rng, rng.randrange(20, 60)), *rng.sample(common, rng.randrange(3)), prose(rng, 25)]) for _ in range(40)]
    texts += [changed(rng, texts[i].replace("\n", " "), 1) for i in range(6)] + [reworded(rng, common[0], 1) + "\n" + prose(rng, 30) for _ in range(3)]
    texts += [f"{prose(rng, 20)} {items[i % 4]} {prose(rng, 20)}" for i in range(6)] + [common[1], common[2] + "\n\n", "12 !?", "", None, "é", "one\ntwo\none", "word " * 9000]
    return [(i, t) for i, t in enumerate(texts)], items


def brute_lines_by_words(rows):
    found = sorted((i, p, x.strip(line_dedup.SPACE)) for i, t in rows for p, x in enumerate(t.split("\n")) if x.strip(line_dedup.SPACE))
    top = list(range(len(found)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, _, x) in enumerate(found):
        for j in range(i):
            y = found[j][2]
            if x == y or (abs(len(x) - len(y)) <= 2 and max(len(x), len(y)) < 1000 and lines_alike(x, y)) or (40 <= min(len(x), len(y)) and max(len(x), len(y)) < 1000 and words_alike(x, y)):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    gone = {(d, p) for i, (d, p, _) in enumerate(found) if root(i) != i}
    out = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows]
    return [(i, t) for (i, t), (_, old) in zip(out, rows, strict=True) if t == old or t.strip()]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = planted()
    full = [(i, t, "xx", "s", len(t or ""), "clash", [1], 7, "clash") for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_lines_by_words([(i, t) for i, t in rows if t and any(c.isalpha() for c in t)])
    groups = brute_groups(want)
    want = [(i, t) for i, t in want if groups[i] == i]
    want = {i: t for i, t in want if not any(holds(t, x) for x in items)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(want) and len(want) > 30
    plain = queries.packing.WordTokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    for i, t in want.items():
        assert sum(r["length"] for r in out if r["doc_id"] == i) == len(plain.encode([t])[0]) + 1
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


@pytest.mark.parametrize("name", ["language", "lines", "near", "benchmark"])
def test_stages_pass_other_columns_and_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([(1, "some item of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    row = ("xx", "s", 3, "clash", [1], 7, "other")
    docs = spark.createDataFrame([(1, "plain words of one", *row), (1, "plain words of one", *row), (None, "something else that stands here", *row), (2, None, *row)], COLUMNS)
    out = stage(spark, docs, str(tmp_path))
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter({(1, "plain words of one"): 2, (None, "something else that stands here"): 1} | ({} if name == "language" else {(2, None): 1}))
    assert all((r["language"], r["lines_gone"], r["label"]) == ("clash", [1], "other") for r in out.collect())
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_twin_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, twin = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(twin.columns) == order
    theirs = Counter(tuple(r[twin.columns.index(c)] for c in order) for r in twin.fetchall())
    assert Counter(tuple(r[c] for c in order) for r in df.collect()) == theirs


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
