"""Exact, line and near dedup against brute force."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, line_dedup, links, minhash, tokens

DOC = "doc_id long, text string"
BIG = 2**60 + 1


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# --- exact ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "x" * 200_000), (BIG, "a b"), (9, "x" * 199_999 + "y"), (None, "lone"), (None, "a b")]
    got = {}
    for r in exact_dedup.decisions(docs(spark, rows).withColumns({"id": F.lit("clash"), "key": F.lit(1), "cid": F.lit(2)}), keep=keep).collect():
        got.setdefault(r["doc_id"], []).append(r)
    want = BIG if keep == "largest" else 1
    assert {got[i][0]["keep_id"] for i in (1, 2, BIG)} == {want} and got[1][0]["group_size"] == 4
    assert [i for i in (1, 2, BIG) if got[i][0]["kept"]] == [want]
    assert got[3][0]["group_size"] == 2 and got[5][0]["group_size"] == got[6][0]["group_size"] == 1 and got[7][0]["group_size"] == 2 and got[9][0]["group_size"] == 1
    assert got[1][0]["text_sha256"] == hashlib.sha256(b"a b").hexdigest() and got[3][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["kept"] for r in got[None]) == [False, True]


def test_exact_repeated_rows_and_empty_table(spark):
    got = exact_dedup.decisions(docs(spark, [(1, "a")] * 5 + [(2, "b")])).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got if r["doc_id"] == 1} == {5}
    assert exact_dedup.decisions(docs(spark, [])).count() == 0


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    keys = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    entries = [(rng.choice(keys), (0, rng.randrange(10**6), i), 1, i) for i in range(3000)]
    want = {}
    for k, rank, n, m in entries:
        v = want.setdefault(k, [rank, 0, []])
        v[0], v[1] = min(v[0], rank), v[1] + n
        v[2].append(m)
    for limit in (10**9, 20_000, 1500):
        got = list(exact_dedup.owners(iter(entries), limit))
        assert sorted((r, n, sorted(m)) for r, n, m in got) == sorted((r, n, sorted(m)) for r, n, m in want.values())


def test_trie_holds_keys_that_are_prefixes_of_others():
    trie = exact_dedup.Trie()
    for i, k in enumerate([b"abc", b"ab", b"abd", b"", b"abcde"]):
        trie.insert(k)[2] = i
    assert [k for k, _ in trie.terminals()] == [b"", b"ab", b"abc", b"abcde", b"abd"]


# --- lines ----------------------------------------------------------------------------------------


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(y):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, what = rng.randrange(len(out) or 1), rng.randrange(3)
        out[k : k + (what > 0)] = [] if what == 2 else [rng.choice("abcdé")]
    return "".join(out)


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_banded_distance(limit):
    rng = random.Random(limit)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(30))) for _ in range(1500)]
    b = [edited(rng, x, rng.randrange(6)) if x else "ab" for x in a]
    assert line_dedup.edit_distances(a, b, limit).tolist() == [min(limit + 1, edit_distance(x, y)) for x, y in zip(a, b, strict=True)]


def lines_alike(x, y):
    return x == y or edit_distance(x, y) <= min(2, min(len(x), len(y)) // 20)


def test_lines_within_few_edits_share_a_bucket():
    rng = random.Random(3)
    for _ in range(1200):
        x = "".join(rng.choice("ab") for _ in range(rng.randrange(18, 70)))
        y = edited(rng, x, rng.randrange(3))
        alike = lines_alike(x, y)
        if x != y:
            assert (line_dedup.char_distances([x], [y])[0] <= 1) == alike
        if alike and len(x) >= line_dedup.NEAR_CHARS and len(y) >= line_dedup.NEAR_CHARS:
            keys, owner = line_dedup.char_buckets([x, y])
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def brute_lines(rows):
    """Removed (doc_id, line) pairs for rows of distinct ids."""
    found = [(i, p, line.strip(line_dedup.SPACE)) for i, t in rows if t for p, line in enumerate(t.split("\n"))]
    found = sorted(x for x in found if len(x[2]) >= line_dedup.MIN_CHARS)
    top = list(range(len(found)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, _, x) in enumerate(found):
        for j in range(i):
            y = found[j][2]
            if x == y or (abs(len(x) - len(y)) <= 2 and lines_alike(x, y)):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {(d, p) for i, (d, p, _) in enumerate(found) if root(i) != i}


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip().ljust(n, "x") for n in (60, 60, 60, 41, 39, 21)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join([*lines, "short", f"own line of document number {i} only"])))
    rows += [(100, None), (101, ""), (102, "short\nshort\n\n"), (103, "  " + base[0] + "\t"), (104, base[1] + "\r\n" + "z" * 50_000), (105, "z" * 50_000)]
    source = docs(spark, rows).withColumns({"h": F.lit(1), "line": F.lit("clash"), "id": F.lit(5), "label": F.lit(0), "removed": F.lit(3)})
    out = line_dedup.dedup(source, report="gone").collect()
    gone = brute_lines(rows)
    assert {(r["doc_id"], x["pos"]) for r in out for x in r["gone"] or []} == gone
    for r in out:
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (r["doc_id"], p) not in gone))
    assert out[0]["label"] == 0 and out[0]["removed"] == 3


def test_many_removed_lines_of_one_document(spark):
    text = "\n".join(f"line {i % 40}" for i in range(30_000))
    began = time.monotonic()
    (row,) = line_dedup.dedup(docs(spark, [(1, text)])).collect()
    assert row["text"] == "\n".join(f"line {i}" for i in range(40)) and time.monotonic() - began < 60


def test_lines_of_repeated_rows_nulls_and_empty_tables(spark):
    line = "a line that is long enough to be judged by far, surely"
    out = line_dedup.dedup(docs(spark, [(1, line), (1, line), (None, line), (2, line)])).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in out) == [((False, 1), line), ((False, 1), line), ((False, 2), ""), ((True, 0), "")]
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def reworded(rng, line, n):
    w = line.split()
    for _ in range(n):
        k, what = rng.randrange(len(w)), rng.randrange(3)
        w[k : k + (what > 0)] = [] if what == 2 else ["".join(rng.choice("klmno") for _ in range(rng.randrange(4, 9)))]
    return " ".join(w)


def words_alike(x, y):
    a, b = sorted((x.split(), y.split()), key=len)
    return len(a) >= 5 and edit_distance(a, b) <= max(1, len(a) // 10)


def test_lines_with_few_edited_words_share_a_bucket_and_are_verified():
    rng = random.Random(4)
    for n in [*range(5, 60), 80, 99, 120, 200, 330, 450]:
        for _ in range(4):
            x = prose(rng, n)
            y = reworded(rng, x, rng.randrange(1, n // 10 + 3))
            keys, owner = line_dedup.word_buckets([x, y])
            assert (line_dedup.word_distances([x], [y])[0] <= 1) == words_alike(x, y)
            if words_alike(x, y):
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    a = "这是一个没有空格的句子它很长而且只有两个字不同"
    assert line_dedup.word_distances([a], [a[:9] + "十" + a[10:]])[0] <= 1


def test_rare_runs_keep_alike_lines_together_and_passages_apart():
    rng = random.Random(14)
    passage = prose(rng, 60)
    lines = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(300)]
    lines += [reworded(rng, lines[i], 11) for i in range(100)] + ["a " * 60 + "b", "a " * 30 + "c " + "a " * 30]
    counts = np.bincount(line_dedup.slots(line_dedup.long_runs(*line_dedup.word_hashes(lines), 10)[0]), minlength=line_dedup.SLOTS)
    levels = np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)
    for ordered in (None, levels):
        keys, owner = line_dedup.word_buckets(lines, 10, ordered)
        filed = [set(keys[owner == i].tolist()) for i in range(len(lines))]
        for i in range(100):
            assert not words_alike(lines[i], lines[300 + i]) or filed[i] & filed[300 + i]
        assert filed[400] & filed[401]
    assert max(np.unique(keys, return_counts=True)[1]) <= 4  # what 400 lines share is no key


def test_runs_at_far_places_bring_no_lines_together(spark):
    rng = random.Random(21)
    lines = []
    for _ in range(60):  # each run stands in three lines, mostly at other places or in lines of another length
        run = prose(rng, 4)
        for _ in range(3):
            w = prose(rng, rng.randrange(40, 140)).split()
            at = rng.randrange(len(w))
            lines.append(" ".join([*w[:at], run, *w[at:]]))
    lines += [reworded(rng, lines[i], rng.randrange(1, 9)) for i in range(60)]
    lines += ["a " * 60 + "b", "a " * 30 + "c " + "a " * 30, prose(rng, line_dedup.TOP - 5)]
    lines.append(f"{prose(rng, 20)} {lines[-1]}")  # the run's places and the line's length are over TOP
    batch = pd.DataFrame({"h": np.arange(len(lines)), "line": lines})
    filed = pd.concat(line_dedup._file(line_dedup.placed_word_buckets)(iter([batch])))
    members = spark.createDataFrame(filed, "bucket long, id long, size short, low short, high short")

    def met(reach):
        buckets = {}
        for r in links.shared_buckets(members, "places", reach).collect():
            buckets.setdefault(r["bucket"], []).append(r["id"])
        return {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}

    near, shared = met(F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 10))), met(None)
    alike = {(i, 180 + i) for i in range(60) if words_alike(lines[i], lines[180 + i])} | {(240, 241), (242, 243)}
    assert len(alike) > 30 and alike <= near <= shared
    assert len(near - alike) < 0.3 * len(shared - alike) and len(shared - alike) > 60


def test_lines_with_edited_words_against_brute_force(spark):
    rng = random.Random(9)
    base = [prose(rng, n) for n in (10, 16, 25, 60, 100)]
    rows = [(i, reworded(rng, base[i % 5], rng.choice([0, 1, 1, 2, 3, 6, 10]))) for i in range(150)]
    top = list(range(150))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j in range(i):
            y = rows[j][1]
            if x == y or (abs(len(x) - len(y)) <= 2 and lines_alike(x, y)) or (min(len(x), len(y)) >= 40 and words_alike(x, y)):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    want = {i for i in range(150) if root(i) != i}
    got = line_dedup.dedup(docs(spark, rows), report="gone", every=line_dedup.EVERY).where("gone is not null")
    assert {r["doc_id"] for r in got.collect()} == want


# --- near duplicates ------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def brute_groups(rows):
    sets = {i: minhash.weighted(tokens.words([t])[0]) for i, t in rows}
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i, _ in rows if len(sets[i][0]))
    for i in ids:
        for j in ids:
            if j < i and minhash.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in top}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    base = [prose(rng, 150) for _ in range(4)]
    rows = [(i, changed(rng, base[0], rng.choice([1, 2, 3, 4, 5, 6, 8, 12]))) for i in range(120)]  # one group with many outsiders
    rows += [(200 + i, changed(rng, base[1 + i % 3], rng.randrange(5))) for i in range(30)] + [(300 + i, prose(rng, rng.randrange(1, 60))) for i in range(30)]
    rows += [(400 + i, " ".join(base[1].split()[: 100 + 3 * i])) for i in range(17)]  # a chain of fronts of one text
    rows += [(500, None), (501, ""), (502, "!!! ... ?"), (503, "one two"), (504, "One, two!"), (505, "one two three"), (BIG, base[0] + " " + prose(rng, 3)), (600, prose(rng, 20_000))]
    rows += [(601, dict(rows)[600])]
    source = docs(spark, rows).withColumns({"item": F.lit("clash"), "th": F.lit(1), "bucket": F.lit(2), "label": F.lit(3), "n": F.lit(4)})
    got = {r["doc_id"]: r for r in minhash.groups(source).collect()}
    want = brute_groups(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["class_id"] == i) and r["class_size"] == list(want.values()).count(want[i]) for i, r in got.items())
    kept = minhash.dedup(source)
    assert kept.columns == source.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in want.items() if i == r}


def test_near_duplicates_that_repeat_passages(spark):
    rng = random.Random(12)
    rows, alike = [], 0
    for i in range(40):
        text, passage = prose(rng, 120), prose(rng, rng.choice([6, 12, 30]))
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        rows += [(10 * i, text + f" {passage}" * n), (10 * i + 1, changed(rng, text, rng.randrange(3)) + f" {passage}" * m), (10 * i + 2, f"{text} {passage}" * 3)]
        x, y = (minhash.weighted(tokens.words([t])[0]) for _, t in rows[-3:-1])
        alike += minhash.probability_jaccard(x, y) >= 0.8
    want = brute_groups(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.groups(docs(spark, rows)).collect()}
    assert 5 < alike < 35
    linked = [i for i, c in want.items() if i != c]
    assert len(linked) > 30 and np.mean([got[i] == want[i] for i in linked]) >= 0.9 and all(got[i] == i for i, c in want.items() if i == c)


def test_boilerplate_sharers_and_copies_of_an_edited_leader(spark):
    """Members of one bucket that share most of their words, few of them alike; and a group in which more than HEAVY members have what its leader lacks."""
    rng = random.Random(21)
    common = prose(rng, 90)
    rows = [(i, f"{common} {prose(rng, rng.randrange(20, 60))}") for i in range(120)]
    rows += [(200 + i, changed(rng, dict(rows)[i % 7], rng.randrange(3))) for i in range(40)]
    base = prose(rng, 100)
    rows += [(300 + i, changed(rng, base, rng.choice([1, 1, 2, 3, 4, 5, 7]))) for i in range(150)]
    want = brute_groups(rows)
    assert {r["doc_id"]: r["class_id"] for r in minhash.groups(docs(spark, rows)).collect()} == want


def test_bound_is_never_below_the_similarity():
    rng = random.Random(5)
    f = lambda u, v, p, q: u * v / (max(v + (1 - q) * u, u + (1 - p) * v) + 1e-300)
    for _ in range(300):
        words_x = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 60))]
        words_y = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 60))] if rng.random() < 0.3 else [w if rng.random() < 0.9 else "z" for w in words_x]
        x, y = (minhash.weighted(tokens.words([" ".join(w)])[0], 1) for w in (words_x, words_y))
        cells = {}
        for k, (keys, weights) in enumerate((x, y)):
            for key, w in zip(keys.tolist(), weights / weights.sum(), strict=True):
                cells.setdefault(key % 5, [0.0, 0.0])[k] += w
        common = set(x[0].tolist()) & set(y[0].tolist())
        p, q = (sum(w for k, w in zip(s[0].tolist(), s[1] / s[1].sum(), strict=True) if k in common) for s in (x, y))
        true = minhash.probability_jaccard(x, y)
        assert not common or true <= 1 / (1 / p + 1 / q - 1) + 1e-9
        assert true <= sum(f(u, v, 1.0, 1.0) for u, v in cells.values()) + 1e-9


def test_long_words_of_the_same_blocks_are_different_words():
    a, b = "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096
    assert len(set(tokens.words([a, b, "a" * 8192])[0].tolist())) == 3


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    text = prose(random.Random(1), 40)
    out = minhash.groups(docs(spark, [(1, text), (1, text), (None, text), (None, "alone in this table it stands"), (2, None)])).collect()
    assert sorted(((r["doc_id"] or 0, r["kept"], r["class_size"]) for r in out)) == [(0, False, 3), (0, True, 1), (1, True, 3), (1, True, 3), (2, True, 1)]
    assert minhash.groups(docs(spark, [])).count() == 0 and minhash.dedup(docs(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for low, high in ((0, 300), (100, 220), (40, 260)):
        a, b = (keys[:high], rng.integers(1, 5, high).astype(float)), (keys[low:], rng.integers(1, 5, 300 - low).astype(float))
        s = minhash.signatures(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.repeat([0, 1], [len(a[0]), len(b[0])]), 2, 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(minhash.probability_jaccard(a, b), abs=0.04)
    x = (keys[:5], np.array([1.0, 2, 3, 1, 1]))
    y = (keys[2:7], np.array([2.0, 1, 1, 4, 1]))
    px, py = dict(zip(x[0], x[1], strict=True)), dict(zip(y[0], y[1], strict=True))
    want = sum(1 / sum(max(px.get(j, 0) / px[i], py.get(j, 0) / py[i]) for j in {*px, *py}) for i in px if i in py)
    assert minhash.probability_jaccard(x, y) == pytest.approx(want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 30)]
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    got = {r["id"]: r["label"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


def test_only_members_that_another_can_be_close_to_have_their_elements_looked_at(spark):
    # leader 1 meets 2, 3 and 4 alone, by a bucket each; 5, 6 and 7 in one bucket; 8 and 9 meet by a bucket of their own, which 1 isn't in
    buckets = [(1, 2), (1, 3), (1, 4), (1, 5, 6, 7), (1, 8), (1, 9), (8, 9)]
    members = spark.createDataFrame([(k, i) for k, ids in enumerate(buckets) for i in ids], "bucket long, id long")
    stars = {(r["leader"], r["id"]): r["met"] for r in links.stars([members], "met").collect()}
    assert {i for (a, i), met in stars.items() if a == 1 and met} == {5, 6, 7, 8, 9}
    assert {i for (a, i), met in stars.items() if a == 1 and not met} == {2, 3, 4}
    rows = [(1, 5, 100, 60.0), (1, 6, 105, 66.0), (1, 7, 100, 5.0), (1, 8, 300, 62.0), (2, 5, 100, 60.0), (3, 5, 100, 60.0), (3, 6, 100, 60.0)]
    known = spark.createDataFrame([(a, i, n, x, float(n // 10), i if a < 3 else 5, True) for a, i, n, x in rows], "leader long, id long, n long, lacks double, slack double, label long, outsider boolean")
    assert sorted(links.comparable(known, F.col("xn") + F.floor(F.col("xn") / 10)).collect()) == [(1, 5), (1, 6)]


def test_words():
    h, first, start, end = tokens.words(["  Héllo wörld_x", None, "", "HÉLLO"])
    assert first.tolist() == [0, 3, 3, 3, 4] and h[0] == h[3] and end[0] - start[0] == 5
    assert tokens.words([])[0].size == 0 and list(tokens.chunks(["a" * 10, "b", "c" * 5], 10)) == [(0, 1), (1, 3)]


def test_buckets_are_joined_in_parts(spark):
    lines = [" ".join(f"w{i % 7}{j}" for j in range(6 + i // 7)) for i in range(60)]
    batch = pd.DataFrame({"h": np.arange(len(lines)), "line": lines})

    def rows(part, parts):
        filed = pd.concat(line_dedup._file(line_dedup.word_buckets, part, parts)(iter([batch])))
        return Counter(zip(filed["bucket"].tolist(), filed["id"].tolist(), strict=True))

    parts = [rows(p, 3) for p in range(3)]
    assert all(parts) and sum(parts, Counter()) == rows(0, 1)
    assert not {b for b, _ in parts[0]} & {b for b, _ in parts[1]}
    members = [spark.createDataFrame(list(p.elements()), "bucket long, id long") for p in [*parts, rows(0, 1)]]
    told = [links.classes(m, lambda p: p.withColumn("d", F.when(F.col("a") % 7 == F.col("b") % 7, 0.5).otherwise(3.0)), 1 + 1e-9, "parts")[0] for m in (members[:3], members[3])]
    assert sorted(told[0].collect()) == sorted(told[1].collect()) and told[0].count() == len(lines)
