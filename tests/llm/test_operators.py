"""Decontamination, chat, packing, sharding, secrets, URLs and languages against plain statements of their rules."""

import bisect
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat_format, decontaminate, language_id, packing, queries, secret_scan, sharding, tokens, url_filter

BIG = 2**60 + 1
DOC = "doc_id long, text string"

# --- decontamination ------------------------------------------------------------------------------


def holds(text, item):
    t, i = (tokens.words([x or ""])[0] for x in (text, item))
    size = min(13, len(i))
    if not len(i) or len(t) < size:
        return False
    windows = np.lib.stride_tricks.sliding_window_view(t, size)
    return any(((windows != i[k : k + size]).sum(axis=1) <= (2 if len(i) >= 13 else 1 if len(i) >= 5 else 0)).any() for k in range(len(i) - size + 1))


def test_masks_leave_out_every_pair_of_positions():
    for pair in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not {at + p for p in mask} & set(pair) for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - mask[-1]))


def test_matches_against_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, say(rng.randrange(22))) for i in range(15)] + [(50, None), (51, "x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 y4 y5 y6"), (51, "again x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2")]
    rows = [(i, say(rng.randrange(70))) for i in range(50)] + [(100, None), (101, ""), (BIG, "X1, x2 x3 -- x4 ZZ x6 x7 x8 x9 y1 WW y3 y4"), (None, items[16][1]), (103, "q " * 60_000 + items[16][1])]
    source = spark.createDataFrame(rows, DOC).withColumns({"item": F.lit(1), "id": F.lit("clash"), "n_words": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.matches(source, bench).collect())
    assert got == Counter((d, i) for d, t in rows for i, x in items if holds(t, x))
    kept = decontaminate.clean(source, bench)
    assert kept.columns == source.columns and {r["doc_id"] for r in kept.collect()} == {d for d, t in rows if not any(holds(t, x) for _, x in items)}
    hit = next(r for r in decontaminate.matches(source, bench).collect() if r["doc_id"] == BIG and r["item_id"] == 51)
    assert (hit["text_word"], hit["item_word"], hit["n_words"], hit["n_replaced"]) == (0, 0, 13, 2)


def test_short_items_with_a_replaced_word():
    rng = random.Random(6)
    for n in range(1, 13):
        item = [f"w{n}x{k}" for k in range(n)]
        for k in range(n):
            one = [*item[:k], "other", *item[k + 1 :]]
            two = [*one[: (k + 2) % n], "more", *one[(k + 2) % n + 1 :]]
            texts = [" ".join(["so", *x, "ends"][rng.randrange(2) :]) for x in (item, one, two)]
            block = decontaminate.Block([(1, " ".join(item))])
            assert [(t, r) for t, _, _, _, _, r in block.scan(texts)] == [(0, 0), *([(1, 1)] if n >= 5 else [])]


def test_a_passage_that_many_items_share_and_a_text_repeats():
    preamble = " ".join(f"p{k}" for k in range(13))
    block = decontaminate.Block([(i, f"{preamble} own{i}a own{i}b") for i in range(2000)])
    began = time.monotonic()
    found = list(block.scan(["x", " ".join([preamble] * 800), f"{preamble} own7a own7b"]))
    assert time.monotonic() - began < 15
    assert [r[:1] + r[2:] for r in found if r[1] == 7] == [(1, 0, 0, 15, 2), (2, 0, 0, 15, 0)]  # the words behind count as replaced
    assert len(found) == 4000


def test_repeated_documents_give_a_row_each(spark):
    text = "so one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontaminate.matches(spark.createDataFrame([(1, text)] * 3 + [(2, text)], DOC), bench).count() == 4


def test_matches_of_empty_tables_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    none = spark.createDataFrame([], DOC)
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0
    doc = spark.createDataFrame([(1, "so one two three four five six seven ends")], DOC)
    assert decontaminate.matches(doc, bench.limit(0)).count() == 0 and decontaminate.clean(doc, bench.limit(0)).count() == 1
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    assert decontaminate.matches(doc, bench.union(bench)).count() == 2


# --- chat -----------------------------------------------------------------------------------------


def test_template_can_be_read_back():
    rng = random.Random(1)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "]", ">", "/s>", "s>", "text", "\n", "é😀", ""]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=6))) for _ in range(4)]
        assert chat_format.read_back("".join(chat_format.segment(r, t)[0] for r, t in turns)) == turns


def test_tree_and_digests(spark):
    rng = random.Random(4)
    rows = [(c if c else None, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "\\x<s>", None, "é😀"])) for c in range(50) for k in range(rng.randrange(1, 6))]
    rows += [(BIG, 0, "user", "a" * 100_000)] + [(900, None, "user", "n")] + [(901 + i, 0, "user", "hot") for i in range(40)] + [(950, 1, "user", "b"), (950, 1, "user", "a"), (950, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit("x"), "node": F.lit(1), "k": F.lit(2), "rank": F.lit(3)})
    tree, paths = chat_format.build(df)
    nodes = {bytes(r["node"]): r for r in tree.collect()}
    by_conv = {}
    for r in paths.collect():
        by_conv.setdefault(r["cid"], {})[r["k"]] = bytes(r["node"])
    stream = [None] * sum(r["length"] for r in nodes.values())
    for r in nodes.values():
        for j, c in enumerate(r["segment"]):
            assert stream[r["start"] + j] is None
            stream[r["start"] + j] = c
    prefixes = set()
    for path in by_conv.values():
        for k, n in path.items():
            before = "".join(nodes[path[i]]["segment"] for i in range(k))
            assert "".join("".join(stream[a["start"] : a["end"]]) for a in nodes[n]["ancestors"]) == before
            assert nodes[n]["position"] == len(before) and nodes[n]["depth"] == k
            prefixes.add(tuple(path[i] for i in range(k + 1)))
    assert len(prefixes) == len(nodes)  # each shared run of turns is there once
    turns = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(tree, paths)).collect()}
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.segment(r, t)[0]) for r, t in own))
        assert tuple(got[c])[1:] == want
    assert set(got) == set(turns)


def test_chat_of_an_empty_table_and_with_a_tokenizer(spark):
    schema = "conv_id long, turn long, role string, text string"
    tree, paths = chat_format.build(spark.createDataFrame([], schema))
    assert tree.count() == 0 and chat_format.digests(chat_format.formatted(tree, paths)).count() == 0
    tree, _ = chat_format.build(spark.createDataFrame([(1, 0, "user", "hello there")], schema), queries.tokenizer_path("byte_bpe_50k.json"))
    row = tree.first()
    assert row["length"] == len(row["ids"]) > 0


# --- packing --------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["It's İstanbul ΣΑΣ don'T we'LL <|endoftext|> a", "", None, "  a\tb", "ß ﬁ 🎉", "\x1c\x85a", "long " * 9000] + ["".join(rng.choice("aAb'sSt \n1²éÉÈ.,<|>🎉中") for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (BIG, "x"), (None, "y")]
    source = spark.createDataFrame(rows, DOC).withColumns({"length": F.lit("clash"), "part": F.lit(1), "id": F.lit(2), "first": F.lit(0)})
    for capacity in (64, 4096):
        got = packing.pack(packing.pieces(source, path, capacity), capacity).collect()
        want = Counter()
        for i, t in rows:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
            want.update((i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        placed = {}
        for r in got:
            placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for spans in placed.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(placed) <= 1 + 1.1 * sum(r["length"] for r in got) / capacity
    with_ids = packing.pieces(source, path, 64, with_ids=True).first()
    assert len(with_ids["ids"]) == with_ids["length"]
    assert packing.pack(packing.pieces(source.limit(0), path)).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Sequences that the plain algorithm opens."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["long", "short", "mixed", "equal"])
def test_packing_opens_about_as_few_sequences_as_best_fit_decreasing(spark, kind):
    rng = random.Random(kind)
    capacity = 4096
    draw = {"long": lambda: rng.randrange(1, capacity + 1), "short": lambda: rng.randrange(1, 60), "mixed": lambda: min(capacity, int(rng.lognormvariate(5.5, 1.3)) + 1), "equal": lambda: 1000}[kind]
    lengths = [draw() for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "rid long, length int")
    seqs = packing.sequences(df, capacity).collect()
    assert Counter((r["rid"], r["length"]) for r in seqs) == Counter(enumerate(lengths))
    used = Counter()
    for r in seqs:
        used[r["seq"]] += r["length"]
    assert max(used.values()) <= capacity
    assert len(used) <= 1.003 * best_fit_decreasing(lengths, capacity) + 1


def test_bands_hold_every_length_once():
    for capacity in (1, 2, 10, 64, 333, 4096):
        lengths = [n for low, high, _ in packing.bands(capacity) for n in range(low + 1, high + 1)]
        assert sorted(lengths) == list(range(1, capacity + 1))


def test_pieces_take_the_gaps_of_partitions_before():
    runs, took = packing.across([(0, 2, 5), (1, 3, 1), (2, 4, 0), (3, 1, 2)])
    assert runs == [(1, 0, 3, 0, 5), (2, 0, 1, 1, 1), (2, 1, 3, 0, 2)] and took == {0: 0, 1: 3, 2: 3, 3: 0}


def test_a_superstep_gives_each_piece_the_first_gap_that_is_left(spark):
    rng = random.Random(8)
    for _ in range(4):
        pieces = [(i, rng.randrange(20, 40)) for i in range(60)]
        gaps = [(i, rng.randrange(1, 45)) for i in range(50)]
        matched, left, over, _ = packing.superstep(spark.createDataFrame(pieces, "rid long, length int"), spark.createDataFrame(gaps, "seq long, free long"), 19, 40)
        room, want = sorted((g, s) for s, g in gaps if g > 19), []
        for n in sorted((n for _, n in pieces), reverse=True):
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                want.append((n, room.pop(at)[0]))
        free = dict(gaps)
        assert sorted((r["length"], free[r["seq"]]) for r in matched.collect()) == sorted(want)
        assert over == len(pieces) - len(want) and sorted(r["nth"] for r in left.collect()) == list(range(over))


# --- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 5, 1000])
def test_shards(spark, n):
    df = spark.createDataFrame([(i if i % 7 else None, f"t{i % 3}") for i in range(n)], DOC).withColumns({"slot": F.lit("clash"), "shard": F.lit("clash")})
    out = sharding.shard(df, 16).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == n and all(sizes[s] == n // 16 + (s < n % 16) for s in range(16))
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i if i % 7 else None, f"t{i % 3}") for i in range(n))
    if n == 1000:  # neighbours are scattered, copies are spread
        assert max(Counter(r["shard"] for r in out if r["text"] == "t0").values()) < 40


def test_shards_of_very_long_texts(spark):
    out = sharding.shard(spark.createDataFrame([(i, "x" * 400_000) for i in range(20)], DOC), 16).collect()
    assert len(out) == 20 and all(len(r["text"]) == 400_000 for r in out)


def test_matrix_has_exact_sums_and_the_right_spread():
    for counts in ([0], [3], [10, 0, 7], [100] * 9):
        m = sharding.matrix(counts, 4, 1)
        assert m.sum(axis=1).tolist() == counts and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    draws = [sharding.matrix([500, 500], 2, s)[0, 0] for s in range(400)]
    assert np.mean(draws) == pytest.approx(250, abs=3) and np.var(draws) == pytest.approx(250 * 0.25, rel=0.3)


def test_large_counts_by_inversion(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 1)
    draws = [sharding.hypergeometric(rng, 300, 700, 100) for _ in range(3000)]
    assert np.mean(draws) == pytest.approx(30, abs=0.4) and np.var(draws) == pytest.approx(100 * 0.3 * 0.7 * 900 / 999, rel=0.12)
    assert abs(sharding.hypergeometric(rng, 4 * 10**9, 4 * 10**9, 10**9) - 5 * 10**8) < 10**6


# --- secrets --------------------------------------------------------------------------------------

KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def spans(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, good) in enumerate(KINDS) for m in p.finditer(text or "") if good(m)]
    return ",".join(x[2] for x in sorted(found))


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(2)
    parts = ["token", "secret", "PASSWORD", "passwd", "api_key", "apiKey", "=", ": ", "'", '"', " ", "abc", "defghi12", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "ab", "\x01", "\x02", "\x03", "é", "😀", "\n", "$1", "\\", "tokeN", "ſecret"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(14)))) for i in range(1500)] + [(2000, None), (2001, ""), (None, "token=abcdefgh"), (2002, "x" * 300_000 + " secret: abcdef"), (2003, "secret=token:abcdef")] + [(3000, "token=abcdefgh")] * 50
    df = spark.createDataFrame(rows, DOC).withColumns({"blob": F.lit(1), "kind": F.lit("clash"), "path": F.lit(0), "found": F.lit(0)})
    found, _ = secret_scan.findings(df)
    got = Counter((r["doc_id"], r["s"]) for r in found.select("doc_id", secret_scan.listed(secret_scan.RULES).alias("s")).collect())
    assert got == Counter((i, spans(t)) for i, t in rows)


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "nothing")], "doc_id string, text string")
    found, ledger = secret_scan.findings(first)
    assert ledger.count() == 6
    second = spark.createDataFrame([("a", "token=abcdefgh"), ("c", "token=abcdefgh"), ("a", "password=zzzzzzzz")], "doc_id string, text string")
    found, new = secret_scan.findings(second, ledger=ledger)
    assert new.count() == 3 and Counter((r["doc_id"], len(r["assign"])) for r in found.collect()) == Counter([("a", 1), ("c", 1), ("a", 1)])
    stricter = (secret_scan.Rule("assign", 2, r"(?i:password)=", "[a-z]+", 6), *secret_scan.RULES[1:])
    found, new = secret_scan.findings(second, rules=stricter, ledger=ledger.unionByName(new))
    assert new.count() == 2 and {(r["kind"], r["version"]) for r in new.collect()} == {("assign", 2)}
    assert Counter((r["doc_id"], len(r["assign"])) for r in found.collect()) == Counter([("a", 0), ("c", 0), ("a", 1)])
    assert secret_scan.findings(first.limit(0))[0].count() == 0


def test_history_scans_each_pair_once(spark):
    rng = random.Random(7)
    rows = [(i, f"token=abcdef{rng.randrange(30)} {'deadbeef' * rng.randrange(5)}") for i in range(200)]
    commits = [spark.createDataFrame(rows[a : a + 50], DOC) for a in range(0, 200, 50)]
    found, ledger = secret_scan.history(commits)
    assert ledger.count() == ledger.select("blob", "kind", "version").distinct().count() == 3 * len({t for _, t in rows})
    got = Counter((r["doc_id"], r["s"]) for r in found.select("doc_id", secret_scan.listed(secret_scan.RULES).alias("s")).collect())
    assert got == Counter((i, spans(t)) for i, t in rows)


def test_places_that_begin_alike(spark):
    key = "AKIA" + "0123456789ABCDEF0123"
    text = f"token={key} secret={'0123456789abcdef' * 2}"
    found, _ = secret_scan.findings(spark.createDataFrame([(1, "0" * 30 + " " + text), (2, key + "=0")], DOC))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", secret_scan.listed(secret_scan.RULES).alias("s")).collect()}
    assert got == {1: spans("0" * 30 + " " + text), 2: spans(key + "=0")}


def test_secret_scan_runs_no_python(spark):
    found, _ = secret_scan.findings(spark.createDataFrame([(1, "x")], DOC))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


# --- URLs -----------------------------------------------------------------------------------------


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    kinds = {"run": "[^/]*", "all": "(?s:.*)", "one": "[^/]"}
    for _ in range(150):
        globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?", "\\*"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 25))]
        texts = ["".join(rng.choice("ab/.cé*") for _ in range(rng.randrange(14))) for _ in range(30)]
        fits = url_filter.Automaton(globs).fits(texts)
        for j, g in enumerate(globs):
            p = re.compile("".join(kinds.get(s) or re.escape(s) for s in url_filter.parse(g)) + r"\Z")
            assert fits[:, j].tolist() == [bool(p.match(t)) for t in texts]


def test_urls(spark):
    rows = [
        (1, "http://Example.ORG/es/x?y=1", "example.org", "/es/x", "example.org/es/", "block"), (2, "https://a.example.org/en/12#t", "a.example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (4, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), (5, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        (6, "http://x.com/en/", "x.com", "/en/", None, "allow"), (7, "http://www.cheap-pills.com/", "www.cheap-pills.com", "/", None, "block"), (8, "http://example.org", "example.org", "", None, "allow"),
        (9, None, "", "", None, "allow"), (10, "no scheme/es/", "", "", None, "allow"), (11, "x://y.org/a://b", "y.org", "/a://b", "org/", "allow"), (12, "http://ÄB.com/Fr/", "Äb.com", "/Fr/", None, "allow"), (13, "http://org/", "org", "/", "org/", "allow"),
        (15, "http://a.example.org/es/en/1", "a.example.org", "/es/en/1", "example.org/es/", "block"), (14, "http://h.net/" + "p" * 20_000, "h.net", "/" + "p" * 20_000, None, "allow"),
    ]
    df = spark.createDataFrame([(i, u) for i, u, *_ in rows] + [(1, rows[0][1])], "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "id": F.lit(2)})
    got = url_filter.judge(df, queries.URL_RULES, queries.URL_BLOCK).collect()
    want = Counter((i, h, p, r, v) for i, _, h, p, r, v in [*rows, rows[0]])
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


# --- languages ------------------------------------------------------------------------------------


def speak(rng, language):
    words = {"xx": "ba be bi bo bu da de di".split(), "yy": "zox qux vix wex jax kix".split(), "zz": "ñoño éà üöä ßeß".split()}[language]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120)))


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    rows = [(i, speak(rng, k), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)] + [(500, None, "xx"), (501, "123 !?", "yy"), (502, "", None), (503, speak(rng, "yy") * 300, None), (None, speak(rng, "zz"), "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"label": F.lit("clash"), "u": F.lit(1), "score": F.lit("old")})
    net = language_id.fit(df)
    out = {r["doc_id"]: r for r in language_id.predict(df, net).collect()}
    assert [out[i]["lang_pred"] for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "yy", "zz"]
    assert [out[i]["score"] for i in (500, 501, 502)] == [0.0] * 3 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [r for i, r in out.items() if i is not None and i < 180 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert out[0]["label"] == "clash"


def test_languages_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.predict(df, language_id.fit(df)).first()["lang_pred"] == "und"
    assert language_id.predict(df.limit(0), language_id.fit(df.limit(0))).count() == 0
    only = spark.createDataFrame([(i, "words of it", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert language_id.predict(only, language_id.fit(only)).first()["lang_pred"] == "xx"


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(i, "same words", k) for i, k in enumerate(["yy", "xx"] * 20)] + [(0, "same words", "yy")] * 2, "doc_id long, text string, lang string")
    out = language_id.predict(df, language_id.fit(df)).collect()
    assert len(out) == 42 and len({(r["lang_pred"], r["score"]) for r in out}) == 1
    tied = language_id.Net(["aa", "bb"], {**language_id.train([b"x"], ["aa"]).params, "dense": np.zeros((48, 2), np.float32), "bias": np.zeros(2, np.float32)})
    assert language_id.predict_texts(tied, tied.tables(), ["some text"]) == (["aa"], [0.5])


def test_sample_takes_windows_of_every_label(spark, monkeypatch):
    rows = [(i, f"{k} " * (1 + i % 700), f"l{k}") for k in range(12) for i in range(k * 20, k * 20 + 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "TEXTS", 36)
    windows, labels = language_id.sample(df, F.lit(True))
    assert set(labels) == {f"l{k}" for k in range(12)} and max(Counter(labels).values()) <= 3 * language_id.WINDOWS
    assert all(0 < len(w) <= language_id.LENGTH for w in windows)


def test_language_query_against_its_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    out = queries.op9_language_id(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]]["text"] or "")) and 0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out} <= {r["lang"] for r in texts.values()} | {"und"}


def test_sharding_query_against_its_rules(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = queries.op5_sharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None) for r in out)
    slots = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(16)]
    assert all(own == list(range(len(own))) for own in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_windows_cover_every_byte():
    texts = [b"a" * 600, b"", b"b" * 256, b"c"]
    x, owner, weight = language_id.windows(texts)
    assert owner.tolist() == [0, 0, 0, 2, 3] and weight.tolist() == [256, 256, 88, 256, 1]
    assert bytes(x[x != language_id.PAD].astype(np.uint8)) == b"".join(texts)


def test_tables_give_what_the_filters_give():
    rng = random.Random(1)
    net = language_id.train([speak(rng, k).encode()[:256] for k in ("xx", "yy") * 5], ["xx", "yy"] * 5)
    x, _, _ = language_id.windows([speak(rng, "xx").encode()])
    pooled = []
    for w in language_id.WIDTHS:
        e = net.params["embed"][x]
        z = np.stack([e[:, i : i + w].reshape(len(x), -1) @ net.params[f"w{w}"] for i in range(x.shape[1] - w + 1)], axis=1)
        pooled.append(np.maximum(z.max(axis=1) + net.params[f"b{w}"], 0))
    want = language_id.softmax(np.concatenate(pooled, axis=1) @ net.params["dense"] + net.params["bias"])
    assert np.allclose(net.probabilities(x, net.tables()), want, atol=1e-5)
