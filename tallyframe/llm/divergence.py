"""Source divergence audit: how far the words of each source lie from those of the other sources of its language, and which words set it apart.

Plain relational: words are exploded out of the texts and counted by language, source and word; a language keeps the
words that enough of its documents have; every group (a source in a language) is crossed with the kept words, zeros and
all; a self-join on language and word gives each pair of groups its terms, which are summed and ranked.

One row holds a kept word with the smoothed shares of all groups of its language, so crossing and self-join happen where
the row lies: two explodes of the same array, and only sums for each pair of groups are shuffled. The array has a number
for each source of the language, of which the report itself lists all pairs.

Arithmetic is exact: shares are whole billionths, from decimals that counts of any table fit in. A sum over all words stays
within 64 bits for up to two billion kept words, and beyond them is an error rather than a wrong number.

Defined results: null text, language and source are empty strings, and an empty source or language is a group like any
other; a group without words has the smoothed shares of zero counts; a language without kept words gives pairs of value 0
and no words; every row is a document, also where ids repeat; a text of any length is one array of its words; ties go by
the item's UTF-8 bytes; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: A word is a run of ASCII letters and of anything beyond ASCII, which is what lies between runs of all else; shares are in billionths.
WORD, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
WHOLE = 1_000_000_000
#: Documents of a language that must have a word, and words listed for each group.
LEAST_DOCS, TOP = 3, 200


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that have it). A document's words are sorted, so that equal ones are a run: one row for each, without moving the document.

    Words are found as the pieces between matches, which is an eighth of the time that regexp_extract_all takes for the same words.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(empty("lang"), empty("source"), F.sort_array(F.split(lower, BETWEEN)).alias("ws"))
    begin = F.transform("ws", lambda w, i: F.when((i == 0) | (F.get("ws", i - 1) != w), i))
    runs = words.withColumn("begin", F.filter(begin, lambda i: i.isNotNull()))
    run = F.transform("begin", lambda i, j: F.struct(F.get("ws", i).alias("term"), (F.coalesce(F.get("begin", j + 1), F.size("ws")) - i).alias("k")))
    return runs.select("lang", "source", F.inline(run)).where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("k").alias("n"), F.count("*").alias("d"))


def kept_words(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """A row for each language and word that `least` of its documents have: lang, term, n, counts (a map from source to occurrences, one entry for each source at most)."""
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    words = counted(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), by_source.alias("counts"))
    return words.where(F.col("d") >= least).drop("d")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kinds)), exactly: in 64 bits where the product fits, which a word has to occur nine billion times to leave."""
    wide = ((n + 1).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)")).cast("decimal(38,0)")
    div = lambda a, b: F.call_function("div", a, b)
    return F.when(n < 2**63 // WHOLE - 1, div((n + 1) * WHOLE, total + kinds)).otherwise(div(wide, (total + kinds).cast("decimal(20,0)"))) + 1


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each language: lang, kinds (kept words), total (their occurrences), groups (source and total of each, by source)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    occurring = docs.select(empty("lang"), empty("source")).distinct()
    totals = words.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = words.groupBy("lang").agg(F.count("*").alias("kinds"))
    each = occurring.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
    listed = F.sort_array(F.collect_list(F.struct("source", "total")))
    return each.groupBy("lang").agg(F.first("kinds").alias("kinds"), F.sum("total").alias("total"), listed.alias("groups"))


def report(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    words = cut(kept_words(docs, least), "words")
    langs = small(cut(groups_of(docs, words), "groups"))
    dense = words.join(langs.withColumnsRenamed({"total": "lang_total"}), "lang")
    # a count is looked up once for each group, and the shares are written once for both parts
    n = F.transform("groups", lambda g: F.coalesce(F.col("counts")[g["source"]], F.lit(0).cast("long")))
    dense = dense.select("lang", "term", "groups", "kinds", share(F.col("n"), F.col("lang_total"), F.col("kinds")).alias("q"), n.alias("ns"))
    shares = F.transform("groups", lambda g, i: share(F.get("ns", i), g["total"], F.col("kinds")))
    dense = cut(dense.select("lang", "term", "q", "ns", shares.alias("ps")), "shares")

    # both sides of the self-join come out of the word's own row
    one = dense.select("lang", "ps", F.posexplode("ps").alias("i", "p"))
    both = one.select("lang", "i", "p", F.posexplode("ps").alias("j", "other")).where("i <> j")
    sums = both.groupBy("lang", "i", "j").agg(F.sum(surprise(F.col("p"), F.col("other"))).alias("value"))
    source = lambda c: F.get("groups", F.col(c))["source"]
    pairs = sums.join(langs.select("lang", "groups"), "lang").select("lang", source("i").alias("source"), source("j").alias("item"), "value")
    bare = langs.where("kinds = 0").select("lang", "groups", F.explode("groups.source").alias("source"))
    bare = bare.select("lang", "source", F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    own = dense.select("lang", F.col("term").alias("item"), "q", "ns", F.posexplode("ps").alias("i", "p")).where((F.get("ns", "i") > 0) & (F.col("p") > F.col("q")))
    own = own.select("lang", "i", "item", surprise(F.col("p"), F.col("q")).alias("value"))
    by_group = Window.partitionBy("lang", "i").orderBy(F.desc("value"), F.asc("item"))
    own = own.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top).join(langs.select("lang", "groups"), "lang")
    terms = own.select("lang", source("i").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


SQL = r"""
    with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    t as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    k as (select lang, term from t group by lang, term having count(distinct r) >= 3),
    v as (select lang, count(*) as v from k group by lang),
    c as (select lang, source, term, count(*) as n from t group by all),
    g as (select distinct lang, source from d),
    e as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    s as (select lang, source, sum(n) as total from e group by all),
    p as (select lang, source, term, n, (1 + (1000000000 * (n + 1)) // (total + v))::bigint as p from e join s using (lang, source) join v using (lang)),
    l as (select lang, term, sum(n) as n from e group by all),
    q as (select lang, term, (1 + (1000000000 * (n + 1)) // (sum(n) over (partition by lang) + v))::bigint as q from l join v using (lang)),
    pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    every as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
    terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q)
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from every
    union all
    select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200"""
