"""Exact classes of similar items from candidate buckets, without all pairs of a bucket.

Any two items that share a bucket are a candidate pair, the similarity is 1 minus a metric, and classes are the connected
components of the pairs that are close enough. All pairs of a bucket need not be looked at:

1. Each bucket has a leader, the member whose buckets are the largest, and each item has a pivot, the weightiest leader of
   its buckets. In a group of edited copies that is the text which they were made from. Every item is compared with its
   pivot, and where the members of a bucket have different pivots also with the bucket's leader: about as many pairs as
   rows. What is close enough is linked.
2. A pair that is left open has been compared with one and the same leader, at least one of the two, the outsider, is not
   close to it, and the two are in different classes. Only members of which two or more, the leader aside, are in one of its
   buckets can make such a pair. For these the operator names the pairs that can still be close, from what has been measured. In general the triangle inequality says so: |d(leader, a) - d(leader, b)| must be within
   the radius. Weighted sets have a much sharper rule, see by_sets.

So no link between two items that share a bucket is lost. Components come from large-star and small-star steps with a
table written to the shared folder after each; their number grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small, tidy

Distances = Callable[[DataFrame], DataFrame]
OpenPairs = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every item of the edges (a, b): label is the least item of its component. Alternating large-star and small-star steps."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        star = cut(star.where("a <> b").distinct(), "small-star")
        sums = [t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for t in (edges, star)]
        edges = star
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def several(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key different items have, and how many rows have it: n."""
    own = Window.partitionBy(*key)
    rows = rows.select("*", F.count("*").over(own).alias("n"), F.min("id").over(own).alias("least"), F.max("id").over(own).alias("most"))
    return rows.where("least < most").drop("least", "most")


def parted(rows: DataFrame, key: list[str], start: str, end: str, reach: Column, to: str) -> DataFrame:
    """Numbers the parts of each key's rows, by their ranges from start to end, between which more than reach is free. Ranges within reach of each other are in one part."""
    order = Window.partitionBy(*key).orderBy(start)
    free = F.col(start) - F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) > reach
    return rows.withColumn(to, F.coalesce(free, F.lit(False)).cast("int")).withColumn(to, F.sum(to).over(order))  # rows with an equal start count together


def shared_buckets(members: DataFrame, name: str, reach: Column | None = None) -> DataFrame:
    """(bucket, id, n) of the buckets that have different items; n counts a bucket's rows.

    reach: members have size, low and high too, and items can only be close if their sizes, and their ranges from low to
    high, are within the reach of the smaller one; it grows with the size. Buckets are then parted where more is free.
    """
    shared = several(members, "bucket")  # items without a like end here
    if reach is not None:
        shared = parted(shared.drop("n"), ["bucket"], "size", "size", reach, "by_size")
        shared = shared.withColumn("reach", F.max(reach).over(Window.partitionBy("bucket", "by_size")))
        shared = several(parted(shared, ["bucket", "by_size"], "low", "high", F.col("reach"), "by_place"), "bucket", "by_size", "by_place")
        shared = shared.withColumn("bucket", F.xxhash64("bucket", "by_size", "by_place"))
    return cut(shared.select("bucket", "id", "n").distinct(), f"{name}-shared")


def stars(members: Sequence[DataFrame], name: str, reach: Column | None = None) -> DataFrame:
    """(leader, id, pivot, met) for all comparisons of step 1; pivot is the item's own. met: whether a bucket that the leader is to settle holds the item and a third one."""
    parts = []
    for m in members:
        parts.append(shared_buckets(m, name, reach))
        if len(members) > 1:
            tidy(m.sparkSession)  # nearly all rows end here, and the next part can have their place on disk
    shared = reduce(DataFrame.union, parts)
    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    lead = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("w", "id")).alias("lead"), F.count("*").alias("k"))
    led = shared.select("bucket", "id").join(lead, "bucket")
    pivot = led.groupBy("id").agg(F.max("lead")["id"].alias("pivot"))
    led = cut(led.select("bucket", "id", F.col("lead.id").alias("leader"), "k").join(pivot, "id"), f"{name}-led")
    mixed = led.groupBy("bucket").agg(F.min("pivot").alias("p"), F.max("pivot").alias("q")).where("p < q").select("bucket")
    # an item's pivot is in a bucket only as its leader, since it outweighs the leaders of the item's other buckets
    own = led.select(F.col("pivot").alias("leader"), "id", "pivot", (F.col("k") - (F.col("leader") == F.col("pivot")).cast("int") > 1).alias("met"))
    others = led.join(mixed, "bucket").select("leader", "id", "pivot", (F.col("k") > 2).alias("met"))
    out = cut(own.union(others).where("leader <> id").groupBy("leader", "id", "pivot").agg(F.max("met").alias("met")), f"{name}-stars")
    release(*parts, led)
    return out


def classes(members: DataFrame | Sequence[DataFrame], distances: Distances, radius: float, name: str, open_pairs: OpenPairs | None = None, reach: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, label) of items that are linked to another, and the links (a, b) that were found.

    members: (bucket, id), a row for each bucket of an item; also as parts that have no bucket in common, which are then
    shuffled one after the other, so that the disk need hold one of them only. distances: adds `d` to pairs (a, b) of items; where that is
    over 2 * radius, any lower bound that is over 2 * radius itself may stand for it. open_pairs: for step 2, takes
    (leader, id, pivot, d, label, outsider) of all leaders that have an outsider and gives the pairs (a, b) to compare.
    reach: see shared_buckets.
    """
    led = stars([members] if isinstance(members, DataFrame) else members, name, reach)
    near = cut(distances(led.select(F.col("leader").alias("a"), F.col("id").alias("b"))).select(F.col("a").alias("leader"), F.col("b").alias("id"), "d"), f"{name}-near")
    if not isinstance(members, DataFrame):
        tidy(near.sparkSession)
    links = near.where(F.col("d") <= radius).select(F.col("leader").alias("a"), F.col("id").alias("b"))
    labels = cut(components(links), f"{name}-labels")
    known = small(labels)
    told = near.join(led.where("met").drop("met"), ["leader", "id"]).join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    told = told.join(known.select(F.col("id").alias("leader"), F.col("label").alias("leader_label")), "leader", "left")
    told = told.withColumn("outsider", (F.col("d") > radius) & (F.col("label") != F.coalesce("leader_label", "leader"))).drop("leader_label")
    told = cut(told.join(told.where("outsider").select("leader").distinct(), "leader"), f"{name}-told")
    if told.isEmpty():
        return labels, links
    left = open_pairs(told) if open_pairs else by_triangle(told, radius)
    left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(distances(left).where(F.col("d") <= radius).select("a", "b"), f"{name}-more")
    return components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)), links.union(more)


#: Whether x and y of one leader are for this leader to settle: in different classes, and not both of another pivot.
OPEN = "xlabel <> label and (xpivot <> pivot or pivot = leader)"
#: An element that more of a leader's members have is common among them, as if the leader had it too.
HEAVY = 32


def by_triangle(told: DataFrame, radius: float) -> DataFrame:
    """Pairs of an outsider and another whose distances to their leader differ by the radius at most."""
    x = told.where("outsider").select("leader", F.col("id").alias("a"), F.col("d").alias("xd"), F.col("label").alias("xlabel"), F.col("pivot").alias("xpivot"))
    y = told.select("leader", F.col("id").alias("b"), "d", "label", "pivot")
    return x.join(y, "leader").where(F.expr(OPEN) & (F.abs(F.col("xd") - F.col("d")) <= radius)).select("a", "b")


def comparable(known: DataFrame, most: Column) -> DataFrame:
    """(leader, id) of the members that some other one of another class, an outsider or theirs, can be close to.

    known: see by_sets, with elements of mass 1; most: the largest size, from `xn`, of one close to it. Of two that are close
    the one's elements that the other hasn't got are within its slack, so their sizes, and what they have that the leader
    lacks, are no further apart. The members are parted where more is free.
    """
    rows = known.select("leader", "id", F.col("n").alias("xn"), "lacks", "slack", "label", "outsider")
    rows = parted(rows, ["leader"], "xn", "xn", most - F.col("xn"), "by_size")
    part = Window.partitionBy("leader", "by_size")
    rows = parted(rows.withColumn("slack", F.max("slack").over(part)), ["leader", "by_size"], "lacks", "lacks", F.col("slack"), "by_lacks")
    part = Window.partitionBy("leader", "by_size", "by_lacks")
    rows = rows.select("leader", "id", F.max("outsider").over(part).alias("any"), F.min("label").over(part).alias("least"), F.max("label").over(part).alias("last"))
    return rows.where("any and least < last").select("leader", "id")


def by_sets(told: DataFrame, sets: DataFrame, fit: Callable[[bool], Column], name: str, carry: tuple[str, ...] = (), sizes: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs of an outsider x and another member y of the same leader whose weighted sets can still be close.

    With sizes, the members that no other one can be close to, by what is known before elements are looked at, end first.

    sets: (leader, id, o, cells, rest, lacks, slack) of all members told of, and what `carry` names: the mass of its
    elements that the leader has, the same by cells of a partition of the leader's set, those that the leader lacks, their
    mass, and how much mass may come before the first element, in any order, that it shares with one that is close. Each
    element of rest has the mass 1, or what `mass` has at its place.

    Elements of rest that more than HEAVY members have count as the leader's. That matters in a group of edited copies:
    where the leader itself was edited, nearly all others have what it lacks. The order common to all members of a
    leader puts first what it lacks, the rarest among its members first, then all the others. The first element that x
    and y share then is either in rest and no heavy one, and at the front of both: this is an equi-join on elements that
    HEAVY members have at most, so the pairs grow in proportion to the rows. Or all that they share is the leader's or
    heavy: then each has most of its mass there, and sizes, a range of `n` for each x, may say where y is.

    fit says for either way (its argument: whether they may share elements of rest that aren't heavy) if x and y can be
    close, from x's columns (named with an x before) and y's: cells, o, h and t, the mass of heavy elements and of others
    that some other member has too, label, pivot and what is carried. It is checked inside the joins.
    """
    spark, key = told.sparkSession, ["leader", "id"]
    known = cut(sets.join(told.select("leader", "id", "pivot", "label", "outsider"), key), name)
    tidy(spark)  # the texts that the sets were made of
    if sizes:
        known = known.join(comparable(known, sizes[1]), key, "left_semi")
    # elements are by far the most rows here, so they are shuffled with nothing that joins back by item, and without a mass that is 1 for all
    if "mass" in known.columns:
        each, w = known.select(*key, F.explode(F.arrays_zip("rest", "mass")).alias("e")).select(*key, F.col("e.rest").alias("s"), F.col("e.mass").alias("w")), F.col("w")
    else:
        each, w = known.select(*key, F.explode("rest").alias("s")), F.lit(1.0)
    again = cut(each.withColumn("c", F.count("*").over(Window.partitionBy("leader", "s"))).where("c > 1"), f"{name}-again")
    tidy(spark)
    own = Window.partitionBy(*key)
    before = F.coalesce(F.sum(w).over(own.orderBy("c", "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total, heavy = F.sum(w).over(own), F.coalesce(F.sum(F.when(F.col("c") > HEAVY, w)).over(own), F.lit(0.0))
    rest = again.select(*key, "s", "c", total.alias("again"), heavy.alias("h"), before.alias("before")).join(known.select(*key, "lacks", "slack"), key)
    rest = rest.withColumn("before", F.col("lacks") - F.col("again") + F.col("before")).drop("lacks")  # those of one member only come first
    rest = cut(rest.where((F.col("c") > HEAVY) | (F.col("before") <= F.col("slack"))), f"{name}-rest")
    release(again)
    tidy(spark)
    sums = rest.groupBy("leader", "id").agg(F.first("h").alias("h"), (F.first("again") - F.first("h")).alias("t"))
    known = known.drop("rest", "mass", "lacks", "slack").join(sums, ["leader", "id"], "left").fillna(0.0, ["h", "t"])
    known = cut(known, f"{name}-known")
    columns = ["label", "pivot", "o", "h", "t", "cells", *carry]
    outer = lambda t: t.where("outsider").select(*(c for c in t.columns if c in ("leader", "s")), F.col("id").alias("a"), *(F.col(c).alias(f"x{c}") for c in columns))
    inner = lambda t: t.select(*(c for c in t.columns if c in ("leader", "s")), F.col("id").alias("b"), *columns)
    front = cut(rest.where(F.col("c") <= HEAVY).select("leader", "id", "s").join(known, ["leader", "id"]), f"{name}-front")
    light = outer(front).join(inner(front), ["leader", "s"]).where(F.expr(OPEN) & fit(True)).select("a", "b")
    x, on = outer(known), ["leader"]
    if sizes:
        x, on = x.where(sizes[0] <= sizes[1]).withColumn("n", F.explode(F.sequence(*sizes))), ["leader", "n"]
    within = x.join(inner(known), on).where(F.expr(OPEN) & fit(False)).select("a", "b")
    return light.union(within)


#: Cells that a leader's set is dealt into for the bound on what two members share of it.
CELLS = 64


def shared_mass(x: str, y: str) -> Column:
    """The sum of the lesser of two arrays' values at each place."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0.0), lambda s, v: s + v)


def against(own: np.ndarray, lead: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """n, o, cells, rest and lacks of a set (sorted hashes) against its leader's."""
    shared = np.isin(own, lead, assume_unique=True)
    cells = np.bincount((own[shared] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.float64)
    return len(own), int(shared.sum()), cells, own[~shared].view(np.int64), int((~shared).sum())


def restrict(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a large table whose key is among the ids (one column of that name, distinct): by a broadcast if these are few."""
    return table.join(small(ids), key, "left_semi")
