"""Sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes and one exchange. If all rows were shuffled at random and dealt into shards of
fixed sizes, the number of rows that go from partition p to shard s would follow a multivariate hypergeometric law. The
driver draws just these counts, a matrix of partitions by shards. Each partition then permutes its rows at random and
cuts them by its line of the matrix, rows are exchanged by shard, and a second random permutation inside each shard
gives the slots. Sizes are exact: shard counts differ by one row at most (the `rows` law).

Neither permutation gathers a shard in one task: a row's random key falls in one of many equal ranges, a count for each
range gives where it starts, and ranks are taken inside ranges only. Copies of a text are dealt like any other rows.

Defined results: nulls and repeated rows are rows like any other; with fewer rows than shards the last shards are
empty; an empty table gives an empty one. Columns called like the two results are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small, spread

#: Rows that one task ranks at a time, on average.
RANGE_ROWS = 200_000
_NUMPY_LIMIT = 10**9  # numpy's sampler takes no larger counts


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of so many draws without return are good. Beyond numpy's range by inversion outwards from the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, left, right, p_left, p_right = rng.random() - at, mode, mode, at, at
    while u > 0 and (left > low or right < high):
        up = p_right * (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1)) if right < high else 0
        down = p_left * left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1)) if left > low else 0
        if up + down < 1e-18:
            break
        if up >= down:
            right, p_right, u = right + 1, up, u - up
            if u <= 0:
                return right
        else:
            left, p_left, u = left - 1, down, u - down
            if u <= 0:
                return left
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition p that go to shard s. Line sums are counts; column sums are equal but for one."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        left = sum(room)
        for s in range(shards):
            left -= room[s]
            k = hypergeometric(rng, room[s], left, n) if left else min(n, room[s])
            out[p, s] = k
            n -= k
        room = [r - int(k) for r, k in zip(room, out[p], strict=True)]
    return out


def _rank(df: DataFrame, group: str, key: Column, ranges: int, name: str) -> DataFrame:
    """Adds the rank of each row in its group by a uniform 63-bit key, from 0; ranges of the key are ranked by themselves."""
    df = df.withColumn("__key", key).withColumn("__range", F.shiftrightunsigned("__key", 63 - max(0, (ranges - 1).bit_length())))
    starts = df.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__range").orderBy("__key", "__rid")
    ranked = df.withColumn("__in", F.row_number().over(inside) - 1)
    return ranked.join(starts, [group, "__range"]).withColumn(name, F.col("__start") + F.col("__in")).drop("__key", "__range", "__start", "__in")


def shard(df: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """All rows and columns of df with `shard` (int) and `slot` (long, from 0 without gaps in each shard), a uniform random order."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    permuted = spread(df.drop("shard", "slot")).withColumn("__u", F.rand(seed)).sortWithinPartitions("__u").drop("__u")
    rows = cut(permuted.withColumn("__rid", F.monotonically_increasing_id()), "shard-rows")  # partition and place in one number
    rows = rows.withColumn("__part", F.shiftrightunsigned("__rid", 33).cast("int")).withColumn("__place", F.col("__rid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    parts = sorted(sizes)
    total = sum(sizes.values())
    m = matrix([sizes[p] for p in parts], shards, seed)
    starts = np.cumsum(m, axis=1) - m
    plan = [(p, [(int(starts[i, s]), int(starts[i, s] + m[i, s]), s) for s in range(shards) if m[i, s]]) for i, p in enumerate(parts)]
    lines = df.sparkSession.createDataFrame(plan, "__part int, __line array<struct<__from: long, __to: long, shard: int>>")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__rid"), 1)
    first = rows.join(small(lines, BROADCAST_ROWS // shards), "__part")
    cell = F.filter("__line", lambda x: (x["__from"] <= F.col("__place")) & (F.col("__place") < x["__to"]))
    dealt = first.withColumn("shard", F.element_at(cell, 1)["shard"]).drop("__place", "__line", "__part")
    ranges = max(1, math.ceil(total / shards / RANGE_ROWS), min(64, total // shards // 1000))
    return _rank(dealt, "shard", uniform, ranges, "slot").drop("__rid")
