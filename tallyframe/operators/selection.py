"""Exact order statistics of groups of any size: no task ever holds a group, or its distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.counts import own_path

#: Bits that are told apart in one pass over the values, and bits of a double.
DIGIT, BITS = 16, 64
#: Values of one group that are put in order in one task, once so few are counted.
FEW = 100_000


def sortable(x: Column) -> Column:
    """A double as a whole number of 64 bits in the same order; -0.0 as 0.0, NaN above all."""
    clean = F.when(x == 0, F.lit(0.0)).otherwise(x)
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), clean).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def double_of(bits: Column) -> Column:
    back = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(F.coalesce(bits, F.lit(0)))  # the method takes no null
    return F.when(bits.isNotNull(), F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), back).cast("double"))


def _digit(bits: Column, shift: int) -> Column:
    """The digit at `shift`; the first is signed, so that negative numbers come first."""
    moved = F.shiftright(bits, shift)
    return moved if shift == BITS - DIGIT else moved.bitwiseAND(F.lit(2**DIGIT - 1))


def _same(left: str, right: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in keys]


def _kept(df: DataFrame) -> DataFrame:
    """A pass's few rows as a table, so that the next passes, which read it more than once, don't go through all values for it again."""
    path = own_path(df.sparkSession, "selection")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(values: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], few: int = FEW) -> DataFrame:
    """keys, and for each name of ranks the value at that rank (from 0, an expression of n, the count of the group's values).

    Radix selection: each of four passes counts, for all groups at once, the next 16 bits of the values that share the bits
    found so far, adds the counts up in the order of the bits, and keeps those where the rank falls. Counts are combined on
    the map side; a pass shuffles at most 65,536 of them for each group and rank. Once no more than `few` values of each group
    are left, they are put in order instead of two or three more passes. Null values are left out, and groups
    without others; a rank outside the group gives no value; a null key is a group.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = values.where(F.col(value).isNotNull()).select(*(F.col(c).alias(a) for c, a in zip(keys, k, strict=True)), sortable(F.col(value).cast("double")).alias("__bits"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rest")) for name, rank in ranks.items())))
    targets = None
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        first = shift == BITS - DIGIT
        if first:
            counts = rows.groupBy(*k, _digit(F.col("__bits"), shift).alias("digit")).agg(F.count("*").alias("c"))
            counts = _kept(counts.withColumn("found", F.lit(0).cast("long")))
            targets = counts.groupBy(*k).agg(F.sum("c").alias("n")).select(*k, wanted.alias("t")).select(*k, "t.name", "t.rest", F.lit(0).cast("long").alias("found"))
        else:
            heads = targets.select(*k, "found").distinct().alias("h")
            near = rows.withColumn("__head", F.shiftright("__bits", shift + DIGIT)).alias("v").join(heads, [*_same("v", "h", k), F.col("v.__head") == F.col("h.found")])
            counts = near.select(*(F.col(f"v.{c}") for c in k), "h.found", _digit(F.col("v.__bits"), shift).alias("digit")).groupBy(*k, "found", "digit").agg(F.count("*").alias("c"))
        hits = targets.alias("t").join(counts.alias("c"), [*_same("t", "c", k), F.col("t.found") == F.col("c.found")])
        hits = hits.select(*(F.col(f"t.{c}") for c in k), "t.name", "t.rest", "t.found", "c.digit", "c.c")
        up_to = F.sum("c").over(Window.partitionBy(*k, "name").orderBy("digit"))
        placed = hits.withColumn("up_to", up_to).where((F.col("up_to") > F.col("rest")) & (F.col("rest") >= F.col("up_to") - F.col("c")))
        found = F.col("digit") if first else F.shiftleft("found", DIGIT).bitwiseOR(F.col("digit"))
        targets = _kept(placed.select(*k, "name", (F.col("rest") - (F.col("up_to") - F.col("c"))).alias("rest"), found.alias("found"), "c"))
        most = targets.agg(F.max("c")).first()[0] or 0
        if shift and most <= few:
            # what is left for each target is counted and few: its values in order
            rest = rows.withColumn("__head", F.shiftright("__bits", shift)).alias("v").join(targets.alias("t"), [*_same("v", "t", k), F.col("v.__head") == F.col("t.found")])
            rest = rest.select(*(F.col(f"t.{c}") for c in k), "t.name", "t.rest", "v.__bits")
            order = Window.partitionBy(*k, "name").orderBy("__bits")
            targets = rest.withColumn("at", F.row_number().over(order)).where(F.col("at") == F.col("rest") + 1).withColumn("found", F.col("__bits"))
            break
        targets = targets.drop("c")
    got = targets.groupBy(*k).pivot("name", list(ranks)).agg(F.first("found"))
    return got.select(*(F.col(a).alias(c) for a, c in zip(k, keys, strict=True)), *(double_of(F.col(f"`{name}`")).alias(name) for name in ranks))


def medians(values: DataFrame, keys: list[str], *columns: str, few: int = FEW) -> DataFrame:
    """keys and median_<column> of each column: the middle value, or the mean of the two; null where a group has none."""
    out = values.select(*keys).distinct()
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    for c in columns:
        both = at_ranks(values, keys, c, {"__low": low, "__high": high}, few)
        one = both.select(*(F.col(x).alias(f"__o{i}") for i, x in enumerate(keys)), ((F.col("__low") + F.col("__high")) / 2).alias(f"median_{c}"))
        out = out.join(one, [F.col(x).eqNullSafe(F.col(f"__o{i}")) for i, x in enumerate(keys)], "left").drop(*(f"__o{i}" for i in range(len(keys))))
    return out
