"""Paired statistics of two models' scores (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_factorial(x: str) -> str:
    """SQL for log x! by Stirling's series, raised by 8 so that four terms are good to 1e-11."""
    z = f"(cast({x} as double) + 8)"
    series = f"({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7))"
    return f"({series} - ({' + '.join(f'ln(cast({x} as double) + {i})' for i in range(1, 8))}))"


def sign_test(paired: DataFrame) -> DataFrame:
    """Two-sided exact sign test: n_pos, n_neg, p_value. Ties are left out.

    The binomial tail is a sum over k of exp(log n! - log k! - log (n-k)! - n log 2), so that no number grows beyond a
    double. Terms more than 12 roots of n below the last are under its e^-288th part and left out: the sum is a few
    million terms for a million million pairs, and nothing is gathered.
    """
    signs = paired.agg(F.count_if(F.col("a") > F.col("b")).alias("n_pos"), F.count_if(F.col("a") < F.col("b")).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    shaped = signs.withColumns({"n": n, "m": F.least("n_pos", "n_neg")}).withColumn("low", F.greatest(F.lit(0).cast("long"), F.col("m") - F.ceil(12 * F.sqrt(n)) - 50))
    term = f"exp({log_factorial('n')} - {log_factorial('k')} - {log_factorial('n - k')} - n * ln(2D))"
    tail = F.expr(f"aggregate(sequence(low, m), 0D, (s, k) -> s + {term})")
    return shaped.select("n_pos", "n_neg", F.when(n == 0, 1.0).otherwise(F.bround(F.least(F.lit(1.0), 2 * tail), 6)).alias("p_value"))


#: Ranges that the sizes of differences are dealt into.
RANGES = 200


def wilcoxon(paired: DataFrame) -> DataFrame:
    """Signed-rank sums w_plus and w_minus over non-zero differences, equal sizes sharing the mean of their ranks, and z with the correction for ties.

    Ranks come from counts of each distinct size. Sizes are dealt into ranges at their approximate quantiles; counts of
    whole ranges say where each begins, and sizes are ranked inside their range, so no task sees all of them.
    """
    d = F.bround(F.col("a") - F.col("b"), 9)
    sizes = paired.withColumn("d", d).where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("pos"))
    bounds = sizes.agg(F.percentile_approx("size", [i / RANGES for i in range(1, RANGES)], 10_000).alias("bounds"))  # one row
    dealt = sizes.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda x: x < F.col("size")))).drop("bounds")
    totals = dealt.groupBy("range").agg(F.sum("t").alias("n"))  # a row for each range
    starts = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = Window.partitionBy("range").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("t").over(before), F.lit(0))).join(F.broadcast(starts), "range")
    ranked = ranked.withColumn("rank", F.col("start") + F.col("inside") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("pos")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("t") - F.col("pos"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(variance > 0, F.bround((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance), 6))
    return sums.select("n", "w_plus", "w_minus", z.alias("z"))


def bootstrap_ci(paired: DataFrame, key: str, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean difference over seeded resamples.

    A Poisson bootstrap: in each resample a pair counts as often as a Poisson(1) draw made from a hash of its key and the
    resample's number says. Pairs needn't be gathered or numbered; each is expanded and summed on the map side.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # The distribution function of Poisson(1) at 0 to 5, to 6 places
    cdf = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cdf[1:]), F.when(u >= cdf[0], 1).otherwise(0))
    drawn = paired.where("a is not null and b is not null").select(key, (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("w", times)
    means = drawn.groupBy("r").agg(F.bround(F.sum(F.col("w") * F.col("d")) / F.sum("w"), 6).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.bround(F.percentile("m", F.lit(tail)), 6).alias("low"), F.bround(F.percentile("m", F.lit(1 - tail)), 6).alias("high"), F.count("*").alias("resamples"))
