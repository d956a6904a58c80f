"""Half-even rounding against Python's round(), and order statistics against sorted lists."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.rounding import half_even
from tallyframe.operators import selection

EDGES = [0.0, -0.0, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -2.675, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan, 2**52 + 0.5, 2**52 - 0.5, 2**53 - 1.0, 450359962737.04962, 1e15 + 0.3, 0.125, 0.15, 0.25, 0.35, 1e22, 4.35, 0.045, None]


@pytest.mark.parametrize("places", [0, 1, 2, 4, 9])
def test_rounding_is_pythons(spark, places):
    rng = random.Random(places)
    xs = list(EDGES)
    for _ in range(3000):
        v = (rng.randint(0, 10 ** rng.randint(1, 12)) + 0.5) / 10 ** rng.choice([1, 2, 4, 9])
        xs += [v, math.nextafter(v, math.inf), math.nextafter(v, 0), -v, rng.uniform(-1, 1) * 10 ** rng.randint(-5, 17)]
    want = [x if x is None or not math.isfinite(x) else float(round(x, places)) for x in xs]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(half_even(F.col("x"), places).alias("y")).collect()]
    bits = lambda v: None if v is None else "nan" if math.isnan(v) else struct.pack("d", v)
    assert [(x, g, w) for x, g, w in zip(xs, got, want, strict=True) if bits(g) != bits(w)] == []


def test_rounding_of_what_is_not_looked_at_fails(spark):
    with pytest.raises(ValueError, match="places"):
        half_even(F.lit(1.0), 10)


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_medians_and_ranks_of_groups(spark, few):
    rng = random.Random(few)
    rows = [(g, float(rng.choice([rng.uniform(-1, 1), rng.gauss(0, 1e300), rng.randint(-3, 3), 0.1 + 1e-16 * rng.randint(0, 9)]))) for g in ("a", "b", None) for _ in range(rng.randint(40, 90))]
    rows += [("one", -5e-324), ("none", None), ("inf", math.inf), ("inf", -0.0), ("inf", 0.0), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").withColumns({"n": F.lit(1), "found": F.lit(2), "digit": F.lit(3), "name": F.lit("x")}).repartition(3)
    got = {r.g: r.median_x for r in selection.medians(df, ["g"], "x", few=few).collect()}
    for g in {g for g, _ in rows}:
        xs = sorted((x for h, x in rows if h == g and x is not None), key=lambda x: (math.isnan(x), x))
        want = (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2 if xs else None
        assert got[g] == want, g
    third = selection.at_ranks(df, ["g"], "x", {"third": F.lit(2), "last": F.col("n") - 1}, few=few)
    assert {r.g for r in third.collect()} == {"a", "b", None, "one", "inf", "nan"}
    for r in third.collect():
        xs = sorted((x for h, x in rows if h == r.g), key=lambda x: (math.isnan(x), x))
        assert r.third == (xs[2] if len(xs) > 2 else None) or math.isnan(r.third)
        assert r.last == xs[-1] or math.isnan(xs[-1])
    assert selection.medians(df.limit(0), ["g"], "x").collect() == []
