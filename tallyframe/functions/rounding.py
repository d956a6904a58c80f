"""Half-even rounding of doubles as Python's round() does it: on the binary value, not on its shortest decimal text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Veltkamp's splitter for doubles, and the size from which a double has no half.
SPLIT, WHOLE = float(2**27 + 1), float(2**52)
#: Places for which a power of ten times any fraction is told apart exactly.
MOST_PLACES = 9


def bound(value: Column, body) -> Column:
    """body of a value that is computed once: repeated in the expression, it would be computed, and compiled, wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halves(x: Column) -> tuple[Column, Column]:
    """x as the sum of two doubles of 26 bits each."""
    t = x * SPLIT
    high = t - (t - x)
    return high, x - high


def _scaled(x: Column, s: float) -> tuple[Column, Column]:
    """x * s as a double and the exact rest that the double leaves out (Dekker's product)."""
    big = s * SPLIT
    s_high = big - (big - s)
    s_low = s - s_high
    high, low = _halves(x)
    p = x * s
    return p, ((high * s_high - p) + high * s_low + low * s_high) + low * s_low


def half_even(x: Column, places: int) -> Column:
    """The double nearest to x rounded to `places` decimal places, ties of the binary value to the even digit.

    x times a power of ten is taken apart into a double and the rest that it leaves out, without error, so that the
    comparison with a half is exact. Large values are split into a whole part and a fraction first. The sign of a zero
    stays; null, NaN and infinities are themselves.
    """
    if not 0 <= places <= MOST_PLACES:
        raise ValueError(f"places must be 0 to {MOST_PLACES}")
    s = float(10**places)

    def digits(y: Column, odd: Column | None = None) -> Column:
        """y * s to a whole number; odd: whether what stands before it is odd, for which whole numbers of tens don't matter."""
        p, rest = _scaled(y, s)

        def nearest(v: Column) -> Column:
            floor = F.floor(v["p"])
            is_odd = (floor % 2 != 0) if odd is None else ((floor % 2 != 0) != odd)
            over = (v["p"] - floor) - 0.5
            up = F.when(over == 0, F.when(v["rest"] == 0, is_odd).otherwise(v["rest"] > 0)).otherwise(over > 0)
            return floor + F.when(up, 1).otherwise(0)

        return bound(F.struct(p.alias("p"), rest.alias("rest")), nearest)

    def of_size(size: Column) -> Column:
        whole = F.floor(size)
        odd = (whole % 2 != 0) if places == 0 else F.lit(False)
        unit = F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places + 1},{places})")
        large = (whole.cast("decimal(17,0)") + digits(size - whole, odd).cast("decimal(11,0)") * unit).cast("double")
        return F.when(size < WHOLE / s, digits(size).cast("double") / s).when(size < 2 * WHOLE, large).otherwise(size)

    def signed(x: Column) -> Column:
        return F.when(F.isnan(x) | x.isNull() | (x == 0), x).when(x < 0, -bound(-x, of_size)).otherwise(bound(x, of_size))

    return bound(x.cast("double"), signed)
