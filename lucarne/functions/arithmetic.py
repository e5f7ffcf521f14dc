"""Float arithmetic with IEEE results where Spark would raise or give null (EXP-2 to EXP-8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def operand(c: Column) -> Column:
    """A column as double; cells that are no number become null (EXP-2)."""
    return c.try_cast("double")


def divide(n: Column, d: Column) -> Column:
    """x/0 is ±Infinity, 0/0 is NaN (EXP-4). The sign of a negative zero is not kept."""
    by_zero = F.when(F.isnan(n) | (n == 0), F.lit(NAN)).when(n > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d == 0, by_zero).otherwise(n / d)


def natural_log(x: Column) -> Column:
    """ln with -Infinity at zero and NaN below (EXP-8)."""
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def log_base(x: Column, base: float = 10.0) -> Column:
    """Logarithm to ``base``, with the same edge values as ``natural_log`` (EXP-8)."""
    if base == 10.0:
        exact = F.log10(x)
    elif base == 2.0:
        exact = F.log2(x)
    else:
        exact = F.log(base, x)
    sign = 1.0 if base > 1 else -1.0
    return F.when(x == 0, F.lit(-INF * sign)).when(x < 0, F.lit(NAN)).otherwise(exact)


def round_half_even(x: Column, decimals: int = 0) -> Column:
    """Round to ``decimals``, ties of the scaled value to even; NaN and Infinity pass through (EXP-7).

    The value is scaled first, unlike in ``bround``, which looks for ties in the decimal text.
    """
    if decimals == 0:
        return F.rint(x)
    scale = F.lit(10.0 ** decimals)
    scaled = x * scale
    return F.when(F.abs(scaled) == INF, x).otherwise(F.rint(scaled) / scale)


def is_bad(x: Column) -> Column:
    """NaN or infinite (null is neither)."""
    return F.isnan(x) | (F.abs(x) == INF)


def finite_or_null(x: Column) -> Column:
    """NaN and Infinity as null (EXP-9, PVT-7)."""
    return F.when(~is_bad(x), x)


def _scaled_floor(x: Column, decimals: int) -> Column:
    """``|x| * 10^decimals`` rounded half-even on the exact binary value, for 1 or 2 decimals.

    Whether the fraction lies above or below a tie c / (2 * 10^decimals) is decided without error:
    20 and 200 are split into powers of two, and close to the tie every difference taken below is
    between numbers within a factor of two, hence exact.
    """
    size = F.abs(x)
    whole = F.floor(size).cast("double")
    part = size - whole
    step = 10.0 ** decimals
    digit = F.floor(part * step).cast("double")
    tie = digit * 2 + 1
    if decimals == 1:
        above = (part * 16 - tie) + part * 4
    elif decimals == 2:
        above = ((part * 128 - tie) + part * 64) + part * 8
    else:
        raise ValueError("only 1 or 2 decimals")
    up = (above > 0) | ((above == 0) & (digit % 2 == 1))
    return whole * step + digit + F.when(up, 1.0).otherwise(0.0)


EXACT_BELOW = float(2**43)    # scaled values stay below 2^53


def round_exact(x: Column, decimals: int) -> Column:
    """Round as Python does: half-even on the binary value, not on its decimal text."""
    rounded = F.signum(x) * _scaled_floor(x, decimals) / 10.0 ** decimals
    return F.when(F.abs(x) < EXACT_BELOW, rounded).otherwise(F.bround(x, decimals))


def one_decimal(x: Column) -> Column:
    """A non-negative number as text with one decimal, rounded as ``round_exact`` does."""
    tenths = _scaled_floor(x, 1).cast("bigint")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(F.abs(x) < EXACT_BELOW, text).otherwise(F.format_string("%.1f", x))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, half-even; 0 for an empty whole."""
    return F.when(whole > 0, round_exact(part / whole * 100, 1)).otherwise(F.lit(0.0))
