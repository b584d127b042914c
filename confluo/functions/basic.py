"""Text helpers and exact rounding as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def present(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def sorted_ignoring_case(values: Column) -> Column:
    """Distinct values in the order of their lower case, equal ones by code points."""
    keyed = F.transform(F.array_distinct(values), lambda s: F.struct(F.lower(s).alias("low"), s.alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: s["value"])


def first_spellings(values: Column) -> Column:
    """As ``sorted_ignoring_case``, keeping of each value only exact duplicates' first."""
    return sorted_ignoring_case(F.array_compact(values))


def pyround(x: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even, as Python does; for |x| up to about 1e6.

    The double is scaled to an integer multiple of 2**-80 in two parts, which is
    exact, and divided as a decimal. Spark's own rounding starts from the
    shortest decimal form and differs on values such as 0.835. Decimals are asked
    only near a tie: elsewhere the scaled double, off by 2e-6 at most, decides.
    """
    unit = F.lit(Decimal(1 << 80)).cast("decimal(25,0)")

    def scaled(wide: Column) -> Column:
        high = F.floor(wide)
        low = F.floor((wide - high) * float(1 << 50)).cast("decimal(16,0)")
        n = high.cast("decimal(17,0)") * F.lit(Decimal(1 << 50)).cast("decimal(16,0)") + low
        return n.cast("decimal(33,0)") * F.lit(Decimal(10**digits)).cast("decimal(5,0)")

    def rounded(m: Column, rest: Column) -> Column:
        k = ((m - rest) / unit).cast("decimal(20,0)")
        twice = rest * F.lit(Decimal(2)).cast("decimal(1,0)")
        up = (twice > unit) | ((twice == unit) & (k % 2 == 1))
        return (k + F.when(up, 1).otherwise(0)).cast("double") / float(10**digits)

    def whole(v: Column) -> Column:
        exact = let(scaled(F.abs(v) * float(1 << 30)), lambda m: let(m % unit, lambda rest: rounded(m, rest)))
        near = F.abs(v) * float(10**digits)
        clear = (F.abs(v) < 1e6) & (F.abs(near - F.floor(near) - 0.5) > 1e-5)
        out = F.when(clear, F.rint(near) / float(10**digits)).otherwise(exact)
        return F.when(v < 0, -out).otherwise(out)

    return let(x.cast("double"), whole)


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many decimals, rounded as ``pyround``."""
    return F.format_string(f"%.{digits}f", pyround(x, digits))
