"""Missing-value and arithmetic rules that differ from Spark's defaults.

A missing value is null or NaN; infinity is an ordinary value. Comparisons with a
missing value are missing, so a conditional on one is missing rather than false.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: ColumnOrName) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def if_known(test: Column, yes, no, given: Sequence[ColumnOrName] | None = None) -> Column:
    """``yes`` where the test is true, ``no`` where it is false, null where it is unknown.

    ``given`` names the inputs whose absence makes the test unknown. Asking for them
    instead of repeating the test keeps the generated code small.
    """
    if given is None:
        return F.when(test, yes).when(~test, no)
    return F.when(test, yes).when(reduce(and_, [as_column(c).isNotNull() for c in given]), no)


def lookup(table: Mapping, key: ColumnOrName) -> Column:
    """The key's value in a small constant table, null for any other key. One constant and
    one reference to the key, where a chain of conditions repeats it."""
    entries = [F.lit(v) for entry in table.items() for v in entry]
    return F.try_element_at(F.create_map(*entries), as_column(key))


def divide(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN, with ANSI mode on or off."""
    n = as_column(numerator).cast("double")
    d = as_column(denominator).cast("double")
    return F.when(d == 0, n * float("inf")).otherwise(n / d)


def sum_known(value: ColumnOrName) -> Column:
    """Sum of the known values; 0 for a group that has none, so that the group is kept."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


#: Exact sums hold the whole number of a double and so many parts of so many bits of its fraction. A sum
#: of 2^41 parts fits a long.
FRACTION_PARTS, PART_BITS = 3, 21


def exact_sum(value: ColumnOrName) -> Column:
    """Sum of the known doubles that no order and no partitioning of the rows changes, not even in the last bit.

    Each value is cut into whole numbers: its own, and 21 bits of its fraction at a time. These are summed as
    longs, which is exact, and put together last. What a value has beyond 63 bits after the point is cut off before
    the sum; a sum of 2^63 or more stops the job under ANSI mode. Infinities and NaN count as in any sum. Null for a
    group without any known value.
    """
    value = as_column(value).cast("double")
    ordinary = F.abs(value) < float("inf")
    rest = F.when(ordinary, value)
    scale = float(1 << PART_BITS)
    sums = []
    for _ in range(FRACTION_PARTS + 1):
        part = F.floor(rest)
        sums.append(F.sum(part).cast("double"))
        rest = (rest - part) * scale
    total = sums.pop()
    for upper in reversed(sums):
        total = upper + total / scale
    return F.coalesce(F.sum(F.when(~ordinary, value)), total)


def exact_sum_known(value: ColumnOrName) -> Column:
    """The exact sum of the known values; 0 for a group that has none."""
    return F.coalesce(exact_sum(value), F.lit(0.0))


def exact_mean(value: ColumnOrName) -> Column:
    """Mean of the known doubles by their exact sum."""
    return exact_sum(value) / F.count(as_column(value))


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the given columns (all columns by default).

    One condition per column, so that each moves down to the table its column comes from.
    """
    tests = []
    for name in df.columns if columns is None else columns:
        tests.append(F.col(name).isNotNull())
        if is_floating(df, name):
            tests.append(~F.isnan(name))
    return df.filter(reduce(and_, tests)) if tests else df


def fill_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and NaN become 0 in numeric columns."""
    return df.fillna(0, subset=list(columns) if columns is not None else None)


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null; only floating-point columns can hold NaN."""
    return nan_to_null(name) if is_floating(df, name) else F.col(name)
