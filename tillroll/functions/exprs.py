"""Column helpers that pin down null, zero and formatting semantics.

The reference's dataframe library differs from Spark SQL in three places that
change numbers, so the operators always go through these helpers:

* ``zero_sum``   - a sum over an empty or all-null group is 0, not NULL.
* ``n_unique``   - a distinct count that counts NULL as one more value.
* ``ratio``      - division with a zero or NULL denominator gives NULL
                   (ANSI mode would raise; infinity would poison later means).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_sum(c: str | Column) -> Column:
    """``sum`` that returns 0 for empty / all-null input."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def n_unique(c: str | Column) -> Column:
    """Distinct count where NULL counts as a value of its own.

    ``count(DISTINCT x)`` skips nulls; adding the "any null" flag gives the
    reference's semantics. Use ``approx=True`` for very high-cardinality keys
    where an HLL estimate is acceptable.
    """
    col = _col(c)
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))


def approx_n_unique(c: str | Column, rsd: float = 0.02) -> Column:
    """HyperLogLog variant of :func:`n_unique` for keys with billions of values."""
    col = _col(c)
    return F.approx_count_distinct(col, rsd) + F.coalesce(
        F.max(col.isNull().cast("int")), F.lit(0)
    )


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def exact(df: DataFrame, col: str) -> tuple[Column, Callable[[Column], Column]]:
    """``col`` in whole units of its own last decimal place, and the way back from a sum of them.

    Sums of a narrow decimal run on 64-bit integers (``sum(decimal(18,2))`` widens to a 38-digit buffer,
    outside Spark's fast path) and lose nothing, whatever its scale. ANSI mode raises on overflow, never
    wraps. Wider decimals, integers and doubles are summed as they are.
    """
    t = df.schema[col].dataType
    if not isinstance(t, DecimalType) or t.precision > 18 or t.scale > 6:
        return F.col(col), lambda c: c
    if t.scale == 0:
        return F.col(col).cast("bigint"), lambda c: c.cast("decimal(38,0)")
    unit = F.lit(10**t.scale)
    return (F.col(col) * unit).cast("bigint"), lambda c: (c.cast("decimal(38,0)") / unit).cast(f"decimal(38,{t.scale})")


def matches_any(cols: Iterable[str], words: Iterable[str]) -> Column:
    """Case-insensitive "contains any word" over several nullable columns.

    ``upper(col)`` contains ``upper(word)``: literal text, no regex engine per
    row, and the same Unicode upper-casing SQL engines use for
    ``upper(x) LIKE '%WORD%'``. A NULL column never matches (NULL OR TRUE is
    TRUE, NULL OR FALSE is NULL, which a filter drops).
    """
    preds = [F.upper(F.col(c)).contains(w.upper()) for c in cols for w in words]
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def id_text(c: str | Column) -> Column:
    """A store id as text: integers as such (``1``), doubles without ``.0``, text unchanged."""
    text = _col(c).cast("string")
    return F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")


def currency(c: str | Column, decimals: int = 2) -> Column:
    """``$1,234.56`` text for a number."""
    return F.concat(F.lit("$"), F.format_number(_col(c).cast("double"), decimals))


def thousands(c: str | Column, decimals: int = 0) -> Column:
    """``1,234`` text (fixed decimals, thousands separators)."""
    return F.format_number(_col(c).cast("double"), decimals)
