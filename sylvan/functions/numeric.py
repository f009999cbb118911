"""Column helpers whose rounding, null and clamping rules the scores depend on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def js_round(x, dp: int = 0) -> Column:
    """Ties toward +infinity at ``dp`` decimals: floor(x * 10^dp + 0.5) / 10^dp.

    ``F.round`` works on the decimal string and rounds ties away from zero, so it
    differs on 1.005 and -0.5.  The result is a double.
    """
    x = c(x).cast("double")
    if dp == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    p = F.lit(float(10**dp))
    return F.floor(x * p + F.lit(0.5)).cast("double") / p


def truthy_or(x, default) -> Column:
    """``x`` unless it is null, NaN or 0."""
    x = c(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == 0), lit(default)).otherwise(x)


def nz(x) -> Column:
    """Null (or NaN) becomes 0."""
    return truthy_or(x, 0.0)


def clamp(x, lo=0.0, hi=100.0) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), lit(x)))


def norm(x, top) -> Column:
    """Share of ``top`` on a 0-100 scale, clamped."""
    return clamp(lit(x) / F.lit(float(top)) * F.lit(100.0), F.lit(0.0), F.lit(100.0))


def wsum(*terms) -> Column:
    """Left-to-right weighted sum: wsum((x, .4), (y, .6))."""
    return reduce(lambda a, b: a + b, [lit(x) * F.lit(float(w)) for x, w in terms])


def band(x, cuts, default) -> Column:
    """First label whose lower limit is reached; ``cuts`` in falling order."""
    out = None
    for limit, label in cuts:
        out = F.when(x >= limit, F.lit(label)) if out is None else out.when(x >= limit, F.lit(label))
    return out.otherwise(F.lit(default))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def sum_of(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def share(cond) -> Column:
    """Aggregate: fraction of rows that meet ``cond`` (null conditions count as no)."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_where(cond) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def group_key(group_cols):
    return [F.col(g) if isinstance(g, str) else g for g in group_cols]
