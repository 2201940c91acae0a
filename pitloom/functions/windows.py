"""Window expressions over ordered series. `s` is a Series: the keys that make a series and its order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int):
        return self.w.rowsBetween(1 - n, 0)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded(agg: Column, x: Column | str, frame, least: int) -> Column:
    """agg over the frame, NULL until the frame holds `least` values."""
    return F.when(F.count(_c(x)).over(frame) >= least, agg.over(frame))


def rolling_mean(x, s: Series, n: int, least: int | None = None) -> Column:
    return guarded(F.avg(_c(x)), x, s.last(n), least or n)


def rolling_std(x, s: Series, n: int, least: int | None = None) -> Column:
    return guarded(F.stddev_samp(_c(x)), x, s.last(n), max(2, least or n))


def rolling_sum(x, s: Series, n: int, least: int | None = None) -> Column:
    return guarded(F.sum(_c(x)), x, s.last(n), least or n)


def zscore(x, s: Series, n: int, least: int | None = None) -> Column:
    """Distance to the rolling mean in rolling standard deviations; NULL where the deviation is 0."""
    return F.try_divide(_c(x) - rolling_mean(x, s, n, least), F.nullif(rolling_std(x, s, n, least), F.lit(0.0)))


def forward_fill(x, s: Series) -> Column:
    return F.last(_c(x), ignorenulls=True).over(s.so_far)


def backward_fill(x, s: Series) -> Column:
    return F.first(_c(x), ignorenulls=True).over(s.w.rowsBetween(0, Window.unboundedFollowing))


def pct_change(x, s: Series, n: int = 1) -> Column:
    """Change against n rows before. NULLs must have been filled forward (see forward_fill) to count as unchanged."""
    return F.try_divide(_c(x), F.lag(_c(x), n).over(s.w)) - 1


def log_change(x, s: Series, n: int = 1) -> Column:
    """ln x minus ln x n rows before; values of 0 or less are NULL."""
    ln = F.when(_c(x) > 0, F.ln(_c(x)))
    return ln - F.lag(ln, n).over(s.w)


def drawdown(x, s: Series) -> Column:
    """Part by which x is below its running maximum, 0 or negative."""
    peak = F.max(_c(x)).over(s.so_far)
    return F.try_divide(_c(x) - peak, peak)


def compounded(r, s: Series) -> Column:
    """Running product of 1 + r; a NULL return counts as 0."""
    return F.product(1 + F.coalesce(_c(r), F.lit(0.0))).over(s.so_far)


def persisted(x, s: Series, n: int) -> Column:
    """x where it has been the same for n rows, else NULL."""
    f = s.last(n)
    return F.when((F.count(_c(x)).over(f) == n) & (F.min(_c(x)).over(f) == F.max(_c(x)).over(f)), _c(x))
