"""Column expressions that several operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def avg_rank(value: str | Column, *by: str) -> Column:
    """Rank with ties at their average, 1 for the smallest."""
    value = F.col(value) if isinstance(value, str) else value
    ordered, tied = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(tied) - 1) / F.lit(2.0)


def trapezoid(x: str, t: str, *by: str) -> Column:
    """Area of the strip that ends at this row; its sum over a group is the integral."""
    w = Window.partitionBy(*by).orderBy(t)
    return (F.col(t) - F.lag(t).over(w)) * (F.col(x) + F.lag(x).over(w)) / F.lit(2.0)


def gradient(x: str, t: str, *by: str) -> Column:
    """Second-order difference on a grid of any spacing, one-sided at both ends."""
    w = Window.partitionBy(*by).orderBy(t)
    f0, f1, f2 = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    h1, h2 = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    inner = (h1 * h1 * f2 + (h2 * h2 - h1 * h1) * f1 - h2 * h2 * f0) / (h1 * h2 * (h1 + h2))
    return F.when(h1.isNull(), (f2 - f1) / h2).when(h2.isNull(), (f1 - f0) / h1).otherwise(inner)


def first_crossing(x: str, t: str, threshold: float, strict: bool = True) -> Column:
    """Aggregate: the first t at which x exceeds the threshold, null if never."""
    over = F.col(x) > threshold if strict else F.col(x) >= threshold
    return F.min(F.when(over, F.col(t)))


def at_max(out: str, x: str, t: str) -> Column:
    """Aggregate: out where x is largest, the first t on ties."""
    return F.max_by(out, F.struct(F.col(x), -F.col(t)))


def at_min(out: str, x: str, t: str) -> Column:
    return F.min_by(out, F.struct(F.col(x), F.col(t)))


def is_boundary(comp: str = "comp") -> Column:
    return F.col(comp).contains("outer_medulla") | F.col(comp).endswith("_boundary")


def r6(value: str | Column, name: str | None = None) -> Column:
    value, name = (F.col(value), name or value) if isinstance(value, str) else (value, name)
    return F.round(value, 6).alias(name)
