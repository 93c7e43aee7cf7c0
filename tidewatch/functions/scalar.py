"""Column expressions that several operators share."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnomalyFilter, Category, ItemFilter, Magnitude, MetricCategories


def finite(x: Column) -> Column:
    """NaN and infinities as null: comparisons then fail instead of being true."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def matches_glob(value: Column, pattern: str) -> Column:
    """Case-sensitive glob over the whole value; a star crosses dots."""
    regex = fnmatch.translate(pattern).replace("\\Z", "\\z")
    return value.rlike("^" + regex)


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, straight between; a step at hi if the two don't rise."""
    if hi <= lo:
        return F.when(x >= hi, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / F.lit(float(hi - lo))))


def score_ramp(z: Column, threshold: Column | float) -> Column:
    """0.5 at the threshold, 1 from twice the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.least((z - t) / t * 0.5 + 0.5, F.lit(1.0))


def hour_of_day(clock: Column) -> Column:
    return F.floor(F.pmod(clock, F.lit(86400)) / 3600).cast("int")


def key_family(key: Column) -> Column:
    return F.trim(F.substring_index(key, "[", 1))


def baseline_sigma(std: Column, intra: Column) -> Column:
    """Deviation of one raw sample: that of the hourly means and that within an hour."""
    i = finite(intra)
    return F.when(i > 0, F.hypot(std, i)).otherwise(std)


def category_index(key: Column, categories: tuple[Category, ...]) -> Column:
    """Index of the first category whose patterns match; null for none."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(categories))):
        for p in c.key_patterns:
            out = F.when(matches_glob(key, p), F.lit(i)).otherwise(out)
    return out


def by_category(index: Column, categories: tuple[Category, ...], value, default) -> Column:
    """value(category) of the indexed category, `default` where there is none; values may be columns or constants."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = col(default)
    for i, c in enumerate(categories):
        out = F.when(index == i, col(value(c))).otherwise(out)
    return out


def category_name(index: Column, cfg: MetricCategories) -> Column:
    return by_category(index, cfg.categories, lambda c: c.name, "default")


def category_weight(index: Column, cfg: MetricCategories) -> Column:
    return by_category(index, cfg.categories, lambda c: float(cfg.default_weight if c.weight is None else c.weight), float(cfg.default_weight))


def magnitude_of(m: Magnitude | None, delta: Column, mean: Column, std: Column) -> Column:
    if m is None:
        return F.lit(1.0)
    small = F.lit(1e-9)
    x = {"relative": lambda: delta / F.greatest(F.abs(mean), small), "sigma": lambda: delta / F.greatest(std, small), "absolute": lambda: delta}[m.mode]()
    return F.greatest(ramp(x, m.lo, m.hi), F.lit(float(m.floor)))


def rule_matches(rule: ItemFilter | AnomalyFilter, key: Column, units: Column) -> Column:
    """An empty pattern or unit matches everything."""
    hit = F.lit(True)
    if rule.key_pattern:
        hit = hit & matches_glob(key, rule.key_pattern)
    if rule.units:
        hit = hit & (units == rule.units)
    return hit
