"""Scaling of physical values as column expressions: no clipping in either direction, null where a range is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mode(mode: tuple[float, float]) -> tuple[float, float]:
    if not isinstance(mode, tuple) or len(mode) != 2:
        raise ValueError("mode is a pair (low, high)")
    return float(mode[0]), float(mode[1])


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def normalize(x: Column, low: Column, high: Column, mode: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """``a + (x - low)(b - a)/(high - low)``."""
    a, b = _mode(mode)
    return F.lit(a) + F.try_divide((x - low) * F.lit(b - a), high - low)


def normalize_log(x: Column, low: Column, high: Column, offset: Column, mode: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """The logarithm of ``x - low + offset`` brought to the mode by its range ``[ln offset, ln(high - low + offset)]``."""
    return normalize(_ln(x - low + offset), _ln(offset), _ln(high - low + offset), mode)


def inverse_normalize(y: Column, low: Column, high: Column, mode: tuple[float, float] = (-1.0, 1.0)) -> Column:
    a, b = _mode(mode)
    return low + (y - F.lit(a)) * (high - low) / F.lit(b - a)


def inverse_normalize_log(y: Column, low: Column, high: Column, offset: Column, mode: tuple[float, float] = (-1.0, 1.0)) -> Column:
    if offset is None:
        raise ValueError("a logarithmic scale has an offset")
    return F.exp(inverse_normalize(y, _ln(offset), _ln(high - low + offset), mode)) - offset + low


def by_variable(y: Column) -> Column:
    """Inverse scaling by the joined catalogue row (log_normalize, normalize_min, normalize_max, log_offset)."""
    low, high, offset = F.col("normalize_min"), F.col("normalize_max"), F.col("log_offset")
    return F.when(F.col("log_normalize"), inverse_normalize_log(y, low, high, offset)).otherwise(inverse_normalize(y, low, high))


def forward_by_variable(x: Column) -> Column:
    low, high, offset = F.col("normalize_min"), F.col("normalize_max"), F.col("log_offset")
    return F.when(F.col("log_normalize"), normalize_log(x, low, high, offset)).otherwise(normalize(x, low, high))


def with_bounds(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Add the data's own least and greatest value (``_low``, ``_high``), over all rows or by group.

    A two-step aggregate joined back: its rows are few, and no window without partitions is used.
    """
    by = by or []
    bounds = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null bounds don't clip; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def sentinel_to_null(x: Column, low: Column, high: Column) -> Column:
    return F.when(F.coalesce(x < low, F.lit(False)) | F.coalesce(x > high, F.lit(False)), None).otherwise(x)


def mask_to_null(x: Column, mask: Column) -> Column:
    """1 is masked out."""
    return F.when(mask == 1, None).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
