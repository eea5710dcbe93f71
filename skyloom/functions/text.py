"""Readable strings, digests, paths and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scientific(v: Column, digits: int) -> Column:
    """Scientific notation with ties to even, as for %e in most languages."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))))
    return F.format_string(f"%.{digits}e", F.coalesce(F.bround(F.try_divide(v, power), digits) * power, v))


def _fixed(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(v, digits))


def readable_value(v: Column, low: float = -1e38, high: float = 1e38) -> Column:
    """A number in as many digits as its size needs; null for null and NaN."""
    size = F.abs(v)
    whole = (F.floor(v).cast("double") == v) & (size < 1000000)
    return (
        F.when(v.isNull() | F.isnan(v), None)
        .when((v < low) | (v > high), _scientific(v, 1))
        .when(whole, F.format_string("%d", v.cast("long")))
        .when(size < 0.01, _scientific(v, 4))
        .when(size < 100, _fixed(v, 4))
        .when(size < 10000, _fixed(v, 2))
        .when(size < 1000000, _fixed(v, 0))
        .otherwise(_scientific(v, 4))
    )


def _whole(x: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(x, 0).cast("long").cast("string")


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def readable_duration(s: Column) -> Column:
    """Seconds as the two units that matter; null for null."""
    return (
        F.when(s.isNull(), None)
        .when(s < 0.001, F.concat(_whole(s * 1e6), F.lit(" µs")))
        .when(s < 1, F.concat(_whole(s * 1000), F.lit(" ms")))
        .when(s < 60, F.concat(_whole(s), F.lit(" s")))
        .when(s < 300, F.concat(_floor(s / 60), F.lit(" min "), _whole(s % 60), F.lit(" s")))
        .when(s < 3600, F.concat(_whole(s / 60), F.lit(" min")))
        .when(s < 86400, F.concat(_floor(s / 3600), F.lit(" h "), _whole((s % 3600) / 60), F.lit(" min")))
        .otherwise(F.concat(_floor(s / 86400), F.lit(" d "), _whole((s % 86400) / 3600), F.lit(" h")))
    )


def readable_bytes(b: Column) -> Column:
    """Whole units of 1024, up to TB."""
    out = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(b < 1024 ** (power + 1), F.concat(F.floor(b / F.lit(1024**power)).cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.floor(b / F.lit(1024**4)).cast("string"), F.lit(" TB")))


def hex_digest(text: Column, n: int = 8) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def state_text(split: Column, keys: list[str], save: Column) -> Column:
    """The state of a dataset as text: ('split', 'key', ..., number)."""
    return F.concat(F.lit("('"), split, F.lit("', "), *[F.lit(f"'{k}', ") for k in keys], save.cast("string"), F.lit(")"))


def zero_filled(n: Column, width: int = 8) -> Column:
    """Leading zeros; longer numbers aren't cut."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def batch_path(split: Column, digest: Column, index: Column) -> Column:
    return F.concat(split, F.lit("_"), digest, F.lit("_"), zero_filled(index), F.lit(".npz"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``${name}`` by each value; names without a value stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"${{{name}}}"), value)
    return template
