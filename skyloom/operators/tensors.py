"""Dense samples: arrays of numbers in row-major order with a shape, and their long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_long(df: DataFrame, keys: list[str], array: str, width: int) -> DataFrame:
    """A row a grid point: keys, y, x and value; NaN is null."""
    out = df.select(*keys, F.posexplode(array).alias("_p", "value"))
    return out.select(*keys, F.floor(F.col("_p") / F.lit(width)).cast("int").alias("y"), (F.col("_p") % width).cast("int").alias("x"), F.when(~F.isnan("value"), F.col("value")).cast("double").alias("value"))


def channel(array: Column, index: Column, size: int) -> Column:
    """One channel of a sample whose channels follow each other."""
    return F.slice(array, index * size + 1, F.lit(size))


def window(array: Column, width: int, y0: Column | int, x0: Column | int, height: int, across: int) -> Column:
    """A window of a grid, row-major, without exploding it; its corner is fixed or comes with the sample."""
    top, left = (c if isinstance(c, Column) else F.lit(c) for c in (y0, x0))
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.slice(array, ((top + y) * width + left + 1).cast("int"), F.lit(across)))
    return F.flatten(rows)


def max_pool_2x2(df: DataFrame, keys: list[str], array: str, width: int) -> DataFrame:
    """Greatest value of each 2x2 block; arithmetic on the array, no shuffle."""
    half = width // 2
    at = lambda y, x: F.element_at(F.col(array), (y * width + x + 1).cast("int"))
    cell = lambda p: F.struct(F.floor(p / F.lit(half)).cast("int").alias("y"), (p % half).cast("int").alias("x"))
    pooled = F.transform(
        F.sequence(F.lit(0), F.lit(half * half - 1)),
        lambda p: F.struct(cell(p)["y"].alias("y"), cell(p)["x"].alias("x"), F.greatest(*[at(cell(p)["y"] * 2 + dy, cell(p)["x"] * 2 + dx) for dy in (0, 1) for dx in (0, 1)]).alias("value")),
    )
    return df.select(*keys, F.explode(pooled).alias("c")).select(*keys, "c.y", "c.x", F.col("c.value").cast("double").alias("value"))


def mean_of(array: Column) -> Column:
    """Mean over an array (global average pool of one channel)."""
    return F.try_divide(F.aggregate(array, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(array).cast("double"))


def tiles(df: DataFrame, keys: list[str], height: int, width: int, size: int, stride: int) -> DataFrame:
    """Corners of all windows of a size that fit a grid, ``stride`` apart."""
    ys, xs = F.sequence(F.lit(0), F.lit(height - size), F.lit(stride)), F.sequence(F.lit(0), F.lit(width - size), F.lit(stride))
    return df.select(*keys, F.explode(ys).alias("y0")).select(*keys, "y0", F.explode(xs).alias("x0"))


def collate(df: DataFrame, group: str, order: str, array: str) -> DataFrame:
    """Samples of a batch joined along the first axis, in order, with their number. A batch fits a row by definition.

    ``array`` is an array or a struct of arrays and structs: each leaf is joined, under the names of the column's type. A
    leaf that is no array is refused.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(array).alias("_a"))))

    def joined(kind: T.DataType, leaf) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[joined(f.dataType, lambda s, n=f.name: leaf(s)[n]).alias(f.name) for f in kind.fields])
        if not isinstance(kind, T.ArrayType):
            raise TypeError(f"{array}: {kind.simpleString()} can't be joined along its first axis")
        return F.flatten(F.transform("_l", lambda s: leaf(s)))

    kind = df.schema[array].dataType
    return df.groupBy(group).agg(listed.alias("_l")).select(group, F.size("_l").cast("long").alias("samples"), joined(kind, lambda s: s["_a"]).alias(array))


def unmasked_fraction(array: Column, mask: Column) -> Column:
    """Part of an array's cells whose mask is 0 (``mask`` takes a cell's value)."""
    return F.try_divide(F.aggregate(array, F.lit(0), lambda a, v: a + F.when(mask(v), 0).otherwise(1)).cast("double"), F.size(array).cast("double"))


def temporal_context(df: DataFrame, key: str, order: list[str], value: str, before: int, after: int) -> DataFrame:
    """The values around each row of a series, in order, as ``context``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn("context", F.collect_list(value).over(w))
