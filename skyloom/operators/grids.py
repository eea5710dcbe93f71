"""Summed-area tables over tiled grids: the sum of any window from four look-ups, also where a grid is larger than a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("grid", "ty", "tx")


def summed(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles of prefix sums from rows of grid, ty, tx and ``cells`` (row by row; null cells are 0).

    ``inner`` has a tile's own two-dimensional prefix sums, ``left`` those of its rows over all tiles to the left,
    ``above`` those of its columns over all tiles above, and ``corner`` the sum of the tiles above and to the left. Only
    edges of tiles pass between tasks. Tiles that aren't there within a grid's extent are empty; of equal ones cells add up.
    """
    src = tiles.select(F.col("grid").cast("long").alias("grid"), F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), F.col("cells").cast("array<double>").alias("cells"))
    n = height * width

    def prefix(batches):
        for batch in batches:
            rows = np.zeros((len(batch), n))
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                if cells is not None:
                    if len(cells) != n:
                        raise ValueError(f"a tile has {height} by {width} cells")
                    rows[i] = [0.0 if c is None else c for c in cells]
            sums = rows.reshape(-1, height, width).cumsum(axis=1).cumsum(axis=2).reshape(-1, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n, dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), lists], names=[*KEY, "inner"])

    inner = src.mapInArrow(prefix, "grid long, ty int, tx int, inner array<double>")
    extent = src.groupBy("grid").agg(F.max("ty").alias("_ty"), F.max("tx").alias("_tx"))
    places = extent.select("grid", F.explode(F.sequence(F.lit(0), F.col("_ty"))).alias("ty"), "_tx").select("grid", "ty", F.explode(F.sequence(F.lit(0), F.col("_tx"))).alias("tx"))
    # equal tiles add up cell by cell; prefix sums are linear
    add = F.aggregate(F.collect_list("inner"), F.array_repeat(F.lit(0.0), n), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    whole = places.join(inner.groupBy(*KEY).agg(add.alias("inner")), list(KEY), "left").withColumn("inner", F.coalesce("inner", F.array_repeat(F.lit(0.0), n)))

    def carried(count: int, at, by: str, along: str, name: str) -> DataFrame:
        """Sums of an edge's values over the tiles before, gathered by tile."""
        edge = whole.select(*KEY, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at("inner", at(i)))).alias("i", "v"))
        before = F.coalesce(F.sum("v").over(Window.partitionBy("grid", by, "i").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        got = edge.withColumn("v", before).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
        return got.select(*KEY, F.transform("s", lambda x: x["v"]).alias(name))

    left = carried(height, lambda i: i * width + width, "ty", "tx", "left")
    above = carried(width, lambda i: i + (n - width + 1), "tx", "ty", "above")
    # the last of ``left`` is the sum of a tile's row to its left; of the rows above these add up
    corner = left.select(*KEY, F.coalesce(F.sum(F.element_at("left", -1)).over(Window.partitionBy("grid", "tx").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("corner"))
    return whole.join(left, list(KEY)).join(above, list(KEY)).join(corner, list(KEY))


def window_sums(samples: DataFrame, sums: DataFrame, height: int, width: int, sample: str, grid: str = "grid", y: str = "y", x: str = "x", h: str = "h", w: str = "w") -> DataFrame:
    """``sample`` and ``total``: the sum of each sample's window, whose corner and size come with the sample; parts outside the grid are empty."""
    extent = sums.groupBy("grid").agg(((F.max("ty") + 1) * height).alias("_h"), ((F.max("tx") + 1) * width).alias("_w"))
    src = samples.select(F.col(sample), F.col(grid).cast("long").alias("grid"), *[F.col(c).cast("long").alias(k) for k, c in (("_y0", y), ("_x0", x))], (F.col(y) + F.col(h)).cast("long").alias("_y1"), (F.col(x) + F.col(w)).cast("long").alias("_x1"))
    inside = src.join(extent, "grid", "left")
    clip = lambda c, end: F.greatest(F.lit(0), F.least(F.col(c), F.coalesce(F.col(end), F.lit(0))))
    corners = F.array(*[F.struct(F.lit(s).alias("sign"), (clip(b, "_h") - 1).alias("cy"), (clip(a, "_w") - 1).alias("cx")) for s, b, a in ((1.0, "_y1", "_x1"), (-1.0, "_y0", "_x1"), (-1.0, "_y1", "_x0"), (1.0, "_y0", "_x0"))])
    asked = inside.select(F.col(sample), "grid", F.inline(corners))
    at = asked.withColumns({"ty": F.floor(F.col("cy") / height).cast("int"), "tx": F.floor(F.col("cx") / width).cast("int"), "iy": F.pmod("cy", F.lit(height)).cast("int"), "ix": F.pmod("cx", F.lit(width)).cast("int")})
    met = at.join(sums, list(KEY), "left")
    value = F.when((F.col("cy") < 0) | (F.col("cx") < 0), F.lit(0.0)).otherwise(F.col("corner") + F.element_at("left", F.col("iy") + 1) + F.element_at("above", F.col("ix") + 1) + F.element_at("inner", F.col("iy") * width + F.col("ix") + 1))
    return met.groupBy(sample).agg(F.coalesce(F.sum(F.col("sign") * value), F.lit(0.0)).alias("total"))
