"""Items and collections of spatio-temporal catalogues as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "1.0.0"


def extent(df: DataFrame, by: list[str], x: str, y: str, time: str) -> DataFrame:
    """Box (least x, least y, greatest x, greatest y) and first and last time of each group."""
    return df.groupBy(*by).agg(F.array(F.min(x), F.min(y), F.max(x), F.max(y)).alias("bbox"), F.min(time).alias("first"), F.max(time).alias("last"))


def polygon(bbox: Column) -> Column:
    """The box's ring, from its lower left corner and back to it."""
    corner = lambda i, j: F.array(bbox[i], bbox[j])
    ring = F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3), corner(0, 1))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def zulu(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def item(name: Column, bbox: Column, first: Column, last: Column, properties: dict[str, Column], assets: Column, collection: str | None = None) -> Column:
    """An item as JSON, its keys in the usual order; ``assets`` is a struct or map of structs with an href."""
    times = [F.lit(None).cast("string").alias("datetime"), zulu(first).alias("start_datetime"), zulu(last).alias("end_datetime")]
    fields = [
        F.lit("Feature").alias("type"), F.lit(VERSION).alias("stac_version"), name.alias("id"), polygon(bbox).alias("geometry"), bbox.alias("bbox"),
        F.struct(*times, *[c.alias(k) for k, c in properties.items()]).alias("properties"), F.array().cast("array<string>").alias("links"), assets.alias("assets"),
    ]
    if collection is not None:
        fields.append(F.lit(collection).alias("collection"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def collection(items: DataFrame, name: str, description: str) -> DataFrame:
    """One row: a collection around items with ``bbox``, ``first`` and ``last``."""
    box = F.array(F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3]))
    whole = items.agg(box.alias("box"), F.min("first").alias("first"), F.max("last").alias("last"))
    extents = F.struct(F.struct(F.array("box").alias("bbox")).alias("spatial"), F.struct(F.array(F.array(zulu(F.col("first")), zulu(F.col("last")))).alias("interval")).alias("temporal"))
    return whole.select(F.to_json(F.struct(F.lit("Collection").alias("type"), F.lit(VERSION).alias("stac_version"), F.lit(name).alias("id"), F.lit(description).alias("description"), extents.alias("extent"), F.array().cast("array<string>").alias("links"))).alias("collection"))


def write_items(items: DataFrame, folder: str) -> None:
    """A line a JSON document; files stay as many as there are partitions."""
    items.select(F.col("item").alias("value")).write.mode("append").text(folder)
