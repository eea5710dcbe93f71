"""Ordered series: order checks, bounded compaction, weighted means and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.splits import dealt_by_key, rank_within, with_earlier


def order_violations(df: DataFrame, series: str, order: list[str], time: str, spread: bool = False) -> DataFrame:
    """Rows whose time isn't above that of the row before in their series, with ``previous_time``.

    Each series is read by one task; with ``spread`` long ones are dealt to many, at the cost of writing the rows once.
    """
    if spread:
        met = with_earlier(dealt_by_key(df, [series, *order]), [series], {"_last": F.max_by(time, "_at")}, {"_before": lambda own: F.lag("_last").over(own)})
        w = Window.partitionBy("_slot", series).orderBy("_at")
        previous = F.when(F.row_number().over(w) == 1, F.col("_before")).otherwise(F.lag(time).over(w))
        return met.withColumn("previous_time", previous).where(F.col(time) <= F.col("previous_time")).drop("_slot", "_at", "_before")
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumn("previous_time", F.lag(time).over(w)).where(F.col(time) <= F.col("previous_time"))


def counter_time(df: DataFrame, series: str, order: list[str], name: str = "counter") -> DataFrame:
    """0, 1, 2 ... in the order of each series."""
    return rank_within(df, [series], order, name, "_n").drop("_n")


def bucket_of(i: Column, n: Column, limit: int, keep_start: int = 0, keep_end: int = 0) -> Column:
    """Bucket of point ``i`` of ``n`` appended one by one to a series of at most ``limit`` buckets.

    When an append exceeds the limit, neighbouring buckets are joined in pairs, but for the first ``keep_start`` and
    the last ``keep_end``; an odd one stays. Counts alone decide, in closed form: of the m = limit + 1 - keep_start -
    keep_end buckets in the middle each joining takes f = m // 2 away, so joinings come every f points after the first.
    A point enters ``f`` places lower for each joining before it, moves down by f in each while it is among the kept
    last ones, and its place in the middle is halved by each joining after that.
    """
    middle = limit + 1 - keep_start - keep_end
    f, end = middle // 2, keep_start + middle
    if limit < 1 or f < 1:
        raise ValueError("the limit leaves no two buckets to join")
    rounds = lambda points: F.when(points <= limit, F.lit(0)).otherwise(F.floor((points - limit - 1) / F.lit(f)) + 1).cast("long")
    before = rounds(i)
    entered = i - f * before
    left = rounds(n) - before
    moving = F.when(entered < end, F.lit(0)).otherwise(F.least(left, F.floor((entered - end) / F.lit(f)).cast("long") + 1))
    place = (entered - f * moving).cast("long")
    halved = keep_start + F.call_function("shiftright", (place - keep_start).cast("long"), F.least(left - moving, F.lit(62)).cast("int"))
    return F.when(place < keep_start, place).otherwise(halved)


def _summarise(df: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """One row a bucket: midpoint time, bounds (null for single points), count and mean."""
    g = df.groupBy(series, "bucket").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("cnt"), F.avg(value).alias("value"))
    many = F.col("cnt") > 1
    return g.select(series, "bucket", ((F.col("lo") + F.col("hi")) / 2).alias("time"), F.when(many, F.col("lo")).alias("lo"), F.when(many, F.col("hi")).alias("hi"), "cnt", "value")


def compact(df: DataFrame, series: str, order: list[str], time: str, value: str, limit: int, keep_start: int = 0, keep_end: int = 0, index: tuple[str, str] | None = None) -> DataFrame:
    """Each series within ``limit`` buckets, as appending its points one by one would leave it; the bucket is a column expression.

    ``index`` names columns that have each point's place in its series and the series' length already.
    """
    numbered = df.withColumns({"i": F.col(index[0]), "n": F.col(index[1])}) if index else rank_within(df, [series], order, "i", "n")
    return _summarise(numbered.withColumn("bucket", bucket_of(F.col("i"), F.col("n"), limit, keep_start, keep_end)), series, time, value)


STATE = ("series", "n", "bucket", "first", "last", "lo", "hi", "cnt", "total")


def _points(df: DataFrame, series: str, order: list[str], time: str, value: str) -> DataFrame:
    """series, time, value of points with a series, their places and numbers; no other columns, so none can clash."""
    keys = [f"_o{i}" for i in range(len(order))]
    src = df.where(F.col(series).isNotNull()).select(F.col(series).alias("series"), F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"), *[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)])
    return rank_within(src, ["series"], keys, "_i", "_new").drop(*keys)


def _singles(points: DataFrame, n: Column, place: Column) -> DataFrame:
    """Each point as a part of a bucket."""
    return points.select("series", n.alias("n"), place.alias("first"), place.alias("last"), F.col("_t").alias("lo"), F.col("_t").alias("hi"), F.lit(1).cast("long").alias("cnt"), F.col("_v").alias("total"))


def state_of(df: DataFrame, series: str, order: list[str], time: str, value: str, limit: int, keep_start: int = 0, keep_end: int = 0) -> DataFrame:
    """State of each series' compaction: its number of points, and of each bucket the first and last point's place and time, their number and sum."""
    return _rebucketed(_singles(_points(df, series, order, time, value), F.col("_new"), F.col("_i")), limit, keep_start, keep_end)


def _rebucketed(parts: DataFrame, limit: int, keep_start: int, keep_end: int) -> DataFrame:
    """Parts of buckets joined by the bucket of their first point: joinings only ever join neighbours, so a bucket goes whole."""
    placed = parts.withColumn("bucket", bucket_of(F.col("first"), F.col("n"), limit, keep_start, keep_end))
    grouped = placed.groupBy("series", "bucket").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))
    return grouped.select(*STATE)


def resumed(state: DataFrame, new: DataFrame, series: str, order: list[str], time: str, value: str, limit: int, keep_start: int = 0, keep_end: int = 0) -> DataFrame:
    """The state after more points, as if all had come in one run; only the state's buckets and the new points are read.

    Points not after their series' last one are refused when the result is read, as appending them one by one refuses them.
    """
    ends = state.groupBy("series").agg(F.max("n").alias("_before"), F.max("hi").alias("_end"))
    met = _points(new, series, order, time, value).join(ends, "series", "left")
    before = F.coalesce("_before", F.lit(0).cast("long"))
    late = F.raise_error(F.concat(F.lit("out of order in series "), F.col("series").cast("string"))).cast("long")
    one = _singles(met, before + F.col("_new"), F.when(F.col("_end").isNull() | (F.col("_t") > F.col("_end")), before + F.col("_i")).otherwise(late))
    grown = one.groupBy(F.col("series").alias("_grown")).agg(F.max("n").alias("_n"))
    old = state.join(grown, F.col("series") == F.col("_grown"), "left").withColumn("n", F.coalesce("_n", "n")).drop("_n", "_grown", "bucket")
    return _rebucketed(old.unionByName(one), limit, keep_start, keep_end)


def buckets(state: DataFrame, series: str) -> DataFrame:
    """What ``compact`` gives, from a state."""
    many = F.col("cnt") > 1
    return state.select(F.col("series").alias(series), "bucket", ((F.col("lo") + F.col("hi")) / 2).alias("time"), F.when(many, F.col("lo")).alias("lo"), F.when(many, F.col("hi")).alias("hi"), "cnt", (F.col("total") / F.col("cnt")).alias("value"))


def merge_pairs(df: DataFrame, series: str, order: list[str], time: str, value: str, index: str | None = None) -> DataFrame:
    """One pass: neighbouring points in pairs, an odd last one alone; ``index`` names a column that has their places."""
    numbered = df.withColumn("i", F.col(index)) if index else rank_within(df, [series], order, "i", "n")
    return _summarise(numbered.withColumn("bucket", F.floor(F.col("i") / F.lit(2))), series, time, value)


def weighted_mean(df: DataFrame, series: str, value: str, count: str) -> DataFrame:
    """Count-weighted mean of each series; a zero count in all gives null."""
    return df.groupBy(series).agg(F.try_divide(F.sum(F.col(value) * F.col(count)), F.sum(count).cast("double")).alias("mean_value"))


def last_values(df: DataFrame, series: str, time: str, value: str) -> DataFrame:
    return df.groupBy(series).agg(F.max_by(value, time).alias("last_value"), F.max(time).alias("last_time"))


def last_values_text(last: DataFrame, series: str, text: Column, exclude: list[str] | None = None) -> DataFrame:
    """One row: "name: value, name: value" by name, without the excluded names. Series are few."""
    kept = last.where(~F.col(series).isin(exclude)) if exclude else last
    pairs = F.sort_array(F.collect_list(F.concat_ws(": ", F.col(series), text)))
    return kept.agg(F.array_join(pairs, ", ").alias("summary"))


def common_length(df: DataFrame, series: str, refuse: bool = False) -> DataFrame:
    """One row: the series' common length (0 without series) and whether all have it; with ``refuse`` unequal ones raise when it is read."""
    n = df.groupBy(series).count()
    found = n.agg(F.coalesce(F.max("count"), F.lit(0)).alias("length"), F.coalesce(F.min("count") == F.max("count"), F.lit(True)).alias("is_common"))
    return found.withColumn("length", F.when(F.col("is_common"), F.col("length")).otherwise(F.raise_error(F.lit("series of unequal lengths")).cast("long"))) if refuse else found


def concurrent_times(df: DataFrame, series: str, time: str) -> DataFrame:
    """Times with the number of series that have a value then, and whether all have."""
    total = df.agg(F.countDistinct(series).alias("total"))
    return df.groupBy(time).agg(F.countDistinct(series).alias("present")).crossJoin(F.broadcast(total)).select(time, "present", (F.col("present") == F.col("total")).alias("complete"))


def migrate_state(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Old state columns under their new names; where both are there the new value wins."""
    out = df
    for old, new in renames.items():
        if old in df.columns:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return out
