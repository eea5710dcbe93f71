"""Deterministic splits and batch index arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyloom.sources.shared import save

SPLITS = ("train", "validation", "test")


def dealt_by_key(df: DataFrame, order: list[Column | str], buckets: int | None = None) -> DataFrame:
    """The rows with ``_slot``, their range among even ranges of the order, and ``_at``, their place in it; written once.

    Spark's range partitioning samples the keys, with a hash of the row behind them, so ranges are even whatever the
    keys look like. Sampling and the shuffle read the input; whatever follows reads the written table, so ranks hold
    also where the input isn't the same each time it is computed.
    """
    n = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
    keys = {f"_key{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)} | {"_tie": F.xxhash64(*hashed)}
    ranged = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the id of a row has its partition in the upper bits and its place in the lower 33
    dealt = save(ranged.withColumn("_at", F.monotonically_increasing_id()).drop(*keys))
    return dealt.withColumns({"_slot": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})


def global_rank(df: DataFrame, order: list[Column | str], name: str = "idx", buckets: int | None = None, size: str | None = None) -> DataFrame:
    """Zero-based rank of every row in a total order without gathering all rows in one task; ``size`` names the number of rows.

    Rows are dealt into ordered ranges, numbered within each range, and shifted by the rows of the ranges before.
    """
    dealt = dealt_by_key(df, order, buckets)
    # one row a range
    count, whole = F.col("count"), Window.partitionBy()
    before = dealt.groupBy("_slot").count().select("_slot", (F.sum(count).over(Window.orderBy("_slot")) - count).alias("_before"), F.sum(count).over(whole).alias(size or "_rows"))
    return dealt.join(F.broadcast(before), "_slot").withColumn(name, F.col("_before") + F.col("_at")).drop("_slot", "_at", "_before", "_rows")


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "i", size: str = "n") -> DataFrame:
    """Zero-based rank of every row among those of equal keys (null is a key), and their number; no task holds a frequent key alone.

    Rows are dealt into ranges of key and order; a table of the sizes of both shifts a row's place in its range.
    """
    if not keys:
        return global_rank(df, order, name, size=size)
    dealt = dealt_by_key(df, [*keys, *order])
    by = [F.col(k).alias(f"_by_{k}") for k in keys]
    sizes = dealt.groupBy(*by, F.col("_slot").alias("_range")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*[f"_by_{k}" for k in keys])
    before = F.sum("_rows").over(own.orderBy("_range")) - F.col("_rows")
    sizes = sizes.select("*", before.alias("_before"), F.sum("_rows").over(own).alias(size))
    same = F.col("_slot") == F.col("_range")
    for k in keys:
        same = same & dealt[k].eqNullSafe(sizes[f"_by_{k}"])
    met = dealt.join(sizes, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return met.drop("_slot", "_at", "_range", "_rows", "_first", "_before", *[f"_by_{k}" for k in keys])


def with_earlier(dealt: DataFrame, keys: list[str], ends: dict[str, Column], earlier: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Dealt rows with what the earlier ranges of their key hold, so that a fold over a key needs no task with all its rows.

    ``ends`` aggregates a key's rows of one range (over the columns and ``_at``), ``earlier`` gets the window of a key's ranges and
    makes columns of these aggregates; the table of both has a row a key and range, and is joined by both.
    """
    by = [F.col(k).alias(f"_by_{k}") for k in keys]
    table = dealt.groupBy(*by, F.col("_slot").alias("_range")).agg(*[c.alias(n) for n, c in ends.items()])
    own = Window.partitionBy(*[f"_by_{k}" for k in keys]).orderBy("_range")
    table = table.select(*[f"_by_{k}" for k in keys], "_range", *[f(own).alias(n) for n, f in earlier.items()])
    same = F.col("_slot") == F.col("_range")
    for k in keys:
        same = same & dealt[k].eqNullSafe(table[f"_by_{k}"])
    return dealt.join(table, same).drop("_range", *[f"_by_{k}" for k in keys])


def split_sizes(n: int, train: float = 0.8, test_of_rest: float = 0.5) -> tuple[int, int, int]:
    """train = floor(f n); of the rest, test = ceil(g rest) and validation what is left."""
    first = int(train * n + 1e-9)
    test = -int(-(n - first) * test_of_rest // 1)
    return first, n - first - test, test


def seeded_order(id_col: str, seed: int) -> list[Column]:
    """An order by a seeded hash of the id."""
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), F.col(id_col)]


def split_by_rank(df: DataFrame, order: list, train: float = 0.8, test_of_rest: float = 0.5, shuffle_seed: int | None = None, id_col: str | None = None) -> DataFrame:
    """``idx`` and ``split`` by rank: contiguous in the order, or in the order of a seeded hash of ``id_col``."""
    ranked = global_rank(df, order if shuffle_seed is None else seeded_order(id_col, shuffle_seed), size="_n")
    first = F.floor(F.col("_n") * F.lit(train) + F.lit(1e-9))
    tests = F.ceil((F.col("_n") - first) * F.lit(test_of_rest))
    return ranked.withColumn("split", F.when(F.col("idx") < first, "train").when(F.col("idx") < F.col("_n") - tests, "validation").otherwise("test")).drop("_n")


def shuffle_within(df: DataFrame, split: str, id_col: str, seed: int, name: str = "position") -> DataFrame:
    """Position of every row in its split, shuffled by a seeded hash of the id; rows stay in their splits."""
    return rank_within(df, [split], seeded_order(id_col, seed), name, "_size").drop("_size")


def batch_of(idx: Column, size: int) -> Column:
    return F.floor(idx / F.lit(size)).cast("long")


def save_index(idx: Column, save: int, built_in: int) -> Column:
    """File that holds an item: ``idx // save`` unbatched, else ``idx // (save // built_in)``."""
    if built_in > 1 and save % built_in:
        raise ValueError("the save batch is a multiple of the built-in batch")
    return batch_of(idx, save if built_in == 0 else save // built_in)


def batch_offset(idx: Column, save: int, built_in: int) -> tuple[Column, Column]:
    """First position of an item in its file, and the position after its last."""
    if built_in == 0:
        start = F.pmod(idx, F.lit(save))
        return start.cast("long"), (start + 1).cast("long")
    start = F.pmod(idx, F.lit(save // built_in)) * built_in
    return start.cast("long"), (start + built_in).cast("long")


def effective_batch_size(built_in: Column, loader: Column) -> Column:
    return built_in * loader


def split_length(files: DataFrame, split: str, path: str, length: str, save: int, built_in: int) -> DataFrame:
    """Items of each split from its number of files and the length of the last one."""
    per = max(built_in, 1)
    return files.groupBy(split).agg(F.ceil(((F.count(F.lit(1)) - 1) * save + F.max_by(length, path)) / F.lit(per)).cast("long").alias("items"))


def at_index(df: DataFrame, idx_col: str, wanted: list[int]) -> DataFrame:
    """Rows at the wanted positions; a position at or past the length raises when the result is read."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    asked = df.sparkSession.createDataFrame([(i,) for i in wanted], "_want long").crossJoin(n)
    checked = asked.withColumn("_ok", F.when(F.col("_want") < F.col("_n"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), F.col("_want").cast("string")))))
    return df.join(F.broadcast(checked.where("_ok")), F.col(idx_col) == F.col("_want")).drop("_want", "_n", "_ok")
