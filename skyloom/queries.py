"""Registered queries of the core library, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import catalog as C
from skyloom.functions import permutation as E
from skyloom.functions import scaling as S
from skyloom.functions import sql as J
from skyloom.functions import text as X
from skyloom.operators import climatology as D
from skyloom.operators import files as L
from skyloom.operators import grids as Z
from skyloom.operators import metrics as M
from skyloom.operators import network as K
from skyloom.operators import passes as W
from skyloom.operators import periods as P
from skyloom.operators import series as R
from skyloom.operators import splits as B
from skyloom.operators import tensors as N
from skyloom.sources import archives as A
from skyloom.sources import catalogue as G
from skyloom.sources import samples as O
from skyloom.sources import states as Y
from skyloom.sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VARS, ALIAS = C.variables_sql(), "(SELECT * FROM " + C.sql_values(list(C.ALIASES.items()), ["alias", "name"]) + ")"
UNITS = "(SELECT * FROM " + C.sql_values(C.UNIT_FACTORS, ["units", "cf_units", "factor", '"offset"']) + ")"
#: Variables that the event types stand for: by alias, by name, and one that is unknown.
EVENT_VARIABLES = [("click", "HRDPS_P_TT_10000"), ("error", "HRDPS_P_PR_SFC"), ("purchase", "P_UUC_10000"), ("signup", "MF"), ("view", "unlisted")]
EV = "(SELECT * FROM " + C.sql_values(EVENT_VARIABLES, ["event_type", "variable"]) + ")"
#: Events joined with their variable's row.
NAMED = f"(SELECT e.*, m.variable, v.name AS canonical, v.* EXCLUDE (name) FROM events e JOIN {EV} m USING (event_type) LEFT JOIN {ALIAS} a ON m.variable = a.alias AND m.variable NOT IN (SELECT name FROM {VARS}) LEFT JOIN {VARS} v ON v.name = coalesce(a.name, m.variable))"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def named_events(spark: SparkSession, sf: str, fields: tuple[str, ...] = tuple(C.FIELDS)) -> DataFrame:
    names = spark.createDataFrame(EVENT_VARIABLES, "event_type string, variable string").coalesce(1)
    return C.with_variable(table(spark, sf, "events").join(F.broadcast(names), "event_type"), "variable", fields)


def seconds(ts: str = "ts") -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)).cast("double") / F.lit(1e6)


SECONDS = "CAST(epoch_us(ts) AS DOUBLE) / 1e6"
r6 = lambda c: F.round(c, 6)

# --- scaling -----------------------------------------------------------------------------------------------------


@query("normalize_linear", "SELECT event_id, round(-1 + (value - min(value) OVER (PARTITION BY event_type)) * 2 / nullif(max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type), 0), 6) AS scaled FROM events")
def _(spark, sf):
    df = S.with_bounds(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return df.select("event_id", r6(S.normalize(F.col("value"), F.col("_low"), F.col("_high"))).alias("scaled"))


@query("normalize_known_range", "SELECT event_id, round(0 + (value - 0) * 1 / (500 - 0), 6) AS scaled FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.normalize(F.col("value"), F.lit(0.0), F.lit(500.0), (0.0, 1.0))).alias("scaled"))


_LOG = "-1 + (ln(value - lo + 1e-3) - ln(1e-3)) * 2 / (ln(hi - lo + 1e-3) - ln(1e-3))"


@query("normalize_log", f"SELECT event_id, round({_LOG}, 6) AS scaled FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def _(spark, sf):
    df = S.with_bounds(table(spark, sf, "events").select("event_id", "value"), "value")
    return df.select("event_id", r6(S.normalize_log(F.col("value"), F.col("_low"), F.col("_high"), F.lit(1e-3))).alias("scaled"))


_Y = "(value % 201 / CAST(100.7 AS DOUBLE) - 1)"


@query("inverse_normalize_linear", f"SELECT event_id, round(lo + ({_Y} + 1) * (hi - lo) / 2, 6) AS restored FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def _(spark, sf):
    df = S.with_bounds(table(spark, sf, "events").select("event_id", "value"), "value")
    return df.select("event_id", r6(S.inverse_normalize(F.col("value") % 201 / 100.7 - 1, F.col("_low"), F.col("_high"))).alias("restored"))


@query("inverse_normalize_log", f"SELECT event_id, round(exp(ln(1e-3) + ({_Y} + 1) * (ln(hi - lo + 1e-3) - ln(1e-3)) / 2) - 1e-3 + lo, 6) AS restored FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def _(spark, sf):
    df = S.with_bounds(table(spark, sf, "events").select("event_id", "value"), "value")
    return df.select("event_id", r6(S.inverse_normalize_log(F.col("value") % 201 / 100.7 - 1, F.col("_low"), F.col("_high"), F.lit(1e-3))).alias("restored"))


@query("post_process_by_variable", f"""SELECT event_id, canonical, round(CASE WHEN log_normalize THEN exp(ln(log_offset) + (y + 1) * (ln(normalize_max - normalize_min + log_offset) - ln(log_offset)) / 2) - log_offset + normalize_min
  ELSE normalize_min + (y + 1) * (normalize_max - normalize_min) / 2 END, 6) AS physical FROM (SELECT *, value / 250.0 - 1 AS y FROM {NAMED})""")
def _(spark, sf):
    df = named_events(spark, sf, ("normalize_min", "normalize_max", "log_normalize", "log_offset"))
    return df.select("event_id", "canonical", r6(S.by_variable(F.col("value") / 250.0 - 1)).alias("physical"))


_SCALED = "CASE WHEN log_normalize THEN -1 + (ln(value - normalize_min + log_offset) - ln(log_offset)) * 2 / (ln(normalize_max - normalize_min + log_offset) - ln(log_offset)) ELSE -1 + (value - normalize_min) * 2 / (normalize_max - normalize_min) END"
_BACK = "CASE WHEN log_normalize THEN exp(ln(log_offset) + (y + 1) * (ln(normalize_max - normalize_min + log_offset) - ln(log_offset)) / 2) - log_offset + normalize_min ELSE normalize_min + (y + 1) * (normalize_max - normalize_min) / 2 END"


@query("round_trip_error", f"SELECT canonical, count(*) AS n, max(abs({_BACK} - value)) < 1e-6 AS exact, round(sum(y), 4) AS scaled FROM (SELECT *, {_SCALED} AS y FROM {NAMED} WHERE canonical IS NOT NULL AND value BETWEEN normalize_min AND greatest(normalize_max, 1000)) GROUP BY canonical")
def _(spark, sf):
    df = named_events(spark, sf).where("canonical is not null and value between normalize_min and greatest(normalize_max, 1000)").withColumn("y", S.forward_by_variable(F.col("value")))
    error = F.abs(S.by_variable(F.col("y")) - F.col("value"))
    return df.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), (F.max(error) < 1e-6).alias("exact"), F.round(F.sum("y"), 4).alias("scaled"))


@query("alias_lookup_join", f"SELECT variable, canonical, units, count(*) AS n FROM {NAMED} GROUP BY ALL")
def _(spark, sf):
    return named_events(spark, sf, ("units",)).groupBy("variable", "canonical", "units").agg(F.count(F.lit(1)).alias("n"))


@query("threshold_flags", f"SELECT canonical AS name, count(*) AS n, coalesce(mean_min, mean_max) IS NOT NULL AS has_mean, coalesce(clip_min, clip_max) IS NOT NULL AS has_clip, coalesce(nan_min, nan_max) IS NOT NULL AS has_nan FROM {NAMED} WHERE canonical IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    df = named_events(spark, sf, tuple(f"{k}_{e}" for k in ("mean", "clip", "nan") for e in ("min", "max"))).where("canonical is not null")
    return df.groupBy(F.col("canonical").alias("name"), *[C.has_thresholds(k).alias(f"has_{k}") for k in ("mean", "clip", "nan")]).agg(F.count(F.lit(1)).alias("n"))


@query("variable_catalogue", f"SELECT v.*, coalesce(n, 0) AS n, total FROM {VARS} v LEFT JOIN (SELECT canonical, count(*) AS n, round(sum(value), 4) AS total FROM {NAMED} GROUP BY 1) e ON e.canonical = v.name")
def _(spark, sf):
    found = named_events(spark, sf, ()).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return C.variables(spark).join(found, F.col("canonical") == F.col("name"), "left").drop("canonical").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("range_validation", f"SELECT variable, count(*) AS n, count_if(value NOT BETWEEN min_value AND max_value) AS outside, avg(value) BETWEEN any_value(mean_min) AND any_value(mean_max) AS mean_ok FROM {NAMED} WHERE canonical IS NOT NULL GROUP BY variable")
def _(spark, sf):
    df = named_events(spark, sf, ("min_value", "max_value", "mean_min", "mean_max")).where("canonical is not null")
    return df.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("value").between(F.col("min_value"), F.col("max_value"))).alias("outside"), F.avg("value").between(F.first("mean_min"), F.first("mean_max")).alias("mean_ok"))


@query("nan_sentinel", "SELECT event_id, CASE WHEN value * 1e35 > 8e36 THEN NULL ELSE value END AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(S.sentinel_to_null(F.col("value") * 1e35, F.lit(None).cast("double"), F.lit(8e36)).isNotNull(), F.col("value")).alias("value"))


@query("clip_values", f"SELECT event_id, CASE WHEN canonical IS NULL THEN value ELSE least(greatest(value, clip_min), 100.0) END AS clipped FROM {NAMED}")
def _(spark, sf):
    df = named_events(spark, sf, ("clip_min",))
    return df.select("event_id", S.clip(F.col("value"), F.col("clip_min"), F.when(F.col("canonical").isNotNull(), 100.0)).alias("clipped"))


@query("unit_convert", f"SELECT event_id, e.cf_units, round(value * u.factor + u.\"offset\", 6) AS converted FROM {NAMED} e LEFT JOIN {UNITS} u ON e.units = u.units AND e.cf_units = u.cf_units")
def _(spark, sf):
    df = named_events(spark, sf, ("units", "cf_units")).join(F.broadcast(C.unit_factors(spark)), ["units", "cf_units"], "left")
    return df.select("event_id", "cf_units", r6(F.col("value") * F.col("factor") + F.col("offset")).alias("converted"))


@query("anomaly", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type, hour(ts)), 6) AS anomaly FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.hour("ts").alias("h"), "value")
    climate = e.groupBy("event_type", "h").agg(F.avg("value").alias("mean"))
    return e.join(climate, ["event_type", "h"]).select("event_id", r6(F.col("value") - F.col("mean")).alias("anomaly"))


@query("deaccumulate", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def _(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "events").select("event_id", r6(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("step"))


@query("temporal_context", "SELECT event_id, len(c) AS n, round(list_sum(c), 6) AS total, c[1] AS earliest FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM events)")
def _(spark, sf):
    df = N.temporal_context(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 2, 2)
    return df.select("event_id", F.size("context").cast("long").alias("n"), r6(F.aggregate("context", F.lit(0.0), lambda a, v: a + v)).alias("total"), F.element_at("context", 1).alias("earliest"))


# --- tensors: each embedding is an 8x8 grid ---------------------------------------------------------------------------

LONG = "(SELECT vec_id, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"


@query("grid_long", f"SELECT vec_id, y, x, value FROM {LONG}")
def _(spark, sf):
    return N.to_long(table(spark, sf, "embeddings"), ["vec_id"], "embedding", 8)


@query("mask_to_null", f"SELECT vec_id, count(value) AS cells, count(CASE WHEN (y + x) % 3 = 0 THEN NULL ELSE value END) AS kept, round(sum(CASE WHEN (y + x) % 3 = 0 THEN NULL ELSE value END), 6) AS total FROM {LONG} GROUP BY vec_id")
def _(spark, sf):
    g = N.to_long(table(spark, sf, "embeddings"), ["vec_id"], "embedding", 8)
    v = S.mask_to_null(F.col("value"), F.when((F.col("y") + F.col("x")) % 3 == 0, 1).otherwise(0))
    return g.groupBy("vec_id").agg(F.count("value").alias("cells"), F.count(v).alias("kept"), r6(F.sum(v)).alias("total"))


@query("window_slice", f"SELECT vec_id, count(*) AS n, round(sum(value), 6) AS total FROM {LONG} WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4 GROUP BY vec_id")
def _(spark, sf):
    w = table(spark, sf, "embeddings").select("vec_id", N.window(F.col("embedding"), 8, 2, 1, 4, 4).alias("w"))
    return w.select("vec_id", F.size("w").cast("long").alias("n"), r6(F.aggregate("w", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("window_by_sample", f"SELECT vec_id, count(*) AS n, round(sum(value), 6) AS total FROM {LONG} WHERE y BETWEEN vec_id % 5 AND vec_id % 5 + 2 AND x BETWEEN vec_id % 3 AND vec_id % 3 + 4 GROUP BY vec_id")
def _(spark, sf):
    v = F.col("vec_id")
    w = table(spark, sf, "embeddings").select("vec_id", N.window(F.col("embedding"), 8, v % 5, v % 3, 3, 5).alias("w"))
    return w.select("vec_id", F.size("w").cast("long").alias("n"), r6(F.aggregate("w", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("channel_select", f"SELECT vec_id, round(sum(value), 6) AS total FROM {LONG} WHERE y BETWEEN 4 AND 5 GROUP BY vec_id")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(F.aggregate(N.channel(F.col("embedding"), F.lit(2), 16), F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("tile_patches", f"SELECT g.vec_id, y0, x0, round(sum(value), 6) AS total FROM {LONG} g, (SELECT CAST(a AS INTEGER) AS y0 FROM range(0, 5, 2) t(a)), (SELECT CAST(b AS INTEGER) AS x0 FROM range(0, 5, 2) t(b)) WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY ALL")
def _(spark, sf):
    t = N.tiles(table(spark, sf, "embeddings"), ["vec_id", "embedding"], 8, 8, 4, 2)
    rows = F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y0") + 3), lambda y: F.slice("embedding", y * 8 + F.col("x0") + 1, F.lit(4))))
    return t.select("vec_id", "y0", "x0", r6(F.aggregate(rows, F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("unmasked_fraction_filter", f"SELECT vec_id, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM {LONG} GROUP BY vec_id HAVING avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) >= 0.5")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", N.unmasked_fraction(F.col("embedding"), lambda v: v <= 0).alias("f"))
    return df.where("f >= 0.5").select("vec_id", r6("f").alias("fraction"))


@query("max_pool_2x2", f"SELECT vec_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(max(value), 6) AS value FROM {LONG} GROUP BY vec_id, y // 2, x // 2")
def _(spark, sf):
    return N.max_pool_2x2(table(spark, sf, "embeddings"), ["vec_id"], "embedding", 8).withColumn("value", r6("value"))


@query("global_avg_pool", f"SELECT vec_id, round(avg(value), 6) AS mean FROM {LONG} GROUP BY vec_id")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(N.mean_of(F.col("embedding"))).alias("mean"))


@query("collate_arrays", "SELECT vec_id // 16 AS batch, count(*) AS samples, CAST(sum(len(embedding)) AS BIGINT) AS length, round(min_by(embedding[1], vec_id), 6) AS head FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY ALL")
def _(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("batch", B.batch_of(F.col("vec_id"), 16))
    return N.collate(df, "batch", "vec_id", "embedding").select("batch", "samples", F.size("embedding").cast("long").alias("length"), r6(F.element_at("embedding", 1).cast("double")).alias("head"))


# --- splits and batches ---------------------------------------------------------------------------------------------

_RANK = "(SELECT *, row_number() OVER (ORDER BY {}) - 1 AS idx, count(*) OVER () AS n FROM orders)"
_SPLIT = "CASE WHEN idx < floor(0.8 * n + 1e-9) THEN 'train' WHEN idx < n - ceil((n - floor(0.8 * n + 1e-9)) * 0.5) THEN 'validation' ELSE 'test' END"
_BY_DATE, _BY_HASH = _RANK.format("o_orderdate, o_orderkey"), _RANK.format("sha256('42:' || o_orderkey), o_orderkey")


@query("contiguous_split", f"SELECT o_orderkey, idx, {_SPLIT} AS split FROM {_RANK.format('o_orderkey')}")
def _(spark, sf):
    return B.split_by_rank(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("hash_shuffle_split", f"SELECT o_orderkey, idx, {_SPLIT} AS split FROM {_BY_HASH}")
def _(spark, sf):
    return B.split_by_rank(table(spark, sf, "orders").select("o_orderkey"), [], shuffle_seed=42, id_col="o_orderkey")


@query("split_counts", f"SELECT {_SPLIT} AS split, count(*) AS n FROM {_BY_HASH} GROUP BY 1")
def _(spark, sf):
    return B.split_by_rank(table(spark, sf, "orders").select("o_orderkey"), [], shuffle_seed=42, id_col="o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("active_split_filter", f"SELECT o_orderkey FROM {_BY_HASH} WHERE {_SPLIT} = 'validation'")
def _(spark, sf):
    return B.split_by_rank(table(spark, sf, "orders").select("o_orderkey"), [], shuffle_seed=42, id_col="o_orderkey").where("split = 'validation'").select("o_orderkey")


@query("batch_assign", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS batch FROM orders")
def _(spark, sf):
    return B.global_rank(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", B.batch_of(F.col("idx"), 128).alias("batch"))


@query("batch_offsets", "SELECT o_orderkey, o_orderkey % 64 AS s0, (o_orderkey % 64) AS s1, (o_orderkey % 32) * 2 AS s2, (o_orderkey % 32) * 2 + 2 AS e2 FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", B.batch_offset(k, 64, 0)[0].alias("s0"), B.batch_offset(k, 64, 1)[0].alias("s1"), B.batch_offset(k, 64, 2)[0].alias("s2"), B.batch_offset(k, 64, 2)[1].alias("e2"))


@query("save_index", "SELECT o_orderkey, o_orderkey // 10 AS unbatched, o_orderkey // (64 // 32) AS batched FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", B.save_index(k, 10, 0).alias("unbatched"), B.save_index(k, 64, 32).alias("batched"))


@query("shuffle_within_splits", f"SELECT o_orderkey, split, row_number() OVER (PARTITION BY split ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1 AS position FROM (SELECT o_orderkey, {_SPLIT} AS split FROM {_BY_DATE})")
def _(spark, sf):
    ranked = B.split_by_rank(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return B.shuffle_within(ranked, "split", "o_orderkey", 7).select("o_orderkey", "split", "position")


_DIGEST = "substr(sha256('(''' || {} || ''', ''input1'', ''output1'', ' || {} || ')'), 1, 8)"


@query("batch_path", f"SELECT o_orderkey, 'train_' || {_DIGEST.format(chr(39) + 'train' + chr(39), 16)} || '_' || CASE WHEN length(CAST(o_orderkey // 16 AS VARCHAR)) < 8 THEN lpad(CAST(o_orderkey // 16 AS VARCHAR), 8, '0') ELSE CAST(o_orderkey // 16 AS VARCHAR) END || '.npz' AS path FROM orders")
def _(spark, sf):
    digest = X.hex_digest(X.state_text(F.lit("train"), ["input1", "output1"], F.lit(16)))
    return table(spark, sf, "orders").select("o_orderkey", X.batch_path(F.lit("train"), digest, B.save_index(F.col("o_orderkey"), 16, 0)).alias("path"))


@query("dataset_digest", f"SELECT o_orderkey, {_DIGEST.format('split', 'save')} AS digest FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS split, 1 + o_orderkey % 32 AS save FROM orders)")
def _(spark, sf):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("test")
    return table(spark, sf, "orders").select("o_orderkey", X.hex_digest(X.state_text(split, ["input1", "output1"], 1 + F.col("o_orderkey") % 32)).alias("digest"))


@query("hex_digest", "SELECT n_nationkey, substr(sha256(n_name), 1, 8) AS digest FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.hex_digest(F.col("n_name")).alias("digest"))


def stored_orders(spark, sf, save: int) -> str:
    """Orders saved in batches of ``save``, as positions of files."""
    path = new_path(spark, "orders")
    k = F.col("o_orderkey")
    O.save_batches(table(spark, sf, "orders").select(F.lit("train").alias("split"), B.batch_of(k, save).alias("batch_id"), (k % save).alias("pos"), "o_orderkey", "o_totalprice"), path)
    return path


@query("load_batch_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey // 1024 = 1 AND o_orderkey % 1024 BETWEEN 128 AND 255")
def _(spark, sf):
    return O.load_batch(spark, stored_orders(spark, sf, 1024), "train", 1, 128, 256, ["o_orderkey", "o_totalprice"]).drop("pos")


@query("load_item_modes", "SELECT mode, o_orderkey FROM orders JOIN (VALUES (0, 77, 78), (1, 77, 78), (4, 1272, 1276)) t(mode, a, b) ON o_orderkey >= a AND o_orderkey < b")
def _(spark, sf):
    path = stored_orders(spark, sf, 64)
    item = lambda mode, idx: O.load_item(spark, path, "train", idx, 64, mode, ["o_orderkey"]).select(F.lit(mode).alias("mode"), "o_orderkey")
    return item(0, 77).unionByName(item(1, 77)).unionByName(item(4, 318))


@query("index_lookup", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders) WHERE idx IN (0, 7, 500, 1499)")
def _(spark, sf):
    ranked = B.global_rank(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").withColumn("day", F.timestamp_diff("DAY", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))), ["day", "o_orderkey"])
    return B.at_index(ranked, "idx", [0, 7, 500, 1499]).select("o_orderkey", "o_totalprice")


_FILES = "(SELECT o_orderstatus AS split, o_orderkey AS path, 1 + o_custkey % 16 AS length FROM orders)"


def pseudo_files(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("path"), (1 + F.col("o_custkey") % 16).alias("length"))


@query("infer_split_index", f"SELECT split, CAST(ceil(((count(*) - 1) * 16 + max_by(length, path)) / 2.0) AS BIGINT) AS items FROM {_FILES} GROUP BY split")
def _(spark, sf):
    return B.split_length(pseudo_files(spark, sf), "split", "path", "length", 16, 2)


@query("effective_batch_size", "SELECT o_orderkey, CAST((o_custkey % 5) * (1 + o_orderkey % 32) AS BIGINT) AS size FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", B.effective_batch_size(F.col("o_custkey") % 5, 1 + F.col("o_orderkey") % 32).cast("long").alias("size"))


# --- series -----------------------------------------------------------------------------------------------------------


@query("monotonic_violations", "SELECT o_orderkey, o_custkey, p AS previous_time FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate <= p")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.order_violations(df, "o_custkey", ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_custkey", "previous_time")


@query("counter_time", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS counter FROM events")
def _(spark, sf):
    return R.counter_time(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "counter")


_COUNTED = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)"
_BUCKETED = "SELECT user_id, bucket, (min(i) + max(i)) / 2.0::DOUBLE AS time, CASE WHEN count(*) > 1 THEN min(i) END AS lo, CASE WHEN count(*) > 1 THEN max(i) END AS hi, count(*) AS cnt, round(avg(value), 9) AS value FROM ({}) GROUP BY user_id, bucket"


def counted_events(spark, sf):
    return B.rank_within(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "t", "n")


def bucketed(df):
    # means of many values of two decimals end in a 5, so that six decimals would round them either way
    return df.withColumn("value", F.round("value", 9))


@query("compact_bounded", _BUCKETED.format(f"SELECT *, CASE WHEN i < 16 THEN i >> p ELSE (8 + (i - 16) % 8) >> (p - 1 - (i - 16) // 8) END AS bucket FROM (SELECT *, CASE WHEN n < 16 THEN 0 ELSE (n - 16) // 8 + 1 END AS p FROM {_COUNTED})"))
def _(spark, sf):
    return bucketed(R.compact(counted_events(spark, sf), "user_id", ["t"], "t", "value", 15, index=("t", "n")))


@query("compact_pairs", _BUCKETED.format(f"SELECT *, i // 2 AS bucket FROM {_COUNTED}"))
def _(spark, sf):
    return bucketed(R.merge_pairs(counted_events(spark, sf), "user_id", ["t"], "t", "value", index="t"))




# limit 20, 3 first and 5 last kept: 13 in the middle, of which a joining takes 6 away
_JOINED = "CASE WHEN {0} <= 20 THEN 0 ELSE ({0} - 21) // 6 + 1 END"
_KEPT_ENDS = f"(SELECT *, place0 - 6 * moving AS place, left_over - moving AS halvings FROM (SELECT *, CASE WHEN place0 < 16 THEN 0 ELSE least(left_over, (place0 - 16) // 6 + 1) END AS moving FROM (SELECT *, i - 6 * {_JOINED.format('i')} AS place0, {_JOINED.format('n')} - {_JOINED.format('i')} AS left_over FROM {_COUNTED})))"


@query("compact_keep_ends", _BUCKETED.format(f"SELECT *, CAST(CASE WHEN place < 3 THEN place ELSE 3 + ((place - 3) >> halvings) END AS BIGINT) AS bucket FROM {_KEPT_ENDS}"))
def _(spark, sf):
    return bucketed(R.compact(counted_events(spark, sf), "user_id", ["t"], "t", "value", 20, 3, 5, index=("t", "n")))


@query("series_weighted_mean", "SELECT event_type, round(sum(value * (1 + user_id % 5)) / sum(1 + user_id % 5), 6) AS mean_value FROM events GROUP BY event_type")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("cnt", 1 + F.col("user_id") % 5)
    return R.weighted_mean(df, "event_type", "value", "cnt").withColumn("mean_value", r6("mean_value"))


@query("series_last_time", "SELECT max(ts) AS last_time FROM events")
def _(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts").alias("last_time"))


@query("series_last_values", "SELECT event_type, max_by(value, event_id) AS last_value, max(event_id) AS last_time FROM events GROUP BY event_type")
def _(spark, sf):
    return R.last_values(table(spark, sf, "events"), "event_type", "event_id", "value")


@query("series_last_values_str", "SELECT string_agg(event_type || ': ' || printf('%.4f', v), ', ' ORDER BY event_type) AS summary FROM (SELECT event_type, max_by(value, event_id) AS v FROM events WHERE event_type NOT IN ('view') GROUP BY event_type)")
def _(spark, sf):
    last = R.last_values(table(spark, sf, "events"), "event_type", "event_id", "value")
    return R.last_values_text(last, "event_type", F.format_string("%.4f", "last_value"), ["view"])


@query("series_common_length", "SELECT max(n) AS length, min(n) = max(n) AS is_common FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def _(spark, sf):
    return R.common_length(table(spark, sf, "events"), "event_type")


@query("concurrent_check", "SELECT h, count(DISTINCT event_type) AS present, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM (SELECT event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY h")
def _(spark, sf):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return R.concurrent_times(table(spark, sf, "events").select("event_type", hour.alias("h")), "event_type", "h")


@query("state_migration", "SELECT n_nationkey, coalesce(n_name, '') AS series, n_regionkey AS max_length FROM nation")
def _(spark, sf):
    old = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("old_series"), F.col("n_regionkey").alias("old_limit"), F.lit(None).cast("string").alias("series"))
    return R.migrate_state(old, {"old_series": "series", "old_limit": "max_length"})


# --- metrics ----------------------------------------------------------------------------------------------------------


@query("metric_argmin", "SELECT event_type, (arg_min({'v': value, 'i': event_id}, {'v': value, 'i': event_id})).v AS min_value, (arg_min({'v': value, 'i': event_id}, {'v': value, 'i': event_id})).i AS min_iteration FROM events GROUP BY event_type")
def _(spark, sf):
    return M.minima(table(spark, sf, "events"), "event_type", "value", "event_id")


@query("metric_argmin_tracked", "SELECT event_type, (arg_min({'v': value, 'i': event_id}, {'v': value, 'i': event_id})).v AS min_value, (arg_min({'v': value, 'i': event_id}, {'v': value, 'i': event_id})).i AS min_iteration FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def _(spark, sf):
    tracked = spark.createDataFrame([("click",), ("error",), ("absent",)], "event_type string")
    return M.minima(table(spark, sf, "events"), "event_type", "value", "event_id", tracked)


@query("any_metric_improved", "SELECT coalesce(bool_or(coalesce(n.value < b.least, TRUE)), FALSE) AS any_improved FROM (SELECT event_type, min(value) AS value FROM events WHERE event_id % 10 = 0 AND event_type IN ('click', 'error') GROUP BY event_type) n LEFT JOIN (SELECT event_type, min(value) AS least FROM events WHERE event_id % 10 <> 0 GROUP BY event_type) b USING (event_type)")
def _(spark, sf):
    e = table(spark, sf, "events")
    now = e.where("event_id % 10 = 0").groupBy("event_type").agg(F.min("value").alias("value"))
    listed = spark.createDataFrame([("click",), ("error",)], "event_type string")
    return M.improved(e.where("event_id % 10 <> 0"), now, "event_type", "value", listed)


@query("running_minimum_flags", "SELECT event_id, p AS previous_min, coalesce(value < p, TRUE) AS improved FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events)")
def _(spark, sf):
    return M.running_minimum(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", ["event_id"], "value").select("event_id", "previous_min", "improved")


@query("running_minimum_spread", "SELECT event_id, p AS previous_min, coalesce(value < p, TRUE) AS improved FROM (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events)")
def _(spark, sf):
    return M.running_minimum(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", ["event_id"], "value", spread=True).select("event_id", "previous_min", "improved")


@query("monotonic_spread", "SELECT o_orderkey, o_orderstatus, p AS previous_time FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate <= p")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return R.order_violations(df, "o_orderstatus", ["o_orderkey"], "o_orderdate", spread=True).select("o_orderkey", "o_orderstatus", "previous_time")


@query("eta_spread", f"SELECT event_id, n AS call, round(CASE WHEN n = 1 THEN NULL WHEN n >= 900 THEN 0.0 ELSE (s - s0) / (n - 1) * (900 - n) END, 3) AS eta FROM (SELECT event_id, row_number() OVER w AS n, {SECONDS} AS s, first({SECONDS}) OVER w AS s0 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts", seconds().alias("s"))
    return M.remaining_time(df, "event_type", ["ts", "event_id"], "s", 900, spread=True).select("event_id", "call", F.round("eta", 3).alias("eta"))


@query("iteration_counts", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lifetime, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY event_id) AS since_restart FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("user_id").alias("loop"), F.dayofmonth("ts").alias("d"))
    return M.iteration_counts(df, ["event_id"], "d").select("event_id", "lifetime", "since_restart")


@query("eta_estimate", f"SELECT event_id, n AS call, round(CASE WHEN n = 1 THEN NULL WHEN n >= 40 THEN 0.0 ELSE (s - s0) / (n - 1) * (40 - n) END, 3) AS eta FROM (SELECT event_id, row_number() OVER w AS n, {SECONDS} AS s, first({SECONDS}) OVER w AS s0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", seconds().alias("s"))
    return M.remaining_time(df, "user_id", ["ts", "event_id"], "s", 40).select("event_id", "call", F.round("eta", 3).alias("eta"))


@query("eta_suffix", f"SELECT event_id, CASE WHEN s IS NULL THEN ' (ETA: unknown)' WHEN s <= 0 THEN ' (ETA: done)' ELSE ' (ETA: ' || floor(s / 86400)::BIGINT || ' d)' END AS suffix FROM (SELECT event_id, CASE WHEN value < 50 THEN NULL WHEN value < 100 THEN 0.0 ELSE 86400.0 * (1 + event_id % 9) END AS s FROM events)")
def _(spark, sf):
    left = F.when(F.col("value") < 50, None).when(F.col("value") < 100, F.lit(0.0)).otherwise(86400.0 * (1 + F.col("event_id") % 9))
    shown = M.eta_suffix(left)
    return table(spark, sf, "events").select("event_id", F.regexp_replace(shown, " 0 h\\)", ")").alias("suffix"))


@query("tail_fraction", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS b, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE b <= ceil(n * 0.1)")
def _(spark, sf):
    return M.tail_part(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"], 0.1).select("event_id")


@query("rate_limit_events", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {SECONDS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, s AS last, 1 AS n, TRUE AS emitted FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.s - f.last < 20000 AND f.n >= 3 THEN f.last ELSE e.s END, CASE WHEN e.s - f.last < 20000 AND f.n >= 3 THEN f.n ELSE f.n + 1 END, NOT (e.s - f.last < 20000 AND f.n >= 3) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, emitted FROM f""")
def _(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", seconds().alias("s"))
    return M.rate_limited(df, "user_id", "event_id", "s", 20000.0, 3)


@query("usage_by_user_over", "SELECT user_id, round(sum(value), 6) AS used FROM events GROUP BY user_id HAVING sum(value) > 3500")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("u")).where("u > 3500").select("user_id", r6("u").alias("used"))


# --- files, manifests, logs -------------------------------------------------------------------------------------------

_LINES = "(SELECT doc_id AS file, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(l, '[\\r\\n]+$', '') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
_MATCH = "(contains(line, 'License') OR contains(line, '***'))"
PATTERNS = ["License", "***"]


def doc_lines(spark, sf):
    return L.lines(table(spark, sf, "documents"), "doc_id", "text")


@query("merge_manifests", f"SELECT (min({{'f': file, 'n': line_no}})).f AS file, (min({{'f': file, 'n': line_no}})).n AS line_no, line FROM {_LINES} WHERE line <> '' GROUP BY line")
def _(spark, sf):
    return L.merge_manifests(doc_lines(spark, sf))


@query("merge_logs_filter", f"SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS position, line FROM {_LINES} WHERE {_MATCH} UNION ALL SELECT DISTINCT file, 0, '--- ' || file || ' ---' FROM {_LINES} WHERE {_MATCH}")
def _(spark, sf):
    return L.filter_logs(doc_lines(spark, sf), PATTERNS)


@query("logs_without_match", f"SELECT DISTINCT file FROM {_LINES} WHERE file NOT IN (SELECT file FROM {_LINES} WHERE {_MATCH})")
def _(spark, sf):
    return L.without_match(doc_lines(spark, sf), PATTERNS)


@query("exclude_keys_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return L.excluding(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("split_glob_batches", "SELECT batch, 'orders_' || lpad(CAST(batch AS VARCHAR), 8, '0') || '.txt' AS manifest, count(*) AS n, min(path) AS head FROM (SELECT path, (row_number() OVER (ORDER BY path) - 1) // 50 AS batch FROM (SELECT 'o' || o_orderkey AS path FROM orders)) GROUP BY batch")
def _(spark, sf):
    paths = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    return L.batches_of_paths(paths, "path", 50, "orders").select("batch", "manifest", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("head"))


_NEWER = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)"


@query("retention_purge", f"SELECT o_orderkey FROM (SELECT *, {_NEWER} AS r FROM orders) WHERE r > 5 AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    now = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return L.retention_plan(df, "o_orderkey", "o_orderdate", now, F.expr("interval 365 days"), 5, both=True, scope="o_custkey").select("o_orderkey")


@query("retention_either", f"SELECT o_orderkey FROM (SELECT *, {_NEWER} AS r FROM orders) WHERE r > 5 OR o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return L.retention_plan(df, "o_orderkey", "o_orderdate", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.expr("interval 365 days"), 5, scope="o_custkey").select("o_orderkey")


@query("latest_checkpoint", "SELECT o_orderpriority, (max({'t': o_orderdate, 'p': o_orderkey})).p AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    return L.newest(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "o_orderdate")


def saves_of(spark, sf):
    """A history of saves: each order is one, of the network of its priority; a third of them have no path."""
    o = table(spark, sf, "orders")
    path = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("/old/"), F.col("o_orderkey").cast("string"), F.lit(".pth")))
    return o.select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("save_id"), F.col("o_orderpriority").alias("network"), path.alias("path"), F.col("o_orderdate").alias("mtime"), "o_orderkey")


@query("checkpoint_history", "SELECT o_orderpriority AS network, arg_max('/old/' || o_orderkey || '.pth', o_orderkey) AS last_path, count(*) AS saves FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_orderpriority")
def _(spark, sf):
    return L.last_saved(saves_of(spark, sf).drop("save_id").withColumnRenamed("o_orderkey", "save_id"))


@query("latest_save", "SELECT o_orderpriority AS network, '/new/' || o_orderkey || '.pth' AS path FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey // 4 = (SELECT o_orderkey // 4 FROM orders WHERE o_orderkey % 3 > 0 AND contains(o_orderkey || '.pth', '7') ORDER BY o_orderdate DESC, '/old/' || o_orderkey || '.pth' DESC LIMIT 1)")
def _(spark, sf):
    saves = saves_of(spark, sf).where("path is not null")
    return L.latest_save(saves.select("path", "mtime"), saves.select("save_id", "network", "path"), "7", "/new/")


@query("duplicate_names", "SELECT c_mktsegment, count(*) AS times FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def _(spark, sf):
    return L.duplicates(table(spark, sf, "customer"), "c_mktsegment")


@query("config_override", "SELECT n_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'own_' || n_nationkey WHEN n_nationkey % 3 = 1 THEN NULL END, 'base') AS value FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    base = n.select("n_name", F.lit("base").alias("value"))
    changes = n.where("n_nationkey % 3 < 2").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("own_"), F.col("n_nationkey").cast("string"))).alias("value"))
    return L.override(base, changes, "n_name", "value")


@query("config_aggregate", "SELECT n_regionkey, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    return L.last_by_key(table(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey")


@query("template_paths", "SELECT n_nationkey, '/data/' || n_regionkey || '/' || n_name || '_${left}.nc' AS path FROM nation")
def _(spark, sf):
    t = F.lit("/data/${region}/${name}_${left}.nc")
    return table(spark, sf, "nation").select("n_nationkey", X.fill_template(t, {"region": F.col("n_regionkey").cast("string"), "name": F.col("n_name")}).alias("path"))


# --- readable strings -------------------------------------------------------------------------------------------------

_VALUE = "CASE WHEN v < -1e38 OR v > {hi} THEN printf('%.1e', v) WHEN floor(v) = v AND abs(v) < 1000000 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN abs(v) < 0.01 THEN printf('%.4e', v) WHEN abs(v) < 100 THEN printf('%.4f', v) WHEN abs(v) < 10000 THEN printf('%.2f', v) WHEN abs(v) < 1000000 THEN printf('%.0f', v) ELSE printf('%.4e', v) END"


@query("readable_value", f"SELECT event_id, {_VALUE.format(hi='1e38')} AS shown, {_VALUE.format(hi='100')} AS bounded FROM (SELECT event_id, value AS v FROM events)")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", X.readable_value(v).alias("shown"), X.readable_value(v, high=100.0).alias("bounded"))


_R = "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)"
_I = "CAST(CAST(floor({}) AS BIGINT) AS VARCHAR)"


@query("readable_delta_t", f"""SELECT event_id, CASE WHEN s < 0.001 THEN {_R.format('s * 1e6')} || ' µs' WHEN s < 1 THEN {_R.format('s * 1000')} || ' ms' WHEN s < 60 THEN {_R.format('s')} || ' s'
 WHEN s < 300 THEN {_I.format('s / 60')} || ' min ' || {_R.format('s % 60')} || ' s' WHEN s < 3600 THEN {_R.format('s / 60')} || ' min'
 WHEN s < 86400 THEN {_I.format('s / 3600')} || ' h ' || {_R.format('(s % 3600) / 60')} || ' min' ELSE {_I.format('s / 86400')} || ' d ' || {_R.format('(s % 86400) / 3600')} || ' h' END AS shown FROM (SELECT event_id, value * value * 7 + 0.003 AS s FROM events)""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.readable_duration(F.col("value") * F.col("value") * 7 + 0.003).alias("shown"))


@query("readable_memory", "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN b // 1024 || ' KB' WHEN b < 1073741824 THEN b // 1048576 || ' MB' WHEN b < 1099511627776 THEN b // 1073741824 || ' GB' ELSE b // 1099511627776 || ' TB' END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1000 AS b FROM orders)")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.readable_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("shown"))


# --- periods and times ------------------------------------------------------------------------------------------------


_PERIODS = "SELECT event_id, strftime(ts, '%Y%m%d%H') || '_' || strftime(ts + to_hours(CAST(user_id AS INTEGER)), '%Y%m%d%H') AS p FROM events"


@query("decode_period", f"SELECT event_id, strptime(split_part(p, '_', 1), '%Y%m%d%H') AS first, strptime(split_part(p, '_', 2), '%Y%m%d%H') AS last FROM ({_PERIODS})")
def _(spark, sf):
    later = F.timestamp_add("HOUR", F.col("user_id").cast("int"), F.col("ts"))
    e = table(spark, sf, "events").select("event_id", F.concat_ws("_", P.compact_hour(F.col("ts")), P.compact_hour(later)).alias("period"))
    a, b = P.decode_period(F.col("period"))
    return e.select("event_id", a.alias("first"), b.alias("last"))


_SPANS = "SELECT user_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY user_id"


@query("split_period", f"SELECT user_id, strftime(f, '%Y%m%d%H') || '_' || strftime(l, '%Y%m%d%H') AS period, f AS first, l AS last FROM (SELECT user_id, a + to_hours(CAST(6 * 8 * i AS INTEGER)) AS f, a + to_hours(CAST(6 * least(8 * i + 7, steps) AS INTEGER)) AS l FROM (SELECT user_id, a, steps, unnest(range(0, steps // 8 + 1)) AS i FROM (SELECT *, date_diff('hour', a, b) // 6 AS steps FROM ({_SPANS}))))")
def _(spark, sf):
    hour = lambda f: F.date_trunc("hour", f("ts")).cast("timestamp_ntz")
    spans = table(spark, sf, "events").groupBy("user_id").agg(hour(F.min).alias("a"), hour(F.max).alias("b"))
    return P.split_spans(spans, "a", "b", 8, timedelta(hours=6)).select("user_id", "period", "first", "last")


@query("assemble_timestamp", "SELECT event_id, date_trunc('hour', ts) AS t, strftime(ts, '%Y%m%d%H') AS compact FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    t = P.assemble_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"))
    return e.select("event_id", t.alias("t"), P.compact_hour(t).alias("compact"))


@query("forecast_hour_filter", "SELECT event_id FROM events WHERE hour(ts) BETWEEN 7 AND 12 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def _(spark, sf):
    return P.forecast_hours(table(spark, sf, "events"), "ts", list(range(7, 13)), datetime(2024, 1, 5), datetime(2024, 1, 20)).select("event_id")


_COARSE = "(SELECT TIMESTAMP '2024-01-01' + to_hours(CAST((epoch_us(o_orderdate) // 86400000000 % 30) * 24 + 6 * (o_orderkey % 3) AS INTEGER)) AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)"


@query("pair_by_time", f"SELECT e.event_id, CASE WHEN date_diff('microsecond', c.t, e.ts) <= 36000000000 THEN c.o_orderkey END AS o_orderkey, CASE WHEN date_diff('microsecond', c.t, e.ts) <= 36000000000 THEN c.t END AS paired_t FROM events e ASOF LEFT JOIN {_COARSE} c ON e.ts >= c.t")
def _(spark, sf):
    day = F.pmod(F.timestamp_diff("DAY", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")), F.lit(30))
    coarse = table(spark, sf, "orders").select("o_orderkey", F.timestamp_add("HOUR", (day * 24 + 6 * (F.col("o_orderkey") % 3)).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("t"))
    return P.pair_as_of(table(spark, sf, "events").select("event_id", "ts"), coarse, "ts", "t", "o_orderkey", 36000).select("event_id", "o_orderkey", "paired_t")


# --- metadata and storage ---------------------------------------------------------------------------------------------


_LEVELLED = "SELECT event_id, event_type || CASE user_id % 4 WHEN 0 THEN '_model_levels' WHEN 1 THEN '_pressure_levels' WHEN 2 THEN '_' || (user_id * 50) ELSE '' END AS name, CASE WHEN value > 30 THEN floor(value) END AS level FROM events"


@query("infer_dimensions", f"SELECT event_id, name, CASE WHEN contains(name, 'model_levels') THEN 'model_level' WHEN contains(name, 'pressure_levels') THEN 'pressure_level' WHEN level IS NOT NULL THEN CAST(CAST(level AS BIGINT) AS VARCHAR) WHEN regexp_extract(name, '_([0-9]{{3,}})$', 1) <> '' THEN regexp_extract(name, '_([0-9]{{3,}})$', 1) END AS dimension FROM ({_LEVELLED})")
def _(spark, sf):
    kind, u = F.col("user_id") % 4, F.col("user_id")
    suffix = F.when(kind == 0, "_model_levels").when(kind == 1, "_pressure_levels").when(kind == 2, F.concat(F.lit("_"), (u * 50).cast("string"))).otherwise("")
    e = table(spark, sf, "events").select("event_id", F.concat("event_type", suffix).alias("name"), F.when(F.col("value") > 30, F.floor("value")).alias("level"))
    return e.select("event_id", "name", C.level_dimension(F.col("name"), F.col("level")).alias("dimension"))


@query("datacube_metadata", f"SELECT units, count(*) AS n, count(DISTINCT canonical) AS variables, min(level) AS lowest, max(level) AS highest, string_agg(DISTINCT CAST(CAST(level AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(level AS BIGINT) AS VARCHAR)) AS levels FROM {NAMED} WHERE canonical IS NOT NULL GROUP BY units")
def _(spark, sf):
    df = named_events(spark, sf, ("units", "level")).where("canonical is not null")
    levels = F.array_join(F.sort_array(F.collect_set(F.col("level").cast("long").cast("string"))), ",")
    found = df.groupBy("units").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("canonical").alias("variables"), F.min("level").alias("lowest"), F.max("level").alias("highest"), levels.alias("levels"))
    return found.withColumn("levels", F.when(F.col("levels") != "", F.col("levels")))


@query("datacube_json", f"SELECT event_id, to_json({{'name': canonical, 'units': units, 'cumulative': cumulative}})::VARCHAR AS item FROM {NAMED} WHERE canonical IS NOT NULL")
def _(spark, sf):
    df = named_events(spark, sf, ("units", "cumulative")).where("canonical is not null")
    return df.select("event_id", F.to_json(F.struct(F.col("canonical").alias("name"), "units", "cumulative")).alias("item"))


_BOX = "SELECT label, min(vec_id % 360 - 180) AS x0, min(vec_id % 17) AS y0, max(vec_id % 360 - 180) AS x1, max(vec_id % 17) AS y1, min(t) AS a, max(t) AS b FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id % 1000 AS INTEGER)) AS t FROM embeddings) GROUP BY label"
_Z = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query("stac_items", f"""SELECT label, '{{"type":"Feature","stac_version":"1.0.0","id":"l' || label || '","geometry":{{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}},"bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"properties":{{"datetime":null,"start_datetime":"' || {_Z.format('a')} || '","end_datetime":"' || {_Z.format('b')} || '","label":' || label || '}},"links":[],"assets":{{"data":{{"href":"/data/' || label || '.parquet"}}}}}}' AS item FROM ({_BOX})""")
def _(spark, sf):
    v = F.col("vec_id")
    t = F.timestamp_add("HOUR", (v % 1000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    boxes = G.extent(table(spark, sf, "embeddings").select("label", (v % 360 - 180).alias("x"), (v % 17).alias("y"), t.alias("t")), ["label"], "x", "y", "t")
    assets = F.struct(F.struct(F.concat(F.lit("/data/"), F.col("label").cast("string"), F.lit(".parquet")).alias("href")).alias("data"))
    return boxes.select("label", G.item(F.concat(F.lit("l"), F.col("label").cast("string")), F.col("bbox"), F.col("first"), F.col("last"), {"label": F.col("label")}, assets).alias("item"))


@query("cf_column_metadata", """SELECT t.*, n, lowest, highest FROM (VALUES ('value', '_FillValue', '-9999.0'), ('value', 'complevel', '4'), ('value', 'units', '"m s-1"'), ('value', 'zlib', 'true'), ('event_id', 'units', '"1"')) t("column", attribute, value),
 LATERAL (SELECT CASE WHEN t."column" = 'value' THEN count(value) ELSE count(event_id) END AS n, CASE WHEN t."column" = 'value' THEN min(value) ELSE min(event_id) END AS lowest, CASE WHEN t."column" = 'value' THEN max(value) ELSE max(event_id) END AS highest FROM events)""")
def _(spark, sf):
    df = O.cf_metadata(table(spark, sf, "events").select("event_id", "value"), {"value": {"units": "m s-1", "_FillValue": -9999.0, "zlib": True, "complevel": 4}, "event_id": {"units": "1"}})
    return O.metadata_table(df).join(F.broadcast(O.column_ranges(df)), "column")


@query("fixed_data_cross", "SELECT vec_id, label, f.n AS total FROM embeddings, (SELECT count(*) AS n FROM region) f")
def _(spark, sf):
    fixed = table(spark, sf, "region").agg(F.count(F.lit(1)).alias("total"))
    return O.with_fixed(table(spark, sf, "embeddings").select("vec_id", "label"), fixed)


@C.columns.register("first_cell", overwrite=True)
def _first_cell() -> Column:
    return F.element_at("embedding", 1).cast("double")


@query("project_dynamic_keys", "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS first_cell FROM embeddings")
def _(spark, sf):
    return O.project(table(spark, sf, "embeddings"), ["label", "first_cell"], ("vec_id",))


@query("limit_samples", "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100")
def _(spark, sf):
    return O.first_samples(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 100)


_TIMES = "strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id % 1000 AS INTEGER)), '%Y%m%d%H')"


def output_samples(spark, sf) -> DataFrame:
    """Two channels of every embedding as model output, with variable, path and values."""
    e = table(spark, sf, "embeddings")
    t = F.timestamp_add("HOUR", (F.col("vec_id") % 1000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    samples = e.select("vec_id", t.alias("ts"), (F.col("vec_id") % 7).alias("h0"), (F.col("vec_id") % 5).alias("w0"), (F.col("vec_id") % 2).alias("use_upscale"), F.array(*[N.channel(F.col("embedding"), F.lit(c), 32) for c in (0, 1)]).alias("channels"))
    return O.output_manifest(samples, "ts", "channels", ["HRDPS_P_TT_10000", "HRDPS_P_PR_SFC"])


@query("model_output_manifest", f"""SELECT vec_id, c AS channel, variable, variable || '/' || {_TIMES} || '_' || vec_id % 7 || '_' || vec_id % 5 || CASE WHEN vec_id % 2 = 1 THEN '_hrdps_upscale' ELSE '' END || '.nc' AS path,
 round(CASE WHEN c = 1 THEN exp(ln(1e-8) + (y + 1) * (ln(0.001 + 1e-8) - ln(1e-8)) / 2) - 1e-8 ELSE -40 + (y + 1) * 40 END, 6) AS head
 FROM (SELECT vec_id, CAST(c AS INTEGER) AS c, CASE WHEN c = 0 THEN 'HRDPS_P_TT_10000' ELSE 'HRDPS_P_PR_SFC' END AS variable, CAST(embedding[c * 32 + 1] AS DOUBLE) AS y FROM embeddings, range(0, 2) t(c))""")
def _(spark, sf):
    m = output_samples(spark, sf)
    return m.select("vec_id", "channel", "variable", "path", r6(F.element_at("values", 1)).alias("head"))


@query("scan_sample_batch", "SELECT vec_id, label, len(embedding) AS cells FROM embeddings WHERE vec_id BETWEEN 16 AND 31")
def _(spark, sf):
    path, v = new_path(spark, "embeddings"), F.col("vec_id")
    O.save_batches(table(spark, sf, "embeddings").select(F.lit("train").alias("split"), B.batch_of(v, 16).alias("batch_id"), (v % 16).alias("pos"), "vec_id", "label", "embedding"), path)
    return O.scan_batch(spark, path, "train", 1, ["vec_id", "label", "embedding"]).select("vec_id", "label", F.size("embedding").cast("long").alias("cells"))


@query("save_batches", "SELECT vec_id % 64 AS pos, label FROM embeddings WHERE vec_id // 64 = 2 AND vec_id % 64 < 10")
def _(spark, sf):
    path = new_path(spark, "batches")
    v = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(F.lit("train").alias("split"), B.batch_of(v, 64).alias("batch_id"), (v % 64).alias("pos"), "label", "embedding")
    O.save_batches(rows, path)
    return O.load_batch(spark, path, "train", 2, 0, 10, ["label"])


@query("read_through_cache", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    folder = new_path(spark, "cache")
    return O.read_through(spark, folder, "b5e241cc", lambda: table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("parameter_count", "SELECT network, sum(parameters) AS parameters, sum(trainable) AS trainable FROM (SELECT unnest(['train_b5e241cc_' || lpad(CAST(b AS VARCHAR), 8, '0') || '.nc', 'total']) AS network, 65 * n AS parameters, 64 * n AS trainable FROM (SELECT vec_id // 64 AS b, count(*) AS n FROM embeddings GROUP BY 1)) GROUP BY 1")
def _(spark, sf):
    """Arrays of archives as layers, of which the ids aren't trained; the networks' own layouts are counted in tests."""
    heads = A.read_archives(spark, archived(spark, sf, "nc"), headers=True)
    return K.parameter_counts(heads.select(F.col("file").alias("network"), F.col("key").alias("name"), "shape", (F.col("key") != "vec_id").alias("trainable")))


# --- archives and runs ------------------------------------------------------------------------------------------------


def archived(spark, sf, suffix: str, size: int = 64) -> str:
    """Embeddings as grids of 8 by 8 in archives of ``size`` samples."""
    path, v = new_path(spark, "archives"), F.col("vec_id")
    name = A.archive_name(F.lit("train"), F.lit("b5e241cc"), B.batch_of(v, size), suffix)
    rows = table(spark, sf, "embeddings").where("embedding is not null").select(name.alias("file"), (v % size).alias("pos"), "vec_id", F.col("embedding").alias("grid"))
    A.write_archives(rows.withMetadata("grid", {"units": "m s-1", "_FillValue": -9999.0}), path, {"grid": [8, 8]})
    return path


_GRID = "SELECT vec_id // 64 AS batch_id, vec_id % 64 AS pos, vec_id, CAST(embedding[1] AS DOUBLE) AS head, CAST(list_max(embedding) AS DOUBLE) AS highest, CAST(list_min(embedding) AS DOUBLE) AS lowest FROM embeddings"


def grid_rows(df: DataFrame) -> DataFrame:
    cell = lambda c: c.cast("double")
    return df.select("batch_id", "pos", "vec_id", cell(F.element_at("grid", 1)).alias("head"), cell(F.array_max("grid")).alias("highest"), cell(F.array_min("grid")).alias("lowest"))


@query("archive_netcdf", _GRID)
def _(spark, sf):
    return grid_rows(A.read_archives(spark, archived(spark, sf, "nc")))


@query("archive_numpy", _GRID)
def _(spark, sf):
    return grid_rows(A.read_archives(spark, archived(spark, sf, "npz")))


@query("archive_slice", f"SELECT * FROM ({_GRID}) WHERE batch_id IN (1, 4) AND pos >= 5 AND pos < 9")
def _(spark, sf):
    return grid_rows(A.read_archives(spark, archived(spark, sf, "nc"), ["vec_id", "grid"], split="train", batch_id=[1, 4], first=5, end=9))


@query("archive_headers", "SELECT 'train_b5e241cc_' || lpad(CAST(b AS VARCHAR), 8, '0') || '.nc' AS file, key, kind, CASE WHEN key = 'grid' THEN n || ',8,8' ELSE CAST(n AS VARCHAR) END AS shape, CASE WHEN key = 'grid' THEN 'm s-1' END AS units, CASE WHEN key = 'grid' THEN '-9999.0' END AS fill FROM (SELECT vec_id // 64 AS b, count(*) AS n FROM embeddings GROUP BY 1), (VALUES ('vec_id', 'i8'), ('grid', 'f4')) t(key, kind)")
def _(spark, sf):
    heads = A.read_archives(spark, archived(spark, sf, "nc"), headers=True)
    return heads.select("file", "key", "kind", F.array_join("shape", ",").alias("shape"), F.col("attributes")["units"].alias("units"), F.col("attributes")["_FillValue"].alias("fill"))


@query("archive_manifest", "SELECT 'train_b5e241cc_' || lpad(CAST(vec_id // 64 AS VARCHAR), 8, '0') || '.npz' AS file, count(*) AS samples FROM embeddings GROUP BY 1")
def _(spark, sf):
    return A.manifest(spark, archived(spark, sf, "npz")).select("file", "samples")


_OUT = """SELECT path AS file, row_number() OVER (PARTITION BY path ORDER BY vec_id) - 1 AS pos, vec_id, head FROM (SELECT vec_id, variable || '/' || {t} || '_' || vec_id % 7 || '_' || vec_id % 5 || CASE WHEN vec_id % 2 = 1 THEN '_hrdps_upscale' ELSE '' END || '.nc' AS path,
 round(CASE WHEN c = 1 THEN exp(ln(1e-8) + (y + 1) * (ln(0.001 + 1e-8) - ln(1e-8)) / 2) - 1e-8 ELSE -40 + (y + 1) * 40 END, 6) AS head
 FROM (SELECT vec_id, c, CASE WHEN c = 0 THEN 'HRDPS_P_TT_10000' ELSE 'HRDPS_P_PR_SFC' END AS variable, CAST(embedding[c * 32 + 1] AS DOUBLE) AS y FROM embeddings, range(0, 2) t(c)))"""


@query("model_outputs_written", _OUT.replace("{t}", _TIMES))
def _(spark, sf):
    path = new_path(spark, "outputs")
    O.write_output_files(output_samples(spark, sf), path, "vec_id", {"values": [4, 8]})
    return A.read_archives(spark, path).select("file", "pos", "vec_id", r6(F.element_at("values", 1)).alias("head"))


@query("epoch_permutation", f"SELECT event_id, position FROM {E.permuted_sql('SELECT event_id AS item, count(*) OVER () AS n FROM events', 'n', 42, 3)} JOIN (SELECT event_id FROM events) ON event_id = item")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return e.crossJoin(F.broadcast(n)).select("event_id", E.permuted(F.col("event_id"), F.col("n"), 42, 3).alias("position"))


@query("epoch_batches", f"SELECT position // 32 AS batch, count(*) AS n, min(item) AS least, max(item) AS greatest FROM {E.permuted_sql('SELECT event_id AS item, count(*) OVER () AS n FROM events', 'n', 42, 4)} GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    placed = e.crossJoin(F.broadcast(n)).select("event_id", E.permuted(F.col("event_id"), F.col("n"), 42, 4).alias("position"))
    return placed.groupBy(B.batch_of(F.col("position"), 32).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("greatest"))


@query("compact_resumed", ORACLE_SQL["compact_bounded"])
def _(spark, sf):
    folder, events = new_path(spark, "states"), counted_events(spark, sf)
    # three runs, cut at different places of the series
    for cut in (F.col("t") < 3 + F.col("user_id") % 5, (F.col("t") >= 3 + F.col("user_id") % 5) & (F.col("t") < F.floor(F.col("n") / 2) + 9), (F.col("t") >= 3 + F.col("user_id") % 5) & (F.col("t") >= F.floor(F.col("n") / 2) + 9)):
        Y.append(events.where(cut), folder, "user_id", ["t"], "t", "value", 15)
    return bucketed(R.buckets(Y.load(spark, folder), "user_id"))


@query("resumable_pass", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY 1")
def _(spark, sf):
    orders, folder = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), new_path(spark, "pass")
    # stopped after three chunks and started again
    for most in (3, None):
        run = W.Pass(spark, folder, orders, "o_orderkey", lambda items: items, chunks=4)
        run.run(most)
    return run.results().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))


# --- windows of grids and of the year ---------------------------------------------------------------------------------

_SAMPLES = "SELECT o_orderkey, o_orderkey % 8 AS grid, o_custkey % 70 - 3 AS y, o_orderkey * 7 % 66 AS x, 1 + o_orderkey % 15 AS h, 1 + o_custkey % 19 AS w FROM orders"
_CELLS = "SELECT vec_id // 64 AS grid, vec_id % 64 // 8 * 8 + i // 8 AS cy, vec_id % 8 * 8 + i % 8 AS cx, CASE WHEN embedding[i + 1] > 0 THEN 1.0 ELSE 0.0 END AS v FROM embeddings, range(0, 64) t(i)"


@query("window_unmasked", f"SELECT o_orderkey, coalesce(sum(v), 0.0)::DOUBLE AS unmasked, round(coalesce(sum(v), 0.0) / any_value(h * w), 6)::DOUBLE AS share FROM ({_SAMPLES}) s LEFT JOIN ({_CELLS}) c ON c.grid = s.grid AND cy >= y AND cy < y + h AND cx >= x AND cx < x + w GROUP BY o_orderkey")
def _(spark, sf):
    v, o = F.col("vec_id"), F.col("o_orderkey")
    cells = F.transform("embedding", lambda c: F.when(c > 0, 1.0).otherwise(0.0))
    tiles = table(spark, sf, "embeddings").select(F.floor(v / 64).alias("grid"), F.floor(v % 64 / 8).alias("ty"), (v % 8).alias("tx"), cells.alias("cells"))
    samples = table(spark, sf, "orders").select("o_orderkey", (o % 8).alias("grid"), (F.col("o_custkey") % 70 - 3).alias("y"), (o * 7 % 66).alias("x"), (1 + o % 15).alias("h"), (1 + F.col("o_custkey") % 19).alias("w"))
    found = Z.window_sums(samples, Z.summed(tiles, 8, 8), 8, 8, "o_orderkey")
    return found.join(samples, "o_orderkey").select("o_orderkey", F.col("total").alias("unmasked"), r6(F.col("total") / (F.col("h") * F.col("w"))).alias("share"))


_DAY = "dayofyear(make_date(2024, month({0}), day({0})))"
_DAILY = f"SELECT o_orderpriority AS p, {_DAY.format('o_orderdate')} AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS s, count(*) AS n FROM orders GROUP BY ALL"
_MEANS = f"SELECT a.p, a.day, CAST(sum(CAST(b.s AS DECIMAL(30,2))) AS DOUBLE) / sum(b.n) AS mean, CAST(sum(b.n) AS BIGINT) AS n FROM (SELECT DISTINCT p, d.day FROM ({_DAILY}), range(1, 367) d(day)) a LEFT JOIN ({_DAILY}) b ON a.p = b.p AND least(abs(a.day - b.day), 366 - abs(a.day - b.day)) <= 15 GROUP BY ALL"


@query("circular_climatology", f"SELECT p AS o_orderpriority, day, mean, coalesce(n, 0) AS n FROM ({_MEANS})")
def _(spark, sf):
    means = D.climatology(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", 15, 2)
    return means.select("o_orderpriority", F.col("day").cast("long").alias("day"), "mean", F.col("count").alias("n"))


@query("climatology_anomaly", f"SELECT o_orderkey, o_totalprice - mean AS anomaly FROM orders JOIN ({_MEANS}) m ON m.p = o_orderpriority AND m.day = {_DAY.format('o_orderdate')}")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    means = D.climatology(o, ["o_orderpriority"], "o_orderdate", "o_totalprice", 15, 2)
    return D.anomalies(o, means, ["o_orderpriority"], "o_orderdate", "o_totalprice").select("o_orderkey", "anomaly")


# --- the same rules called from SQL -----------------------------------------------------------------------------------


def sql_query(name: str, text: str, oracle: str) -> None:
    """A query written in SQL over the library's functions; ``{table}`` stands for a table's Parquet."""

    def run(spark, sf):
        J.register(spark)
        return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf}/{m[1]}.parquet`", text))

    query(name, oracle)(run)


sql_query("sql_normalize", "SELECT event_id, round(sky_normalize(value, 0D, 500D), 6) AS y, round(sky_denormalize(sky_normalize(value, 0D, 500D), 0D, 500D), 6) AS x FROM {events}", "SELECT event_id, round(-1 + value * 2 / 500, 6) AS y, round(value, 6) AS x FROM events")
sql_query("sql_normalize_log", "SELECT event_id, round(sky_normalize_log(value, 0D, 1000D, 1D), 6) AS y, round(sky_denormalize_log(sky_normalize_log(value, 0D, 1000D, 1D), 0D, 1000D, 1D), 6) AS x FROM {events}", "SELECT event_id, round(-1 + 2 * ln(value + 1) / ln(1001), 6) AS y, round(value, 6) AS x FROM events")
sql_query("sql_readable_value", "SELECT event_id, sky_readable_value(value) AS shown FROM {events}", f"SELECT event_id, {_VALUE.format(hi='1e38')} AS shown FROM (SELECT event_id, value AS v FROM events)")
sql_query("sql_readable_duration", "SELECT event_id, sky_readable_duration(value * value * 7 + 0.003D) AS shown FROM {events}", ORACLE_SQL["readable_delta_t"])
sql_query("sql_readable_bytes", "SELECT o_orderkey, sky_readable_bytes(o_orderkey * o_orderkey * 1000) AS shown FROM {orders}", ORACLE_SQL["readable_memory"])
sql_query("sql_digest", "SELECT n_nationkey, sky_hex_digest(n_name) AS digest FROM {nation}", ORACLE_SQL["hex_digest"])
sql_query("sql_batch_path", "SELECT o_orderkey, sky_batch_path('train', sky_hex_digest(\"('train', 'input1', 'output1', 16)\"), sky_batch_of(o_orderkey, 16)) AS path FROM {orders}", ORACLE_SQL["batch_path"])
sql_query("sql_compact", "SELECT user_id, bucket, (min(i) + max(i)) / 2D AS time, CASE WHEN count(*) > 1 THEN min(i) END AS lo, CASE WHEN count(*) > 1 THEN max(i) END AS hi, count(*) AS cnt, round(avg(value), 9) AS value FROM (SELECT *, sky_bucket_of(i, n) AS bucket FROM (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {events})) GROUP BY user_id, bucket", ORACLE_SQL["compact_bounded"])
sql_query("sql_calendar", "SELECT sky_calendar_day(o_orderdate) AS day, count(*) AS n FROM {orders} GROUP BY 1", f"SELECT {_DAY.format('o_orderdate')} AS day, count(*) AS n FROM orders GROUP BY 1")
sql_query("sql_periods", "SELECT event_id, sky_period_start(p) AS first, sky_period_end(p) AS last FROM (SELECT event_id, concat(sky_compact_hour(ts), '_', sky_compact_hour(timestampadd(HOUR, user_id, ts))) AS p FROM {events})", ORACLE_SQL["decode_period"])
sql_query("sql_levels", "SELECT event_id, name, sky_level_dimension(name, level) AS dimension FROM (SELECT event_id, concat(event_type, CASE user_id % 4 WHEN 0 THEN '_model_levels' WHEN 1 THEN '_pressure_levels' WHEN 2 THEN concat('_', user_id * 50) ELSE '' END) AS name, CASE WHEN value > 30 THEN floor(value) END AS level FROM {events})", ORACLE_SQL["infer_dimensions"])
sql_query("sql_split_period", "SELECT user_id, p.period, p.first_at AS first, p.last_at AS last FROM (SELECT user_id, CAST(date_trunc('hour', min(ts)) AS TIMESTAMP_NTZ) AS a, CAST(date_trunc('hour', max(ts)) AS TIMESTAMP_NTZ) AS b FROM {events} GROUP BY user_id) s, LATERAL sky_split_period(s.a, s.b, 8, 6) p", ORACLE_SQL["split_period"])
sql_query("sql_batches", "SELECT b.batch, b.first_idx, b.end_idx FROM (SELECT count(*) AS n FROM {orders}) s, LATERAL sky_batches(s.n, 128) b", "SELECT k AS batch, k * 128 AS first_idx, least(n, k * 128 + 128) AS end_idx FROM (SELECT n, unnest(range(0, (n + 127) // 128)) AS k FROM (SELECT count(*) AS n FROM orders))")
