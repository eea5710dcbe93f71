"""Catalogue of physical variables with aliases, as dimension tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = (
    "name units file_key cf_units level level_units min_value max_value mean_min mean_max clip_min clip_max nan_min nan_max cumulative log_normalize normalize_min normalize_max log_offset"
).split()
_TEXT, _FLAG = {"name", "units", "file_key", "cf_units", "level_units"}, {"cumulative", "log_normalize"}
SCHEMA = T.StructType([T.StructField(f, T.StringType() if f in _TEXT else T.BooleanType() if f in _FLAG else T.DoubleType()) for f in FIELDS])
CELSIUS = "°C"
LEVELS = (850, 700, 500, 250)

# Name, units, CF units, valid range, range of means, normal range, and what else is set.
_BASE = [
    ("HU", "1", "1", (-0.1, 0.1), (0.0, 0.01), (0.0, 0.02), {"clip_min": 0.0}),
    ("PC", "m", "kg m-2 s-1", (-1e-7, 1.0), (0.0, 0.1), (0.0, 0.001), {"clip_min": 0.0, "cumulative": True, "log_normalize": True, "log_offset": 1e-8}),
    ("PR", "m", "kg m-2 s-1", (-1e-7, 5.0), (0.0, 0.1), (0.0, 0.001), {"clip_min": 0.0, "cumulative": True, "log_normalize": True, "log_offset": 1e-8}),
    ("PN", "mb", "Pa", (900.0, 1100.0), (950.0, 1050.0), (900.0, 1100.0), {}),
    ("TD", CELSIUS, "K", (-100.0, 100.0), (-20.0, 20.0), (-40.0, 40.0), {}),
    ("TT_model_levels", CELSIUS, "K", (-100.0, 100.0), (-20.0, 20.0), (-40.0, 40.0), {}),
    ("UU_model_levels", "kts", "m s-1", (-100.0, 100.0), (-10.0, 10.0), (-100.0, 100.0), {}),
    ("VV_model_levels", "kts", "m s-1", (-100.0, 100.0), (-10.0, 10.0), (-100.0, 100.0), {}),
    ("GZ", "dam", None, (50.0, 1500.0), (250.0, 1000.0), (50.0, 1500.0), {}),
    ("P_TT_10000", CELSIUS, "K", (-90.0, 90.0), (-20.0, 20.0), (-40.0, 40.0), {"file_key": "HRDPS_P_TT_10000", "nan_max": 8e36}),
    ("P_PR_SFC", "m", "kg m-2 s-1", (0.0, 5.0), (0.0, 0.01), (0.0, 0.001), {"file_key": "HRDPS_P_PR_SFC", "nan_max": 8e36, "cumulative": True, "log_normalize": True, "log_offset": 1e-8}),
    ("P_UUC_10000", "kts", "m s-1", (-120.0, 120.0), (-10.0, 10.0), (-100.0, 100.0), {"file_key": "HRDPS_P_UUC_10000", "nan_max": 8e36}),
    ("P_VVC_10000", "kts", "m s-1", (-120.0, 120.0), (-10.0, 10.0), (-100.0, 100.0), {"file_key": "HRDPS_P_VVC_10000", "nan_max": 8e36}),
    ("MF", "m", "m", (-6.0, 5600.0), (-6.0, 5600.0), (-6.0, 5600.0), {}),
    ("sftlf", "1", "1", (0.0, 1.0), (0.0, 1.0), (0.0, 1.0), {"file_key": "HRDPS_sftlf"}),
]
# Variables derived from others, with what differs. A range is (least, greatest).
_DERIVED = [
    ("PN_anomaly", "PN", {"valid": (-80.0, 80.0), "normal": (-50.0, 50.0)}),
    ("TD_anomaly", "TD", {"valid": (-40.0, 40.0), "normal": (-40.0, 40.0)}),
    ("TT_model_levels_anomaly", "TT_model_levels", {"normal": (-20.0, 20.0)}),
    ("TT_pressure_levels", "TT_model_levels", {"file_key": "TT_pressure_levels", "mean": (-30.0, -5.0)}),
    ("UU_model_levels_anomaly", "UU_model_levels", {}),
    ("UU_pressure_levels", "UU_model_levels", {"file_key": "UU_pressure_levels", "valid": (-300.0, 300.0), "mean": (-30.0, 30.0)}),
    ("VV_model_levels_anomaly", "VV_model_levels", {}),
    ("VV_pressure_levels", "VV_model_levels", {"file_key": "VV_pressure_levels", "valid": (-300.0, 300.0), "mean": (-20.0, 20.0)}),
    ("P_TT_10000_anomaly", "P_TT_10000", {"normal": (-10.0, 10.0)}),
]
# Families on pressure levels: prefix, parent, and the anomalies' ranges (None: no anomalies).
_FAMILIES = [
    ("HU", "HU", None),
    ("TT", "TT_pressure_levels", {"normal": (-20.0, 20.0)}),
    ("UU", "UU_pressure_levels", {"normal": (-40.0, 40.0)}),
    ("VV", "VV_pressure_levels", {"normal": (-40.0, 40.0)}),
    ("GZ", "GZ", {"valid": (-70.0, 70.0), "normal": (-30.0, 30.0)}),
]
# What single levels have of their own.
_LEVEL_RANGES = {
    "TT850": {"mean": (-25.0, 15.0)}, "TT700": {"mean": (-30.0, 10.0)}, "TT500": {"mean": (-35.0, 5.0)}, "TT250": {"mean": (-60.0, -20.0)}, "UU250": {"mean": (-30.0, 40.0)},
    "GZ850": {"valid": (50.0, 500.0), "mean": (50.0, 250.0)}, "GZ700": {"valid": (100.0, 1000.0), "mean": (200.0, 400.0)}, "GZ500": {"valid": (200.0, 1000.0), "mean": (450.0, 650.0)}, "GZ250": {"valid": (500.0, 1500.0), "mean": (900.0, 1300.0)},
}
#: Alternative names of fine-grid variables.
ALIASES = {f"HRDPS_{n}": n for n in ("P_TT_10000", "P_TT_10000_anomaly", "P_PR_SFC", "P_UUC_10000", "P_VVC_10000")}
#: Ours: factors and offsets from the labelled units to CF units (value * factor + offset).
UNIT_FACTORS = [(CELSIUS, "K", 1.0, 273.15), ("kts", "m s-1", 0.5144444444444445, 0.0), ("mb", "Pa", 100.0, 0.0), ("m", "kg m-2 s-1", 1000.0 / 3600.0, 0.0), ("m", "m", 1.0, 0.0), ("1", "1", 1.0, 0.0)]


def _apply(row: dict, changes: dict) -> dict:
    pairs = {"valid": ("min_value", "max_value"), "mean": ("mean_min", "mean_max"), "normal": ("normalize_min", "normalize_max")}
    for key, value in changes.items():
        row.update(zip(pairs[key], value, strict=True) if key in pairs else [(key, value)])
    return row


def variable_rows() -> list[dict]:
    """All variables as dictionaries, built from base variables, derivations and level families."""
    rows: dict[str, dict] = {}
    for name, units, cf, valid, mean, normal, more in _BASE:
        row = dict.fromkeys(FIELDS) | {"name": name, "units": units, "file_key": name, "cf_units": cf, "cumulative": False, "log_normalize": False}
        rows[name] = _apply(row, {"valid": valid, "mean": mean, "normal": normal} | more)
    for name, parent, changes in _DERIVED:
        rows[name] = _apply(rows[parent] | {"name": name}, changes)
    for prefix, parent, anomaly in _FAMILIES:
        for level in LEVELS:
            at = {"level": float(level), "level_units": "hPa"}
            name = f"{prefix}{level}"
            rows[name] = _apply(rows[parent] | at | {"name": name}, _LEVEL_RANGES.get(name, {}))
            if anomaly is not None:
                rows[f"{name}_anomaly"] = _apply(rows[parent] | at | {"name": f"{name}_anomaly"}, anomaly)
    return list(rows.values())


def variables(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, a row a variable; small and fixed, so it is safe to broadcast."""
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in variable_rows()], SCHEMA).coalesce(1)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, name string").coalesce(1)


def unit_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIT_FACTORS, "units string, cf_units string, factor double, offset double").coalesce(1)


def with_variable(df: DataFrame, column: str, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """Join the catalogue by name, the exact name first and then the alias; unknown names get nulls, in ``canonical`` too."""
    spark = df.sparkSession
    named = aliases(spark).select(F.col("alias").alias("_alias"), F.col("name").alias("_by_alias"))
    exact = variables(spark).select(F.col("name").alias("_exact"))
    keyed = df.join(F.broadcast(exact), F.col(column) == F.col("_exact"), "left").join(F.broadcast(named), F.col(column) == F.col("_alias"), "left")
    keyed = keyed.withColumn("canonical", F.coalesce("_exact", "_by_alias")).drop("_exact", "_alias", "_by_alias")
    rows = variables(spark).select(F.col("name").alias("_name"), *[f for f in fields if f != "name"])
    return keyed.join(F.broadcast(rows), F.col("canonical") == F.col("_name"), "left").drop("_name")


def has_thresholds(kind: str):
    """Whether either bound of a kind (mean, clip, nan) is set."""
    return F.coalesce(F.col(f"{kind}_min"), F.col(f"{kind}_max")).isNotNull()


def level_dimension(name: Column, level: Column) -> Column:
    """The level dimension of a variable: by its name, else its level, else three or more digits that end its name; null without any."""
    suffix = F.regexp_extract(name, "_([0-9]{3,})$", 1)
    return F.when(name.contains("model_levels"), "model_level").when(name.contains("pressure_levels"), "pressure_level").when(level.isNotNull(), level.cast("long").cast("string")).when(suffix != "", suffix)


def sql_values(rows: list[tuple], names: list[str]) -> str:
    """A VALUES list for the SQL side of a comparison."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def variables_sql() -> str:
    return "(SELECT * FROM " + sql_values([tuple(r[f] for f in FIELDS) for r in variable_rows()], FIELDS) + ")"


class Registry:
    """Names of builders: columns (name -> Column) or datasets (name -> DataFrame). A name can be taken once unless overwritten."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, overwrite: bool = False) -> Callable:
        def keep(builder: Callable) -> Callable:
            if name in self.entries and not overwrite:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.entries[name] = builder
            return builder

        return keep

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def build(self, name: str, *args, **kwargs):
        if name not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; known: {sorted(self.entries)}")
        return self.entries[name](*args, **kwargs)


#: Hooks: column builders by key, what a dataset's digest is made of, side inputs, named datasets, configuration types.
columns = Registry("column")
digests = Registry("digest")
side_inputs = Registry("side input")
datasets = Registry("dataset")
configs = Registry("configuration type")
