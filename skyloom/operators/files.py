"""Manifests, logs, listings, retention and checkpoints as tables of lines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.splits import batch_of, global_rank, rank_within


def lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """file, line_no (from 0) and line; only the ends of lines are taken off."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", "[\\r\\n]+$", ""))


def merge_manifests(all_lines: DataFrame) -> DataFrame:
    """Ordered union of lines: blank ones go, of equal ones the first (by file and line) stays."""
    kept = all_lines.where("line <> ''")
    return kept.groupBy("line").agg(F.min(F.struct("file", "line_no")).alias("at")).select("at.file", "at.line_no", "line")


def matches(line: Column, patterns: list[str] | None) -> Column:
    """Whether a line holds any of the patterns as it stands; no list lets all pass, an empty one none."""
    if patterns is None:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | line.contains(p)
    return out


def filter_logs(all_lines: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Matching lines with their place in the merged log, where a header line precedes each contributing file.

    ``position`` counts from 0 within a file: 0 is the header, and a blank line precedes it in the merged text
    for all files but the first.
    """
    kept = all_lines.where(matches(F.col("line"), patterns))
    w = Window.partitionBy("file").orderBy("line_no")
    body = kept.select("file", F.row_number().over(w).cast("long").alias("position"), "line")
    header = kept.select("file").distinct().select("file", F.lit(0).cast("long").alias("position"), F.concat(F.lit("--- "), F.col("file").cast("string"), F.lit(" ---")).alias("line"))
    return header.unionByName(body)


def without_match(all_lines: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Files that contribute no line: candidates for deletion."""
    return all_lines.select("file").distinct().join(all_lines.where(matches(F.col("line"), patterns)).select("file"), "file", "left_anti")


def excluding(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(excluded.select(*keys), keys, "left_anti")


def retention_plan(files: DataFrame, path: str, mtime: str, now: Column, older_than: Column | None = None, keep: int | None = None, both: bool = False, compat: bool = False, scope: str | None = None) -> DataFrame:
    """Files to delete by age, by number of newer ones, by either or by both; nothing is deleted here.

    With ``compat``, "both" falls back to the number if no file is old enough, and to the age if few files are there.
    """
    old = F.col(mtime) < now - older_than if older_than is not None else F.lit(False)
    keys = [scope] if scope else []
    ranked = rank_within(files, keys, [mtime, path], "_i", "_n")
    surplus = F.col("_n") - F.col("_i") > keep if keep is not None else F.lit(False)
    flagged = ranked.withColumn("_old", F.coalesce(old, F.lit(False))).withColumn("_surplus", surplus)
    if both and older_than is not None and keep is not None:
        rule = F.col("_old") & F.col("_surplus")
        if compat:
            some = flagged.groupBy(*[F.col(k).alias("_scope") for k in keys]).agg(F.max("_old").alias("_any_old"), F.max("_surplus").alias("_many"))
            flagged = flagged.join(some, flagged[scope].eqNullSafe(some["_scope"])) if scope else flagged.crossJoin(F.broadcast(some))
            rule = F.when(~F.col("_many"), F.col("_old")).when(~F.col("_any_old"), F.col("_surplus")).otherwise(rule)
    else:
        rule = F.col("_old") | F.col("_surplus")
    return flagged.where(rule).select(*files.columns)


def batches_of_paths(files: DataFrame, path: str, size: int, prefix: str = "batch") -> DataFrame:
    """batch, manifest name and paths, by the paths' order."""
    from skyloom.functions.text import zero_filled

    numbered = global_rank(files.select(path), [path]).withColumn("batch", batch_of(F.col("idx"), size))
    listed = numbered.groupBy("batch").agg(F.sort_array(F.collect_list(path)).alias("paths"))
    return listed.select("batch", F.concat(F.lit(f"{prefix}_"), zero_filled(F.col("batch")), F.lit(".txt")).alias("manifest"), "paths")


def newest(files: DataFrame, group: str, path: str, mtime: str) -> DataFrame:
    """Newest file of each group; of equal times the greatest path."""
    best = F.max(F.struct(F.col(mtime).alias("t"), F.col(path).alias("p")))
    return files.groupBy(group).agg(best.alias("b")).select(group, F.col("b.p").alias(path), F.col("b.t").alias(mtime))


def latest_save(files: DataFrame, saves: DataFrame, experiment: str | None, folder: str) -> DataFrame:
    """network and path of every network saved together with the newest checkpoint file of an experiment.

    ``files`` has path and mtime; ``saves`` has save_id, network and path as they were when saved. The newest file is found
    by name among the saves; paths get ``folder``, since files may have moved. A file that no save names stands alone under
    the empty network.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    found = files.where(F.lit(True) if experiment is None else name(F.col("path")).contains(experiment))
    # one row
    newest_file = found.agg(F.max(F.struct("mtime", "path")).alias("b")).where("b is not null").select(name(F.col("b.path")).alias("_file"))
    own = saves.join(F.broadcast(newest_file), name(saves["path"]) == F.col("_file")).agg(F.max("save_id").alias("_save"))
    together = saves.join(F.broadcast(own.where("_save is not null")), saves["save_id"] == F.col("_save")).select("network", name(saves["path"]).alias("_name"))
    alone = newest_file.crossJoin(F.broadcast(own)).where("_save is null").select(F.lit("").alias("network"), F.col("_file").alias("_name"))
    return together.unionByName(alone).select("network", F.concat(F.lit(folder.rstrip("/") + "/"), "_name").alias("path"))


def last_saved(saves: DataFrame) -> DataFrame:
    """The last saved path of each network, and its number of saves; networks without a path are left out."""
    kept = saves.where(F.col("path").isNotNull())
    return kept.groupBy("network").agg(F.max_by("path", "save_id").alias("last_path"), F.count(F.lit(1)).alias("saves"))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).count().where("count > 1").withColumnRenamed("count", "times")


def override(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Right-wins merge of key/value tables; a null change keeps the base value."""
    new = changes.select(key, F.col(value).alias("_new"))
    return base.join(new, key, "full").select(key, F.coalesce("_new", value).alias(value))


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Later files win by key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
