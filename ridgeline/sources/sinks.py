"""Sinks: keyed tables, resumable appends, overlays, run logs. A former version is never written over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing path
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def new_rows(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not done yet, one per key: of several the least by its columns, whichever run it is."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(df.columns) if rest else df.distinct()
    return one.join(done.select(*keys), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Append what is new by key to a table and return the table; a run that stops can be repeated."""
    done = read_or_empty(df.sparkSession, path, df.schema)
    new_rows(df, done, *keys).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def done_keys(spark: SparkSession, path: str, schema, prefixes: list[int]) -> DataFrame:
    """Rows of a table written by append_pruned in some of its folders; no other folder is even listed."""
    if not prefixes:
        return spark.createDataFrame([], schema)
    folders = f"{path.rstrip('/')}/_prefix={{{','.join(map(str, prefixes))}}}"
    try:
        return spark.read.schema(schema).parquet(folders)
    except Exception as error:  # noqa: BLE001 - only where none of them is there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_pruned(df: DataFrame, path: str, *keys: str, prefixes: int = 256) -> DataFrame:
    """Append what is new by key to a table in folders by a hash of the key, and return the new rows as they were found.

    Only the folders that the rows fall into are read, so a small batch costs what its own folders hold.
    A table keeps the number of folders that it began with. A run that stops can be repeated.
    """
    prefix = F.pmod(F.xxhash64(*keys), F.lit(prefixes)).cast("int")
    rows = df.withColumn("_prefix", prefix)
    mine = sorted(r[0] for r in rows.select("_prefix").distinct().collect())  # no more than prefixes
    done = done_keys(df.sparkSession, path, df.schema, mine)
    new = new_rows(df, done, *keys).withColumn("_prefix", prefix)
    new.repartition("_prefix").write.mode("append").partitionBy("_prefix").parquet(path)
    return new.drop("_prefix")


def sorted_copy(spark: SparkSession, path: str, out: str, *order: str) -> DataFrame:
    """The finished table in key order, range-partitioned, as a table of its own."""
    rows = spark.read.parquet(path)
    rows.drop("_prefix").orderBy(*order).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def append_log(df: DataFrame, path: str) -> None:
    """Append entries to a run log, as JSON lines with the time of the run; fields may differ from those of earlier runs."""
    df.withColumn("run_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, error) of all files of a run log: entries as VARIANT, whatever their fields.

    A legacy file is one document: a list of entries, or an object that holds one as ``runs`` or
    ``entries``. What can't be read is a row with its first characters as error, and stops nothing.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    whole = files.select("file", "value", F.try_parse_json("value").alias("v"))
    held = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in ("runs", "entries")])
    legacy = whole.where(held.isNotNull()).select("file", F.explode(held).alias("entry"), F.lit(None).cast("string").alias("error"))
    lines = whole.where(held.isNull()).select("file", F.explode(F.split("value", r"\r?\n")).alias("line")).where(F.trim("line") != "")
    lines = lines.select("file", F.try_parse_json("line").alias("entry"), "line")
    good = F.schema_of_variant("entry").startswith("OBJECT")
    good = F.coalesce(good, F.lit(False))
    lines = lines.select("file", F.when(good, F.col("entry")).alias("entry"), F.when(~good, F.substring("line", 1, 80)).alias("error"))
    return legacy.unionByName(lines)


def log_fields(log: DataFrame, **fields: str) -> DataFrame:
    """Entries as columns: name=type, NULL where an entry lacks it or holds another type."""
    return log.where("error IS NULL").select("file", *[F.try_variant_get("entry", f"$.{n}", t).alias(n) for n, t in fields.items()])


def latest_entries(entries: DataFrame, *keys: str, at: str = "run_at") -> DataFrame:
    """Per key the entry of the last run; one without a time is older than all others."""
    rest = [c for c in entries.columns if c not in keys]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), F.col(at), F.struct(*rest))).alias("_r"))
    return last.select(*keys, "_r.*").select(entries.columns)


#: An evaluation's entry in its history.
HISTORY = {"step": "long", "tag": "string", "stage": "string", "composite": "double"}


def append_history(spark: SparkSession, path: str, step: int, tag: str, stage: str, composite: float | None) -> DataFrame:
    """Append an evaluation (step, tag, stage, composite) and return the history, to which best_runs() may be applied."""
    append_log(spark.createDataFrame([(step, tag, stage, composite)], ", ".join(f"{k} {v}" for k, v in HISTORY.items())), path)
    return log_fields(read_log(spark, path), **HISTORY, run_at="string").drop("file")


def write_with_stats(df: DataFrame, stats: DataFrame, path: str, apply: bool = True) -> DataFrame:
    """A table and its statistics under one path, and the statistics; a dry run (apply false) writes neither."""
    if apply:
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/rows")
        stats.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/stats")
    return stats


def write_scores(rows: DataFrame, summary: DataFrame, path: str, scene: str = "scene_id", frame: str = "frame_id", pred: str = "pred_xy") -> None:
    """Per-sample lines, the summary, and the official form of the results, as JSON lines each."""
    rows.write.mode("errorifexists").json(f"{path.rstrip('/')}/per_sample")
    summary.write.mode("errorifexists").json(f"{path.rstrip('/')}/summary")
    official(rows, scene, frame, pred).write.mode("errorifexists").json(f"{path.rstrip('/')}/results")


def official(rows: DataFrame, scene: str = "scene_id", frame: str = "frame_id", pred: str = "pred_xy") -> DataFrame:
    """(id, pred_xy) with ids as scene-frame."""
    return rows.select(F.concat_ws("-", scene, frame).alias("id"), F.col(pred).alias("pred_xy"))


def compact_answers(rows: DataFrame) -> DataFrame:
    """One short row per answer: what was said and how long, without what can be derived again. rows: answer, and any of the kept columns."""
    a = F.col("answer")
    kept = [c for c in ("scene_id", "frame_id", "frame_key", "task", "pred_xy", "motion_gt", "sample_class", "v0", "ade5", "n_new_tokens", "hit_cap", "prefix", "prompt_len", "text") if c in rows.columns]
    return rows.select(*kept, a["n_objects"].alias("n_objects"), F.size(a["objects"]).alias("emitted"), *[a[c].alias(c) for c in ("ego_state", "reason", "final_plan", "motion", "traj")])


def apply_overlay(df: DataFrame, overlay: DataFrame, key: str, base: str, columns: list[str]) -> DataFrame:
    """Patch columns from an overlay keyed by the full path or, failing that, by its last part."""
    o = overlay.select(F.col("key").alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = overlay.select(F.col("key").alias("_kb"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    rows = df.join(o, F.col(key) == F.col("_k"), "left").join(b, F.col(base) == F.col("_kb"), "left")
    patched = {c: F.coalesce(f"_o_{c}", f"_b_{c}", c) for c in columns}
    return rows.withColumns(patched).drop("_k", "_kb", *[f"_{s}_{c}" for s in "ob" for c in columns])


def changed_only(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of after that differ from before in one of the columns, or are new."""
    old = before.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    rows = after.join(old, F.col(key) == F.col("_k"), "left")
    return rows.where(F.col("_k").isNull() | ~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_k", "_old")


def versioned_write(df: DataFrame, root: str, version: str) -> str:
    """Write a table as a version of its own; earlier versions stay."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def predictions_out(df: DataFrame, pred: str, missing: str = "null", n: int = 20) -> DataFrame:
    """Predictions with missing ones as zeros or null."""
    zero = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), n)
    return df.withColumn(pred, F.coalesce(F.col(pred), zero)) if missing == "zeros" else df


def rated_index(df: DataFrame, rated: Column) -> DataFrame:
    """Rated frames as (scene_id, frame_id), ordered as texts."""
    return df.where(rated).select(F.col("scene_id").cast("string").alias("scene_id"), F.col("frame_id").cast("string").alias("frame_id")).orderBy("scene_id", "frame_id")


def rated_index_document(index: DataFrame) -> DataFrame:
    """One JSON document {count, frames} of a short index."""
    one = index.agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("scene_id", "frame_id"))).alias("frames"))
    return one.select(F.to_json(F.struct("count", "frames")).alias("value"))
