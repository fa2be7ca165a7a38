"""A usage log: records and partial updates are appended, and folded into one row per record bucket by bucket.

An append writes its own rows and nothing else. `current` reads the folded rows and what was appended since; `compact` folds that in,
and rewrites only the buckets that it touches. Which folders count is said by the newest file of `_state`, written when
everything else is complete, so a reader sees a whole state, and a batch that is appended twice counts once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import merged_updates
from .store import _file_system

#: Columns that hold lists, kept as JSON text (fixed values), and what a record can change.
LISTS = ("excluded_type_terms", "parsed_pmids")
BUCKETS = 64


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest state: the folder of each bucket, the appended folders not yet folded, and those already folded."""
    files, place = _file_system(spark, path)
    if not files.exists(place(f"{path}/_state")):
        return 0, {"buckets": {}, "done": []}
    names = [f.getPath().getName() for f in files.listStatus(place(f"{path}/_state"))]
    newest = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
    if not newest:
        return 0, {"buckets": {}, "done": []}
    return newest, json.loads(spark.read.text(f"{path}/_state/{newest}.json", wholetext=True).first()[0])


def _appended(spark: SparkSession, path: str, done: list[str]) -> list[str]:
    """Folders of complete appends that are not among done."""
    files, place = _file_system(spark, path)
    if not files.exists(place(f"{path}/log")):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place(f"{path}/log")) if f.isDirectory()]
    return sorted(n for n in names if n not in done and files.exists(place(f"{path}/log/{n}/_SUCCESS")))


def append(updates: DataFrame, path: str, key: str, name: str | None = None, buckets: int = BUCKETS) -> str:
    """Adds updates (key, at, and any columns; null leaves a column as it is) to the log; appending again under the same name replaces. Returns the name."""
    name = name or uuid.uuid4().hex
    _bucketed(updates, key, buckets).write.mode("overwrite").parquet(f"{path}/log/{name}")
    return name


def _since(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/log/{n}" for n in names]) if names else None


def _folded(spark: SparkSession, path: str, folders: list[str]) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/base/{f}" for f in folders]) if folders else None


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row per record: the latest value that is not null of each column, created_at (the first at) and updated_at (the last)."""
    _, state = _state(spark, path)
    base, new = _folded(spark, path, list(state["buckets"].values())), _since(spark, path, _appended(spark, path, state["done"]))
    if base is None and new is None:
        raise FileNotFoundError(f"{path} holds no records")
    return _merged(base, new, key)


def _merged(base: DataFrame | None, new: DataFrame | None, key: str) -> DataFrame:
    parts = []
    if base is not None:
        parts.append(base.withColumnRenamed("updated_at", "at"))
    if new is not None:
        parts.append(new.drop("bucket").withColumn("created_at", F.col("at")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    values = merged_updates(rows.drop("created_at"), key, "at")
    times = rows.groupBy(F.col(key).alias("_key")).agg(F.min("created_at").alias("created_at"), F.max("at").alias("updated_at"))
    return values.join(times, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def compact(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> list[int]:
    """Folds what was appended since into the buckets that it touches, and returns those; the others stay as they are. One at a time; appends may go on meanwhile."""
    number, state = _state(spark, path)
    names = _appended(spark, path, state["done"])
    new = _since(spark, path, names)
    if new is None:
        return []
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    base = _folded(spark, path, [state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]])
    version = uuid.uuid4().hex
    _bucketed(_merged(base, new, key), key, buckets).write.partitionBy("bucket").parquet(f"{path}/base/{version}")
    after = {"buckets": state["buckets"] | {str(b): f"{version}/bucket={b}" for b in touched}, "done": state["done"] + names}
    files, place = _file_system(spark, path)
    files.mkdirs(place(f"{path}/_state"))
    aside = place(f"{path}/_state/.{version}")
    out = files.create(aside, True)
    out.write(json.dumps(after).encode())
    out.close()
    if not files.rename(aside, place(f"{path}/_state/{number + 1}.json")):
        raise OSError(f"another compaction of {path} was faster")
    return touched


def stream_log(updates: DataFrame, path: str, checkpoint: str, key: str):
    """Appends every batch of a stream under its own name, so that a batch that runs again replaces itself; bytes written grow with the batch alone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append(batch, path, key, f"batch-{batch_id:012d}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(requests: DataFrame) -> DataFrame:
    """Requests as records keep them: lists as JSON text."""
    return requests.withColumns({c: F.to_json(c) for c in LISTS if c in requests.columns})


def replayed(records: DataFrame) -> DataFrame:
    """Records as the requests they came from: lists read back (none where the text is no list), years empty where all years were asked for."""
    lists = {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in LISTS if c in records.columns}
    years = {c: F.when(~F.coalesce("all_years", F.lit(False)), F.col(c)) for c in ("start_year", "end_year") if c in records.columns and "all_years" in records.columns}
    return records.withColumns(lists | years)
