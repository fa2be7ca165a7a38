"""Job events, usage records and expiry, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import delete_runs

TTL_SECONDS, TERMINAL = 86_400, ("completed", "failed")
PHASES = ("queued", "running", "completed", "failed")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("last", last).where("last = 1").drop("last")


def merged_updates(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Partial updates folded into one row per key: the latest non-null value of each column."""
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def expired(created: Column, now: Column, ttl: int = TTL_SECONDS) -> Column:
    """Whether a run's epoch is over its time to live, or not set."""
    return (created <= 0) | (now - created > ttl)


def expired_jobs(jobs: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Jobs (status, updated_at) that ended and are over their time to live."""
    return jobs.where(F.col("status").isin(*TERMINAL) & expired(F.col("updated_at"), now, ttl))


def usage(records: DataFrame, author: str = "", status: str = "", limit: int = 50) -> DataFrame:
    """The newest usage records whose author contains a text and whose status is given; 1 to 200 of them."""
    found = records
    if author:
        found = found.where(F.col("author").ilike(f"%{author}%"))
    if status:
        found = found.where(F.col("status") == status)
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))


def rate(events: DataFrame, key: str, time: str, seconds: int, most: int) -> DataFrame:
    """Keys with more than so many events in a window of so many seconds (tumbling)."""
    counted = events.groupBy(F.window(time, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(F.col("w.start").alias("start"), key, "n")


def stream_latest(events: DataFrame, path: str, checkpoint: str, key: str, order: list[str]):
    """Keeps, at path, the latest row of each key of a stream: every batch is folded into a new version, named by its id; the version before stays for readers, older ones go."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/version={batch_id - 1}"
        both = batch
        if batch_id > 0:
            both = spark.read.parquet(before).unionByName(batch)
        latest(both, key, order).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        delete_runs(spark, path, [f"version={batch_id - 2}"])

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rate(events: DataFrame, key: str, time: str, seconds: int, late: str) -> DataFrame:
    """Counts per key and window of a stream, with late events up to a delay."""
    return events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))
