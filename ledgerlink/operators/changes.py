"""Attribute changes, the work queue, and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attribute_changes(log: DataFrame) -> DataFrame:
    """From observations (entity_id, field, value, ts, ordinal): those that differ from the one before, null-safely."""
    w = Window.partitionBy("entity_id", "field").orderBy("ts", "ordinal")
    seen = log.withColumn("old_value", F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    return seen.filter((F.col("n") > 1) & ~F.col("old_value").eqNullSafe(F.col("value"))).select("entity_id", "field", "old_value", F.col("value").alias("new_value"), "ts", "ordinal")


# The columns whose changes are kept.
TRACKED = ["status", "legal_form", "share_capital", "display_name", "merged_into_id"]


def snapshot_changes(old: DataFrame, new: DataFrame, columns: list[str], on: str) -> DataFrame:
    """Changes between two snapshots by entity_id, a row a column; new entities have none."""
    pair = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old_value"), F.col(f"n.{c}").cast("string").alias("new_value"))
    joined = old.alias("o").join(new.alias("n"), "entity_id").select("entity_id", F.explode(F.array(*[pair(c) for c in columns])).alias("c"))
    return joined.select("entity_id", "c.*", F.lit(on).cast("date").alias("on")).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


MOST_ATTEMPTS = 5


def enqueue(tasks: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """tasks and those of incoming with new keys, each once."""
    return tasks.unionByName(incoming.dropDuplicates(key).join(tasks.select(*key), key, "left_anti"))


def claim(tasks: DataFrame, source: int, now: str, batch: int) -> DataFrame:
    """tasks with the next batch running: due and pending ones of source, by priority, then time, then id.

    One writer at a time: a table of files has no row locks.
    """
    due = tasks.filter((F.col("source") == source) & (F.col("status") == "pending") & (F.col("scheduled_for") <= F.lit(now).cast("timestamp")))
    mine = due.orderBy(F.col("priority").desc(), "scheduled_for", "id").limit(batch).select("id", F.lit(True).alias("mine"))
    marked = tasks.join(F.broadcast(mine), "id", "left")
    made = {"status": F.when(F.col("mine"), "running").otherwise(F.col("status")), "attempts": F.col("attempts") + F.coalesce(F.col("mine").cast("int"), F.lit(0))}
    return marked.select(*[made[c].alias(c) if c in made else F.col(c) for c in tasks.columns])


def after_failure(tasks: DataFrame, failed: DataFrame, now: str, delay_seconds: int = 600) -> DataFrame:
    """tasks with the failed ones (id) back for a retry, or failed for good after MOST_ATTEMPTS."""
    marked = tasks.join(failed.select("id", F.lit(True).alias("hit")), "id", "left")
    later = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.lit(delay_seconds))
    made = {"status": F.when(F.col("hit"), F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("pending")).otherwise(F.col("status")), "scheduled_for": F.when(F.col("hit"), later).otherwise(F.col("scheduled_for"))}
    return marked.select(*[made[c].alias(c) if c in made else F.col(c) for c in tasks.columns])


def after_success(tasks: DataFrame, finished: DataFrame) -> DataFrame:
    """tasks with the finished ones (id) done; only what is running can be finished."""
    marked = tasks.join(finished.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    status = F.when(F.col("hit") & (F.col("status") == "running"), "done").otherwise(F.col("status"))
    return marked.select(*[status.alias(c) if c == "status" else F.col(c) for c in tasks.columns])


def release_stale(tasks: DataFrame, now: str, older_seconds: int) -> DataFrame:
    """tasks with running ones locked before now - older_seconds pending again."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(older_seconds))
    stale = (F.col("status") == "running") & (F.col("locked_at") < cutoff)
    made = {"status": F.when(stale, "pending").otherwise(F.col("status")), "locked_at": F.when(~stale, F.col("locked_at"))}
    return tasks.select(*[made[c].alias(c) if c in made else F.col(c) for c in tasks.columns])


def queue_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("source", "status").agg(F.count("*").alias("n"))


def stale_keys(log: DataFrame, now: str, days: int) -> DataFrame:
    """Keys last fetched more than days ago, or on that day exactly: due again. log: key, ts."""
    return log.groupBy("key").agg(F.max("ts").alias("last")).filter(F.col("last") <= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def batches(keys: DataFrame, size: int) -> DataFrame:
    """key, batch: consecutive batches of at most size keys within each shard of the key space.

    Requests are limited in size, not in order, so no global sort is needed.
    """
    sharded = keys.select("key").distinct().withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(64)))
    n = F.row_number().over(Window.partitionBy("shard").orderBy("key"))
    return sharded.withColumn("batch", F.floor((n - 1) / size)).groupBy("shard", "batch").agg(F.sort_array(F.collect_list("key")).alias("keys"))
