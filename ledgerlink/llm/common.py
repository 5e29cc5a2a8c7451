"""What the training-data operators share: workspace, words, index permutation."""

from __future__ import annotations

import atexit
import gc
import math
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here; a word is a run of other characters.
SPACE = " \t\n\x0b\x0c\r"
#: Largest table, in bytes, that is ever broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_local: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under spark.checkpoint.dir.

    Only where that setting is absent and the master is this machine, as in
    tests, is a temporary folder of this process used, and removed at its end.
    On a cluster without that setting there is no folder that all see: an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="ledgerlink-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        base = "file://" + _local["dir"]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: ends its lineage."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cluster remove shuffle files that nothing refers to any more, now and not at the driver's next collection."""
    # What a collection finds dead may be named by events that are still on their way, so it takes a few.
    for _ in range(4):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows fit BROADCAST_BYTES, else as it is.

    df must be cheap to count (a table just cut).
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of text; empty for null."""
    flat = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) that depends on parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid of at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: Column, a: Column, b: Column, *key: Column, rounds: int = 4) -> Column:
    """The image of x in a keyed pseudorandom permutation of 0..n-1.

    A Feistel network on the a-by-b grid (a*b >= n, from sides()); an image
    outside 0..n-1 walks its cycle until it is inside. Less than a cells are
    outside, so a walk of a steps always ends.
    """

    def network(v: Column) -> Column:
        left, right = v % a, F.floor(v / a).cast("long")
        for r in range(rounds):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(r), *key), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), *key), a), a)
        return right * a + left

    def walk(v: Column) -> Column:
        step = lambda s, _: F.when(s < n, s).otherwise(network(s))
        return F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a), v, step))

    return bind(network(x.cast("long")), walk)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what a Python worker gets at once by bytes, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def grouped(batches, keys: list[str]):
    """From record batches sorted by keys: (table, starts), whole groups only.

    starts[i]:starts[i+1] are the rows of group i. Rows of a group that goes on
    in the next batch wait for it.
    """
    import numpy as np
    import pyarrow as pa

    def bounds(t):
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        new[:1] = True
        return np.append(np.flatnonzero(new), t.num_rows)

    waiting = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        waiting.append(batch)
        if key == last == first:
            continue
        last = key
        t = pa.Table.from_batches(waiting)
        starts = bounds(t)
        if len(starts) > 2:
            yield t.slice(0, starts[-2]), starts[:-1]
        waiting = t.slice(starts[-2]).combine_chunks().to_batches()
    if waiting:
        t = pa.Table.from_batches(waiting)
        yield t, bounds(t)


def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """node, root: the smallest node reachable by edges (a, b), for every node of an edge.

    Alternating large-star and small-star steps, each a groupBy and an equi-join;
    every round is written to the shared folder. Nothing is gathered on the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        near = both.join(low, F.col("u") == F.col("w"))
        if large:
            out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = mark(now)
    for _ in range(limit):
        now = cut(star(star(now, True), False), "edges")
        is_ = mark(now)
        if is_ == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was = is_
    raise RuntimeError(f"components did not settle in {limit} rounds")
