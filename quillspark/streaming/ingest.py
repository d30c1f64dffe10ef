"""Continuous ingestion: a stream of documents kept as an idempotent table of the latest version of each.

What is known of each key (its order and size) is the stream's own state; a batch writes what it changes and nothing else,
and every so many batches the changes are folded into a new base.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Batches between two bases.
EVERY = 16
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def latest(batch: DataFrame, key: str = "doc_id", order: str = "mtime") -> DataFrame:
    """Of each key the row with the highest order; of equal ones the last by their columns' JSON."""
    w = W.partitionBy(key).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*batch.columns))))
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def tracked(stream: DataFrame, key: str = "doc_id", order: str = "mtime", size: str | None = None, error: str | None = None) -> DataFrame:
    """The stream's rows with a status each: failed (error is not null; what was known of the key stays), skipped (its order
    is not above the last good one's; with size, if it is below, or the same with the same size), else ok. A row without key or
    order has failed. Rows of one key and batch are judged in their order."""
    columns = stream.columns
    asked = stream.select(
        F.col(key).cast("string").alias("k"),
        F.col(order).cast("double").alias("o"),
        (F.col(size).cast("double") if size else F.lit(0.0)).alias("s"),
        (F.col(error).isNotNull() if error else F.lit(False)).alias("bad"),
        F.to_json(F.struct(*columns), _JSON).alias("row"),
    )

    def judge(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        for p in [pd.concat(list(parts)).sort_values(["o", "row"])]:
            status = []
            for o, s, bad in zip(p["o"], p["s"], p["bad"], strict=True):
                if bad or o != o or name[0] is None:
                    status.append("failed")
                elif known is not None and (o < known[0] or (o == known[0] and s == known[1])):
                    status.append("skipped")
                else:
                    status.append("ok")
                    known = (float(o), float(s) if s == s else -1.0)
            if known is not None:
                state.update(known)
            yield pd.DataFrame({"row": p["row"], "status": status})

    found = asked.groupBy("k").applyInPandasWithState(judge, "row string, status string", "o double, s double", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.from_json("row", stream.schema, _JSON).alias("row"), "status").select("row.*", "status")


def keep_current(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", order: str = "mtime", size: str | None = None, error: str | None = None, every: int = EVERY):
    """Start a query that keeps the latest good row of each key below path; current() reads them. A batch writes its ok
    rows as changes/batch=<number> and its counts by status as report/batch=<number>, over what an earlier try has left, so
    replays change nothing. Late and equal rows are known by the stream's state, without reading the table. After every
    so many batches base/v<number> holds all rows; what it replaces goes with the base after it, when no replay needs it."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        good = latest(batch.filter("status = 'ok'").drop("status"), key, order)
        good.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        batch.groupBy("status").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/report/batch={number}")
        batch.unpersist()
        if (number + 1) % every == 0:
            old = number - every
            _merged(spark, path, old if old >= 0 else None, range(old + 1, number + 1), key).write.mode("overwrite").parquet(f"{path}/base/v{number}")
            for dead in [f"base/v{old - every}", *(f"changes/batch={k}" for k in range(old - every + 1, old + 1))]:
                p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{dead}")
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return tracked(stream, key, order, size, error).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(spark: SparkSession, path: str, base: int | None, batches, key: str) -> DataFrame:
    """A base and the changes of these batches: of each key the row of the last batch that has one."""
    x = None
    for k in batches:
        some = spark.read.parquet(f"{path}/changes/batch={k}").withColumn("_batch", F.lit(k))
        x = some if x is None else x.unionByName(some)
    new = None if x is None else x.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_batch")))).filter("_r = 1").drop("_r", "_batch")
    if base is None:
        return new
    old = spark.read.parquet(f"{path}/base/v{base}")
    return old if new is None else old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName().removeprefix(prefix)) for s in fs.listStatus(p) if whole(s)) if fs.exists(p) else []


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The table as it is after the last whole batch: the last base, and the changes since."""
    bases = _numbers(spark, f"{path}/base", "v")
    base = bases[-1] if bases else None
    return _merged(spark, path, base, [k for k in _numbers(spark, f"{path}/changes", "batch=") if base is None or k > base], key)


def report(spark: SparkSession, path: str) -> DataFrame:
    """(batch, status, n) of every batch: how many rows were ok, skipped and failed."""
    return spark.read.parquet(f"{path}/report")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of a stream's events (ts, event_type) by tumbling window, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
