"""Sustained pressure on a stream whose samples come late and out of order.

Samples of a run wait in its state until the watermark has passed them, then they are judged in order; so the result is that of
the batch for every sample that is no later than ``delay``. Later ones are dropped by the watermark. A run's state ends when it
has nothing waiting and no open pressure, or when the watermark is ``idle`` seconds beyond its last sample; after so long a silence a run
starts anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.sources.tables import shared_folder

OUTPUT = "run string, id long, fired boolean"
#: Samples of a span of time that is replayed.
SPAN = 250_000
STATE = "since double, last double, ats array<double>, ids array<long>, values array<double>"


def sustained_by_watermark(samples: DataFrame, limit: float, seconds: float, delay: float, idle: float = 30 * 86400.0) -> DataFrame:
    """A stream of (run string, id long, ts timestamp, value double) -> (run, id, fired), as ``operators.monitors.sustained``.

    Order is by time, then ``id``. A null value is not above the limit; a null time is dropped."""

    def update(key, frames, state: GroupState):
        since, last, ats, ids, values = state.get if state.exists else (None, None, [], [], [])
        kinds = {"at": "float64", "id": "Int64", "value": "float64"}
        parts = [pd.DataFrame({"at": list(ats), "id": list(ids), "value": list(values)}).astype(kinds)]
        if not state.hasTimedOut:
            parts += [f[list(kinds)].astype(kinds) for f in frames]
        rows = pd.concat(parts).sort_values(["at", "id"])
        passed = state.getCurrentWatermarkMs() / 1000
        ready, waiting, fired = rows[rows["at"] <= passed], rows[rows["at"] > passed], []
        for at, value in zip(ready["at"], ready["value"], strict=True):
            since, last = since if last is not None and at - last <= idle else None, at
            if value > limit:
                fired.append(since is not None and at - since >= seconds)
                since = at if since is None else since
            else:
                fired.append(False)
                since = None
        silent = state.hasTimedOut and not len(rows)
        if len(waiting) or (since is not None and not silent):
            state.update((since, last, waiting["at"].tolist(), waiting["id"].tolist(), [None if pd.isna(v) else v for v in waiting["value"]]))
            until = waiting["at"].min() if len(waiting) else max(passed, last + idle)
            state.setTimeoutTimestamp(int(until * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"run": key[0], "id": ready["id"], "fired": fired})

    timed = samples.where(F.col("ts").isNotNull()).withWatermark("ts", f"{int(delay * 1000)} milliseconds")
    timed = timed.select("run", "id", "ts", F.col("ts").cast("double").alias("at"), F.col("value").cast("double").alias("value"))
    return timed.groupBy("run").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(table: DataFrame, parts: int, folder: str, files: int = 4) -> float:
    """Writes (run, id, ts, value) into a folder of files as ``parts`` spans of time, one after the other, of ``files`` files each, and a last sample of
    each run that closes it; returns the seconds of a span. Inside a span, files and rows have no order. The table is read once; a span reads only its own rows."""
    spark = table.sparkSession
    low, high = table.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))).first()
    span = max(1.0, ((high or 0.0) - (low or 0.0)) / parts)
    at = F.least(F.floor((F.col("ts").cast("double") - F.lit(low)) / span), F.lit(parts - 1))
    dealt = f"{shared_folder(spark)}/spans"
    table.where(F.col("ts").isNotNull()).withColumn("part", at.cast("int")).repartition("part").write.partitionBy("part").parquet(dealt)
    spans = spark.read.schema(T.StructType([*table.schema, T.StructField("part", T.IntegerType())])).parquet(dealt)
    for k in range(parts):
        spans.where(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(folder)
    end = F.timestamp_seconds(F.lit((high or 0.0) + 3 * span))
    table.select("run").distinct().select("run", F.lit(None).cast("long").alias("id"), end.alias("ts"), F.lit(None).cast("double").alias("value")).write.mode("append").parquet(folder)
    return span


def drained(table: DataFrame, limit: float, seconds: float, parts: int | None = None, files: int = 4) -> DataFrame:
    """The stream over ``table``'s spans of time, run until nothing is left: (run, id, fired) of every sample with a time.

    The watermark stays one span behind, as that is how far samples of a span can be out of order. A run's samples of two spans are
    held at once, so by default spans have about ``SPAN`` samples, and there are more of them in a larger table."""
    spark, folder = table.sparkSession, shared_folder(table.sparkSession)
    own = table.select("run", F.col("id").cast("long").alias("id"), "ts", F.col("value").cast("double").alias("value"))
    span = replayed(own, parts or max(4, -(-own.count() // SPAN)), f"{folder}/samples", files)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/samples")
    finished(sustained_by_watermark(stream, limit, seconds, span), folder)
    return spark.read.schema(OUTPUT).parquet(f"{folder}/fired").where("id IS NOT NULL")


def finished(stream: DataFrame, folder: str) -> None:
    """Runs a stream into files until its source is used up; started again on the same folder, it goes on where it ended."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/fired").option("checkpointLocation", f"{folder}/state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
