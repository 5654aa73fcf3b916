"""Event streams: idempotent intake, windows, and per-reader state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibliome.operators.recommend import LEARNING_RATE

#: How far into the past and the future an event may lie.
OLDEST, AHEAD = "365 days", "5 minutes"


def timed(events: DataFrame) -> DataFrame:
    """ts as an instant (files hold it without zone, in UTC)."""
    return events if dict(events.dtypes)["ts"] == "timestamp" else events.withColumn("ts", F.col("ts").cast("timestamp"))


def admitted(events: DataFrame, now: Column) -> DataFrame:
    """Events that aren't older than a year nor ahead of the clock."""
    return events.where((F.col("ts") >= now - F.expr(f"INTERVAL {OLDEST}")) & (F.col("ts") <= now + F.expr(f"INTERVAL {AHEAD}")))


def deduplicated(events: DataFrame, key: str = "event_id", lateness: str = "2 days") -> DataFrame:
    """Each event once however often it is delivered; on a stream, keys are remembered for as long as events may be late."""
    x = timed(events)
    return x.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key]) if x.isStreaming else x.dropDuplicates([key])


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str | None = "2 days") -> DataFrame:
    """(start, event_type, n, total): counts and sums per window and kind; lateness None where the stream has its watermark."""
    x = timed(events)
    x = x.withWatermark("ts", lateness) if x.isStreaming and lateness else x
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = "2 days") -> DataFrame:
    """(user_id, start, stop, n): runs of a reader's events with no gap as long as that."""
    x = timed(events)
    x = x.withWatermark("ts", lateness) if x.isStreaming and lateness else x
    return x.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that has come in since the last run, in micro-batches; the checkpoint keeps the place, so a rerun adds nothing."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_new(path: str, key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A sink that appends only rows whose key the table doesn't hold, so that replayed batches change nothing.

    The table is partitioned by day; an event keeps its time however often it is delivered, so a batch is held only against the
    days it has events of. Events without a time share one partition.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        if _exists(spark, path):
            days = [r.day for r in new.select("day").distinct().collect()]  # the days of one micro-batch
            held = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, day string").parquet(path)
            here = F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() if None in days else F.lit(False))
            new = new.join(held.where(here).select(key), key, "left_anti")
        new.write.mode("append").partitionBy("day").parquet(path)

    return sink


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds any partition yet; the first batch finds none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(folder) and any("day=" in str(f.getPath()) for f in fs.listStatus(folder))


_STEP = LEARNING_RATE


def _fold(weight: float, deltas: list[float]) -> float:
    for d in deltas:
        weight = min(1.0, max(-1.0, weight + d))
    return weight


def learned_weights(signals: DataFrame) -> DataFrame:
    """signals(user_id, feature, ts, event_id, direction, value) -> (user_id, feature, weight, observations).

    Each signal moves a weight by a small step, held within -1..1 after every step, in order of time. Steps with a clamp make up a
    shift between two bounds, and such shifts are put together without knowing the weight they start from: each hour of a
    reader's signals becomes one, spread over tasks however busy the reader, and the hours are put together in order.
    """
    step = (F.lit(_STEP) * F.col("direction") * F.col("value")).alias("d")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")
    x = signals.where("value BETWEEN 0 AND 1").groupBy("user_id", "feature", hour).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", step))).alias("s"))
    held = lambda v, low, high: F.least(high, F.greatest(low, v))
    start = F.struct(F.lit(0.0).alias("by"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
    one = F.aggregate("s", start, lambda a, e: F.struct((a.by + e.d).alias("by"), held(a.low + e.d, F.lit(-1.0), F.lit(1.0)).alias("low"), held(a.high + e.d, F.lit(-1.0), F.lit(1.0)).alias("high")))
    parts = x.select("user_id", "feature", "hour", one.alias("m"), F.size("s").alias("n")).groupBy("user_id", "feature")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("hour", "m"))).alias("h"), F.sum("n").cast("int").alias("observations"))
    return whole.select("user_id", "feature", F.aggregate("h", F.lit(0.0), lambda w, p: held(w + p.m.by, p.m.low, p.m.high)).alias("weight"), "observations")


def learned_weights_stream(signals: DataFrame) -> DataFrame:
    """The same on a stream: one number and one count of state per reader and feature, folded in order within each micro-batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        weight, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        weight = _fold(float(weight), (_STEP * rows["direction"] * rows["value"]).tolist())
        seen = int(seen) + len(rows)
        state.update((weight, seen))
        yield pd.DataFrame({"user_id": [key[0]], "feature": [key[1]], "weight": [weight], "observations": [seen]})

    return signals.where("value BETWEEN 0 AND 1").groupBy("user_id", "feature").applyInPandasWithState(
        update, "user_id bigint, feature string, weight double, observations bigint", "weight double, seen bigint", "update", "NoTimeout"
    )
