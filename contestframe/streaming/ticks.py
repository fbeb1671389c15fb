"""Structured Streaming over ticks: windows, watermarks and deduplicated events. `contests` has the steps that keep state."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestframe.operators import joins
from contestframe.operators.windows import keep_one
from contestframe.session import shared_dir

TTL = "4 hours"
AUDIT_BUCKETS = 64  # folders of the milestone audit

# Alert stages (name, seconds before post)
STAGES = (("T-15m", 900), ("T-10m", 600), ("T-3m", 180), ("T-45s", 45), ("T-12s", 12))
MILESTONES = (("T-5m", 300), ("T-2m", 120))


def tick_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Ticks of a growing Parquet folder as an unbounded table; `drop_late` says when a tick is too old."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def drop_late(stream: DataFrame, delay: str = TTL) -> DataFrame:
    """Watermark on `ts`: stateful operators drop what is older."""
    return stream.withWatermark("ts", delay)


def candles(stream: DataFrame, width: str = "1 minute") -> DataFrame:
    """Open, high, low, close and count per entrant and tumbling window."""
    return stream.groupBy(F.window("ts", width).alias("w"), "contest_id", "entrant_id").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("ticks"),
    ).select(F.col("w.start").alias("start"), "contest_id", "entrant_id", "open", "high", "low", "close", "ticks")


def velocity(stream: DataFrame, window: str = "90 seconds", slide: str = "30 seconds") -> DataFrame:
    """Relative price change from the first to the last tick of each sliding window."""
    first, last = F.min_by("price", "ts"), F.max_by("price", "ts")
    out = stream.groupBy(F.window("ts", window, slide).alias("w"), "contest_id", "entrant_id").agg(first.alias("first"), last.alias("last"))
    change = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first"))
    return out.select(F.col("w.end").alias("end"), "contest_id", "entrant_id", "first", "last", change.alias("velocity"))


def recent(stream: DataFrame, window: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """Rolling baseline: the earliest price of each sliding window."""
    out = stream.groupBy(F.window("ts", window, slide).alias("w"), "contest_id", "entrant_id").agg(F.min_by("price", "ts").alias("recent_price"))
    return out.select(F.col("w.end").alias("end"), "contest_id", "entrant_id", "recent_price")


def baseline(stream: DataFrame, age_seconds: int = 900, keep: str = TTL, slide: str = "15 minutes") -> DataFrame:
    """Oldest retained price of each entrant once it is at least `age_seconds` older than the newest tick.

    Ticks are retained for `keep`: every `slide` has a window of that length, whose state goes with the watermark.
    """
    out = stream.groupBy(F.window("ts", keep, slide).alias("w"), "contest_id", "entrant_id").agg(
        F.min_by("price", "ts").alias("base_price"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )
    age = (F.unix_micros("newest") - F.unix_micros("oldest")) / 1e6
    return out.select(F.col("w.end").alias("end"), "contest_id", "entrant_id", "base_price", age.alias("age")).where(F.col("age") >= age_seconds)


def to_post(stream: DataFrame, posts: DataFrame) -> DataFrame:
    """Joins the static post times and adds the seconds that are left."""
    return stream.join(posts, "contest_id").withColumn("to_post", (F.unix_micros("post_at") - F.unix_micros("ts")) / 1e6)


def _once(stream: DataFrame, label: Column, name: str, delay: str) -> DataFrame:
    """First row of each (contest, label); state older than the watermark is dropped."""
    marked = stream.withColumn(name, label).where(F.col(name).isNotNull())
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["contest_id", name])


def milestones(stream: DataFrame, marks: Sequence[tuple[str, float]] = MILESTONES, closed: Column | None = None, delay: str = TTL) -> DataFrame:
    """One event per contest and milestone: the first tick at or inside each mark; CLOSED when given.

    `stream` carries `to_post`. A tick inside several marks raises each of them.
    """
    raised = [F.when(F.col("to_post") <= seconds, F.lit(name)) for name, seconds in marks]
    if closed is not None:
        raised.append(F.when(closed, F.lit("CLOSED")))
    exploded = stream.withColumn("milestone", F.explode(F.filter(F.array(*raised), lambda m: m.isNotNull())))
    return _once(exploded, F.col("milestone"), "milestone", delay)


def staged_alerts(stream: DataFrame, stages: Sequence[tuple[str, float]] = STAGES, delay: str = TTL) -> DataFrame:
    """One alert per contest and stage; a tick belongs to the nearest stage it has reached."""
    label = None
    for name, seconds in sorted(stages, key=lambda s: s[1]):
        test = (F.col("to_post") >= 0) & (F.col("to_post") <= seconds)
        label = F.when(test, name) if label is None else label.when(test, name)
    return _once(stream, label, "stage", delay)


def flagged_moves(stream: DataFrame, alerts: DataFrame) -> DataFrame:
    """Ticks of flagged entrants with the move since their alert (stream-static join)."""
    flagged = alerts.select("contest_id", "entrant_id", F.col("price").alias("alert_price"))
    move = (F.col("price") / F.col("alert_price") - 1) * 100
    return stream.join(flagged, ["contest_id", "entrant_id"]).withColumn("move_pct", move)


def episodes(stream: DataFrame, steam: Column, window: str, delay: str = TTL) -> DataFrame:
    """Distinct sets of steaming entrants per contest, each reported once within the delay.

    Entrants are gathered per window as a set, which is bounded by the field, not by its ticks.
    """
    hot = stream.where(steam).withWatermark("ts", delay)
    sets = hot.groupBy(F.window("ts", window), "contest_id").agg(F.sort_array(F.collect_set("entrant_id")).alias("_set"))
    key = F.array_join(F.transform("_set", lambda x: x.cast("string")), ",")
    keyed = sets.select("contest_id", F.window_time("window").alias("at"), key.alias("entrants"))
    # a set is reported anew once the watermark has passed it by the delay; until then its state is kept
    return keyed.dropDuplicatesWithinWatermark(["contest_id", "entrants"])


def with_ttl(stream: DataFrame, ttl: str = TTL, slide: str = "1 hour") -> DataFrame:
    """Retained snapshots: first and last price of each entrant over the last `ttl`, one window for each `slide`."""
    return drop_late(stream, ttl).groupBy(F.window("ts", ttl, slide), "contest_id", "entrant_id").agg(
        F.min_by("price", "ts").alias("first_price"), F.max_by("price", "ts").alias("last_price"), F.count(F.lit(1)).alias("kept")
    )


def run(stream: DataFrame, keys: Sequence[str] = (), mode: str = "update") -> DataFrame:
    """Runs a stream over what is available and returns its result as a table.

    Batches are written to Parquet in the shared folder with their number. With `keys` the newest
    version of each key is the result, which is how an update stream is read; without, every row.
    A batch that is repeated after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch_id={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    written = spark.read.option("basePath", f"{home}/out").schema(schema.add("batch_id", T.LongType())).parquet(f"{home}/out")
    if not keys:
        return written.drop("batch_id")
    return keep_one(written, list(keys), ["batch_id"], "last").drop("batch_id")


def audit_sink(batch: DataFrame, path: str) -> None:
    """foreachBatch body of the milestone audit: appends the (contest, milestone, entrant) rows not stored yet.

    The store lies in folders by a hash of the contest, so a batch reads those of its own contests.
    """
    from contestframe.sources.stores import append_new

    append_new(batch, batch.sparkSession, path, ["contest_id", "milestone", "entrant_id"], buckets=AUDIT_BUCKETS)


def alerts_with_moves(ticks: DataFrame, alerts: DataFrame, at: str) -> DataFrame:
    """Batch form of the slippage check: newest price of each flagged entrant against its alert."""
    return flagged_moves(joins.latest_per(ticks, "entrant_id", [at]), alerts)
