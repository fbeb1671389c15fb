"""Adapters from the star-schema tables to the engine's views (runs, ticks, payouts, work events)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contestframe.config import CFG
from contestframe.operators.field import has_oversized
from contestframe.scale import probe
from contestframe.session import spread

# Instants of the tick view that stand for the market's baseline, decision and post time.
BASELINE_AT = "2024-01-10 00:00:00"
DECISION_AT = "2024-01-20 00:00:00"
POST_AT = "2024-01-25 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=16)
def _rows(spark: SparkSession, sf_dir: str) -> int:
    """Number of order lines, from their Parquet footers; it sizes tasks and no result depends on it."""
    return table(spark, sf_dir, "lineitem").count()


def large(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the runs view has more than hot_rows rows."""
    return _rows(spark, sf_dir) > CFG.hot_rows


def runs(spark: SparkSession, sf_dir: str, stable: bool = False, ranked: bool = True) -> DataFrame:
    """One row per entrant and contest. `stable` adds stable_id, which needs one more join.

    The supplier join comes first, so that the frame leaves here partitioned by contest. Equal times are ranked by the
    other columns of the run, so that every reading of the view gives the same ranks. A large table is dealt by
    contest into as many tasks as its rows need. Without `ranked` there is no finish_rank and nothing is dealt for it.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = spread(spark, _rows(spark, sf_dir), CFG.hot_rows, CFG.task_rows)
    if stable:
        lines = lines.join(
            table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"),
            "l_suppkey",
        )
    if tasks is not None and ranked:
        lines = lines.repartition(tasks, "l_orderkey")
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    packed = (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("bigint")
    by_contest = W.partitionBy("contest_id").orderBy("l_extendedprice", "draw", "entrant_id", "rider_id", "price", "weight")
    out = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("contest_id"),
        F.to_date("o_orderdate").alias("contest_date"),
        (packed * 1000000 + F.col("l_orderkey")).alias("contest_ord"),
        F.col("l_partkey").alias("entrant_id"),
        F.col("l_suppkey").alias("rider_id"),
        *([F.col("s_nationkey").alias("stable_id")] if stable else []),
        F.col("o_orderpriority").alias("track"),
        (1000 + 200 * (F.col("o_custkey") % 7)).alias("distance"),
        F.col("l_linenumber").alias("draw"),
        (F.col("l_extendedprice") / 1000).alias("elapsed"),
        ((12 + 6 * F.col("l_quantity")) / 10).alias("price"),
        (105 + 375 * F.col("l_tax")).alias("weight"),
        "l_extendedprice",
    )
    if not ranked:
        return out.drop("l_extendedprice")
    return out.withColumn("finish_rank", F.row_number().over(by_contest)).drop("l_extendedprice")


_RAW_KEY = {"entrant_id": "l_partkey", "rider_id": "l_suppkey", "contest_id": "l_orderkey"}


def hot(spark: SparkSession, sf_dir: str, frame: DataFrame, keys: list[str], order: str = "contest_ord"):
    """Cut points of `frame` by `keys`, None when no key is hot.

    A table of at most hot_rows rows has no hot key, which its Parquet footers tell. Beyond that the
    fact table's own key columns are counted when the keys are among them.
    """
    lines = table(spark, sf_dir, "lineitem")
    if lines.count() <= CFG.hot_rows:
        return None
    if all(k in _RAW_KEY for k in keys):
        narrow = lines.select(*[F.col(_RAW_KEY[k]).alias(k) for k in keys])
        return probe(frame, keys, order, counts_from=narrow)
    return probe(frame, keys, order)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quotes: one row per entrant and instant."""
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).cast("bigint").alias("contest_id"),
        F.col("user_id").alias("entrant_id"),
        (1 + F.col("value")).alias("price"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("source"),
    )


def payouts(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """Official payouts per 10 units of the WIN, PLACE, QUINELLA and QPL pools."""
    top = (runs(spark, sf_dir) if placed is None else placed).where("finish_rank <= 3")
    per = top.groupBy("contest_id").agg(
        *[
            F.max(F.when(F.col("finish_rank") == k, F.col("price"))).alias(f"p{k}")
            for k in (1, 2, 3)
        ]
    )

    def row(pool: str, combo: str, amount) -> F.Column:
        return F.struct(
            F.lit(pool).alias("pool"), F.lit(combo).alias("combo"), amount.cast("double").alias("payout")
        )

    def place(k: int):
        return row("PLACE", str(k), 10 * (1 + (F.col(f"p{k}") - 1) / 4))

    def pair(pool: str, a: int, b: int):
        return row(pool, f"{a}/{b}", 10 * F.col(f"p{a}") * F.col(f"p{b}") / 2)

    rows = F.array(
        row("WIN", "1", 10 * F.col("p1")), place(1), place(2), place(3),
        pair("QUINELLA", 1, 2), pair("QPL", 1, 2), pair("QPL", 1, 3), pair("QPL", 2, 3),
    )
    return per.select("contest_id", F.inline(rows)).where(F.col("payout").isNotNull())


def work_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation events of an entrant: activity date, rider, timed work."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entrant_id"),
        F.to_date("l_shipdate").alias("activity_date"),
        F.col("l_suppkey").alias("rider_id"),
        (F.col("l_quantity") / 2 + 10).alias("time_400"),
        (F.col("l_linestatus") == "F").alias("is_fast"),
    )


def oversized(spark: SparkSession, sf_dir: str) -> bool:
    """Whether some contest of the runs view is too large for one array; reads one column."""
    return has_oversized(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contest_id")), "contest_id")
