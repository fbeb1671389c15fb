"""Operators on the tick stream at rest. Ticks of a busy contest are aggregated or rank-limited per task.

A key has one tick per instant, so the instant in microseconds, one BIGINT, orders its ticks: newest, opening and as-of
values are `max_by` and `min_by` on it, which Spark hashes instead of sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators import field, joins

OPEN_ABOVE = 1.01  # fixed value: a market is open once any price is above it


def valid_price(df: DataFrame, c: str, price: str, out: str, how: str = "window") -> DataFrame:
    """True for every known price of a contest in which some price is above 1.01."""
    is_open = F.max((F.col(price) > OPEN_ABOVE).cast("int"))
    df = scale.attach(df, [c], {"_open": is_open}, how)
    return df.withColumn(out, F.coalesce(F.col("_open") == 1, F.lit(False)) & F.col(price).isNotNull()).drop("_open")


def open_price(ticks: DataFrame, c: str, e: str, at: str, price: str) -> DataFrame:
    """First known price of each entrant once its contest's market is open."""
    opened = ticks.where(F.col(price) > OPEN_ABOVE).groupBy(c).agg(F.min(at).alias("_open_at"))
    live = ticks.join(opened, c).where((F.col(at) >= F.col("_open_at")) & F.col(price).isNotNull())
    us = F.unix_micros(at)
    return live.groupBy(c, e).agg(F.min(at).alias("open_at"), F.min_by(price, us).alias("open_price"))


def last_move(ticks: DataFrame, c: str, e: str, at: str, price: str, now: Column, cfg: Config = CFG, cuts: DataFrame | None = None) -> DataFrame:
    """Per contest the time of the last price change (else its first tick) and whether it is frozen.

    `cuts` splits busy entrants along the tick time in microseconds (`_us`).
    """
    timed = ticks.select(c, e, at, price, F.unix_micros(at).alias("_us"))

    def build(d: DataFrame, part: list[str]) -> DataFrame:
        return d.withColumn("_before", F.lag(price).over(W.partitionBy(*part).orderBy("_us")))

    seen = scale.bounded(timed, [c, e], "_us", 1, build, cuts)
    moved = F.when(F.col("_before").isNotNull() & (F.col(price) != F.col("_before")), F.col(at))
    out = seen.groupBy(c).agg(F.coalesce(F.max(moved), F.min(at)).alias("last_move"), F.count_distinct(at).alias("_polls"))
    still = (F.unix_micros(now) - F.unix_micros("last_move")) / 1e6 >= cfg.frozen
    return out.withColumn("frozen", still & (F.col("_polls") >= 2)).drop("_polls")


def price_moves(ticks: DataFrame, c: str, e: str, at: str, price: str) -> DataFrame:
    """Latest price with its change from the opening price (percent) and from the previous tick."""
    opening = open_price(ticks, c, e, at, price)
    two = joins.last_two(ticks, [c, e], at, [price]).withColumnRenamed(f"prev_{price}", "prev_price")
    out = two.select(c, e, F.col(price).alias("price"), "prev_price").join(opening, [c, e], "left")
    move = F.when(F.col("open_price") > 0, (F.col("price") - F.col("open_price")) / F.col("open_price") * 100)
    return out.withColumns({"move_pct": move, "tick_delta": F.col("price") - F.col("prev_price")})


def lifecycle(moves: DataFrame, post: Column, now: Column, cfg: Config = CFG) -> DataFrame:
    """State of each contest from `last_move` output: PRE_POST, TURBO_APPROACH, LOADING_DELAY, OFFICIAL_CLOSED."""
    left = (F.unix_micros(post) - F.unix_micros(now)) / 1e6
    return moves.withColumn("to_post", left).withColumn("state", lifecycle_state("to_post", "frozen", cfg))


def lifecycle_state(to_post: Column | str, frozen: Column | str, cfg: Config = CFG) -> Column:
    t = F.col(to_post) if isinstance(to_post, str) else to_post
    z = F.col(frozen) if isinstance(frozen, str) else frozen
    return (
        F.when(t.isNull() | (t >= cfg.turbo_lead), "PRE_POST").when(t >= 0, "TURBO_APPROACH")
        .when(F.coalesce(z, F.lit(False)), "OFFICIAL_CLOSED").otherwise("LOADING_DELAY")
    )


def odds_slope(ticks: DataFrame, keys: Sequence[str], at: str, price: str, target: float = 300.0, gap: float = 180.0) -> DataFrame:
    """Log change from the tick nearest to `target` seconds before the last one to the last one.

    Ticks at least `gap` seconds old are preferred; without any, the nearest earlier tick serves.
    """
    last = ticks.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("t"), F.col(price).alias("p"))).alias("_last"))
    age = (F.unix_micros("_last.t") - F.unix_micros(at)) / 1e6
    earlier = ticks.join(last, list(keys)).withColumn("_age", age).where(F.col("_age") > 0)
    row = F.struct(F.abs(F.col("_age") - target), F.col(at), F.col(price).alias("p"))
    near = earlier.groupBy(*keys).agg(
        F.first("_last").alias("_last"), F.coalesce(F.min(F.when(F.col("_age") >= gap, row)), F.min(row)).alias("_near")
    )
    final, old = F.col("_last.p"), F.col("_near.p")
    slope = F.when((final > 0) & (old > 0), F.ln(final) - F.ln(old))
    return near.select(*keys, final.alias("final_price"), old.alias("old_price"), slope.alias("slope"))


def _picked(cols: Sequence[str], us: Column, windows: dict[str, int], now_us: Column) -> dict[str, Column]:
    """Aggregates: newest values, and per window the last values at or before its start and the first at or after it.

    Without such a tick both are the earliest values.
    """
    out = {f"now_{x}": F.max_by(x, us) for x in cols}
    for name, seconds in windows.items():
        cut = now_us - seconds * 1_000_000
        before, after = F.when(us <= cut, us), F.when(us >= cut, us)
        for x in cols:
            first = F.min_by(x, us)
            out[f"{name}_base_{x}"] = F.when(F.max(before).isNotNull(), F.max_by(x, before)).otherwise(first)
            out[f"{name}_in_{x}"] = F.when(F.min(after).isNotNull(), F.min_by(x, after)).otherwise(first)
    return out


def tick_summary(ticks: DataFrame, keys: Sequence[str], at: str, now: Column, windows: dict[str, int], cols: Sequence[str]) -> DataFrame:
    """One pass over the ticks up to `now`: newest row, and per named window (seconds) two baselines.

    `<name>_base` is the last row at or before now - w (else the earliest), `<name>_in` the first row
    at or after it (else the earliest). All are conditional minima and maxima, hashed and combined map-side.
    """
    values = _picked(cols, F.unix_micros(at), windows, F.unix_micros(now))
    out = ticks.where(F.col(at) <= now).groupBy(*keys).agg(F.count(F.lit(1)).alias("polls"), F.min(at).alias("first_at"), *[v.alias(n) for n, v in values.items()])
    rows = {"now_row": "now", **{f"{n}_{k}": f"{n}_{k}" for n in windows for k in ("base", "in")}}
    return out.select(*keys, "polls", "first_at", *[F.struct(*[F.col(f"{p}_{x}").alias(x) for x in cols]).alias(r) for r, p in rows.items()])


def tick_card(
    ticks: DataFrame, c: str, e: str, at: str, now: Column, windows: dict[str, int], cols: Sequence[str], cfg: Config = CFG, cuts: DataFrame | None = None
) -> DataFrame:
    """One row per entrant from two readings of the ticks up to `now`; the first of `cols` is the price.

    polls, first_at, the newest values, prev_<col> of the tick before, <window>_base_<col> and <window>_in_<col> as in
    `tick_summary`, open_at and open_price as in `open_price`, last_move and frozen of the contest as in `last_move`. The
    first reading finds when a market opens, one number per contest; the second one orders each entrant's ticks once
    and hashes the rest. `cuts` splits busy entrants along `_us`.
    """
    price = cols[0]
    seen = ticks.where(F.col(at) <= now)
    opened = seen.where(F.col(price) > OPEN_ABOVE).groupBy(c).agg(F.min(F.unix_micros(at)).alias("_open"))
    timed = seen.select(c, e, *cols, F.unix_micros(at).alias("_us")).join(opened, c, "left")

    def build(d: DataFrame, part: list[str]) -> DataFrame:
        w = W.partitionBy(*part).orderBy("_us")
        return d.withColumns({f"_p_{x}": F.lag(x).over(w) for x in cols})

    rows = scale.bounded(timed, [c, e], "_us", 1, build, cuts)
    us = F.col("_us")
    live = F.when((us >= F.col("_open")) & F.col(price).isNotNull(), us)
    moved = F.when(F.col(f"_p_{price}").isNotNull() & (F.col(price) != F.col(f"_p_{price}")), us)
    aggs = {
        "polls": F.count(F.lit(1)), "_first": F.min(us), "_last": F.max(us), "_moved": F.max(moved), "_open_at": F.min(live), "open_price": F.min_by(price, live),
        **{f"prev_{x}": F.max_by(f"_p_{x}", us) for x in cols}, **_picked(cols, us, windows, F.unix_micros(now)),
    }
    card = rows.groupBy(c, e).agg(*[v.alias(n) for n, v in aggs.items()])
    card = scale.attach(card, [c], {"_c_moved": F.max("_moved"), "_c_first": F.min("_first"), "_c_last": F.max("_last")}, "window")
    move = F.coalesce("_c_moved", "_c_first")
    still = (F.unix_micros(now) - move) / 1e6 >= cfg.frozen
    card = card.withColumns({
        "first_at": F.timestamp_micros("_first"), "open_at": F.timestamp_micros("_open_at"), "last_move": F.timestamp_micros(move), "frozen": still & (F.col("_c_first") < F.col("_c_last")),
        **{x: F.col(f"now_{x}") for x in cols}})
    return card.drop("_first", "_last", "_moved", "_open_at", "_c_moved", "_c_first", "_c_last", *[f"now_{x}" for x in cols])
