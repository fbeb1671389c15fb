"""Joins: keyed, as-of, nearest, range, top-n partners and settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.functions import columns as C
from contestframe.operators.windows import keep_one


def join_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, cols: Sequence[str]) -> DataFrame:
    """Left join on the normalised name; a name that occurs twice on the right keeps its first row."""
    keyed = right.select(C.name_key(right_name).alias("_key"), *cols)
    one = keep_one(keyed, ["_key"], list(cols))
    return left.withColumn("_key", C.name_key(left_name)).join(one, "_key", "left").drop("_key")


def join_run(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join on (contest, entrant) against a right side reduced to its first row per key."""
    return left.join(keep_one(right, keys, order), list(keys), "left")


def decision_panel(base: DataFrame, decision: DataFrame, final: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entrants with a baseline price, a decision price and an official result."""
    return (
        decision.join(base, list(keys)).join(final, list(keys)).na.drop(subset=["base_price", "price", "final_price", "finish_rank"])
    )


def event_sums(
    runs: DataFrame,
    events: DataFrame,
    run_keys: Sequence[str],
    entity: str,
    run_date: str,
    event_date: str,
    days: int,
    inputs: Sequence[str],
    aggs: dict[str, Column],
) -> DataFrame:
    """Per run key the aggregates of the entity's events of the `days` days before the run (its day is
    outside); runs without such events are absent.

    Runs meet events in equal day buckets `days` wide: an event is listed in its own bucket and the
    next, so a busy entity is spread over time instead of meeting itself whole. `aggs` may use
    `_age`, the event's age in days.
    """
    span = F.lit(days)
    day = F.unix_date(event_date)
    listed = (
        events.select(F.col(entity).alias("_e"), day.alias("_day"), *[F.col(c).alias(f"ev_{c}") for c in inputs])
        .withColumn("_bucket", F.explode(F.array(F.floor(F.col("_day") / span), F.floor(F.col("_day") / span) + 1)))
    )
    needed = [*run_keys, entity, run_date, *[c for c in inputs if c in runs.columns and c not in (*run_keys, entity, run_date)]]
    left = runs.select(*needed).withColumn("_rd", F.unix_date(run_date)).withColumn("_rb", F.floor(F.col("_rd") / span))
    hit = (F.col(entity) == F.col("_e")) & (F.col("_rb") == F.col("_bucket"))
    age = F.col("_rd") - F.col("_day")
    found = left.join(listed, hit).withColumn("_age", age).where((F.col("_age") > 0) & (F.col("_age") <= span))
    return found.groupBy(*run_keys).agg(*[expr.alias(name) for name, expr in aggs.items()])


def event_window(runs: DataFrame, events: DataFrame, run_keys: Sequence[str], *spec) -> DataFrame:
    """All runs with their `event_sums`, NULL where there were no events."""
    return runs.join(event_sums(runs, events, run_keys, *spec), list(run_keys), "left")


def nearest_frame(
    ticks: DataFrame, keys: Sequence[str], entrant: str, at: str, to_post: str, target: float, lo: float, hi: float
) -> DataFrame:
    """The whole snapshot of each key whose time to post is nearest to `target` within [lo, hi]."""
    inside = ticks.where(F.col(to_post).between(lo, hi))
    chosen = inside.groupBy(*keys).agg(
        F.min(F.struct(F.abs(F.col(to_post) - target).alias("d"), F.col(at).alias("at"))).alias("_pick")
    ).select(*keys, F.col("_pick.at").alias(at))
    frame = ticks.join(chosen, [*keys, at], "left_semi")
    return keep_one(frame, [*keys, *([entrant] if entrant not in keys else [])], [at])


def asof_frames(ticks: DataFrame, keys: Sequence[str], at: str, cutoff: Column, cols: Sequence[str]) -> DataFrame:
    """Per key `before_<col>` of the last row at or before the cutoff and `after_<col>` of the first at or after it.

    Where there is no such row, the earliest one serves. A key has one row per instant; one hash aggregate gives all.
    """
    us, cut = F.unix_micros(at), F.unix_micros(cutoff)
    before, after = F.when(us <= cut, us), F.when(us >= cut, us)
    picked = []
    for x in (at, *cols):
        picked.append(F.when(F.max(before).isNotNull(), F.max_by(x, before)).otherwise(F.min_by(x, us)).alias(f"before_{x}"))
        picked.append(F.when(F.min(after).isNotNull(), F.min_by(x, after)).otherwise(F.min_by(x, us)).alias(f"after_{x}"))
    return ticks.groupBy(*keys).agg(*picked)


def asof_frame(ticks: DataFrame, keys: Sequence[str], at: str, cutoff: Column, cols: Sequence[str]) -> DataFrame:
    """Per key the last row at or before the cutoff, else the earliest row."""
    return asof_frames(ticks, keys, at, cutoff, cols).select(*keys, *[F.col(f"before_{x}").alias(x) for x in (at, *cols)])


def asof_forward(ticks: DataFrame, keys: Sequence[str], at: str, cutoff: Column, cols: Sequence[str]) -> DataFrame:
    """Per key the first row at or after the cutoff, else the earliest row."""
    return asof_frames(ticks, keys, at, cutoff, cols).select(*keys, *[F.col(f"after_{x}").alias(x) for x in (at, *cols)])


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, cols: Sequence[str],
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Every left row with the right row of its key that is latest at or before it.

    Both sides are united on one time axis and the latest right row is a running maximum, which
    `cuts` (border values of `_at`, microseconds) splits for hot keys.
    """
    payload = F.struct(F.col(right_at).alias("at"), *cols)
    l = left.select(*keys, F.unix_micros(left_at).alias("_at"), F.struct(*left.columns).alias("_left"))
    r = right.select(*keys, F.unix_micros(right_at).alias("_at"), payload.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    frame = lambda part: W.partitionBy(*part).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    seen = scale.running(both, keys, "_at", {"_latest": ("max", "_right")}, frame, cuts)
    matched = seen.where(F.col("_left").isNotNull())
    return matched.select("_left.*", *[F.col(f"_latest.{x}").alias(f"asof_{x}") for x in ["at", *cols]])


def latest_per(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each entity."""
    return keep_one(df, [entity], order, "last")


def baseline_join(now: DataFrame, base: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Left join of a baseline column; entrants without one keep NULL, which scores as neutral."""
    return now.join(base.select(*keys, F.col(col).alias(out)), list(keys), "left")


def last_two(ticks: DataFrame, keys: Sequence[str], at: str, cols: Sequence[str]) -> DataFrame:
    """The newest values of each key and, as prev_<col>, those of the tick before; two ticks per key and task are shuffled."""
    w = W.partitionBy(*keys).orderBy(F.col(at).desc())
    newest = ticks.select(*keys, F.unix_micros(at).alias("_us"), *cols, F.row_number().over(w).alias("_rn")).where("_rn <= 2")
    first, second = F.when(F.col("_rn") == 1, F.col("_us")), F.when(F.col("_rn") == 2, F.col("_us"))
    return newest.groupBy(*keys).agg(*[F.max_by(x, first).alias(x) for x in cols], *[F.max_by(x, second).alias(f"prev_{x}") for x in cols])


def prev_poll(ticks: DataFrame, keys: Sequence[str], at: str, cols: Sequence[str]) -> DataFrame:
    """Row of the second-latest instant of each key.

    One pass: the rank filter keeps the two newest instants of a key in every task before they are shuffled.
    """
    w = W.partitionBy(*keys).orderBy(F.col(at).desc())
    two = ticks.select(*keys, at, *cols).withColumn("_r", F.dense_rank().over(w)).where("_r <= 2")
    return two.where("_r = 2").groupBy(*keys).agg(F.max(F.struct(F.col(at), *cols)).alias("_row")).select(*keys, "_row.*")


def legs(df: DataFrame, listed: DataFrame, c: str, e: str, names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Listed combinations (contest and one column per leg) with each leg's columns, suffixed by its name.

    The combinations come from a table, so a field of any size costs what is listed; a combination in which an
    entrant does not run, or runs twice, is left out.
    """
    out = listed
    for n in names:
        side = df.select(c, F.col(e).alias(n), *[F.col(x).alias(f"{x}_{n}") for x in carry])
        out = out.join(side, [c, n])
    for i, n in enumerate(names):
        for m in names[:i]:
            out = out.where(F.col(n) != F.col(m))
    return out


def pairs(df: DataFrame, listed: DataFrame, c: str, e: str, carry: Sequence[str] = ()) -> DataFrame:
    """Listed pairs (leg_a, leg_b) as unordered pairs, leg_a the smaller id, each once."""
    low, high = F.least("leg_a", "leg_b"), F.greatest("leg_a", "leg_b")
    one = listed.select(c, low.alias("a"), high.alias("b")).distinct()
    return legs(df, one, c, e, ["a", "b"], carry).withColumnsRenamed({"a": "leg_a", "b": "leg_b"})


def triples(df: DataFrame, listed: DataFrame, c: str, e: str) -> DataFrame:
    """Listed ordered triples (first, second, third) of distinct entrants, each once."""
    return legs(df, listed.select(c, "first", "second", "third").distinct(), c, e, ["first", "second", "third"])


def _best(df: DataFrame, c: str, e: str, score: str, k: int) -> DataFrame:
    w = W.partitionBy(c).orderBy(F.col(score).desc(), F.col(e))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def cross_top(bankers: DataFrame, satellites: DataFrame, c: str, e: str, score: str, n: int) -> DataFrame:
    """Each banker with its n best satellites other than itself.

    A banker can be at most one of them, so the n + 1 best satellites of a contest are enough.
    """
    best = _best(satellites, c, e, score, n + 1).select(c, F.col(e).alias("satellite"), F.col(score).alias("satellite_score"))
    met = bankers.withColumnRenamed(e, "banker").join(best, c).where("banker <> satellite")
    w = W.partitionBy(c, "banker").orderBy(F.col("satellite_score").desc(), "satellite")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def settle(tickets: DataFrame, payouts: DataFrame, stake: str = "stake", per: float = 10.0, combo: str = "combo") -> DataFrame:
    """Tickets (contest_id, pool, combo, stake) with `returned`; a combination not paid returns 0.

    `combo` names the column of legs on both sides: numbers, or `combo_codes` for entrant codes. Legs are
    compared in their order only in pools that pay by order; a payout listed again counts once.
    """
    key = C.combo_key(combo, "pool")
    paid = payouts.select("contest_id", "pool", key.alias("_key"), "payout").groupBy("contest_id", "pool", "_key").agg(F.max("payout").alias("payout"))
    return tickets.withColumn("_key", key).join(paid, ["contest_id", "pool", "_key"], "left").withColumn(
        "returned", F.coalesce(F.col("payout") / per * F.col(stake), F.lit(0.0))
    ).drop("_key")


def covered(df: DataFrame, payouts: DataFrame, c: str = "contest_id") -> DataFrame:
    """Rows of contests that have payouts."""
    return df.join(payouts, c, "left_semi")


def new_only(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not stored yet."""
    return df.join(stored, list(keys), "left_anti")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join of a small attribute table; the optimiser broadcasts it when its size allows."""
    return df.join(table.select(*keys, *cols), list(keys), "left")


def attach_intent(card: DataFrame, intent: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Intent columns on the priced card, 0 where unknown."""
    return lookup(card, intent, keys, cols).na.fill(0, subset=list(cols))


def attach_rail(df: DataFrame, rails: DataFrame, date: str, venue: str) -> DataFrame:
    """Rail setting by meeting date and venue alias, NULL when unknown."""
    keyed = rails.select(
        F.to_date("date").alias("_d"), C.venue_code("venue").alias("_v"), F.upper(F.trim("rail")).alias("rail")
    )
    one = keep_one(keyed, ["_d", "_v"], ["rail"])
    return df.join(one, (F.col(date) == F.col("_d")) & (C.venue_code(venue) == F.col("_v")), "left").drop("_d", "_v")
