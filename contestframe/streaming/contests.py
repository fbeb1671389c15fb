"""Stateful steps over one-second quotes: contest lifecycle, steam transitions and the tick sink.

`quotes` thins a stream to the newest price of each entrant and second. Its windows close with the watermark, so batches
come in event-time order and the steps need no late data. All steps are DataFrame plans on a micro-batch
and the state tables of `state.BatchState`; no Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators.market import lifecycle_state
from contestframe.streaming.state import BatchState, Step, run_steps
from contestframe.streaming.ticks import TTL

SECOND = 1_000_000  # microseconds
KEEP = 4 * 3600  # seconds that quotes and closed contests are remembered
CLOSED = "OFFICIAL_CLOSED"
_PRICES = "contest_id bigint, entrant_id bigint, price double"
_CONTESTS = "contest_id bigint, first_at bigint, moved_at bigint, polls bigint, state string, closed_at bigint"
_QUOTES = "contest_id bigint, entrant_id bigint, price double, at bigint, changed boolean"


def quotes(stream: DataFrame, delay: str = TTL) -> DataFrame:
    """contest_id, entrant_id, price, at: the newest known price of each entrant and second, at the end of the second (microseconds)."""
    known = stream.where("price is not null").withWatermark("ts", delay)
    out = known.groupBy(F.window("ts", "1 second"), "contest_id", "entrant_id").agg(F.max_by("price", "ts").alias("price"))
    return out.select(F.col("contest_id").cast("bigint").alias("contest_id"), F.col("entrant_id").cast("bigint").alias("entrant_id"), "price", F.unix_micros("window.end").alias("at"))


def _until(batch: DataFrame, state: BatchState) -> tuple[int | None, int | None]:
    """Event time that earlier batches have reached, and that this one reaches; two numbers on the driver."""
    before = state.before("clock", "until bigint").agg(F.max("until")).first()[0]
    now = batch.agg(F.max("at")).first()[0]
    until = max((x for x in (before, now) if x is not None), default=None)
    state.after("clock", state.spark.createDataFrame([(until,)], "until bigint"))
    return before, until


def _state_at(post: Column, at: Column, polls: Column, moved: Column, cfg: Config) -> Column:
    frozen = (polls >= 2) & ((at - moved) / SECOND >= cfg.frozen)
    return lifecycle_state((post - at) / SECOND, frozen, cfg)


def lifecycle_step(posts: DataFrame, cfg: Config = CFG, keep: int = KEEP) -> Step:
    """contest_id, at, before, state, to_post: every change of a contest's state, at its first microsecond.

    The state of a contest at an instant follows from the time to post and from its last price change, as in
    `market.lifecycle`. It can change at quotes, `turbo_lead` before post, at post, and `frozen` seconds after a price
    change, so only these instants are looked at; the last three come without a quote. A contest that closes
    is done: its prices are dropped, and later quotes of it are ignored while it is remembered (`keep` seconds).
    """
    posts = posts.select(F.col("contest_id").cast("bigint").alias("contest_id"), F.unix_micros("post_at").alias("post"))
    lead, frozen = round(cfg.turbo_lead * SECOND), round(cfg.frozen * SECOND)
    in_time = W.partitionBy("contest_id").orderBy("at")
    so_far = in_time.rowsBetween(W.unboundedPreceding, 0)

    def step(batch: DataFrame, state: BatchState) -> DataFrame:
        batch = state.written("quotes", batch)
        reached, until = _until(batch, state)
        contests = state.before("contests", _CONTESTS)
        closed = contests.where("closed_at is not null")
        fresh = batch.join(posts, "contest_id", "left_semi").join(closed, "contest_id", "left_anti")
        past = state.before("prices", _PRICES).withColumn("at", F.lit(-1).cast("bigint"))
        prev = F.lag("price").over(W.partitionBy("contest_id", "entrant_id").orderBy("at"))
        both = state.written("both", past.select(*fresh.columns).unionByName(fresh).withColumn("changed", prev.isNotNull() & (prev != F.col("price"))))
        polls = both.where("at >= 0").groupBy("contest_id", "at").agg(F.max(F.col("changed").cast("int")).alias("changed"))
        polls = polls.select("contest_id", "at", F.lit(1).alias("poll"), "changed")

        # instants without a quote at which a state can change
        running = contests.where("closed_at is null").select("contest_id", F.coalesce("moved_at", "first_at").alias("moved"))
        moves = running.unionByName(polls.select("contest_id", F.col("at").alias("moved")))
        timers = moves.select("contest_id", (F.col("moved") + frozen).alias("at"))
        marks = moves.select("contest_id").distinct().join(posts, "contest_id").select("contest_id", F.explode(F.array(F.col("post") - lead + 1, F.col("post") + 1)).alias("at"))
        quiet = timers.unionByName(marks).where((F.col("at") > (reached if reached is not None else -1)) & (F.col("at") <= (until or 0)))
        instants = polls.unionByName(quiet.select("contest_id", "at", F.lit(0).alias("poll"), F.lit(0).alias("changed")))
        instants = instants.groupBy("contest_id", "at").agg(F.max("poll").alias("poll"), F.max("changed").alias("changed"))

        known = contests.select("contest_id", "first_at", "moved_at", F.col("polls").alias("earlier"), F.col("state").alias("last_state"))
        timed = instants.join(known, "contest_id", "left").join(posts, "contest_id")
        timed = timed.withColumns({
            "polls": F.coalesce("earlier", F.lit(0)) + F.sum("poll").over(so_far),
            "first_at": F.coalesce("first_at", F.min(F.when(F.col("poll") == 1, F.col("at"))).over(so_far)),
            "moved_at": F.coalesce(F.max(F.when(F.col("changed") == 1, F.col("at"))).over(so_far), "moved_at"),
        }).where("polls > 0")
        timed = timed.withColumn("state", _state_at(F.col("post"), F.col("at"), F.col("polls"), F.coalesce("moved_at", "first_at"), cfg))
        ended = F.sum(F.when(F.col("state") == CLOSED, 1).otherwise(0)).over(in_time.rowsBetween(W.unboundedPreceding, -1))
        open_ = state.written("instants", timed.withColumns({"before": F.coalesce(F.lag("state").over(in_time), "last_state"), "ended": F.coalesce(ended, F.lit(0))}).where("ended = 0"))

        last = open_.groupBy("contest_id").agg(
            F.max("first_at").alias("first_at"), F.max("moved_at").alias("moved_at"), F.max("polls").cast("bigint").alias("polls"),
            F.max_by("state", "at").alias("state"), F.max(F.when(F.col("state") == CLOSED, F.col("at"))).alias("closed_at"))
        kept = contests.join(last, "contest_id", "left_anti").where(F.col("closed_at").isNull() | (F.col("closed_at") > (until or 0) - keep * SECOND))
        now = state.written("contests", kept.select(*last.columns).unionByName(last))
        state.after("contests", now)
        prices = both.groupBy("contest_id", "entrant_id").agg(F.max_by("price", "at").alias("price"))
        state.after("prices", prices.join(now.where("closed_at is null"), "contest_id", "left_semi"))
        changes = open_.where(~F.col("state").eqNullSafe(F.col("before")))
        return changes.select("contest_id", "at", "before", "state", ((F.col("post") - F.col("at")) / SECOND).alias("to_post"))

    return step


def lifecycle(stream: DataFrame, posts: DataFrame, delay: str = TTL, cfg: Config = CFG, home: str | None = None) -> DataFrame:
    """State changes of every contest over what the stream has, see `lifecycle_step`."""
    return run_steps(quotes(stream, delay), lifecycle_step(posts, cfg), home)


def audited(changes: DataFrame, cfg: Config = CFG) -> DataFrame:
    """The changes into a late state, with the effective time and the market weight that hold from then on."""
    late = changes.where(F.col("state").isin("TURBO_APPROACH", "LOADING_DELAY", CLOSED))
    return late.withColumn("t_eff", C.t_effective("to_post", cfg)).withColumn("weight", C.fusion_weight("t_eff", "state", cfg))


def steam_step(keep: int = KEEP) -> Step:
    """contest_id, at, entered, gone, n_before, n_after: how the set of steaming entrants changes from window to window."""

    def step(batch: DataFrame, state: BatchState) -> DataFrame:
        batch = state.written("sets", batch)
        _, until = _until(batch, state)
        past = state.before("sets", "contest_id bigint, at bigint, entrants array<bigint>")
        both = past.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
        nobody = F.array().cast("array<bigint>")
        prev = F.coalesce(F.lag("entrants").over(W.partitionBy("contest_id").orderBy("at")), nobody)
        seen = both.withColumn("prev", prev).where(~F.col("old"))
        moved = seen.select("contest_id", "at", F.array_except("entrants", "prev").alias("entered"), F.array_except("prev", "entrants").alias("gone"), F.size("prev").alias("n_before"), F.size("entrants").alias("n_after"))
        newest = both.groupBy("contest_id").agg(F.max("at").alias("at"), F.max_by("entrants", "at").alias("entrants"))
        state.after("sets", newest.where(F.col("at") > (until or 0) - keep * SECOND))
        return moved.where("size(entered) + size(gone) > 0")

    return step


def steam_transitions(stream: DataFrame, steam: Column, window: str, delay: str = TTL, keep: int = KEEP, home: str | None = None) -> DataFrame:
    """Entrants that enter or leave the steaming set of a contest between consecutive windows with ticks.

    A set holds each entrant once, so it is bounded by the field. A contest without ticks for `keep` seconds starts
    from the empty set again.
    """
    sets = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "contest_id").agg(F.sort_array(F.collect_set(F.when(steam, F.col("entrant_id").cast("bigint")))).alias("entrants"))
    return run_steps(sets.select(F.col("contest_id").cast("bigint").alias("contest_id"), F.unix_micros("window.end").alias("at"), "entrants"), steam_step(keep), home)


def labelled(rows: DataFrame, posts: DataFrame, window: int = 90, keep: int = KEEP, cfg: Config = CFG) -> DataFrame:
    """Quotes with time to post, effective time, state, velocity and the final-price flag; `changed` as `flagged` gives it.

    The velocity base of a quote is the entrant's newest quote at least `window` seconds older, else its earliest one
    before it. A contest is frozen by the quotes of the last `keep` seconds, which are also what bases are taken from.
    """
    back = keep * SECOND
    own = W.partitionBy("contest_id", "entrant_id").orderBy("at")
    field = W.partitionBy("contest_id").orderBy("at").rangeBetween(-back, 0)
    df = rows.join(posts.select(F.col("contest_id").cast("bigint").alias("contest_id"), F.unix_micros("post_at").alias("post")), "contest_id", "left")
    base = F.coalesce(F.last("price").over(own.rangeBetween(-back, -window * SECOND)), F.first("price").over(own.rangeBetween(-back, -1)))
    moved = F.coalesce(F.max(F.when(F.col("changed"), F.col("at"))).over(field), F.min("at").over(field))
    several = F.min("at").over(field) < F.col("at")
    df = df.withColumns({"base": base, "moved": moved, "polls": F.when(several, 2).otherwise(1), "time_to_post": (F.col("post") - F.col("at")) / SECOND})
    df = df.withColumns({"state": _state_at(F.col("post"), F.col("at"), F.col("polls"), F.col("moved"), cfg), "t_eff": C.t_effective("time_to_post", cfg)})
    return df.withColumns({"velocity": F.when(F.col("base") > 0, (F.col("price") - F.col("base")) / F.col("base")), "is_final": F.col("state") == CLOSED}).drop("base", "moved", "polls", "post")


def flagged(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """Adds `changed`: the price differs from the entrant's previous quote of the last `keep` seconds."""
    own = W.partitionBy("contest_id", "entrant_id").orderBy("at")
    prev = F.lag(F.struct("price", "at")).over(own)
    return rows.withColumn("changed", F.coalesce((prev["price"] != F.col("price")) & (prev["at"] >= F.col("at") - keep * SECOND), F.lit(False)))


def sink_step(posts: DataFrame, window: int = 90, keep: int = KEEP, cfg: Config = CFG) -> Step:
    """Labelled quotes of a micro-batch with their `day`; the state is the quotes of the last `keep` seconds."""

    def step(batch: DataFrame, state: BatchState) -> DataFrame:
        batch = state.written("quotes", batch)
        _, until = _until(batch, state)
        past = state.before("history", _QUOTES).withColumn("old", F.lit(True))
        new = batch.withColumn("old", F.lit(False))
        seen = flagged(past.drop("changed").unionByName(new), keep).where(~F.col("old"))
        both = state.written("history", past.unionByName(seen.select(*past.columns)))
        state.after("history", both.where(F.col("at") > (until or 0) - keep * SECOND).drop("old"))
        done = labelled(both, posts, window, keep, cfg).where(~F.col("old")).drop("old")
        return done.withColumn("day", F.to_date(F.timestamp_micros("at")))

    return step


def sink_ticks(stream: DataFrame, posts: DataFrame, home: str | None = None, delay: str = TTL, window: int = 90, keep: int = KEEP, cfg: Config = CFG) -> DataFrame:
    """Writes labelled quotes below batch_id= and day= folders of the sink and returns them.

    A batch overwrites its own folder, so that failures and restarts on the same `home` neither lose nor repeat rows.
    """
    return run_steps(quotes(stream, delay), sink_step(posts, window, keep, cfg), home, ("day",))
