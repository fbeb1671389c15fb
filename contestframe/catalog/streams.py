"""Streaming queries: the tick table is read as a stream to its end and the result tables are returned."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.catalog.history import R
from contestframe.catalog.tickq import POST, at, us
from contestframe.config import CFG
from contestframe.sources import views
from contestframe.streaming import contests as K
from contestframe.streaming import ticks as S


def stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    raw = S.tick_stream(spark, f"{sf}/events*.parquet", schema)
    return raw.select(
        F.floor(F.col("user_id") / 10).cast("bigint").alias("contest_id"), F.col("user_id").alias("entrant_id"),
        (1 + F.col("value")).alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"),
    )


def posts(spark, sf):
    return views.ticks(spark, sf).select("contest_id").distinct().withColumn("post_at", at(POST))


@register(
    "r01_r11_candles",
    f"""select epoch_us(time_bucket(interval 6 hour, ts, timestamp '1970-01-01')) as start, contest_id, entrant_id, {R('arg_min(price, ts)')} as open,
  {R('max(price)')} as high, {R('min(price)')} as low, {R('arg_max(price, ts)')} as close, count(*) as ticks from ticks group by 1, 2, 3""",
    "ticks",
)
def r11(spark, sf):
    out = S.run(S.candles(S.drop_late(stream(spark, sf)), "6 hours"), ["start", "contest_id", "entrant_id"])
    return out.select(us("start"), big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), *[r4(c).alias(c) for c in ("open", "high", "low", "close")], big("ticks").alias("ticks"))


@register(
    "r04_stream_velocity",
    f"""with w as (select t.*, epoch_us(time_bucket(interval 1 day, ts, timestamp '1970-01-01')) + (k + 1) * 86400000000 as end from ticks t cross join range(3) r(k))
select "end", contest_id, entrant_id, {R('arg_min(price, ts)')} as first, {R('arg_max(price, ts)')} as last,
  {R('(arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts)')} as velocity from w group by 1, 2, 3""",
    "ticks",
)
def r04(spark, sf):
    out = S.run(S.velocity(S.drop_late(stream(spark, sf)), "3 days", "1 day"), ["end", "contest_id", "entrant_id"])
    return out.select(us("end"), big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), *[r4(c).alias(c) for c in ("first", "last", "velocity")])


@register(
    "r05_stream_recent",
    f"""with w as (select t.*, epoch_us(time_bucket(interval 1 day, ts, timestamp '1970-01-01')) + (k + 1) * 86400000000 as end from ticks t cross join range(2) r(k))
select "end", contest_id, entrant_id, {R('arg_min(price, ts)')} as recent_price from w group by 1, 2, 3""",
    "ticks",
)
def r05(spark, sf):
    out = S.run(S.recent(S.drop_late(stream(spark, sf)), "2 days", "1 day"), ["end", "contest_id", "entrant_id"])
    return out.select(us("end"), big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), r4("recent_price").alias("recent_price"))


@register(
    "r03_stream_baseline",
    f"""with w as (select t.*, epoch_us(time_bucket(interval 1 day, ts, timestamp '1970-01-01')) + (k + 1) * 86400000000 as end from ticks t cross join range(4) r(k))
select "end", contest_id, entrant_id, {R('arg_min(price, ts)')} as base_price, {R('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} as age
from w group by 1, 2, 3 having (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 900""",
    "ticks",
)
def r03(spark, sf):
    """Baselines over a retention of four days, one for each day, as the tick table spans weeks."""
    out = S.run(S.baseline(S.drop_late(stream(spark, sf)), keep="4 days", slide="1 day"), ["end", "contest_id", "entrant_id"])
    return out.select(us("end"), big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), r4("base_price").alias("base_price"), r4("age").alias("age"))


@register(
    "r07_milestones",
    f"""with m as (select contest_id, milestone from ticks cross join (values ('T-5m', 5), ('T-2m', 2), ('CLOSED', 0)) v(milestone, d)
  where (epoch_us(timestamp '{POST}') - epoch_us(ts)) / 86400e6 <= d) select distinct contest_id, milestone from m""",
    "ticks",
)
def r07(spark, sf):
    timed = S.to_post(stream(spark, sf), posts(spark, sf))
    marks = (("T-5m", 5 * 86400), ("T-2m", 2 * 86400))
    out = S.run(S.milestones(timed, marks, closed=F.col("to_post") <= 0, delay="40 days"), mode="append")
    return out.select(big("contest_id").alias("contest_id"), "milestone")


@register(
    "r08_staged_alerts",
    f"""with d as (select contest_id, (epoch_us(timestamp '{POST}') - epoch_us(ts)) / 86400e6 as d from ticks)
select distinct contest_id, case when d <= 1 then 'T-1d' when d <= 3 then 'T-3d' else 'T-9d' end as stage from d where d between 0 and 9""",
    "ticks",
)
def r08(spark, sf):
    timed = S.to_post(stream(spark, sf), posts(spark, sf))
    stages = (("T-9d", 9 * 86400), ("T-3d", 3 * 86400), ("T-1d", 86400))
    out = S.run(S.staged_alerts(timed, stages, delay="40 days"), mode="append")
    return out.select(big("contest_id").alias("contest_id"), "stage")


@register(
    "r09_flagged_moves",
    f"""with a as (select entrant_id, arg_max(price, ts) as ap from ticks where ts <= timestamp '{views.DECISION_AT}' and entrant_id % 4 = 0 group by 1)
select contest_id, t.entrant_id, epoch_us(ts) as ts, {R('(price / ap - 1) * 100')} as move_pct from ticks t join a on t.entrant_id = a.entrant_id where ts > timestamp '{views.DECISION_AT}'""",
    "ticks",
)
def r09(spark, sf):
    from contestframe.operators import joins

    early = views.ticks(spark, sf).where((F.col("ts") <= at(views.DECISION_AT)) & (F.col("entrant_id") % 4 == 0))
    alerts = joins.latest_per(early, "entrant_id", ["ts"])
    out = S.run(S.flagged_moves(stream(spark, sf).where(F.col("ts") > at(views.DECISION_AT)), alerts), mode="append")
    return out.select(big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), us("ts"), r4("move_pct").alias("move_pct"))


@register(
    "r10_episodes",
    """with w as (select contest_id, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as d, string_agg(distinct cast(entrant_id as varchar), ',') as raw,
  list_sort(list(distinct entrant_id)) as ids from ticks where price > 18 group by 1, 2)
select distinct contest_id, array_to_string(ids, ',') as entrants from w where d + interval 1 day <= (select max(ts) from ticks where price > 18) - interval 1 day""",
    "ticks",
)
def r10(spark, sf):
    """Windows still inside the watermark at the end of the table are not reported yet, as in a live stream."""
    out = S.run(S.episodes(stream(spark, sf), F.col("price") > 18, "1 day", "1 day"), mode="append")
    return out.select(big("contest_id").alias("contest_id"), "entrants")


def quotes_sql(delay: int) -> str:
    """One quote per entrant and second, those that the watermark has passed; `delay` in seconds."""
    return f"""qa as (select contest_id, entrant_id, (epoch_us(ts) // 1000000 + 1) * 1000000 as t_us, arg_max(price, ts) as price from ticks group by 1, 2, 3),
q as (select * from qa where t_us <= (select epoch_us(max(ts)) // 1000 * 1000 - {delay * 1000000} from ticks))"""


POST_US = f"epoch_us(timestamp '{POST}')"
SLOW = dataclasses.replace(CFG, frozen=3 * 3600.0, turbo_lead=86400.0)
STATE_SQL = f"""case when ({POST_US} - t_us) / 1e6 >= 86400 then 'PRE_POST' when {POST_US} >= t_us then 'TURBO_APPROACH'
    when polls >= 2 and (t_us - moved) / 1e6 >= 10800 then 'OFFICIAL_CLOSED' else 'LOADING_DELAY' end"""
LIFECYCLE = f"""{quotes_sql(3600)},
lg as (select *, lag(price) over (partition by contest_id, entrant_id order by t_us) as prev from q),
polled as (select contest_id, t_us, max(case when prev <> price then 1 else 0 end) as changed from lg group by 1, 2),
instants as (select contest_id, t_us, 1 as poll, changed from polled union all select contest_id, t_us + 10800000000, 0, 0 from polled
  union all select contest_id, {POST_US} - 86400000000 + 1, 0, 0 from polled union all select contest_id, {POST_US} + 1, 0, 0 from polled),
merged as (select contest_id, t_us, max(poll) as poll, max(changed) as changed from instants where t_us <= (select max(t_us) from q) group by 1, 2),
known as (select contest_id, t_us, sum(poll) over w as polls, coalesce(max(case when changed = 1 then t_us end) over w, min(case when poll = 1 then t_us end) over w) as moved
  from merged window w as (partition by contest_id order by t_us)),
states as (select contest_id, t_us, {STATE_SQL} as state from known where polls > 0),
steps as (select *, lag(state) over w as before, coalesce(sum(case when state = 'OFFICIAL_CLOSED' then 1 else 0 end) over (partition by contest_id order by t_us rows between unbounded preceding and 1 preceding), 0) as ended
  from states window w as (partition by contest_id order by t_us)),
changes as (select * from steps where state is distinct from before and ended = 0)"""


@register("r06_stream_lifecycle", f"with {LIFECYCLE} select contest_id, t_us, state from changes", "ticks")
def r06(spark, sf):
    """Lifecycle over quotes that lag by up to an hour; a market is frozen after three hours here, as ticks are sparse."""
    return K.lifecycle(stream(spark, sf), posts(spark, sf), "1 hour", SLOW).select("contest_id", F.col("at").alias("t_us"), "state")


@register(
    "r10_state_transitions",
    f"""with {LIFECYCLE}, t as (select *, ({POST_US} - t_us) / 1e6 as left_s from changes where state <> 'PRE_POST'),
e as (select *, case when left_s > 45 then left_s else greatest(left_s, 20) end as t_eff from t)
select contest_id, t_us, before, state, {R('t_eff')} as t_eff, {R("case when state in ('TURBO_APPROACH', 'LOADING_DELAY') then 0.85 else 0.85 - 0.6 / (1 + exp(-0.02 * (t_eff - 360))) end")} as weight from e""",
    "ticks",
)
def r10_states(spark, sf):
    """Changes into a late state, with the state before and the market weight from then on."""
    out = K.audited(K.lifecycle(stream(spark, sf), posts(spark, sf), "1 hour", SLOW), SLOW)
    return out.select("contest_id", F.col("at").alias("t_us"), "before", "state", r4("t_eff").alias("t_eff"), r4("weight").alias("weight"))


@register(
    "r10_steam_transitions",
    """with w as (select contest_id, epoch_us(time_bucket(interval 1 day, ts, timestamp '1970-01-01')) + 86400000000 as t_us,
  coalesce(list_sort(list(distinct entrant_id) filter (where price > 18)), []) as ids from ticks group by 1, 2),
p as (select *, coalesce(lag(ids) over (partition by contest_id order by t_us), []) as prev from w where t_us <= (select epoch_us(max(ts)) // 1000 * 1000 - 86400000000 from ticks)),
d as (select contest_id, t_us, array_to_string(list_filter(ids, lambda x: not list_contains(prev, x)), ',') as entered, array_to_string(list_filter(prev, lambda x: not list_contains(ids, x)), ',') as gone,
  len(prev) as n_before, len(ids) as n_after from p)
select * from d where entered <> '' or gone <> ''""",
    "ticks",
)
def r10_steam(spark, sf):
    out = K.steam_transitions(stream(spark, sf), F.col("price") > 18, "1 day", "1 day", keep=400 * 86400)
    return out.select("contest_id", F.col("at").alias("t_us"), F.array_join("entered", ",").alias("entered"), F.array_join("gone", ",").alias("gone"), big("n_before").alias("n_before"), big("n_after").alias("n_after"))


@register(
    "s05_tick_sink",
    f"""with {quotes_sql(3600)},
lg as (select *, lag(price) over w as prev, lag(t_us) over w as prev_at from q window w as (partition by contest_id, entrant_id order by t_us)),
fl as (select *, coalesce(prev <> price and prev_at >= t_us - 691200000000, false) as changed from lg),
b as (select contest_id, entrant_id, t_us, price,
    coalesce(last_value(price) over (partition by contest_id, entrant_id order by t_us range between 691200000000 preceding and 172800000000 preceding),
      first_value(price) over (partition by contest_id, entrant_id order by t_us range between 691200000000 preceding and 1 preceding)) as base,
    coalesce(max(case when changed then t_us end) over f, min(t_us) over f) as moved, case when min(t_us) over f < t_us then 2 else 1 end as polls
  from fl window f as (partition by contest_id order by t_us range between 691200000000 preceding and current row)),
s as (select *, {STATE_SQL} as state from b)
select contest_id, entrant_id, t_us, {R('price')} as price, {R('(price - base) / base')} as velocity, state, state = 'OFFICIAL_CLOSED' as is_final, {R(f'({POST_US} - t_us) / 1e6')} as time_to_post,
  strftime(make_timestamp(t_us), '%Y-%m-%d') as day from s""",
    "ticks",
)
def s05_sink(spark, sf):
    """Quotes labelled on their way into the store: velocity over two days, a memory of eight."""
    out = K.sink_ticks(stream(spark, sf), posts(spark, sf), delay="1 hour", window=2 * 86400, keep=8 * 86400, cfg=SLOW)
    return out.select("contest_id", "entrant_id", F.col("at").alias("t_us"), *[r4(c).alias(c) for c in ("price", "velocity")], "state", "is_final", r4("time_to_post").alias("time_to_post"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@register(
    "r02_r12_late_and_ttl",
    f"""with w as (select t.*, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - k * interval 1 hour as start from ticks t cross join range(4) r(k))
select epoch_us(start) as start, contest_id, entrant_id, {R('arg_min(price, ts)')} as first_price, {R('arg_max(price, ts)')} as last_price, count(*) as kept from w
where start + interval 4 hour <= (select max(ts) from ticks) - interval 4 hour group by 1, 2, 3""",
    "ticks",
)
def r12(spark, sf):
    out = S.run(S.with_ttl(stream(spark, sf)), mode="append")
    return out.select(
        us("window.start").alias("start"), big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), r4("first_price").alias("first_price"),
        r4("last_price").alias("last_price"), big("kept").alias("kept"),
    )
