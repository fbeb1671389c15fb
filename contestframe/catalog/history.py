"""History-window queries over the runs view."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.functions import columns as C
from contestframe.operators import field, windows
from contestframe.operators.windows import History
from contestframe.scale import attach
from contestframe.sources import views


def R(expr: str) -> str:
    """SQL twin of r4."""
    return f"round({expr} + 1e-7, 4) + 0.0"


KEY = ["contest_id", "finish_rank"]
ENTRANT = ("finish_rank",)


def base(spark, sf, stable=False):
    return views.runs(spark, sf, stable).withColumn("win", (F.col("finish_rank") == 1).cast("int"))


def history(spark, sf, frame, keys, ties=ENTRANT, kind="prior_contest"):
    return History(tuple(keys), "contest_ord", tuple(ties), kind, views.hot(spark, sf, frame, list(keys)))


def keyed(df, *cols):
    return df.select(big("contest_id").alias("contest_id"), big("finish_rank").alias("finish_rank"), *cols)


@register(
    "value_runs_by_day",
    f"""with d as (select *, dense_rank() over (partition by entrant_id order by contest_ord) dr from runs),
h as (select *, coalesce(avg(win) over (partition by entrant_id order by dr
        range between 50 preceding and 1 preceding), 0) as win_rate from d),
s as (select contest_id, list(1/price) as q, case when sum(power(1/price, 2)) <= 1 and sum(power(1/price, 0.01)) >= 1 then 1 else 0 end as ok from runs group by contest_id),
b as (select contest_id, ok, list_reduce(list_prepend(struct_pack(lo := 0.01::double, hi := 2.0::double),
        list_transform(range(60), lambda i: struct_pack(lo := i::double, hi := 0.0::double))),
        lambda a, x: case when list_sum(list_transform(q, lambda v: power(v, (a.lo + a.hi) / 2))) > 1
          then struct_pack(lo := (a.lo + a.hi) / 2, hi := a.hi)
          else struct_pack(lo := a.lo, hi := (a.lo + a.hi) / 2) end) as r from s),
v as (select h.*, case when ok = 0 then (1/price) / sum(1/price) over (partition by h.contest_id)
        else power(1/price, (r.lo + r.hi) / 2) end as market
      from h join b using (contest_id)),
e as (select *, market * price * power(4.0/price, 1.25) - 1 as ev from v),
t as (select *, row_number() over (partition by contest_date order by round(ev, 9) desc, contest_id, finish_rank) as pick from e)
select contest_id, finish_rank, pick, {R('win_rate')} as win_rate, {R('market')} as market, {R('ev')} as ev
from t where pick <= 10""",
    views="runs",
)
def value_runs_by_day(spark, sf):
    df = base(spark, sf)
    df = windows.rolling_rates(df, history(spark, sf, df, ["entrant_id"]), {"win_rate": "win"})
    df = field.devig_power(df, "contest_id", "price", "market")
    df = df.withColumn("ev", C.ev("market", "price"))
    best = W.partitionBy("contest_date").orderBy(F.round("ev", 9).desc(), "contest_id", "finish_rank")
    top = df.withColumn("pick", F.row_number().over(best)).where("pick <= 10")
    return keyed(top, big("pick").alias("pick"), *[r4(c).alias(c) for c in ("win_rate", "market", "ev")])


@register(
    "w01_prior_expanding",
    f"""select contest_id, finish_rank,
  {R('avg(elapsed) over w')} as prior_mean, {R('stddev_samp(elapsed) over w')} as prior_sd
from runs window w as (partition by track, distance order by contest_ord
  range between unbounded preceding and 1 preceding)""",
    views="runs",
)
def w01(spark, sf):
    df = base(spark, sf)
    h = history(spark, sf, df, ["track", "distance"])
    out = windows.prior_expanding(df, h, "elapsed", "m", "s")
    return keyed(out, r4("m").alias("prior_mean"), r4("s").alias("prior_sd"))


@register(
    "w02_speed_figure",
    f"""with p as (select *, avg(elapsed) over w as m, stddev_samp(elapsed) over w as s
  from runs window w as (partition by track, distance order by contest_ord
    range between unbounded preceding and 1 preceding)),
f as (select median(elapsed) as med from runs)
select contest_id, finish_rank,
  {R('least(greatest((coalesce(m, 50.0) - elapsed) / (coalesce(s, 1.0) + 1e-6), -4.5), 4.5)')} as figure
from p""",
    views="runs",
)
def w02(spark, sf):
    df = base(spark, sf)
    h = history(spark, sf, df, ["track", "distance"])
    out = windows.prior_expanding(df, h, "elapsed", "m", "s")
    return keyed(out, r4(windows.speed_figure("elapsed", "m", "s", F.lit(50.0))).alias("figure"))


@register(
    "w03_early_speed_z",
    f"""with t as (select *, elapsed / 4 as sec1 from runs),
g as (select avg(sec1) as gm, stddev_samp(sec1) as gs from t where contest_date < date '1997-01-01'),
p as (select *, avg(sec1) over w as m, stddev_samp(sec1) over w as s
  from t window w as (partition by track, distance order by contest_ord
    range between unbounded preceding and 1 preceding))
select contest_id, finish_rank, {R('''coalesce(least(greatest((sec1 - coalesce(m, gm))
  / greatest(coalesce(s, gs), 0.1), -4.5), 4.5), 0)''')} as early_z from p cross join g""",
    views="runs",
)
def w03(spark, sf):
    df = base(spark, sf).withColumn("sec1", F.col("elapsed") / 4)
    fills = df.where("contest_date < date'1997-01-01'")
    h = history(spark, sf, df, ["track", "distance"])
    out = windows.prior_expanding(df, h, "sec1", "m", "s")
    z = windows.early_speed_z(
        "sec1", "m", "s", fills.agg(F.avg("sec1")).scalar(), fills.agg(F.stddev_samp("sec1")).scalar()
    )
    return keyed(out, r4(z).alias("early_z"))


def _rolling_sql(keys: str) -> str:
    return f"""with d as (select *, case when finish_rank <= 3 then 1 else 0 end as place,
  dense_rank() over (partition by {keys} order by contest_ord) dr from runs)
select contest_id, finish_rank, {R('coalesce(avg(win) over w, 0)')} as win_rate,
  {R('coalesce(avg(place) over w, 0)')} as place_rate
from d window w as (partition by {keys} order by dr range between 50 preceding and 1 preceding)"""


def _rolling(keys, stable=False):
    def run(spark, sf):
        df = base(spark, sf, stable).withColumn("place", C.is_place("finish_rank"))
        out = windows.rolling_rates(df, history(spark, sf, df, keys), {"win_rate": "win", "place_rate": "place"})
        return keyed(out, r4("win_rate").alias("win_rate"), r4("place_rate").alias("place_rate"))

    return run


register("w04_rolling_rate_entrant", _rolling_sql("entrant_id"), "runs")(_rolling(["entrant_id"]))
register("w04_rolling_rate_rider", _rolling_sql("rider_id"), "runs")(_rolling(["rider_id"]))
register("w04_rolling_rate_stable", _rolling_sql("stable_id"), "runs")(_rolling(["stable_id"], True))
register("w04_rolling_rate_rider_stable", _rolling_sql("rider_id, stable_id"), "runs")(
    _rolling(["rider_id", "stable_id"], True)
)


@register(
    "w04_rolling_rate_draw",
    f"""with d as (select *, dense_rank() over (partition by track, distance, draw order by contest_ord) dr from runs)
select contest_id, finish_rank, {R('coalesce(avg(win) over (partition by track, distance, draw order by dr range between 50 preceding and 1 preceding), 0.083)')} as draw_rate
from d""",
    views="runs",
)
def w04_draw(spark, sf):
    df = base(spark, sf)
    h = history(spark, sf, df, ["track", "distance", "draw"])
    out = windows.rolling_rates(df, h, {"draw_rate": "win"}, fill=0.083)
    return keyed(out, r4("draw_rate").alias("draw_rate"))


def _roi_sql(keys: str) -> str:
    w = f"(partition by {keys} order by dr range between 50 preceding and 1 preceding)"
    return f"""with d as (select *, case when win = 1 then price else 0 end as ret,
  dense_rank() over (partition by {keys} order by contest_ord) dr from runs)
select contest_id, finish_rank, {R(f'''case when count(win) over {w} > 0
  then (sum(ret) over {w} - count(win) over {w}) / count(win) over {w} else 0 end''')} as roi from d"""


def _roi(keys, stable=False):
    def run(spark, sf):
        df = base(spark, sf, stable)
        out = windows.rolling_roi(df, history(spark, sf, df, keys), "win", "price", "roi")
        return keyed(out, r4("roi").alias("roi"))

    return run


register("w05_rolling_roi_rider", _roi_sql("rider_id"), "runs")(_roi(["rider_id"]))
register("w05_rolling_roi_stable", _roi_sql("stable_id"), "runs")(_roi(["stable_id"], True))


@register(
    "w06_ewm",
    f"""with n as (select *, row_number() over (partition by entrant_id order by contest_ord, finish_rank) as i from runs),
h as (select a.contest_id, a.finish_rank, a.i, b.i as j, b.win as w, b.price as p
  from n a join n b on a.entrant_id = b.entrant_id and b.i < a.i and b.i >= a.i - 200)
select n.contest_id, n.finish_rank,
  {R("sum(w * case when j = 1 then power(2/3.0, n.i - 2) else power(2/3.0, n.i - 1 - j) / 3 end)")} as win_ewm,
  {R("sum(p * case when j = 1 then power(0.5, n.i - 2) else power(0.5, n.i - j) end)")} as price_ewm
from n left join h on n.contest_id = h.contest_id and n.finish_rank = h.finish_rank
group by n.contest_id, n.finish_rank""",
    views="runs",
)
def w06(spark, sf):
    df = base(spark, sf)
    h = history(spark, sf, df, ["entrant_id"])
    out = windows.ewm(df, h, {"win_ewm": "win"}, span=5)
    out = windows.ewm(out, h, {"price_ewm": "price"}, span=3)
    return keyed(out, r4("win_ewm").alias("win_ewm"), r4("price_ewm").alias("price_ewm"))


@register(
    "w07_lag_diff_trend",
    f"""select contest_id, finish_rank, {R('coalesce(weight - lag(weight) over w, 0)')} as weight_diff,
  {R('coalesce(lag(elapsed) over w - lag(elapsed, 2) over w, 0)')} as elapsed_trend,
  cast(coalesce(distance - lag(distance) over w, 0) as bigint) as distance_diff,
  cast(coalesce(lag(finish_rank) over w, 99) as bigint) as last_rank
from runs window w as (partition by entrant_id order by contest_ord, finish_rank)""",
    views="runs",
)
def w07(spark, sf):
    df = base(spark, sf)
    h = history(spark, sf, df, ["entrant_id"])
    out = windows.lag_diff(df, h, "weight", "weight_diff")
    out = windows.lag_trend(out, h, "elapsed", "elapsed_trend")
    out = windows.lag_diff(out, h, "distance", "distance_diff", fill=0)
    out = windows.lags(out, h, {"last_rank": ("finish_rank", 1)})
    return keyed(
        out, r4("weight_diff").alias("weight_diff"), r4("elapsed_trend").alias("elapsed_trend"),
        big("distance_diff").alias("distance_diff"),
        big(F.coalesce("last_rank", F.lit(99))).alias("last_rank"),
    )


@register(
    "w08_days_since_rest",
    """with d as (select *, coalesce(date_diff('day', lag(contest_date) over (partition by entrant_id
  order by contest_ord, finish_rank), contest_date), 365) as days from runs)
select contest_id, finish_rank, cast(days as bigint) as days,
  case when days <= 7 then 'Short_Backup' when days <= 14 then 'Quick_Return' when days <= 30 then 'Optimal'
    when days <= 60 then 'Freshened' when days <= 120 then 'Spell' else 'Long_Layoff' end as rest from d""",
    views="runs",
)
def w08(spark, sf):
    df = base(spark, sf)
    out = windows.days_since(df, history(spark, sf, df, ["entrant_id"]), "contest_date", "days")
    return keyed(out, big("days").alias("days"), C.rest_bucket("days").alias("rest"))


@register(
    "w09_career_starts",
    """select contest_id, finish_rank,
  row_number() over (partition by entrant_id order by contest_ord, finish_rank) - 1 as career_starts from runs""",
    views="runs",
)
def w09(spark, sf):
    df = base(spark, sf)
    out = windows.career_starts(df, history(spark, sf, df, ["entrant_id"]))
    return keyed(out, big("career_starts").alias("career_starts"))


SEASON = "year(contest_date) - case when month(contest_date) >= 9 then 0 else 1 end"


@register(
    "w10_w11_w12_season_wins",
    f"""with s as (select *, {SEASON} as season from runs),
w as (select *, cast(coalesce(sum(win) over (partition by stable_id, season order by contest_ord
    range between unbounded preceding and 1 preceding), 0) as bigint) as season_wins,
    cast(coalesce(sum(win) over (partition by rider_id order by contest_ord
    range between unbounded preceding and 1 preceding), 0) as bigint) as rider_wins,
    greatest(date_diff('day', contest_date, make_date(season + 1, 7, 31)) / 7.0, 0) as weeks from s)
select contest_id, finish_rank, season_wins, rider_wins,
  cast(greatest(0, 16 - season_wins) as bigint) as quota_gap,
  {R('greatest(0, 16 - season_wins) / (weeks + 1)')} as urgency,
  cast(case when dense_rank() over (partition by contest_date order by season_wins desc) <= 3
    and month(contest_date) in (5, 6, 7) then 1 else 0 end as bigint) as contender,
  cast(case when rider_wins < 20 then 10 when rider_wins < 45 then 7 when rider_wins < 70 then 5
    when rider_wins < 95 then 3 else 0 end as bigint) as claim
from w""",
    views="runs",
)
def w10(spark, sf):
    df = base(spark, sf, stable=True).withColumn("season", C.season("contest_date"))
    stable = history(spark, sf, df, ["stable_id", "season"])
    out = windows.prior_sum(df, stable, "win", "season_wins")
    out = windows.prior_sum(out, history(spark, sf, df, ["rider_id"]), "win", "rider_wins")
    gap, urgency = windows.quota_urgency("season_wins", C.weeks_left("contest_date"))
    out = windows.title_contender(out, "contest_date", "season_wins", "contender")
    return keyed(
        out, big("season_wins").alias("season_wins"), big("rider_wins").alias("rider_wins"),
        big(gap).alias("quota_gap"), r4(urgency).alias("urgency"), big("contender").alias("contender"),
        big(C.claim_ladder("rider_wins")).alias("claim"),
    )


@register(
    "w13_p18_pace_history",
    f"""with f as (select *, count(*) over (partition by contest_id) as n from runs),
e as (select *, (draw - 1) / greatest(n - 1, 1) as early, (draw - finish_rank) / n as late,
  dense_rank() over (partition by entrant_id order by contest_ord) dr from f),
h as (select *, coalesce(avg(early) over w, 0.5) as early3, coalesce(avg(late) over w, 0) as late3
  from e window w as (partition by entrant_id order by dr range between 3 preceding and 1 preceding)),
s as (select *, case when early3 <= 0.33 then 'Leader' when early3 <= 0.66 then 'Stalker' else 'Closer' end as style from h),
l as (select *, sum(case when style = 'Leader' then 1 else 0 end) over (partition by contest_id) as leaders from s)
select contest_id, finish_rank, {R('early3')} as early3, {R('late3')} as late3, style,
  cast(leaders as bigint) as leaders, {R('leaders / n')} as density,
  case when leaders >= 3 then 'Fast' when leaders = 2 then 'Normal' else 'Slow' end as scenario,
  case when leaders >= 3 and style = 'Closer' then 1.0 when leaders <= 1 and style = 'Leader' then 1.0
    when leaders >= 3 and style = 'Leader' then -1.0 else 0.0 end::double as advantage
from l""",
    views="runs",
)
def w13(spark, sf):
    df = attach(base(spark, sf), ["contest_id"], {"n": F.count(F.lit(1))}, "window")
    df = df.withColumn("early", C.early_pct("draw", "n")).withColumn(
        "late", C.late_rating(F.col("draw") - F.col("finish_rank"), "n")
    )
    h = history(spark, sf, df, ["entrant_id"])
    df = windows.rolling_mean(df, h, "early", "early3", fill=0.5)
    df = windows.rolling_mean(df, h, "late", "late3", fill=0.0)
    df = df.withColumn("style", C.run_style("early3"))
    df = df.withColumn("leaders", F.sum((F.col("style") == "Leader").cast("int")).over(W.partitionBy("contest_id")))
    return keyed(
        df, r4("early3").alias("early3"), r4("late3").alias("late3"), "style", big("leaders").alias("leaders"),
        r4(F.col("leaders") / F.col("n")).alias("density"), C.pace_scenario("leaders").alias("scenario"),
        C.pace_advantage("leaders", "style").alias("advantage"),
    )


@register(
    "w14_in_field",
    f"""select contest_id, finish_rank,
  dense_rank() over (partition by contest_id order by weight desc) as weight_rank,
  {R('weight - avg(weight) over (partition by contest_id)')} as weight_to_mean,
  {R('weight - max(weight) over (partition by contest_id)')} as weight_to_max from runs""",
    views="runs",
)
def w14(spark, sf):
    out = windows.in_field(base(spark, sf), "contest_id", "weight", "weight")
    return keyed(
        out, big("weight_rank").alias("weight_rank"), r4("weight_to_mean").alias("weight_to_mean"),
        r4("weight_to_max").alias("weight_to_max"),
    )


@register(
    "w15_w16_w17_gear_incidents",
    """with t as (select *, case when price > 20 then 'B' else 'TT' end as gear,
    case when draw >= 5 then 1 else 0 end as wide, case when finish_rank >= 4 then 1 else 0 end as checked from runs),
l as (select *, lag(gear) over w as prev, coalesce(lag(wide) over w, 0) as lw, coalesce(lag(checked) over w, 0) as lc,
    coalesce(max(case when gear = 'B' then 1 else 0 end) over (partition by entrant_id order by contest_ord, finish_rank
      rows between unbounded preceding and 1 preceding), 0) as ever
  from t window w as (partition by entrant_id order by contest_ord, finish_rank))
select contest_id, finish_rank, cast(case when prev is not null and prev <> gear then 1 else 0 end as bigint) as gear_change,
  cast(case when gear = 'B' and ever = 0 then 1 else 0 end as bigint) as first_b,
  cast(lw as bigint) as last_wide, cast(lc as bigint) as last_checked, cast(greatest(lw, lc) as bigint) as forgive
from l""",
    views="runs",
)
def w15(spark, sf):
    df = base(spark, sf).withColumns(
        {
            "gear": F.when(F.col("price") > 20, "B").otherwise("TT"),
            "wide": (F.col("draw") >= 5).cast("int"),
            "checked": (F.col("finish_rank") >= 4).cast("int"),
        }
    )
    df = df.withColumn("wears_b", (F.col("gear") == "B").cast("int"))
    h = history(spark, sf, df, ["entrant_id"])
    out = windows.changed(df, h, "gear", "gear_change")
    out = windows.first_time(out, h, "wears_b", "first_b")
    out = windows.lag_any(out, h, {"last_wide": "wide", "last_checked": "checked"}, "forgive")
    cols = ["gear_change", "first_b", "last_wide", "last_checked", "forgive"]
    return keyed(out, *[big(c).alias(c) for c in cols])


@register(
    "w18_rating_features",
    f"""with r as (select *, case when draw % 3 = 0 then price * 2 else 0 end as official,
    round(105 - 15 + least(greatest(weight, 115), 135) / 20.0 * 15 - 115 / 20.0 * 15, 1) as implied from runs),
u as (select *, case when official > 0 then official else implied end as used from r)
select contest_id, finish_rank, {R('used')} as rating_used,
  {R('used - max(used) over (partition by contest_id)')} as rating_vs_max,
  {R('coalesce(used - lag(used) over (partition by entrant_id order by contest_ord, finish_rank), 0)')} as rating_change
from u""",
    views="runs",
)
def w18(spark, sf):
    df = base(spark, sf).withColumns(
        {
            "official": F.when(F.col("draw") % 3 == 0, F.col("price") * 2).otherwise(0.0),
            "implied": C.implied_rating("weight", F.lit("Class 1")),
        }
    )
    h = history(spark, sf, df, ["entrant_id"])
    out = windows.rating_features(df, h, "official", "implied", "contest_id")
    return keyed(out, *[r4(c).alias(c) for c in ("rating_used", "rating_vs_max", "rating_change")])


@register(
    "w19_drawdown",
    f"""with d as (select stable_id, contest_date, sum(case when win = 1 then 10 * price - 10 else -10 end) as pnl
  from runs group by 1, 2),
e as (select *, 10000 + sum(pnl) over (partition by stable_id order by contest_date) as equity from d),
p as (select *, max(equity) over (partition by stable_id order by contest_date) as peak from e)
select cast(stable_id as bigint) as stable_id, cast(contest_date as varchar) as day, {R('equity')} as equity,
  {R('peak')} as peak, {R('(equity - peak) / peak')} as drawdown from p""",
    views="runs",
)
def w19(spark, sf):
    out = windows.drawdown(_equity(spark, sf), ["stable_id"], "day_no", "equity")
    return out.select(
        big("stable_id").alias("stable_id"), F.date_format("contest_date", "yyyy-MM-dd").alias("day"),
        r4("equity").alias("equity"), r4("peak").alias("peak"), r4("drawdown").alias("drawdown"),
    )


def _equity(spark, sf):
    """Daily flat-stake equity per stable: one row per stable and day, whatever the number of runs."""
    daily = (
        base(spark, sf, stable=True)
        .groupBy("stable_id", "contest_date")
        .agg(F.sum(F.when(F.col("win") == 1, 10 * F.col("price") - 10).otherwise(-10.0)).alias("pnl"))
        .withColumn("day_no", F.unix_date("contest_date").cast("bigint"))
    )
    w = W.partitionBy("stable_id").orderBy("day_no").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("equity", 10000 + F.sum("pnl").over(w))


@register(
    "w20_risk_ratios",
    f"""with d as (select stable_id, contest_date, sum(case when win = 1 then 10 * price - 10 else -10 end) as pnl
  from runs group by 1, 2),
e as (select *, 10000 + sum(pnl) over (partition by stable_id order by contest_date) as equity from d),
p as (select *, max(equity) over (partition by stable_id order by contest_date) as peak,
  equity / lag(equity) over (partition by stable_id order by contest_date) - 1 as ret from e),
a as (select stable_id, count(*) as n_days, avg(ret) / stddev_samp(ret) * sqrt(365.0) as sharpe,
  min((equity - peak) / peak) as dd, date_diff('day', min(contest_date), max(contest_date)) / 365.25 as years,
  arg_min(equity, contest_date) as f, arg_max(equity, contest_date) as l from p group by 1)
select cast(stable_id as bigint) as stable_id, n_days, {R('sharpe')} as sharpe, {R('dd')} as max_drawdown,
  {R('case when dd < 0 and years > 0 and l > 0 then (power(l / f, 1 / years) - 1) / abs(dd) end')} as calmar from a""",
    views="runs",
)
def w20(spark, sf):
    out = windows.risk_ratios(_equity(spark, sf), ["stable_id"], "contest_date", "equity")
    return out.select(
        big("stable_id").alias("stable_id"), big("n_days").alias("n_days"),
        *[r4(c).alias(c) for c in ("sharpe", "max_drawdown", "calmar")],
    )


@register(
    "w24_keep_one",
    """select cast(entrant_id as bigint) as entrant_id, contest_id, finish_rank from (select *, row_number() over
  (partition by entrant_id order by contest_ord desc, finish_rank desc) as rn from runs) where rn = 1""",
    views="runs",
)
def w24(spark, sf):
    cols = ["entrant_id", "contest_ord", "finish_rank", "contest_id"]
    out = windows.keep_one(base(spark, sf).select(*cols), ["entrant_id"], ["contest_ord", "finish_rank"], "last")
    return out.select(big("entrant_id").alias("entrant_id"), big("contest_id").alias("contest_id"), big("finish_rank").alias("finish_rank"))
