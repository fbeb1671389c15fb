"""Join, set, aggregate, selection and settlement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.catalog.fields import CARD, DEVIG, POWERED, card, neutral
from contestframe.catalog.history import R, base, history, keyed
from contestframe.functions import columns as C
from contestframe.operators import aggregates, field, joins, policy, topk, windows
from contestframe.scale import attach
from contestframe.sources import views

EVP = "p * price * power(4.0/price, 1.25)"


# ---- joins -----------------------------------------------------------------------------------


@register(
    "j01_join_name",
    f"""with l as (select n_nationkey, n_name, n_regionkey from nation),
s as (select s_suppkey, s_nationkey, s_acctbal from supplier),
k as (select upper(n_name) as key, max(n_nationkey) as nk from nation group by 1)
select cast(s_suppkey as bigint) as s_suppkey, cast(k.nk as bigint) as nk, {R('s_acctbal')} as bal
from s join l on s.s_nationkey = l.n_nationkey left join k on k.key = upper(l.n_name)""",
)
def j01(spark, sf):
    nation = views.table(spark, sf, "nation")
    sup = views.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    sup = sup.withColumn("spelled", F.concat(F.initcap("n_name"), F.lit(" (AUS)")))
    right = nation.select(F.col("n_name").alias("r_name"), F.col("n_nationkey").alias("nk"))
    out = joins.join_name(sup, right, "spelled", "r_name", ["nk"])
    return out.select(big("s_suppkey").alias("s_suppkey"), big("nk").alias("nk"), r4("s_acctbal").alias("bal"))


@register(
    "j02_join_run",
    f"""with pr as (select contest_id, finish_rank, max(price) as model_price from runs where draw <= 3 group by 1, 2)
select runs.contest_id, runs.finish_rank, {R('weight')} as weight, {R('model_price')} as model_price
from runs left join pr using (contest_id, finish_rank)""",
    "runs",
)
def j02(spark, sf):
    df = base(spark, sf)
    preds = df.where("draw <= 3").select("contest_id", "finish_rank", F.col("price").alias("model_price"))
    out = joins.join_run(df, preds, ["contest_id", "finish_rank"], ["model_price"])
    return keyed(out, r4("weight").alias("weight"), r4("model_price").alias("model_price"))


PANEL = """pan as (select *, price * (1 + (draw - 3) / 20.0) as base_price,
    price * (1 + (finish_rank - 2) / 15.0) as final_price from runs where draw <> 2),
ps as (select *, 1/price - 1/base_price - avg(1/price - 1/base_price) over (partition by contest_id) as d from pan),
panel as (select *, least(greatest(50 + 200 * d, 0), 100) as score, final_price / price as slip from ps)"""


def panel(spark, sf):
    """Decision panel: baseline, decision and final price, result and flow score."""
    df = base(spark, sf)
    keys = ["contest_id", "finish_rank"]
    first = df.where("draw <> 2").select(*keys, (F.col("price") * (1 + (F.col("draw") - 3) / 20.0)).alias("base_price"))
    final = df.select(*keys, (F.col("price") * (1 + (F.col("finish_rank") - 2) / 15.0)).alias("final_price"))
    joined = joins.decision_panel(first, df.select(*keys, "entrant_id", "price", "draw"), final, keys)
    scored = field.flow_score(joined, "contest_id", "price", "base_price", "score")
    return scored.withColumn("slip", C.slippage("final_price", "price"))


@register(
    "j03_decision_panel",
    f"""with {PANEL} select contest_id, finish_rank, {R('base_price')} as base_price, {R('price')} as price,
  {R('final_price')} as final_price, {R('score')} as score, {R('slip')} as slip from panel""",
    "runs",
)
def j03(spark, sf):
    return keyed(panel(spark, sf), *[r4(c).alias(c) for c in ("base_price", "price", "final_price", "score", "slip")])


@register(
    "j04_a24_event_window",
    f"""with h as (select r.contest_id, r.finish_rank, r.rider_id, e.rider_id as er, e.is_fast, e.time_400,
    date_diff('day', activity_date, contest_date) as age
  from runs r join work_events e on r.entrant_id = e.entrant_id
    and activity_date < contest_date and activity_date >= contest_date - interval 28 day),
a as (select contest_id, finish_rank,
    sum(case when age <= 14 and is_fast then 1 else 0 end) as fast14,
    sum(case when age <= 14 and er = rider_id then 1 else 0 end) as same14,
    min(case when age <= 14 then time_400 end) as best14,
    sum(case when age <= 21 and is_fast then 1 else 0 end) as fast21,
    sum(case when age <= 21 and is_fast and er = rider_id then 1 else 0 end) as same21,
    max(case when time_400 < 15 then 1 else 0 end) as trial28 from h group by 1, 2),
g as (select avg(time_400) as m, stddev_samp(time_400) as s from work_events)
select r.contest_id, r.finish_rank, cast(coalesce(fast14, 0) as bigint) as fast14, cast(coalesce(same14, 0) as bigint) as same14,
  cast(case when fast21 > 0 and same21 >= 0.7 * fast21 then 1 else 0 end as bigint) as exclusive,
  cast(coalesce(trial28, 0) as bigint) as trial28,
  {R('case when best14 is null then 0 else least(greatest((m - best14) / s, -4.5), 4.5) end')} as time_z
from runs r left join a using (contest_id, finish_rank) cross join g""",
    "runs work_events",
)
def j04(spark, sf):
    events = views.work_events(spark, sf)
    fast = F.col("ev_is_fast")
    age = F.col("_age")
    same = F.col("ev_rider_id") == F.col("rider_id")
    out = joins.event_window(
        base(spark, sf), events, ["contest_id", "finish_rank"], "entrant_id", "contest_date", "activity_date", 28,
        ["rider_id", "time_400", "is_fast"],
        {
            "fast14": F.count_if((age <= 14) & fast), "same14": F.count_if((age <= 14) & same),
            "best14": F.min(F.when(age <= 14, F.col("ev_time_400"))),
            "fast21": F.count_if((age <= 21) & fast), "same21": F.count_if((age <= 21) & fast & same),
            "trial28": F.max((F.col("ev_time_400") < 15).cast("int")),
        },
    )
    mean, sd = events.agg(F.avg("time_400")).scalar(), events.agg(F.stddev_samp("time_400")).scalar()
    exclusive = (F.col("fast21") > 0) & (F.col("same21") >= 0.7 * F.col("fast21"))
    zero = F.lit(0)
    return keyed(
        out, big(F.coalesce("fast14", zero)).alias("fast14"), big(F.coalesce("same14", zero)).alias("same14"),
        big(F.coalesce(exclusive, F.lit(False))).alias("exclusive"), big(F.coalesce("trial28", zero)).alias("trial28"),
        r4(F.coalesce(C.clip((mean - F.col("best14")) / sd, -4.5, 4.5), F.lit(0.0))).alias("time_z"),
    )


@register(
    "j11_pairs",
    f"""select a.contest_id, cast(a.finish_rank as bigint) as leg_a, cast(b.finish_rank as bigint) as leg_b,
  {R('a.price * b.price')} as product from runs a join runs b on a.contest_id = b.contest_id and a.finish_rank < b.finish_rank
  join (select contest_id, cast(split_part(combo, '/', 1) as bigint) as l, cast(split_part(combo, '/', 2) as bigint) as h
    from payouts where pool in ('QUINELLA', 'QPL') group by all) p on p.contest_id = a.contest_id and p.l = a.finish_rank and p.h = b.finish_rank""",
    "runs payouts",
)
def j11(spark, sf):
    df = base(spark, sf)
    leg = F.split("combo", "/")
    paid = views.payouts(spark, sf, df).where(F.col("pool").isin("QUINELLA", "QPL"))
    listed = paid.select("contest_id", big(F.get(leg, F.lit(1))).alias("leg_a"), big(F.get(leg, F.lit(0))).alias("leg_b"))
    out = joins.pairs(df.withColumn("finish_rank", big("finish_rank")), listed, "contest_id", "finish_rank", ["price"])
    return out.select(
        big("contest_id").alias("contest_id"), big("leg_a").alias("leg_a"), big("leg_b").alias("leg_b"),
        r4(F.col("price_a") * F.col("price_b")).alias("product"),
    )


@register(
    "j12_triples",
    """select a.contest_id, cast(a.finish_rank as bigint) as first, cast(b.finish_rank as bigint) as second, cast(c.finish_rank as bigint) as third
from runs a join runs b on a.contest_id = b.contest_id and b.finish_rank = a.finish_rank + 1
join runs c on a.contest_id = c.contest_id and c.finish_rank = a.finish_rank + 2""",
    "runs",
)
def j12(spark, sf):
    """Every run with the two behind it, as a list of combinations that names absent entrants too."""
    df = base(spark, sf).withColumn("finish_rank", big("finish_rank"))
    r = F.col("finish_rank")
    listed = df.select("contest_id", r.alias("first"), (r + 1).alias("second"), (r + 2).alias("third"))
    out = joins.triples(df, listed, "contest_id", "finish_rank")
    return out.select(*[big(c).alias(c) for c in ("contest_id", "first", "second", "third")])


@register(
    "j14_settle",
    f"""with t as (select contest_id, 'WIN' as pool, cast(finish_rank as varchar) as combo, 100.0 as stake from runs where price < 10
  union all select contest_id, 'QPL', '1/' || cast(finish_rank as varchar), 100.0 from runs where finish_rank between 2 and 4)
select t.contest_id, t.pool, t.combo, {R('coalesce(payout / 10 * stake, 0)')} as returned
from t left join payouts p on t.contest_id = p.contest_id and t.pool = p.pool and t.combo = p.combo""",
    "runs payouts",
)
def j14(spark, sf):
    df = base(spark, sf)
    number = F.col("finish_rank").cast("string")
    single = df.where("price < 10").select("contest_id", F.lit("WIN").alias("pool"), number.alias("combo"))
    # legs in reversed order still match the canonical key
    double = df.where("finish_rank between 2 and 4").select(
        "contest_id", F.lit("QPL").alias("pool"), C.combo_key(F.concat(number, F.lit(" 1"))).alias("combo")
    )
    tickets = topk.union_all(single, double).withColumn("stake", F.lit(100.0))
    out = joins.settle(tickets, views.payouts(spark, sf, df))
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", r4("returned").alias("returned"))


@register(
    "j15_j16_covered_new",
    """with q as (select distinct contest_id from payouts where pool = 'QPL')
select contest_id, finish_rank, case when contest_id in (select contest_id from q) then 'covered' else 'open' end as side
from runs where contest_id in (select contest_id from q) or finish_rank = 1""",
    "runs payouts",
)
def j15(spark, sf):
    df = base(spark, sf)
    pairs = views.payouts(spark, sf, df).where("pool = 'QPL'").select("contest_id")
    inside = joins.covered(df, pairs).withColumn("side", F.lit("covered"))
    outside = joins.new_only(df.where("finish_rank = 1"), pairs, ["contest_id"]).withColumn("side", F.lit("open"))
    return keyed(topk.union_all(inside, outside), "side")


@register(
    "j18_j19_lookups",
    f"""with i as (select l_partkey as entrant_id, max(l_tax) as urgency from lineitem where l_quantity < 20 group by 1),
r as (select o_orderdate::date as d, case when month(o_orderdate) % 2 = 0 then 'C+3' else 'A' end as rail,
    case when o_orderpriority like '1%' then 'HV' else 'ST' end as v from orders group by 1, 2, 3)
select contest_id, finish_rank, {R('coalesce(urgency, 0)')} as urgency, rail
from runs left join i using (entrant_id)
left join r on r.d = contest_date and r.v = case when track like '1%' then 'HV' else 'ST' end""",
    "runs",
)
def j18(spark, sf):
    df = base(spark, sf).withColumn("venue", F.when(F.col("track").startswith("1"), "Happy Valley").otherwise("sha tin"))
    intent = views.table(spark, sf, "lineitem").where("l_quantity < 20").groupBy(F.col("l_partkey").alias("entrant_id")).agg(F.max("l_tax").alias("urgency"))
    rails = views.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderpriority").startswith("1"), "HV").otherwise("ST").alias("venue"),
        F.when(F.month("o_orderdate") % 2 == 0, "c+3").otherwise("a").alias("rail"),
    )
    out = joins.attach_rail(joins.attach_intent(df, intent, ["entrant_id"], ["urgency"]), rails, "contest_date", "venue")
    return keyed(out, r4("urgency").alias("urgency"), "rail")


# ---- sets and top-k --------------------------------------------------------------------------


@register(
    "t02_top_k",
    f"""select contest_id, finish_rank, pick, {R('weight')} as weight from (select *, row_number() over
  (partition by contest_id order by weight desc, finish_rank) as pick from runs) where pick <= 3""",
    "runs",
)
def t02(spark, sf):
    out = topk.top_k(base(spark, sf), ["contest_id"], "weight", 3, ["finish_rank"])
    return keyed(out, big("pick").alias("pick"), r4("weight").alias("weight"))


@register(
    "t03_top_n",
    f"""select contest_id, pool, combo, {R('payout')} as payout from payouts order by payouts.payout desc, contest_id, pool, combo limit 25""",
    "runs payouts",
)
def t03(spark, sf):
    out = topk.top_n(views.payouts(spark, sf), "payout", 25, ["contest_id", "pool", "combo"])
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", r4("payout").alias("payout"))


@register(
    "t04_top_pairs",
    f"""with r as (select *, row_number() over (partition by contest_id order by price desc, finish_rank) as r from runs),
p as (select a.contest_id, a.finish_rank as leg_a, b.finish_rank as leg_b, a.price + b.price as s,
    row_number() over (partition by a.contest_id order by a.price + b.price desc, a.r, b.r) as pair_rank
  from r a join r b on a.contest_id = b.contest_id and a.r < b.r)
select contest_id, cast(leg_a as bigint) as leg_a, cast(leg_b as bigint) as leg_b, pair_rank, {R('s')} as pair_score from p where pair_rank <= 5""",
    "runs",
)
def t04(spark, sf):
    out = topk.top_pairs(base(spark, sf), ["contest_id"], "finish_rank", "price", 5)
    return out.select(
        *[big(c).alias(c) for c in ("contest_id", "leg_a", "leg_b", "pair_rank")], r4("pair_score").alias("pair_score")
    )


@register(
    "u01_u02_union_priority",
    f"""with a as (select contest_id, finish_rank, price, 1 as tier from runs where draw <= 2),
b as (select contest_id, finish_rank, price * 2 as price, 2 as tier from runs where draw >= 2),
u as (select *, row_number() over (partition by contest_id, finish_rank order by tier) as rn from (select * from a union all select * from b))
select contest_id, finish_rank, cast(tier as bigint) as tier, {R('price')} as price from u where rn = 1""",
    "runs",
)
def u02(spark, sf):
    df = base(spark, sf).select("contest_id", "finish_rank", "draw", "price")
    one = df.where("draw <= 2").withColumn("tier", F.lit(1)).drop("draw")
    two = df.where("draw >= 2").withColumns({"price": F.col("price") * 2, "tier": F.lit(2)}).drop("draw")
    return keyed(topk.union_priority([one, two], ["contest_id", "finish_rank"]), big("tier").alias("tier"), r4("price").alias("price"))


@register(
    "u03_u04_key_sets",
    """with a as (select distinct entrant_id from runs where draw = 1), b as (select distinct entrant_id from runs where draw = 6)
select cast(entrant_id as bigint) as entrant_id, 'only_first' as side from a where entrant_id not in (select entrant_id from b)
union all select cast(entrant_id as bigint), 'both' from a where entrant_id in (select entrant_id from b)""",
    "runs",
)
def u03(spark, sf):
    df = base(spark, sf)
    a, b = df.where("draw = 1"), df.where("draw = 6")
    only = topk.key_difference(a, b, ["entrant_id"]).withColumn("side", F.lit("only_first"))
    both = topk.key_intersection(a, b, ["entrant_id"]).withColumn("side", F.lit("both"))
    return topk.union_all(only, both).select(big("entrant_id").alias("entrant_id"), "side")


# ---- aggregates ------------------------------------------------------------------------------


@register(
    "a01_field_stats",
    f"""select contest_id, finish_rank, count(*) over w as field_n, {R('max(weight) over w')} as field_max,
  {R('avg(weight) over w')} as field_mean from runs window w as (partition by contest_id)""",
    "runs",
)
def a01(spark, sf):
    out = aggregates.field_stats(base(spark, sf), "contest_id", "weight")
    return keyed(out, big("field_n").alias("field_n"), r4("field_max").alias("field_max"), r4("field_mean").alias("field_mean"))


@register(
    "a02_a03_overround_thin",
    f"""with o as (select contest_id, count(price) as n, sum(1/price) as book from runs group by 1)
select contest_id, n, {R('book')} as book, {R('(book - 1) * 100')} as overround_pct,
  cast(case when n < 8 or round((book - 1) * 100, 6) < 15 then 1 else 0 end as bigint) as thin from o""",
    "runs",
)
def a02(spark, sf):
    out = aggregates.overround(base(spark, sf), ["contest_id"], "price")
    thin = aggregates.thin_flag("n", F.round("overround_pct", 6))
    return out.select(
        big("contest_id").alias("contest_id"), big("n").alias("n"), r4("book").alias("book"),
        r4("overround_pct").alias("overround_pct"), big(thin).alias("thin"),
    )


@register(
    "a04_a05_draw_stats",
    f"""with t as (select track, distance, draw, count(*) as n, avg(win) as wr,
    avg(case when finish_rank <= 3 then 1 else 0 end) as pr from runs group by grouping sets ((track, distance, draw), (track, draw))),
m as (select *, sum(n) over w as total, sum(wr * n) over w / sum(n) over w as aw, sum(pr * n) over w / sum(n) over w as ap
  from t window w as (partition by track, distance))
select track, cast(distance as bigint) as distance, cast(draw as bigint) as draw, n, {R('wr')} as win_rate, {R('pr')} as place_rate,
  {R('case when total >= 60 then wr / aw end')} as mult_win, {R('case when total >= 60 then pr / ap end')} as mult_place,
  {R('least(greatest(1 + 0.5 * (coalesce(case when total >= 60 then wr / aw end, 1) - 1), 0.5), 2)')} as logit_mult from m""",
    "runs",
)
def a04(spark, sf):
    out = aggregates.draw_stats(base(spark, sf), "track", "distance", "draw", "finish_rank")
    mult = aggregates.draw_multiplier(F.lit(1.0), F.col("mult_win"))
    return out.select(
        "track", big("distance").alias("distance"), big("draw").alias("draw"), big("n").alias("n"),
        *[r4(c).alias(c) for c in ("win_rate", "place_rate", "mult_win", "mult_place")], r4(mult).alias("logit_mult"),
    )


TICKETS = """tk as (select *, 10.0 as stake, case when finish_rank = 1 then 10 * price else 0 end as returned,
  case when draw <= 2 then 'T-5m' else 'T-2m' end as milestone, case when weight > 120 then 'WIN' else 'PLACE' end as pool from runs)"""


def tickets(spark, sf):
    df = aggregates.flat_tickets(base(spark, sf), F.col("finish_rank") == 1, "price")
    return df.withColumns(
        {
            "milestone": F.when(F.col("draw") <= 2, "T-5m").otherwise("T-2m"),
            "pool": F.when(F.col("weight") > 120, "WIN").otherwise("PLACE"),
        }
    )


MONEY = f"""count(*) as bets, {R('sum(stake)')} as staked, {R('sum(returned)')} as returned,
  {R('sum(returned) - sum(stake)')} as net, {R('(sum(returned) - sum(stake)) / sum(stake) * 100')} as roi,
  {R('avg(case when returned > 0 then 1 else 0 end) * 100')} as hit_rate"""


def money(df, *keys):
    return df.select(*keys, big("bets").alias("bets"), *[r4(c).alias(c) for c in ("staked", "returned", "net", "roi", "hit_rate")])


@register("a06_pnl_rollup", f"with {TICKETS} select milestone, pool, {MONEY} from tk group by rollup (milestone, pool)", "runs")
def a06(spark, sf):
    return money(aggregates.pnl(tickets(spark, sf), ["milestone", "pool"], rollup=True), "milestone", "pool")


@register(
    "a07_pnl_by_band",
    f"""with {TICKETS}, b as (select *, case when price > 1.5 and price <= 3 then '(1.5-3]' when price > 3 and price <= 5 then '(3-5]'
  when price > 5 and price <= 8 then '(5-8]' when price > 8 and price <= 999 then '(8-999]' end as band from tk)
select band, {MONEY} from b where band is not null group by band""",
    "runs",
)
def a07(spark, sf):
    return money(aggregates.pnl_by_band(tickets(spark, sf), "price"), "band")


@register(
    "a08_pnl_by_month",
    f"""with {TICKETS} select strftime(contest_date, '%Y-%m') as month, {R('sum(stake)')} as invested,
  {R('sum(returned) - sum(stake)')} as profit, {R('(sum(returned) - sum(stake)) / sum(stake) * 100')} as roi,
  {R('arg_min(price, contest_ord * 100 + finish_rank)')} as start_bankroll from tk group by 1""",
    "runs",
)
def a08(spark, sf):
    df = tickets(spark, sf).withColumn("o", F.col("contest_ord") * 100 + F.col("finish_rank"))
    out = aggregates.pnl_by_month(df, "contest_date", "price", "o")
    return out.select("month", *[r4(c).alias(c) for c in ("invested", "profit", "roi", "start_bankroll")])


@register(
    "a09_slippage_stats",
    f"""with {PANEL} select count(slip) as n, {R('avg(slip)')} as mean, {R('avg(case when slip < 1 then 1 else 0 end)')} as share_below_1,
  {R('quantile_cont(slip, 0.25)')} as p25, {R('quantile_cont(slip, 0.5)')} as p50, {R('quantile_cont(slip, 0.75)')} as p75 from panel""",
    "runs",
)
def a09(spark, sf):
    out = aggregates.slippage_stats(panel(spark, sf), "slip", views.table(spark, sf, "lineitem"))
    return out.select(big("n").alias("n"), *[r4(c).alias(c) for c in ("mean", "share_below_1", "p25", "p50", "p75")])


@register(
    "a11_scoring",
    f"""with {CARD} select {R('-avg(win * ln(least(p, 1 - 1e-12)) + (1 - win) * ln(1 - least(p, 1 - 1e-12)))')} as logloss_model,
  {R('-avg(win * ln(least(q, 1 - 1e-12)) + (1 - win) * ln(1 - least(q, 1 - 1e-12)))')} as logloss_market,
  {R('avg((p - win) * (p - win))')} as brier_model, {R('avg((q - win) * (q - win))')} as brier_market from card where n > 1""",
    "runs",
)
def a11(spark, sf):
    out = aggregates.scoring(card(spark, sf).where("n > 1"), "win", {"model": "p", "market": "q"})
    return out.select(*[r4(c).alias(c) for c in out.columns])


@register(
    "a12_ndcg",
    f"""with {CARD}, g as (select *, case finish_rank when 1 then 3 when 2 then 2 when 3 then 1 else 0 end as rel,
    row_number() over (partition by contest_id order by round(p, 9) desc, md5(contest_id || ':' || finish_rank)) as r,
    row_number() over (partition by contest_id order by case finish_rank when 1 then 3 when 2 then 2 when 3 then 1 else 0 end desc, md5(contest_id || ':' || finish_rank)) as i
  from card where n > 1)
select contest_id, {R('''sum(case when r <= 3 then (power(2, rel) - 1) / log2(r + 1) else 0 end)
  / sum(case when i <= 3 then (power(2, rel) - 1) / log2(i + 1) else 0 end)''')} as ndcg from g group by 1""",
    "runs",
)
def a12(spark, sf):
    df = card(spark, sf).where("n > 1").withColumn("rel", C.relevance("finish_rank")).withColumns({"p": F.round("p", 9), "tie": neutral()})
    out = aggregates.ndcg(df, "contest_id", "p", "rel", 3, ["tie"])
    return out.select(big("contest_id").alias("contest_id"), r4("ndcg").alias("ndcg"))


def _poisson_sql(u: str) -> str:
    """Weight of a replicate: how many steps of the Poisson(1) distribution lie below u."""
    mass, acc, steps = 0.36787944117144233, 0.0, []
    for k in range(aggregates.POISSON_STEPS):
        acc += mass
        steps.append(f"case when {u} > {acc!r} then 1 else 0 end")
        mass /= k + 1
    return " + ".join(steps)


def _md5_sql(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


@register(
    "a13_bootstrap_roi",
    f"""with g as (select {_md5_sql("contest_id || ':' || finish_rank")} % 256 as cell, count(*) * 10.0 as stake,
    sum(case when finish_rank = 1 then 10.0 * price else 0 end) as returned from runs where price between 4.5 and 8 group by 1),
s as (select *, ({_md5_sql("cell || ':' || k || ':7'")} + 0.5) / 4294967296.0 as u from g cross join range(1, 10001) r(k)),
w as (select k, stake, returned, {_poisson_sql("u")} as w from s),
r as (select (sum(w * returned) - sum(w * stake)) / sum(w * stake) * 100 as roi from w group by k having sum(w * stake) > 0)
select count(*) as replicates, {R('avg(roi)')} as mean, {R('quantile_cont(roi, 0.025)')} as lo, {R('quantile_cont(roi, 0.975)')} as hi,
  {R('avg(case when roi <= 0 then 1.0 else 0.0 end)')} as p_loss from r""",
    "runs",
)
def a13(spark, sf):
    df = tickets(spark, sf).where("price between 4.5 and 8")
    out = aggregates.bootstrap_roi(df, ["contest_id", "finish_rank"])
    return out.select(big("replicates").alias("replicates"), *[r4(c).alias(c) for c in ("mean", "lo", "hi", "p_loss")])


@register(
    "a14_signal_test",
    f"""with {PANEL}, tk as (select *, 10.0 as stake, case when finish_rank = 1 then 10 * final_price else 0 end as returned
  from panel where round(score, 9) >= 50.5 and price between 3 and 12)
select count(distinct contest_id) as contests, {MONEY} from tk""",
    "runs",
)
def a14(spark, sf):
    df = panel(spark, sf).withColumn("score", F.round("score", 9))
    return money(aggregates.signal_test(df, 50.5, 3.0, 12.0), big("contests").alias("contests"))


@register(
    "a15_dual_track",
    f"""with {PANEL}, {CARD}, d as (select panel.*, card.p from panel join card using (contest_id, finish_rank)
  where panel.price between 2 and 8 and round(card.p * panel.price * power(4.0/panel.price, 1.25), 9) >= 1.05)
select count(*) as decisions, cast(count_if(finish_rank = 1) as bigint) as wins,
  {R('avg(case when finish_rank = 1 then price - 1 else -1 end) * 100')} as decision_roi,
  {R('avg(case when finish_rank = 1 then final_price - 1 else -1 end) * 100')} as realised_roi,
  {R('avg(case when finish_rank = 1 then price - final_price else 0 end) * 100')} as erosion, {R('avg(slip)')} as mean_slippage from d""",
    "runs",
)
def a15(spark, sf):
    probs = card(spark, sf).select("contest_id", "finish_rank", "p")
    out = aggregates.dual_track(panel(spark, sf).join(probs, ["contest_id", "finish_rank"]), "p", 2.0, 8.0, 1.05)
    return out.select(
        big("decisions").alias("decisions"), big("wins").alias("wins"),
        *[r4(c).alias(c) for c in ("decision_roi", "realised_roi", "erosion", "mean_slippage")],
    )


@register(
    "a16_a17_career_form",
    f"""with r as (select *, row_number() over (partition by entrant_id order by contest_ord desc, finish_rank desc) as rn from runs)
select cast(entrant_id as bigint) as entrant_id, count(*) as starts, cast(sum(win) as bigint) as wins, {R('avg(win) * 100')} as win_pct,
  {R('max(weight)')} as best, string_agg(case when rn <= 5 then printf('%.3f', 1/price) end, ' ' order by rn desc) as recent,
  string_agg(case when rn <= 3 then cast(finish_rank as varchar) end, '-' order by rn desc) as form from r group by 1""",
    "runs",
)
def a16(spark, sf):
    df = base(spark, sf).withColumn("imp", 1 / F.col("price"))
    order = ["contest_ord", "finish_rank"]
    out = aggregates.career(df, "entrant_id", order, "win", "weight", "imp")
    out = out.join(aggregates.last_form(df, "entrant_id", order, "finish_rank"), "entrant_id")
    return out.select(
        big("entrant_id").alias("entrant_id"), big("starts").alias("starts"), big("wins").alias("wins"),
        r4("win_pct").alias("win_pct"), r4("best").alias("best"), "recent", "form",
    )


@register(
    "a21_a22_early_pressure",
    f"""with s as (select *, -(weight - 120) / 10 + case when draw >= 10 then 0.5 else 0 end as sp,
    case when draw <= 2 then 1 else 0 end as lead, count(*) over (partition by contest_id) as n from runs),
r as (select *, row_number() over (partition by contest_id order by sp desc) as k, sum(lead) over (partition by contest_id) as leaders from s)
select contest_id, {R('avg(case when k <= 3 then sp end)')} as early_pressure, cast(max(leaders) as bigint) as front_runners,
  {R('max(leaders / n)')} as front_density from r group by 1""",
    "runs",
)
def a21(spark, sf):
    df = base(spark, sf).withColumns(
        {"speed": (F.col("weight") - 120) / 10, "style": F.when(F.col("draw") <= 2, "Leader").otherwise("Closer")}
    )
    press = aggregates.early_pressure(df, "contest_id", "speed", "draw")
    front = aggregates.front_runners(df.select("contest_id", "style", "finish_rank"), "contest_id", "style").where("finish_rank = 1")
    out = press.join(front, "contest_id")
    return out.select(
        big("contest_id").alias("contest_id"), r4("early_pressure").alias("early_pressure"),
        big("front_runners").alias("front_runners"), r4("front_density").alias("front_density"),
    )


@register(
    "a23_global_fill",
    f"""select {R('avg(elapsed)')} as mean, {R('stddev_samp(elapsed)')} as std, {R('median(elapsed)')} as median
from runs where contest_date < date '2000-01-01'""",
    "runs",
)
def a23(spark, sf):
    df = views.runs(spark, sf, ranked=False)
    fills = aggregates.global_fill(df.select("elapsed", "contest_date"), ["elapsed"], ("contest_date", "2000-01-01"), views.table(spark, sf, "lineitem"))["elapsed"]
    one = df.agg(F.count(F.lit(1)).alias("_n"))
    return one.select(*[r4(fills[k]).alias(k) for k in ("mean", "std", "median")])


PARAMS = [(lo, hi, ev) for lo in (3.0, 4.5) for hi in (8.0, 12.0) for ev in (0.8, 1.0, 1.22)]


@register(
    "a25_sweep",
    f"""with {CARD}, pr as (select * from (values {', '.join(str(p) for p in PARAMS)}) t(lo, hi, ev)),
b as (select pr.*, c.* from pr left join card c on c.price between lo and hi and {EVP} > ev),
g as (select lo, hi, ev, count(contest_id) as bets, cast(count_if(win = 1) as bigint) as wins, count(contest_id) * 10 as staked,
  coalesce(sum(case when win = 1 then 10 * price else 0 end), 0) as ret from b group by 1, 2, 3)
select {R('lo')} as min_price, {R('hi')} as max_price, {R('ev')} as min_ev, bets, wins, {R('staked')} as staked, {R('ret')} as returned,
  {R('ret - staked')} as net, {R('case when staked > 0 then (ret - staked) / staked * 100 end')} as roi from g""",
    "runs",
)
def a25(spark, sf):
    out = aggregates.sweep(card(spark, sf), PARAMS, "p", "price", "win")
    return out.select(
        *[r4(c).alias(c) for c in ("min_price", "max_price", "min_ev")], big("bets").alias("bets"), big("wins").alias("wins"),
        *[r4(c).alias(c) for c in ("staked", "returned", "net", "roi")],
    )


@register(
    "a26_top_divergence",
    f"""with {CARD}, r as (select *, row_number() over (partition by contest_id order by p desc, finish_rank) as rm,
    row_number() over (partition by contest_id order by q desc, finish_rank) as rk from card)
select contest_id, coalesce(string_agg(case when rm <= 3 and rk > 3 then cast(finish_rank as varchar) end, ',' order by finish_rank), '') as divergent
from r group by 1""",
    "runs",
)
def a26(spark, sf):
    out = aggregates.top_divergence(card(spark, sf), "contest_id", "finish_rank", "p", "q")
    return out.select(big("contest_id").alias("contest_id"), "divergent")


# ---- selection and sizing --------------------------------------------------------------------


KELLY = f"""{CARD},
k0 as (select *, p * 1.6 as kp, p * 1.6 * price * power(4.0/price, 1.25) as evr from card
  where n >= 3 and price between 4.5 and 8),
k1 as (select *, row_number() over (partition by contest_id order by evr desc, finish_rank) as r from k0 where evr > 1.22),
k2 as (select *, 1 - coalesce(sum(kp) over w, 0) as rs, 1 - coalesce(sum(1/price) over w, 0) as os from k1
  window w as (partition by contest_id order by r rows between unbounded preceding and 1 preceding)),
k3 as (select *, min(case when os <> 0 and evr > rs / os then 1 else 0 end) over
  (partition by contest_id order by r rows unbounded preceding) as taken from k2),
k4 as (select *, 1 - sum(kp) over (partition by contest_id) as fr, 1 - sum(1/price) over (partition by contest_id) as fo from k3 where taken = 1),
k5 as (select *, least(greatest(kp - fr / fo / price, 0) * 0.15, 0.02) as f0 from k4 where fo > 1e-12),
kelly as (select *, case when sum(f0) over (partition by contest_id) > 0.06
    then f0 * 0.06 / sum(f0) over (partition by contest_id) else f0 end as fraction from k5)"""


def kelly(spark, sf, *extra):
    df = card(spark, sf, *extra).where("n >= 3").withColumn("kp", F.col("p") * 1.6)
    return policy.kelly_field(df, "contest_id", "finish_rank", "kp", "price")


@register("k03_kelly_field", f"with {KELLY} select contest_id, finish_rank, {R('evr')} as ev_ratio, {R('fraction * 100')} as fraction_pct from kelly", "runs")
def k03(spark, sf):
    return keyed(kelly(spark, sf), r4("ev_ratio").alias("ev_ratio"), r4(F.col("fraction") * 100).alias("fraction_pct"))


@register(
    "k04_bankroll_path",
    f"""with {KELLY},
l as (select contest_ord, 'full' as strategy, fraction as f, price * 0.3 as price, win from kelly where fraction > 0
  union all select contest_ord, 'tenth', fraction / 10, price * 0.3, win from kelly where fraction > 0),
s as (select strategy, contest_ord, list(struct_pack(f := f, g := case when win = 1 then price - 1 else -1 end)) as bets from l group by 1, 2),
o as (select strategy, list(struct_pack(b := 0.0::double, n := 0::double, bets := bets) order by contest_ord) as steps from s group by 1),
z as (select strategy, list_reduce(list_prepend(struct_pack(b := 10000.0::double, n := 0::double, bets := steps[1].bets), steps),
  lambda a, x: struct_pack(
    b := a.b + coalesce(list_sum(list_transform(x.bets, lambda t: case when a.b * t.f >= 5 then a.b * t.f * t.g else 0 end)), 0),
    n := a.n + coalesce(list_sum(list_transform(x.bets, lambda t: case when a.b * t.f >= 5 then 1.0 else 0 end)), 0),
    bets := a.bets)) as r from o)
select strategy, cast(r.n as bigint) as bets, {R('r.b')} as final_bankroll from z""",
    "runs",
)
def k04(spark, sf):
    sized = kelly(spark, sf, "contest_ord").select("contest_ord", "price", "win", "fraction")
    rows = F.array(
        F.struct(F.lit("full").alias("strategy"), F.col("fraction").alias("f")),
        F.struct(F.lit("tenth").alias("strategy"), (F.col("fraction") / 10).alias("f")),
    )
    ledger = sized.select("contest_ord", (F.col("price") * 0.3).alias("price"), "win", F.inline(rows))
    path = policy.bankroll_path(ledger, "strategy", "contest_ord", "f", "price", "win")
    out = policy.bankroll_summary(path, "strategy")
    return out.select("strategy", big("bets").alias("bets"), r4("final_bankroll").alias("final_bankroll"))




@register(
    "k02_j13_core_satellite",
    f"""with {CARD}, e as (select *, {EVP} - 1 as ev, (weight - 105) / 30 as intent from card where n >= 2),
b as (select contest_id, finish_rank, case when price between 4 and 8 and round(ev, 9) >= 0.22 then 1 else 2 end as tier from e
  where (price between 4 and 8 and round(ev, 9) >= 0.22) or (price between 3 and 9 and round(ev, 9) >= 0.12)),
s as (select contest_id, finish_rank, intent from e where price >= 7 and round(intent, 9) >= 0.4),
p as (select b.contest_id, b.finish_rank as banker, s.finish_rank as satellite, tier,
    row_number() over (partition by b.contest_id, b.finish_rank order by round(intent, 9) desc, s.finish_rank) as r
  from b join s on b.contest_id = s.contest_id and b.finish_rank <> s.finish_rank)
select contest_id, cast(banker as bigint) as banker, cast(satellite as bigint) as satellite, cast(tier as bigint) as tier from p where r <= 2""",
    "runs",
)
def k02(spark, sf):
    df = card(spark, sf).withColumns(
        {"ev": F.round(C.ev("p", "price"), 9), "intent": F.round((F.col("weight") - 105) / 30, 9)}
    )
    pairs, _ = policy.core_satellite(df, "contest_id", "finish_rank", "p", "price", "ev", "intent", oversized=views.oversized(spark, sf))
    return pairs.select(*[big(c).alias(c) for c in ("contest_id", "banker", "satellite", "tier")])


AUDIT = f"""{CARD},
audit as (select contest_id, finish_rank as number, milestone, least(p * boost, 0.99) as p, price * mult as price, least(p * boost, 0.99) * price * mult * power(4.0/(price * mult), 1.25) - 1 as ev,
    case when draw = 3 then null else draw * 16.0 end as score, 1 + (price - 1) / 4 as place_price,
    least(p * 2.5, 0.95) * (1 + (price - 1) / 4) as place_ev, draw, track
  from card cross join (values ('T-5m', 1.05, 1.5), ('T-2m', 1.0, 1.8)) m(milestone, mult, boost))"""


def audit(spark, sf):
    """Two milestone frames per contest in the shape of the decision audit."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("milestone"), F.lit(x).alias("mult"), F.lit(b).alias("boost")) for m, x, b in (("T-5m", 1.05, 1.5), ("T-2m", 1.0, 1.8))]
    )
    df = card(spark, sf, "track").select("contest_id", F.col("finish_rank").alias("number"), "p", "price", "draw", "track", F.inline(rows))
    df = df.withColumns(
        {
            "place_price": 1 + (F.col("price") - 1) / 4,
            "place_ev": F.least(F.col("p") * 2.5, F.lit(0.95)) * (1 + (F.col("price") - 1) / 4),
            "score": F.when(F.col("draw") != 3, F.col("draw") * 16.0),
            "p": F.least(F.col("p") * F.col("boost"), F.lit(0.99)),
            "price": F.col("price") * F.col("mult"),
        }
    )
    return df.withColumn("ev", C.ev("p", "price"))


def settled_tickets(spark, sf):
    """Settled tickets of the audit frames; scores are rounded so that ties rank alike everywhere."""
    frame = audit(spark, sf).withColumns({c: F.round(c, 9) for c in ("p", "ev", "place_ev")})
    return policy.settle_audit(frame, views.payouts(spark, sf))


SETTLED = f"""{AUDIT},
we as (select * from audit where round(ev, 9) >= 0.15 and price between 2.2 and 14 and round(p, 9) >= 0.16 and coalesce(score, 50) >= 50),
pe as (select * from audit where round(place_ev, 9) >= 1.15 and place_price >= 1.5 and coalesce(score, 50) >= 50),
wr as (select *, row_number() over (partition by contest_id, milestone order by round(p, 9) desc, number) as r from we),
pr as (select *, row_number() over (partition by contest_id, milestone order by round(place_ev, 9) desc, number) as r from pe),
qp as (select a.contest_id, a.milestone, least(a.number, b.number) || '/' || greatest(a.number, b.number) as combo,
    row_number() over (partition by a.contest_id, a.milestone order by round(a.p, 9) + round(b.p, 9) desc, a.r, b.r) as k
  from wr a join wr b on a.contest_id = b.contest_id and a.milestone = b.milestone and a.r < b.r),
pp as (select a.contest_id, a.milestone, least(a.number, b.number) || '/' || greatest(a.number, b.number) as combo,
    row_number() over (partition by a.contest_id, a.milestone order by round(a.place_ev, 9) + round(b.place_ev, 9) desc, a.r, b.r) as k
  from pr a join pr b on a.contest_id = b.contest_id and a.milestone = b.milestone and a.r < b.r),
t as (select contest_id, milestone, 'WIN' as pool, cast(number as varchar) as combo, price as odds_exec from we
  union all select contest_id, milestone, 'PLACE', cast(number as varchar), place_price from pe
  union all select contest_id, milestone, 'QUINELLA', combo, null from qp where k <= 5
  union all select contest_id, milestone, 'QPL', combo, null from pp where k <= 5),
tk as (select t.*, 100.0 as stake, coalesce(payout * 10, 0) as returned, odds_exec - payout / 10 as slip
  from t left join payouts y on t.contest_id = y.contest_id and t.pool = y.pool and t.combo = y.combo)"""


@register(
    "k06_k07_settle_audit",
    f"""with {SETTLED}
select milestone, pool, {MONEY}, count(slip) as slips, {R('avg(slip)')} as mean_slip from tk group by 1, 2""",
    "runs payouts",
)
def k06(spark, sf):
    settled = policy.with_slippage(settled_tickets(spark, sf))
    slips = [F.count("slippage").alias("slips"), F.avg("slippage").alias("mean_slip")]
    out = aggregates.pnl(settled, ["milestone", "pool"], extra=slips)
    return money(out, "milestone", "pool", big("slips").alias("slips"), r4("mean_slip").alias("mean_slip"))


@register(
    "a18_cohort_ev",
    f"""with {AUDIT}, s as (select *, case when draw = 1 then -0.15 when draw = 2 then 0.1 end as shift,
    case when track like '1%' then 'SLOW' when track like '2%' then 'LONE' end as pace from audit)
select case when shift < 0 then 'penalised' when shift > 0 then 'boosted' else 'untouched' end as cohort, coalesce(pace, 'N/A') as pace,
  count(*) as runners, {R("avg(case when milestone = 'T-5m' then ev end)")} as ev_1, {R("avg(case when milestone = 'T-2m' then ev end)")} as ev_2
from s group by 1, 2""",
    "runs",
)
def a18(spark, sf):
    df = audit(spark, sf).withColumns(
        {
            "shift": F.when(F.col("draw") == 1, -0.15).when(F.col("draw") == 2, 0.1),
            "pace": F.when(F.col("track").startswith("1"), "SLOW").when(F.col("track").startswith("2"), "LONE"),
        }
    )
    out = aggregates.cohort_ev(df, "shift", "pace", "milestone", "ev", ["T-5m", "T-2m"])
    return out.select("cohort", "pace", big("runners").alias("runners"), r4("ev_1").alias("ev_1"), r4("ev_2").alias("ev_2"))


@register(
    "k05_flat_ledger",
    f"""with t as (select contest_id, contest_ord, 'PLACE' as pool, cast(finish_rank as varchar) as combo from runs where price between 3 and 9
  union all select contest_id, contest_ord, 'QPL', '1/' || cast(finish_rank as varchar) from runs where finish_rank between 2 and 4 and price > 8),
s as (select t.*, coalesce(payout, 0) as returned from t left join payouts y on t.contest_id = y.contest_id and t.pool = y.pool and t.combo = y.combo),
c as (select contest_id, contest_ord, count(*) as tickets, cast(count_if(returned > 0) as bigint) as hits, sum(returned) - count(*) * 10 as pnl from s group by 1, 2)
select contest_id, tickets, hits, {R('pnl')} as pnl, {R('10000 + sum(pnl) over (order by contest_ord)')} as bankroll from c""",
    "runs payouts",
)
def k05(spark, sf):
    df = base(spark, sf)
    number = F.col("finish_rank").cast("string")
    tickets_ = topk.union_all(
        df.where("price between 3 and 9").select("contest_id", F.lit("PLACE").alias("pool"), number.alias("combo")),
        df.where("finish_rank between 2 and 4 and price > 8").select("contest_id", F.lit("QPL").alias("pool"), F.concat(F.lit("1/"), number).alias("combo")),
    )
    ranks = df.where("finish_rank = 1").select("contest_id", "contest_ord")
    out = policy.flat_ledger(tickets_, ranks, views.payouts(spark, sf, df), "contest_id", "contest_ord")
    return out.select(
        big("contest_id").alias("contest_id"), big("tickets").alias("tickets"), big("hits").alias("hits"), r4("pnl").alias("pnl"), r4("bankroll").alias("bankroll")
    )


@register(
    "k09_scan_overlays",
    f"""with {CARD}, e as (select *, p * 1.5 as kp, p * 1.5 * price * power(4.0/price, 1.25) - 1 as ev from card)
select contest_id, finish_rank, {R('ev')} as ev, {R('least(greatest(ev / (price - 1) * 0.15, 0), 0.02) * 100')} as kelly_pct
from e where ev > 1.22 - 1 and price between 4.5 and 8 order by e.ev desc, contest_id, finish_rank limit 10""",
    "runs",
)
def k09(spark, sf):
    df = card(spark, sf).withColumns({"kp": F.col("p") * 1.5, "intent": (F.col("weight") - 105) / 30})
    df = df.withColumn("ev", C.ev("kp", "price"))
    # the value band is a ratio threshold: an EV column given as ratio minus 1 is lifted first
    core, _ = policy.scan_overlays(df.withColumn("ratio", F.col("ev") + 1), "contest_id", "finish_rank", "kp", "price", "ratio", "intent", oversized=views.oversized(spark, sf))
    return keyed(core, r4("ev").alias("ev"), r4(F.col("kelly") * 100).alias("kelly_pct"))


@register(
    "k09_overlay_pairs",
    f"""with {CARD}, c as (select * from card where n >= 3), e as (select *, p * 1.5 * price * power(4.0/price, 1.25) as ratio, round((weight - 105) / 30, 9) as intent from c),
b as (select contest_id, finish_rank from e where (price between 4 and 8 and ratio >= 0.22) or (price between 3 and 9 and ratio >= 0.12)),
s as (select contest_id, finish_rank, intent from e where price >= 7 and intent >= 0.4),
l as (select b.contest_id, b.finish_rank as x, s.finish_rank as y, row_number() over (partition by b.contest_id, b.finish_rank order by intent desc, s.finish_rank) as r
  from b join s on b.contest_id = s.contest_id and b.finish_rank <> s.finish_rank),
m as (select * from l where r <= 2),
tr as (select a.contest_id, a.finish_rank as i, b.finish_rank as j, d.finish_rank as k, a.p / (1-a.p) * b.p / (1-a.p-b.p) * d.p as v, a.q / (1-a.q) * b.q / (1-a.q-b.q) * d.q as u
  from c a join c b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank join c d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)),
t3 as (select m.contest_id, x, y, sum(v) as model, sum(u) as market from m join tr on m.contest_id = tr.contest_id and (i = x or j = x or k = x) and (i = y or j = y or k = y) group by 1, 2, 3)
select contest_id, cast(x as bigint) as banker, cast(y as bigint) as satellite, {R('model')} as model_qp3, {R('market')} as market_qp3, {R('model / market - 1')} as edge
from t3 order by t3.model / t3.market desc, contest_id, x, y limit 10""",
    "runs",
)
def k09_pairs(spark, sf):
    """The best banker and satellite pairs of the day, priced under the model and the market."""
    df = card(spark, sf).where("n >= 3").withColumns({"kp": F.col("p") * 1.5, "intent": F.round((F.col("weight") - 105) / 30, 9)})
    df = df.withColumn("ratio", C.ev("kp", "price") + 1)
    _, pairs = policy.scan_overlays(df, "contest_id", "finish_rank", "kp", "price", "ratio", "intent", oversized=views.oversized(spark, sf))
    return pairs.select(*[big(c).alias(c) for c in ("contest_id", "banker", "satellite")], *[r4(c).alias(c) for c in ("model_qp3", "market_qp3", "edge")])


@register(
    "k12_value_bets",
    f"""with {CARD}, e as (select *, p * 1.5 * price * power(4.0/price, 1.25) - 1 as ev from card),
c as (select max(contest_id) as contest_id from e where ev > 0)
select contest_id, finish_rank, {R('ev')} as ev from e join c using (contest_id) where ev > 0 order by e.ev desc, finish_rank limit 5""",
    "runs",
)
def k12(spark, sf):
    df = card(spark, sf).withColumn("ev", C.ev(F.col("p") * 1.5, "price"))
    newest = df.where("ev > 0").agg(F.max("contest_id")).scalar()
    return keyed(policy.value_bets(df, "contest_id", newest, "ev", 5, ["finish_rank"]), r4("ev").alias("ev"))


@register(
    "t01_t05_t06_orders",
    f"""with {KELLY}, e as (select contest_id, finish_rank, fraction, case when finish_rank % 5 > 0 then round(evr, 9) end as ev from kelly)
select contest_id, finish_rank, {R('ev')} as ev_ratio,
  row_number() over (order by case when fraction > 0.01 then 0 else 1 end, ev desc nulls last, contest_id, finish_rank) as place,
  row_number() over (order by ev desc nulls last, contest_id, finish_rank) as plain_place,
  row_number() over (order by contest_id, finish_rank) as time_place from e""",
    "runs",
)
def t05(spark, sf):
    """All plays with their place in conviction order, by expected value (some are NULL) and in time."""
    tier, known = F.when(F.col("fraction") > 0.01, "HIGH").otherwise("MED"), F.when(F.col("finish_rank") % 5 > 0, F.round("ev_ratio", 9))
    df = kelly(spark, sf).withColumn("tier", tier).withColumn("ev_ratio", known)
    ties = ("contest_id", "finish_rank")
    out = topk.placed(df, topk.conviction("tier", "ev_ratio", *ties))
    out = topk.placed(out, [F.col("ev_ratio").desc_nulls_last(), *[F.col(t).asc() for t in ties]], "plain_place")
    out = topk.placed(out, [F.col(t).asc() for t in ties], "time_place")
    return keyed(out, r4("ev_ratio").alias("ev_ratio"), *[big(c).alias(c) for c in ("place", "plain_place", "time_place")])
