"""Queries of the field probability operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.catalog.history import R, base, keyed
from contestframe.functions import columns as C
from contestframe.operators import field
from contestframe.scale import attach
from contestframe.sources.views import oversized, payouts

CARD = """card as (select *, (1.0/(draw+2)) / sum(1.0/(draw+2)) over (partition by contest_id) as p,
    (1/price) / sum(1/price) over (partition by contest_id) as q,
    count(*) over (partition by contest_id) as n from runs)"""
GAMMA = "0.75 + least(greatest((n - 4) / 10.0, 0), 1) * 0.13"
POWERED = f"""{CARD},
gp as (select *, power(greatest(p, 1e-12), {GAMMA}) as g from card),
w as (select *, sum(g) over (partition by contest_id) as s from gp)"""
DEVIG = """s as (select contest_id, list(1/price) as ql,
    case when sum(power(1/price, 2)) <= 1 and sum(power(1/price, 0.01)) >= 1 then 1 else 0 end as ok
  from runs group by contest_id),
b as (select contest_id, ok, list_reduce(list_prepend(struct_pack(lo := 0.01::double, hi := 2.0::double),
        list_transform(range(60), lambda i: struct_pack(lo := i::double, hi := 0.0::double))),
        lambda a, x: case when list_sum(list_transform(ql, lambda v: power(v, (a.lo + a.hi) / 2))) > 1
          then struct_pack(lo := (a.lo + a.hi) / 2, hi := a.hi)
          else struct_pack(lo := a.lo, hi := (a.lo + a.hi) / 2) end) as r from s)"""


def neutral():
    """Tie order that says nothing about the result: a hash of the row's key."""
    return F.md5(F.concat_ws(":", F.col("contest_id").cast("string"), F.col("finish_rank").cast("string")))


def card(spark, sf, *extra):
    """Runs with a model vector p from the draw and a market vector q from the price."""
    df = base(spark, sf).select("contest_id", "finish_rank", "draw", "price", "weight", "elapsed", "win", *extra)
    df = df.withColumns({"_a": 1.0 / (F.col("draw") + 2), "_b": 1 / F.col("price")})
    df = attach(df, ["contest_id"], {"_sa": F.sum("_a"), "_sb": F.sum("_b"), "n": F.count(F.lit(1))}, "window")
    return df.withColumns({"p": F.col("_a") / F.col("_sa"), "q": F.col("_b") / F.col("_sb")}).drop("_a", "_b", "_sa", "_sb")


@register(
    "f01_normalise",
    f"""select contest_id, finish_rank, {R('(1/price) / sum(1/price) over (partition by contest_id)')} as market from runs""",
    "runs",
)
def f01(spark, sf):
    df = base(spark, sf).withColumn("imp", 1 / F.col("price"))
    return keyed(field.normalise(df, "contest_id", "imp", "market", how="join"), r4("market").alias("market"))


@register(
    "f02_devig_power",
    f"""with {DEVIG}
select runs.contest_id, finish_rank, {R('''case when ok = 0 then (1/price) / sum(1/price) over (partition by runs.contest_id)
  else power(1/price, (r.lo + r.hi) / 2) end''')} as market from runs join b on runs.contest_id = b.contest_id""",
    "runs",
)
def f02(spark, sf):
    return keyed(field.devig_power(base(spark, sf), "contest_id", "price", "market"), r4("market").alias("market"))


@register(
    "x02_devig_alpha",
    f"""with {DEVIG} select contest_id, {R('case when ok = 1 then (r.lo + r.hi) / 2 end')} as alpha from b""",
    "runs",
)
def x02(spark, sf):
    out = field.devig_alpha(base(spark, sf), "contest_id", "price")
    return out.select(big("contest_id").alias("contest_id"), r4("_alpha").alias("alpha"))


@register(
    "f03_softmax",
    f"""with e as (select *, exp((weight - max(weight) over (partition by contest_id)) / 10 / 1.5) as x from runs)
select contest_id, finish_rank, {R('x / sum(x) over (partition by contest_id)')} as prob from e""",
    "runs",
)
def f03(spark, sf):
    df = base(spark, sf).withColumn("z", F.col("weight") / 10)
    return keyed(field.softmax(df, "contest_id", "z", "prob", tau=1.5, how="join"), r4("prob").alias("prob"))


@register(
    "f04_fuse",
    f"""with {CARD},
z as (select *, case when draw = 3 then ln(q/(1-q)) else 0.4 * ln(p/(1-p)) + 0.6 * ln(q/(1-q)) end
    + case when finish_rank = 2 then 0.35 else 0 end as z from card where n > 1),
e as (select *, exp(z - max(z) over (partition by contest_id)) as x from z)
select contest_id, finish_rank, {R('x / sum(x) over (partition by contest_id)')} as fused from e""",
    "runs",
)
def f04(spark, sf):
    df = card(spark, sf).where("n > 1").withColumn("pm", F.when(F.col("draw") != 3, F.col("p")))
    delta = F.when(F.col("finish_rank") == 2, 0.35).otherwise(0.0)
    return keyed(field.fuse(df, "contest_id", "pm", "q", F.lit(0.6), "fused", delta), r4("fused").alias("fused"))


MOVES = """mv as (select *, case when draw = 2 then null else price * (1 + (draw - 3) / 20.0) end as open_price,
    price * (1 + (finish_rank - 2) / 15.0) as recent_price from runs)"""


def moves(spark, sf):
    """Runs with an opening and a recent price beside the current one."""
    return base(spark, sf).withColumns(
        {
            "open_price": F.when(F.col("draw") != 2, F.col("price") * (1 + (F.col("draw") - 3) / 20.0)),
            "recent_price": F.col("price") * (1 + (F.col("finish_rank") - 2) / 15.0),
        }
    )


@register(
    "f05_f06_flow_score",
    f"""with {MOVES},
d as (select *, 1/price - 1/open_price as d1, 1/price - 1/recent_price as d2 from mv),
s as (select *, coalesce(least(greatest(50 + 200 * (d1 - avg(d1) over (partition by contest_id)), 0), 100)
      + 0 * d1, 50) as s1,
    least(greatest(50 + 200 * (d2 - avg(d2) over (partition by contest_id)), 0), 100) as s2 from d),
o as (select *, case when abs(s2 - 50) > abs(s1 - 50) then s2 else s1 end as score from s)
select contest_id, finish_rank, {R('s1')} as open_score, {R('s2')} as recent_score,
  {R('score')} as score, case when score >= 75 then 'STEAMER' when score < 40 then 'DRIFTER' else 'STABLE' end as label
from o""",
    "runs",
)
def f05(spark, sf):
    df = field.flow_score(moves(spark, sf), "contest_id", "price", "open_price", "s1", how="join")
    df = field.flow_score(df, "contest_id", "price", "recent_price", "s2", how="join")
    df = df.withColumn("score", field.overlay_score("s1", "s2"))
    return keyed(
        df, r4("s1").alias("open_score"), r4("s2").alias("recent_score"), r4("score").alias("score"),
        C.flow_label("score").alias("label"),
    )


@register(
    "f07_flow_update",
    f"""with {CARD},
z as (select *, ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12)))
    + 0.2 * (draw * 15 - 50) / 50.0 as z from card),
e as (select *, exp(z - max(z) over (partition by contest_id)) as x from z),
l as (select *, x / sum(x) over (partition by contest_id) as lp from e)
select contest_id, finish_rank, {R('lp')} as live_prob,
  {R('lp * price * least(power(4.0/price, 1.25), 1) - 1')} as live_ev, {R('lp - q')} as live_edge from l""",
    "runs",
)
def f07(spark, sf):
    df = card(spark, sf).withColumn("score", F.col("draw") * 15.0)
    df = field.flow_update(df, "contest_id", "p", "score", "price")
    return keyed(df, *[r4(c).alias(c) for c in ("live_prob", "live_ev", "live_edge")])


@register(
    "f08_field_prior",
    f"""with {CARD},
k as (select *, case when draw <= 4 then p end as lp from card),
c as (select *, avg(case when lp is null then 0 else 1 end) over (partition by contest_id) as known from k),
e as (select *, case when known >= 0.5 then power(lp, 1/1.75) end as x from c)
select contest_id, finish_rank, {R('x / sum(x) over (partition by contest_id)')} as prior from e""",
    "runs",
)
def f08(spark, sf):
    df = card(spark, sf).withColumn("lp", F.when(F.col("draw") <= 4, F.col("p")))
    return keyed(field.field_prior(df, "contest_id", "lp", "prior"), r4("prior").alias("prior"))


@register(
    "f09_pace_adjust",
    f"""with {CARD},
t as (select *, case when draw <= 2 then 'Leader' when draw <= 4 then 'Stalker' else 'Closer' end as style,
    case when draw % 2 = 0 then 1.2 else 0.9 end as mult from card),
l as (select *, sum(case when style = 'Leader' then 1 else 0 end) over (partition by contest_id) as leaders from t),
a as (select *, mult * case when leaders >= 3 then case style when 'Leader' then -0.15 when 'Closer' then 0.10 else 0 end
    when leaders = 1 then case style when 'Leader' then 0.2 else 0 end
    when leaders = 0 and track like '1%' then case when style = 'Closer' and draw >= 8 then -0.15 else 0 end
    else 0 end as shift from l),
m as (select *, 1/(1+exp(-(ln(least(p, 1 - 1e-12)/(1-least(p, 1 - 1e-12))) + shift))) as mp,
    max(case when shift <> 0 then 1 else 0 end) over (partition by contest_id) as any_shift from a)
select contest_id, finish_rank, case when leaders >= 3 then 'MELTDOWN' when leaders = 1 then 'LONE'
    when leaders = 0 then 'SLOW' else 'NORMAL' end as pace, cast(leaders as bigint) as pace_leaders, {R('shift')} as pace_shift,
  {R('case when any_shift = 1 then mp / sum(mp) over (partition by contest_id) else p end')} as adjusted from m""",
    "runs",
)
def f09(spark, sf):
    df = card(spark, sf, "track").withColumns(
        {
            "style": F.when(F.col("draw") <= 2, "Leader").when(F.col("draw") <= 4, "Stalker").otherwise("Closer"),
            "mult": F.when(F.col("draw") % 2 == 0, 1.2).otherwise(0.9),
            "venue": F.when(F.col("track").startswith("1"), "HV").otherwise("ST"),
        }
    )
    df = field.pace_adjust(df, "contest_id", "p", "style", "draw", F.col("venue"), F.col("mult"), "adjusted")
    return keyed(
        df, "pace", big("pace_leaders").alias("pace_leaders"), r4("pace_shift").alias("pace_shift"), r4("adjusted").alias("adjusted")
    )


@register(
    "f10_rank2",
    f"""with {POWERED}
select contest_id, finish_rank, {R('case when n >= 2 then g * (sum(p/(s-g)) over (partition by contest_id) - p/(s-g)) end')} as p_rank2
from w""",
    "runs",
)
def f10(spark, sf):
    return keyed(field.rank2(card(spark, sf), "contest_id", "p", "p_rank2"), r4("p_rank2").alias("p_rank2"))


@register(
    "f11_f13_rank3",
    f"""with {POWERED},
r2 as (select b.contest_id, b.finish_rank, sum(a.p / (a.s - a.g) * b.g) as r2 from w a join w b
  on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank group by 1, 2),
r3 as (select d.contest_id, d.finish_rank, sum(a.p / (a.s - a.g) * b.g / (a.s - a.g - b.g) * d.g) as r3
  from w a join w b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join w d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank) group by 1, 2)
select w.contest_id, w.finish_rank, {R('p')} as p_rank1, {R('r2')} as p_rank2, {R('r3')} as p_rank3,
  {R('p + r2')} as p_top2, {R('p + r2 + r3')} as p_top3
from w left join r2 using (contest_id, finish_rank) left join r3 using (contest_id, finish_rank)""",
    "runs",
)
def f11(spark, sf):
    out = field.rank3(card(spark, sf), "contest_id", "finish_rank", "p", oversized=oversized(spark, sf))
    return keyed(out, *[r4(c).alias(c) for c in ("p_rank1", "p_rank2", "p_rank3", "p_top2", "p_top3")])


@register(
    "f12_rank4",
    f"""with {POWERED},
r4 as (select x.contest_id, x.finish_rank,
    sum(a.p / (a.s-a.g) * b.g / (a.s-a.g-b.g) * d.g / (a.s-a.g-b.g-d.g) * x.g) as r4
  from w a join w b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join w d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)
  join w x on a.contest_id = x.contest_id and x.finish_rank not in (a.finish_rank, b.finish_rank, d.finish_rank)
  group by 1, 2)
select w.contest_id, w.finish_rank, {R('r4')} as p_rank4 from w left join r4 using (contest_id, finish_rank)""",
    "runs",
)
def f12(spark, sf):
    return keyed(field.rank4(card(spark, sf), "contest_id", "finish_rank", "p", oversized=oversized(spark, sf)), r4("p_rank4").alias("p_rank4"))


HARVILLE = f"""{CARD},
pl as (select b.contest_id, b.finish_rank, sum(a.p / (1 - a.p) * b.p) as r2 from card a join card b
  on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank group by 1, 2),
pk as (select d.contest_id, d.finish_rank, sum(a.p / (1 - a.p) * b.p / (1 - a.p - b.p) * d.p) as r3
  from card a join card b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join card d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank) group by 1, 2),
ph as (select card.*, coalesce(r2, 0) as r2, coalesce(r3, 0) as r3 from card
  left join pl using (contest_id, finish_rank) left join pk using (contest_id, finish_rank))"""


@register(
    "f14_f18_place_harville",
    f"""with {HARVILLE}
select contest_id, finish_rank, {R('p + r2')} as place2, {R('p + r2 + r3')} as place3,
  {R('0.825 / greatest(p + r2 + r3, 1e-9)')} as payout from ph""",
    "runs",
)
def f14(spark, sf):
    df = card(spark, sf)
    out = field.place_harville(df, "contest_id", "finish_rank", "p", "place2", places=2)
    out = field.place_harville(out, "contest_id", "finish_rank", "p", "place3", oversized=oversized(spark, sf))
    return keyed(out, r4("place2").alias("place2"), r4("place3").alias("place3"), r4(field.place_payout("place3")).alias("payout"))


@register(
    "f15_f16_listed_pairs",
    f"""with {POWERED},
pr as (select * from (values (1, 2), (1, 3), (2, 3)) t(x, y)),
pq as (select a.contest_id, x, y, a.n, a.p / (a.s - a.g) * b.g + b.p / (b.s - b.g) * a.g as q
  from pr join w a on a.finish_rank = x join w b on a.contest_id = b.contest_id and b.finish_rank = y),
tr as (select a.contest_id, a.finish_rank as i, b.finish_rank as j, d.finish_rank as k,
    a.p / (a.s-a.g) * b.g / (a.s-a.g-b.g) * d.g as v
  from w a join w b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join w d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)),
t3 as (select contest_id, x, y, sum(v) as qp3 from pr join tr
  on (i = x or j = x or k = x) and (i = y or j = y or k = y) group by 1, 2, 3)
select pq.contest_id, cast(pq.x as bigint) as leg_a, cast(pq.y as bigint) as leg_b, {R('q')} as quinella,
  {R('case when n >= 7 then qp3 else q end')} as both_k, {R('case when n = 2 then q else qp3 end')} as both_top3
from pq left join t3 on pq.contest_id = t3.contest_id and pq.x = t3.x and pq.y = t3.y where n > 2""",
    "runs",
)
def f15(spark, sf):
    """The payout pools' pairs (first three finishers) priced by the model."""
    df = card(spark, sf).where("n > 2")
    legs = df.where("finish_rank <= 3").groupBy("contest_id").agg(F.max("finish_rank").alias("_top"))
    listed = F.array(*[F.struct(F.lit(a).alias("leg_a"), F.lit(b).alias("leg_b")) for a, b in ((1, 2), (1, 3), (2, 3))])
    pairs = legs.select("contest_id", F.inline(listed))
    out = field.price_pairs(pairs, df, "contest_id", "finish_rank", "leg_a", "leg_b", {"m": "p"}, oversized=oversized(spark, sf))
    return out.select(
        big("contest_id").alias("contest_id"), big("leg_a").alias("leg_a"), big("leg_b").alias("leg_b"),
        r4("m_q").alias("quinella"), r4("m_qp").alias("both_k"), r4("m_qp3").alias("both_top3"),
    )


@register(
    "f17_combo_table",
    f"""with {HARVILLE},
pr as (select distinct contest_id, cast(split_part(combo, '/', 1) as bigint) as x, cast(split_part(combo, '/', 2) as bigint) as y from payouts where pool in ('QUINELLA', 'QPL')),
pq as (select a.contest_id, x, y, a.p / (1 - a.p) * b.p + b.p / (1 - b.p) * a.p as q
  from pr join card a on pr.contest_id = a.contest_id and a.finish_rank = x join card b on a.contest_id = b.contest_id and b.finish_rank = y where a.n > 2),
tr as (select a.contest_id, a.finish_rank as i, b.finish_rank as j, d.finish_rank as k,
    a.p / (1-a.p) * b.p / (1-a.p-b.p) * d.p as v
  from card a join card b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join card d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)),
t3 as (select tr.contest_id, x, y, sum(v) as qp3 from pr join tr
  on pr.contest_id = tr.contest_id and (i = x or j = x or k = x) and (i = y or j = y or k = y) group by 1, 2, 3)
select contest_id, 'PLACE' as pool, cast(finish_rank as bigint) as leg_a, cast(null as bigint) as leg_b,
  {R('p + r2 + r3')} as probability from ph where n > 2
union all select contest_id, 'QUINELLA', x, y, {R('q')} from pq
union all select contest_id, 'QPL', x, y, {R('qp3')} from t3""",
    "runs payouts",
)
def f17(spark, sf):
    """Place and both pair pools, for every pair that the payouts list."""
    df = card(spark, sf).where("n > 2")
    legs = F.split("combo", "/")
    paid = payouts(spark, sf, df).where(F.col("pool").isin("QUINELLA", "QPL"))
    pairs = paid.select("contest_id", F.get(legs, F.lit(0)).cast("int").alias("leg_a"), F.get(legs, F.lit(1)).cast("int").alias("leg_b")).distinct()
    out = field.combo_table(pairs, df, "contest_id", "finish_rank", "p", oversized(spark, sf))
    return out.select(
        big("contest_id").alias("contest_id"), "pool", big("leg_a").alias("leg_a"), big("leg_b").alias("leg_b"),
        r4("probability").alias("probability"),
    )


@register(
    "f19_place_ev",
    f"""with {POWERED},
r2 as (select b.contest_id, b.finish_rank, sum(a.p / (a.s - a.g) * b.g) as r2 from w a join w b
  on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank group by 1, 2),
r3 as (select d.contest_id, d.finish_rank, sum(a.p / (a.s - a.g) * b.g / (a.s - a.g - b.g) * d.g) as r3
  from w a join w b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank
  join w d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank) group by 1, 2),
x as (select w.*, case when n >= 7 then p + r2 + r3 when n >= 4 then p + r2 end as pp
  from w left join r2 using (contest_id, finish_rank) left join r3 using (contest_id, finish_rank))
select contest_id, finish_rank, {R('pp')} as place_prob, {R('pp * (1 + (price - 1) / 4)')} as place_ev from x""",
    "runs",
)
def f19(spark, sf):
    out = field.rank3(card(spark, sf), "contest_id", "finish_rank", "p", oversized=oversized(spark, sf)).withColumn("pp", 1 + (F.col("price") - 1) / 4)
    prob, value = field.place_ev("n", "p_top2", "p_top3", "pp")
    return keyed(out, r4(prob).alias("place_prob"), r4(value).alias("place_ev"))


@register(
    "f20_absorption",
    f"""with {CARD},
r as (select *, (1 / (1 + (price - 1) / (3 + draw % 3))) as ip from card),
x as (select *, ip / sum(ip) over (partition by contest_id) / p as ratio from r),
m as (select *, median(ratio) over (partition by contest_id) as med from x)
select contest_id, finish_rank, cast(case when n >= 2 and ratio >= 1.5 * med - 1e-9 then 1 else 0 end as bigint) as absorbed,
  {R('ratio')} as ratio from m""",
    "runs",
)
def f20(spark, sf):
    df = card(spark, sf).withColumn("pp", 1 + (F.col("price") - 1) / (3 + F.col("draw") % 3))
    out = field.absorption(df, "contest_id", "p", "pp", "absorbed")
    out = attach(out.withColumn("_i", 1 / F.col("pp")), ["contest_id"], {"_is": F.sum("_i")})
    return keyed(out, big("absorbed").alias("absorbed"), r4(F.col("_i") / F.col("_is") / F.col("p")).alias("ratio"))


def _sums_sql(p: str, tag: str) -> str:
    """Henery triples of one probability vector, brute force."""
    return f"""g{tag} as (select contest_id, finish_rank, n, {p} as p, power(greatest({p}, 1e-12), {GAMMA}) as g from card where n > 1),
w{tag} as (select *, sum(g) over (partition by contest_id) as s from g{tag}),
q{tag} as (select a.contest_id, a.finish_rank as x, b.finish_rank as y, a.n,
    a.p / (a.s-a.g) * b.g + b.p / (b.s-b.g) * a.g as q from w{tag} a join w{tag} b
  on a.contest_id = b.contest_id and a.finish_rank < b.finish_rank),
v{tag} as (select a.contest_id, a.finish_rank as i, b.finish_rank as j, d.finish_rank as k,
    a.p / (a.s-a.g) * b.g / (a.s-a.g-b.g) * d.g as v
  from w{tag} a join w{tag} b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank and a.n >= 7
  join w{tag} d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)),
e{tag} as (select contest_id, least(i, j) as x, greatest(i, j) as y, v from v{tag}
  union all select contest_id, least(i, k), greatest(i, k), v from v{tag}
  union all select contest_id, least(j, k), greatest(j, k), v from v{tag}),
t{tag} as (select contest_id, x, y, sum(v) as qp from e{tag} group by 1, 2, 3)"""


@register(
    "f21_overlay_pairs",
    f"""with {CARD}, {_sums_sql('p', 'm')}, {_sums_sql('q', 'k')},
j as (select qm.contest_id, qm.x, qm.y, qm.q / qk.q - 1 as q_edge,
    case when qm.n >= 7 then tm.qp / tk.qp - 1 else qm.q / qk.q - 1 end as qp_edge
  from qm join qk using (contest_id, x, y)
  left join tm on qm.contest_id = tm.contest_id and qm.x = tm.x and qm.y = tm.y
  left join tk on qm.contest_id = tk.contest_id and qm.x = tk.x and qm.y = tk.y),
s as (select j.*, greatest(q_edge, qp_edge) as best from j
  join card a on a.contest_id = j.contest_id and a.finish_rank = x
  join card b on b.contest_id = j.contest_id and b.finish_rank = y
  where greatest(a.draw * 12, b.draw * 12) >= 50),
r as (select *, row_number() over (partition by contest_id order by best desc, x, y) as rank from s where best >= 0.25)
select contest_id, cast(x as bigint) as leg_a, cast(y as bigint) as leg_b, rank, {R('q_edge')} as q_edge,
  {R('qp_edge')} as qp_edge from r where rank <= 5""",
    "runs",
)
def f21(spark, sf):
    df = card(spark, sf).withColumn("score", F.col("draw") * 12.0)
    out = field.overlay_pairs(df, "contest_id", "finish_rank", "p", "price", "score", oversized(spark, sf))
    return out.select(
        big("contest_id").alias("contest_id"), big("leg_a").alias("leg_a"), big("leg_b").alias("leg_b"),
        big("rank").alias("rank"), r4("q_edge").alias("q_edge"), r4("qp_edge").alias("qp_edge"),
    )


@register(
    "f22_core_intent",
    f"""with {CARD},
tm as (select a.contest_id, a.finish_rank as i, b.finish_rank as j, d.finish_rank as k,
    a.p / (1-a.p) * b.p / (1-a.p-b.p) * d.p as m, a.q / (1-a.q) * b.q / (1-a.q-b.q) * d.q as v
  from card a join card b on a.contest_id = b.contest_id and a.finish_rank <> b.finish_rank and a.n >= 4
  join card d on a.contest_id = d.contest_id and d.finish_rank not in (a.finish_rank, b.finish_rank)),
it as (select contest_id, arg_max(finish_rank, weight * 100 - finish_rank) as y from card where n >= 4 group by 1),
pr as (select c.contest_id, c.finish_rank as x, y from card c join it using (contest_id)
  where c.price between 4.5 and 8 and c.finish_rank <> y),
sm as (select pr.contest_id, x, y, sum(m) as qm, sum(v) as qk from pr join tm on pr.contest_id = tm.contest_id
  and (i = x or j = x or k = x) and (i = y or j = y or k = y) group by 1, 2, 3)
select contest_id, cast(x as bigint) as leg_a, cast(y as bigint) as leg_b, {R('qm')} as qp_model,
  {R('qk')} as qp_market, {R('qm / qk - 1')} as qp_edge, {R('0.75 / qk')} as est_payout from sm where qm / qk - 1 >= 0.15""",
    "runs",
)
def f22(spark, sf):
    df = card(spark, sf).withColumn("intent", F.col("weight") * 100 - F.col("finish_rank"))
    out = field.core_intent(df, "contest_id", "finish_rank", "p", "price", "intent", oversized(spark, sf))
    return out.select(
        big("contest_id").alias("contest_id"), big("leg_a").alias("leg_a"), big("leg_b").alias("leg_b"),
        *[r4(c).alias(c) for c in ("qp_model", "qp_market", "qp_edge", "est_payout")],
    )


@register(
    "f23_f24_velocity_delta",
    f"""with {MOVES},
{CARD},
v as (select mv.*, card.p, card.q, (mv.price - recent_price) / recent_price as vel,
    case when mv.price > 1 and recent_price > 1 then ln((mv.price - 1) / (recent_price - 1)) end as lv,
    mv.price / (1 + (mv.price - 1) / 4) < recent_price / (1 + (recent_price - 1) / 4) as contracted
  from mv join card using (contest_id, finish_rank)),
d as (select *, coalesce(lv <= ln(0.85) and contracted, false) as steam, coalesce(round(p, 9) > 0.3 and round(q, 9) < 0.09, false) as trap from v)
select contest_id, finish_rank, {R('vel')} as velocity, {R('lv')} as logit_velocity,
  cast(case when steam then 1 else 0 end as bigint) as steam, cast(case when trap then 1 else 0 end as bigint) as trap,
  {R('''case when steam then 0.1 + 0.25 * least(abs(vel) / 0.15, 1) else 0 end + case when trap then -1.5 else 0 end''')} as delta
from d""",
    "runs",
)
def f23(spark, sf):
    df = moves(spark, sf).select("contest_id", "finish_rank", "recent_price").join(card(spark, sf), ["contest_id", "finish_rank"])
    df = df.withColumns({"pp": 1 + (F.col("price") - 1) / 4, "rp": 1 + (F.col("recent_price") - 1) / 4})
    df = df.withColumns(field.velocity("price", "recent_price", "pp", "rp"))
    delta, steam, trap = field.flow_delta(
        F.col("velocity"), F.col("logit_velocity"), F.col("contracted"), F.round("p", 9), F.round("q", 9), F.lit(60.0)
    )
    return keyed(
        df, r4("velocity").alias("velocity"), r4("logit_velocity").alias("logit_velocity"),
        big(steam).alias("steam"), big(trap).alias("trap"), r4(delta).alias("delta"),
    )


@register(
    "f26_score_to_prob",
    f"""with s as (select *, case when draw <> 2 then weight / 100 end as score from runs),
f as (select *, coalesce(score, min(score) over (partition by contest_id) / 2) as filled from s)
select contest_id, finish_rank, {R('filled / (sum(filled) over (partition by contest_id) + 1e-9)')} as prob from f""",
    "runs",
)
def f26(spark, sf):
    df = base(spark, sf).withColumn("score", F.when(F.col("draw") != 2, F.col("weight") / 100))
    return keyed(field.score_to_prob(df, "contest_id", "score", "prob"), r4("prob").alias("prob"))
