"""Queries of the column functions over the runs view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.catalog.history import R, base, keyed
from contestframe.functions import columns as C
from contestframe.functions.sql import register_functions
from contestframe.sources import stores, views

TOKEN = """tok as (select *, case when draw = 7 then 'DNF' when draw = 6 then '' when draw = 5 then 'WV-A'
  when win = 1 and draw % 2 = 0 then '1 DH' when draw = 4 then cast(finish_rank as varchar) || '0' else cast(finish_rank as varchar) end as pos from runs)"""


def tokens(spark, sf):
    rank = F.col("finish_rank").cast("string")
    pos = (
        F.when(F.col("draw") == 7, "DNF").when(F.col("draw") == 6, "").when(F.col("draw") == 5, "WV-A")
        .when((F.col("win") == 1) & (F.col("draw") % 2 == 0), "1 DH").when(F.col("draw") == 4, F.concat(rank, F.lit("0"))).otherwise(rank)
    )
    return base(spark, sf).withColumn("pos", pos)


@register(
    "p01_p05_finish_tokens",
    f"""with {TOKEN}, r as (select *, try_cast(nullif(regexp_extract(pos, '^(\\d+)', 1), '') as integer) as rk from tok
  where regexp_matches(split_part(pos, ' ', 1), '^[0-9]+$'))
select contest_id, finish_rank, pos, cast(rk as bigint) as parsed, cast(case when regexp_matches(pos, '^1(\\s|$)') then 1 else 0 end as bigint) as is_win,
  cast(case when rk <= 3 then 1 else 0 end as bigint) as is_place,
  cast(case rk when 1 then 3 when 2 then 2 when 3 then 1 else 0 end as bigint) as relevance from r""",
    "runs",
)
def p01(spark, sf):
    df = C.finishers(tokens(spark, sf), "pos")
    rank = C.finish_rank("pos")
    return keyed(
        df, "pos", big(rank).alias("parsed"), big(C.is_win("pos")).alias("is_win"), big(C.is_place(rank)).alias("is_place"),
        big(C.relevance(rank)).alias("relevance"),
    )


@register(
    "p02_p08_ids_dates",
    f"""select contest_id, finish_rank, strftime(contest_date, '%Y-%m-%d') || '_Race' || draw as cid, strftime(contest_date, '%Y-%m-%d') as day,
  cast(draw as bigint) as number, {R('price')} as price_num,
  strftime(contest_date, '%Y-%m-%d') || '_' || track || '_' || distance || '_Class ' || draw as fallback,
  cast((year(contest_date) * 10000 + month(contest_date) * 100 + day(contest_date)) * 1000 + draw as bigint) as ord from runs""",
    "runs",
)
def p02(spark, sf):
    df = base(spark, sf).withColumn("cid", C.contest_id("contest_date", "draw"))
    day, number = C.contest_parts("cid")
    # three written forms of the same date
    text = F.when(F.col("draw") % 3 == 0, F.date_format("contest_date", "yyyy/MM/dd")).when(
        F.col("draw") % 3 == 1, F.date_format("contest_date", "yyyyMMdd")
    ).otherwise(F.date_format("contest_date", "yyyy-MM-dd"))
    df = df.withColumns({"day_a": day, "number": number, "day_b": C.norm_date(text)}).where("day_a = day_b")
    klass = F.concat(F.lit("Class "), F.col("draw").cast("string"))
    return keyed(
        df, "cid", F.date_format("day_b", "yyyy-MM-dd").alias("day"), big("number").alias("number"),
        r4(C.to_num(F.concat(F.lit(" "), F.col("price").cast("string")), 4)).alias("price_num"),
        C.contest_id_fallback("contest_date", "track", "distance", klass).alias("fallback"), big(C.contest_ord("contest_date", "draw")).alias("ord"),
    )


@register(
    "p09_entrant_code",
    """select cast(l_partkey as bigint) as part, dense_rank() over (order by 'P' || l_partkey) - 1 as code from (select distinct l_partkey from lineitem)""",
)
def p09(spark, sf):
    parts = views.table(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), "l_partkey")
    out = stores.entrant_codes(parts, "name", "code").select("l_partkey", "code").distinct()
    return out.select(big("l_partkey").alias("part"), big("code").alias("code"))


@register(
    "p10_p15_weights_ratings",
    f"""with t as (select *, case when draw % 3 = 0 then draw else 0 end as inl, case when draw % 2 = 0 then case when finish_rank * 20 < 20 then 10
    when finish_rank * 20 < 45 then 7 when finish_rank * 20 < 70 then 5 when finish_rank * 20 < 95 then 3 else 0 end else 0 end as lad,
    1 + draw % 5 as cls from runs),
c as (select *, coalesce(nullif(inl, 0), nullif(lad, 0), nullif(finish_rank, 0), 0) as claim,
  case cls when 1 then 105 when 2 then 100 when 3 then 80 when 4 then 60 else 40 end as top, case when cls in (1, 5) then 15 else 20 end as width from t)
select contest_id, finish_rank, cast(claim as bigint) as claim, {R('weight + claim')} as declared, cast(cls as bigint) as class_num,
  cast(60 + draw as bigint) as band_max, {R('round(top - width + least(greatest(weight - 115, 0), 20) / 20 * width, 1)')} as implied from c""",
    "runs",
)
def p10(spark, sf):
    draw = F.col("draw").cast("string")
    rider = F.when(F.col("draw") % 3 == 0, F.concat(F.lit("A Rider (-"), draw, F.lit(")"))).otherwise("A Rider")
    ladder = F.when(F.col("draw") % 2 == 0, C.claim_ladder(F.col("finish_rank") * 20)).otherwise(0)
    klass = F.concat(F.lit("Class "), (1 + F.col("draw") % 5).cast("string"))
    df = base(spark, sf).withColumn("claim", C.resolve_claim(C.inline_claim(rider), ladder, -F.col("finish_rank")))
    band = F.concat(F.lit("("), (60 + F.col("draw")).cast("string"), F.lit("-40)"))
    return keyed(
        df, big("claim").alias("claim"), r4(C.declared_weight("weight", "claim")).alias("declared"), big(C.class_num(klass)).alias("class_num"),
        big(C.band_max(band)).alias("band_max"), r4(C.implied_rating("weight", klass)).alias("implied"),
    )


@register(
    "p16_p18_times_positions",
    f"""with n as (select *, count(*) over (partition by contest_id) as n from runs)
select contest_id, finish_rank, {R('floor(elapsed) * 60 + draw + 0.25')} as seconds, cast(draw as bigint) as early, cast(draw - finish_rank as bigint) as gained,
  {R('(draw - 1) / greatest(n - 1, 1)')} as early_pct, {R('(draw - finish_rank) / n')} as late_rating from n""",
    "runs",
)
def p16(spark, sf):
    from contestframe.scale import attach

    df = attach(base(spark, sf), ["contest_id"], {"n": F.count(F.lit(1))}, "window")
    clock = F.concat(F.floor("elapsed").cast("string"), F.lit(":"), F.lpad(F.col("draw").cast("string"), 2, "0"), F.lit(".25"))
    path = F.concat_ws(" ", F.col("draw").cast("string"), F.lit("3"), F.col("finish_rank").cast("string"))
    early, gained = C.position_path(path)
    df = df.withColumns({"early": early, "gained": gained})
    return keyed(
        df, r4(C.elapsed_seconds(clock)).alias("seconds"), big("early").alias("early"), big("gained").alias("gained"),
        r4(C.early_pct("early", "n")).alias("early_pct"), r4(C.late_rating("gained", "n")).alias("late_rating"),
    )


@register(
    "p19_keyword_flags",
    """select doc_id, cast(case when regexp_matches(lower(text), 'checked|blocked|held up|the|und') then 1 else 0 end as bigint) as hit,
  cast(case when contains(lower(text), 'a.b') then 1 else 0 end as bigint) as literal from documents""",
)
def p19(spark, sf):
    df = views.table(spark, sf, "documents")
    return df.select(
        big("doc_id").alias("doc_id"), big(C.has_any("text", ["checked", "blocked", "held up", "the", "und"])).alias("hit"),
        big(C.has_any("text", ["a.b"])).alias("literal"),
    )


@register(
    "p23_p44_p49_calendar",
    f"""with s as (select *, year(contest_date) - case when month(contest_date) >= 9 then 0 else 1 end as season from runs)
select contest_id, finish_rank, cast(season as bigint) as season, {R("greatest(date_diff('day', contest_date, make_date(season + 1, 7, 31)) / 7.0, 0)")} as weeks,
  cast(case when dayofweek(contest_date) in (0, 3, 6) and not (month(contest_date) * 100 + day(contest_date) between 716 and 831) then 1 else 0 end as bigint) as meeting,
  case when dayofweek(contest_date) = 3 then 'HV' else 'ST' end as venue from s""",
    "runs",
)
def p23(spark, sf):
    return keyed(
        base(spark, sf), big(C.season("contest_date")).alias("season"), r4(C.weeks_left("contest_date")).alias("weeks"),
        big(C.is_meeting_day("contest_date")).alias("meeting"), C.default_venue("contest_date").alias("venue"),
    )


@register(
    "p24_p26_flags_combos",
    """select contest_id, finish_rank, case when draw % 2 = 0 then 'SLOW' end as pace, cast(draw as bigint) as draw_tag,
  case when win = 1 then 'steam' else '' end as tags, case when draw < 10 and finish_rank < 10 then least(draw, finish_rank) || '/' || greatest(draw, finish_rank) end as combo,
  case when draw % 2 = 0 then 'pace=SLOW|' else '' end || 'draw=' || draw || case when win = 1 then '|steam' else '' end as packed from runs""",
    "runs",
)
def p24(spark, sf):
    pace = F.when(F.col("draw") % 2 == 0, "SLOW")
    df = base(spark, sf).withColumn("packed", C.pack_flags({"pace": pace, "draw": F.col("draw")}, {"steam": F.col("win") == 1}))
    df = df.withColumn("f", C.parse_flags("packed"))  # the draw stands first or second, with values equal to its place
    combo = C.combo_key(F.concat(F.col("draw").cast("string"), F.lit(", "), F.col("finish_rank").cast("string")))
    return keyed(
        df, F.try_element_at("f.ctx", F.lit("pace")).alias("pace"), F.try_element_at("f.ctx", F.lit("draw")).cast("bigint").alias("draw_tag"),
        F.array_join("f.tags", ",").alias("tags"), F.when((F.col("draw") < 10) & (F.col("finish_rank") < 10), combo).alias("combo"), "packed",
    )


@register(
    "p27_p28_p45_names",
    """with n as (select cast(n_nationkey as bigint) as id, n_name from nation)
select id, upper(trim(n_name)) as name_key, case when id % 3 = 0 then 'HV' when id % 3 = 1 then 'ST' end as venue,
  cast(case when contains(upper(n_name), 'IN') then 1 else 0 end as bigint) as found,
  upper(n_name) || ' (#' || id || case when id % 2 = 0 then ' [D' || (id + 1) || ']' else '' end || ')' as label from n""",
)
def p27(spark, sf):
    df = views.table(spark, sf, "nation").select(big("n_nationkey").alias("id"), "n_name")
    hits = C.find_entrant(df, "n_name", "in").select("id", F.lit(1).alias("found"))
    venue = F.when(F.col("id") % 3 == 0, " happy valley ").when(F.col("id") % 3 == 1, "st").otherwise("Macau")
    draw = F.when(F.col("id") % 2 == 0, F.col("id") + 1)
    return df.join(hits, "id", "left").select(
        "id", C.name_key(F.concat(F.col("n_name"), F.lit(" (AUS)"))).alias("name_key"), C.venue_code(venue).alias("venue"),
        big(F.coalesce("found", F.lit(0))).alias("found"), C.entrant_label("n_name", "id", draw).alias("label"),
    )


@register(
    "p30_p38_price_rules",
    f"""with t as (select *, 1.0 / (draw + 1) as p, draw * 15.0 as score from runs)
select contest_id, finish_rank, {R('power(4.0/price, 1.25)')} as decay, {R('least(power(4.0/price, 1.25), 1)')} as clamped,
  {R('case when price > 8 then p * power(8/price, 2) else p end')} as penalised, {R('p * price * power(4.0/price, 1.25) - 1')} as ev,
  {R('p - 1/price')} as edge, {R('case when p > 0 and p < 1 then case when p * 4 >= 1.15 then 1.15 / p else power(1.15 / (p * power(4.0, 1.25)), -4.0) end end')} as min_price,
  {R('ln(p/(1-p))')} as logit, {R('1/(1+exp(-price/10))')} as sig, case when score >= 75 then 'STEAMER' when score < 40 then 'DRIFTER' else 'STABLE' end as flow,
  cast(case when price between 4.5 and 8 and round(p * price * power(4.0/price, 1.25) - 1, 9) >= 0.22 and score >= 50 then 1 else 0 end as bigint) as prime,
  {R('least(greatest((p * price * least(power(4.0/price, 1.25), 1) - 1) / (price - 1) * 0.15, 0), 0.02)')} as kelly from t""",
    "runs",
)
def p30(spark, sf):
    df = base(spark, sf).withColumns({"p": 1.0 / (F.col("draw") + 1), "score": F.col("draw") * 15.0})
    return keyed(
        df, r4(C.decay("price")).alias("decay"), r4(C.decay("price", clamp=True)).alias("clamped"), r4(C.longshot_penalty("p", "price")).alias("penalised"),
        r4(C.ev("p", "price")).alias("ev"), r4(C.edge("p", 1 / F.col("price"))).alias("edge"), r4(C.min_price("p")).alias("min_price"),
        r4(C.logit("p")).alias("logit"), r4(C.sigmoid(F.col("price") / 10)).alias("sig"), C.flow_label("score").alias("flow"),
        big(C.prime_value("price", F.round(C.ev("p", "price"), 9), "score")).alias("prime"), r4(C.kelly_single("p", "price")).alias("kelly"),
    )


@register(
    "p36_verdicts",
    f"""with t as (select *, 1.0 / (draw + 1) as p, case when draw <> 3 then draw * 20.0 end as score, 1 + (price - 1) / 3 as pp, (1 + (price - 1) / 3) * 0.9 / draw as pev from runs),
e as (select *, round(p * price * least(power(4.0/price, 1.25), 1) - 1 + 0.4, 9) as ev from t),
f as (select *, p >= 0.16 and ev >= 0.15 and price between 2.2 and 14 and coalesce(score, 50) >= 50 as pw,
  ((pp between 1.8 and 4 and pev >= 1.15) or (pp > 4 and pev >= 1.3)) and coalesce(score, 50) >= 50 as ppr from e)
select contest_id, finish_rank, case when draw = 7 then 'CLOSED' when draw = 6 then 'PRE-OPEN' when not pw and ppr and ev + 1 >= 1.25 and price > 14 then 'EXOTIC'
  when draw = 2 and ppr then 'EXOTIC' when pw and ppr then 'DUAL VALUE' when pw then 'PRIME W' when ppr then 'PRIME P' else 'PASS' end as verdict,
  case when pw then 'PRIME W' when ev + 1 >= 1.25 and price > 14 then 'EXOTIC' when ev > 0 and coalesce(score, 50) < 40 then 'DRIFT' else 'NONE' end as flag from f""",
    "runs",
)
def p36(spark, sf):
    df = base(spark, sf).withColumns(
        {"p": 1.0 / (F.col("draw") + 1), "score": F.when(F.col("draw") != 3, F.col("draw") * 20.0), "pp": 1 + (F.col("price") - 1) / 3}
    )
    df = df.withColumns({"pev": F.col("pp") * 0.9 / F.col("draw"), "ev": F.round(C.ev("p", "price", C.decay("price", clamp=True)) + 0.4, 9)})
    cols = [F.col(c) for c in ("p", "price", "ev", "score", "pp", "pev")]
    verdict = C.verdict(*cols, trap=F.col("draw") == 2, closed=F.col("draw") == 7, unposted=F.col("draw") == 6)
    return keyed(df, verdict.alias("verdict"), C.row_flag(*cols[:4]).alias("flag"))


@register(
    "p40_p43_post_time_weights",
    f"""with t as (select *, draw * 60.0 - 100 as sec from runs),
e as (select *, case when sec > 45 then sec else least(greatest(sec, 20), 45) end as te,
  case when sec >= 90 then 'PRE_POST' when sec >= 0 then 'TURBO_APPROACH' else 'LOADING_DELAY' end as state from t)
select contest_id, finish_rank, {R('te')} as t_eff, state, {R("case when state <> 'PRE_POST' then 0.85 else 0.85 - 0.6 / (1 + exp(-0.02 * (te - 360))) end")} as w,
  {R('0.75 + least(greatest((draw - 4) / 10.0, 0), 1) * 0.13')} as gamma, strftime(contest_date - interval 1 day, '%Y-%m-%d') || ' 23:05' as post_utc from e""",
    "runs",
)
def p40(spark, sf):
    from contestframe.operators.market import lifecycle_state

    df = base(spark, sf).withColumn("sec", F.col("draw") * 60.0 - 100)
    df = df.withColumns({"te": C.t_effective("sec"), "state": lifecycle_state("sec", F.lit(False))})
    header = F.concat(F.lit("Race "), F.col("draw").cast("string"), F.lit(" - 7:05 Sha Tin"))
    return keyed(
        df, r4("te").alias("t_eff"), "state", r4(C.fusion_weight("te", "state")).alias("w"), r4(C.field_gamma("draw")).alias("gamma"),
        F.date_format(C.post_time("contest_date", header), "yyyy-MM-dd HH:mm").alias("post_utc"),
    )


@register(
    "p20_p22_p46_p48_flags",
    f"""select contest_id, finish_rank, cast(case when weight / 1500 < 0.08 and price > 12 then 1 else 0 end as bigint) as combo_flag,
  cast(case when draw < 4 and finish_rank = 1 then 1 else 0 end as bigint) as star, {R('-(weight - 120) / 10 + case when draw >= 10 then 0.5 else 0 end')} as adj,
  {R('(price + draw) / price')} as slip, case when (price * (1 + (draw - 4) / 50.0) / price - 1) * 100 <= -3.0001 then 'STEAMING'
    when (price * (1 + (draw - 4) / 50.0) / price - 1) * 100 >= 3.0001 then 'PRICE COLLAPSED' else 'STABLE' end as move from runs""",
    "runs",
)
def p46(spark, sf):
    rate = F.when((F.col("weight") / 1500 < 0.08) & (F.col("price") > 12), 0.05).otherwise(0.5)
    df = base(spark, sf).withColumns({"speed": (F.col("weight") - 120) / 10, "now": F.col("price") * (1 + (F.col("draw") - 4) / 50.0)})
    return keyed(
        df, big(C.high_value_combo(rate, F.lit(0.2))).alias("combo_flag"), big(C.unexposed_star(F.col("draw") * 3, "finish_rank")).alias("star"),
        r4(C.adj_speed("speed", "draw")).alias("adj"), r4(C.slippage(F.col("price") + F.col("draw"), "price")).alias("slip"),
        C.move_class("now", "price", 3.0001).alias("move"),
    )


@register(
    "x01_sql_functions",
    f"""select contest_id, finish_rank, {R('power(4.0/price, 1.25)')} as decay, case when draw * 15 >= 75 then 'STEAMER' when draw * 15 < 40 then 'DRIFTER' else 'STABLE' end as flow,
  {R('0.75 + least(greatest((draw - 4) / 10.0, 0), 1) * 0.13')} as gamma, {R('case when draw * 10 > 45 then draw * 10 else least(greatest(draw * 10, 20), 45) end')} as t_eff,
  {R('case when 1.0/(draw+1) * 4 >= 1.15 then 1.15 * (draw+1) else power(1.15 / (1.0/(draw+1) * power(4.0, 1.25)), -4.0) end')} as min_price from runs""",
    "runs",
)
def x01(spark, sf):
    """The SQL-callable functions are inlined expressions; no Python runs per row."""
    register_functions(spark)
    base(spark, sf).createOrReplaceTempView("cf_runs")
    out = spark.sql(
        """select contest_id, finish_rank, cf_decay(price) as decay, cf_flow_label(draw * 15.0D) as flow, cf_field_gamma(draw) as gamma,
        cf_t_effective(draw * 10.0D) as t_eff, cf_min_price(1.0D / (draw + 1), 1.15D) as min_price from cf_runs"""
    )
    return keyed(out, "flow", *[r4(c).alias(c) for c in ("decay", "gamma", "t_eff", "min_price")])


@register(
    "x03_calendar_table",
    """select strftime(d, '%Y-%m-%d') as day, cast(count(distinct o_orderkey) as bigint) as contests
from (select unnest(generate_series(date '1996-01-01', date '1997-12-31', interval 1 day)) as d) left join orders on cast(o_orderdate as date) = d
where dayofweek(d) in (0, 3, 6) and not (month(d) * 100 + day(d) between 716 and 831) group by 1""",
)
def x03(spark, sf):
    """Meeting days of the table function with the contests stored for each."""
    register_functions(spark)
    days = spark.sql("select date from cf_calendar(date'1996-01-01', date'1997-12-31')")
    orders = views.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count_distinct("o_orderkey").alias("contests"))
    out = days.join(orders, "date", "left")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"), big(F.coalesce("contests", F.lit(0))).alias("contests"))


@register(
    "x03_pairs_table",
    """select distinct a.contest_id, cast(a.entrant_id as bigint) as leg_a, cast(b.entrant_id as bigint) as leg_b
from runs a join runs b on a.contest_id = b.contest_id and a.entrant_id < b.entrant_id where a.finish_rank <= 3 and b.finish_rank <= 3""",
    "runs",
)
def x03_pairs(spark, sf):
    """The pairs of the placed entrants of every contest by a lateral join with the table function."""
    register_functions(spark)
    placed = base(spark, sf).where("finish_rank <= 3").groupBy("contest_id").agg(F.collect_set(F.col("entrant_id").cast("bigint")).alias("ids"))
    placed.createOrReplaceTempView("cf_placed")
    return spark.sql("select cast(contest_id as bigint) as contest_id, leg_a, leg_b from cf_placed, lateral cf_pairs(ids)")


@register(
    "x02_group_functions",
    f"""with s as (select entrant_id, list(price order by contest_ord, finish_rank) as xs from runs group by 1)
select cast(entrant_id as bigint) as entrant_id, {R('list_reduce(xs, lambda a, x: a * (1 - 2.0/6) + x * 2.0/6)')} as ewm from s""",
    "runs",
)
def x02g(spark, sf):
    from contestframe.functions.groups import ewm_agg

    newest = Window.partitionBy("entrant_id").orderBy(F.col("contest_ord").desc(), F.col("finish_rank").desc())
    df = base(spark, sf).withColumn("newer", F.row_number().over(newest) - 1)
    out = df.groupBy("entrant_id").agg(ewm_agg("price", "newer", span=5).alias("ewm"))
    return out.select(big("entrant_id").alias("entrant_id"), r4("ewm").alias("ewm"))
