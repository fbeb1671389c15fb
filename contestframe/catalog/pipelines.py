"""Queries of the feature frame, the stores and the page extraction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import session
from contestframe.catalog.base import big, r4, register
from contestframe.catalog.history import R, base, keyed
from contestframe.catalog.ledger import SETTLED, settled_tickets
from contestframe.functions import columns as C
from contestframe.plans.features import FEATURES, build_features
from contestframe.session import written
from contestframe.sources import pages, stores, views


def feature_input(spark, sf):
    """Runs with the optional columns of the full feature frame, all derived from the order lines."""
    df = views.runs(spark, sf, stable=True)
    return df.withColumns(
        {
            "klass": F.lit("Class 3"), "going": F.when(F.col("distance") > 1600, "WET").otherwise("GOOD"), "sec1": F.col("elapsed") / 4,
            "early_position": F.col("draw"), "places_gained": F.col("draw") - F.col("finish_rank"), "gear": F.when(F.col("price") > 20, "B").otherwise("TT"),
            "incident": F.when(F.col("draw") >= 5, "raced wide without cover").when(F.col("finish_rank") >= 4, "checked near the turn").otherwise(""),
            "official_rating": F.lit(0), "class_max": F.lit(None).cast("double"), "body_weight": F.col("weight") * 10,
            "rider_text": F.lit("A Rider"), "prior_wins": F.when(F.col("rider_id") % 2 == 0, 0), "claim_scraped": F.lit(0),
        }
    )


def features(spark, sf, columns=FEATURES, turn=None):
    """The feature frame; a large table's is written in turn between its stages, by the writers of groups and of stages."""
    work = views.work_events(spark, sf).withColumn("is_swim", F.col("time_400") > 30)
    trials = work.select("entrant_id", F.col("activity_date").alias("trial_date"), F.when(F.col("time_400") < 15, 1).otherwise(5).alias("finish_pos"), F.lit(None).cast("double").alias("margin"))
    keep, step = turn or writers(spark, sf)
    return build_features(feature_input(spark, sf), lambda frame, keys: views.hot(spark, sf, frame, keys), work, trials, until="1999-01-01", keep=keep, step=step, columns=columns)


def writers(spark, sf):
    """What writes a large table's frame between groups of stages and between stages."""
    return session.in_turn(written, session.written) if views.large(spark, sf) else [lambda df: df] * 2


FEAT_SQL = f"""with t as (select *, case when distance > 1600 then 'WET' else 'GOOD' end as going, count(*) over (partition by contest_id) as n from runs),
g as (select avg(elapsed) as gm from t where contest_date < date '1999-01-01'),
p as (select *, avg(elapsed) over w as m, stddev_samp(elapsed) over w as s from t
  window w as (partition by track, distance, going order by contest_ord range between unbounded preceding and 1 preceding)),
f as (select p.*, least(greatest((coalesce(m, gm) - elapsed) / (coalesce(s, 1.0) + 1e-6), -4.5), 4.5) as figure,
  dense_rank() over (partition by entrant_id order by contest_ord) as de, dense_rank() over (partition by rider_id order by contest_ord) as dr,
  dense_rank() over (partition by stable_id order by contest_ord) as ds, (draw - 1) / greatest(n - 1, 1) as early from p cross join g),
e as (select *, coalesce(lag(figure) over o, 0) as last_fig, coalesce(lag(figure) over o - lag(figure, 2) over o, 0) as fig_change,
  coalesce(avg(win) over (partition by entrant_id order by de range between 50 preceding and 1 preceding), 0) as ew,
  coalesce(avg(win) over (partition by rider_id order by dr range between 50 preceding and 1 preceding), 0) as rw,
  coalesce(avg(case when win = 1 then price else 0 end) over (partition by stable_id order by ds range between 50 preceding and 1 preceding) - 1, 0) as sroi,
  coalesce(avg(early) over (partition by entrant_id order by de range between 3 preceding and 1 preceding), 0.5) as early3,
  row_number() over o - 1 as starts, coalesce(date_diff('day', lag(contest_date) over o, contest_date), 365) as days,
  coalesce(lag(finish_rank) over o, 99) as last_rank
  from f window o as (partition by entrant_id order by contest_ord, contest_id, finish_rank)),
x as (select *, case when early3 <= 0.33 then 'Leader' when early3 <= 0.66 then 'Stalker' else 'Closer' end as style from e)
select contest_id, finish_rank, {R('figure')} as speed_figure, {R('last_fig')} as last_speed_figure, {R('fig_change')} as speed_figure_change,
  {R('ew')} as entrant_win_rate, {R('rw')} as rider_win_rate, {R('sroi')} as stable_roi, starts as career_starts, cast(days as bigint) as days_since_last,
  cast(last_rank as bigint) as last_finish, style as run_style, cast(sum(case when style = 'Leader' then 1 else 0 end) over (partition by contest_id) as bigint) as front_runners,
  dense_rank() over (partition by contest_id order by round(last_fig, 9) desc) as speed_rank, {R('last_fig - avg(last_fig) over (partition by contest_id)')} as speed_to_mean,
  {R('weight - max(weight) over (partition by contest_id)')} as weight_to_max from x"""


@register("s12_feature_frame", FEAT_SQL, "runs")
def s12(spark, sf):
    counts = ["career_starts", "days_since_last", "last_finish", "front_runners", "speed_rank"]
    nums = ["speed_figure", "last_speed_figure", "speed_figure_change", "entrant_win_rate", "rider_win_rate", "stable_roi", "speed_to_mean", "weight_to_max"]
    out = features(spark, sf, ["contest_id", "finish_rank", "run_style", *counts, *nums])
    return keyed(out, "run_style", *[big(c).alias(c) for c in counts], *[r4(c).alias(c) for c in nums])


@register("s12_feature_frame_wide")
def s12_wide(spark, sf):
    """Every column of the stored feature frame."""
    return features(spark, sf)


@register(
    "s02_s06_defaults_migrate",
    f"""select contest_id, finish_rank, case when draw = 3 then 'Unknown' else 'C' || draw end as course, 0 as horse_rating, cast(null as varchar) as extra,
  {R('price')} as price from runs""",
    "runs",
)
def s02(spark, sf):
    df = base(spark, sf).withColumn("course_type", F.when(F.col("draw") != 3, F.concat(F.lit("C"), F.col("draw").cast("string"))))
    full = stores.with_defaults(df, {"course_type": "Unknown", "horse_rating": 0})
    out = stores.migrate(full, ["contest_id", "finish_rank", "course_type", "horse_rating", "extra", "price"], {"horse_rating": "int"})
    return keyed(out, F.col("course_type").alias("course"), "horse_rating", "extra", r4("price").alias("price"))


@register(
    "s07_read_payouts",
    f"""select contest_id, pool, combo, {R("case when pool = 'QPL' then payout else payout * 2 end")} as payout from payouts""",
    "runs payouts",
)
def s07(spark, sf):
    pay = views.payouts(spark, sf)
    first = pay.where("pool <> 'QPL'").withColumn("payout", F.col("payout") * 2)
    second = pay.withColumn("combo", F.array_join(F.reverse(F.split("combo", "/")), " "))
    out = stores.read_payouts([first, second])
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", r4("payout").alias("payout"))


@register(
    "s09_star_schema",
    """select (select count(distinct (track, contest_date, distance)) from runs) as contests, (select count(distinct entrant_id) from runs) as entrants,
  (select count(distinct (track, contest_date, distance, entrant_id)) from runs) as results""",
    "runs",
)
def s09(spark, sf):
    df = base(spark, sf).select(
        "track", F.col("contest_date").alias("race_date"), "distance", F.lit("Class 4").alias("race_class"), F.concat(F.lit("E"), F.col("entrant_id").cast("string")).alias("horse_name"),
        F.col("finish_rank").alias("finish_position"), F.col("elapsed").alias("finishing_time"), F.col("rider_id").alias("jockey"), F.lit("S").alias("trainer"),
        F.col("weight").alias("weight_carried"), F.col("draw").alias("barrier_draw"), F.col("price").alias("win_odds"),
    )
    races, horses, facts = stores.to_star(df)
    counted = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((races, "contests"), (horses, "entrants"), (facts, "results"))]
    one = counted[0].withColumns({"entrants": counted[1].scalar(), "results": counted[2].scalar()})
    return one.select("contests", "entrants", "results")


@register(
    "s10_backfill",
    f"""select contest_id, finish_rank, {R('case when draw = 1 then price * 2 else case when draw <> 2 then elapsed end end')} as sec1 from runs""",
    "runs",
)
def s10(spark, sf):
    df = base(spark, sf).withColumn("sec1", F.when(~F.col("draw").isin(1, 2), F.col("elapsed")))
    patch = base(spark, sf).where("draw = 1").select("contest_id", "finish_rank", (F.col("price") * 2).alias("sec1"))
    return keyed(stores.backfill(df, patch, ["contest_id", "finish_rank"], ["sec1"]), r4("sec1").alias("sec1"))


@register(
    "s11_missing_dates",
    """with have as (select distinct cast(o_orderdate as date) as d from orders where o_orderdate < timestamp '1999-01-01'),
cal as (select distinct cast(o_orderdate as date) as d from orders)
select strftime(d, '%Y-%m-%d') as day from cal where d not in (select d from have) and d > (select max(d) from have)""",
)
def s11(spark, sf):
    days = views.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    out = stores.missing_dates(days, days.where("date < date'1999-01-01'"), "date")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"))


@register(
    "s13_export_predictions",
    f"""with p as (select contest_id, finish_rank, max(weight / 200) as true_prob from runs where draw <> 4 group by 1, 2)
select r.contest_id, r.finish_rank, {R('true_prob')} as true_prob, {R('sum(1/price) over (partition by r.contest_id)')} as overround,
  {R('1/price / sum(1/price) over (partition by r.contest_id)')} as market_share from runs r left join p using (contest_id, finish_rank)""",
    "runs",
)
def s13(spark, sf):
    df = base(spark, sf)
    preds = df.where("draw <> 4").select("contest_id", "finish_rank", (F.col("weight") / 200).alias("true_prob"))
    out = stores.export_predictions(df, preds, ["contest_id", "finish_rank"], "contest_id", "price")
    return keyed(out, *[r4(c).alias(c) for c in ("true_prob", "overround", "market_share")])


@register(
    "s15_settlement_json",
    f"""with {SETTLED} select contest_id, milestone, pool, count(*) as n, {R('sum(stake)')} as staked, {R('sum(returned)')} as returned from tk group by 1, 2, 3""",
    "runs payouts",
)
def s15(spark, sf):
    """The exported documents, read back into rows."""
    made = stores.settlement_json(settled_tickets(spark, sf))
    shape = "struct<contest_id: bigint, milestone: string, pools: array<struct<pool: string, n: bigint, staked: double, returned: double>>>"
    body = made.select(F.from_json("document", shape).alias("d"))
    out = body.select("d.contest_id", "d.milestone", F.inline("d.pools"))
    return out.select("contest_id", "milestone", "pool", "n", r4("staked").alias("staked"), r4("returned").alias("returned"))


@register(
    "s17_flatten_record",
    f"select contest_id, finish_rank, track, {R('price')} as price from runs",
    "runs",
)
def s17(spark, sf):
    rows = F.collect_list(F.struct("finish_rank", "price"))
    nested = base(spark, sf).groupBy("contest_id", "track").agg(rows.alias("results"))
    record = nested.select(F.struct(F.struct("contest_id", "track").alias("race"), "results").alias("payload"))
    return keyed(stores.flatten(record, "payload"), "track", r4("price").alias("price"))


# ---- pages -----------------------------------------------------------------------------------


@register(
    "h02_page_elements",
    """with e as (select page_id, unnest(regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1)) as row from pages)
select cast(page_id as bigint) as page_id, count(*) as n_rows,
  cast(sum(length(trim(regexp_replace(replace(replace(regexp_replace(row, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')))) as bigint) as text_length,
  cast(sum(len(regexp_extract_all(row, '(?is)<a(?:\\s[^>]*)?>(.*?)</a\\s*>', 1))) as bigint) as n_cells from e group by 1""",
)
def h02(spark, sf):
    out = pages.html_rows(views.table(spark, sf, "pages"), "html", "li", "a", keep=["page_id"])
    return out.groupBy(big("page_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), big(F.sum(F.length("text"))).alias("text_length"), big(F.sum(F.size("cells"))).alias("n_cells")
    )


def result_pages(spark, sf):
    """One result page per contest with a header row and a row per run, written from the runs view."""
    code = F.concat(F.lit("K"), F.lpad((F.col("entrant_id") % 1000).cast("string"), 3, "0"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    text = lambda c: F.col(c).cast("string")
    row = F.concat(
        F.lit("<tr class='r'>"), cell(text("finish_rank")), cell(text("draw")), cell(F.concat(F.lit("<b>Runner "), text("entrant_id"), F.lit("</b> ("), code, F.lit(")"))),
        cell(F.format_string("%.2f", F.col("elapsed"))), cell(F.when(F.col("draw") == 3, "999").otherwise(F.format_string("%.1f", F.col("price")))), F.lit("</tr>"),
    )
    rows = base(spark, sf).groupBy("contest_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("body"))
    head = "<table><tr><th>Pla.</th><th>Horse No.</th><th>Horse</th><th>Sec</th><th>Win Odds</th></tr>"
    return rows.select("contest_id", F.concat(F.lit("<html><h1>Race 1</h1>" + head), "body", F.lit("</table></html>")).alias("html"))


@register(
    "h03_h08_h09_result_pages",
    f"""select contest_id, finish_rank, cast(draw as bigint) as number, 'K' || lpad(cast(entrant_id % 1000 as varchar), 3, '0') as code,
  {R('round(elapsed + 1e-9, 2)')} as sec1, {R('case when draw <> 3 then round(price + 1e-9, 1) end')} as win_price from runs""",
    "runs",
)
def h03(spark, sf):
    df = result_pages(spark, sf)
    rows = pages.html_rows(df, "html", keep=["contest_id"])
    names = {"rank": ["pla."], "number": ["horse no."], "horse": ["horse"], "sec": ["sec"], "win": ["win odds"]}
    bound = pages.bind_columns(rows, "contest_id", names)
    return bound.select(
        big("contest_id").alias("contest_id"), F.col("rank").cast("bigint").alias("finish_rank"), F.col("number").cast("bigint").alias("number"),
        pages.entrant_code(F.col("horse")).alias("code"), r4(C.to_num("sec")).alias("sec1"), r4(F.nullif(C.to_num("win"), F.lit(999.0))).alias("win_price"),
    )


@register(
    "h01_card_json",
    """select contest_id, finish_rank, 'K' || lpad(cast(entrant_id % 1000 as varchar), 3, '0') as entrant_code, cast(40 + draw as bigint) as rating,
  case when draw % 2 = 0 then 'B/TT' end as gear, cast(case when draw % 3 = 0 then -5 else 0 end as bigint) as allowance from runs""",
    "runs",
)
def h01(spark, sf):
    code = F.concat(F.lit("K"), F.lpad((F.col("entrant_id") % 1000).cast("string"), 3, "0"))
    runner = F.struct(
        F.col("finish_rank").cast("string").alias("id"), F.struct(code.alias("code"), F.lit("x").alias("name_en")).alias("horse"),
        F.lpad((40 + F.col("draw")).cast("string"), 3, "0").alias("currentRating"), F.when(F.col("draw") % 2 == 0, "B/TT").otherwise("").alias("gearInfo"),
        F.struct(F.when(F.col("draw") % 3 == 0, "").otherwise("0").alias("allowance"), F.lit("A Rider (-5)").alias("name_en")).alias("jockey"),
    )
    # one race per run keeps the finish rank recoverable as the race number
    races = base(spark, sf).groupBy("contest_id").agg(F.collect_list(F.struct(F.col("finish_rank").cast("string").alias("no"), F.array(runner).alias("runners"))).alias("races"))
    body = races.select("contest_id", F.to_json(F.struct(F.struct(F.array(F.struct("races")).alias("raceMeetingProfile")).alias("data"))).alias("body"))
    out = pages.parse_card_json(body, "body", ["contest_id"])
    return out.select(
        big("contest_id").alias("contest_id"), big("race_no").alias("finish_rank"), "entrant_code", big("rating").alias("rating"), "gear", big("allowance").alias("allowance")
    )


@register(
    "h04_payout_tokens",
    f"""select contest_id, pool, replace(combo, '/', ',') as combo, {R('round(payout + 1e-9, 2)')} as payout from payouts""",
    "runs payouts",
)
def h04(spark, sf):
    """Payout sections written as running text, one per contest, and read back."""
    names = F.when(F.col("pool") == "QPL", "Quinella Place").otherwise(F.col("pool"))
    pair = F.concat(F.replace("combo", F.lit("/"), F.lit(",")), F.lit(" "), F.format_number("payout", 2))
    pools = views.payouts(spark, sf).groupBy("contest_id", "pool").agg(F.array_join(F.array_sort(F.collect_list(pair)), " ").alias("pairs"), F.first(names).alias("name"))
    text = F.concat(F.lit("Result list Dividend Pool Winning Combination Dividend (HK$) "), F.array_join(F.collect_list(F.concat("name", F.lit(" "), "pairs")), " "), F.lit(" Dividend Note: WIN 9 99.0"))
    out = pages.payout_tokens(pools.groupBy("contest_id").agg(text.alias("text")), "text", ["contest_id"])
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", r4("payout").alias("payout"))


@register(
    "h05_attribute_text",
    """select contest_id, cast(entrant_id as bigint) as entrant_id, cast(count(distinct finish_rank) as bigint) as n_lines from runs group by 1, 2""",
    "runs",
)
def h05(spark, sf):
    """Report lines of all runs: odd ranks name the code, even ranks the name."""
    df = base(spark, sf)
    # a code tells the entrants of one contest apart, so it counts them; the ids of a whole table outnumber the codes
    place = F.dense_rank().over(W.partitionBy("contest_id").orderBy("entrant_id")) - 1
    code = F.concat(F.chr(F.lit(65) + F.floor(F.col("_place") / 1000)), F.lpad((F.col("_place") % 1000).cast("string"), 3, "0"))
    df = df.withColumn("_place", place).withColumns({"code": code, "name": F.concat(F.lit("RUNNER "), F.col("entrant_id").cast("string"), F.lit("X"))})
    line = F.when(F.col("finish_rank") % 2 == 1, F.concat(F.lit("Runner ("), "code", F.lit(") was checked near the 400 metres"))).otherwise(
        F.concat(F.lit("Near the turn "), F.initcap("name"), F.lit(" raced wide without cover"))
    )
    lines = df.select("contest_id", F.col("finish_rank").alias("line_no"), line.alias("line"))
    entrants = df.select("contest_id", "code", "name", "entrant_id").distinct()
    out = pages.attribute_text(lines, entrants.select("contest_id", "code", "name").distinct(), "contest_id", "line", "code", "name")
    counted = out.withColumn("n_lines", F.size(F.regexp_extract_all("report", F.lit("(checked|raced)"), 1)))
    return entrants.join(counted, ["contest_id", "code"]).select(big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), big("n_lines").alias("n_lines"))


@register(
    "h12_top_pair_prices",
    f"""with p as (select contest_id, split_part(combo, '/', 1)::bigint as leg_a, split_part(combo, '/', 2)::bigint as leg_b, payout as price from payouts where pool in ('QPL', 'QUINELLA')),
r as (select *, row_number() over (partition by contest_id order by price, leg_a, leg_b) as position from p)
select contest_id, leg_a, leg_b, {R('price')} as price, position from r where position <= 2""",
    "runs payouts",
)
def h12(spark, sf):
    df = views.payouts(spark, sf).where("pool in ('QPL', 'QUINELLA')").withColumn("cell", F.concat(F.lit("qb_9_"), F.replace("combo", F.lit("/"), F.lit("_"))))
    out = pages.top_pair_prices(df, "contest_id", "cell", "payout", 2)
    return out.select(*[big(c).alias(c) for c in ("contest_id", "leg_a", "leg_b", "position")], r4("price").alias("price"))


@register(
    "h15_form_remarks",
    """with r as (select *, row_number() over (partition by entrant_id order by contest_ord * 100 + finish_rank desc) as rn from runs)
select cast(entrant_id as bigint) as entrant_id, string_agg(case when rn <= 3 then 'Finished ' || finish_rank || ' Energy: ' || (draw + 60) end, ' | ' order by rn) as remarks,
  cast(max(case when rn = 1 then draw + 60 end) as bigint) as energy from r group by 1""",
    "runs",
)
def h15(spark, sf):
    remark = F.concat(F.lit("Finished "), F.col("finish_rank").cast("string"), F.lit(" Energy: "), (F.col("draw") + 60).cast("string"))
    df = base(spark, sf).withColumns({"o": F.col("contest_ord") * 100 + F.col("finish_rank"), "remark": remark})
    out = pages.form_remarks(df, "entrant_id", "o", "remark").join(pages.energy(df, "entrant_id", "o", "remark"), "entrant_id")
    return out.select(big("entrant_id").alias("entrant_id"), "remarks", big("energy").alias("energy"))


def _cells(*texts):
    """One table row of the given cell texts."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), t, F.lit("</td>")) for t in texts], F.lit("</tr>"))


def _text(c: str):
    return F.col(c).cast("string")


def _pages(df, key: str, head: str, row, title=""):
    """One page per key: title, header row and the rows in sorted order."""
    body = F.array_join(F.array_sort(F.collect_list(row)), "")
    rows = df.groupBy(key).agg(body.alias("body"))
    return rows.select(key, F.concat(F.lit(f"<html>{title}<table><tr>{head}</tr>"), "body", F.lit("</table></html>")).alias("html"))


@register(
    "h06_trackwork_pages",
    f"""select cast(entrant_id as bigint) as entrant_id, strftime(activity_date, '%Y-%m-%d') as day, 'R' || rider_id as rider, {R('round(time_400 * 2 + 1e-9, 1)')} as time_800,
  {R('round(time_400 + 1e-9, 1)')} as time_400, case when is_fast then 'Fast Gallop' else 'Swimming' end as work from work_events""",
    "work_events",
)
def h06(spark, sf):
    """A trackwork page per entrant, written from the work events and read back."""
    df = views.work_events(spark, sf)
    times = F.format_string("%.1f %.1f", F.col("time_400") * 2, F.col("time_400"))
    row = _cells(
        F.date_format("activity_date", "d MMM yyyy"), F.lit("AWT"), F.when(F.col("is_fast"), "Fast Gallop").otherwise("Swimming"), times,
        F.concat(F.lit("R"), _text("rider_id")), F.lit("B"),
    )
    head = "<th>Date</th><th>Course</th><th>Exercise</th><th>Time</th><th>Rider</th><th>Gear</th>"
    out = pages.parse_trackwork(_pages(df, "entrant_id", head, row, "<h2>Trackwork</h2>"), "html", "entrant_id")
    return out.select(
        big("entrant_id").alias("entrant_id"), F.date_format("activity_date", "yyyy-MM-dd").alias("day"), "rider", r4("time_800").alias("time_800"),
        r4("time_400").alias("time_400"), F.col("work_type").alias("work"),
    )


@register(
    "h07_trial_pages",
    f"""select cast(entrant_id as bigint) as entrant_id, strftime(contest_date, '%Y-%m-%d') as day, cast(finish_rank as bigint) as finish_pos, cast(draw as bigint) as field_size,
  {R('finish_rank / 2')} as margin, '0:5' || (draw % 10) || '.30' as time from runs""",
    "runs",
)
def h07(spark, sf):
    clock = F.concat(F.lit("0:5"), (F.col("draw") % 10).cast("string"), F.lit(".30"))
    row = _cells(
        F.date_format("contest_date", "d MMM yyyy"), F.lit("Turf"), _text("finish_rank"), _text("draw"), clock,
        F.concat(F.format_string("%.1f", F.col("finish_rank") / 2), F.lit("L")), F.lit("A Rider"),
    )
    made = _pages(base(spark, sf), "entrant_id", "<th>Barrier trial</th>", row)
    out = pages.parse_trials(made, "html", "entrant_id")
    return out.select(
        big("entrant_id").alias("entrant_id"), F.date_format("trial_date", "yyyy-MM-dd").alias("day"), big("finish_pos").alias("finish_pos"),
        big("field_size").alias("field_size"), r4("margin").alias("margin"), "time",
    )


@register(
    "h10_card_pages",
    f"""select contest_id, 'K' || lpad(cast(entrant_id % 1000 as varchar), 3, '0') as entrant_code, cast(40 + draw as bigint) as rating,
  case when draw % 2 = 0 then 'TT' end as gear, cast(case when draw % 3 = 0 then 5 else 0 end as bigint) as allowance, 60::bigint as band_max from runs""",
    "runs",
)
def h10(spark, sf):
    code = F.concat(F.lit("K"), F.lpad((F.col("entrant_id") % 1000).cast("string"), 3, "0"))
    rider = F.when(F.col("draw") % 3 == 0, "A Rider (-5)").otherwise("A Rider")
    row = _cells(_text("finish_rank"), F.lit("Runner"), code, rider, (40 + F.col("draw")).cast("string"), F.when(F.col("draw") % 2 == 0, "TT").otherwise(""))
    head = "<th>No</th><th>Horse</th><th>Brand No</th><th>Jockey</th><th>Rtg.</th><th>Gear</th>"
    out = pages.parse_card_html(_pages(base(spark, sf), "contest_id", head, row, "<p>Class 4 (60-40)</p>"), "html", "contest_id")
    return out.select(
        big("contest_id").alias("contest_id"), "entrant_code", big("rating").alias("rating"), "gear", big("allowance").alias("allowance"), big("band_max").alias("band_max")
    )


@register(
    "h11_odds_pages",
    f"""select contest_id, cast(finish_rank as bigint) as number, 'RUNNER ' || entrant_id as name, {R('case when draw <> 3 then round(price + 1e-9, 1) end')} as win_price,
  {R('round(1 + (price - 1) / 4 + 1e-9, 2)')} as place_price from runs where draw <> 5 and contest_id % 7 <> 0""",
    "runs",
)
def h11(spark, sf):
    """Odds pages: draw 3 shows 999, draw 5 is scratched, every seventh page shows another contest."""
    name = F.concat(F.lit("Runner "), _text("entrant_id"), F.when(F.col("draw") == 5, " Scratched").otherwise(" (AUS)"))
    win = F.when(F.col("draw") == 3, "999").otherwise(F.format_string("%.1f", F.col("price")))
    row = _cells(_text("finish_rank"), name, _text("draw"), win, F.format_string("%.2f", F.round(1 + (F.col("price") - 1) / 4 + 1e-9, 2)))
    made = _pages(base(spark, sf), "contest_id", "<th>No.</th><th>Horse</th><th>Draw</th><th>Win</th><th>Place</th>", row)
    shown = F.when(F.col("contest_id") % 7 == 0, F.col("contest_id") + 1).otherwise(F.col("contest_id")).cast("string")
    made = made.withColumn("html", F.concat(F.lit("<h2>Race "), shown, F.lit("</h2>"), "html"))
    out = pages.parse_odds(made, "html", "contest_id", F.col("contest_id").cast("int"))
    return out.select(big("contest_id").alias("contest_id"), big("number").alias("number"), "name", r4("win_price").alias("win_price"), r4("place_price").alias("place_price"))


@register(
    "h13_draw_stat_pages",
    f"""select track, cast(draw as bigint) as draw, {R('round(avg(win) * 100 + 1e-9, 1)')} as win_pct, {R('round(avg(case when finish_rank <= 3 then 1 else 0 end) * 100 + 1e-9, 1)')} as place_pct from runs group by 1, 2""",
    "runs",
)
def h13(spark, sf):
    stats = base(spark, sf).groupBy("track", "draw").agg((F.avg("win") * 100).alias("w"), (F.avg(C.is_place("finish_rank")) * 100).alias("p"))
    row = _cells(_text("draw"), F.format_string("%.1f%%", F.round(F.col("w") + 1e-9, 1)), F.format_string("%.1f%%", F.round(F.col("p") + 1e-9, 1)))
    out = pages.parse_draw_stats(_pages(stats, "track", "<th>Draw</th><th>Win %</th><th>Place %</th>", row), "html", "track")
    return out.select("track", big("draw").alias("draw"), r4("win_pct").alias("win_pct"), r4("place_pct").alias("place_pct"))


@register(
    "h14_schedule_json",
    """select strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, case when o_orderpriority like '1%' then 'HV' else 'ST' end as venue, cast(o_orderkey as bigint) as race_no,
  case when o_orderstatus = 'F' then 'CLOSED' else 'OPEN' end as status, strftime(cast(o_orderdate as date), '%Y-%m-%d') || ' 11:10' as post from orders""",
)
def h14(spark, sf):
    day = F.to_date("o_orderdate")
    race = F.struct(
        _text("o_orderkey").alias("no"), F.date_format(day, "yyyy-MM-dd'T'11:10:00'Z'").alias("postTime"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status")
    )
    venue = F.when(F.col("o_orderpriority").startswith("1"), "HV").otherwise("ST")
    meetings = views.table(spark, sf, "orders").groupBy(F.date_format(day, "yyyyMMdd").alias("date"), venue.alias("venueCode")).agg(F.collect_list(race).alias("races"))
    body = meetings.select(F.to_json(F.struct(F.array(F.struct("date", "venueCode", "races")).alias("meetings"))).alias("body"))
    out = pages.parse_schedule(body, "body")
    return out.select(
        F.date_format("contest_date", "yyyy-MM-dd").alias("day"), "venue", big("race_no").alias("race_no"), "status", F.date_format("post_at", "yyyy-MM-dd HH:mm").alias("post")
    )
