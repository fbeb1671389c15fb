"""Queries of the stores: rows are written to the shared folder, written again where that must change nothing, and read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from contestframe.catalog.base import big, r4, register
from contestframe.catalog.fields import CARD, HARVILLE, card, neutral
from contestframe.catalog.history import R, base, keyed
from contestframe.catalog.pipelines import result_pages
from contestframe.config import CFG
from contestframe.functions import columns as C
from contestframe.functions.groups import ndcg_agg
from contestframe.operators import policy
from contestframe.session import shared_dir
from contestframe.sources import pages, stores, views
from contestframe.streaming.ticks import audit_sink


def folder(spark) -> str:
    return f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"


@register(
    "s01_read_runs",
    f"""select contest_id, finish_rank, case when draw % 2 = 0 then track end as track, {R('price')} as price, case when draw % 2 = 1 then 'x, "' || draw || '"' end as note from runs""",
    "runs",
)
def s01(spark, sf):
    """Two layouts of CSV files in two folders, one with quoted commas in a header and in values."""
    home, df = folder(spark), base(spark, sf)
    one = df.where("draw % 2 = 0").select("contest_id", "finish_rank", "track", "price")
    note = F.concat(F.lit('x, "'), F.col("draw").cast("string"), F.lit('"'))
    two = df.where("draw % 2 = 1").select("price", note.alias("note, quoted"), "finish_rank", "contest_id")
    for part, name in ((one, "one"), (two, "more/two")):
        part.write.option("header", True).option("escape", '"').csv(f"{home}/{name}")
    raw = stores.read_runs(spark, home)
    return raw.select(
        F.col("contest_id").cast("bigint").alias("contest_id"), F.col("finish_rank").cast("bigint").alias("finish_rank"), "track",
        r4(F.col("price").cast("double")).alias("price"), F.col("`note, quoted`").alias("note"))


@register(
    "s03_read_events",
    """select cast(entrant_id as bigint) as entrant_id, strftime(activity_date, '%Y-%m-%d') as activity_date, cast(null as varchar) as absent, count(*) as n
from work_events group by 1, 2""",
    "work_events",
)
def s03(spark, sf):
    home = folder(spark)
    views.work_events(spark, sf).select("entrant_id", F.date_format("activity_date", "yyyy-MM-dd").alias("activity_date")).write.option("header", True).csv(home)
    raw = stores.read_events(spark, home, ["entrant_id", "activity_date", "absent"])
    none = stores.read_events(spark, f"{home}/none", ["entrant_id", "activity_date", "absent"])
    return raw.unionByName(none).groupBy(F.col("entrant_id").cast("bigint").alias("entrant_id"), "activity_date", "absent").agg(F.count("*").alias("n"))


@register(
    "s04_tick_store",
    f"""select contest_id, entrant_id, epoch_us(ts) as ts, {R('price')} as price from ticks
where cast(ts as date) = (select max(cast(ts as date)) from ticks) and contest_id % 2 = 0""",
    "ticks",
)
def s04(spark, sf):
    """The newest day of one venue, read from its folder of the tick store."""
    home = folder(spark)
    df = views.ticks(spark, sf).withColumn("venue", F.when(F.col("contest_id") % 2 == 0, "HV").otherwise("ST"))
    stores.write_ticks(df, home)
    newest = df.agg(F.max(F.to_date("ts"))).first()[0]
    out = stores.read_ticks(spark, home, str(newest), "hv")
    return out.select(big("contest_id").alias("contest_id"), big("entrant_id").alias("entrant_id"), F.unix_micros("ts").alias("ts"), r4("price").alias("price"))


@register(
    "s08_append_new",
    f"select contest_id, pool, combo, {R('max(payout)')} as payout from payouts group by 1, 2, 3",
    "runs payouts",
)
def s08(spark, sf):
    """Overlapping halves of the payouts, appended to a store partitioned by pool, the second one twice."""
    home, pay = folder(spark), views.payouts(spark, sf).select("contest_id", "pool", "combo", "payout")
    keys = ["contest_id", "pool", "combo"]
    for part in (pay.where("contest_id % 3 < 2"), pay.where("contest_id % 3 > 0"), pay.where("contest_id % 3 > 0")):
        stores.append_new(part, spark, home, keys, partition_by=["pool"])
    out = spark.read.parquet(home)
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", r4("payout").alias("payout"))


@register("s14_ledger_file", f"select contest_id, finish_rank, {R('price')} as price from runs", "runs")
def s14(spark, sf):
    home = folder(spark)
    df = base(spark, sf).select("contest_id", "finish_rank", "price")
    for _ in range(2):
        stores.write_ledger(df, home, "csv")
    raw = spark.read.option("header", True).csv(home)
    return raw.select(F.col("contest_id").cast("bigint").alias("contest_id"), F.col("finish_rank").cast("bigint").alias("finish_rank"), r4(F.col("price").cast("double")).alias("price"))


@register("s16_audit_sink", "select contest_id, 'T-' || (draw % 2) as milestone, finish_rank as entrant_id from runs", "runs")
def s16(spark, sf):
    """Two micro-batches of the milestone audit, the first one repeated as after a failure."""
    home = folder(spark)
    df = base(spark, sf).select("contest_id", F.concat(F.lit("T-"), (F.col("draw") % 2).cast("string")).alias("milestone"), F.col("finish_rank").alias("entrant_id"))
    for batch in (df.where("contest_id % 2 = 0"), df.where("contest_id % 2 = 0"), df):
        audit_sink(batch, home)
    return spark.read.parquet(home).select(big("contest_id").alias("contest_id"), "milestone", big("entrant_id").alias("entrant_id"))


@register("s18_drop_store", "select track, count(*) as n, false as listed from runs group by track", "runs")
def s18(spark, sf):
    """A catalogued store of the run counts; dropping it takes the name away, the folder's rows stay readable."""
    home, name = folder(spark), f"store_{uuid.uuid4().hex}"
    base(spark, sf).groupBy("track").agg(F.count("*").alias("n")).write.option("path", home).saveAsTable(name)
    stores.drop_store(spark, name)
    return spark.read.parquet(home).select("track", "n", F.lit(spark.catalog.tableExists(name)).alias("listed"))


@register(
    "h08_sectionals",
    f"""select contest_id, 'K' || lpad(cast(entrant_id % 1000 as varchar), 3, '0') as code, {R('round(elapsed + 1e-9, 2)')} as sec1,
  {R('case when draw <> 3 then round(price + 1e-9, 1) end')} as sec2 from runs""",
    "runs",
)
def h08(spark, sf):
    out = pages.parse_sectionals(result_pages(spark, sf), "html", "contest_id", n=2)
    return out.select(big("contest_id").alias("contest_id"), F.col("entrant_code").alias("code"), r4("sec1_time").alias("sec1"), r4("sec2_time").alias("sec2"))


@register(
    "h09_runner_map",
    "select contest_id, cast(draw as bigint) as number, 'K' || lpad(cast(entrant_id % 1000 as varchar), 3, '0') as code from runs",
    "runs",
)
def h09(spark, sf):
    out = pages.runner_map(result_pages(spark, sf), "html", "contest_id")
    return out.select(big("contest_id").alias("contest_id"), big("number").alias("number"), F.col("entrant_code").alias("code"))


@register(
    "p26_combo_codes",
    """select p.contest_id, pool, combo, string_agg('E' || r.entrant_id, '/' order by r.finish_rank) as combo_codes from payouts p
join runs r on r.contest_id = p.contest_id and list_contains(string_split(combo, '/'), cast(r.finish_rank as varchar)) group by 1, 2, 3""",
    "runs payouts",
)
def p26(spark, sf):
    """Payouts keyed by entrant code: every leg's number looked up among the contest's runners."""
    df = base(spark, sf).withColumn("code", F.concat(F.lit("E"), F.col("entrant_id").cast("string")))
    out = C.combo_codes(views.payouts(spark, sf, df), df, "contest_id", "finish_rank", "code")
    return out.select(big("contest_id").alias("contest_id"), "pool", "combo", "combo_codes").distinct()


@register(
    "x02_ndcg_group",
    f"""with {CARD}, g as (select *, case finish_rank when 1 then 3 when 2 then 2 when 3 then 1 else 0 end as rel from card),
r as (select *, row_number() over (partition by contest_id order by round(p, 9) desc, md5(contest_id || ':' || finish_rank)) as r,
  row_number() over (partition by contest_id order by rel desc) as i from g)
select contest_id, {R('''sum(case when r <= 3 then (power(2, rel) - 1) / log2(r + 1) else 0 end)
  / sum(case when i <= 3 then (power(2, rel) - 1) / log2(i + 1) else 0 end)''')} as ndcg from r group by 1""",
    "runs",
)
def x02n(spark, sf):
    df = card(spark, sf).withColumn("rel", C.relevance("finish_rank")).withColumns({"p": F.round("p", 9), "tie": neutral()})
    out = df.groupBy("contest_id").agg(ndcg_agg("p", "rel", "tie", 3).alias("ndcg"))
    return out.select(big("contest_id").alias("contest_id"), r4("ndcg").alias("ndcg"))


def _market_places() -> str:
    """The place sums of HARVILLE once more, over the market vector q."""
    text = HARVILLE.split(",\npl as", 1)[1].replace("a.p", "a.q").replace("b.p", "b.q").replace("d.p", "d.q")
    for name in ("pl", "pk", "ph"):
        text = re.sub(rf"\b{name}\b", f"m{name}", text)
    return "mpl as" + text


@register(
    "k02_place_picks",
    f"""with {HARVILLE}, {_market_places()},
v as (select ph.contest_id, ph.finish_rank, ph.price, ph.n, (ph.p + ph.r2 + ph.r3) * 0.825 / greatest(mph.q + mph.r2 + mph.r3, 1e-9) as value
  from ph join mph using (contest_id, finish_rank))
select contest_id, finish_rank, {R('value')} as place_value from v where n >= 2 and value > {CFG.place_pick_ev} and price >= {CFG.place_pick_price}""",
    "runs",
)
def k02_picks(spark, sf):
    """Place picks of the core and satellite policy."""
    df = card(spark, sf).withColumns({"ev": F.round(C.ev("p", "price"), 9), "intent": F.round((F.col("weight") - 105) / 30, 9)})
    _, picks = policy.core_satellite(df, "contest_id", "finish_rank", "p", "price", "ev", "intent", oversized=views.oversized(spark, sf))
    return keyed(picks, r4("place_value").alias("place_value"))
