"""Inputs that larger tables hold: equal times, equal edges, prices of 1, more entrants than codes."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contestframe.operators import aggregates, field
from contestframe.sources import views
from tools.check import TABLES, canonical


def changed(tmp_path, sf, **sql):
    """The tables of `sf` in a new folder, the named ones as their SQL over the old ones gives them."""
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        if t not in sql:
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    for t, text in sql.items():
        con.sql(text).write_parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = canonical(entry.queries()[name](spark, folder).toPandas()), canonical(con.sql(entry.oracle_sql()[name]).df())
    return got.equals(want)


def test_equal_edges_keep_the_smaller_partner(spark):
    """One strong entrant and eight equal ones: its best five pairs are those with the first five."""
    rows = [(1, 1, 0.6, 20.0)] + [(1, e, 0.05, 10.0) for e in range(2, 10)]
    df = spark.createDataFrame(rows, "c int, e int, p double, price double").withColumn("s", F.lit(60.0))
    got = field.overlay_pairs(df, "c", "e", "p", "price", "s").orderBy("rank").collect()
    assert [(r["leg_a"], r["leg_b"]) for r in got] == [(1, k) for k in range(2, 7)]


def test_prices_of_one_count_where_asked(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 2, 4.0, 1.0), (1, 3, 1.0, 1.0), (1, 4, 4.0, 2.0)], "c int, e int, now double, base double")
    log = {r["e"]: r["v"] for r in df.select("e", field.velocity("now", "base", even=True)["logit_velocity"].alias("v")).collect()}
    assert log[1] == float("-inf") and log[2] == float("inf") and log[3] != log[3] and abs(log[4] - 1.0986122886681098) < 1e-12
    plain = {r["e"]: r["v"] for r in df.select("e", field.velocity("now", "base")["logit_velocity"].alias("v")).collect()}
    assert plain[1] is plain[2] is plain[3] is None
    score = {r["e"]: r["s"] for r in field.flow_score(df, "c", "now", "base", "s", even=True).collect()}
    mean = (2 / 3 - 0.75 + 0 - 0.25) / 4
    assert abs(score[3] - (50 - 200 * mean)) < 1e-9 and score[1] == 100 and score[2] == 0


@pytest.mark.parametrize("name", ["f23_velocity_ticks", "f27_score_card", "a19_meeting_overview", "a20_field_kpis"])
def test_ticks_with_prices_of_one(spark, sf, tmp_path, name):
    """The last quote before the decision of one user, and the first quote of another, are 1."""
    ones = f"""select * replace (case when event_id in (select arg_max(event_id, ts) from events where ts <= timestamp '{views.DECISION_AT}' and user_id = 3
      union all select arg_min(event_id, ts) from events where user_id = 7) then 0.0 else value end as value) from events order by ts"""
    assert same_as_sql(spark, changed(tmp_path, sf, events=ones), name)


def test_report_lines_of_entrants_whose_ids_end_alike(spark, sf, tmp_path):
    """Two entrants of a contest lie 26,000 ids apart, as many as there are codes."""
    pair = "select * replace (case when l_linenumber % 2 = 0 then 5 else 26005 end as l_partkey) from lineitem"
    assert same_as_sql(spark, changed(tmp_path, sf, lineitem=pair), "h05_attribute_text")


def test_equal_times_rank_alike_in_any_row_order(spark, sf, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    coarse = "select * replace (round(l_extendedprice / 40000) as l_extendedprice) from lineitem order by {}"
    a, b = (views.runs(spark, changed(tmp_path / k, sf, lineitem=coarse.format(o))) for k, o in (("a", "l_partkey, l_quantity"), ("b", "l_partkey desc, l_quantity desc")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_ledger_totals_are_written_once(spark, sf):
    """What looks for hot keys and what adds up read the written totals, not the runs again."""
    plan = entry.queries()["k05_flat_ledger"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_ratio_at_the_limit_counts(spark):
    df = spark.createDataFrame([(1.05 / 4 - 1e-13, 4.0, 4.0, 1), (1.04 / 4, 4.0, 4.0, 1)], "p double, price double, final_price double, finish_rank int")
    assert aggregates.dual_track(df, "p", 2.0, 8.0, 1.05).first()["decisions"] == 1
