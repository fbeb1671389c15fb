"""Fixtures for rules that must not lose or invent values."""

import os

from pyspark.sql import functions as F

from contestframe.functions import columns as C
from contestframe.functions.groups import ewm_agg
from contestframe.operators import joins, topk
from contestframe.sources import pages, stores


def test_flags_at_every_place(spark):
    keys = ["pace", "nl", "v", "adj", "draw"]
    rows = []
    for shift in range(5):
        for value in range(13):
            order = keys[shift:] + keys[:shift]
            rows.append(("|".join(f"{k}={value}" for k in order) + "|steam", str(value)))
    df = spark.createDataFrame(rows, "flags string, want string").withColumn("f", C.parse_flags("flags"))
    for r in df.collect():
        assert r.f.ctx == dict.fromkeys(keys, r.want) and r.f.tags == ["steam"], r.flags


def test_wide_quoted_and_nested_run_files(spark, tmp_path):
    folder = tmp_path / "ra w"
    os.makedirs(folder / "20%26")
    wide = [f"c{k:02d}" for k in range(70)]
    (folder / "wide.csv").write_text(",".join(wide) + "\n" + ",".join(str(k) for k in range(70)) + "\n")
    (folder / "20%26" / "q.csv").write_text('﻿"c01","name, full",c69,c69\r\n7,"A ""B"", C",8,9\r\n', encoding="utf-8")
    got = stores.read_runs(spark, str(folder))
    assert set(got.columns) == {*wide, "name, full"}
    by = {r["c01"]: r for r in got.collect()}
    assert all(by["1"][c] == str(k) for k, c in enumerate(wide)) and by["1"]["name, full"] is None
    assert by["7"]["name, full"] == 'A "B", C' and by["7"]["c69"] == "8" and by["7"]["c00"] is None


def test_dead_heats_pay_every_combination(spark):
    text = "Dividend WIN 3 45.0 5 38.5 PLACE 3 12.0 5 13.0 7 15.0 9 21.0 FORECAST 3,5 80.0 5,3 90.5 Dividend Note"
    got = pages.payout_tokens(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"]).collect()
    assert [(r.pool, r.combo, r.payout) for r in sorted(got, key=lambda r: (r.group_no, r.pair_no))] == [
        ("WIN", "3", 45.0), ("WIN", "5", 38.5), ("PLACE", "3", 12.0), ("PLACE", "5", 13.0), ("PLACE", "7", 15.0), ("PLACE", "9", 21.0), ("FORECAST", "3,5", 80.0), ("FORECAST", "5,3", 90.5)]


def test_order_counts_in_ordered_pools(spark):
    kind = "contest_id int, pool string, combo string, payout double"
    paid = spark.createDataFrame([(1, "FORECAST", "1,2", 50.0), (1, "FORECAST", "2,1", 70.0), (1, "TIERCE", "2-5-7".replace("-", ","), 500.0), (1, "TRIO", "7,5,2", 90.0), (1, "TRIO", "2 5 7", 90.0)], kind)
    store = stores.read_payouts([paid, paid])
    assert store.count() == 4
    tickets = spark.createDataFrame([(1, "FORECAST", "2/1", 10.0), (1, "TIERCE", "7/2/5", 10.0), (1, "TIERCE", "2/5/7", 10.0), (1, "TRIO", "5/7/2", 10.0)], "contest_id int, pool string, combo string, stake double")
    for table in (store, paid):  # a payout that is listed twice pays once
        got = {(r.pool, r.combo): r.returned for r in joins.settle(tickets, table).collect()}
        assert got == {("FORECAST", "2/1"): 70.0, ("TIERCE", "7/2/5"): 0.0, ("TIERCE", "2/5/7"): 500.0, ("TRIO", "5/7/2"): 90.0}
        assert joins.settle(tickets, table).count() == 4


def test_settlement_by_code(spark):
    paid = spark.createDataFrame([(1, "QPL", "2,7", 30.0), (1, "WIN", "9", 20.0), (1, "FORECAST", "7,2", 99.0)], "contest_id int, pool string, combo string, payout double")
    runners = spark.createDataFrame([(1, 2, "K2"), (1, 7, "A7"), (1, 9, None), (2, 2, "Z9")], "contest_id int, number int, code string")
    coded = C.combo_codes(paid, runners, "contest_id", "number", "code")
    assert {r.pool: r.combo_codes for r in coded.collect()} == {"QPL": "K2/A7", "WIN": "9", "FORECAST": "A7/K2"}
    tickets = spark.createDataFrame([(1, "QPL", "A7/K2", 10.0), (1, "FORECAST", "K2/A7", 10.0)], "contest_id int, pool string, combo_codes string, stake double")
    got = {r.pool: r.returned for r in joins.settle(tickets, coded, combo="combo_codes").collect()}
    assert got == {"QPL": 30.0, "FORECAST": 0.0}


def test_partitioned_store_appended_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a", "d1", 1.0), (2, "b", "d2", 2.0)], "k int, e string, day string, x double")
    for more in range(2):
        stores.append_new(df, spark, path, ["k", "day"], partition_by=["day"])
        assert spark.read.parquet(path).count() == 2
    stores.append_new(df.withColumn("k", F.col("k") + 1), spark, path, ["k", "day"], partition_by=["day"])
    assert spark.read.parquet(path).count() == 4 and stores.stored(spark, str(tmp_path / "none")) is None


def test_places_of_a_whole_table(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 100).alias("x"))
    got = topk.placed(df, [F.col("x").desc_nulls_last(), F.col("id").asc()]).orderBy("place").collect()
    want = sorted(range(5000), key=lambda k: (k % 3 == 0, -(k % 100) if k % 3 else 0, k))
    assert [r.id for r in got] == want and [r.place for r in got] == list(range(1, 5001))


def test_exponential_mean_of_a_long_group(spark):
    xs = [float((7 * k) % 13) for k in range(400)]
    df = spark.createDataFrame([(1, len(xs) - 1 - k, x) for k, x in enumerate(xs)] + [(2, 0, 5.0)], "g int, newer int, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(ewm_agg("x", "newer", 5).alias("m")).collect()}
    acc = xs[0]
    for x in xs[1:]:
        acc = acc * (2 / 3) + x / 3
    assert abs(got[1] - acc) < 1e-9 and got[2] == 5.0
