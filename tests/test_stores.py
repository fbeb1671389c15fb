"""Readers and writers on literal files."""

import os

from pyspark.sql import functions as F

from contestframe.sources import stores

HEAD = "track,race_date,race_number,race_class,distance,course_type,horse_name,horse_code,finish_position,finishing_time,jockey,trainer,weight_carried,barrier_draw,win_odds"


def write(folder, name, header, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join([header, *lines]) + "\n")


def test_read_runs_binds_by_header(spark, tmp_path):
    d = str(tmp_path / "raw")
    write(d, "a.csv", HEAD, 'Sha Tin,2026/04/15,1,Class 4,1200,"TURF - ""C"" Course",Abc,K001,1,70.1,J A,T A,120,3,4.5', 'Sha Tin,2026/04/15,1,Class 4,1200,"TURF - ""C"" Course",Def,K002,,71,J B,T B,118,4,9')
    write(d, "b.csv", "win_odds,finish_position,race_date,race_number,track,horse_name,gear,weight_carried,barrier_draw,horse_code,finishing_time",
          "7.5,2 DH,2026-04-16,10,Happy Valley,Ghi,B,125,1,,69.5", "3,1 DH,2026-04-16,2,Happy Valley,Jkl,,125,2,K009,69.0")
    raw = stores.read_runs(spark, d)
    assert set(dict(raw.dtypes).values()) == {"string"}
    rows = {r["horse_name"]: r for r in raw.collect()}
    assert rows["Abc"]["course_type"] == 'TURF - "C" Course' and rows["Abc"]["gear"] is None
    assert rows["Ghi"]["win_odds"] == "7.5" and rows["Ghi"]["race_class"] is None
    clean = {r["horse_name"]: r for r in stores.clean_runs(raw).collect()}
    assert set(clean) == {"Abc", "Ghi", "Jkl"}  # one blank finish costs one row, not the file
    assert clean["Ghi"]["finish_rank"] == 2 and clean["Ghi"]["is_win"] == 0 and clean["Jkl"]["is_win"] == 1
    assert clean["Ghi"]["entrant_code"] == "Ghi" and clean["Ghi"]["contest_id"] == "2026-04-16_Race10"
    assert clean["Jkl"]["contest_ord"] < clean["Ghi"]["contest_ord"]
    assert clean["Abc"]["body_weight"] == 1200.0 and clean["Abc"]["incident_report"] == ""


def test_append_new_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "WIN", "1", 10.0), (1, "WIN", "1", 10.0), (2, "WIN", "3", 20.0)], "contest_id int, pool string, combo string, payout double")
    for _ in range(2):
        stores.append_new(df, spark, path, ["contest_id", "pool", "combo"])
        assert spark.read.parquet(path).count() == 2
    stores.append_new(df.withColumn("contest_id", F.col("contest_id") + 1), spark, path, ["contest_id", "pool", "combo"])
    assert spark.read.parquet(path).count() == 4


def test_events_missing_file(spark, tmp_path):
    df = stores.read_events(spark, str(tmp_path / "none"), ["horse_code", "time_400"])
    assert df.columns == ["horse_code", "time_400"] and df.count() == 0
    write(str(tmp_path / "ev"), "t.csv", "horse_code,rider", "K1,A")
    got = stores.read_events(spark, str(tmp_path / "ev"), ["horse_code", "time_400"]).first()
    assert got["horse_code"] == "K1" and got["time_400"] is None


def test_ticks_roundtrip_prunes(spark, tmp_path):
    path = str(tmp_path / "ticks")
    df = spark.createDataFrame([(1, 1, 4.0, "2026-09-09 11:00:00", "HV"), (1, 1, 3.0, "2026-09-09 11:02:00", "HV"), (2, 1, 9.0, "2026-09-10 11:00:00", "ST")], "contest_id int, entrant_id int, price double, t string, venue string")
    df = df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    posts = spark.createDataFrame([(1,), (2,)], "contest_id int").withColumn("post_at", F.lit("2026-09-09 11:03:00").cast("timestamp"))
    labelled = stores.label_ticks(df, posts)
    late = labelled.where("ts = '2026-09-09 11:02:00'").first()
    assert late["state"] == "TURBO_APPROACH" and abs(late["velocity"] + 0.25) < 1e-12
    stores.write_ticks(labelled, path)
    day = stores.read_ticks(spark, path, "2026-09-09", "hv")
    assert day.count() == 2
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan.replace("#", "") or "PartitionFilters" in plan


def test_features_ledger_and_json(spark, tmp_path, sf):
    from contestframe.catalog.ledger import audit
    from contestframe.operators import policy
    from contestframe.sources import views

    df = spark.createDataFrame([(1, 2.0, 2025), (2, 3.0, 2026)], "contest_id int, figure double, season int")
    stores.write_features(df, str(tmp_path / "f"), ["contest_id", "missing", "figure"])
    assert spark.read.parquet(str(tmp_path / "f")).where("season = 2026").first()["figure"] == 3.0
    stores.write_ledger(df, str(tmp_path / "l"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == 2
    settled = policy.settle_audit(audit(spark, sf), views.payouts(spark, sf))
    stores.write_settlement_json(settled, str(tmp_path / "j"))
    docs = spark.read.json(str(tmp_path / "j"))
    assert {"contest_id", "milestone", "pools"} <= set(docs.columns)
    total = docs.select(F.explode("pools").alias("p")).agg(F.sum("p.n")).first()[0]
    assert total == settled.count()


def test_entrant_codes_are_dense(spark):
    df = spark.range(500).select(F.concat(F.lit("K"), (F.col("id") % 137).cast("string")).alias("k"))
    got = {r["k"]: r["code"] for r in stores.entrant_codes(df, "k", "code").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_drop_store(spark):
    spark.sql("create or replace temp view keepme as select 1 as x")
    stores.drop_store(spark, "no_such_store")
    assert spark.table("keepme").count() == 1


def test_csv_to_features(spark, tmp_path):
    """From files to the feature frame and back from the feature store."""
    from contestframe.plans.features import FEATURES, build_features, from_store

    head = HEAD + ",running_position,horse_weight,track_condition,sec1_time"
    for day in range(1, 6):
        lines = []
        for race in (1, 2, 10):
            for i in range(1, 5):
                who = (i + day + race) % 6
                rider = "C L Chau" if i == 2 else f"R {i}"
                lines.append(
                    f'Sha Tin,2026/03/0{day},{race},Class 4,1200,"TURF - ""A"" Course",H{who},K{who:03d},{i if i < 4 else "DNF" if race == 2 else 4},{70 + i / 10},{rider},T {i % 2},{115 + i},{i},{2 + i},{5 - i} 2 {i},1100,GOOD,{13 + i / 10}'
                )
        write(str(tmp_path / "raw"), f"2026-03-0{day}.csv", head, *lines)
    clean = stores.clean_runs(stores.read_runs(spark, str(tmp_path / "raw")))
    assert clean.count() == 5 * (4 + 3 + 4)
    feats = build_features(from_store(clean), lambda *_: None)
    stores.write_features(feats, str(tmp_path / "features"), FEATURES)
    back = spark.read.parquet(str(tmp_path / "features"))
    assert back.count() == clean.count() and set(back.columns) == set(FEATURES)
    first = back.where("contest_id = '2026-03-01_Race1'").collect()
    assert all(r["career_starts"] == 0 and r["entrant_win_rate"] == 0 and r["days_since_last"] == 365 for r in first)
    assert {r["claim"] for r in back.where("finish_rank = 2 and contest_date = '2026-03-01'").collect()} == {10}
    race10 = back.where("contest_id = '2026-03-01_Race10'").collect()
    assert max(r["career_starts"] for r in race10) == 2  # race 10 comes after races 1 and 2
    assert all(abs(r["speed_figure"]) <= 4.5 for r in back.collect())
