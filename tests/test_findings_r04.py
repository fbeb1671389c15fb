"""Tests of the findings of round 4."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestframe import scale, session
from contestframe.catalog import pipelines
from contestframe.config import CFG
from contestframe.learning import folds
from contestframe.operators import windows
from contestframe.operators.windows import History
from contestframe.plans.features import FEATURES, rider_features
from contestframe.sources import views

from conftest import assert_same, rows


def tables(spark):
    """Folders of the tables written so far."""
    top = f"{session.shared_dir(spark)}/tables".removeprefix("file://")
    return {f"{top}/{d}" for d in os.listdir(top)} if os.path.isdir(top) else set()


def test_a_written_frame_replaces_the_one_before(spark):
    before = tables(spark)
    keep, step = session.in_turn(session.written, session.written)
    out = step(keep(step(spark.range(10)).withColumn("a", F.col("id") + 1)).where("id < 7"))
    assert len(tables(spark) - before) == 1
    assert rows(out, "id") == [{"id": k, "a": k + 1} for k in range(7)]


def test_a_large_frame_is_on_disk_once_and_without_columns_nobody_reads(spark, sf, monkeypatch):
    """three tables stood side by side, each with every column of the runs and of the stages before."""
    seen = []
    monkeypatch.setattr(views, "large", lambda *_: True)
    monkeypatch.setattr(pipelines, "written", lambda df: seen.append(df.columns) or session.written(df))
    before = tables(spark)
    narrow = pipelines.features(spark, sf, ["contest_id", "finish_rank", "rider_win_rate", "speed_rank"])
    assert len(tables(spark) - before) == 1
    assert {"rider_text", "stable_roi", "pair_roi", "elapsed"}.isdisjoint(seen[-1]) and "rider_win_rate" in seen[-1]
    monkeypatch.undo()
    assert_same(narrow, pipelines.features(spark, sf), ["contest_id", "finish_rank"], ["rider_win_rate", "speed_rank"])
    assert pipelines.features(spark, sf).columns == FEATURES


def test_a_stage_shuffles_the_frame_once(spark, sf):
    """Runs met their days, riders and pairs in an exchange each."""
    df = pipelines.feature_input(spark, sf).withColumns({"is_win": F.col("finish_rank").eqNullSafe(1).cast("int"), "stable_season_wins": F.lit(1)})
    plan = rider_features(session.written(df), lambda *_: None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(rider_id") == 1
    assert "Exchange hashpartitioning(contest_date" not in plan.split("BroadcastExchange")[0]


def test_a_frame_with_hot_keys_equals_the_plain_one(spark, sf, monkeypatch):
    """at 6 GB conditions and stables are cut into blocks, on frames that the next stage's writer deletes."""
    columns = ["contest_id", "finish_rank", "last_speed_figure", "stable_roi", "stable_season_wins", "title_contender"]
    plain = pipelines.features(spark, sf, columns)
    monkeypatch.setattr(views, "CFG", replace(CFG, hot_rows=200, block_rows=80))
    monkeypatch.setattr(scale, "CFG", replace(CFG, hot_rows=200, block_rows=80))
    assert views.large(spark, sf) and views.hot(spark, sf, views.runs(spark, sf, stable=True), ["stable_id"]) is not None
    assert_same(pipelines.features(spark, sf, columns), plain, columns[:2], columns[2:], 1e-6)


@pytest.mark.parametrize("hot", [None, 300])
def test_moments_of_two_columns_are_those_of_each(spark, sf, hot):
    df = views.runs(spark, sf).withColumn("sec1", F.when(F.col("draw") != 2, F.col("elapsed") / 4))
    cuts = scale.cut_points(df, ["track"], "contest_ord", hot, 100) if hot else None
    h = History(("track",), cuts=cuts)
    both = windows.prior_moments(df, h, {"elapsed": ("m", "s"), "sec1": ("m1", "s1")})
    one = windows.prior_expanding(windows.prior_expanding(df, History(("track",)), "elapsed", "m", "s"), History(("track",)), "sec1", "m1", "s1")
    assert sorted(both.columns) == sorted(one.columns)
    assert_same(both, one, ["contest_id", "finish_rank"], ["m", "s", "m1", "s1"], 1e-9)


def dated(spark):
    rnd = np.random.default_rng(3)
    day, a = np.sort(rnd.integers(0, 600, 3000)), rnd.normal(size=3000)
    won = (rnd.random(3000) < 1 / (1 + np.exp(-0.7 * a))).astype(int)
    df = spark.createDataFrame([(k, int(d), float(v), int(w)) for k, (d, v, w) in enumerate(zip(day, a, won))], "id int, d int, a double, won int")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")


def test_the_rows_of_a_walk_are_written_as_columns(spark, monkeypatch):
    """a checkpoint held them row by row."""
    saved = []
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: pytest.fail("checkpoint"))
    out, found, _ = folds.walk_forward(dated(spark), "date", "won", ["a"], ["id"], step=3, keep_rows=lambda df: saved.append(1) or session.written(df))
    assert saved == [1] and len(found) >= 2 and out.where("p_model is null").isEmpty()


def test_the_report_is_one_pass_and_calibration_ends_when_it_stands_still(spark, monkeypatch):
    """three passes and always eight."""
    passes, original = [], folds._sums
    monkeypatch.setattr(folds, "_sums", lambda frame, jobs, *rest, **named: passes.append(jobs[0][3]) or original(frame, jobs, *rest, **named))
    _, found, frame = folds.walk_forward(dated(spark), "date", "won", ["a"], ["id"], step=3)
    assert 0 < sum(p is not None for p in passes) < folds.CALIBRATION_STEPS
    passes.clear()
    got = rows(folds.report(frame, found), "fold")
    assert len(passes) == 1
    days = {f.lo: [frame.where(c).count() for c in (f"day < {f.cut}", f"day >= {f.cut} and day < {f.lo}", f"day >= {f.lo} and day < {f.hi}")] for f in found}
    assert [[r["n_train"], r["n_valid"], r["n_test"]] for r in got] == [days[lo] for lo in sorted(days)]


def test_code_that_the_jvm_would_interpret_is_split(spark):
    """the pass over some sixty columns was one method of more than 8,000 bytes."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    session.compiled(spark)
    assert int(spark.conf.get(name)) == 8000
    spark.conf.set(name, "4000")
    session.compiled(spark)
    assert spark.conf.get(name) == "4000"
    spark.conf.unset(name)
