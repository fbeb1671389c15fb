"""Findings of round 3 about size: rows of a task, work of page queries."""

from dataclasses import replace

from conftest import rows
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.catalog import pipelines
from contestframe.config import CFG
from contestframe.learning import jobs
from contestframe.operators import aggregates
from contestframe.session import spread, written
from contestframe.sources import pages, views


def held(spark, check):
    """Runs `check` and sets the shuffle partitions back."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        check()
    finally:
        spark.conf.set(name, before)


def test_a_large_table_is_dealt_into_tasks_of_bounded_rows(spark, sf, monkeypatch):
    plain = rows(views.runs(spark, sf, True), "contest_id", "finish_rank")
    monkeypatch.setattr(views, "CFG", replace(CFG, hot_rows=1_000, task_rows=200))

    def check():
        dealt = views.runs(spark, sf, True)
        assert rows(dealt, "contest_id", "finish_rank") == plain
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 200 and sum(sizes) == len(plain)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= len(plain) / 200

    held(spark, check)


def test_shuffle_partitions_are_raised_but_never_lowered(spark):
    def check():
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        assert spread(spark, 100, 100, 10) is None and spark.conf.get("spark.sql.shuffle.partitions") == "6"
        assert spread(spark, 101, 100, 10) == 11 and spark.conf.get("spark.sql.shuffle.partitions") == "11"
        assert spread(spark, 101, 100, 50) == 3 and spark.conf.get("spark.sql.shuffle.partitions") == "11"

    held(spark, check)


PAGE = (
    "<table><tr><th>Pla.</th><th>No.</th><th>Horse</th><th>Sec</th></tr>"
    "<TR class='r'><td>1</td><td> <b>7</b>&nbsp;</td><td>A &amp; B <i>(K152)</i></td><td>23.10 x 24.55</td></tr >"
    "<tr><td>2</td><td>x</td><td>No number (K153)</td><td>none</td></tr>"
    "<tr><td>3</td><td>9</td><td title='(K154)'>No code</td><td>22.0</td></tr>"
    "<tr><td>(K155)</td></tr></table>"
)


def test_page_rows_are_parsed_once_and_as_before(spark, capsys):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page int, html string")
    found = pages.runner_map(df, "html", "page")
    assert [tuple(r) for r in found.collect()] == [(1, 7, "K152")]
    times = pages.parse_sectionals(df, "html", "page", n=2)
    assert [tuple(r) for r in times.collect()] == [(1, "K152", 24.55, None), (1, "K153", None, None)]
    for out in (found, times):
        capsys.readouterr()
        out.explain()
        plan = capsys.readouterr().out
        assert plan.count(r"\(([A-Z]\d{3})\)") == 1  # a filter above the exploded rows would parse them again


def test_the_values_of_a_large_frame_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(scale, "CFG", replace(CFG, hot_rows=100, block_rows=50))
    read = spark.sparkContext.accumulator(0)

    def noted(v):
        read.add(1)
        return float(v % 250)

    df = spark.range(1000).select(F.udf(noted, "double").asNondeterministic()("id").alias("x"))
    got = aggregates.quantiles(df, "x", {"low": 0.0, "mid": 0.5}, spark.range(1000)).first()
    assert (got["low"], got["mid"], read.value) == (0.0, 124.5, 1000)


def test_runs_without_ranks_are_the_same_runs(spark, sf):
    plain = views.runs(spark, sf, ranked=False)
    assert "finish_rank" not in plain.columns
    key = ("contest_id", "entrant_id", "draw")
    assert rows(plain, *key) == rows(views.runs(spark, sf).drop("finish_rank"), *key)


def test_the_stacker_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def noted(v):
        read.add(1)
        return float(v % 7)

    at = F.col("id")
    df = spark.range(400).select(
        F.floor(at / 4).alias("c"), at.alias("o"), F.udf(noted, "double").asNondeterministic()("id").alias("x"), (at % 4 == 0).cast("int").alias("won"), F.lit(0.25).alias("champion"))
    _, report = jobs.fit_stacker(df, "c", "o", ["x"], "won", "champion")
    assert report.count() == 1 and read.value == 400


def test_the_feature_frame_of_a_large_table_is_written_between_groups(spark, sf, monkeypatch):
    cols = [c for c, t in pipelines.features(spark, sf).dtypes if t != "double"]
    plain = rows(pipelines.features(spark, sf).select(*cols), "contest_id", "finish_rank")
    calls = []
    monkeypatch.setattr(views, "large", lambda *_: True)
    monkeypatch.setattr(pipelines, "written", lambda df: calls.append(1) or written(df))
    assert rows(pipelines.features(spark, sf).select(*cols), "contest_id", "finish_rank") == plain
    assert len(calls) == 3
