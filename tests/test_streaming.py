"""Streams replayed from files in several batches must agree with the batch result."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from contestframe.streaming import ticks as S

SCHEMA = "contest_id bigint, entrant_id bigint, price double, ts timestamp"


def files(spark, folder, *batches):
    """One Parquet file per batch, named in order."""
    for i, batch in enumerate(batches):
        data = [(c, e, float(p), t) for c, e, p, t in batch]
        df = spark.createDataFrame(data, "contest_id bigint, entrant_id bigint, price double, t string")
        df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(f"{folder}/b{i:02d}")


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False)
    return reader.parquet(f"{folder}/b*/part-*.parquet")


@pytest.fixture
def day(spark, tmp_path):
    folder = str(tmp_path / "in")
    files(
        spark, folder,
        [(1, 1, 5.0, "2026-09-09 11:00:00"), (1, 2, 8.0, "2026-09-09 11:00:10")],
        [(1, 1, 4.0, "2026-09-09 11:00:40"), (1, 2, 9.0, "2026-09-09 11:01:30")],
        [(1, 1, 4.0, "2026-09-09 11:04:00"), (1, 2, 9.0, "2026-09-09 11:04:30")],
        [(1, 1, 3.5, "2026-09-09 20:00:00"), (2, 7, 2.0, "2026-09-09 20:00:01")],
        [(2, 7, 2.1, "2026-09-09 20:00:05")],
    )
    return folder


def test_candles_over_batches(spark, day):
    got = rows(S.run(S.candles(S.drop_late(stream(spark, day)), "1 minute"), ["start", "contest_id", "entrant_id"]), "start", "entrant_id")
    first = got[0]
    assert (first["open"], first["high"], first["low"], first["close"], first["ticks"]) == (5.0, 5.0, 4.0, 4.0, 2)
    assert sum(r["ticks"] for r in got) == 9


def test_milestones_once(spark, day):
    posts = spark.createDataFrame([(1,), (2,)], "contest_id bigint").withColumn("post_at", F.lit("2026-09-09 11:05:00").cast("timestamp"))
    timed = S.to_post(stream(spark, day), posts)
    got = [(r["contest_id"], r["milestone"]) for r in S.run(S.milestones(timed, delay="20 hours"), mode="append").collect()]
    assert sorted(got) == [(1, "T-2m"), (1, "T-5m"), (2, "T-2m"), (2, "T-5m")]


def test_staged_alerts(spark, day):
    posts = spark.createDataFrame([(1,)], "contest_id bigint").withColumn("post_at", F.lit("2026-09-09 11:05:00").cast("timestamp"))
    got = {r["stage"] for r in S.run(S.staged_alerts(S.to_post(stream(spark, day), posts), delay="20 hours"), mode="append").collect()}
    assert got == {"T-10m", "T-3m", "T-45s"}


def test_baseline_age(spark, day):
    got = S.run(S.baseline(S.drop_late(stream(spark, day)), age_seconds=240), ["end", "contest_id", "entrant_id"]).collect()
    assert {(r["entrant_id"], r["base_price"], r["age"]) for r in got} == {(1, 5.0, 240.0), (2, 8.0, 260.0)}


def test_baseline_forgets_old_prices(spark, tmp_path):
    """Only ticks of the last four hours count: the price of the morning is no baseline in the evening."""
    folder = str(tmp_path / "ticks")
    files(spark, folder, [(1, 1, 8.0, "2026-09-09 08:00:00")], [(1, 1, 6.0, "2026-09-09 20:00:00"), (1, 1, 5.0, "2026-09-09 20:30:00")])
    got = S.run(S.baseline(S.drop_late(stream(spark, folder))), ["end", "contest_id", "entrant_id"]).collect()
    assert {(r["base_price"], r["age"]) for r in got} == {(6.0, 1800.0)}


def test_late_ticks_are_dropped(spark, tmp_path):
    """A batch drops what is older than the watermark of the batch before it."""
    folder = str(tmp_path / "late")
    files(spark, folder, [(1, 1, 5.0, "2026-09-09 10:00:00")], [(1, 1, 6.0, "2026-09-09 20:00:00")], [(1, 1, 6.1, "2026-09-09 20:00:30")], [(1, 1, 9.0, "2026-09-09 10:01:00")], [(1, 1, 6.5, "2026-09-09 20:01:00")])
    got = S.run(S.candles(S.drop_late(stream(spark, folder), "1 hour"), "1 hour"), ["start", "contest_id", "entrant_id"])
    highs = {str(r["start"]): (r["high"], r["ticks"]) for r in got.collect()}
    assert highs["2026-09-09 10:00:00"] == (5.0, 1) and highs["2026-09-09 20:00:00"] == (6.5, 3)


def test_episodes_once(spark, day):
    got = S.run(S.episodes(stream(spark, day), F.col("price") < 4.5, "1 minute", "10 minutes"), mode="append").collect()
    assert ("1", 1) in {(r["entrants"], r["contest_id"]) for r in got} and len(got) == len({(r["entrants"], r["contest_id"]) for r in got})


def test_audit_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "T-5m", 3, 0.2), (1, "T-5m", 4, 0.3)], "contest_id int, milestone string, entrant_id int, p double")
    for _ in range(2):
        S.audit_sink(df, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
