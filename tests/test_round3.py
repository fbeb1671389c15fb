"""De-vig forms, tick cards, walk-forward folds, event tables and pruned appends."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contestframe.functions import columns as C
from contestframe.learning import folds
from contestframe.operators import field, market
from contestframe.sources import stores


def bisect(prices):
    """The exponent by halving, None without a root in [.01, 2]."""
    def book(a):
        return sum(p**-a for p in prices)

    lo, hi = 0.01, 2.0
    if book(lo) < 1 or book(hi) > 1:
        return None
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if book(mid) > 1 else (lo, mid)
    return lo


def test_devig_forms_agree_with_halving(spark):
    rnd = random.Random(4)
    fields = [[rnd.choice((1.01, 1.5, 2.4, 6.0, 12.5, 40.0, 999.0)) * rnd.uniform(1, 1.3) for _ in range(rnd.choice((1, 2, 5, 9, 14)))] for _ in range(150)]
    fields += [[1.0, 1.0], [1.0], [1.0, 3.0], [rnd.uniform(20, 400) for _ in range(3000)], [500.0] * 20]
    rows = [(c, float(p)) for c, prices in enumerate(fields) for p in prices] + [(0, None), (1, 0.0), (9999, None)]
    df = spark.createDataFrame(rows, "c bigint, price double")
    for how in ("window", "join"):
        got = {r["c"]: r["_alpha"] for r in field.devig_alpha(df, "c", "price", how).collect()}
        for c, prices in enumerate(fields):
            want = bisect(prices)
            assert (got[c] is None) == (want is None), (how, c)
            assert want is None or abs(got[c] - want) < 1e-9, (how, c, prices[:5])
        shares = field.devig_power(df, "c", "price", "q", how=how).groupBy("c").agg(F.sum("q").alias("s"), F.count("q").alias("n")).collect()
        assert all(r["n"] == 0 or abs(r["s"] - 1) < 1e-9 for r in shares)
        assert {r["c"]: r["n"] for r in shares}[0] == len(fields[0])


def test_card_reads_ticks_twice_and_hashes(spark, sf):
    plan = entry.queries()["f27_score_card"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 2
    ticks = spark.createDataFrame([(1, 1, 5.0, 2.0, "2026-01-01 10:00:00")], "contest_id bigint, entrant_id bigint, price double, place_price double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    card = market.tick_card(ticks, "contest_id", "entrant_id", "ts", F.lit("2026-01-01 11:00:00").cast("timestamp"), {"flow": 90}, ["price", "place_price"])
    assert "SortAggregate" not in card._jdf.queryExecution().executedPlan().toString()


def test_card_values(spark):
    rows = [(1, 1, 1.0, 1.0, 0), (1, 1, 5.0, 2.0, 60), (1, 1, 4.0, None, 120), (1, 1, 4.0, 1.8, 200), (1, 2, 1.01, 1.1, 10), (1, 2, 9.0, 3.0, 70), (2, 7, 3.0, 1.5, 30)]
    ticks = spark.createDataFrame([(c, e, p, q, s) for c, e, p, q, s in rows], "contest_id bigint, entrant_id bigint, price double, place double, s int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    now = F.timestamp_seconds(F.lit(1_700_000_250))
    got = {(r["contest_id"], r["entrant_id"]): r for r in market.tick_card(ticks, "contest_id", "entrant_id", "ts", now, {"flow": 90}, ["price", "place"]).collect()}
    a, b, d = got[1, 1], got[1, 2], got[2, 7]
    assert (a["polls"], a["price"], a["prev_price"], a["prev_place"], a["flow_base_price"], a["flow_base_place"], a["flow_in_price"]) == (4, 4.0, 4.0, None, 4.0, None, 4.0)
    assert (a["open_price"], b["open_price"], d["open_price"]) == (5.0, 9.0, 3.0)
    assert a["frozen"] and a["last_move"] == b["last_move"] and not d["frozen"] and d["prev_price"] is None
    assert (b["flow_in_price"], b["flow_base_price"]) == (1.01, 9.0)


def plain_fit(x, y, penalty):
    beta, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - ridge @ beta)
    return beta


@pytest.mark.parametrize("penalty", [1e-3, 20.0])
def test_folds_fitted_together_equal_single_fits(spark, penalty):
    rnd = np.random.default_rng(1)
    day = np.sort(rnd.integers(0, 500, 900))
    a, b = rnd.normal(size=900), rnd.normal(3, 2, 900)
    y = (rnd.random(900) < 1 / (1 + np.exp(-(0.8 * a - 0.3 * (b - 3))))).astype(int)
    rows = [(k, int(d), float(u), None if k % 50 == 0 else float(v), int(w)) for k, (d, u, v, w) in enumerate(zip(day, a, b, y))]
    df = spark.createDataFrame(rows, "id int, d int, a double, b double, won int").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).repartition(5)
    out, found, frame = folds.walk_forward(df, "date", "won", ["a", "b"], ["id"], start=6, step=3, penalties=(penalty,))
    local = sorted(((r["id"], r["day"], r["y"], list(r["x"])) for r in frame.collect()))
    days, ys, xs = np.array([r[1] for r in local]), np.array([r[2] for r in local]), np.array([r[3] for r in local])
    assert len(found) >= 3 and all(f.cut < f.lo < f.hi for f in found)
    for f in found:
        past = days < f.cut
        assert 0.8 * (days < f.lo).sum() <= past.sum() < 0.83 * (days < f.lo).sum()
        assert np.allclose(f.beta, plain_fit(xs[past], ys[past], penalty), atol=1e-6) and f.gradient < 1e-8
        valid = (days >= f.cut) & (days < f.lo)
        z = xs[valid] @ f.beta
        p = 1 / (1 + np.exp(-(f.scale[0] + f.scale[1] * z)))
        assert abs(p.sum() - ys[valid].sum()) < 1e-3  # a calibration by likelihood keeps the mean
    scored = out.collect()
    assert sorted(r["id"] for r in scored) == [k for k, d in zip(range(900), days) if d >= found[0].lo]
    by = {f.lo: f for f in found}
    for r in scored[:50]:
        f = by[(np.datetime64(r["fold"], "D")).astype(int)]
        assert f.lo <= r["day"] < f.hi and abs(r["score"] - np.dot(r["x"], f.beta)) < 1e-9


def test_events_are_bound_by_header_in_every_folder(spark, tmp_path):
    (tmp_path / "e" / "deep").mkdir(parents=True)
    (tmp_path / "e" / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "e" / "deep" / "b.csv").write_text("y,x\nc,2\n")
    got = stores.read_events(spark, str(tmp_path / "e"), ["x", "y", "z"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", "b", None), ("2", "c", None)]
    assert stores.read_events(spark, str(tmp_path / "none"), ["x"]).collect() == []


def test_positions_beyond_an_int(spark):
    early, gained = C.position_path("p")
    df = spark.createDataFrame([("99999999999 3",), ("7 5 1",), ("4",)], "p string").select("p", early.alias("e"), gained.alias("g"))
    assert {r["p"]: (r["e"], r["g"]) for r in df.collect()} == {"99999999999 3": (None, None), "7 5 1": (7, 6), "4": (None, None)}


def test_second_append_reads_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = spark.range(4000).select((F.col("id") % 400).alias("contest_id"), F.concat(F.lit("T-"), (F.col("id") % 10).cast("string")).alias("milestone"), F.col("id").alias("entrant_id"))
    keys = ["contest_id", "milestone", "entrant_id"]
    stores.append_new(df, spark, path, keys, buckets=64)
    batch = df.where("contest_id in (3, 77)")
    seen = []

    original = stores.joins.new_only
    stores.joins.new_only = lambda fresh, have, k: seen.append(have) or original(fresh, have, k)
    try:
        stores.append_new(batch, spark, path, keys, buckets=64)
    finally:
        stores.joins.new_only = original
    read = seen[0].select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("bucket=")[1].split("/")[0] for r in read}) <= 2
    assert "PartitionFilters: [(bucket" in seen[0]._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [((bucket" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(path).count() == 4000
