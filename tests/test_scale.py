"""Every split path must give what the plain window gives, on data where one key holds a third of the rows."""

import dataclasses

import pytest
from conftest import assert_same
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG
from contestframe.operators import aggregates, field, joins, market, policy, windows
from contestframe.operators.windows import History
from contestframe.sources import views

KEYS = ["contest_id", "finish_rank"]


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """Runs in which one rider and one entrant hold about a third of all rows."""
    df = views.runs(spark, sf)
    third = F.pmod(F.xxhash64("contest_id", "finish_rank"), F.lit(3)) == 0
    df = df.withColumns(
        {
            "rider_id": F.when(third, F.lit(1)).otherwise(F.col("rider_id")),
            "entrant_id": F.when(third, F.lit(1)).otherwise(F.col("entrant_id")),
            "win": (F.col("finish_rank") == 1).cast("int"),
            "place": (F.col("finish_rank") <= 3).cast("int"),
        }
    ).cache()
    assert df.where("rider_id = 1").count() > df.count() / 4
    return df


def both(df, keys, order="contest_ord", ties=("finish_rank",), frame="prior_contest"):
    cuts = scale.cut_points(df, list(keys), order, hot_rows=100, block_rows=40)
    made = cuts.collect()
    assert made and any(len(r["_cuts"]) > 3 for r in made)
    plain = History(tuple(keys), order, tuple(ties), frame)
    return plain, dataclasses.replace(plain, cuts=cuts)


CASES = {
    "rates": lambda d, h: windows.rolling_rates(d, h, {"a": "win", "b": "place"}),
    "short": lambda d, h: windows.rolling_mean(d, h, "price", "a", 3).withColumn("b", F.lit(0)),
    "roi": lambda d, h: windows.rolling_roi(d, h, "win", "price", "a").withColumn("b", F.lit(0)),
    "expanding": lambda d, h: windows.prior_expanding(d, h, "elapsed", "a", "b"),
    "ewm": lambda d, h: windows.ewm(d, h, {"a": "win", "b": "price"}),
    "lags": lambda d, h: windows.lags(d, h, {"a": ("price", 1), "b": ("price", 2)}),
    "starts": lambda d, h: windows.career_starts(d, h, "a").withColumn("b", F.lit(0)),
    "sum": lambda d, h: windows.prior_sum(d, h, "win", "a").withColumn("b", F.lit(0)),
    "first": lambda d, h: windows.first_time(d, h, "win", "a").withColumn("b", F.lit(0)),
    "days": lambda d, h: windows.days_since(d, h, "contest_date", "a").withColumn("b", F.lit(0)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("frame", ["prior_contest", "prior_row"])
def test_split_history(skewed, case, frame):
    plain, split = both(skewed, ["rider_id"], frame=frame, ties=("contest_id", "finish_rank"))
    assert_same(CASES[case](skewed, plain), CASES[case](skewed, split), KEYS, ["a", "b"], 1e-7)


def test_lookback_longer_than_blocks(spark):
    """Blocks far smaller than the look-back still see all of it."""
    df = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("x"))
    cuts = scale.cut_points(df, ["k"], "o", hot_rows=10, block_rows=5)
    plain, split = History(("k",), "o"), History(("k",), "o", cuts=cuts)
    assert_same(windows.rolling_mean(df, plain, "x", "m", 50), windows.rolling_mean(df, split, "x", "m", 50), ["o"], ["m"])


def test_probe_is_none_when_cold(skewed):
    assert scale.probe(skewed, ["rider_id"], "contest_ord") is None


def test_drawdown_split(skewed):
    df = skewed.withColumns({"o": F.col("contest_ord") * 100 + F.col("finish_rank"), "equity": 1000 + F.col("price") * F.col("draw")})
    cuts = scale.cut_points(df, ["rider_id"], "o", hot_rows=100, block_rows=40)
    assert_same(windows.drawdown(df, ["rider_id"], "o", "equity"), windows.drawdown(df, ["rider_id"], "o", "equity", cuts), KEYS, ["peak", "drawdown"])


def test_asof_join_split(spark, sf):
    df = views.ticks(spark, sf)
    left, right = df.where("source = 'purchase'"), df.where("source = 'view'").withColumnRenamed("ts", "r_ts").select("contest_id", "r_ts", "price")
    cuts = scale.cut_points(df.withColumn("_at", F.unix_micros("ts")), ["contest_id"], "_at", hot_rows=50, block_rows=20)
    assert cuts.count() > 0
    a, b = (joins.asof_join(left, right, ["contest_id"], "ts", "r_ts", ["price"], c) for c in (None, cuts))
    assert_same(a, b, ["entrant_id", "ts"], ["asof_price", "asof_at"])


def test_last_move_split(spark, sf):
    df = views.ticks(spark, sf)
    now = F.lit("2024-02-01").cast("timestamp")
    cuts = scale.cut_points(df.withColumn("_us", F.unix_micros("ts")), ["contest_id", "entrant_id"], "_us", hot_rows=10, block_rows=5)
    assert cuts.count() > 0
    a, b = (market.last_move(df, "contest_id", "entrant_id", "ts", "price", now, cuts=c) for c in (None, cuts))
    assert_same(a, b, ["contest_id"], ["last_move", "frozen"])


def test_quantiles_split(skewed, monkeypatch):
    want = aggregates.quantiles(skewed, "elapsed", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    exact = skewed.agg(*[F.percentile("elapsed", F.lit(p)) for p in (0.25, 0.5, 0.9)]).first()
    monkeypatch.setattr(scale, "probe", lambda d, k, o, **_: scale.cut_points(d, k, o, hot_rows=50, block_rows=300))
    split = aggregates.quantiles(skewed, "elapsed", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    for got in (want, split):
        assert [round(x, 9) for x in got] == [round(x, 9) for x in exact]


def test_attach_join_equals_window(skewed):
    aggs = {"n": F.count(F.lit(1)), "m": F.avg("price")}
    assert_same(scale.attach(skewed, ["rider_id"], aggs), scale.attach(skewed, ["rider_id"], aggs, "window"), KEYS, ["n", "m"])


SMALL = dataclasses.replace(CFG, field_limit=3, chunk=2)


def test_oversized_fields(skewed):
    """Fields beyond the array limit go through packs and must agree with the one-array path."""
    df = skewed.withColumn("w", 1.0 / (F.col("draw") + 2))
    a = field.rank4(field.rank3(df, "contest_id", "finish_rank", "w"), "contest_id", "finish_rank", "w")
    b = field.rank4(field.rank3(df, "contest_id", "finish_rank", "w", cfg=SMALL), "contest_id", "finish_rank", "w", cfg=SMALL)
    assert_same(a, b, KEYS, ["p_rank2", "p_rank3", "p_rank4"])


def test_oversized_overlay(skewed):
    df = field.normalise(skewed.withColumns({"w": 1.0 / (F.col("draw") + 2), "s": F.col("draw") * 12.0}), "contest_id", "w", "p")
    a = field.overlay_pairs(df, "contest_id", "finish_rank", "p", "price", "s")
    b = field.overlay_pairs(df, "contest_id", "finish_rank", "p", "price", "s", cfg=SMALL)
    assert_same(a, b, ["contest_id", "leg_a", "leg_b"], ["best_edge"])


def test_bankroll_matches_a_plain_loop(spark, sf):
    """Compounding by running logarithms with refined minimum bets equals the sequential loop."""
    df = views.runs(spark, sf).where("finish_rank <= 3")
    ledger = df.select(
        F.lit("s").alias("strategy"), "contest_ord", (F.col("draw") / 400).alias("f"), (F.col("price") * 0.35).alias("price"),
        (F.col("finish_rank") == 1).cast("int").alias("win"),
    )
    ledger = ledger.unionByName(ledger.withColumns({"strategy": F.lit("t"), "f": F.col("f") / 8}))
    cuts = scale.cut_points(ledger, ["strategy"], "contest_ord", hot_rows=100, block_rows=100)
    path = policy.bankroll_path(ledger, "strategy", "contest_ord", "f", "price", "win")
    split = policy.bankroll_path(ledger, "strategy", "contest_ord", "f", "price", "win", cuts=cuts)
    got = {r["strategy"]: r for r in policy.bankroll_summary(path, "strategy").collect()}
    again = {r["strategy"]: r for r in policy.bankroll_summary(split, "strategy").collect()}
    skipped = 0
    for name in ("s", "t"):
        bets: dict = {}
        for r in ledger.where(F.col("strategy") == name).collect():
            bets.setdefault(r["contest_ord"], []).append(r)
        level, n = 10_000.0, 0
        for o in sorted(bets):
            stakes = [(level * r["f"], r) for r in bets[o]]
            skipped += sum(s < 5 for s, _ in stakes)
            placed = [(s, r) for s, r in stakes if s >= 5]
            n += len(placed)
            level += sum(s * (r["price"] - 1) if r["win"] else -s for s, r in placed)
        for side in (got, again):
            assert side[name]["bets"] == n
            assert abs(side[name]["final_bankroll"] - level) < 1e-6 * max(level, 1)
    assert skipped > 0


def test_top_pairs_needs_only_the_best(spark, sf):
    from contestframe.operators import topk

    df = views.runs(spark, sf)
    got = {(r["contest_id"], r["pair_rank"]): r["pair_score"] for r in topk.top_pairs(df, ["contest_id"], "finish_rank", "price", 5).collect()}
    legs: dict = {}
    for r in df.select("contest_id", "price").collect():
        legs.setdefault(r[0], []).append(r[1])
    want = {}
    for c, xs in legs.items():
        sums = sorted((a + b for i, a in enumerate(xs) for b in xs[i + 1 :]), reverse=True)[:5]
        want |= {(c, i + 1): s for i, s in enumerate(sums)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_no_look_ahead(skewed):
    """Earlier rows do not change when later contests are removed."""
    cut = skewed.agg(F.percentile_approx("contest_ord", 0.6)).first()[0]
    early = skewed.where(F.col("contest_ord") <= cut)
    h = History(("rider_id",), ties=("contest_id", "finish_rank"))
    build = lambda d: windows.ewm(windows.rolling_rates(d, h, {"a": "win"}), h, {"b": "price"})
    whole = build(skewed).where(F.col("contest_ord") <= cut)
    assert_same(build(early), whole, KEYS, ["a", "b"])


def test_same_contest_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame([(1, 1, 7, 1, 1), (1, 1, 7, 2, 0), (2, 2, 7, 1, 0)], "contest_id int, contest_ord bigint, k int, finish_rank int, win int")
    by = lambda frame: {(r["contest_id"], r["finish_rank"]): r["a"] for r in windows.rolling_rates(df, History(("k",), "contest_ord", ("finish_rank",), frame), {"a": "win"}).collect()}
    contest, row = by("prior_contest"), by("prior_row")
    assert contest[(1, 1)] == contest[(1, 2)] == 0.0 and contest[(2, 1)] == 0.5
    assert row[(1, 2)] == 1.0


def test_window_spec_is_total(skewed):
    """Two shuffled copies give the same lags."""
    h = History(("rider_id",), ties=("contest_id", "finish_rank"))
    a = windows.lags(skewed.repartition(7), h, {"a": ("price", 1)})
    b = windows.lags(skewed.repartition(3, "draw"), h, {"a": ("price", 1)})
    assert_same(a, b, KEYS, ["a"])
    assert W is not None
