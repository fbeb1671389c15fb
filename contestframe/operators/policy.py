"""Selection, stake sizing and ledgers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators import field, joins, topk
from contestframe.session import checkpointed


def eligible(pool: str, cfg: Config = CFG) -> Column:
    """Policy test of an audit row (p, price, ev, score, place_price, place_ev) for WIN or PLACE."""
    score = F.col("score")
    if pool == "WIN":
        return (
            (F.coalesce("ev", F.lit(-9.0)) >= cfg.win_ev)
            & (F.coalesce("price", F.lit(0.0)) >= cfg.win_lo)
            & (F.coalesce("price", F.lit(99.0)) <= cfg.win_hi)
            & (F.coalesce("p", F.lit(0.0)) >= cfg.win_p)
            & (F.coalesce(score, F.lit(cfg.win_score)) >= cfg.win_score)
        )
    return (
        (F.coalesce("place_ev", F.lit(0.0)) >= cfg.place_ev)
        & (F.coalesce("place_price", F.lit(0.0)) >= cfg.place_lo)
        & (F.coalesce(score, F.lit(cfg.place_score)) >= cfg.place_score)
    )


def bankers(df: DataFrame, c: str, e: str, price: str, ev: str, cfg: Config = CFG) -> DataFrame:
    """Two-tier bankers; an entrant in both keeps tier 1."""
    def tier(bounds: tuple) -> DataFrame:
        lo, hi, least = bounds
        return df.where(F.col(price).between(lo, hi) & (F.col(ev) >= least))

    one = tier(cfg.tier1).withColumn("tier", F.lit(1))
    two = tier(cfg.tier2).withColumn("tier", F.lit(2))
    cols = [c, e, "tier", ev]
    return topk.union_priority([one.select(*cols), two.select(*cols)], [c, e])


def core_satellite(df: DataFrame, c: str, e: str, p: str, price: str, ev: str, intent: str, signals: Sequence[str] = (), oversized: bool | None = None, cfg: Config = CFG):
    """(banker x satellite pairs with tier, place picks) of every contest with two priced entrants."""
    known = df.where(F.col(p).isNotNull() & F.col(price).isNotNull())
    known = scale.attach(known, [c], {"_size": F.count(F.lit(1))}, "window").where("_size >= 2")
    wanted = F.coalesce(F.col(intent), F.lit(0.0)) >= cfg.satellite_intent
    for s in signals:
        wanted = wanted | (F.coalesce(F.col(s), F.lit(0)) == 1)
    legs = known.where((F.col(price) >= cfg.satellite_price) & wanted).withColumn("_i", F.coalesce(F.col(intent), F.lit(0.0)))
    picked = bankers(known, c, e, price, ev, cfg)
    pairs = joins.cross_top(picked, legs, c, e, "_i", cfg.satellite_max).select(c, "banker", "satellite", "tier")

    both = known.select(c, e, price, p, (1 / F.col(price)).alias("_q"))
    both = field.place_harville(both, c, e, p, "_pm", oversized=oversized)
    both = field.place_harville(both, c, e, "_q", "_pk", oversized=oversized)
    value = F.col("_pm") * field.place_payout("_pk", cfg.takeout_place)
    picks = both.withColumn("place_value", value).where(
        (F.col("place_value") > cfg.place_pick_ev) & (F.col(price) >= cfg.place_pick_price)
    ).select(c, e, "place_value")
    return pairs, picks


def kelly_field(df: DataFrame, c: str, e: str, p: str, price: str, cfg: Config = CFG) -> DataFrame:
    """Stake fractions of mutually exclusive outcomes, taken in falling EV order.

    A row is taken while its EV ratio exceeds (1 - sum p) / (1 - sum 1/price) of the rows taken
    before it. Prices are at most `kelly_hi`, so the book of the taken rows is used up after
    kelly_hi rows and nothing is staked then; the first kelly_hi + 1 rows decide every contest.
    """
    ratio = F.col(p) * F.col(price) * C.decay(price, cfg.decay_c, cfg.decay_gamma)
    able = df.where(F.col(price).between(cfg.kelly_lo, cfg.kelly_hi)).withColumn("ev_ratio", ratio)
    able = topk.top_k(able.where(F.col("ev_ratio") > cfg.kelly_min_ev), [c], "ev_ratio", math.ceil(cfg.kelly_hi) + 1, [e], "_r")
    before = W.partitionBy(c).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(c).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    left_p = 1 - F.coalesce(F.sum(p).over(before), F.lit(0.0))
    left_o = 1 - F.coalesce(F.sum(1 / F.col(price)).over(before), F.lit(0.0))
    test = F.coalesce(F.col("ev_ratio") > F.try_divide(left_p, left_o), F.lit(False)).cast("int")
    taken = able.withColumn("_ok", test).withColumn("_taken", F.min("_ok").over(upto)).where("_taken = 1")
    whole = W.partitionBy(c)
    reserve = (1 - F.sum(p).over(whole)) / F.nullif(1 - F.sum(1 / F.col(price)).over(whole), F.lit(0.0))
    book_left = 1 - F.sum(1 / F.col(price)).over(whole)
    sized = taken.withColumns({"_res": reserve, "_left": book_left}).where(F.col("_left") > 1e-12)
    full = F.greatest(F.col(p) - F.col("_res") / F.col(price), F.lit(0.0)) * cfg.kelly_fraction
    capped = sized.withColumn("_f", F.least(full, F.lit(cfg.kelly_cap)))
    total = F.sum("_f").over(whole)
    scaled = F.when(total > cfg.kelly_contest_cap, F.col("_f") * cfg.kelly_contest_cap / total).otherwise(F.col("_f"))
    out = capped.withColumn("fraction", scaled)
    return out.drop("_r", "_ok", "_taken", "_res", "_left", "_f")


def bankroll_path(
    ledger: DataFrame, strategy: str, order: str, fraction: str, price: str, won: str, cfg: Config = CFG,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Compounding bankroll of each strategy: every bet of the ledger with `bankroll` before its
    contest, `stake` (0 when below the minimum bet) and `returned`.

    The path is a product of contest multipliers, so for a known set of placed bets it is a running
    sum of logarithms. Whether a bet reaches the minimum depends on the path, so both are refined in
    turn: each round makes the path right at least up to the first bet that was judged wrongly, and
    a round without a change is the sequential result. Stakes never exceed contest_cap of the
    bankroll, so multipliers stay positive, and below `stop_below` no bet reaches the minimum.
    """
    if cfg.kelly_cap * cfg.stop_below >= cfg.min_bet:
        raise ValueError("the stop level must lie below the smallest bankroll that can place a bet")
    gain = F.col(fraction) * F.when(F.col(won) == 1, F.col(price) - 1).otherwise(-1.0)
    bets = checkpointed(ledger.where(F.col(fraction) > 0).withColumn("_placed", F.lit(True)))
    frame = lambda part: W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    while True:
        steps = bets.groupBy(strategy, order).agg(F.ln(1 + F.sum(F.when(F.col("_placed"), gain).otherwise(0.0))).alias("_log"))
        path = scale.running(steps, [strategy], order, {"_before": ("sum", "_log")}, frame, cuts)
        level = F.lit(cfg.bankroll) * F.exp(F.coalesce(F.col("_before"), F.lit(0.0)))
        judged = bets.join(path.select(strategy, order, level.alias("_level")), [strategy, order])
        judged = judged.withColumn("_now", F.col("_level") * F.col(fraction) >= cfg.min_bet)
        judged = checkpointed(judged)
        if judged.where(F.col("_now") != F.col("_placed")).isEmpty():
            break
        bets = judged.withColumn("_placed", F.col("_now")).drop("_now", "_level")
    stake = F.when(F.col("_placed"), F.col("_level") * F.col(fraction)).otherwise(0.0)
    out = judged.withColumnRenamed("_level", "bankroll").withColumn("_level", F.col("bankroll")).withColumn("stake", stake)
    returned = F.when(F.col(won) == 1, F.col("stake") * F.col(price)).otherwise(0.0)
    return out.withColumn("returned", returned).drop("_placed", "_now", "_level")


def bankroll_summary(path: DataFrame, strategy: str, cfg: Config = CFG) -> DataFrame:
    """Bets, money and final bankroll of each strategy."""
    placed = F.col("stake") > 0
    net = F.sum("returned") - F.sum("stake")
    return path.groupBy(strategy).agg(
        F.count_if(placed).alias("bets"), F.sum("stake").alias("invested"), F.sum("returned").alias("returned"),
        (F.lit(cfg.bankroll) + net).alias("final_bankroll"), (net / F.sum("stake") * 100).alias("roi"),
    )


def flat_ledger(tickets: DataFrame, ranks: DataFrame, payouts: DataFrame, c: str, order: str, cfg: Config = CFG, cuts: DataFrame | None = None) -> DataFrame:
    """Contest totals of flat tickets (pool, combo) with the running bankroll.

    Tickets are settled and summed per contest first; the running sum then has one row per contest. These rows are written
    once, as the look for hot keys, their cut points and the running sum each read them.
    """
    paid = joins.settle(tickets.withColumn("stake", F.lit(cfg.flat_stake)), payouts)
    per = paid.join(ranks, c).groupBy(c, order).agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("returned") > 0).alias("hits"),
        (F.sum("returned") - F.sum("stake")).alias("pnl"),
    )
    per = checkpointed(per.withColumn("_all", F.lit(0)))
    frame = lambda part: W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    cuts = scale.probe(per, ["_all"], order) if cuts is None else cuts
    run = scale.running(per, ["_all"], order, {"_sum": ("sum", "pnl")}, frame, cuts)
    return run.withColumn("bankroll", F.lit(cfg.bankroll) + F.col("_sum")).drop("_sum", "_all")


def settle_audit(audit: DataFrame, payouts: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Settled tickets of the four pools for every (contest, milestone).

    WIN and PLACE tickets are the eligible rows; QUINELLA and QPL box the best pairs of them, by
    summed probability and by summed place EV. Both sides are listed in one pass over the audit.
    """
    frame = ["contest_id", "milestone"]
    sides = F.array(
        F.struct(F.lit("WIN").alias("pool"), F.col("price").alias("odds_exec"), F.col("p").alias("rank_by"), eligible("WIN", cfg).alias("ok")),
        F.struct(F.lit("PLACE").alias("pool"), F.col("place_price").alias("odds_exec"), F.col("place_ev").alias("rank_by"), eligible("PLACE", cfg).alias("ok")),
    )
    listed = audit.select(*frame, "number", F.inline(F.filter(sides, lambda s: s["ok"])))
    single = listed.select(*frame, "pool", F.col("number").cast("string").alias("combo"), "odds_exec")
    boxed = topk.top_pairs(listed, [*frame, "pool"], "number", "rank_by", cfg.max_pairs)
    double = boxed.select(
        *frame, F.when(F.col("pool") == "WIN", "QUINELLA").otherwise("QPL").alias("pool"), C.pair_key("leg_a", "leg_b").alias("combo"),
        F.lit(None).cast("double").alias("odds_exec"),
    )
    return joins.settle(topk.union_all(single, double).withColumn("stake", F.lit(cfg.stake)), payouts)


def slippage_rows(settled: DataFrame) -> DataFrame:
    """Executed against official price of the settled winners."""
    paid = settled.where(F.col("payout").isNotNull() & F.col("odds_exec").isNotNull())
    return with_slippage(paid)


def with_slippage(settled: DataFrame) -> DataFrame:
    """Adds official price and slippage, NULL for tickets that did not pay or have no own price."""
    return settled.withColumn("official", F.col("payout") / 10).withColumn("slippage", F.col("odds_exec") - F.col("official"))


def daily_card(scored: DataFrame, c: str, cfg: Config = CFG) -> DataFrame:
    """Prime plays of open, liquid contests with tier, buy thresholds and reasons."""
    ok = ~F.col("unposted")
    market = scored.groupBy(c).agg(
        F.count_if(ok).alias("_n"), ((F.sum(F.when(ok & (F.col("price") >= 1), 1 / F.col("price"))) - 1) * 100).alias("_over"),
        F.bool_or(F.col("closed")).alias("_closed"),
    )
    open_ = market.where(~F.col("_closed") & (F.col("_n") >= 8) & (F.col("_over") >= 15)).select(c)
    rows = scored.where(ok).join(open_, c, "left_semi")
    play = (
        F.when(F.col("verdict") == "DUAL VALUE", "WP").when(F.col("verdict") == "EXOTIC", "EX")
        .when(F.col("verdict") == "PRIME W", "W").when(F.col("verdict") == "PRIME P", "P")
    )
    hot = (F.col("score") >= 70) | F.coalesce(F.col("steam"), F.lit(False))
    win_side = F.col("play").isin("W", "WP")
    chance = F.when(win_side, F.col("p") * 100).otherwise(F.coalesce(F.col("place_prob"), F.lit(0.0)) * 100)
    high = hot | (F.col("chance") >= F.when(win_side, 20.0).otherwise(40.0))
    place_side = F.col("play").isin("P", "WP", "EX") & (F.col("place_prob") > 0)
    target = F.when(F.col("place_price") > cfg.verdict_place_hi, cfg.verdict_place_ev_long).otherwise(cfg.place_ev)
    why = F.concat_ws(
        " · ",
        F.when(win_side & F.col("ev").isNotNull(), F.format_string("EV-W x%.2f", F.col("ev") + 1)),
        F.when(F.col("play").isin("P", "WP", "EX") & F.col("place_ev").isNotNull(), F.format_string("EV-P x%.2f", F.col("place_ev"))),
        F.when(F.col("steam"), "STEAM"), F.when(F.col("absorbed"), "PLACE-ABSORB"), F.when(F.col("trap"), "TRAP"),
        F.when(F.col("score") >= cfg.flow_steam, "S-HOT"),
    )
    out = rows.withColumn("play", play).where(F.col("play").isNotNull()).withColumn("chance", chance)
    return out.withColumns(
        {
            "tier": F.when(high, "HIGH").otherwise("MED"),
            "buy_win": F.when(win_side, C.min_price("p", cfg.place_ev)),
            "buy_place": F.when(place_side, target / F.col("place_prob")),
            "why": why,
        }
    )


def scan_overlays(scored: DataFrame, c: str, e: str, p: str, price: str, ev: str, intent: str, top: int = 10, oversized: bool | None = None, cfg: Config = CFG):
    """(core win picks, best banker x satellite pairs) of a whole day, the best `top` of each."""
    core = scored.where((F.col(ev) > cfg.kelly_min_ev) & F.col(price).between(cfg.kelly_lo, cfg.kelly_hi))
    core = core.withColumn("kelly", C.kelly_single(p, price, C.decay(price)))
    pairs, _ = core_satellite(scored, c, e, p, price, ev, intent, oversized=oversized, cfg=cfg)
    both = scored.select(c, e, p, (1 / F.col(price)).alias("_q"))
    priced = field.price_pairs(pairs, both, c, e, "banker", "satellite", {"model": p, "market": "_q"}, 1.0, oversized)
    priced = priced.withColumn("edge", F.col("model_qp3") / F.nullif(F.col("market_qp3"), F.lit(0.0)) - 1)
    return topk.top_n(core, ev, top, [c, e]), topk.top_n(priced, "edge", top, [c, "banker", "satellite"])


def formation(scored: DataFrame, c: str, p: str, opening: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k most probable entrants of each contest with their opening price."""
    return joins.lookup(topk.top_k(scored, [c], p, k, [keys[-1]], "position"), opening, keys, ["open_price"])


def run_report(scored: DataFrame, columns: Sequence[str], name: str, number: str, draw: str) -> DataFrame:
    """Long report: one row per entrant with its label and all score columns."""
    return scored.select(C.entrant_label(name, number, draw).alias("label"), *columns)


def value_bets(preds: DataFrame, c: str, contest, ev: str, k: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """The k best positive-EV predictions of one contest."""
    return topk.top_n(preds.where((F.col(c) == contest) & (F.col(ev) > 0)), ev, k, ties)
