"""Aggregations: market, ledger, ranking quality, bootstrap and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators import topk
from contestframe.session import checkpointed


def field_stats(df: DataFrame, c: str, x: str, how: str = "join") -> DataFrame:
    """Field size, maximum and mean of x on every row."""
    return scale.attach(df, [c], {"field_n": F.count(F.lit(1)), "field_max": F.max(x), "field_mean": F.avg(x)}, how)


def overround(df: DataFrame, by: Sequence[str], price: str) -> DataFrame:
    """Size and book sum of each market, and the book's excess over 1 in percent."""
    book = F.sum(F.when(F.col(price) >= 1, 1 / F.col(price)))
    return df.groupBy(*by).agg(F.count(price).alias("n"), book.alias("book"), ((book - 1) * 100).alias("overround_pct"))


def thin_flag(n: Column | str, overround_pct: Column | str, closed: Column | None = None, min_n: int = 8, min_over: float = 15.0) -> Column:
    n, over = (F.col(x) if isinstance(x, str) else x for x in (n, overround_pct))
    thin = (n < min_n) | over.isNull() | (over < min_over)
    return F.coalesce(thin if closed is None else thin | closed, F.lit(True))


def draw_stats(runs: DataFrame, venue: str, distance: str, draw: str, rank: str, min_n: int = 60) -> DataFrame:
    """Win and place rates by (venue, distance, draw) and, with distance NULL, by (venue, draw).

    Pooled rates weigh every run alike. Multipliers relate a rate to its table's mean and are NULL
    under `min_n` runs. The tables after the grouping sets are dimension-sized.
    """
    placed = F.when(F.col(rank) <= 3, 1.0).otherwise(0.0)
    won = F.when(F.col(rank) == 1, 1.0).otherwise(0.0)
    known = runs.where((F.col(rank) >= 1) & F.col(draw).isNotNull())
    v, s, d = (F.col(x) for x in (venue, distance, draw))
    table = known.groupingSets([[v, s, d], [v, d]], v, s, d).agg(
        F.count(F.lit(1)).alias("n"), F.avg(won).alias("win_rate"), F.avg(placed).alias("place_rate")
    )
    w = W.partitionBy(venue, distance)
    total = F.sum("n").over(w)

    def multiplier(rate: str) -> Column:
        mean = F.sum(F.col(rate) * F.col("n")).over(w) / total
        return F.when(total >= min_n, F.when(mean > 0, F.col(rate) / mean).otherwise(1.0))

    return table.withColumns({"mult_win": multiplier("win_rate"), "mult_place": multiplier("place_rate")})


def draw_multiplier(rail: Column, empirical: Column, blend: float = 0.5) -> Column:
    return C.clip(F.coalesce(rail, F.lit(1.0)) * (1 + blend * (F.coalesce(empirical, F.lit(1.0)) - 1)), 0.5, 2.0)


def _money() -> list[Column]:
    staked, returned = F.sum("stake"), F.sum("returned")
    return [
        F.count(F.lit(1)).alias("bets"),
        staked.alias("staked"),
        returned.alias("returned"),
        (returned - staked).alias("net"),
        F.when(staked > 0, (returned - staked) / staked * 100).alias("roi"),
        (F.avg((F.col("returned") > 0).cast("double")) * 100).alias("hit_rate"),
    ]


def pnl(tickets: DataFrame, keys: Sequence[str], rollup: bool = False, extra: Sequence[Column] = ()) -> DataFrame:
    """Bets, money and rates by keys; `rollup` adds the totals (NULL keys)."""
    grouped = tickets.rollup(*keys) if rollup else tickets.groupBy(*keys)
    return grouped.agg(*_money(), *extra)


def price_band(price: str, edges: Sequence[float]) -> Column:
    """Label of the half-open band (lo, hi] a price falls in, NULL outside."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        test = (F.col(price) > lo) & (F.col(price) <= hi)
        label = f"({lo:g}-{hi:g}]"
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def pnl_by_band(tickets: DataFrame, price: str, edges: Sequence[float] = (1.5, 3.0, 5.0, 8.0, 999.0)) -> DataFrame:
    banded = tickets.withColumn("band", price_band(price, edges)).where(F.col("band").isNotNull())
    return pnl(banded, ["band"])


def pnl_by_month(tickets: DataFrame, date: str, bankroll: str | None = None, order: str | None = None) -> DataFrame:
    """Monthly invested, profit and ROI; with a bankroll column also the month's first value."""
    month = F.date_format(F.date_trunc("month", date), "yyyy-MM").alias("month")
    profit = F.sum("returned") - F.sum("stake")
    aggs = [F.sum("stake").alias("invested"), profit.alias("profit"), (profit / F.sum("stake") * 100).alias("roi")]
    if bankroll:
        aggs.append(F.min_by(bankroll, order or date).alias("start_bankroll"))
    return tickets.groupBy(month).agg(*aggs)


def _value_counts(df: DataFrame, x: str, bound: DataFrame | None) -> DataFrame:
    """Distinct values of x with `_k` occurrences, `_cum` up to and including the value, `_total`.

    The counts of a large frame are written once, and accumulated in blocks along the value axis when there are many.
    `bound` is a cheap frame with at least as many rows, asked for its size instead of `df`.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.withColumn("_all", F.lit(0))
    rows = counts if bound is None else bound.select(F.lit(0).alias("_all"))
    cuts = None
    if not scale.hot_keys(rows, ["_all"]).isEmpty():
        # the look for hot keys, their cut points, the sums and the total each read the counts, which may stand on a long plan
        counts = checkpointed(counts)
        cuts = scale.probe(counts, ["_all"], x)
    frame = lambda part: W.partitionBy(*part).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    summed = scale.running(counts, ["_all"], x, {"_cum": ("sum", "_k")}, frame, cuts)
    if cuts is None:
        return summed.withColumn("_total", F.sum("_k").over(W.partitionBy("_all")))
    return summed.withColumn("_total", counts.agg(F.sum("_k")).scalar())


def _quantile(x: str, p: float) -> Column:
    """Interpolated quantile as an aggregate over `_value_counts` output."""
    pos = (F.col("_total") - 1) * F.lit(p)
    low = F.min(F.when(F.col("_cum") > F.floor(pos), F.col(x)))
    high = F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(x)))
    return low + (high - low) * F.max(pos - F.floor(pos))


def quantiles(df: DataFrame, x: str, probs: dict[str, float], bound: DataFrame | None = None) -> DataFrame:
    """Exact interpolated quantiles of one column without bringing its values together."""
    return _value_counts(df, x, bound).agg(*[_quantile(x, p).alias(name) for name, p in probs.items()])


def slippage_stats(panel: DataFrame, slip: str, bound: DataFrame | None = None) -> DataFrame:
    """Count, mean, share below 1 and quartiles of a slippage column in one pass."""
    n = F.sum("_k")
    return _value_counts(panel, slip, bound).agg(
        n.alias("n"), (F.sum(F.col("_k") * F.col(slip)) / n).alias("mean"),
        (F.sum(F.when(F.col(slip) < 1, F.col("_k")).otherwise(0)) / n).alias("share_below_1"),
        *[_quantile(slip, p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)],
    )


def coverage(ticks: DataFrame, contest: str, day: str, to_post: str, zones: dict[str, tuple[float, float]], approx: bool = False) -> DataFrame:
    """Rows, distinct contests and days, and rows per time-to-post zone."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    counted = [F.count_if(F.col(to_post).between(lo, hi)).alias(name) for name, (lo, hi) in zones.items()]
    return ticks.agg(F.count(F.lit(1)).alias("n_rows"), distinct(contest).alias("contests"), distinct(day).alias("days"), *counted)


def scoring(df: DataFrame, y: str, probs: dict[str, str]) -> DataFrame:
    """Log-loss and Brier score of several probability columns (label -> column)."""
    aggs = []
    for label, p in probs.items():
        q, t = C.clip(p, 1e-12, 1 - 1e-12), F.col(y).cast("double")
        aggs.append((-F.avg(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias(f"logloss_{label}"))
        aggs.append(F.avg((q - t) * (q - t)).alias(f"brier_{label}"))
    return df.agg(*aggs)


def ndcg(df: DataFrame, c: str, score: str, rel: str, k: int, ties: Sequence[str] = (), out: str = "ndcg") -> DataFrame:
    """NDCG@k per contest, NULL when the contest has no relevant row.

    Both the ranking and the ideal keep k rows per contest before they are shuffled.
    """
    def dcg(order: str, name: str) -> DataFrame:
        best = topk.top_k(df.select(c, score, rel, *ties), [c], order, k, ties, "_r")
        gain = (F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col("_r") + 1)
        return best.groupBy(c).agg(F.sum(gain).alias(name))

    both = dcg(score, "_dcg").join(dcg(rel, "_ideal"), c)
    return both.select(c, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).alias(out))


def ndcg_sums(scores: dict[str, str], c: str, rel: str, ks: Sequence[int], ties: Sequence[str] = ()) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """(rank columns, aggregates per contest, NDCG columns) of several scores at several depths, for one pass over the rows.

    Add the ranks to the rows, aggregate them by contest, then add the NDCG columns `ndcg<k>_<label>`.
    """
    def rank(col: str) -> Column:
        return F.row_number().over(topk.W.partitionBy(c).orderBy(F.col(col).desc_nulls_last(), *ties))

    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    names = {**scores, "ideal": rel}
    sums = {f"_dcg{k}_{n}": F.sum(F.when(F.col(f"_r_{n}") <= k, gain / F.log2(F.col(f"_r_{n}") + 1)).otherwise(0.0)) for k in ks for n in names}
    out = {f"ndcg{k}_{n}": F.when(F.col(f"_dcg{k}_ideal") > 0, F.col(f"_dcg{k}_{n}") / F.col(f"_dcg{k}_ideal")) for k in ks for n in scores}
    return {f"_r_{n}": rank(col) for n, col in names.items()}, sums, out


POISSON_STEPS = 16


def _hashed(*parts: Column | str) -> Column:
    """32-bit number from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("bigint")


def bootstrap_roi(tickets: DataFrame, row_key: Sequence[str], replicates: int = 10_000, seed: int = 7, cells: int = 256) -> DataFrame:
    """Percentile interval of the ROI from Poisson(1) resampling.

    Tickets are summed into a fixed number of cells by a hash of their key, combined map-side; the cells are
    resampled, so the work of the replicates does not grow with the tickets. A cell's weight in a replicate is
    the inverse Poisson distribution at a hash of cell, replicate and seed.
    """
    groups = tickets.groupBy((_hashed(*row_key) % cells).alias("cell")).agg(F.sum("stake").alias("stake"), F.sum("returned").alias("returned"))
    u = (_hashed("cell", "replicate", F.lit(str(seed))) + 0.5) / float(2**32)
    mass, acc, weight = 0.36787944117144233, 0.0, F.lit(0)
    for k in range(POISSON_STEPS):
        acc += mass
        weight = weight + F.when(u > acc, 1).otherwise(0)
        mass /= k + 1
    spread = groups.select(
        "cell", "stake", "returned", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    ).withColumn("_w", weight)
    per = spread.groupBy("replicate").agg(
        F.sum(F.col("_w") * F.col("stake")).alias("_s"), F.sum(F.col("_w") * F.col("returned")).alias("_t")
    )
    roi = per.where("_s > 0").select(((F.col("_t") - F.col("_s")) / F.col("_s") * 100).alias("roi"))
    return roi.agg(
        F.count("roi").alias("replicates"), F.avg("roi").alias("mean"),
        F.percentile("roi", F.lit(0.025)).alias("lo"), F.percentile("roi", F.lit(0.975)).alias("hi"),
        F.avg((F.col("roi") <= 0).cast("double")).alias("p_loss"),
    )


def flat_tickets(panel: DataFrame, won: Column, price: str, stake: float = CFG.flat_stake) -> DataFrame:
    return panel.withColumns({"stake": F.lit(stake), "returned": F.when(won, stake * F.col(price)).otherwise(0.0)})


def signal_test(panel: DataFrame, score_min: float, lo: float, hi: float) -> DataFrame:
    """Flat stakes on every row with a high flow score and a price in the band, paid at the final price."""
    picked = panel.where((F.col("score") >= score_min) & F.col("price").between(lo, hi))
    tickets = flat_tickets(picked, F.col("finish_rank") == 1, "final_price")
    return tickets.agg(F.count_distinct("contest_id").alias("contests"), *_money())


def dual_track(panel: DataFrame, p: str, lo: float, hi: float, ev_min: float) -> DataFrame:
    """The same decisions paid at the decision price and at the final price, and the erosion in points.

    The ratio is rounded to 9 digits, so that one at the limit counts whatever its last bits are.
    """
    ratio = F.round(F.col(p) * F.col("price") * C.decay("price"), 9)
    picked = panel.where(F.col("price").between(lo, hi) & (ratio >= ev_min))
    won = F.col("finish_rank") == 1
    naive = F.avg(F.when(won, F.col("price") - 1).otherwise(-1.0)) * 100
    real = F.avg(F.when(won, F.col("final_price") - 1).otherwise(-1.0)) * 100
    return picked.agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(won).alias("wins"), naive.alias("decision_roi"),
        real.alias("realised_roi"), (naive - real).alias("erosion"),
        F.avg(F.col("final_price") / F.col("price")).alias("mean_slippage"),
    )


def career(runs: DataFrame, e: str, order: Sequence[str], win: str, figure: str, prob: str, last: int = 5) -> DataFrame:
    """Starts, wins, win rate and best figure, with the probabilities of the last few starts as text.

    The recent rows are cut by rank before they are collected, so a long career stays an aggregate.
    """
    totals = runs.groupBy(e).agg(
        F.count(F.lit(1)).alias("starts"), F.sum(win).alias("wins"), (F.avg(win) * 100).alias("win_pct"), F.max(figure).alias("best")
    )
    w = W.partitionBy(e).orderBy(*[F.col(o).desc() for o in order])
    recent = runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    shown = F.transform(
        F.array_sort(F.collect_list(F.struct(-F.col("_r"), F.format_string("%.3f", prob).alias("p")))), lambda s: s["p"]
    )
    return totals.join(recent.groupBy(e).agg(F.array_join(shown, " ").alias("recent")), e)


def last_form(runs: DataFrame, e: str, order: Sequence[str], rank: str, k: int = 3) -> DataFrame:
    """Ranks of the last k starts, oldest first: '1-2-4'."""
    w = W.partitionBy(e).orderBy(*[F.col(o).desc() for o in order])
    recent = runs.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= k) & F.col(rank).between(1, 20))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_r"), F.col(rank).alias("k")))), lambda s: s["k"].cast("string"))
    return recent.groupBy(e).agg(F.array_join(ordered, "-").alias("form"))


def cohort_ev(audit: DataFrame, shift: str, pace: str, milestone: str, ev: str, milestones: Sequence[str]) -> DataFrame:
    """Runners and mean EV per milestone for penalised, boosted and untouched rows of each pace."""
    side = F.when(F.col(shift) < 0, "penalised").when(F.col(shift) > 0, "boosted").otherwise("untouched")
    grouped = audit.groupBy(side.alias("cohort"), F.coalesce(F.col(pace), F.lit("N/A")).alias("pace"))
    return grouped.agg(
        F.count(F.lit(1)).alias("runners"),
        *[F.avg(F.when(F.col(milestone) == m, F.col(ev))).alias(f"ev_{i}") for i, m in enumerate(milestones, 1)],
    )


def meeting_overview(scored: DataFrame, c: str, label: str) -> DataFrame:
    """One row per contest: counts, overround, steamers, primes, best EV with its pool, top four."""
    ok = ~F.col("unposted")
    over = (F.sum(F.when(ok & (F.col("price") >= 1), 1 / F.col("price"))) - 1) * 100
    win = F.when(ok & F.col("ev").isNotNull(), F.struct((F.col("ev") + 1).alias("v"), F.lit("W").alias("pool"), F.col(label).alias("who")))
    place = F.when(ok & F.col("place_ev").isNotNull(), F.struct(F.col("place_ev").alias("v"), F.lit("P").alias("pool"), F.col(label).alias("who")))
    best = F.greatest(F.max(win), F.max(place))
    out = scored.groupBy(c).agg(
        F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_pre"), over.alias("overround"),
        F.count_if(ok & (F.col("score") >= CFG.flow_steam)).alias("steam"),
        F.count_if(ok & F.col("verdict").isin("EXOTIC", "DUAL VALUE", "PRIME W", "PRIME P")).alias("primes"),
        best.alias("_best"), F.bool_or(F.col("closed")).alias("closed"),
    )
    four = topk.top_k(scored.where(ok & F.col("p").isNotNull()), [c], "p", 4, [label], "_r")
    names = F.transform(F.array_sort(F.collect_list(F.struct("_r", label))), lambda s: s[label])
    out = out.join(four.groupBy(c).agg(F.array_join(names, ", ").alias("top4")), c, "left")
    out = out.withColumn("thin", thin_flag("n_valid", "overround", F.col("closed")))
    shown = F.when(~F.col("thin"), F.col("_best"))
    return out.withColumns(
        {"best_value": shown["v"], "best_pool": shown["pool"], "best_entrant": shown["who"]}
    ).drop("_best")


def field_kpis(scored: DataFrame, c: str) -> DataFrame:
    ok = ~F.col("unposted")
    return scored.groupBy(c).agg(
        F.count_if(ok).alias("active"), F.count_if(~ok).alias("pre_open"), F.max(F.when(ok, F.col("ev"))).alias("top_ev"),
        F.count_if(ok & (F.col("score") >= CFG.flow_steam)).alias("steamers"),
        F.count_if(ok & (F.col("score") < CFG.flow_drift)).alias("drifters"),
    )


def early_pressure(df: DataFrame, c: str, speed: str, draw: str, k: int = 3) -> DataFrame:
    """Mean adjusted early speed of the k fastest of each contest."""
    fast = df.select(c, C.adj_speed(speed, draw).alias("_s"))
    top = topk.top_k(fast, [c], "_s", k, out="_r")
    return top.groupBy(c).agg(F.avg("_s").alias("early_pressure"))


def front_runners(df: DataFrame, c: str, style: str, how: str = "join") -> DataFrame:
    lead = F.sum(F.when(F.col(style) == "Leader", 1).otherwise(0))
    out = scale.attach(df, [c], {"front_runners": lead, "_n": F.count(F.lit(1))}, how)
    return out.withColumn("front_density", F.col("front_runners") / F.col("_n")).drop("_n")


def global_fill(df: DataFrame, cols: Sequence[str], until: tuple[str, str] | None = None, bound: DataFrame | None = None) -> dict[str, dict[str, Column]]:
    """Mean, standard deviation and median of columns as scalar subqueries.

    `until` = (date column, cutoff) keeps the values to a training period.
    """
    known = df if until is None else df.where(F.col(until[0]) < F.lit(until[1]))
    return {
        x: {
            "mean": known.agg(F.avg(x)).scalar(),
            "std": known.agg(F.stddev_samp(x)).scalar(),
            "median": quantiles(known, x, {"m": 0.5}, bound).scalar(),
        }
        for x in cols
    }


def sweep(preds: DataFrame, params: Sequence[tuple[float, float, float]], p: str, price: str, won: str, stake: float = CFG.flat_stake) -> DataFrame:
    """Flat-stake results of every (price lo, price hi, EV min) in one pass.

    Each parameter set is a group of conditional sums, so rows are not multiplied.
    """
    ratio = F.col(p) * F.col(price) * C.decay(price)
    rows, aggs = [], []
    for i, (lo, hi, ev_min) in enumerate(params):
        hit = F.col(price).between(lo, hi) & (ratio > ev_min)
        aggs += [
            F.count_if(hit).alias(f"b{i}"),
            F.count_if(hit & (F.col(won) == 1)).alias(f"w{i}"),
            F.sum(F.when(hit, F.when(F.col(won) == 1, stake * F.col(price)).otherwise(0.0))).alias(f"r{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(lo).alias("min_price"), F.lit(hi).alias("max_price"), F.lit(ev_min).alias("min_ev"),
                F.col(f"b{i}").alias("bets"), F.col(f"w{i}").alias("wins"), (F.col(f"b{i}") * stake).alias("staked"),
                F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("returned"),
            )
        )
    out = preds.agg(*aggs).select(F.inline(F.array(*rows)))
    net = F.col("returned") - F.col("staked")
    return out.withColumns({"net": net, "roi": F.when(F.col("staked") > 0, net / F.col("staked") * 100)})


def top_divergence(scored: DataFrame, c: str, e: str, p: str, q: str, k: int = 3) -> DataFrame:
    """Entrants in the model's top k that are not in the market's, as sorted text."""
    def best(x: str, name: str) -> DataFrame:
        return topk.top_k(scored.select(c, e, x), [c], x, k, [e], "_r").groupBy(c).agg(F.collect_list(e).alias(name))

    both = best(p, "_m").join(best(q, "_k"), c)
    diff = F.transform(F.array_sort(F.array_except("_m", "_k")), lambda x: x.cast("string"))
    return both.select(c, F.array_join(diff, ",").alias("divergent"))


def card_size(ticks: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Largest contest number stored for each meeting."""
    return ticks.groupBy(*by).agg(F.max(number).alias("card_size"))
