"""Point-in-time history features: every window sees only earlier contests of its key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG, Config
from contestframe.functions.columns import clip


@dataclass(frozen=True)
class History:
    """Key, order and frame of a history.

    `order` is a BIGINT that is equal within a contest. `frame` is 'prior_contest' (rows of the
    same contest never see each other) or 'prior_row' (row order within `ties`, as row shifts do).
    `cuts` comes from `scale.probe`; None means that no key needs splitting.
    """

    keys: tuple[str, ...]
    order: str = "contest_ord"
    ties: tuple[str, ...] = ()
    frame: str = "prior_contest"
    cuts: DataFrame | None = None

    def prior_all(self, part: Sequence[str]) -> W:
        if self.frame == "prior_contest":
            return W.partitionBy(*part).orderBy(self.order).rangeBetween(W.unboundedPreceding, -1)
        return W.partitionBy(*part).orderBy(self.order, *self.ties).rowsBetween(W.unboundedPreceding, -1)

    def by_row(self, part: Sequence[str]) -> W:
        return W.partitionBy(*part).orderBy(self.order, *self.ties)


Aggs = Callable[[W], dict[str, Column]]


def rolling(df: DataFrame, h: History, specs: Sequence[tuple[int, Aggs]]) -> DataFrame:
    """Aggregates over the last n contests (or rows) before the current one, for several n at once.

    Each spec is (n, function from a window to named columns); all share one numbering of the
    key's contests and one exchange.
    """
    def build(d: DataFrame, part: list[str]) -> DataFrame:
        if h.frame == "prior_row":
            for n, aggs in specs:
                d = d.withColumns(aggs(h.by_row(part).rowsBetween(-n, -1)))
            return d
        d = d.withColumn("_dr", F.dense_rank().over(W.partitionBy(*part).orderBy(h.order)))
        for n, aggs in specs:
            d = d.withColumns(aggs(W.partitionBy(*part).orderBy("_dr").rangeBetween(-n, -1)))
        return d.drop("_dr")

    return scale.bounded(df, h.keys, h.order, max(n for n, _ in specs), build, h.cuts)


def mean_spec(x: str, out: str, fill: float | None = None) -> Aggs:
    """Mean of x, `fill` without history."""
    return lambda w: {out: F.avg(x).over(w) if fill is None else F.coalesce(F.avg(x).over(w), F.lit(fill))}


def roi_spec(win: str, price: str, out: str) -> Aggs:
    """Flat-stake return on investment, 0 without history."""
    returned = F.when(F.col(win) == 1, F.col(price)).otherwise(0.0)

    def roi(w):
        bets = F.count(win).over(w)
        return {out: F.when(bets > 0, (F.sum(returned).over(w) - bets) / bets).otherwise(0.0)}

    return roi


def rolling_mean(df: DataFrame, h: History, x: str, out: str, n: int = CFG.short_n, fill: float | None = None) -> DataFrame:
    """Mean of x over the last n contests."""
    return rolling(df, h, [(n, mean_spec(x, out, fill))])


def rolling_rates(df: DataFrame, h: History, flags: dict[str, str], n: int = CFG.rolling_n, fill: float = 0.0) -> DataFrame:
    """Win or place rates over the last n contests; flags maps output name to 0/1 column."""
    return rolling(df, h, [(n, mean_spec(f, o, fill)) for o, f in flags.items()])


def rolling_roi(df: DataFrame, h: History, win: str, price: str, out: str, n: int = CFG.rolling_n) -> DataFrame:
    """Flat-stake return on investment over the last n contests."""
    return rolling(df, h, [(n, roi_spec(win, price, out))])


def prior_expanding(df: DataFrame, h: History, x: str, mean: str, sd: str) -> DataFrame:
    """Mean and sample standard deviation of x over all earlier contests of the condition key."""
    return prior_moments(df, h, {x: (mean, sd)})


def prior_moments(df: DataFrame, h: History, xs: dict[str, tuple[str, str]]) -> DataFrame:
    """`prior_expanding` of several columns at once, column -> (mean, deviation): a hot key's rows are cut and summed once for all."""
    if h.cuts is None:
        w = h.prior_all(h.keys)
        return df.withColumns({out: f(x).over(w) for x, names in xs.items() for out, f in zip(names, (F.avg, F.stddev_samp), strict=True)})
    blocked = scale.with_blocks(df, h.keys, h.order, h.cuts)
    w = h.prior_all([*h.keys, "_blk"])
    at = {x: str(i) for i, x in enumerate(xs)}
    local = blocked.withColumns(
        {f"{name}{i}": f(x).over(w) for x, i in at.items() for name, f in (("_n", F.count), ("_m", F.avg), ("_v", F.var_pop))}
    )
    # Block moments are merged about the key's own mean, so that no large squares cancel.
    spread = scale.with_blocks(df, h.keys, h.order, h.cuts).where("_last > 0")
    centre = spread.groupBy(*h.keys).agg(*[F.avg(x).alias(f"_k{i}") for x, i in at.items()])
    centred = spread.join(centre, list(h.keys)).withColumns({f"_d{i}": F.col(x) - F.col(f"_k{i}") for x, i in at.items()})
    totals, merge = {}, {}
    for i in at.values():
        d = F.col(f"_d{i}")
        totals |= {f"_cn{i}": F.count(d), f"_cs{i}": F.sum(d), f"_cq{i}": F.sum(d * d), f"_ck{i}": F.first(f"_k{i}")}
        merge |= {f"{c}{i}": (lambda col, win: F.sum(col).over(win)) for c in ("_cn", "_cs", "_cq")}
        merge |= {f"_ck{i}": lambda col, win: F.first(col).over(win)}
    both = local.join(scale.carry(centred, h.keys, totals, merge), [*h.keys, "_blk"], "left")
    out = {}
    for x, (mean, sd) in xs.items():
        col = lambda name, i=at[x]: F.col(f"{name}{i}")
        n1, n2 = col("_n"), F.coalesce(col("_cn"), F.lit(0))
        m1, q1 = F.coalesce(col("_m"), F.lit(0.0)), F.coalesce(col("_v"), F.lit(0.0)) * col("_n")
        m2 = F.when(n2 > 0, col("_ck") + col("_cs") / n2).otherwise(0.0)
        q2 = F.when(n2 > 0, col("_cq") - col("_cs") * col("_cs") / n2).otherwise(0.0)
        n = n1 + n2
        total = q1 + q2 + (m1 - m2) * (m1 - m2) * n1 * n2 / F.greatest(n, F.lit(1))
        out |= {mean: F.when(n > 0, (n1 * m1 + n2 * m2) / n), sd: F.when(n > 1, F.sqrt(F.greatest(total, F.lit(0.0)) / (n - 1)))}
    return both.withColumns(out).drop("_blk", "_last", *[f"{c}{i}" for c in ("_n", "_m", "_v", "_cn", "_cs", "_cq", "_ck") for i in at.values()])


def speed_figure(t: str, mean: str, sd: str, fill_mean: Column | None = None, cfg: Config = CFG) -> Column:
    """How far a time beats the track variant, in standard deviations, winsorised."""
    m = F.col(mean) if fill_mean is None else F.coalesce(F.col(mean), fill_mean)
    return clip((m - F.col(t)) / (F.coalesce(F.col(sd), F.lit(1.0)) + cfg.figure_eps), -cfg.winsor, cfg.winsor)


def early_speed_z(t: str, mean: str, sd: str, fill_mean: Column, fill_sd: Column, cfg: Config = CFG) -> Column:
    """Standardised early time, negative is fast; 0 where it was not taken."""
    m, s = F.coalesce(F.col(mean), fill_mean), F.coalesce(F.col(sd), fill_sd)
    z = (F.col(t) - m) / F.greatest(s, F.lit(cfg.early_std_floor))
    return F.coalesce(clip(z, -cfg.winsor, cfg.winsor), F.lit(0.0))


def ewm(df: DataFrame, h: History, xs: dict[str, str], span: int = CFG.ewm_span_rate) -> DataFrame:
    """Exponentially weighted mean of earlier rows (the first value seeds it); xs maps output to column.

    Weights fall below 1e-12 after `reach` rows, so the look-back is bounded without changing a
    result; the seed weight is kept while the history is shorter than that.
    """
    alpha = 2.0 / (span + 1)
    reach, left = 0, 1.0
    while left >= 1e-12:
        left *= 1 - alpha
        reach += 1

    def build(d: DataFrame, part: list[str]) -> DataFrame:
        w = h.by_row(part)
        past = w.rowsBetween(-reach, -1)

        def fold(x: str) -> Column:
            values = F.collect_list(F.col(x).cast("double")).over(past)
            return F.aggregate(
                values,
                F.lit(None).cast("double"),
                lambda acc, v: F.when(acc.isNull(), v).otherwise(acc * (1 - alpha) + v * alpha),
            )

        return d.withColumns({o: fold(x) for o, x in xs.items()})

    return scale.bounded(df, h.keys, h.order, reach, build, h.cuts)


def lags(df: DataFrame, h: History, xs: dict[str, tuple[str, int]]) -> DataFrame:
    """Values of earlier rows: output name -> (column, how many rows back)."""
    deepest = max(k for _, k in xs.values())

    def build(d: DataFrame, part: list[str]) -> DataFrame:
        w = h.by_row(part)
        return d.withColumns({o: F.lag(x, k).over(w) for o, (x, k) in xs.items()})

    return scale.bounded(df, h.keys, h.order, deepest, build, h.cuts)


def lag_diff(df: DataFrame, h: History, x: str, out: str, k: int = 1, fill: float = 0.0) -> DataFrame:
    """Change of x against k rows earlier, `fill` without one."""
    return lags(df, h, {"_lag": (x, k)}).withColumn(out, F.coalesce(F.col(x) - F.col("_lag"), F.lit(fill))).drop("_lag")


def lag_trend(df: DataFrame, h: History, x: str, out: str) -> DataFrame:
    """Last value minus the one before it."""
    seen = lags(df, h, {"_l1": (x, 1), "_l2": (x, 2)})
    return seen.withColumn(out, F.coalesce(F.col("_l1") - F.col("_l2"), F.lit(0.0))).drop("_l1", "_l2")


def days_since(df: DataFrame, h: History, date: str, out: str, fill: int = CFG.fill_rest_days) -> DataFrame:
    seen = lags(df, h, {"_ld": (date, 1)})
    return seen.withColumn(out, F.coalesce(F.datediff(F.col(date), F.col("_ld")), F.lit(fill))).drop("_ld")


def career_starts(df: DataFrame, h: History, out: str = "career_starts") -> DataFrame:
    """Number of earlier rows of the entrant."""
    frame = lambda part: h.by_row(part).rowsBetween(W.unboundedPreceding, -1)
    return scale.running(df.withColumn("_one", F.lit(1)), h.keys, h.order, {out: ("count", "_one")}, frame, h.cuts).drop("_one")


def prior_sum(df: DataFrame, h: History, x: str, out: str) -> DataFrame:
    """Sum of x over earlier contests, 0 without any."""
    summed = scale.running(df, h.keys, h.order, {out: ("sum", x)}, h.prior_all, h.cuts)
    return summed.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def quota_urgency(wins: str, weeks: Column, cfg: Config = CFG) -> tuple[Column, Column]:
    """(wins still missing to the quota, that gap per remaining week)."""
    gap = F.greatest(F.lit(0), F.lit(cfg.quota_target) - F.col(wins))
    return gap, gap / (weeks + 1)


def title_contender(df: DataFrame, date: str, wins: str, out: str, cfg: Config = CFG) -> DataFrame:
    """1 for the day's top three totals (dense rank) in May to July.

    The three totals come from a group-limited rank over distinct (date, total) rows, so no day
    is sorted whole. The floors, a row a day, are broadcast, so that the runs are not dealt by day.
    """
    totals = df.select(date, wins).distinct()
    ranked = totals.withColumn("_r", F.row_number().over(W.partitionBy(date).orderBy(F.col(wins).desc())))
    floor = ranked.where(F.col("_r") <= cfg.title_top).groupBy(date).agg(F.min(wins).alias("_floor"))
    flag = (F.col(wins) >= F.col("_floor")) & F.month(date).isin(5, 6, 7)
    return df.join(F.broadcast(floor), date, "left").withColumn(out, F.coalesce(flag, F.lit(False)).cast("int")).drop("_floor")


def in_field(df: DataFrame, c: str, x: str, prefix: str) -> DataFrame:
    """Dense rank of x in its contest (1 is highest) and distance to the field's mean and maximum."""
    w = W.partitionBy(c)
    return df.withColumns(
        {
            f"{prefix}_rank": F.when(F.col(x).isNotNull(), F.dense_rank().over(w.orderBy(F.col(x).desc_nulls_last()))),
            f"{prefix}_to_mean": F.col(x) - F.avg(x).over(w),
            f"{prefix}_to_max": F.col(x) - F.max(x).over(w),
        }
    )


def changed(df: DataFrame, h: History, x: str, out: str) -> DataFrame:
    """1 when x differs from the previous row and there is one."""
    seen = lags(df, h, {"_prev": (x, 1)})
    flag = F.col("_prev").isNotNull() & ~F.col(x).eqNullSafe(F.col("_prev"))
    return seen.withColumn(out, flag.cast("int")).drop("_prev")


def first_time(df: DataFrame, h: History, flag: str, out: str) -> DataFrame:
    """1 when the flag is set now and was never set before."""
    frame = lambda part: h.by_row(part).rowsBetween(W.unboundedPreceding, -1)
    seen = scale.running(df, h.keys, h.order, {"_ever": ("max", flag)}, frame, h.cuts)
    return seen.withColumn(
        out, ((F.col(flag) == 1) & (F.coalesce(F.col("_ever"), F.lit(0)) == 0)).cast("int")
    ).drop("_ever")


def lag_any(df: DataFrame, h: History, flags: dict[str, str], out: str) -> DataFrame:
    """Last row's flags (output name -> 0/1 column) and whether any of them was set."""
    seen = lags(df, h, {o: (f, 1) for o, f in flags.items()})
    seen = seen.withColumns({o: F.coalesce(F.col(o), F.lit(0)) for o in flags})
    return seen.withColumn(out, F.greatest(*[F.col(o) for o in flags], F.lit(0)))


def rating_level(df: DataFrame, official: str, implied: str, c: str, class_max: str | None = None) -> DataFrame:
    """Rating used (official when present, else implied) and its gap to the class maximum."""
    used = F.when(F.coalesce(F.col(official), F.lit(0)) > 0, F.col(official)).otherwise(F.coalesce(F.col(implied), F.lit(0)))
    rated = df.withColumn("rating_used", used.cast("double"))
    top = F.max("rating_used").over(W.partitionBy(c))
    if class_max is not None:
        top = F.coalesce(F.when(F.col(class_max) > 0, F.col(class_max)), top)
    return rated.withColumn("rating_vs_max", F.col("rating_used") - top)


def rating_features(df: DataFrame, h: History, official: str, implied: str, c: str, class_max: str | None = None) -> DataFrame:
    """`rating_level` and the change of the rating since the previous run."""
    return lag_diff(rating_level(df, official, implied, c, class_max), h, "rating_used", "rating_change")


def drawdown(df: DataFrame, by: Sequence[str], order: str, equity: str, cuts: DataFrame | None = None) -> DataFrame:
    """Running peak of an equity series and the relative fall from it."""
    frame = lambda part: W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    peaked = scale.running(df, by, order, {"peak": ("max", equity)}, frame, cuts)
    return peaked.withColumn("drawdown", (F.col(equity) - F.col("peak")) / F.nullif(F.col("peak"), F.lit(0.0)))


def risk_ratios(daily: DataFrame, by: Sequence[str], day: str, equity: str, periods: int = 365, cuts: DataFrame | None = None) -> DataFrame:
    """Sharpe ratio of the period-on-period change, and Calmar ratio, per series."""
    h = History(tuple(by), order="_day", cuts=cuts)
    seen = lags(daily.withColumn("_day", F.unix_date(day).cast("bigint")), h, {"_before": (equity, 1)})
    seen = seen.withColumn("_ret", F.col(equity) / F.col("_before") - 1)
    falls = drawdown(seen, by, "_day", equity, cuts)
    years = (F.max("_day") - F.min("_day")) / 365.25
    out = falls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.avg("_ret") / F.stddev_samp("_ret") * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        years.alias("_years"),
        F.min_by(equity, "_day").alias("_first"),
        F.max_by(equity, "_day").alias("_final"),
    )
    growth = F.pow(F.col("_final") / F.col("_first"), 1 / F.col("_years")) - 1
    calmar = F.when((F.col("max_drawdown") < 0) & (F.col("_years") > 0) & (F.col("_final") > 0), growth / F.abs("max_drawdown"))
    return out.withColumn("calmar", calmar).drop("_years", "_first", "_final")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], which: str = "first") -> DataFrame:
    """First or last row per key by the whole of `order`; a partial aggregate, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if which == "first" else F.max_by
    packed = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*").select(*df.columns)
