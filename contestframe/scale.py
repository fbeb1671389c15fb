"""Splitting ordered work on hot keys.

A window runs one task per key. A key holding a third of all rows would be one task, so every
ordered operator takes `cuts`: one row per hot key with the values of the order column at which
its rows are cut into blocks. Blocks are then windowed on their own, and what crosses a block
border travels as a small table:

* bounded look-back (lag, last n, exponential mean): the last n rows of the earlier blocks are
  copied into the block (`with_halo`);
* unbounded look-back (running sums, maxima, moments): per-block totals are accumulated over the
  blocks of the key and added to the local result (`carry`).

There are at most rows / hot_rows hot keys with rows / block_rows blocks in all; Spark broadcasts the small
tables only while they are small. `probe` returns None when no key is hot, which keeps the plan a single
plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contestframe.config import CFG


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Keys with more than `hot_rows` rows and their counts; at most rows / hot_rows of them."""
    limit = CFG.hot_rows if hot_rows is None else hot_rows
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)


def cut_points(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    hot_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """keys + `_cuts`: ascending border values of `order` for each hot key."""
    per_block = CFG.block_rows if block_rows is None else block_rows
    hot = hot_keys(df, keys, hot_rows)
    most = hot.agg(F.max("_n")).first()[0] or 0
    blocks = max(2, -(-most // per_block))  # as many as the largest key needs
    shares = [i / blocks for i in range(1, blocks)]
    grid = (
        df.select(*keys, order)
        .join(hot, list(keys))
        .groupBy(*keys)
        .agg(F.percentile_approx(order, shares, max(10_000, 10 * blocks)).alias("_grid"), F.first("_n").alias("_n"))
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(blocks * per_block) / F.col("_n"))).cast("int")
    thinned = F.filter(F.col("_grid"), lambda _, i: (i + 1) % step == 0)
    return grid.select(*keys, F.array_sort(F.array_distinct(thinned)).alias("_cuts"))


def probe(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    counts_from: DataFrame | None = None,
    hot_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame | None:
    """Cut points when some key is hot, else None.

    `counts_from` names a narrower frame with the same keys (the fact table before its joins), so
    that the check is a one-column scan with a partial count.
    """
    if hot_keys(counts_from if counts_from is not None else df, keys, hot_rows).isEmpty():
        return None
    return cut_points(df, keys, order, hot_rows, block_rows)


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, cuts: DataFrame) -> DataFrame:
    """Adds `_blk` (0 for keys that are not hot) and `_last` (number of the key's final block)."""
    block = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return (
        df.join(cuts, list(keys), "left")
        .withColumn("_blk", F.when(F.col("_cuts").isNull(), 0).otherwise(block))
        .withColumn("_last", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")))
        .drop("_cuts")
    )


def with_halo(
    df: DataFrame, keys: Sequence[str], order: str, lookback: int, cuts: DataFrame
) -> DataFrame:
    """Blocked rows plus, for each block, copies of the rows of its last `lookback` earlier orders."""
    blocked = with_blocks(df, keys, order, cuts)
    newest = F.col(order).desc()
    tails = (
        blocked.where("_last > 0 and _blk < _last")
        .withColumn("_back", F.dense_rank().over(W.partitionBy(*keys, "_blk").orderBy(newest)))
        .where(F.col("_back") <= lookback)
        .withColumn("_to", F.explode(F.sequence(F.col("_blk") + 1, F.col("_last"))))
        .withColumn("_back", F.dense_rank().over(W.partitionBy(*keys, "_to").orderBy(newest)))
        .where(F.col("_back") <= lookback)
        .withColumn("_blk", F.col("_to"))
        .drop("_back", "_to")
    )
    return blocked.withColumn("_halo", F.lit(False)).unionByName(
        tails.withColumn("_halo", F.lit(True))
    )


def bounded(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lookback: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    cuts: DataFrame | None,
) -> DataFrame:
    """Runs `build(frame, partition columns)` with every row seeing `lookback` earlier orders."""
    if cuts is None:
        return build(df, list(keys))
    out = build(with_halo(df, keys, order, lookback, cuts), [*keys, "_blk"])
    return out.where(~F.col("_halo")).drop("_blk", "_last", "_halo")


def carry(
    blocked: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    merge: dict[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """keys + `_blk` + accumulated totals of all earlier blocks of the same hot key.

    `totals` are aggregates of one block; `merge[name](name column, window)` accumulates them.
    """
    per_block = (
        blocked.where("_last > 0")
        .groupBy(*keys, "_blk")
        .agg(*[expr.alias(name) for name, expr in totals.items()])
    )
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    return per_block.select(
        *keys, "_blk", *[merge[name](F.col(name), before).alias(name) for name in totals]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: dict[str, tuple[str, str]],
    frame: Callable[[list[str]], W],
    cuts: DataFrame | None,
) -> DataFrame:
    """Running sum / count / max / min over `frame(partition columns)`; outputs name -> (kind, column)."""
    funcs = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    if cuts is None:
        window = frame(list(keys))
        return df.withColumns({n: funcs[k](c).over(window) for n, (k, c) in outputs.items()})
    blocked = with_blocks(df, keys, order, cuts)
    window = frame([*keys, "_blk"])
    local = blocked.withColumns({n: funcs[k](c).over(window) for n, (k, c) in outputs.items()})
    joined = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    before = carry(
        blocked,
        keys,
        {f"_c_{n}": funcs[k](c) for n, (k, c) in outputs.items()},
        {f"_c_{n}": (lambda col, w, k=k: joined[k](col).over(w)) for n, (k, _) in outputs.items()},
    )
    out = local.join(before, [*keys, "_blk"], "left")

    def combine(name: str, kind: str) -> Column:
        here, past = F.col(name), F.col(f"_c_{name}")
        if kind == "max":
            return F.greatest(here, past)
        if kind == "min":
            return F.least(here, past)
        both = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        return both if kind == "count" else F.when(here.isNotNull() | past.isNotNull(), both)

    out = out.withColumns({n: combine(n, k) for n, (k, _) in outputs.items()})
    return out.drop("_blk", "_last", *[f"_c_{n}" for n in outputs])


def attach(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], how: str = "join") -> DataFrame:
    """Adds group aggregates to every row.

    'join' aggregates (combined map-side, one row per key) and joins back; AQE splits the side that
    carries the rows when one key is skewed, which a window could not be. 'window' saves the second
    pass over a long plan and is meant for frames that hold one row per entrant of a field.
    """
    if how == "window":
        return df.withColumns({name: expr.over(W.partitionBy(*keys)) for name, expr in aggs.items()})
    grouped = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_g_{k}"), keys, grouped)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, match, "left").drop(*[f"_g_{k}" for k in keys])
