"""Ordering, top-k and set operations. Ranks that are filtered at once are limited before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe.session import checkpointed


def chronological(df: DataFrame, *order: str) -> DataFrame:
    """Global order; meant for the last step before a sink."""
    return df.orderBy(*order)


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, ties: Sequence[str] = (), out: str = "pick") -> DataFrame:
    """The k best rows of each group, NULL scores last."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *ties)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def top_n(df: DataFrame, score: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The n best rows overall; each task keeps n."""
    return df.orderBy(F.col(score).desc_nulls_last(), *ties).limit(n)


def top_pairs(df: DataFrame, by: Sequence[str], e: str, score: str, n: int) -> DataFrame:
    """The n pairs of each group with the highest summed score.

    A pair that uses the entrant ranked r is beaten by the r - 2 pairs of the leader with ranks
    2 .. r - 1, so only the n + 1 best entrants can be part of the result. Those few are packed
    into one array, and the pairs are formed inside it.
    """
    best = top_k(df, by, score, n + 1, [e], "_r").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col(e).alias("e"), F.col(score).cast("double").alias("s")))).alias("_best")
    )
    after = lambda x: F.filter("_best", lambda y: y["_r"] > x["_r"])
    formed = F.flatten(
        F.transform(
            "_best",
            lambda x: F.transform(
                after(x),
                lambda y: F.struct(
                    (-(x["s"] + y["s"])).alias("_neg"), x["_r"].alias("_ra"), y["_r"].alias("_rb"), x["e"].alias("leg_a"), y["e"].alias("leg_b")
                ),
            ),
        )
    )
    kept = best.select(*by, F.posexplode(F.slice(F.array_sort(formed), 1, n)).alias("_p", "_pair"))
    return kept.select(
        *by, F.col("_pair.leg_a").alias("leg_a"), F.col("_pair.leg_b").alias("leg_b"), (-F.col("_pair._neg")).alias("pair_score"), (F.col("_p") + 1).alias("pair_rank")
    )


def conviction(tier: str, ev: str, *ties: str) -> list[Column]:
    """Order of conviction: HIGH tier first, then falling expected value, NULL last."""
    return [F.when(F.col(tier) == "HIGH", 0).otherwise(1).asc(), F.col(ev).desc_nulls_last(), *[F.col(t).asc() for t in ties]]


def by_conviction(df: DataFrame, tier: str, ev: str, *ties: str) -> DataFrame:
    """HIGH tier first, then falling expected value."""
    return df.orderBy(*conviction(tier, ev, *ties))


def placed(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Adds the row's place (from 1) in a global order whose columns leave no ties.

    Rows are range-partitioned, numbered within their range, and moved by the rows of the ranges before, so no
    task sees all rows. The checkpoint fixes the ranges, whose borders are sampled.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    joined = ranged.withColumn("_n", number).join(sizes.select("_range", before.alias("_before")), "_range")
    return joined.withColumn(out, F.col("_before") + F.col("_n")).drop("_range", "_n", "_before")


def nulls_last(df: DataFrame, x: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(x).desc_nulls_last(), *ties)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_priority(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which a key found in several frames keeps its row of the first one."""
    cols = dfs[0].columns
    rest = [x for x in cols if x not in keys]
    stacked = union_all(*[d.select(*cols).withColumn("_tier", F.lit(i)) for i, d in enumerate(dfs)])
    picked = stacked.groupBy(*keys).agg(F.min(F.struct("_tier", *rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{x}").alias(x) for x in rest]).select(*cols)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b does not have."""
    return a.select(*keys).distinct().join(b, list(keys), "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found in both."""
    return a.select(*keys).intersect(b.select(*keys))
