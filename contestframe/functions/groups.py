"""Group expressions with the feel of user aggregates. The groups they collect must be bounded by the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ewm_agg(x: str, newer: str, span: int) -> Column:
    """Exponentially weighted mean of a group, the oldest value as the seed.

    `newer` is the number of rows of the group behind a row, so 0 for the newest. The mean is a sum of weighted
    values, combined map-side; weights fade with age, the oldest row gets what is left.
    """
    keep = 1 - 2.0 / (span + 1)
    age = F.col(newer).cast("double")
    value = F.col(x).cast("double")
    weight = F.pow(F.lit(keep), age)
    seed = F.max_by(value, age) * F.pow(F.lit(keep), F.max(age) + 1)
    return F.sum(value * weight) * (1 - keep) + seed


def ndcg_agg(score: str, rel: str, tie: str, k: int) -> Column:
    """NDCG@k of one field as an aggregate."""
    def dcg(order: Column) -> Column:
        ranked = F.slice(F.array_sort(F.collect_list(F.struct(order, F.col(tie), F.col(rel).alias("rel")))), 1, k)
        gains = F.transform(ranked, lambda s, i: (F.pow(F.lit(2.0), s["rel"]) - 1) / F.log2(i + 2.0))
        return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)

    ideal = dcg(-F.col(rel))
    return F.when(ideal > 0, dcg(-F.col(score)) / ideal)


def per_contest(df: DataFrame, c: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Escape hatch for user logic on one field as a pandas frame; no operator of the library uses it."""
    return df.groupBy(c).applyInPandas(fn, schema)
