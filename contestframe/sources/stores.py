"""Readers and writers of the stores: runs, ticks, payouts, features, ledgers."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators import joins, market, topk
from contestframe.operators.windows import keep_one
from contestframe.session import checkpointed

# Declared columns of the append-only stores
TICK_COLUMNS = [
    "timestamp", "epoch", "race_id", "venue", "horse_number", "horse_name", "win_odds", "place_odds",
    "time_to_post", "state", "t_tilde", "win_velocity_90s", "is_final_jump_price", "pool_volume",
]
RUN_DEFAULTS = {
    "horse_rating": 0, "jockey_allowance": 0, "class_max_rating": 0, "gear": "", "incident_report": "",
    "course_type": "Unknown", "track_condition": "Unknown", "running_position": None,
}


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run CSVs below a folder and its sub-folders, every column as text, whatever order their headers have.

    One job keeps the first line of each file; the driver sees the distinct headers with their files, which it
    lists for any scan. Files of one header are one scan with that schema, and the scans are united by name.
    Of columns with one name the first counts.
    """
    def source(reader):
        return reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)

    first = (
        source(spark.read).text(path)
        .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")
        .where("_start = 0").groupBy("_file").agg(F.first("value").alias("_line"))
    )
    grouped = first.groupBy("_line").agg(F.sort_array(F.collect_list("_file")).alias("_files")).orderBy("_line").collect()
    scans = []
    for line, files in grouped:
        names = [n.strip() for n in next(csv.reader([line.lstrip("\ufeff").rstrip("\r")]), [])]
        kept = [n for k, n in enumerate(names) if n and n not in names[:k]]
        spots = [n if n in kept and n not in names[:k] else f"_skip{k}" for k, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in spots])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"')
        scans.append(rows.csv([unquote(f) for f in files]).select(*[f"`{n}`" for n in kept]))
    if not scans:
        raise FileNotFoundError(f"no CSV files below {path}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), scans)


def with_defaults(df: DataFrame, spec: dict[str, object]) -> DataFrame:
    """Adds missing columns and fills NULLs from a column -> default mapping."""
    def value(name: str, default: object) -> Column:
        literal = F.lit(default) if default is not None else F.lit(None).cast("string")
        return F.coalesce(F.col(name), literal) if name in df.columns else literal

    return df.withColumns({name: value(name, default) for name, default in spec.items()})


def clean_runs(raw: DataFrame) -> DataFrame:
    """Typed finishers with contest id, contest order and entrant code."""
    df = with_defaults(C.finishers(raw), RUN_DEFAULTS)
    number = F.col("race_number").try_cast("int")
    day = C.norm_date("race_date")
    weight = C.to_num("weight_carried")
    body = C.to_num("horse_weight") if "horse_weight" in df.columns else F.lit(None).cast("double")
    return df.withColumns(
        {
            "contest_date": day, "contest_id": C.contest_id(day, number), "contest_ord": C.contest_ord(day, number),
            "finish_rank": C.finish_rank("finish_position"), "is_win": C.is_win("finish_position"),
            "elapsed": C.to_num("finishing_time", 2), "weight": weight, "price": C.to_num("win_odds"),
            "body_weight": F.coalesce(body, weight * 10), "draw": F.col("barrier_draw").try_cast("int"),
            "entrant_code": F.coalesce("horse_code", "horse_name"), "claim_scraped": F.coalesce(F.col("jockey_allowance").try_cast("int"), F.lit(0)),
        }
    )


def entrant_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense integer code of a text key in its sorted order.

    Codes are given to the distinct keys only. They are range-partitioned, counted per partition and
    numbered from the partition's offset, so no task sees all keys. The range borders are sampled,
    hence the checkpoint: both uses of the partition number must see the same rows.
    """
    ranged = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col)
    keys = checkpointed(ranged.withColumn("_p", F.spark_partition_id()))
    w = topk.W.partitionBy("_p").orderBy(col)
    sizes = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    offset = F.coalesce(F.sum("_k").over(topk.W.orderBy("_p").rowsBetween(topk.W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", offset.alias("_start"))
    coded = keys.withColumn("_r", F.row_number().over(w)).join(starts, "_p").select(col, (F.col("_start") + F.col("_r") - 1).alias(out))
    return df.join(coded, col, "left")


def read_events(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Optional event table as text columns, bound by header name in every file below the folder and its sub-folders.

    An absent folder or column reads as empty or NULL.
    """
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    try:
        raw = read_runs(spark, path)
    except FileNotFoundError:
        return empty
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in cols])


def read_ticks(spark: SparkSession, path: str, day: str | None = None, venue: str | None = None) -> DataFrame:
    """Tick store, pruned to the partition of a day and venue when they are given."""
    df = spark.read.parquet(path)
    if day is not None:
        df = df.where(F.col("day") == F.to_date(F.lit(day)))
    return df if venue is None else df.where(F.col("venue") == venue.upper())


def label_ticks(ticks: DataFrame, posts: DataFrame, window: int = 90, cuts: DataFrame | None = None, cfg: Config = CFG) -> DataFrame:
    """Adds time_to_post, t_eff, state and the trailing velocity to ticks (contest_id, entrant_id, ts, price).

    The velocity base of a tick is the entrant's newest price at least `window` seconds older, found
    as of a shifted clock; `cuts` splits busy entrants along `_at` (microseconds).
    """
    late = ticks.withColumn("_base_at", F.timestamp_micros(F.unix_micros("ts") - window * 1_000_000))
    history = ticks.select("contest_id", "entrant_id", F.col("ts").alias("_h_at"), F.col("price").alias("_h_price"))
    based = joins.asof_join(late, history, ["contest_id", "entrant_id"], "_base_at", "_h_at", ["_h_price"], cuts)
    df = based.join(posts, "contest_id", "left").withColumn("time_to_post", (F.unix_micros("post_at") - F.unix_micros("ts")) / 1e6)
    base = F.col("asof__h_price")
    return df.withColumns(
        {
            "t_eff": C.t_effective("time_to_post", cfg), "state": market.lifecycle_state("time_to_post", F.lit(False), cfg),
            "velocity": F.when(base > 0, (F.col("price") - base) / base),
        }
    ).drop("_base_at", "asof_at", "asof__h_price", "post_at")


def write_ticks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Appends ticks below day=/venue= folders, one file per folder and task."""
    parts = df.withColumn("day", F.to_date("ts"))
    parts.write.mode(mode).partitionBy("day", "venue").parquet(path)


def migrate(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The store's declared columns in order; missing ones NULL, unknown ones dropped."""
    kinds = types or {}
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).try_cast(kinds.get(c, dict(df.dtypes).get(c, "string"))).alias(c) for c in columns]
    )


def read_payouts(stores: Iterable[DataFrame], keys: Sequence[str] = ("contest_id", "pool", "combo")) -> DataFrame:
    """Union of payout stores; the first store wins a key that several have."""
    keyed = [s.withColumn("combo", C.combo_key("combo", "pool")) for s in stores]
    return topk.union_priority(keyed, list(keys))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet store at a path, partitioned or not; None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, spark: SparkSession, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), buckets: int = 0) -> None:
    """Appends the rows whose keys the Parquet store does not have; a second run adds nothing.

    With `partition_by` (which must follow from the keys) or with `buckets` (folders by a hash of the first key) only the
    folders that the new rows fall into are read: their names, at most one per folder, prune the scan.
    """
    parts = list(partition_by)
    if buckets:
        df, parts = df.withColumn("bucket", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int")), [*parts, "bucket"]
    fresh = keep_one(df, keys, [c for c in df.columns if c not in keys] or list(keys))
    have = stored(spark, path)
    if have is not None:
        if parts:
            touched = fresh.select(*parts).distinct().collect()
            some = [reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(row[c])) for c in parts]) for row in touched]
            have = have.where(reduce(lambda x, y: x | y, some, F.lit(False)))
        fresh = joins.new_only(fresh, have.select(*keys), keys)
    fresh.write.mode("append").partitionBy(*parts).parquet(path)


def to_star(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contests, entrants, results) with surrogate ids from a hash of the natural keys."""
    contest = F.xxhash64("track", "race_date", "distance").alias("race_id")
    entrant = F.xxhash64("horse_name").alias("horse_id")
    races = keep_one(runs.select(contest, "track", "race_date", "race_class", "distance"), ["race_id"], ["track", "race_class"])
    horses = runs.select(entrant, F.col("horse_name").alias("name")).dropDuplicates(["horse_id"])
    facts = keep_one(
        runs.select(contest, entrant, "finish_position", "finishing_time", "jockey", "trainer", "weight_carried", "barrier_draw", "win_odds"),
        ["race_id", "horse_id"], ["finish_position", "finishing_time"],
    )
    return races, horses, facts


def backfill(df: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of the patch where it has any, the stored values elsewhere."""
    one = keep_one(patch.select(*keys, *cols), keys, list(cols))
    renamed = one.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = df.join(renamed, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).drop(*[f"_new_{c}" for c in cols])


def missing_dates(calendar: DataFrame, have: DataFrame, date: str, after: bool = True) -> DataFrame:
    """Calendar dates not stored; with `after`, only those beyond the newest stored date."""
    gaps = joins.new_only(calendar, have.select(date).distinct(), [date])
    newest = have.agg(F.max(date)).scalar()
    return gaps.where(newest.isNull() | (F.col(date) > newest)) if after else gaps


def write_features(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Feature store in declared column order, partitioned by season; optional columns may be absent."""
    keep = [c for c in (columns or df.columns) if c in df.columns]
    out = df.select(*keep) if "season" in keep else df.select(*keep, "season")
    out.write.mode(mode).partitionBy("season").parquet(path)


def export_predictions(features: DataFrame, preds: DataFrame, keys: Sequence[str], contest: str, price: str) -> DataFrame:
    """Features with their predictions and, where a price is known, the overround-normalised market share."""
    joined = joins.join_run(features, preds, keys, [c for c in preds.columns if c not in keys])
    implied = F.when(F.col(price) > 0, 1 / F.col(price))
    book = F.sum(implied).over(topk.W.partitionBy(contest))
    return joined.withColumns({"overround": book, "market_share": implied / book})


def write_ledger(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def settlement_json(settled: DataFrame) -> DataFrame:
    """One JSON document per contest and milestone with its pool totals."""
    pool = settled.groupBy("contest_id", "milestone", "pool").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stake").alias("staked"), F.sum("returned").alias("returned")
    )
    per = pool.groupBy("contest_id", "milestone").agg(F.sort_array(F.collect_list(F.struct("pool", "n", "staked", "returned"))).alias("pools"))
    return per.select("contest_id", "milestone", F.to_json(F.struct("contest_id", "milestone", "pools")).alias("document"))


def write_settlement_json(settled: DataFrame, path: str, mode: str = "overwrite") -> None:
    settlement_json(settled).select("document").write.mode(mode).text(path)


def flatten(df: DataFrame, payload: str, runs: str = "results", head: str = "race") -> DataFrame:
    """One row per run of a nested contest record, with the contest's fields in front."""
    return df.select(F.col(f"{payload}.{head}.*"), F.explode(F.col(f"{payload}.{runs}")).alias("_run")).select("*", "_run.*").drop("_run")


def drop_store(spark: SparkSession, name: str) -> None:
    """Drops a catalogued store table."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
