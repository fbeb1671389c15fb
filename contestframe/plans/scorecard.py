"""The whole live card as one lazy plan: ticks and static tables in, scored entrants out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestframe import scale
from contestframe.config import CFG, Config
from contestframe.functions import columns as C
from contestframe.operators import field, market


def score_card(
    ticks: DataFrame,
    profiles: DataFrame,
    now: Column,
    post: Column,
    cfg: Config = CFG,
    flow_window: int = 90,
    recent_window: int = 600,
    unit: int = 1,
    even: bool = False,
) -> DataFrame:
    """Scores every entrant of every contest at the instant `now`.

    `ticks` has contest_id, entrant_id, price, place_price, ts; `profiles` has entrant_id, last_p,
    style, draw, venue and draw_mult. Windows are in seconds times `unit` (a unit of 86400 reads
    them as days). `even` reads a price of exactly 1 as a price in flow and steam. Ticks are reduced to one row per entrant first; everything after that runs on
    fields and shares their partitioning.
    """
    c, e = "contest_id", "entrant_id"
    seen = ticks.where(F.col("ts") <= now)
    busy = scale.probe(seen.withColumn("_us", F.unix_micros("ts")), [c, e], "_us", counts_from=seen.select(c, e))
    windows = {"flow": flow_window * unit, "recent": recent_window * unit}
    card = market.tick_card(ticks, c, e, "ts", now, windows, ["price", "place_price"], cfg, busy).select(
        c, e, "polls", "first_at", "price", "place_price", F.col("flow_base_price").alias("base_price"), F.col("flow_base_place_price").alias("base_place"),
        F.col("recent_in_price").alias("recent_price"), "open_at", "open_price", "prev_price", F.col("prev_place_price").alias("prev_place"), "frozen",
    )
    card = market.lifecycle(card.join(profiles, e, "left"), post, now, cfg).withColumn("to_post", F.col("to_post") / unit).drop("frozen")
    card = card.withColumn("t_eff", C.t_effective("to_post", cfg)).withColumn("w_fuse", C.fusion_weight("t_eff", "state", cfg))

    card = market.valid_price(card, c, "price", "_valid")
    live = F.col("_valid")
    card = card.withColumn("price", F.when(live, F.col("price")))
    card = field.field_prior(card.withColumn("_lp", F.when(live, F.col("last_p"))), c, "_lp", "prior", cfg)
    card = field.pace_adjust(card, c, "prior", "style", "draw", F.col("venue"), F.col("draw_mult"), "model")
    card = field.flow_score(card, c, "price", "open_price", "_s1", cfg, even=even)
    card = field.flow_score(card, c, "price", "recent_price", "_s2", cfg, even=even)
    card = card.withColumn("score", field.overlay_score("_s1", "_s2", cfg))
    card = field.devig_power(card, c, "price", "market", min_n=2)
    card = card.withColumns(field.velocity("price", "base_price", "place_price", "base_place", even))
    delta, steam, trap = field.flow_delta(
        F.col("velocity"), F.col("logit_velocity"), F.col("contracted"), F.col("model"), F.col("market"), F.col("t_eff"), cfg
    )
    card = card.withColumns({"delta": delta, "steam": steam, "trap": trap})
    card = field.fuse(card, c, "model", "market", F.col("w_fuse"), "p", F.col("delta"))
    card = card.withColumn("ev", C.ev("p", "price", C.decay("price", clamp=True)))
    card = field.rank_probs(card, c, e, "p", oversized=field.has_oversized(seen.select(c, e).distinct(), c, cfg))
    size = F.count("price").over(field.W.partitionBy(c))
    card = card.withColumn("field_n", size)
    place_prob, place_ev = field.place_ev("field_n", "p_top2", "p_top3", "place_price")
    card = card.withColumns({"place_prob": place_prob, "place_ev": place_ev})
    card = field.absorption(card, c, "p", "place_price", "absorbed")
    closed = F.col("state") == "OFFICIAL_CLOSED"
    return card.withColumns(
        {
            "unposted": ~live,
            "closed": closed,
            "kelly": C.kelly_single("p", "price", cfg=cfg),
            "flow": C.flow_label("score", cfg),
            "move_pct": (F.col("price") - F.col("open_price")) / F.nullif(F.col("open_price"), F.lit(0.0)) * 100,
            "tick_delta": F.col("price") - F.col("prev_price"),
            "verdict": C.verdict(
                F.col("p"), F.col("price"), F.col("ev"), F.col("score"), F.col("place_price"), F.col("place_ev"), F.col("trap"), closed, ~live, cfg
            ),
        }
    ).drop("_valid", "_lp", "_s1", "_s2", "open_at")
