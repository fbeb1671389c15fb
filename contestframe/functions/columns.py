"""Column functions: text, date, price and label rules. Each takes and returns Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestframe.config import CFG, Config

# Incident keywords (English and Chinese)
BLOCKED = [
    "held up", "denied clear run", "checked", "severely checked",
    "bumped heavily", "blocked", "受阻", "勒避", "受困",
]
WIDE_NO_COVER = [
    "raced wide without cover", "wide throughout", "without cover",
    "全程走外疊", "走外疊", "無遮擋",
]
BAD_START = [
    "slow to begin", "bounded in the air", "knuckled", "slow into stride",
    "出閘緩慢", "慢閘", "閘內跪低",
]

# Class band width and ceiling; claim ladder (wins below -> claim); rest buckets
CLASS_WIDTH = {"class 1": 15, "class 2": 20, "class 3": 20, "class 4": 20, "class 5": 15}
CLASS_MAX = {"class 1": 105, "class 2": 100, "class 3": 80, "class 4": 60, "class 5": 40}
CLAIM_LADDER = [(20, 10), (45, 7), (70, 5), (95, 3)]
REST_EDGES = [7, 14, 30, 60, 120]
REST_LABELS = ["Short_Backup", "Quick_Return", "Optimal", "Freshened", "Spell", "Long_Layoff"]
# Pools that pay only the legs in their order
ORDERED_POOLS = ("FORECAST", "TIERCE", "QUARTET")
# Career wins of apprentice riders before the data window
PRIOR_WINS = {
    "C L Chau": 5, "M F Poon": 45, "K H Chan": 24, "H T Mo": 40, "Y L Chung": 0,
    "E C W Wong": 0, "P N Wong": 0, "H N Wong": 28, "C Wong": 30,
}
# Venue aliases
VENUES = {"HV": "HV", "ST": "ST", "HAPPY VALLEY": "HV", "SHA TIN": "ST"}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col: Column | str, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL (greatest and least skip NULLs)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


# ---- text and casts -------------------------------------------------------------------------


def is_finisher(col: Column | str) -> Column:
    """True when the first token of a finish position is a number."""
    return F.coalesce(F.split(_c(col), " ")[0].rlike("^[0-9]+$"), F.lit(False))


def finishers(df: DataFrame, col: str = "finish_position") -> DataFrame:
    return df.where(is_finisher(col))


def to_num(col: Column | str, scale: int | None = None) -> Column:
    number = F.trim(_c(col)).try_cast("double")
    return number if scale is None else F.round(number, scale)


def finish_rank(col: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(col), r"^(\d+)", 1), F.lit("")).try_cast("int")


def is_win(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(r"^1(\s|$)"), F.lit(False)).cast("int")


def is_place(rank: Column | str, k: int = 3) -> Column:
    return F.coalesce(_c(rank) <= k, F.lit(False)).cast("int")


def relevance(rank: Column | str) -> Column:
    r = _c(rank)
    return F.when(r == 1, 3).when(r == 2, 2).when(r == 3, 1).otherwise(0)


def contest_id(date: Column | str, number: Column | str) -> Column:
    return F.concat(F.date_format(_c(date), "yyyy-MM-dd"), F.lit("_Race"), _c(number).cast("string"))


def contest_id_fallback(date, track, distance, klass) -> Column:
    """Composite id for rows that carry no contest number."""
    return F.concat_ws("_", F.date_format(_c(date), "yyyy-MM-dd"), _c(track), _c(distance).cast("string"), _c(klass))


def contest_parts(cid: Column | str) -> tuple[Column, Column]:
    pattern = r"^(\d{4}-\d{2}-\d{2})_Race(\d+)$"
    c = F.trim(_c(cid))
    return (
        F.to_date(F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))),
        F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).try_cast("int"),
    )


def norm_date(col: Column | str) -> Column:
    """Date from yyyy-MM-dd, yyyy/MM/dd or yyyyMMdd text."""
    c = F.trim(_c(col))
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")])


def contest_ord(date: Column | str, number: Column | str) -> Column:
    """Sortable BIGINT of date and contest number: Race2 comes before Race10."""
    d = _c(date)
    day = (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("bigint")
    return day * 1000 + _c(number).cast("bigint")


def name_key(col: Column | str) -> Column:
    """Upper-case name without a bracketed country suffix."""
    return F.upper(F.trim(F.regexp_replace(_c(col), r"\s*\([A-Za-z]{2,3}\)\s*$", "")))


def venue_code(col: Column | str) -> Column:
    pairs = [F.lit(x) for kv in VENUES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.upper(F.trim(_c(col))))


def default_venue(date: Column | str) -> Column:
    """Wednesday meetings are tried at HV first, all others at ST."""
    return F.when(F.dayofweek(_c(date)) == 4, "HV").otherwise("ST")


def has_any(col: Column | str, words: Sequence[str]) -> Column:
    """Case-insensitive test for any of the words, taken literally."""
    pattern = "(?i)" + "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    return F.coalesce(_c(col).rlike(pattern), F.lit(False))


def combo_key(col: Column | str, pool: Column | str | None = None) -> Column:
    """'7/2', '2,7' and '7 2' all become '2/7'; with a pool in which the order counts, it is kept."""
    legs = F.split(F.trim(_c(col)), r"[,\s/]+")
    if pool is None:
        return F.array_join(F.array_sort(legs), "/")
    kept = F.upper(F.trim(_c(pool))).isin(*ORDERED_POOLS)
    return F.array_join(F.when(kept, legs).otherwise(F.array_sort(legs)), "/")


def combo_codes(payouts: DataFrame, runners: DataFrame, contest: str, number: str, code: str) -> DataFrame:
    """Payouts (contest, pool, combo of numbers) with `combo_codes`: the same legs as entrant codes.

    A leg whose number has no code keeps the number. Each leg is one row of an equi-join on contest and number.
    """
    legs = payouts.select(contest, "pool", "combo").distinct()
    each = legs.select(contest, "pool", "combo", F.posexplode(F.split(F.trim("combo"), r"[,\s/]+")).alias("_at", "_leg"))
    known = runners.where(F.col(code).isNotNull()).groupBy(contest, F.col(number).cast("string").alias("_leg")).agg(F.min(code).alias("_code"))
    met = each.join(known, [contest, "_leg"], "left").groupBy(contest, "pool", "combo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_code", "_leg").alias("c")))), lambda s: s["c"]), "/").alias("combo_codes"))
    return payouts.join(met, [contest, "pool", "combo"], "left")


def pair_key(a: Column | str, b: Column | str) -> Column:
    parts = F.array(_c(a).cast("string"), _c(b).cast("string"))
    return F.array_join(F.array_sort(parts), "/")


def parse_flags(col: Column | str, known: Sequence[str] = ("pace", "nl", "v", "adj", "draw")) -> Column:
    """'pace=SLOW|nl=0|steam' -> struct(ctx map of the known keys, tags array of the rest)."""
    tokens = F.filter(F.transform(F.split(F.coalesce(_c(col), F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")

    def key(t: Column) -> Column:
        return F.lower(F.trim(F.substring_index(t, "=", 1)))

    def is_known(t: Column) -> Column:
        return t.contains("=") & key(t).isin(*known)

    # the last value of a repeated key wins, so earlier ones are dropped before the map is built
    pairs = F.transform(
        F.filter(tokens, is_known),
        lambda t: F.struct(key(t).alias("k"), F.trim(F.regexp_replace(t, r"^[^=]*=", "")).alias("v")),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]),
    )
    return F.struct(
        F.map_from_entries(last).alias("ctx"), F.filter(tokens, lambda t: ~is_known(t)).alias("tags")
    )


def pack_flags(pairs: dict[str, Column], tags: dict[str, Column]) -> Column:
    """Flag text from `k=v` columns (NULL skipped) and Boolean tags."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs.items()]
    parts += [F.when(cond, F.lit(tag)) for tag, cond in tags.items()]
    return F.concat_ws("|", *parts)


def find_entrant(df: DataFrame, col: str, query: str) -> DataFrame:
    """Rows whose name equals the query; when there is none, rows whose name contains it."""
    name, q = F.upper(F.col(col)), query.upper()
    hits = df.where(name.contains(q)).withColumn("_m", F.when(name == q, 0).otherwise(1))
    best = hits.agg(F.min("_m")).scalar()
    return hits.where(F.col("_m") == best).drop("_m")


def entrant_label(name, number, draw) -> Column:
    """'NAME (#2 [D12])'."""
    return F.concat(
        F.upper(_c(name).cast("string")), F.lit(" (#"), _c(number).cast("int").cast("string"),
        F.coalesce(F.concat(F.lit(" [D"), _c(draw).cast("int").cast("string"), F.lit("]")), F.lit("")), F.lit(")"),
    )


# ---- weights, ratings, classes ---------------------------------------------------------------


def inline_claim(col: Column | str) -> Column:
    """Claim in the rider cell: 'A Name(-5)' -> 5."""
    return F.abs(F.nullif(F.regexp_extract(_c(col), r"\([^\d]*?(\d{1,2})[^\d]*?\)", 1), F.lit("")).try_cast("int"))


def claim_ladder(wins: Column | str) -> Column:
    w, out = _c(wins), None
    for below, claim in CLAIM_LADDER:
        out = F.when(w < below, claim) if out is None else out.when(w < below, claim)
    return out.otherwise(0)


def prior_wins(rider: Column | str) -> Column:
    """Wins of an apprentice before the data window, NULL for other riders."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIOR_WINS.items() for x in kv]), F.trim(_c(rider)))


def resolve_claim(inline: Column, ladder: Column, scraped: Column) -> Column:
    """The first of inline, ladder and scraped claim that is not zero, else 0."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(inline, zero), F.nullif(ladder, zero), F.nullif(F.abs(scraped), zero), zero)


def declared_weight(weight: Column | str, claim: Column | str) -> Column:
    return _c(weight) + F.coalesce(_c(claim), F.lit(0))


def class_num(col: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(col), r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(4))


def band_max(col: Column | str) -> Column:
    """Ceiling of a class band written '(60-40)' or '(40-60)'."""
    pattern = r"(\d{2,3})\s*-\s*(\d{1,3})"
    sides = [F.nullif(F.regexp_extract(_c(col), pattern, i), F.lit("")).try_cast("int") for i in (1, 2)]
    return F.greatest(*sides)


def implied_rating(weight, klass, class_max=None) -> Column:
    """Carried weight between 115 and 135 mapped linearly onto the class band."""
    name = F.lower(_c(klass))

    def lookup(values: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), name)

    top = lookup(CLASS_MAX)
    if class_max is not None:
        top = F.coalesce(F.when(_c(class_max) > 0, _c(class_max)), top)
    width = F.coalesce(lookup(CLASS_WIDTH), F.lit(20))
    share = (clip(weight, 115.0, 135.0) - 115.0) / 20.0
    return F.round(top - width + share * width, 1)


# ---- times, positions, pace ------------------------------------------------------------------


def elapsed_seconds(col: Column | str) -> Column:
    """'1:09.85' or '69.85' -> 69.85."""
    parts = F.split(F.trim(_c(col)), ":")
    minutes = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)).try_cast("double")).otherwise(F.lit(0.0))
    seconds = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).try_cast("double")
    return minutes * 60 + seconds


def position_path(col: Column | str) -> tuple[Column, Column]:
    """'7 5 1' -> (early position 7, places gained 6); NULL with fewer than two numbers, and for one beyond an INT."""
    digits = F.transform(
        F.filter(F.split(F.trim(_c(col)), r"\s+"), lambda t: t.rlike(r"^\d+$")), lambda t: t.try_cast("int")
    )
    enough = F.size(digits) >= 2
    first = F.when(enough, F.get(digits, F.lit(0)))
    return first, F.when(enough, F.get(digits, F.lit(0)) - F.get(digits, F.size(digits) - 1))


def early_pct(early: Column | str, n: Column | str, fill: float = CFG.fill_early) -> Column:
    return F.coalesce((_c(early) - 1) / F.greatest(_c(n) - 1, F.lit(1)), F.lit(fill))


def late_rating(gained: Column | str, n: Column | str) -> Column:
    return F.coalesce(_c(gained) / _c(n), F.lit(0.0))


def bucket(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge that is not below the value; the last label beyond all edges."""
    c, out = _c(col), None
    for edge, label in zip(edges, labels):
        out = F.when(c <= edge, label) if out is None else out.when(c <= edge, label)
    return out.otherwise(labels[len(edges)])


def rest_bucket(days: Column | str) -> Column:
    return bucket(days, REST_EDGES, REST_LABELS)


def run_style(pct: Column | str) -> Column:
    c = _c(pct)
    return F.when(c.isNull(), "Unknown").otherwise(bucket(c, [0.33, 0.66], ["Leader", "Stalker", "Closer"]))


def pace_scenario(leaders: Column | str) -> Column:
    return F.when(_c(leaders) >= 3, "Fast").when(_c(leaders) == 2, "Normal").otherwise("Slow")


def pace_advantage(leaders: Column | str, style: Column | str) -> Column:
    n, s = _c(leaders), _c(style)
    return (
        F.when((n >= 3) & (s == "Closer"), 1.0)
        .when((n <= 1) & (s == "Leader"), 1.0)
        .when((n >= 3) & (s == "Leader"), -1.0)
        .otherwise(0.0)
    )


def adj_speed(past_speed: Column | str, draw: Column | str) -> Column:
    """Early speed, higher is faster, with half a point for draws of ten and wider."""
    return -F.coalesce(_c(past_speed), F.lit(0.0)) + F.when(_c(draw) >= 10, 0.5).otherwise(0.0)


def high_value_combo(rate: Column | str, roi: Column | str) -> Column:
    return F.coalesce((_c(rate) < 0.12) & (_c(roi) > 0.15), F.lit(False)).cast("int")


def unexposed_star(starts: Column | str, last_rank: Column | str) -> Column:
    return F.coalesce((_c(starts) < 10) & (_c(last_rank) == 1), F.lit(False)).cast("int")


# ---- calendar --------------------------------------------------------------------------------


def season(date: Column | str) -> Column:
    """Year in which the season (September to July) of a date began."""
    d = _c(date)
    return F.year(d) - F.when(F.month(d) >= 9, 0).otherwise(1)


def weeks_left(date: Column | str) -> Column:
    d = _c(date)
    end = F.make_date(F.year(d) + F.when(F.month(d) >= 9, 1).otherwise(0), F.lit(7), F.lit(31))
    return F.greatest(F.datediff(end, d) / 7.0, F.lit(0.0))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Meeting days: Wednesday, Saturday and Sunday outside 16 July to 31 August."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date")
    )
    return days.where(is_meeting_day("date"))


def is_meeting_day(date: Column | str) -> Column:
    d = _c(date)
    md = F.month(d) * 100 + F.dayofmonth(d)
    return F.dayofweek(d).isin(1, 4, 7) & ~md.between(716, 831)


def post_time(date: Column | str, header: Column | str) -> Column:
    """UTC instant of an HH:mm post time written in local +08:00 text."""
    clock = F.nullif(F.regexp_extract(_c(header), r"\b(\d{1,2}:\d{2})\b", 1), F.lit(""))
    local = F.try_to_timestamp(F.concat(F.date_format(_c(date), "yyyy-MM-dd "), F.lpad(clock, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    return F.to_utc_timestamp(local, "+08:00")


def t_effective(seconds: Column | str, cfg: Config = CFG) -> Column:
    """Seconds to post; the last 45 are held inside [20, 45]."""
    s = _c(seconds)
    return F.when(s > cfg.t_max, s).when(s.isNotNull(), clip(s, cfg.t_min, cfg.t_max))


def fusion_weight(t: Column | str, state: Column | str, cfg: Config = CFG) -> Column:
    """Market weight: logistic in the effective time, held at its peak in the late states."""
    z = F.exp(-F.lit(cfg.w_kappa) * (_c(t) - cfg.w_t0))
    curve = cfg.w_late - (cfg.w_late - cfg.w_early) / (1 + z)
    return (
        F.when(_c(state).isin("TURBO_APPROACH", "LOADING_DELAY"), F.lit(cfg.w_late))
        .when(_c(t).isNull(), F.lit(cfg.w_early))
        .otherwise(curve)
    )


# ---- prices and probabilities ----------------------------------------------------------------


def decay(price: Column | str, c: float = CFG.decay_c, g: float = CFG.decay_gamma, clamp: bool = False) -> Column:
    o = _c(price)
    raw = F.when(o > 0, F.pow(F.lit(c) / o, F.lit(g)))
    return F.when(raw.isNotNull(), F.least(raw, F.lit(1.0))) if clamp else raw


def longshot_penalty(p: Column | str, price: Column | str, beyond: float = 8.0) -> Column:
    o = _c(price)
    return _c(p) * F.when(o > beyond, F.pow(F.lit(beyond) / o, F.lit(2.0))).otherwise(1.0)


def ev(p: Column | str, price: Column | str, factor: Column | None = None) -> Column:
    """Decay-adjusted expected value per unit staked, above zero means profit."""
    return _c(p) * _c(price) * (decay(price) if factor is None else factor) - 1


def edge(p: Column | str, q: Column | str) -> Column:
    return _c(p) - _c(q)


def min_price(p: Column | str, target: float = 1.15, c: float = CFG.decay_c, g: float = CFG.decay_gamma) -> Column:
    """Lowest price at which the clamped-decay EV ratio still reaches the target."""
    q = _c(p)
    beyond = F.pow(F.lit(target) / (q * c**g), F.lit(1.0 / (1.0 - g)))
    return F.when((q > 0) & (q < 1), F.when(q * c >= target, F.lit(target) / q).otherwise(beyond))


def logit(p: Column | str, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def flow_label(score: Column | str, cfg: Config = CFG) -> Column:
    s = _c(score)
    return F.when(s >= cfg.flow_steam, "STEAMER").when(s < cfg.flow_drift, "DRIFTER").otherwise("STABLE")


def field_gamma(n: Column | str, cfg: Config = CFG) -> Column:
    share = clip((_c(n) - cfg.gamma_n_lo) / float(cfg.gamma_n_hi - cfg.gamma_n_lo), 0.0, 1.0)
    return cfg.gamma_min + share * (cfg.gamma_max - cfg.gamma_min)


def kelly_single(p, price, factor: Column | None = None, cfg: Config = CFG) -> Column:
    o = _c(price)
    full = ev(p, o, decay(o, clamp=True) if factor is None else factor) / (o - 1) * cfg.kelly_fraction
    return F.when(o > 1, F.coalesce(clip(full, 0.0, cfg.kelly_cap), F.lit(0.0))).otherwise(0.0)


def prime_value(price, ev_ratio_minus_1, score, cfg: Config = CFG) -> Column:
    """Price in the value band, EV at least .22 and score at least 50 (a missing score counts as 50)."""
    s = F.coalesce(_c(score), F.lit(cfg.flow_centre))
    ok = _c(price).between(cfg.kelly_lo, cfg.kelly_hi) & (_c(ev_ratio_minus_1) >= cfg.kelly_min_ev - 1) & (s >= cfg.overlay_score)
    return F.coalesce(ok, F.lit(False))


def win_prime(p, price, ev_, score, cfg: Config = CFG) -> Column:
    s = F.coalesce(_c(score), F.lit(cfg.flow_centre))
    ok = (_c(p) >= cfg.win_p) & (_c(ev_) >= cfg.win_ev) & _c(price).between(cfg.win_lo, cfg.win_hi) & (s >= cfg.win_score)
    return F.coalesce(ok, F.lit(False))


def place_prime(place_price, place_ev, score, cfg: Config = CFG) -> Column:
    s, o, e = F.coalesce(_c(score), F.lit(cfg.flow_centre)), _c(place_price), _c(place_ev)
    short = o.between(cfg.verdict_place_lo, cfg.verdict_place_hi) & (e >= cfg.place_ev)
    long = (o > cfg.verdict_place_hi) & (e >= cfg.verdict_place_ev_long)
    return F.coalesce((short | long) & (s >= cfg.place_score), F.lit(False))


def verdict(p, price, ev_, score, place_price, place_ev, trap=None, closed=None, unposted=None, cfg: Config = CFG) -> Column:
    """CLOSED, PRE-OPEN, EXOTIC, DUAL VALUE, PRIME W, PRIME P or PASS."""
    no = F.lit(False)
    pw, pp = win_prime(p, price, ev_, score, cfg), place_prime(place_price, place_ev, score, cfg)
    long = F.coalesce((_c(ev_) + 1 >= cfg.exotic_ev) & (_c(price) > cfg.win_hi), no)
    trap = no if trap is None else F.coalesce(_c(trap), no)
    return (
        F.when(no if closed is None else F.coalesce(_c(closed), no), "CLOSED")
        .when(no if unposted is None else F.coalesce(_c(unposted), no), "PRE-OPEN")
        .when(~pw & pp & long, "EXOTIC")
        .when(trap & pp, "EXOTIC")
        .when(pw & pp, "DUAL VALUE")
        .when(pw, "PRIME W")
        .when(pp, "PRIME P")
        .otherwise("PASS")
    )


def row_flag(p, price, ev_, score, cfg: Config = CFG) -> Column:
    """Win-side flag of one row: PRIME W, EXOTIC, DRIFT or NONE."""
    s = F.coalesce(_c(score), F.lit(cfg.flow_centre))
    return (
        F.when(_c(p).isNull() | _c(price).isNull() | _c(ev_).isNull(), "NONE")
        .when(win_prime(p, price, ev_, score, cfg), "PRIME W")
        .when((_c(ev_) + 1 >= cfg.exotic_ev) & (_c(price) > cfg.win_hi), "EXOTIC")
        .when((_c(ev_) > 0) & (s < cfg.flow_drift), "DRIFT")
        .otherwise("NONE")
    )


def slippage(final: Column | str, decided: Column | str) -> Column:
    return _c(final) / _c(decided)


def move_class(now: Column | str, before: Column | str, band: float = 3.0) -> Column:
    move = (_c(now) / _c(before) - 1) * 100
    return (
        F.when(move.isNull(), None).when(move <= -band, "STEAMING").when(move >= band, "PRICE COLLAPSED").otherwise("STABLE")
    )
