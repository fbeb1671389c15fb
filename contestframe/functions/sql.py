"""SQL-callable versions of the column rules: SQL functions, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from contestframe.config import CFG, Config


def register_functions(spark: SparkSession, cfg: Config = CFG) -> None:
    """Creates cf_decay, cf_flow_label, cf_field_gamma, cf_t_effective, cf_min_price and the table functions cf_calendar and cf_pairs.

    cf_pairs gives the unordered pairs of an array, the smaller id first, also for the arrays of a table: `FROM t, LATERAL cf_pairs(t.ids)`.
    """
    c, g = f"{cfg.decay_c}D", f"{cfg.decay_gamma}D"
    width = cfg.gamma_n_hi - cfg.gamma_n_lo
    bodies = {
        "cf_decay(price DOUBLE) RETURNS DOUBLE": f"CASE WHEN price > 0 THEN pow({c} / price, {g}) END",
        "cf_flow_label(score DOUBLE) RETURNS STRING": f"CASE WHEN score >= {cfg.flow_steam} THEN 'STEAMER' WHEN score < {cfg.flow_drift} THEN 'DRIFTER' ELSE 'STABLE' END",
        "cf_field_gamma(n INT) RETURNS DOUBLE": f"{cfg.gamma_min}D + least(greatest((n - {cfg.gamma_n_lo}) / {width}D, 0D), 1D) * {cfg.gamma_max - cfg.gamma_min}D",
        "cf_t_effective(s DOUBLE) RETURNS DOUBLE": f"CASE WHEN s > {cfg.t_max} THEN s WHEN s IS NOT NULL THEN least(greatest(s, {cfg.t_min}D), {cfg.t_max}D) END",
        "cf_min_price(p DOUBLE, target DOUBLE) RETURNS DOUBLE": (
            f"CASE WHEN p > 0 AND p < 1 THEN CASE WHEN p * {c} >= target THEN target / p "
            f"ELSE pow(target / (p * pow({c}, {g})), {1.0 / (1.0 - cfg.decay_gamma)}D) END END"
        ),
        "cf_calendar(lo DATE, hi DATE) RETURNS TABLE(date DATE)": (
            "SELECT d FROM (SELECT explode(sequence(lo, hi)) AS d) "
            "WHERE dayofweek(d) IN (1, 4, 7) AND NOT (month(d) * 100 + day(d) BETWEEN 716 AND 831)"
        ),
        "cf_pairs(ids ARRAY<BIGINT>) RETURNS TABLE(leg_a BIGINT, leg_b BIGINT)": (
            "SELECT l.p, l.q FROM explode(flatten(transform(array_sort(ids), (p, i) -> "
            "transform(slice(array_sort(ids), i + 2, size(ids)), q -> struct(p, q))))) AS t(l)"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
