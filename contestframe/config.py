"""Every threshold of the engine in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Favourite-longshot decay (C / price) ** gamma
    decay_c: float = 4.0
    decay_gamma: float = 1.25

    # Simultaneous Kelly
    kelly_lo: float = 4.5
    kelly_hi: float = 8.0
    kelly_min_ev: float = 1.22
    kelly_fraction: float = 0.15
    kelly_cap: float = 0.02
    kelly_contest_cap: float = 0.06

    # Softmax temperature
    tau: float = 1.0
    tau_min: float = 0.8
    tau_max: float = 1.5
    tau_live: float = 1.75

    # History features
    winsor: float = 4.5
    figure_eps: float = 1e-6
    early_std_floor: float = 0.1
    rolling_n: int = 50
    short_n: int = 3
    ewm_span_rate: int = 5
    ewm_span_figure: int = 3
    fill_rest_days: int = 365
    fill_early: float = 0.5
    fill_draw_rate: float = 0.083
    fill_last_rank: int = 99
    quota_target: int = 16
    title_top: int = 3

    # Smart-money flow
    flow_centre: float = 50.0
    flow_gain: float = 200.0
    flow_update: float = 0.20
    flow_steam: float = 75.0
    flow_drift: float = 40.0

    # Order-statistic discount by field size
    gamma_min: float = 0.75
    gamma_max: float = 0.88
    gamma_n_lo: int = 4
    gamma_n_hi: int = 14

    # Pool takeouts
    takeout_win: float = 0.175
    takeout_place: float = 0.175
    takeout_pair: float = 0.25

    # Overlay scan
    overlay_edge: float = 0.25
    overlay_score: float = 50.0
    overlay_top: int = 5
    intent_edge: float = 0.15

    # Bankers and satellites (price lo, price hi, EV)
    tier1: tuple = (4.0, 8.0, 0.22)
    tier2: tuple = (3.0, 9.0, 0.12)
    satellite_price: float = 7.0
    satellite_max: int = 2
    satellite_intent: float = 0.40
    place_pick_ev: float = 1.15
    place_pick_price: float = 3.0

    # Settlement policy
    win_ev: float = 0.15
    win_lo: float = 2.2
    win_hi: float = 14.0
    win_p: float = 0.16
    win_score: float = 50.0
    place_ev: float = 1.15
    place_lo: float = 1.5
    place_score: float = 50.0
    stake: float = 100.0
    max_pairs: int = 5

    # verdict
    exotic_ev: float = 1.25
    verdict_place_lo: float = 1.8
    verdict_place_hi: float = 4.0
    verdict_place_ev_long: float = 1.30

    # Lifecycle and fusion weight (seconds)
    turbo_lead: float = 90.0
    frozen: float = 60.0
    t_min: float = 20.0
    t_max: float = 45.0
    w_early: float = 0.25
    w_late: float = 0.85
    w_t0: float = 360.0
    w_kappa: float = 0.02

    # Steam and trap
    steam_move: float = -0.15
    steam_delta_min: float = 0.10
    steam_delta_max: float = 0.35
    trap_model: float = 0.30
    trap_market: float = 0.09
    trap_seconds: float = 120.0
    trap_penalty: float = -1.5

    # Back-test
    bankroll: float = 10_000.0
    min_bet: float = 5.0
    stop_below: float = 10.0
    flat_stake: float = 10.0

    # Scale: a key with more rows than this is cut into blocks along its order column
    hot_rows: int = 4_000_000
    block_rows: int = 1_000_000
    # Scale: a table beyond hot_rows is shuffled into a partition for each so many rows, at least
    task_rows: int = 500_000
    # Scale: a field up to this size travels as one array, a larger one as arrays of `chunk`
    field_limit: int = 128
    chunk: int = 64


CFG = Config()
