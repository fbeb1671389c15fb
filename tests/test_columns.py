"""Literal cases of the text, date and price rules."""

import pytest
from conftest import close
from pyspark.sql import functions as F

from contestframe.functions import columns as C
from contestframe.operators.market import lifecycle_state


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"])
    return df.select(column.alias("v")).first()["v"]


def test_finish_tokens(spark):
    df = spark.createDataFrame([(t,) for t in ["1", "1 DH", "10", "DNF", "", "WV-A", None]], "pos string")
    kept = C.finishers(df, "pos").select("pos", C.is_win("pos").alias("w"), C.finish_rank("pos").alias("r")).collect()
    assert {(r["pos"], r["w"], r["r"]) for r in kept} == {("1", 1, 1), ("1 DH", 1, 1), ("10", 0, 10)}


def test_contest_order(spark):
    day = F.to_date(F.lit("2026-04-15"))
    assert value(spark, C.contest_ord(day, F.lit(2))) < value(spark, C.contest_ord(day, F.lit(10)))


def test_contest_parts_and_dates(spark):
    day, number = C.contest_parts(F.lit("2026-09-09_Race3"))
    assert str(value(spark, day)) == "2026-09-09" and value(spark, number) == 3
    assert value(spark, C.contest_parts(F.lit("x"))[0]) is None
    for text in ("2026/09/09", "2026-09-09", "20260909"):
        assert str(value(spark, C.norm_date(F.lit(text)))) == "2026-09-09"


@pytest.mark.parametrize("text,seconds", [("1:09.85", 69.85), ("58.2", 58.2), ("x", None)])
def test_elapsed(spark, text, seconds):
    assert close(value(spark, C.elapsed_seconds(F.lit(text))), seconds)


@pytest.mark.parametrize("text,early,gained", [("7 5 1", 7, 6), ("3", None, None), ("", None, None), ("2 x 4", 2, -2)])
def test_positions(spark, text, early, gained):
    a, b = C.position_path(F.lit(text))
    assert value(spark, a) == early and value(spark, b) == gained


def test_claims(spark):
    assert value(spark, C.inline_claim(F.lit("P N Wong(-7)"))) == 7
    assert value(spark, C.inline_claim(F.lit("C L Chau (-2)"))) == 2
    assert [value(spark, C.claim_ladder(F.lit(w))) for w in (0, 19, 20, 45, 70, 95)] == [10, 10, 7, 5, 3, 0]
    assert value(spark, C.resolve_claim(F.lit(0), F.lit(7), F.lit(-5))) == 7
    assert value(spark, C.resolve_claim(F.lit(None).cast("int"), F.lit(0), F.lit(-5))) == 5


def test_flags(spark):
    f = C.parse_flags(F.lit("pace=SLOW|nl=0|v=HV|adj=-0.15|draw=8|syndicate_steam|x=1|pace=LONE"))
    got = value(spark, f)
    assert got["ctx"] == {"nl": "0", "v": "HV", "adj": "-0.15", "draw": "8", "pace": "LONE"}
    assert got["tags"] == ["syndicate_steam", "x=1"]
    assert value(spark, C.parse_flags(F.lit(None).cast("string")))["tags"] == []


def test_keywords(spark):
    assert value(spark, C.has_any(F.lit("Severely CHECKED near 800"), C.BLOCKED))
    assert value(spark, C.has_any(F.lit("全程走外疊"), C.WIDE_NO_COVER))
    assert not value(spark, C.has_any(F.lit(None).cast("string"), C.BAD_START))


def test_names(spark):
    assert value(spark, C.name_key(F.lit("Lucky Star (AUS)"))) == "LUCKY STAR"
    assert value(spark, C.combo_key(F.lit("7, 2"))) == "2/7"
    assert value(spark, C.venue_code(F.lit(" happy valley"))) == "HV"
    assert value(spark, C.entrant_label(F.lit("Abc"), F.lit(2), F.lit(12))) == "ABC (#2 [D12])"
    assert value(spark, C.band_max(F.lit("Class 4 (60-40)"))) == 60


@pytest.mark.parametrize("p,o,ev,s,want", [
    (0.30, 6.0, 0.30, 60.0, "PRIME W"), (0.10, 20.0, 0.30, 60.0, "EXOTIC"), (0.40, 20.0, 0.40, 60.0, "EXOTIC"),
    (0.05, 6.0, 0.50, 60.0, "NONE"), (0.30, 6.0, 0.10, 35.0, "DRIFT"),
])
def test_row_flag(spark, p, o, ev, s, want):
    assert value(spark, C.row_flag(F.lit(p), F.lit(o), F.lit(ev), F.lit(s))) == want


def test_fusion_weight(spark):
    w = lambda t, s="PRE_POST": value(spark, C.fusion_weight(F.lit(t), F.lit(s)))
    assert abs(w(7200.0) - 0.25) < 1e-6
    assert w(5.0, "TURBO_APPROACH") == w(5.0, "LOADING_DELAY") == 0.85
    assert 0.80 < w(200.0) < 0.84 and 0.24 < w(900.0) < 0.45
    assert [value(spark, C.t_effective(F.lit(t))) for t in (600.0, 10.0, -30.0)] == [600.0, 20.0, 20.0]


def test_lifecycle_state(spark):
    s = lambda t, z: value(spark, lifecycle_state(F.lit(t), F.lit(z)))
    assert s(600.0, False) == "PRE_POST" and s(60.0, False) == "TURBO_APPROACH"
    assert s(-10.0, False) == "LOADING_DELAY" and s(-10.0, True) == "OFFICIAL_CLOSED"


def test_field_gamma(spark):
    got = [value(spark, C.field_gamma(F.lit(n))) for n in range(3, 17)]
    assert got[1] == 0.75 and abs(got[11] - 0.88) < 1e-12 and got == sorted(got)


def test_min_price_inverts_ev(spark):
    for p in (0.05, 0.15, 0.3, 0.6):
        price = C.min_price(F.lit(p))
        # from C downwards the decay is clamped; the other branch inverts the unclamped curve
        back = C.ev(F.lit(p), price, C.decay(price, clamp=p * 4 >= 1.15))
        assert abs(value(spark, back) + 1 - 1.15) < 1e-9


def test_calendar(spark):
    days = [str(r[0]) for r in C.calendar(spark, "2026-07-10", "2026-09-05").collect()]
    assert days == ["2026-07-11", "2026-07-12", "2026-07-15", "2026-09-02", "2026-09-05"]


def test_post_time(spark):
    got = value(spark, F.date_format(C.post_time(F.to_date(F.lit("2026-09-09")), F.lit("Race 1 19:05 HV")), "yyyy-MM-dd HH:mm"))
    assert got == "2026-09-09 11:05"
