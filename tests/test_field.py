"""Probability operators: literal cases, invariants and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from contestframe.operators import aggregates, field, market, policy


def fields(spark, *prices):
    data = [(c, e, float(o)) for c, xs in enumerate(prices) for e, o in enumerate(xs)]
    return spark.createDataFrame(data, "c int, e int, price double")


def by(df, col, k=("c", "e")):
    return {tuple(r[x] for x in k): r[col] for r in df.collect()}


def test_devig_literals(spark):
    df = fields(spark, (2, 3, 6), (1.0, 50, 80), (4,), (1.5, 4))
    q = by(field.devig_power(df, "c", "price", "q"), "q")
    assert [round(q[0, i], 9) for i in range(3)] == [round(x, 9) for x in (1 / 2, 1 / 3, 1 / 6)]
    book = 1 + 1 / 50 + 1 / 80
    assert abs(q[1, 0] - 1 / book) < 1e-12 and abs(q[1, 1] - 1 / 50 / book) < 1e-12
    assert q[2, 0] == 1.0
    assert abs(q[3, 0] + q[3, 1] - 1) < 1e-9
    assert by(field.devig_power(df, "c", "price", "q", min_n=2), "q")[2, 0] is None


def ranks(p, gamma):
    n, g = len(p), [x**gamma for x in p]
    out = {r: [0.0] * n for r in (2, 3, 4)}
    for r in (2, 3, 4):
        for order in itertools.permutations(range(n), r):
            left, prob = sum(g), p[order[0]]
            for i in order[1:]:
                left -= g[order[order.index(i) - 1]]
                prob *= g[i] / left
            out[r][order[-1]] += prob
    return out


def test_rank_probs_brute_force(spark):
    rng = random.Random(3)
    cases = {}
    data = []
    for c, n in enumerate((3, 4, 5, 6, 7)):
        x = [rng.gammavariate(1, 1) + 0.01 for _ in range(n)]
        cases[c] = [v / sum(x) for v in x]
        data += [(c, e, p) for e, p in enumerate(cases[c])]
    df = spark.createDataFrame(data, "c int, e int, p double")
    got = field.rank_probs(df, "c", "e", "p", gamma=0.81)
    table = {(r["c"], r["e"]): r for r in got.collect()}
    for c, p in cases.items():
        want = ranks(p, 0.81)
        for e in range(len(p)):
            for r in (2, 3, 4):
                v = table[c, e][f"p_rank{r}"]
                assert (v is None) if len(p) < r else abs(v - want[r][e]) < 1e-9
        for r in (2, 3, 4):
            if len(p) >= r:
                assert abs(sum(table[c, e][f"p_rank{r}"] for e in range(len(p))) - 1) < 1e-9


def test_harville_invariants(spark):
    p = (0.25, 0.2, 0.15, 0.1, 0.3)
    df = spark.createDataFrame([(0, e, x) for e, x in enumerate(p)], "c int, e int, p double")
    place = by(field.place_harville(df, "c", "e", "p", "pl"), "pl")
    assert abs(sum(place.values()) - 3) < 1e-9
    pairs = spark.createDataFrame([(0, a, b) for a in range(5) for b in range(a + 1, 5)], "c int, a int, b int")
    priced = field.price_pairs(pairs, df, "c", "e", "a", "b", {"m": "p"}, 1.0).collect()
    assert abs(sum(r["m_qp3"] for r in priced) - 3) < 1e-9
    assert abs(sum(r["m_q"] for r in priced) - 1) < 1e-9


def test_fusion(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 0.2), (0, 1, 0.3, 0.3), (0, 2, 0.2, 0.5), (1, 0, None, 0.2), (1, 1, 0.5, 0.4), (1, 2, 0.5, 0.4)], "c int, e int, p double, q double")
    flat = by(field.fuse(df, "c", "p", "q", F.lit(0.85), "f"), "f")
    lifted = by(field.fuse(df, "c", "p", "q", F.lit(0.85), "f", F.when(F.col("e") == 1, 0.35)), "f")
    for c in (0, 1):
        assert abs(sum(flat[c, e] for e in range(3)) - 1) < 1e-9
    assert lifted[0, 1] > flat[0, 1]


def test_flow_score(spark):
    df = spark.createDataFrame([(0, 0, 4.0, 4.0), (0, 1, 5.0, 5.0), (1, 0, 2.0, 2.5), (1, 1, 5.0, 3.3333333333333335), (1, 2, 4.0, None)], "c int, e int, now double, base double")
    s = by(field.flow_score(df, "c", "now", "base", "s"), "s")
    assert s[0, 0] == s[0, 1] == 50 and s[1, 2] == 50
    assert abs(s[1, 0] - (50 + 200 * (0.1 - (0.1 - 0.1) / 2))) < 1e-6


def test_valid_price(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 50.0), (1, 2, None)], "c int, e int, price double")
    v = by(market.valid_price(df, "c", "price", "v"), "v")
    assert not v[0, 0] and v[1, 0] and v[1, 1] and not v[1, 2]


@pytest.mark.parametrize("n,total", [(3, 0.06), (4, 0.06)])
def test_kelly_caps(spark, n, total):
    """Each stake is capped at .02; four capped stakes are scaled to .06."""
    df = spark.createDataFrame([(0, e, 0.24, 8.0) for e in range(n)], "c int, e int, p double, price double")
    f = by(policy.kelly_field(df.withColumn("p", F.lit(0.9 / n)).withColumn("price", F.lit(8.0)), "c", "e", "p", "price"), "fraction")
    assert sum(f.values()) <= total + 1e-12 and all(v <= 0.02 + 1e-12 for v in f.values())


def kelly_loop(rows):
    """The stated rule, one contest at a time."""
    able = sorted(((p * o * (4 / o) ** 1.25, -e, p, o) for e, p, o in rows if 4.5 <= o <= 8 and p * o * (4 / o) ** 1.25 > 1.22), reverse=True)
    left_p = left_o = 1.0
    taken = []
    for ev, e, p, o in able:
        if left_o == 0 or not ev > left_p / left_o:
            break
        taken.append((-e, p, o))
        left_p, left_o = left_p - p, left_o - 1 / o
    if left_o <= 1e-12:
        return {}
    f = {e: min(max(p - left_p / left_o / o, 0) * 0.15, 0.02) for e, p, o in taken}
    s = sum(f.values())
    return {e: v * 0.06 / s if s > 0.06 else v for e, v in f.items()}


def test_kelly_against_loop(spark):
    rng = random.Random(5)
    data = [(c, e, rng.uniform(0.02, 0.5), rng.choice([4.5, 5.0, 6.0, 7.5, 8.0, 9.0])) for c in range(60) for e in range(rng.randint(2, 14))]
    df = spark.createDataFrame(data, "c int, e int, p double, price double")
    got = by(policy.kelly_field(df, "c", "e", "p", "price"), "fraction")
    want = {}
    for c in range(60):
        want |= {(c, e): v for e, v in kelly_loop([(e, p, o) for k, e, p, o in data if k == c]).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_settlement_reversed_pair_and_bands(spark):
    from contestframe.operators import joins

    tickets = spark.createDataFrame([(1, "QPL", "2/7", 10.0)], "contest_id int, pool string, combo string, stake double")
    paid = spark.createDataFrame([(1, "QPL", "7,2", 50.0)], "contest_id int, pool string, combo string, payout double")
    assert joins.settle(tickets, paid).first()["returned"] == 50.0
    df = spark.createDataFrame([(x,) for x in (1.5, 3.0, 3.01, 5.0, 8.0, 8.01)], "price double")
    bands = [r[0] for r in df.select(aggregates.price_band("price", (1.5, 3.0, 5.0, 8.0, 999.0))).collect()]
    assert bands == [None, "(1.5-3]", "(3-5]", "(3-5]", "(5-8]", "(8-999]"]


def test_event_window_borders(spark):
    from contestframe.operators import joins

    runs = spark.sql("select 1 as contest_id, 7 as e, date'2026-03-20' as d")
    events = spark.sql("select 7 as e, explode(array(date'2026-03-20', date'2026-03-19', date'2026-03-06', date'2026-03-05')) as a")
    got = joins.event_window(runs, events, ["contest_id"], "e", "d", "a", 14, [], {"n": F.count(F.lit(1)), "oldest": F.max("_age")}).first()
    assert got["n"] == 2 and got["oldest"] == 14


def test_bootstrap_is_independent_of_partitioning(spark, sf):
    from contestframe.sources import views

    df = aggregates.flat_tickets(views.runs(spark, sf).where("price between 3 and 9"), F.col("finish_rank") == 1, "price")
    a = aggregates.bootstrap_roi(df.repartition(5), ["contest_id", "finish_rank"], 50).first()
    b = aggregates.bootstrap_roi(df.repartition(2), ["contest_id", "finish_rank"], 50).first()
    plain = df.agg((F.sum("returned") / F.sum("stake") - 1) * 100).first()[0]
    assert [round(x, 6) for x in a] == [round(x, 6) for x in b]
    assert a["lo"] < plain < a["hi"]
