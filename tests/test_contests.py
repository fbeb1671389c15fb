"""Stateful stream steps: lifecycle, transitions and the tick sink against plain recomputation and the batch forms."""

import dataclasses
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from contestframe.config import CFG
from contestframe.operators import market
from contestframe.streaming import contests as K
from contestframe.streaming.state import BatchState, run_steps
from test_streaming import files, stream

DAY = 1_788_998_400  # 2026-09-10 00:00:00 UTC
FAST = dataclasses.replace(CFG, frozen=60.0, turbo_lead=90.0)


def clock(seconds):
    return f"{__import__('datetime').datetime.fromtimestamp(DAY + seconds, __import__('datetime').timezone.utc):%Y-%m-%d %H:%M:%S.%f}"


def posts_frame(spark, posts):
    return spark.createDataFrame([(c, clock(p)) for c, p in posts.items()], "contest_id bigint, t string").select("contest_id", F.col("t").cast("timestamp").alias("post_at"))


def ticks_of(seed, n=400, span=1500):
    """Ticks of three contests with gaps and pauses; contest 3 has one poll only before it falls silent."""
    rnd = random.Random(seed)
    out, at = [], 0.0
    while at < span and len(out) < n:
        at += rnd.choice((0.3, 1, 1, 5, 20, 70))
        for entrant in rnd.sample((1, 2, 3), rnd.randint(1, 3)):
            out.append((rnd.choice((1, 2)), entrant, rnd.choice((5.0, 5.0, 6.0)), at))
    out.append((3, 9, 4.0, 10.0))
    out.append((1, 1, 9.0, span + 4000))  # moves the watermark past all that counts
    return sorted(out, key=lambda t: t[3])


def seconds(ticks, delay):
    """One quote per entrant and second, as (contest, entrant, price, microsecond), up to the watermark."""
    newest = {}
    for c, e, p, at in ticks:
        newest[c, e, int(at) + 1] = p
    last = int(max(at for *_, at in ticks) * 1000) / 1000 - delay
    return sorted(((c, e, p, (DAY + s) * 10**6) for (c, e, s), p in newest.items() if s <= last), key=lambda q: (q[3], q[0], q[1]))


def state_of(quotes, contest, post, at, cfg):
    """The state at an instant by the definition, from the quotes until then."""
    own = [q for q in quotes if q[0] == contest and q[3] <= at]
    if not own:
        return None
    moved, prices = own[0][3], {}
    for _, e, p, t in own:
        if e in prices and prices[e] != p:
            moved = t
        prices[e] = p
    left = (post - at) / 1e6
    if left >= cfg.turbo_lead:
        return "PRE_POST"
    if left >= 0:
        return "TURBO_APPROACH"
    return "OFFICIAL_CLOSED" if len({q[3] for q in own}) >= 2 and (at - moved) / 1e6 >= cfg.frozen else "LOADING_DELAY"


def split(ticks, parts):
    step = -(-len(ticks) // parts)
    return [[(c, e, p, clock(at)) for c, e, p, at in ticks[k : k + step]] for k in range(0, len(ticks), step)]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4)])
def test_lifecycle_equals_the_definition(spark, tmp_path, seed, parts):
    ticks, post = ticks_of(seed), {1: 600.5, 2: 800, 3: 50}
    files(spark, str(tmp_path / "in"), *split(ticks, parts))
    got = K.lifecycle(stream(spark, str(tmp_path / "in")), posts_frame(spark, post), "10 seconds", FAST).collect()
    quotes = seconds(ticks, 10)
    until = quotes[-1][3]
    want = []
    for c, p in post.items():
        at_post = round((DAY + p) * 10**6)
        times = {q[3] for q in quotes if q[0] == c}
        times |= {t + 60 * 10**6 for t in times} | {at_post + 1, at_post - 90 * 10**6 + 1}
        state = None
        for t in sorted(t for t in times if t <= until):
            now = state_of(quotes, c, at_post, t, FAST)
            if now != state:
                want.append((c, t, state, now))
                state = now
            if state == "OFFICIAL_CLOSED":
                break
    assert sorted((r.contest_id, r.at, r.before, r.state) for r in got) == sorted(want)
    assert {s for *_, s in want} == {"PRE_POST", "TURBO_APPROACH", "LOADING_DELAY", "OFFICIAL_CLOSED"}


def test_lifecycle_equals_the_batch_form(spark, tmp_path):
    """At post time, a microsecond later and at other instants the last change gives the state of `market.lifecycle`."""
    ticks, post = ticks_of(5), {1: 700, 2: 720}
    files(spark, str(tmp_path / "in"), *split(ticks, 3))
    changes = K.lifecycle(stream(spark, str(tmp_path / "in")), posts_frame(spark, post), "10 seconds", FAST).collect()
    quotes = seconds(ticks, 10)
    frame = spark.createDataFrame(quotes, "contest_id bigint, entrant_id bigint, price double, us bigint").select("contest_id", "entrant_id", "price", F.timestamp_micros("us").alias("ts"))
    for at in [(DAY + 700) * 10**6, (DAY + 700) * 10**6 + 1, (DAY + 610) * 10**6, (DAY + 610) * 10**6 + 1, (DAY + 733) * 10**6 + 5]:
        now = F.timestamp_micros(F.lit(at))
        moves = market.last_move(frame.where(F.col("ts") <= now), "contest_id", "entrant_id", "ts", "price", now, FAST).join(posts_frame(spark, post), "contest_id")
        for r in market.lifecycle(moves, F.col("post_at"), now, FAST).collect():
            own = sorted((c.at, c.state) for c in changes if c.contest_id == r.contest_id and c.at <= at)
            if own and own[-1][1] != "OFFICIAL_CLOSED":
                assert own[-1][1] == r.state


def test_closing_drops_the_prices(spark, tmp_path):
    home = str(tmp_path / "home")
    step = K.lifecycle_step(posts_frame(spark, {1: 100, 2: 5000}), FAST)
    first = spark.createDataFrame([(1, 1, 5.0, (DAY + 50) * 10**6), (1, 1, 6.0, (DAY + 90) * 10**6), (2, 1, 3.0, (DAY + 200) * 10**6)], "contest_id bigint, entrant_id bigint, price double, at bigint")
    out = step(first, BatchState(spark, home, 0))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.state, r.at) for r in out.where("contest_id = 1").orderBy("at").collect()][-1] == ("OFFICIAL_CLOSED", (DAY + 150) * 10**6)
    after = BatchState(spark, home, 1)
    assert [r.contest_id for r in after.before("prices", K._PRICES).collect()] == [2]
    later = spark.createDataFrame([(1, 1, 9.0, (DAY + 300) * 10**6)], first.schema)
    assert step(later, after).where("contest_id = 1").count() == 0
    end = spark.createDataFrame([(2, 1, 3.0, (DAY + 300 + 4 * 3600) * 10**6)], first.schema)
    step(end, BatchState(spark, home, 2))
    assert [r.contest_id for r in BatchState(spark, home, 3).before("contests", K._CONTESTS).collect()] == [2]


@pytest.mark.parametrize("parts", [4])
def test_steam_transitions(spark, tmp_path, parts):
    ticks = ticks_of(7)
    files(spark, str(tmp_path / "in"), *split(ticks, parts))
    got = K.steam_transitions(stream(spark, str(tmp_path / "in")), F.col("price") > 5.5, "1 minute", "10 seconds").collect()
    sets = {}
    for c, e, p, at in ticks:
        sets.setdefault((c, (DAY + int(at // 60 + 1) * 60) * 10**6), set()).update({e} if p > 5.5 else ())
    until = (DAY + int(max(at for *_, at in ticks) * 1000) / 1000 - 10) * 10**6
    want, last = [], {}
    for (c, at), now in sorted(sets.items()):
        if at <= until:
            before = last.get(c, set())
            if now != before:
                want.append((c, at, sorted(now - before), sorted(before - now), len(before), len(now)))
            last[c] = now
    assert want and sorted((r.contest_id, r.at, r.entered, r.gone, r.n_before, r.n_after) for r in got) == want


def sink_rows(df):
    return sorted((r.contest_id, r.entrant_id, r.at, r.price, None if r.velocity is None else round(r.velocity, 9), r.state, r.is_final, str(r.day)) for r in df.collect())


def plain_sink(ticks, post, delay, window, keep):
    quotes, out = seconds(ticks, delay), []
    for c, e, p, at in quotes:
        near = [q for q in quotes if at - keep * 10**6 <= q[3] < at and q[0] == c and q[1] == e]
        base = next((q[2] for q in reversed(near) if q[3] <= at - window * 10**6), near[0][2] if near else None)
        moved = None
        for _, e2, p2, t2 in (q for q in quotes if q[0] == c and at - keep * 10**6 <= q[3] <= at):
            prev = [q for q in quotes if q[0] == c and q[1] == e2 and t2 - keep * 10**6 <= q[3] < t2]
            if prev and prev[-1][2] != p2:
                moved = t2
        times = [q[3] for q in quotes if q[0] == c and at - keep * 10**6 <= q[3] <= at]
        left = round((DAY + post[c]) * 10**6) - at
        frozen = len(set(times)) >= 2 and (at - (moved or min(times))) >= 60 * 10**6
        state = "PRE_POST" if left >= 90 * 10**6 else "TURBO_APPROACH" if left >= 0 else "OFFICIAL_CLOSED" if frozen else "LOADING_DELAY"
        out.append((c, e, at, p, None if base is None else round((p - base) / base, 9), state, state == "OFFICIAL_CLOSED", clock(at / 1e6 - DAY)[:10]))
    return sorted(out)


def test_sink_over_restarts(spark, tmp_path):
    """Batches, a restart on new files, a repeated last batch and a repeated batch with its commit lost give the same rows."""
    ticks, post = ticks_of(11, 160), {1: 500, 2: 640, 3: 50}
    parts, folder, home = split(ticks, 4), str(tmp_path / "in"), str(tmp_path / "home")
    files(spark, folder, *parts[:2])

    def run():
        return sink_rows(K.sink_ticks(stream(spark, folder), posts_frame(spark, post), home, "10 seconds", 90, 400, FAST))

    run()
    files(spark, str(tmp_path / "more"), *parts[2:])
    for k, name in enumerate(sorted(os.listdir(tmp_path / "more")), 2):
        shutil.copytree(tmp_path / "more" / name, f"{folder}/b{k:02d}")
    want = plain_sink(ticks, post, 10, 90, 400)
    assert run() == want
    for _ in range(2):  # as if the process had ended between the output and the commit of its last batch
        commits = [f for f in os.listdir(f"{home}/checkpoint/commits") if f.isdigit()]
        newest = max(commits, key=int)
        for name in (newest, f".{newest}.crc"):
            os.path.exists(f"{home}/checkpoint/commits/{name}") and os.remove(f"{home}/checkpoint/commits/{name}")
        assert run() == want
    assert {r[6] for r in want} == {True, False} and any(r[4] for r in want)


def test_steps_over_nothing(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [(1, 1, 5.0, clock(0))])
    out = run_steps(K.quotes(stream(spark, str(tmp_path / "in")), "1 hour"), K.lifecycle_step(posts_frame(spark, {1: 60}), FAST))
    assert out.count() == 0 and "state" in out.columns
