"""Page extraction on literal pages."""

from pyspark.sql import functions as F

from contestframe.sources import pages


def page(spark, html, key="K1"):
    return spark.createDataFrame([(key, html)], "k string, html string")


def test_trackwork(spark):
    html = """<table><tr><td>Trackwork</td></tr><tr><th>Date</th><th>Track</th><th>Workout</th><th>Time</th><th>Rider</th><th>Gear</th></tr>
    <tr><td>12 Aug 2026</td><td>AWT</td><td>Fast Gallop</td><td>24.6 22.4 (58.0)</td><td>J M</td><td>B/TT</td></tr>
    <tr><td>2026-08-11</td><td>Pool</td><td>Swimming</td><td></td><td>&nbsp;</td><td></td></tr><tr><td>footer</td></tr></table>"""
    got = pages.parse_trackwork(page(spark, html), "html", "k").orderBy("activity_date").collect()
    assert [str(r["activity_date"]) for r in got] == ["2026-08-11", "2026-08-12"]
    fast = got[1]
    assert (fast["work_type"], fast["rider"], fast["time_800"], fast["time_400"], fast["gear"]) == ("Fast Gallop", "J M", 24.6, 22.4, "B/TT")
    assert got[0]["time_400"] is None


def test_trials(spark):
    html = "<table><tr><th>Barrier trial</th></tr><tr><td>3 Sep 2026</td><td>ST</td><td>2</td><td>10</td><td>0:59.80</td><td>1.5L</td><td>J X</td></tr></table>"
    r = pages.parse_trials(page(spark, html), "html", "k").first()
    assert (str(r["trial_date"]), r["finish_pos"], r["field_size"], r["time"], r["margin"], r["rider"]) == ("2026-09-03", 2, 10, "0:59.80", 1.5, "J X")


def test_sectionals_and_runner_map(spark):
    html = """<table><tr><th>Pos</th><th>No</th><th>Horse</th><th>1</th><th>2</th></tr>
    <tr><td>1</td><td>4</td><td>Abc (K123)</td><td>1 13.55</td><td>2-1/4 22.10 11.0</td></tr></table>"""
    r = pages.parse_sectionals(page(spark, html), "html", "k", n=3).first()
    assert (r["entrant_code"], r["sec1_time"], r["sec2_time"], r["sec3_time"]) == ("K123", 13.55, 11.0, None)
    assert tuple(pages.runner_map(page(spark, html), "html", "k").first()) == ("K1", 4, "K123")


def test_card_html(spark):
    html = """<p>Class 4 (60-40)</p><table><tr><th>No</th><th>Horse</th><th>Brand</th><th>Jockey</th><th>Rtg</th><th>Gear</th></tr>
    <tr><td>1</td><td>Abc</td><td>K123</td><td>M F P (-5)</td><td>58</td><td>TT</td></tr><tr><td>2</td><td>Def</td><td>J001</td><td>Z P</td><td>-</td><td></td></tr></table>"""
    got = {r["entrant_code"]: r for r in pages.parse_card_html(page(spark, html), "html", "k").collect()}
    assert (got["K123"]["rating"], got["K123"]["gear"], got["K123"]["allowance"], got["K123"]["band_max"]) == (58, "TT", 5, 60)
    assert got["J001"]["rating"] is None and got["J001"]["gear"] is None and got["J001"]["allowance"] == 0


def test_odds_page(spark):
    html = """<h2>Race 3</h2><table><tr><th>No.</th><th>Horse Name</th><th>Draw</th><th>Win</th><th>Place</th></tr>
    <tr><td>1</td><td>Abc (AUS)</td><td>5</td><td>4.5</td><td>1.9</td></tr><tr><td>2</td><td>Def</td><td>1</td><td>999</td><td>999</td></tr>
    <tr><td>3</td><td>Ghi Scratched</td><td>2</td><td>-</td><td>-</td></tr></table>"""
    got = {r["number"]: r for r in pages.parse_odds(page(spark, html), "html", "k", F.lit(3)).collect()}
    assert set(got) == {1, 2} and got[1]["name"] == "ABC" and got[1]["win_price"] == 4.5 and got[2]["win_price"] is None
    assert pages.parse_odds(page(spark, html), "html", "k", F.lit(4)).count() == 0


def test_draw_stats_and_schedule(spark):
    html = "<table><tr><th>Draw</th><th>Win %</th><th>Place %</th></tr><tr><td>1</td><td>12%</td><td>30%</td></tr></table>"
    assert tuple(pages.parse_draw_stats(page(spark, html), "html", "k").first())[1:] == (1, 12.0, 30.0)
    body = '{"meetings":[{"date":"2026-09-09","venueCode":"HV","races":[{"no":"2","postTime":"2026-09-09T11:10:00Z","status":"OPEN"}]}]}'
    r = pages.parse_schedule(page(spark, body), "html").first()
    assert (str(r["contest_date"]), r["venue"], r["race_no"], r["status"]) == ("2026-09-09", "HV", 2, "OPEN") and r["post_at"] is not None


def test_payout_tokens(spark):
    text = "Dividend Pool Winning Combination Dividend (HK$) WIN 7 60.50 PLACE 7 20.00 2 15.5 QUINELLA 2,7 120.00 QUINELLA PLACE 2,7 40.00 7,9 1,055.00 FIRST 4 1,2,7,9 9,999.00 DIVIDEND NOTE: WIN 1 1.0"
    got = {(r["pool"], r["combo"]): r["payout"] for r in pages.payout_tokens(page(spark, text), "html", ["k"]).collect()}
    assert got == {
        ("WIN", "7"): 60.5, ("PLACE", "7"): 20.0, ("PLACE", "2"): 15.5, ("QUINELLA", "2,7"): 120.0,
        ("QPL", "2,7"): 40.0, ("QPL", "7,9"): 1055.0, ("FIRST4", "1,2,7,9"): 9999.0,
    }


def test_attribute_text(spark):
    lines = spark.createDataFrame(
        [(1, 1, "Runner (K001) was checked at the 400 metres"), (1, 2, "Near the turn Lucky Star raced wide"), (1, 3, "short"), (2, 1, "Near the turn Lucky Star raced wide")],
        "c int, line_no int, line string",
    )
    entrants = spark.createDataFrame([(1, "K001", "ABC"), (1, "K002", "LUCKY STAR"), (1, "K003", "STAR R"), (1, "K004", "LUCKY STA")], "c int, code string, name string")
    got = {r["code"]: r["report"] for r in pages.attribute_text(lines, entrants, "c", "line", "code", "name").collect()}
    assert set(got) == {"K001", "K002"}


def test_form_and_energy(spark):
    df = spark.createDataFrame([("a", i, f"r{i}", f"Energy: {60 + i}") for i in range(1, 6)], "e string, o int, remark string, t string")
    assert pages.form_remarks(df, "e", "o", "remark").first()["remarks"] == "r5 | r4 | r3"
    assert pages.energy(df, "e", "o", "t").first()["energy"] == 65
