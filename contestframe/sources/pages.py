"""Extraction from stored page text: all pages of a table in one job, by expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestframe.functions import columns as C

CARD_SCHEMA = """struct<data: struct<raceMeetingProfile: array<struct<races: array<struct<no: string,
runners: array<struct<id: string, horse: struct<code: string, name_en: string, name_ch: string>,
currentRating: string, gearInfo: string, jockey: struct<allowance: string, name_en: string>>>>>>>>>"""
SCHEDULE_SCHEMA = "struct<meetings: array<struct<date: string, venueCode: string, races: array<struct<no: string, postTime: string, status: string>>>>>"

# Pool names
POOLS = ["WIN", "PLACE", "QUINELLA", "QPL", "FORECAST", "TIERCE", "TRIO", "FIRST4", "QUARTET"]


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(col: Column | str) -> Column:
    """Visible text of a fragment: tags become spaces, runs of blanks one space."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def elements(html: Column | str, tag: str) -> Column:
    """Inner fragments of every element with this tag (nested elements of the same tag are not split)."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), 1)


def _cells(fragment: Column, tag: str = "td|th") -> Column:
    """Inner fragments of the cells of a row."""
    return F.regexp_extract_all(fragment, F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})\s*>"), 1)


def html_rows(df: DataFrame, html: str, row_tag: str = "tr", cell_tag: str = "td|th", keep: Sequence[str] = ()) -> DataFrame:
    """One line per row element: position, its text and the texts of its cells."""
    rows = df.select(*keep, F.posexplode(elements(html, row_tag)).alias("row_no", "_row"))
    cells = F.transform(_cells(F.col("_row"), cell_tag), strip_tags)
    return rows.select(*keep, "row_no", F.col("_row").alias("fragment"), strip_tags("_row").alias("text"), cells.alias("cells"))


def bind_columns(rows: DataFrame, page: str, header_map: dict[str, Sequence[str]], first: Sequence[str] = ()) -> DataFrame:
    """Names the cells by the page's header row, found by its texts.

    `header_map` gives for each output the words one of which its header contains. The header is the
    first row in which two cells are recognised; only rows below it are kept. Outputs in `first`
    take their first matching cell, the others the last one.
    """
    def position(name: str) -> Column:
        words = header_map[name]
        hits = F.transform(
            "cells",
            lambda x, i: F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(x), w)), i),
        )
        known = F.filter(hits, lambda h: h.isNotNull())
        return F.get(known, F.lit(0)) if name in first else F.try_element_at(known, F.lit(-1))

    where = F.struct(*[position(n).alias(n) for n in header_map])
    spots = F.array_distinct(F.filter(F.array(*[where[n] for n in header_map]), lambda i: i.isNotNull()))
    # a header row names two outputs somewhere in its text; only such rows are looked at cell by cell
    named = [reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(w)) for w in header_map[n]]) for n in header_map]
    likely = sum((F.when(x, 1).otherwise(0) for x in named), F.lit(0)) >= 2
    candidate = F.when(likely, F.when(F.size(spots) >= 2, F.struct("row_no", where.alias("at"))))
    # the rows of one page are one window, so the page text is taken apart once
    body = rows.withColumn("_cand", candidate).withColumn("_head", F.min("_cand").over(W.partitionBy(page)))
    body = body.where(F.col("row_no") > F.col("_head.row_no"))
    return body.select(
        *[c for c in rows.columns], *[F.when(F.col(f"_head.at.{n}").isNotNull(), F.get("cells", F.col(f"_head.at.{n}"))).alias(n) for n in header_map]
    )


def payout_tokens(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """(pool, combo, payout) of a payout section written as running text.

    The section starts at the word dividend and ends at its note. A pool name is followed by pairs
    of combination and amount, which end at the next pool name; a dead heat has more of them than usual.
    """
    c = F.regexp_replace(F.regexp_replace(F.col(text), r"(?i)\bQUINELLA\s+PLACE\b", "QPL"), r"(?i)\bFIRST\s+4\b", "FIRST4")
    section = F.regexp_extract(c, r"(?is)dividend(.*?)(?:dividend\s+note|$)", 1)
    names = "|".join(POOLS)
    pair = rf"(?:\s+(?!(?:{names})\s)[^\s]*\d[^\s]*\s+[\d,]+(?:\.\d+)?(?=\s|$))"
    groups = F.regexp_extract_all(F.concat(F.lit(" "), section), F.lit(rf"(?i)(?<=\s)((?:{names}){pair}+)"), 1)
    pools = df.select(*keep, F.posexplode(groups).alias("group_no", "_g"))
    tokens = F.split(F.trim("_g"), r"\s+")
    listed = pools.select(
        *keep, "group_no", F.upper(F.get(tokens, F.lit(0))).alias("pool"), tokens.alias("_t")
    ).withColumn("_n", F.floor((F.size("_t") - 1) / 2).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(1), "_n"), lambda i: F.struct(F.get("_t", i * 2 - 1).alias("combo"), F.get("_t", i * 2).alias("amount"))
    )
    rows = listed.where("_n > 0").select(*keep, "group_no", "pool", F.posexplode(pairs).alias("pair_no", "_pair"))
    amount = F.replace(F.col("_pair.amount"), F.lit(","), F.lit("")).try_cast("double")
    return rows.select(
        *keep, "group_no", "pool", "pair_no", F.col("_pair.combo").alias("combo"), amount.alias("payout")
    )


def attribute_text(lines: DataFrame, entrants: DataFrame, contest: str, line: str, code: str, name: str, min_len: int = 20) -> DataFrame:
    """Joins report lines to the entrants they speak of and concatenates them per entrant.

    A line that carries bracketed codes goes to those codes; any other line goes to every entrant of
    its contest whose whole name it contains. Codes meet by equality, names by contest and first word, then
    the whole name is verified.
    """
    long = lines.where(F.length(F.trim(line)) > min_len).withColumn("_line", F.trim(line))
    numbered = long.withColumn("_no", F.col("line_no")).withColumn("_codes", F.array_distinct(F.regexp_extract_all("_line", F.lit(r"\(([A-Z]\d{3})\)"), 1)))
    by_code = numbered.select(contest, "_no", "_line", F.explode("_codes").alias(code)).join(entrants.select(contest, code), [contest, code], "left_semi")
    def words(text: Column) -> Column:
        return F.regexp_extract_all(F.upper(text), F.lit(r"\w+"), 0)

    named = entrants.where(F.length(name) > 0).select(contest, code, name, F.get(words(F.col(name)), F.lit(0)).alias("_word"))
    plain = numbered.where(F.size("_codes") == 0).select(contest, "_no", "_line", F.explode(F.array_distinct(words(F.col("_line")))).alias("_word"))
    quoted = F.concat(F.lit(r"(?i)\b\Q"), F.col(name), F.lit(r"\E\b"))
    by_name = plain.join(named, [contest, "_word"]).where(F.rlike("_line", quoted))
    hits = by_code.select(contest, code, "_no", "_line").unionByName(by_name.select(contest, code, "_no", "_line")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_no", "_line"))), lambda s: s["_line"])
    return hits.groupBy(contest, code).agg(F.array_join(ordered, " ").alias("report"))


def entrant_code(*sources: Column) -> Column:
    """First code like K152 found in the given texts."""
    return F.coalesce(*[_empty_to_null(F.regexp_extract(F.upper(s), r"[A-Z]\d{3}", 0)) for s in sources])


def parse_card_json(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Race card JSON to (race_no, entrant_code, rating, gear, allowance); runners without a code are dropped."""
    body = df.select(*keep, F.from_json(col, CARD_SCHEMA).alias("_b"))
    races = body.select(*keep, F.explode("_b.data.raceMeetingProfile").alias("_p")).select(*keep, F.explode("_p.races").alias("_r"))
    runners = races.select(*keep, F.col("_r.no").try_cast("int").alias("race_no"), F.explode("_r.runners").alias("_x"))
    inline = _empty_to_null(F.regexp_extract("_x.jockey.name_en", r"\(([+-]?\d+)\)", 1)).try_cast("int")
    stated = _empty_to_null(F.trim("_x.jockey.allowance"))
    allowance = F.when(stated.isNotNull(), F.coalesce(stated.try_cast("int"), F.lit(0))).otherwise(F.coalesce(inline, F.lit(0)))
    return runners.select(
        *keep, "race_no",
        entrant_code(F.col("_x.horse.code"), F.col("_x.horse.name_en"), F.col("_x.horse.name_ch"), F.col("_x.id")).alias("entrant_code"),
        F.col("_x.currentRating").try_cast("int").alias("rating"), _empty_to_null(F.col("_x.gearInfo")).alias("gear"), allowance.alias("allowance"),
    ).where(F.col("entrant_code").isNotNull())


def parse_card_html(df: DataFrame, html: str, page: str) -> DataFrame:
    """Race card table to (entrant_code, rating, gear, allowance, band_max)."""
    band = df.select(page, C.band_max(strip_tags(html)).alias("band_max"))
    rows = html_rows(df, html, keep=[page])
    bound = bind_columns(rows, page, {"name": ["horse"], "rider": ["jockey"], "rating": ["rtg", "rating"], "gear": ["gear"], "code": ["brand", "code"]}, first=["name", "rating"])
    code = entrant_code(F.col("code"), F.col("fragment"))
    return bound.join(band, page).select(
        page, code.alias("entrant_code"), _empty_to_null(F.regexp_extract("rating", r"(\d+)", 1)).try_cast("int").alias("rating"),
        _empty_to_null(F.col("gear")).alias("gear"), F.coalesce(C.inline_claim("rider"), F.lit(0)).alias("allowance"), "band_max",
    ).where(F.col("entrant_code").isNotNull())


def _day(text: Column) -> Column:
    return F.coalesce(
        F.try_to_date(_empty_to_null(F.regexp_extract(text, r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})", 1)), "d MMM yyyy"),
        C.norm_date(_empty_to_null(F.regexp_extract(text, r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1))),
    )


def parse_trackwork(df: DataFrame, html: str, code: str) -> DataFrame:
    """Trackwork page of an entrant to dated work events with split times."""
    rows = html_rows(df, html, keep=[code])
    names = {
        "date": ["date"], "track_type": ["track", "course", "awt", "turf"], "work_type": ["work", "exercise", "training"],
        "rider": ["rider", "jockey"], "time": ["time", "distance"], "gear": ["gear"],
    }
    bound = bind_columns(rows, code, names, first=["track_type", "time"])
    times = F.regexp_extract_all("time", F.lit(r"(\d+\.\d+)"), 1)
    return bound.where(F.size("cells") >= 3).select(
        code, _day(F.col("date")).alias("activity_date"), "track_type", "work_type", "rider",
        F.get(times, F.lit(0)).try_cast("double").alias("time_800"), F.get(times, F.lit(1)).try_cast("double").alias("time_400"), "gear",
    ).where(F.col("activity_date").isNotNull())


def parse_trials(df: DataFrame, html: str, code: str) -> DataFrame:
    """Barrier trials of an entrant: date, finish, field size, time, margin, rider."""
    rows = html_rows(df, html, keep=[code])
    numbers = F.filter("cells", lambda x: x.rlike(r"^\d{1,2}$"))
    margin = F.filter(F.transform("cells", lambda x: _empty_to_null(F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*[LNH]$", 1))), lambda m: m.isNotNull())
    return rows.select(
        code, _day(F.col("text")).alias("trial_date"), F.get(numbers, F.lit(0)).try_cast("int").alias("finish_pos"),
        F.get(numbers, F.lit(1)).try_cast("int").alias("field_size"), _empty_to_null(F.regexp_extract("text", r"\d{1,2}:\d{2}\.\d{2}", 0)).alias("time"),
        F.get(margin, F.lit(0)).try_cast("double").alias("margin"), F.when(F.size("cells") > 5, F.element_at("cells", -1)).alias("rider"),
    ).where(F.col("trial_date").isNotNull())


def parse_sectionals(df: DataFrame, html: str, page: str, code_cell: int = 2, first_cell: int = 3, n: int = 6) -> DataFrame:
    """Sectional times per entrant code: the last decimal of each section cell.

    A row is taken apart inside its page, once, and only the cells that are read lose their tags: a filter on a column of an
    exploded row would have it parsed for the filter and for the result.
    """
    def section(cells: Column, i: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(strip_tags(F.get(cells, F.lit(first_cell + i))), F.lit("")), F.lit(r"(\d+\.\d+)"), 1)
        return F.try_element_at(found, F.lit(-1)).try_cast("double").alias(f"sec{i + 1}_time")

    def parsed(cells: Column) -> Column:
        code = F.regexp_extract(strip_tags(F.get(cells, F.lit(code_cell))), r"\(([A-Z]\d{3})\)", 1)
        return F.struct(code.alias("entrant_code"), *[section(cells, i) for i in range(n)])

    rows = F.transform(F.transform(elements(html, "tr"), lambda row: _cells(row)), parsed)
    return df.select(page, F.inline(F.filter(rows, lambda r: r["entrant_code"] != "")))


def runner_map(df: DataFrame, html: str, page: str, number_cell: int = 1) -> DataFrame:
    """Entrant number to code of a result page; rows are taken apart as in `parse_sectionals`."""
    def parsed(row: Column) -> Column:
        code = F.regexp_extract(strip_tags(row), r"\(([A-Z]\d{3})\)", 1)
        return F.struct(strip_tags(F.get(_cells(row), F.lit(number_cell))).try_cast("int").alias("number"), code.alias("entrant_code"))

    rows = F.transform(elements(html, "tr"), parsed)
    return df.select(page, F.inline(F.filter(rows, lambda r: r["number"].isNotNull() & (r["entrant_code"] != ""))))


def parse_odds(df: DataFrame, html: str, page: str, expected: Column | None = None) -> DataFrame:
    """Win/place table to ticks: 999 is no quote, scratched rows and pages of another contest are dropped.

    `expected` is the contest number the page should show in its 'Race n' heading.
    """
    shown = _empty_to_null(F.regexp_extract(strip_tags(html), r"(?i)\bRace\s+(\d+)\b", 1)).try_cast("int")
    pages = df if expected is None else df.where(shown.isNull() | (shown == expected))
    bound = bind_columns(
        html_rows(pages, html, keep=[page]), page, {"number": ["no."], "name": ["horse"], "draw": ["draw"], "win": ["win"], "place": ["place"]}
    )

    def price(c: str) -> Column:
        return F.nullif(C.to_num(F.regexp_replace(c, r"[^\d.]", "")), F.lit(999.0))

    return bound.where(F.col("number").rlike(r"^\d+$") & ~F.lower("text").contains("scratched")).select(
        page, F.col("number").cast("int").alias("number"), C.name_key("name").alias("name"), F.col("draw").try_cast("int").alias("draw"),
        price("win").alias("win_price"), price("place").alias("place_price"),
    )


def top_pair_prices(df: DataFrame, contest: str, cell: str, price: str, n: int = 10) -> DataFrame:
    """The n lowest-priced pairs of each contest; pair ids like 'qb_1_7_3' end in the two legs."""
    legs = F.regexp_extract_all(cell, F.lit(r"(\d+)"), 1)
    pairs = df.where(F.size(legs) >= 2).select(
        contest, F.element_at(legs, -2).cast("int").alias("leg_a"), F.element_at(legs, -1).cast("int").alias("leg_b"), F.col(price).alias("price")
    )
    w = W.partitionBy(contest).orderBy("price", "leg_a", "leg_b")
    return pairs.where("price is not null").withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def parse_draw_stats(df: DataFrame, html: str, page: str) -> DataFrame:
    """Draw statistics table to draw, win% and place%."""
    bound = bind_columns(html_rows(df, html, keep=[page]), page, {"draw": ["draw"], "win_pct": ["win %", "win%"], "place_pct": ["place %", "place%"]}, first=["draw"])
    percent = lambda c: C.to_num(F.replace(c, F.lit("%"), F.lit("")))
    return bound.where(F.col("draw").rlike(r"^\d+$")).select(
        page, F.col("draw").cast("int").alias("draw"), percent(F.col("win_pct")).alias("win_pct"), percent(F.col("place_pct")).alias("place_pct")
    )


def parse_schedule(df: DataFrame, col: str) -> DataFrame:
    """Meeting schedule JSON to contests with post time and status."""
    meetings = df.select(F.explode(F.from_json(col, SCHEDULE_SCHEMA)["meetings"]).alias("_m"))
    races = meetings.select(C.norm_date("_m.date").alias("contest_date"), C.venue_code("_m.venueCode").alias("venue"), F.explode("_m.races").alias("_r"))
    return races.select("contest_date", "venue", F.col("_r.no").try_cast("int").alias("race_no"), F.try_to_timestamp("_r.postTime").alias("post_at"), F.col("_r.status").alias("status"))


def form_remarks(df: DataFrame, entity: str, order: str, remark: str, k: int = 3, sep: str = " | ") -> DataFrame:
    """The newest k remarks of each entity, newest first."""
    w = W.partitionBy(entity).orderBy(F.col(order).desc(), remark)
    top = df.where(F.length(remark) > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", remark))), lambda s: s[remark])
    return top.groupBy(entity).agg(F.array_join(ordered, sep).alias("remarks"))


def energy(df: DataFrame, entity: str, order: str, text: str) -> DataFrame:
    """Newest energy figure of each entity, read from text like 'Energy: 72'."""
    value = _empty_to_null(F.regexp_extract(text, r"(?i)energy\D{0,12}(\d{1,3})", 1)).try_cast("int")
    known = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    return known.groupBy(entity).agg(F.max_by("_v", order).alias("energy"))
