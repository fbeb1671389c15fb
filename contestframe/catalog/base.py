"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Macro-free text of the four adapter views; a query lists the ones it uses.
VIEW_SQL = {
    "runs": """runs as (
  select l_orderkey as contest_id, cast(o_orderdate as date) as contest_date,
    cast(year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) as bigint)*1000000
      + l_orderkey as contest_ord,
    l_partkey as entrant_id, l_suppkey as rider_id, s_nationkey as stable_id,
    o_orderpriority as track, 1000 + 200*(o_custkey % 7) as distance, l_linenumber as draw,
    l_extendedprice/1000 as elapsed, (12 + 6*l_quantity)/10 as price, 105 + 375*l_tax as weight,
    row_number() over (partition by l_orderkey order by l_extendedprice) as finish_rank,
    case when row_number() over (partition by l_orderkey order by l_extendedprice) = 1 then 1 else 0 end as win
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey)""",
    "ticks": """ticks as (
  select cast(floor(user_id/10) as bigint) as contest_id, user_id as entrant_id, 1 + value as price,
    ts, event_type as source
  from events)""",
    "payouts": """placed as (
  select contest_id, max(case when finish_rank=1 then price end) p1,
    max(case when finish_rank=2 then price end) p2, max(case when finish_rank=3 then price end) p3
  from runs where finish_rank <= 3 group by contest_id),
payouts as (
  select * from (
    select contest_id, 'WIN' as pool, '1' as combo, 10*p1 as payout from placed
    union all select contest_id, 'PLACE', '1', 10*(1+(p1-1)/4) from placed
    union all select contest_id, 'PLACE', '2', 10*(1+(p2-1)/4) from placed
    union all select contest_id, 'PLACE', '3', 10*(1+(p3-1)/4) from placed
    union all select contest_id, 'QUINELLA', '1/2', 10*p1*p2/2 from placed
    union all select contest_id, 'QPL', '1/2', 10*p1*p2/2 from placed
    union all select contest_id, 'QPL', '1/3', 10*p1*p3/2 from placed
    union all select contest_id, 'QPL', '2/3', 10*p2*p3/2 from placed) where payout is not null)""",
    "work_events": """work_events as (
  select l_partkey as entrant_id, cast(l_shipdate as date) as activity_date, l_suppkey as rider_id,
    l_quantity/2 + 10 as time_400, l_linestatus = 'F' as is_fast
  from lineitem)""",
}


def register(name: str, sql: str | None = None, views: str = ""):
    """Adds a query; `views` names the adapter views its SQL starts from."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            names = views.split()
            body = sql.strip()
            if names:
                head = ",\n".join(VIEW_SQL[v] for v in names)
                body = f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head}\n{body}"
            ORACLES[name] = body
        return fn

    return keep


def r4(col) -> Column:
    """Rounded for comparison: moves half-way ties off the border and removes negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(1e-7), 4) + F.lit(0.0)


def big(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")
