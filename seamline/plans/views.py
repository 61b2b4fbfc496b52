"""Logical views of deliveries over the driver's tables, and the same views as DuckDB SQL.

``relational``: lineitem with orders; a large, unordered fact table.
``ordered``: events in ``event_id`` order; innings of eight hours.
Both have the columns of ``COLUMNS``; operators know only these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.aggregate import meet

COLUMNS = ["delivery_id", "innings_id", "match_id", "season", "over", "batter", "non_striker", "bowler", "player_out", "runs_bat", "wides", "noballs", "byes", "legbyes", "penalty", "wicket", "super_over", "batting_team", "bowling_team", "venue"]
KINDS = ["caught", "bowled", "lbw", "run out", "stumped", "retired hurt", "hit wicket"]

#: Line items of a part, and from how many on they are dealt into parts of this size.
PART_ROWS, DEAL_FROM = 250_000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind_expr(index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


def materialise(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes both fact views once, rows of an innings together and in season order; queries over ``sf_dir`` in this application then read them.

    Without it, or once a table has changed, every query joins the tables anew. ``path`` is a folder that all executors share.
    """
    state = _state(spark, sf_dir)
    for view in (relational, ordered):
        facts = view(spark, sf_dir).repartitionByRange("season", "innings_id").sortWithinPartitions("season", "innings_id", "delivery_id")
        facts.write.mode("overwrite").parquet(f"{path}/{view.__name__}")
    made = getattr(spark.sparkContext, "_seamline_facts", {})
    spark.sparkContext._seamline_facts = made | {sf_dir: (path, state)}


def _state(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Size and time of the tables that the views read, as the file system of the path tells them; a folder's time changes with its files."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{{lineitem,orders,customer,supplier,events}}.parquet")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The view as written, if its tables have not changed since."""
    path, state = getattr(spark.sparkContext, "_seamline_facts", {}).get(sf_dir, (None, None))
    return spark.read.parquet(f"{path}/{name}") if path and state == _state(spark, sf_dir) else None


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many parts to deal the line items, so that one has at most ``PART_ROWS`` on average; None where they are so few that Spark may choose."""
    rows = table(spark, sf_dir, "lineitem").count()  # from the footers
    return max(-(-rows // PART_ROWS), spark.sparkContext.defaultParallelism) if rows > DEAL_FROM else None


def relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item; the two nation columns stand for venue and teams. A large table is dealt by innings, so that what a task sorts does not grow with it."""
    if (made := _made(spark, sf_dir, "relational")) is not None:
        return made
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "cast(l_quantity as int) AS q", "l_returnflag AS flag", "l_linestatus AS status")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    # orders meet customers before line items, so that only narrow rows are ever dealt by customer
    n = parts(spark, sf_dir)
    orders = meet(orders, table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey"), "o_custkey", "inner", n)
    line = meet(line, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey"), "l_suppkey", "inner", n)
    # innings last, so that what follows finds the balls dealt by them
    return meet(line, orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "inner", n, small=0).selectExpr(*_RELATIONAL)


_OUT = f"CASE WHEN status = 'F' AND q % 7 = 3 THEN {_kind_expr('l_linenumber - 1')} END"
_RELATIONAL = [
    "cast(NULL as bigint) AS delivery_id", "cast(l_orderkey as bigint) AS innings_id", "cast(l_orderkey as bigint) AS match_id", "cast(year(o_orderdate) as int) AS season",
    "cast((l_linenumber - 1) * 3 as int) AS over", "cast(o_custkey as bigint) AS batter", "cast(o_custkey * 7 % 1009 as bigint) AS non_striker", "cast(l_suppkey as bigint) AS bowler",
    f"CASE WHEN {_OUT} IS NULL THEN NULL WHEN l_linenumber = 4 THEN cast(o_custkey * 7 % 1009 as bigint) ELSE cast(o_custkey as bigint) END AS player_out",
    "cast(CASE WHEN q <= 5 * (l_suppkey % 5 + 1) THEN 0 WHEN q % 9 = 5 THEN 6 WHEN q % 9 = 6 THEN 0 WHEN q % 9 = 7 THEN 1 WHEN q % 9 = 8 THEN 5 ELSE q % 9 END as int) AS runs_bat",
    "cast(CASE WHEN q % 11 = 0 AND flag = 'A' THEN 1 ELSE 0 END as int) AS wides", "cast(CASE WHEN q % 13 = 0 AND flag = 'R' THEN 1 ELSE 0 END as int) AS noballs",
    "cast(CASE WHEN q % 17 = 0 THEN 1 ELSE 0 END as int) AS byes", "cast(CASE WHEN q % 19 = 0 THEN 1 ELSE 0 END as int) AS legbyes", "cast(CASE WHEN q = 50 THEN 5 ELSE 0 END as int) AS penalty",
    f"{_OUT} AS wicket", "o_orderstatus = 'P' AND l_linenumber = 7 AS super_over", "cast(c_nationkey as int) AS batting_team", "cast(s_nationkey as int) AS bowling_team", "cast(c_nationkey as int) AS venue",
]

RELATIONAL_SQL = (
    f"SELECT {', '.join(_RELATIONAL)} FROM (SELECT *, cast(l_quantity as int) AS q, l_returnflag AS flag, l_linestatus AS status FROM lineitem) l "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
)

_EVENT_OUT = f"CASE WHEN event_type = 'signup' AND k < 25 THEN {_kind_expr('k % 7')} END"
_ORDERED = [
    "cast(event_id as bigint) AS delivery_id", "inn AS innings_id", "inn // 2 AS match_id", "cast(2020 + inn // 18 as int) AS season", "cast(user_id as bigint) AS batter", "cast((user_id * 7 + 3) % 150 as bigint) AS non_striker",
    "cast(k % 40 as bigint) AS bowler", f"CASE WHEN {_EVENT_OUT} IS NULL THEN NULL WHEN k % 7 = 3 THEN cast((user_id * 7 + 3) % 150 as bigint) ELSE cast(user_id as bigint) END AS player_out",
    "cast(CASE event_type WHEN 'click' THEN 1 + k % 3 WHEN 'purchase' THEN 4 + 2 * (k % 2) ELSE 0 END as int) AS runs_bat", "cast(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 1 ELSE 0 END as int) AS wides",
    "cast(CASE WHEN event_type = 'error' AND k % 2 = 1 THEN 1 ELSE 0 END as int) AS noballs", "cast(0 as int) AS byes", "cast(CASE WHEN event_type = 'view' AND k % 20 = 1 THEN 1 ELSE 0 END as int) AS legbyes", "cast(0 as int) AS penalty",
    f"{_EVENT_OUT} AS wicket", "inn % 45 = 44 AS super_over", "cast((inn // 2 + inn) % 10 as int) AS batting_team", "cast((inn // 2 + inn + 1) % 10 as int) AS bowling_team", "cast(inn // 2 % 12 as int) AS venue",
]


def _over(name: str = "over") -> str:
    """Overs of six legal balls, in event order."""
    return f"cast((sum(CASE WHEN wides = 0 AND noballs = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY innings_id ORDER BY delivery_id) - CASE WHEN wides = 0 AND noballs = 0 THEN 1 ELSE 0 END) {{div}} 6 as int) AS {name}"


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, in event order within innings."""
    if (made := _made(spark, sf_dir, "ordered")) is not None:
        return made
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "cast(get_json_object(props, '$.k') as int) AS k", "(unix_seconds(cast(ts as timestamp)) - 1704067200) div 28800 AS inn")
    d = e.selectExpr(*[x.replace("//", "div") for x in _ORDERED])
    return d.selectExpr("*", _over().format(div="div")).select(*COLUMNS)


ORDERED_SQL = (
    f"SELECT {', '.join(COLUMNS)} FROM (SELECT *, {_over().format(div='//')} FROM (SELECT {', '.join(_ORDERED)} FROM "
    "(SELECT event_id, user_id, event_type, cast(props ->> '$.k' as int) AS k, cast(floor((epoch(ts) - 1704067200) / 28800) as bigint) AS inn FROM events) e) f) g"
)


def batting_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, hand (RHB, LHB or null)."""
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) AS player", "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'LHB' WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'RHB' END AS hand")


def bowling_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, bowl_class (one of six or null)."""
    return table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) AS player", "CASE s_nationkey % 7 WHEN 1 THEN 'RAP' WHEN 2 THEN 'LAP' WHEN 3 THEN 'OB' WHEN 4 THEN 'LB' WHEN 5 THEN 'SLA' WHEN 6 THEN 'SLW' END AS bowl_class")


BATTING_SQL = "SELECT c_custkey::BIGINT AS player, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'LHB' WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'RHB' END AS hand FROM customer"
BOWLING_SQL = "SELECT s_suppkey::BIGINT AS player, CASE s_nationkey % 7 WHEN 1 THEN 'RAP' WHEN 2 THEN 'LAP' WHEN 3 THEN 'OB' WHEN 4 THEN 'LB' WHEN 5 THEN 'SLA' WHEN 6 THEN 'SLW' END AS bowl_class FROM supplier"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each day and user: the results table's columns that the operators read."""
    return table(spark, sf_dir, "events").selectExpr("cast(cast(ts as date) as string) AS date", "user_id", "value", "event_type", "cast(get_json_object(props, '$.k') as int) AS k", "event_id").groupBy("date", "user_id").agg(
        F.expr("concat('r', date, '-', cast(user_id as string))").alias("id"),
        F.expr("CASE WHEN user_id % 9 = 0 THEN '  ' ELSE concat('p', cast(user_id as string)) END").alias("player"),
        F.expr("max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)").alias("defended"),
        F.expr("max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)").alias("chased"),
        F.expr("cast(sum(k) as double)").alias("total_score"),
        F.expr("max(event_id)").alias("finished_at"),
    ).select("id", "date", "player", "defended", "chased", "total_score", "finished_at")


RESULTS_SQL = """
SELECT concat('r', date, '-', user_id::VARCHAR) AS id, date, CASE WHEN user_id % 9 = 0 THEN '  ' ELSE concat('p', user_id::VARCHAR) END AS player,
  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS defended, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS chased,
  sum(k)::DOUBLE AS total_score, max(event_id) AS finished_at
FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, event_type, (props ->> '$.k')::INT AS k, event_id FROM events) e GROUP BY date, user_id"""
