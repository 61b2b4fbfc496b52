"""The draft pool has both roles; in the driver's tables no batter faces 500 balls, 11 an innings, so these tables are made here."""

import datetime

import duckdb
import pandas as pd

from seamline.plans.registry import QUERIES

#: Customer: supplier who bowls, innings, balls an innings, quantities of its balls (40 is a four, 1 no run).
BATS = {0: (8, 40, 15, (40, 1)), 1: (8, 40, 15, (40, 1)), 2: (8, 20, 15, (40, 1)), 3: (8, 60, 10, (40, 1)), 4: (1, 14, 60, (1,)), 5: (7, 36, 14, (40, 1, 40, 1, 1)), 7: (8, 1, 1, (1,)), 8: (7, 1, 1, (1,))}


def _tables(folder):
    orders, lines = [], []
    for player, (bowler, innings, balls, quantities) in BATS.items():
        for i in range(innings):
            key = 1000 * player + i
            orders.append((key, player, datetime.date(1995 + i % 3, 5, 1), "F"))
            lines += [(key, n + 1, bowler, float(quantities[(n + i) % len(quantities)]), "N", "O") for n in range(balls)]
    tables = {
        "customer": pd.DataFrame([(c, c % 5, ("BUILDING", "HOUSEHOLD")[c % 2]) for c in BATS], columns=["c_custkey", "c_nationkey", "c_mktsegment"]),
        "supplier": pd.DataFrame([(1, 1), (7, 2), (8, 3)], columns=["s_suppkey", "s_nationkey"]),
        "orders": pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"]),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]),
    }
    for name, rows in tables.items():
        rows.to_parquet(f"{folder}/{name}.parquet")
    return tables


def test_batters_are_drafted_too(spark, tmp_path):
    query, sql = QUERIES["B9_K8_draft_pool"]
    c = duckdb.connect()
    for name in _tables(tmp_path):
        c.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    got = [tuple(r) for r in query(spark, str(tmp_path)).select("role", "player", "quality", "cost").collect()]
    assert got == c.sql(sql).fetchall()
    # batter 2 has too few balls, 3 too few an innings, 4 too little quality; bowler 8 has none; 1 is drafted in both roles
    assert [(role, player) for role, player, _, _ in got] == [("bowler", 1), ("bowler", 7), ("batter", 0), ("batter", 1), ("batter", 5)]
