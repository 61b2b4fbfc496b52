"""Large tables are dealt by innings and by player, so that what one task holds does not grow with them; results stay."""

import os
import re

import pytest

from seamline.operators import aggregate, rates
from seamline.plans import registry_more  # noqa: F401
from seamline.plans import views as v
from seamline.plans.registry import QUERIES, lx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", ["B18_chase_rules", "A21_phase_rates", "A3_volumes"])
def test_tasks_grow_with_the_table(spark, monkeypatch, name):
    query = QUERIES[name][0]
    plain = sorted(map(tuple, query(spark, SF).collect()))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(v, "DEAL_FROM", 100)
    monkeypatch.setattr(v, "PART_ROWS", rows // 20)
    dealt = query(spark, SF)
    assert dealt.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, dealt.collect())) == plain


@pytest.mark.parametrize("name", ["B8_bowler_quality", "B9_K8_draft_pool", "K3_leaderboard", "B7_cell_rates", "A9_cell_counts"])
def test_balls_meet_players_in_as_many_tasks_as_the_table_needs(spark, monkeypatch, name):
    query = QUERIES[name][0]
    plain = sorted(map(tuple, query(spark, SF).collect()))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(v, "DEAL_FROM", 100)
    monkeypatch.setattr(v, "PART_ROWS", rows // 20)
    monkeypatch.setattr(aggregate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, query(spark, SF).collect())) == plain
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        balls = rates._sides(lx(spark, SF), v.batting_attributes(spark, SF), v.bowling_attributes(spark, SF), v.parts(spark, SF))
        plan = balls._jdf.queryExecution().executedPlan().toString()
        dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", plan)]
        assert len(dealt) >= 8 and min(dealt) >= 20, dealt  # Spark alone takes 4
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_small_tables_are_left_to_spark(spark):
    assert v.parts(spark, SF) is None


@pytest.mark.parametrize("name", ["M4_outcome_model", "M4_train_win_model"])
def test_models_are_trained_on_features_that_are_made_once(spark, monkeypatch, name):
    class Stop(Exception):
        pass

    def train(df, *args, **kwargs):
        assert not [f for f in df.inputFiles() if "events" in f]
        assert df.count()
        raise Stop

    monkeypatch.setattr(registry_more.bo, "train", train)
    with pytest.raises(Stop):
        QUERIES[name][0](spark, SF)
