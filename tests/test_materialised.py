import shutil

from seamline.plans import views
from seamline.plans.registry import QUERIES
from tests.test_oracles import SF


def test_facts_written_once_give_the_same_rows(spark, tmp_path):
    rows = lambda name: sorted(map(str, QUERIES[name][0](spark, SF).collect()))
    names = ["A1_P9_P10_P16_J1_J2_dist", "A21_phase_rates", "W1_W2_W4_W5_running_state"]
    before = [rows(n) for n in names]
    views.materialise(spark, SF, str(tmp_path / "facts"))
    try:
        assert [rows(n) for n in names] == before
        assert views.relational(spark, SF).columns == views.COLUMNS
    finally:
        spark.sparkContext._seamline_facts = {}


def test_a_changed_table_is_not_read_from_what_was_written(spark, tmp_path):
    for name in ("lineitem", "orders", "customer", "supplier", "events"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    d = str(tmp_path)
    views.materialise(spark, d, str(tmp_path / "facts"))
    whole = views.ordered(spark, d).count()
    assert "facts" in views.ordered(spark, d).inputFiles()[0]
    half = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 2 = 0").toPandas()
    half.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    assert views.ordered(spark, d).count() == len(half) < whole
