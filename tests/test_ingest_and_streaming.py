import json

import pytest
from pyspark.sql import functions as F

from seamline.operators import windows as wi
from seamline.plans.registry import ex
from seamline.sources import ingest
from seamline.streaming import live


def match(date, people, balls, season="2024", stage=None, venue="Ground"):
    return {
        "meta": {"data_version": "1", "created": date, "revision": 1},
        "info": {"balls_per_over": 6, "city": "", "dates": [date], "event": {"name": "Cup"} | ({"stage": stage} if stage else {}), "match_type": "T20", "outcome": {"winner": "A"}, "registry": {"people": people}, "season": season, "teams": ["A", "B"], "toss": {"decision": "bat", "winner": "A"}, "venue": venue},
        "innings": [{"team": "A", "overs": [{"over": 0, "deliveries": balls}]}],
    }


def one(batter="X", bowler="Y", runs=0, label=None, **more):
    return {"batter": batter, "bowler": bowler, "non_striker": "Z", "runs": {"batter": runs, "extras": 0, "total": runs}} | more | ({"actual_delivery": label} if label else {})


@pytest.fixture
def folder(tmp_path):
    a = match("2024-05-02", {"X": "p1", "Y": "p2", "Z": "p3"}, [one(runs=4, label=0.1), one(extras={"wides": 1}), one(wickets=[{"kind": "caught", "player_out": "X"}]), one(label=0.9)], stage=3)
    b = match("2024-05-01", {"X": "p9", "Y": "p2"}, [one(runs=1)], season=2024)
    for name, m in (("a", a), ("b", b)):
        (tmp_path / f"{name}.json").write_text(json.dumps(m, indent=1))
    return str(tmp_path)


def test_matches_to_facts(spark, folder, tmp_path):
    m = ingest.read_matches(spark, folder)
    assert [r.file for r in m.orderBy("match_id").collect()] == ["b.json", "a.json"]
    seen = ingest.people(m)
    (tmp_path / "people.csv").write_text("identifier,name,unique_name,key_cricinfo\np1,X,Xavier,77\np2,Y,,\n")
    players = ingest.resolve_players(seen, ingest.read_register(spark, str(tmp_path / "people.csv")))
    got = {r.person_id: (r.player_id, r.name, r.external_id) for r in players.collect()}
    assert got == {"p1": (0, "Xavier", "77"), "p2": (1, "Y", None), "p3": (2, "Z", None), "p9": (3, "X", None)}
    d = ingest.with_player_ids(ingest.deliveries(m), seen, players).orderBy("delivery_id")
    rows = d.collect()
    assert [r.batter for r in rows] == [3, 0, 0, 0, 0] and [r.non_striker for r in rows] == [None, 2, 2, 2, 2] and rows[3].player_out == 0 and rows[2].wides == 1
    assert [r.label for r in rows] == [None, "0.1", None, None, "0.9"]
    q = {r.key: r.value for r in ingest.quality(d, m).collect()}
    assert q["deliveries"] == 5 and q["legal"] == 4 and q["wickets"] == 1 and q["city"] == 0 and q["venue"] == 1 and q["unresolved"] == 0
    path = str(tmp_path / "facts")
    ingest.write_facts(d, path)
    ingest.verify_round_trip(d, path)
    with pytest.raises(ValueError):
        ingest.verify_round_trip(d.withColumn("wides", F.col("wides") + 1), path)
    with pytest.raises(ValueError):
        ingest.read_facts(spark, path, d.withColumn("wides", F.lit("x")).schema)


def test_bad_documents_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"info": ')
    with pytest.raises(Exception):  # noqa: B017
        ingest.read_matches(spark, str(tmp_path)).select("info").collect()
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        ingest.read_register(spark, str(tmp_path / "p.csv"))


def test_attributes(spark, tmp_path):
    assert ingest.load_attributes(spark, str(tmp_path / "none.csv")).count() == 0
    head = ",".join(ingest.ATTRIBUTES)
    (tmp_path / "a.csv").write_text(f"{head}\n p2 ,B,,RHB,,,,manual,,\np1,A,,LHB,OB,x,y,sourced,w,d\n")
    df = ingest.load_attributes(spark, str(tmp_path / "a.csv"))
    ingest.save_attributes(df, str(tmp_path / "out"))
    back = ingest.load_attributes(spark, str(tmp_path / "out"))
    assert [r.person_id for r in back.collect()] == ["p1", "p2"] and back.exceptAll(df).isEmpty()
    (tmp_path / "b.csv").write_text(f"{head}\np1,A,,LHB,OB,x,y,guessed,w,d\n")
    with pytest.raises(ValueError):
        ingest.load_attributes(spark, str(tmp_path / "b.csv"))


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    ingest.write_document(df, str(tmp_path / "d.json"), title="t")
    assert ingest.read_document(str(tmp_path / "d.json")) == {"title": "t", "rows": [{"k": 1, "v": "a"}, {"k": 2, "v": None}]}
    assert "| 1 | a |" in ingest.markdown_table(df, "T")
    ingest.write_matrix(df.withColumn("split", F.lit("train")), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    x = ex(spark, "/root/testdata/sf0.001").select("innings_id", "delivery_id", "total", "costs", "legal")
    half = x.agg(F.expr("percentile(delivery_id, 0.5)")).first()[0]
    for i, part in enumerate((x.where(F.col("delivery_id") <= half), x.where(F.col("delivery_id") > half - 20))):  # with repeats
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = live.running_state_stream(stream, None).writeStream.format("memory").queryName("running").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    want = wi.running_state(ex(spark, "/root/testdata/sf0.001")).select("innings_id", "delivery_id", "score_before", "wickets_before", "legal_before")
    got = spark.table("running")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_absent_attributes_are_empty_and_other_faults_are_not(spark, tmp_path):
    for path in (str(tmp_path / "none.csv"), f"file://{tmp_path}/none.csv"):
        assert ingest.load_attributes(spark, path).count() == 0
    there = spark.createDataFrame([("p1", "Ann", "RHB", "RAP", "manual")], "person_id string, name string, batting_hand string, bowling_class string, provenance string")
    there.write.option("header", True).csv(str(tmp_path / "some.csv"))
    # a folder that the driver's own working directory does not show under this name
    assert ingest.load_attributes(spark, f"file:{tmp_path}/some.csv").count() == 1
    with pytest.raises(Exception, match="[Ff]ile ?[Ss]ystem|scheme"):
        ingest.load_attributes(spark, "nosuch://host/none.csv")


def test_a_load_passes_its_gate_or_leaves_what_was_published(spark, tmp_path):
    from seamline.sources import loader

    def match(day, balls, city):
        ball = {"batter": "A", "bowler": "B", "non_striker": "C", "runs": {"batter": 1}}
        info = {"dates": [day], "teams": ["X", "Y"], "venue": "V", "registry": {"people": {"A": "a", "B": "b", "C": "c"}}} | ({"city": "Z"} if city else {})
        return json.dumps({"info": info, "innings": [{"team": "X", "overs": [{"over": 0, "deliveries": [ball] * balls}]}]})

    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "1.json").write_text(match("2020-01-01", 6, True))
    (folder / "2.json").write_text(match("2020-01-02", 5, True))
    (tmp_path / "register.csv").write_text("identifier,unique_name\na,Ann\nb,Bo\n")
    report = loader.load(spark, str(folder), str(tmp_path / "register.csv"), out)
    assert {r.key: r.value for r in report.collect()} == {"deliveries": 11, "legal": 11, "wickets": 0, "unresolved": 0, "matches": 2, "city": 1, "venue": 1, "toss": 0, "winner": 0}
    facts, players = loader.published(spark, out)
    assert facts.count() == 11 and {r.name for r in players.collect()} == {"Ann", "Bo", "C"}
    (tmp_path / "old.json").write_text((tmp_path / "out" / "quality.json").read_text())
    (folder / "2.json").write_text(match("2020-01-02", 4, False))
    with pytest.raises(loader.QualityError, match="city: coverage fell.*deliveries: fewer"):
        loader.load(spark, str(folder), str(tmp_path / "register.csv"), out, baseline=str(tmp_path / "old.json"))
    assert loader.published(spark, out)[0].count() == 11  # as before
    (folder / "2.json").write_text(match("2020-01-02", 7, True))
    loader.load(spark, str(folder), str(tmp_path / "register.csv"), out, baseline=str(tmp_path / "old.json"))
    assert loader.published(spark, out)[0].count() == 13
    assert "| deliveries | count | 13.0 |" in (tmp_path / "out" / "quality.md").read_text()
    (folder / "3.json").write_text("{broken")
    with pytest.raises(Exception, match="[Mm]alformed|FAILFAST"):
        loader.load(spark, str(folder), str(tmp_path / "register.csv"), out)
    assert loader.published(spark, out)[0].count() == 13
