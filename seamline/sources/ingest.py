"""Match documents to fact tables: reading, ordering, flattening, entity resolution, quality, and the tables' sinks."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.functions import ball
from seamline.operators.scan import numbered
from seamline.session import opened

#: The documents' fields, fixed by their format.
MATCH = (
    "meta struct<data_version: string, created: string, revision: int>, info struct<balls_per_over: int, city: string, dates: array<string>, event: struct<name: string, stage: string>, match_type: string, outcome: struct<winner: string, result: string>,"
    " registry: struct<people: map<string, string>>, season: string, teams: array<string>, toss: struct<decision: string, winner: string>, venue: string>,"
    " innings array<struct<team: string, super_over: boolean, miscounted_overs: map<string, struct<balls: int>>, target: struct<runs: int, overs: double>,"
    " overs: array<struct<over: int, deliveries: array<struct<actual_delivery: double, batter: string, bowler: string, non_striker: string, runs: struct<batter: int, extras: int, total: int>,"
    " extras: struct<wides: int, noballs: int, byes: int, legbyes: int, penalty: int>, wickets: array<struct<kind: string, player_out: string>>>>>>>>"
)
ATTRIBUTES = ["person_id", "name", "external_id", "batting_hand", "bowling_class", "batting_raw", "bowling_raw", "provenance", "source", "retrieved"]
PROVENANCE = ["sourced", "manual", "inferred"]


def assert_schema(df: DataFrame, expected: T.StructType | list[str]) -> DataFrame:
    """``df`` if it has the expected columns (and types), else an error that names the difference."""
    if isinstance(expected, list):
        gone = [c for c in expected if c not in df.columns]
        if gone:
            raise ValueError(f"columns are missing: {gone}")
        return df
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} for {f.dataType}" for f in expected if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("schema differs: " + "; ".join(wrong))
    return df


def read_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder with match_id from 0 by first date, then file name; one bad document fails the read.

    Only dates and file names are put in order; the documents stay where they are read.
    """
    df = spark.read.schema(MATCH).option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(f"{folder}/*.json")
    df = df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"))
    keys = numbered(df.select(F.get("info.dates", F.lit(0)).alias("day"), "file", "_path"), "day", "file", "_path", name="match_id")
    return df.join(keys.select("_path", F.col("match_id").cast("int").alias("match_id")), "_path").drop("_path")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The people register: columns found by their header; identifier and unique_name are needed."""
    return assert_schema(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path), ["identifier", "unique_name"])


def people(matches: DataFrame) -> DataFrame:
    """(match_id, name, id): each match's own registry."""
    return matches.select("match_id", F.explode("info.registry.people").alias("name", "id"))


def resolve_players(sightings: DataFrame, register: DataFrame) -> DataFrame:
    """(player_id, person_id, name, aliases, external_id): ids in the order of person ids; the register's name, else the preferred one."""
    from seamline.operators.aggregate import preferred_names

    names = preferred_names(sightings.select("id", "name")).select("id", F.col("name").alias("seen"))
    alias = sightings.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    reg = register.select(F.col("identifier").alias("id"), "unique_name", *[F.col(c).alias("external_id") for c in register.columns if c == "key_cricinfo"])
    df = alias.join(names, "id").join(reg, "id", "left")
    external = F.col("external_id") if "external_id" in reg.columns else F.lit(None).cast("string")
    named = df.select(F.col("id").alias("person_id"), F.coalesce("unique_name", "seen").alias("name"), "aliases", external.alias("external_id"))
    return numbered(named, "person_id").select(F.col("row").cast("int").alias("player_id"), *named.columns)


def deliveries(matches: DataFrame) -> DataFrame:
    """One row a ball in bowled order: positions of the nested arrays are the order."""
    i = matches.select("match_id", "info", F.posexplode("innings").alias("inn_no", "inn"))
    o = i.select("match_id", "info", "inn_no", "inn", F.posexplode("inn.overs").alias("over_no", "o"))
    d = o.select("match_id", "info", "inn_no", "inn", F.col("o.over").alias("over"), "over_no", F.posexplode("o.deliveries").alias("ball_in_over", "d"))
    e = lambda c: F.coalesce(f"d.extras.{c}", F.lit(0)).alias(c)
    kind = F.get("d.wickets", F.lit(0))
    season = F.substring(F.get("info.dates", F.lit(0)), 1, 4).cast("int")
    other = F.when(F.get("info.teams", F.lit(0)) == F.col("inn.team"), F.get("info.teams", F.lit(1))).otherwise(F.get("info.teams", F.lit(0)))
    flat = d.select(
        "match_id", (F.col("match_id") * 8 + F.col("inn_no")).cast("bigint").alias("innings_id"), season.alias("season"), "over", "ball_in_over", F.col("d.batter").alias("batter"), F.col("d.bowler").alias("bowler"), F.col("d.non_striker").alias("non_striker"),
        kind["player_out"].alias("player_out"), F.col("d.runs.batter").alias("runs_bat"), e("wides"), e("noballs"), e("byes"), e("legbyes"), e("penalty"), ball.parse_wicket(kind["kind"]).alias("wicket"), F.coalesce("inn.super_over", F.lit(False)).alias("super_over"),
        F.col("inn.team").alias("batting_team"), other.alias("bowling_team"), F.col("info.venue").alias("venue"), F.col("d.actual_delivery").cast("string").alias("label"), F.coalesce(F.map_contains_key("inn.miscounted_overs", F.col("over").cast("string")), F.lit(False)).alias("miscounted"), "over_no",
    )
    # a position within the match, so that no global sort is needed
    return flat.withColumn("delivery_id", F.col("innings_id") * 1_000_000 + F.col("over_no") * 1000 + F.col("ball_in_over")).drop("over_no")


def with_player_ids(d: DataFrame, sightings: DataFrame, players: DataFrame) -> DataFrame:
    """Names replaced by player ids through each match's registry; a name that it lacks is null."""
    ids = sightings.join(players.select(F.col("person_id").alias("id"), "player_id"), "id").select("match_id", "name", "player_id")
    for c in ("batter", "bowler", "non_striker", "player_out"):
        d = d.join(ids.select("match_id", F.col("name").alias(c), F.col("player_id").alias(f"_{c}")), ["match_id", c], "left").drop(c).withColumnRenamed(f"_{c}", c)
    return d


def quality(d: DataFrame, matches: DataFrame) -> DataFrame:
    """(key, kind, value) of counts, coverage shares and faults: what the gate compares."""
    x = d.withColumn("legal", ball.is_legal())
    n = x.agg(F.count("*").alias("deliveries"), F.count_if("legal").alias("legal"), F.count_if(F.col("wicket").isNotNull()).alias("wickets"), F.count_if(F.col("batter").isNull() | F.col("bowler").isNull()).alias("unresolved"))
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit("")) != "", 1.0).otherwise(0.0))
    m = matches.agg(F.count("*").alias("matches"), share(F.col("info.city")).alias("city"), share(F.col("info.venue")).alias("venue"), share(F.col("info.toss.winner")).alias("toss"), share(F.col("info.outcome.winner")).alias("winner"))
    kinds = {"deliveries": "count", "legal": "count", "wickets": "count", "matches": "count", "unresolved": "fault", "city": "coverage", "venue": "coverage", "toss": "coverage", "winner": "coverage"}
    return n.crossJoin(m).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("kind"), F.col(k).cast("double").alias("value")) for k, v in kinds.items()])).alias("x")).select("x.*")


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """Percentage of rows with a non-empty value, by column."""
    return df.agg(*[F.round(F.coalesce(F.avg(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 100.0).otherwise(0.0)), F.lit(0.0)), 6).alias(c) for c in columns])


# -- sinks


def write_facts(d: DataFrame, path: str) -> None:
    """Facts by season, rows of an innings together, so that filters on season and innings skip files and row groups; a large season is cut into ranges of innings."""
    d.repartitionByRange("season", "innings_id").sortWithinPartitions("season", "innings_id", "delivery_id").write.mode("overwrite").partitionBy("season").parquet(path)


def verify_round_trip(d: DataFrame, path: str) -> None:
    """Fails unless what was written is what was meant, row for row."""
    back = d.sparkSession.read.schema(d.schema).parquet(path).select(d.columns)
    if back.count() != d.count() or not back.exceptAll(d).isEmpty() or not d.exceptAll(back).isEmpty():
        raise ValueError(f"{path} does not hold what was written")


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Facts from Parquet; a file that is damaged or has another schema is an error."""
    return assert_schema(spark.read.option("mergeSchema", False).parquet(path), schema)


def load_attributes(spark: SparkSession, path: str) -> DataFrame:
    """The attribute table; absent means empty; an empty id or unknown provenance is an error."""
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        # the file system of the path, not the driver's disk, says whether it is there
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ATTRIBUTES))
    assert_schema(df, ["person_id", "name", "batting_hand", "bowling_class"])
    df = df.select(*[(F.trim(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ATTRIBUTES])
    bad = df.where(F.coalesce("person_id", F.lit("")).eqNullSafe("") | ~F.coalesce("provenance", F.lit("")).isin(PROVENANCE)).limit(1).collect()
    if bad:
        raise ValueError(f"bad attribute row: {bad[0].asDict()}")
    return df.select(*[F.nullif(c, F.lit("")).alias(c) for c in ATTRIBUTES])


def save_attributes(df: DataFrame, path: str) -> None:
    """One sorted CSV file, so that versions differ by their changes only; a dimension table."""
    df.select(ATTRIBUTES).orderBy("person_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """A training matrix by ``split`` in one pass."""
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def _few(rows: DataFrame, most: int) -> list:
    """The rows of a report; more than ``most`` are refused, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows: write a table, or raise the bound")
    return got


def write_document(rows: DataFrame, path: str, most: int = 10_000, **more) -> None:
    """A small report as indented JSON: its rows, at most ``most``, under ``rows``."""
    got = [r.asDict(recursive=True) for r in _few(rows, most)]
    write_text(path, json.dumps(more | {"rows": got}, indent=2, default=str) + "\n")


def write_text(path: str, text: str) -> None:
    """A small file on the file system of its path, under its name only once it is whole."""
    files, at = opened(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as f:
        f.write(text.encode())
    files.move(own, at)


def read_document(path: str) -> dict:
    files, at = opened(path)
    with files.open_input_file(at) as f:
        return json.loads(f.read())


def markdown_table(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result, of at most ``most`` rows, as a Markdown section."""
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _few(rows, most)]
    return "\n".join(lines) + "\n"
