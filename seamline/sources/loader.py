"""The whole load of a corpus: documents to facts, checked, reported, and published only if the quality gate passes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from seamline.operators.results import compare_reports
from seamline.session import written
from seamline.sources import ingest

REPORT = "key string, kind string, value double"


class QualityError(ValueError):
    """A report that is worse than its baseline."""


def load(spark: SparkSession, folder: str, register: str, out: str, baseline: str | None = None) -> DataFrame:
    """Loads the documents of ``folder`` into ``out`` and returns the quality report.

    Facts go to a folder of their own, are read back and compared row for row, and
    measured. The report is written as ``quality.json`` and ``quality.md``. With a
    ``baseline`` (the path of an earlier report) a regression is an error that names
    every one of them; what was published before then stays. Else ``current.json``
    comes to name the new facts and players, by one rename, so readers see the old
    load or the new one. An empty folder is an error of the read.
    """
    matches = written(ingest.read_matches(spark, folder), "matches")
    sightings = ingest.people(matches)
    players = written(ingest.resolve_players(sightings, ingest.read_register(spark, register)), "players")
    facts = written(ingest.with_player_ids(ingest.deliveries(matches), sightings, players), "facts")
    version = uuid.uuid4().hex
    paths = {"facts": f"{out}/facts-{version}", "players": f"{out}/players-{version}"}
    ingest.write_facts(facts, paths["facts"])
    ingest.verify_round_trip(facts, paths["facts"])
    players.write.parquet(paths["players"])
    report = written(ingest.quality(facts, matches), "quality").orderBy("key")
    ingest.write_document(report, f"{out}/quality.json", folder=folder)
    ingest.write_text(f"{out}/quality.md", ingest.markdown_table(report, "Quality"))
    if baseline:
        worse = compare_reports(read_report(spark, baseline), report).orderBy("key").collect()
        if worse:
            raise QualityError("; ".join(f"{r.key}: {r.regression}, {r.was} before and {r.now} now" for r in worse))
    ingest.write_text(f"{out}/current.json", json.dumps(paths) + "\n")
    return report


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(r["key"], r["kind"], r["value"]) for r in ingest.read_document(path)["rows"]], REPORT)


def published(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(facts, players) of the last load that passed its gate."""
    paths = ingest.read_document(f"{out}/current.json")
    return spark.read.parquet(paths["facts"]), spark.read.parquet(paths["players"])
