"""Queries of this subpackage for ``__spark_entry__``: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import oracles
from seamline.llm.shared import ship, table
from seamline.llm.url_filter import Rule

URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]
#: The key of the surrogates; a deployment sets its own.
PII_KEY = "surrogate-key-1"
#: Host labels that mark a listed host, wherever they stand in it.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track"]


def _remainder(df: DataFrame, n: int):
    """Null for a row without doc_id, which is never held out."""
    return F.pmod(F.crc32(df.doc_id.cast("string")), F.lit(n))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, LISTED_LABELS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import lang_id

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.coalesce(_remainder(docs, 3) == 1, F.lit(False)))
    model = lang_id.fit(docs.where("NOT held_out"))
    return lang_id.identify(docs, model, ["doc_id", "held_out"])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import pii

    return pii.surrogate(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import flac

    return flac.audio_features(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.withColumn("held_out", F.coalesce(_remainder(docs, 5) == 0, F.lit(False)))
    model = toxicity.fit(docs.where("NOT held_out"), labels.where(_remainder(labels, 5) != 0))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import piece_codec

    return piece_codec.encode_column(table(spark, sf_dir, "documents"), piece_codec.default_model(), ["doc_id"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import decontaminate

    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import recurrent_lm as lm
    from seamline.llm.shared import written

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.coalesce(_remainder(docs, 7) == 2, F.lit(False)))
    training = docs.where("NOT held_out").select("text")
    counts = written(lm.count_tokens(training), "counts")
    return lm.score(docs, lm.fit(training, counts), counts, ["doc_id", "held_out"])


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import warc

    got = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import quality
    from seamline.llm.shared import written

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.withColumn("held_out", F.coalesce(_remainder(docs, 5) == 0, F.lit(False)))
    stats = written(quality.statistics(docs, ["doc_id", "held_out"]), "stats")
    return quality.score(stats, quality.fit(stats, labels.where(_remainder(labels, 5) != 0)), ["doc_id", "held_out"], least=0.3)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", dims=64, scale=64)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm import phrases

    return phrases.mine(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, inside_percent=50)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pii": (op1_pii, None),
    "op2_url_filter": (op2_url_filter, oracles.url_filter(URL_RULES, LISTED_LABELS)),
    "op3_flac": (op3_flac, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_language_id": (op5_language_id, None),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_recurrent_lm": (op8_recurrent_lm, None),
    "op9_near_dup": (op9_near_dup, oracles.NEAR_DUP),
    "op10_warc": (op10_warc, oracles.WARC),
    "op11_quality": (op11_quality, None),
    "op12_centroids": (op12_centroids, oracles.centroids(16, 3)),
    "op13_phrases": (op13_phrases, oracles.PHRASES),
}
QUERIES = {name: (_shipped(query), sql) for name, (query, sql) in _ALL.items()}
