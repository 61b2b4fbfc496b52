"""A corpus pipeline: each stage applies one operator of ``seamline.llm`` to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import decontaminate, lang_id, near_dup, pii, piece_codec
from seamline.llm.registry import PII_KEY
from seamline.llm.shared import BATCH_BYTES, SMALL_BATCH, fresh_names, ship, table, written

NEAR_PERCENT = 80


def prepare(spark: SparkSession) -> None:
    """Ships the package. Stages are written by whoever calls them, so the session itself gets batches that keep a task's Python small."""
    ship(spark)
    spark.conf.set(BATCH_BYTES, f"{SMALL_BATCH}b")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the identifier rejects; fills a missing ``lang``. With no labelled text, only texts without a letter go."""
    prepare(spark)
    names = fresh_names(docs.columns, "lang_pred", "score", "rejected")
    found = lang_id.identify(docs, lang_id.fit(docs), docs.columns, tuple(names)).where(~F.col(names[2]))
    named = F.when(F.col(names[0]) != lang_id.UNDETERMINED, F.col(names[0]))
    return found.withColumn("lang", F.coalesce("lang", named)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group."""
    prepare(spark)
    return near_dup.drop_near_duplicates(docs, NEAR_PERCENT)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the new text."""
    new = pii.surrogate(docs, PII_KEY)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, round_trip."""
    prepare(spark)
    return piece_codec.encode_column(docs, piece_codec.default_model(), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pii", replace_private),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage but the third could be said in SQL; tests hold them against plain Python.
ORACLE_SQL = None
