"""The registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe, fingerprint, interaction, langid, licenses, multimatch, neighbours, packing, pitman_yor, secrets, simhash, spelling, substrings,
)
from millrace.llm.batches import read
from millrace.llm.checking import FILTER_AUDIT, SHINGLE_JOIN, SPELLING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def checked(sql: str):
    """Register a query together with its checking SQL."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        ORACLES[build.__name__] = sql
        return query(build)

    return register


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(read(spark, folder, "documents"), vocabulary())


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), vocabulary())


@query
def op2_langid(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    samples = langid.learn(documents.where(fold != 2))
    ids = documents.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    return langid.predict(ids, samples).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.deduplicate(read(spark, folder, "documents"), digest=True)
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query
def op9_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.against_next(read(spark, folder, "documents"))


@query
def op10_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    flagged = documents.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    model = pitman_yor.train(documents.withColumn("learn", F.coalesce(fold != 2, F.lit(False))))
    return pitman_yor.score(flagged, model)


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "source")
    found = secrets.scan(documents).select("doc_id", F.explode("findings").alias("f"))
    return found.select(
        "doc_id", F.col("f.at").alias("word_number"), F.length("f.value").alias("length"), F.sha2("f.value", 256).alias("value_sha256"),
        "f.before", "f.after", F.col("f.chance").alias("chance"), (F.col("f.chance") > 0.5).alias("is_secret"),
    )


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


@checked(SPELLING)
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, folder, "documents")))


@checked(FILTER_AUDIT)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interaction.audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


@checked(SHINGLE_JOIN)
def op13_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return multimatch.linked(read(spark, folder, "documents"))
