"""Queries of the operators in this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.wordbpe import token_counts, vocabulary_path

    out = token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.pieces import model_path, round_trip

    return round_trip(table(spark, sf_dir, "documents"), model_path())


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.licences import licence_report

    return licence_report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.common import fold_of
    from trailweave.llm.language import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    out = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.personal import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.common import fold_of
    from trailweave.llm.toxicity import predict, train, training_rows

    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    return predict(docs, model).withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "score", "predicted")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.common import scratch_path
    from trailweave.llm.tokenfiles import read_token_files, write_token_files
    from trailweave.llm.wordbpe import vocabulary_path

    out = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), out, end_id=2)
    return read_token_files(spark, out)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.common import fold_of
    from trailweave.llm.quality import predict, train, training_rows

    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    return predict(docs, model).withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from trailweave.llm import audit, lexical

    return {"op11_filter_audit": audit.SQL, "op12_lexical_search": lexical.SQL}
