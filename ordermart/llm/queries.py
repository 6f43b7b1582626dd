"""The registered queries of the text operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.llm import alignment, bpe, hard_negatives, licences, line_dedup, metric_join, mixing, packing, pii, quality, simhash, suffix_dedup, toxicity
from ordermart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    one = F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(one, ",").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mix": op1_mix,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_metric_join": op4_metric_join,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_licences": op9_licences,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.oracle(),
    "op4_metric_join": metric_join.oracle(),
    "op9_licences": licences.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
}
