"""The numbered queries with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.llm import (
    binary_packing,
    line_dedup,
    multi_index,
    pii_boosting,
    poly_exact,
    prefix_trie,
    qda_quality,
    recurrent_lm,
    reply_trees,
    simhash_index,
    templates,
    token_alignment,
    token_secrets,
)
from procsift.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.scored(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def span_digests(rows: DataFrame, *counted: str) -> DataFrame:
    """doc_id, a count for each kind of ``base``, the digest of ``base``, all ``spans``."""
    return rows.select(
        "doc_id",
        *[F.size(F.filter("base", _of(kind))).cast("bigint").alias(f"n_{kind}") for kind in counted],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("assign", "access", "hex")
    rows = token_secrets.scan(table(spark, sf_dir, "documents"))
    return span_digests(
        rows.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*kinds))), *kinds
    )


def op6_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(pii_boosting.find(table(spark, sf_dir, "documents")), *pii_boosting.KINDS)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_index.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poly_exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.packing_list(table(spark, sf_dir, "documents"))


#: The text of both turns of the conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    formatted = reply_trees.format_trees(reply_trees.linear_trees(rows))
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        reply_trees.read_turns(F.col("formatted")).alias("turns"),
        reply_trees.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_pii_boosting": op6_pii_boosting,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_multi_index": op11_multi_index,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}
