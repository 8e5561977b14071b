"""The operators of this subpackage applied to the standard tables, with their SQL where there is any."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard, language, lm, manifest, neardup, packing, resampling, sharding, topk, toxicity, urls
from .oracles import manifest_sql, near_copies_sql, resampling_sql

TOXIC_AT = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_conversations(turns.unionByName(extra))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turns_of = [chat.read_back(f) for f in pdf["formatted"]]
            loss = [chat.loss_text(f, a, b) for f, a, b in zip(pdf["formatted"], pdf["loss_starts"], pdf["loss_ends"], strict=True)]
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"],
                    "n_turns": [len(t) for t in turns_of],
                    "turns_sha256": [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest() for x in turns_of],
                    "loss_chars": [len(x) for x in loss],
                    "loss_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in loss],
                    "formatted_chars": [len(f) for f in pdf["formatted"]],
                }
            )

    return formatted.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    docs = table(spark, sf_dir, "documents")
    return language.train(docs.filter(~language.held_out(F.col("doc_id"), 3, 1)).select("text", "lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = language.with_language(docs, language_model(spark, sf_dir))
    return judged.select("doc_id", language.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    labels = table(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
    return toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", F.col("mean_log_prob").alias("score"), "n_words", "log_prob")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs = table(spark, sf_dir, "documents").withColumn("hit", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    docs = docs.withColumn("lowered", F.when(F.col("hit"), F.translate("text", capitals, capitals.lower())))  # a column of its own, so worked out once
    tampered = F.when(F.col("hit"), manifest.leaf_digest([F.col("lowered" if c == "text" else c) for c in manifest.COLUMNS]))
    proofs = manifest.build(docs, claims={"tampered": tampered}).proofs()
    folded = manifest.fold(F.coalesce("claim_tampered", "digest"), F.col("path"))
    out = proofs.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing, op2_decontamination, op3_jaccard_join, op4_url_filters, op5_chat_formatting, op6_language_id, op7_toxicity, op8_lm_scoring, op9_sharding, op10_topk_search,
        op11_merkle_manifest, op12_importance_resampling, op13_embedding_neardup,
    ]
    return {f.__name__: f for f in found}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_topk_search": TOPK_SQL, "op11_merkle_manifest": manifest_sql(), "op12_importance_resampling": resampling_sql(), "op13_embedding_neardup": near_copies_sql()}
