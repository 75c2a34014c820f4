"""Registered queries of the pipeline operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_middle, language_model, near_duplicates, packing, pii, quality, secrets, token_files, top_k, toxicity, variants
from .storage import scratch_path

CHECK_KEY = b"a key for checks, known to every reader"
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.pseudonymize(documents(spark, sf_dir), CHECK_KEY))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, sf_dir)).drop("fp")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search_all(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("text_key")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(WORD_BPE), cache_pieces=1_500_000, keep_cache=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, tokenizer_path(BYTE_BPE), alphabet=50257, cache_pieces=1_000_000, keep_cache=True)
    rows = token_files.with_starts(token_files.read_tokens(spark, path), path)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(documents(spark, sf_dir), typo_every=31)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(documents(spark, sf_dir)))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_pii, op3_near_duplicates, op4_top_k, op5_line_quality, op6_packing, op7_token_files, op8_language_model, op9_secrets, op10_toxicity,
                                    op11_spelling_variants, op12_fill_middle, op13_decontamination)}
ORACLES: dict[str, str] = {"op4_top_k": OP4_SQL, "op5_line_quality": quality.oracle(), "op12_fill_middle": fill_middle.oracle(), "op13_decontamination": decontaminate.oracle()}
