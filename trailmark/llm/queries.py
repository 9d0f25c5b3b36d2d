"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    from trailmark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path=None if tokenizer_path else public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.exact_dedup import exact_dedup

    found = exact_dedup(table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages")).drop("score")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.pii import KINDS, as_text, find

    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_mixing, op4_packing, op5_exact_dedup, op6_url_filter, op7_personal_data, op8_near_dedup, op9_nearest_neighbours, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL}
