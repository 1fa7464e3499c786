"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paritas.llm import bpe, collocations, conversations, decontaminate, jaccard, license, mixing, neardup, quality, secrets, sharding, tokens, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """The vocabulary file of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def queries() -> dict:
    return {
        "op1_mixing": lambda s, d: mixing.mix_report(_docs(s, d)),
        "op2_byte_bpe": lambda s, d: bpe.encode_digests(_docs(s, d), vocabulary()),
        "op3_near_dedup": lambda s, d: neardup.near_duplicates(s.read.parquet(f"{d}/embeddings.parquet")),
        "op4_toxicity": lambda s, d: toxicity.score_toxicity(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op5_ngram_jaccard": lambda s, d: jaccard.similar_documents(_docs(s, d)),
        "op6_sharding": lambda s, d: sharding.shard_documents(_docs(s, d)),
        "op7_token_counts": lambda s, d: tokens.token_report(_docs(s, d), vocabulary()),
        "op8_license_scan": lambda s, d: license.scan_licenses(_docs(s, d)),
        "op9_quality_rules": lambda s, d: quality.score_quality(_docs(s, d)),
        "op10_secret_scan": lambda s, d: secrets.secret_digests(_docs(s, d)),
        "op11_collocations": lambda s, d: collocations.mine_collocations(_docs(s, d)),
        "op12_conversation_repair": lambda s, d: conversations.repair_damaged(s.read.parquet(f"{d}/conversations.parquet")),
        "op13_decontamination": lambda s, d: decontaminate.decontaminate(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": license.oracle(), "op9_quality_rules": quality.ORACLE, "op11_collocations": collocations.ORACLE, "op12_conversation_repair": conversations.ORACLE, "op13_decontamination": decontaminate.ORACLE}
