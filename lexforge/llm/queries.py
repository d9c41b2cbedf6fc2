"""The registered query of each operator: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import balltree, decontamination, factorisation, jaccard, media, packing, quality, resampling, secrets, sentencepiece, substring, tokencount, warc
from lexforge.llm.common import shared_dir, table
from lexforge.llm.sql import ORACLES

#: The tokenizer files' folder; None: that of the installed package.
TOKENIZERS = None
TOKEN_LIMIT = 2048

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A tokenizer file's path, the same on all machines."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame) -> DataFrame:
    """docs in batches, with the ids of the 50,256-token byte vocabulary."""
    import public_tokenizers

    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(warc.load(spark, path), payloads=False).filter("record_type is not null")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.kept(media.store(table(spark, sf_dir, "documents")))).withColumnRenamed("key", "doc_id")


def op3_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("key", "doc_id")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op5_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op6_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), TOKEN_LIMIT).withColumnRenamed("key", "doc_id")


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.getField("k")), x.getField("start").cast("string"), x.getField("end").cast("string"))), ",")
    base = F.filter(F.col("spans"), lambda x: x.getField("k") < len(secrets.BASE))
    count = lambda k: F.size(F.filter(F.col("spans"), lambda x: x.getField("k") == k)).cast("long").alias(f"n_{secrets.RULES[k].kind}")
    return found.select(F.col("key").alias("doc_id"), *map(count, range(len(secrets.BASE))), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return balltree.mine(moved, F.col("key") % 50 == 0)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_salvage, op2_telephony_audio, op3_sentencepiece_prefix_table, op4_quality_cascade, op5_recompression_dedup, op6_whole_token_counts, op7_chosen_path_join,
        op8_length_buckets, op9_factorisation_machine, op10_secret_spans, op11_hard_negatives, op12_benchmark_decontamination, op13_importance_resampling,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
