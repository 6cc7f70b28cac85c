"""The document operators over the ``documents`` table as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import alignment, bpe, decontamination, langid, lm_scoring, ngram_join, pii, prefix_trie, quality, secret_scan, substring_dedup, suffix_dedup, token_files
from tidegrid.llm.common import digest, spans_text
from tidegrid.session import new_folder


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.dedup(documents(spark, folder))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(documents(spark, folder), decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder)).drop("rejected_by")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: ~s["added"])
    return pii.find(docs, pii.fit(docs)).select(
        "doc_id",
        *[count_kind(base, k) for k in pii.KINDS],
        digest(spans_text(base)).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.dedup(documents(spark, folder))
    return cut.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return secret_scan.scan(documents(spark, folder)).select(
        "doc_id",
        *[count_kind(spans, k) for k in ("assign", "access", "hex")],
        digest(spans_text(base)).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "token-files")
    token_files.write(documents(spark, folder), target)
    return token_files.read(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_counts(documents(spark, folder))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_trie.trie(prefix_trie.share_openings(prefix_trie.paths(conversations)))


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(documents(spark, folder))


NAMED = (
    *(op1_decontamination, op2_suffixes, op3_bpe, op4_language, op5_quality, op6_pii, op7_ngram_join, op8_substrings),
    *(op9_secrets, op10_token_files, op11_alignment, op12_prefix_trie, op13_lm_scoring),
)
QUERIES = {f.__name__: f for f in NAMED}
SQL: dict[str, str] = {}
