"""From raw documents to token ids in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontamination, langid, ngram_join, pii
from tidegrid.session import new_folder

LEAST_SCORE = 0.4


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named c0, c1, ..., which no operator uses, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: not ``und``, and a score of LEAST_SCORE at least.

    The model learns from the labelled documents that are not held out; where none are labelled every text with a
    letter stays.  NULL and empty texts go; repeated rows stay; other columns pass through, whatever their names.
    """
    model = langid.fit(docs.filter(~langid.held_out()))
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows, names = _numbered(docs)
    others = tuple(new for old, new in names.items() if old != "doc_id")
    judged = langid.predict(rows, model, id_col=names["doc_id"], text_col=names["text"], keep=others)
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows with equal id and text one.

    Texts without a word are in no group and stay.  Other columns pass through, whatever their names.
    """
    classes = ngram_join.join(docs, n=5, percent=80)
    stays = classes.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    rows, names = _numbered(docs)
    left = rows.join(stays, F.col(names["doc_id"]).eqNullSafe(F.col("stays")), "left_semi")
    once = left.withColumn("text_hash", F.xxhash64(names["text"])).dropDuplicates([names["doc_id"], "text_hash"])
    return once.select(*[F.col(new).alias(old) for old, new in names.items()])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all columns and rows of the others, NULL and empty texts included."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove(docs, decontamination.find(docs, benchmark))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars``, if there is one, follows the new text (NULL: NULL)."""
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: token ids of every document, and the digest of their decoded text; NULL is empty."""
    return bpe.encode(docs, decoded=True).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("tokens", tokenize),
]

ORACLE_SQL = None  # trained models and a tokenizer are beyond SQL; tests compare with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        target = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return docs
