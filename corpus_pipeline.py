"""The corpus pipeline: documents in, packed training sequences out, one operator of ``trialscope.llm`` per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.llm import language_id, quality
from trialscope.llm.common import stored
from trialscope.llm.minhash import near_duplicates
from trialscope.llm.packing import pack
from trialscope.llm.secrets import redact
from trialscope.session import work_path

#: A document whose best language is less than this ahead of the second one is in none of the learned languages.
LEAST_LANGUAGE_MARGIN = 0.1
#: A document below this quality score goes.
LEAST_QUALITY = 0.5
TOKENIZER = "word_bpe_49k.json"


def _wrapped(docs: DataFrame) -> DataFrame:
    """All columns in one, so that their names cannot clash with an operator's, and the text."""
    return docs.select(F.struct(*docs.columns).alias("document"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has labels for; null and letterless texts go.

    The model is learned from the documents' own labels. Columns stay as they are. Without any labelled
    document nothing can be told, and only documents without a letter go.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(_wrapped(docs), model, ["document"], margin=True)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("margin") >= LEAST_LANGUAGE_MARGIN)).select("document.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from ``labels.quality``, is at least ``LEAST_QUALITY``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.score_quality(_wrapped(docs), model, ["document"]).where(F.col("score") >= LEAST_QUALITY).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The group's least doc_id stays. Repeated rows of one doc_id are one document here and all stay or go.
    Rows without a doc_id stay.
    """
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret and ``n_chars`` of the masked text."""
    masked = redact(docs, work_path(spark, "ledger"))
    changed = F.col("text").contains("[SECRET]") & F.col("n_chars").isNotNull()
    return masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces: their token ids and their place in a sequence of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), ["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Models and sketches are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
