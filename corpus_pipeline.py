"""Training-data pipeline over ``documents``: STAGES in order, each written and read again.

1. ``language_id``: documents without a letter go, and those whose text is far
   less likely in the languages found than the training rows are (unlearned
   languages, gibberish); documents in two or more learned languages stay.
2. ``ngram_join``: of each group of near copies the document with the least
   id stays.
3. ``decontaminate``: documents contaminated by benchmark passages go.
4. ``pii``: personal data are replaced by their kinds, terms that reveal
   them generalised or removed; n_chars follows the text.
5. ``byte_bpe``: texts are encoded (token_ids, n_tokens) and the text is
   decoded from the ids again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import byte_bpe, decontaminate, language_id, ngram_join, pii
from tabloom.llm.common import held_out, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, names=("_lang", "_share", "_shares"), evidence_col="_evidence")
    return found.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_evidence") >= 0)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(docs, ranks, pattern, ids_col="token_ids", decoded_col="_decoded")
    return (
        coded.withColumn("text", F.col("_decoded").cast("string")).withColumn("n_tokens", F.size("token_ids").cast("long"))
        .select(*docs.columns, "n_tokens", "token_ids")
    )


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_copy_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
