"""The corpus pipeline: language ID, near duplicates, personal data, packing.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a table. All but the last keep the columns of
documents. Language ID drops what it rejects: texts without a letter and those whose margin is narrow. Of each component
of near duplicates the document with the smallest doc_id stays. Personal data is replaced by its kind, and n_chars is
counted anew. Packing puts what is left into sequences.

Null and empty texts, and those without a letter, go in the first stage, as no language is theirs. Repeated rows are near
duplicates: one stays, the one of least doc_id; rows without doc_id give way to one that has one, and one of several stays
where none has. Columns beyond those of documents, whatever their names, travel through the first three stages unchanged
(lang_pred, score, rejected and the like among them); packing returns its own columns. Very long texts are read whole in
every stage. An empty table, or one of which nothing is left, gives empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.llm import fasttok, jaccard, langid, packing, pii
from larkspire.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, fasttok.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
