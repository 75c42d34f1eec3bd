"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspire.llm import extract, fasttok, fim, fingerprint, importance, jaccard, knn, langid, packing, pii, quality, subword, tokenfile, warc
from larkspire.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.digest(table(spark, sf_dir, "embeddings"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(table(spark, sf_dir, "documents"), fasttok.vocabulary("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), fasttok.vocabulary("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.samples(table(spark, sf_dir, "documents"), fasttok.vocabulary("piece_bpe_32k.model"), packed=True)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_knn, op3_tokens, op4_packing, op5_warc, op6_fingerprint, op7_extract, op8_jaccard, op9_langid, op10_sentencepiece, op11_fim, op12_importance, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_knn": knn.ORACLE, "op5_warc": warc.ORACLE, "op11_fim": fim.ORACLE, "op12_importance": importance.ORACLE}
