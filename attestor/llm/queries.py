"""The registered corpus queries: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import ann, chat, fingerprints, jaccard, langid, mixing, packing, pii, quantizer, sentencepieces, spelling, tokencounts, toxicity
from attestor.llm.session import read
from attestor.llm.vocabulary import Vocabulary

#: The public tokenizers that op5 and op6, and op11, take; parameters of the operators.
MODEL, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_all(spark, read(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(read(spark, sf_dir, "documents"))


def vocabulary(name: str = MODEL) -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read(spark, sf_dir, "documents"), vocabulary())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_to_every_fiftieth(read(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer.compress(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_fingerprints, op2_chat_format, op3_mixing, op4_personal_data, op5_sentencepiece, op6_token_counts, op7_toxicity, op8_jaccard_join, op9_nearest, op10_language_id, op11_packing, op12_spelling, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op12_spelling": spelling.ORACLE, "op13_vector_codes": quantizer.ORACLE}
