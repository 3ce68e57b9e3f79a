"""The stages of the corpus pipeline: each takes documents and gives back documents, the last one their ids.

Every stage works on all rows its predecessor kept, and returns the columns of the documents as they came (``n_chars`` follows the text).
Rows with a null doc_id or text are judged like the operators say: without a letter there is no language, so they leave in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.llm import language, mixing, near_texts, pieces, secret_scan
from shoptide.llm.common import fresh

#: Below this share of belief in the best language, a document's language is not known.
LEAST_SCORE = 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language cannot be told."""
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Rows that take no part stay."""
    kept = near_texts.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    part = docs.where("doc_id is not null and text is not null")
    text, = fresh(docs, "text_hash")
    once = part.withColumn(text, F.xxhash64("text")).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", text])
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null or text is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    spans, = fresh(docs, "secrets")
    found = secret_scan.scan(docs, spans=spans)
    clean = secret_scan.redacted(F.col("text"), F.col(spans))
    changed = {"text": clean, **({"n_chars": F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
                                 if "n_chars" in docs.columns else {})}
    return found.withColumns(changed).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every document, and ``exact``: whether decoding gives its text again."""
    kept = docs.select("doc_id", "lang", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    found = pieces.round_trip(kept, tokenizer_path())
    return found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.xxhash64("decoded") == F.col("_text")).alias("exact"))
