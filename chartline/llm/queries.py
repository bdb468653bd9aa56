"""One query for each operator, with production parameters on its whole table, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartline.llm import (
    chat_format, decontaminate, html_text, jaccard_join, language_id, line_dedup, piece_codec, secret_scan,
    spot_signatures, sql, token_alignment, token_shards, url_filter, word_runs,
)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer(name: str) -> str:
    """A tokenizer file; it lies at the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return tokenizer("piece_bpe_32k.model")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents", "doc_id", "text"), piece_model())


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "copy_id", "n_links", "n_copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    fitted = language_id.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text", "held_out"), fitted)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return token_alignment.align(docs, tokenizer("byte_bpe_50k.json"), piece_model()).select("doc_id", "alignment.*")


def op13_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.query(spark, sf_dir, tokenizer("word_bpe_49k.json"))


QUERIES = {
    "op1_chat_formatting": chat_format.query,
    "op2_secret_scans": secret_scan.query,
    "op3_url_filters": url_filter.query,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_extraction": op6_html_extraction,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_dedup": line_dedup.query,
    "op9_document_fingerprints": spot_signatures.query,
    "op10_language_id": op10_language_id,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_periodic_runs": word_runs.query,
    "op13_token_id_output": op13_token_id_output,
}

ORACLE = {
    "op1_chat_formatting": chat_format.SQL,
    "op4_benchmark_decontamination": sql.DECONTAMINATION,
    "op7_ngram_jaccard_join": sql.JACCARD,
    "op8_line_dedup": line_dedup.SQL,
}
