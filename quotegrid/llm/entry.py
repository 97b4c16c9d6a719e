"""The queries of this subpackage, with their production parameters, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, hosts, licenses, mixing, quality, secret_ledger, simhash, substrings, tokenstore, toxicity, whitening
from .common import table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.read_digests(spark, tokenstore.write_store(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.grade(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.SCORE_AT).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.scan_twice(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return hosts.judge(pages, hosts.page_outcomes(pages)).select("page_id", "host", "path", "rule", "verdict")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_probe(chat.canonical(table(spark, sf_dir, "conversations")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_store": op3_token_store,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_chat": op13_chat,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": substrings.SQL,
    "op8_secret_scan": secret_ledger.SQL,
    "op10_url_filter": hosts.SQL,
    "op13_chat": chat.SQL,
}
