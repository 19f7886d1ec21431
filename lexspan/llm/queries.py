"""The registered queries of this subpackage; their SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents
from .conversations import repair_damaged
from .divergence import audit_sources
from .exact import exact_groups
from .html_text import extract
from .lines import dedup_lines
from .mixing import mix_sources
from .packing import pack
from .repetition import repetition_rules
from .simhash import near_groups
from .tokencounts import count_tokens
from .tokenfiles import read_tokens, with_starts, write_tokens
from .toxicity import fit, held_out, score
from .warc import read_warc, write_warc


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token-files")
    write_tokens(documents(spark, sf_dir), f"{ws.path}/files", vocabulary("word_bpe_49k.json"), end_id=2)
    back = ws.stage(read_tokens(spark, f"{ws.path}/files"), "read")
    return with_starts(back).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("row.doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{Workspace(spark, 'archive').path}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read_warc(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), limit=512)
    return counted.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_repetition, op4_pack, op5_mix, op6_simhash, op7_line_dedup, op8_exact_dedup, op9_html, op10_warc, op11_divergence, op12_conversation_repair, op13_token_counts)}
