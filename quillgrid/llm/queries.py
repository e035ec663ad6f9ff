"""The queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, packing, pii, quality, repeats, simhash, spans, warc
from .common import table
from .oracles import ORACLES


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by automata learnt from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~out))
    return docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), langid.identify(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and the least id that links of up to four bits reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a media file and read back."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", media.round_trip(F.col("text")).alias("m")).select("doc_id", "m.*")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 400-byte strings that also start elsewhere."""
    found = repeats.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every text, whether it fails the base rule, whether it is kept, and the rule that rejects it."""
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the sentences of repeated passages but the first, and the ids that have these."""
    found = spans.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("kept"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_sentences", "n_removed", "n_spans", kept.alias("kept_sha256"), "first_ids")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every text and the terms that reveal it, by place."""
    found = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.array_sort(F.concat("base", "more"))).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    found = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives tell it that were written and read back."""
    found = warc.deduplicated(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
