"""The registered queries of this folder: thin reports over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder
from . import (
    fingerprints,
    maxent,
    ngram_join,
    packing,
    pii,
    prefix_bpe,
    prefix_trie,
    quality,
    secrets,
    substring,
    token_counts,
    token_files,
    whitening,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_documents(_documents(spark, sf))


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edit_and_next(_documents(spark, sf))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    return pii.span_report(pii.with_spans(docs, pii.train_on_corpus(docs)))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    model = quality.train_on_labels(docs, _table(spark, sf, "labels"))
    return quality.quality_verdicts(docs, model)


def op5_substring(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return substring.removal_report(docs, substring.repeat_runs(docs))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.piece_digests(packing.packed_pieces(_documents(spark, sf), vocabulary))


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(_documents(spark, sf), path, vocabulary, end_id=0)
    return token_files.token_file_report(spark, path)


def op8_prefix_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.round_trip(_documents(spark, sf), path, public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_documents(spark, sf), path, public_tokenizers.PATTERN)


def op10_maxent(spark: SparkSession, sf: str) -> DataFrame:
    return maxent.score_documents(_documents(spark, sf))


def op11_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, scratch_folder(spark, "blob-ledger"))
    ledger.scan(docs)
    return secrets.secret_report(ledger.findings(docs))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf, "conversations"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_fingerprints": op2_fingerprints,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_prefix_bpe": op8_prefix_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_maxent": op10_maxent,
    "op11_secrets": op11_secrets,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op11_secrets": secrets.sql(), "op12_prefix_trie": prefix_trie.SQL}
