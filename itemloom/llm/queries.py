"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from itemloom.llm import conversations, encoding, identifiers, jaccard, kdtree, merkle, mixing, rabit, secrets, suffixes, tokenfiles, toxicity, urls
from itemloom.llm.shared import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The byte-level vocabulary that the encoding queries use.
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_bpe_encoding")
def bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: token count and digests of ids and text."""
    return encoding.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digests=True)


@query("op8_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to flat files in doc_id order, and what the files say of it."""
    folder = scratch(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder)
    return tokenfiles.read(spark, folder)


@query("op7_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from the labels outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


@query("op2_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op4_secret_scan", secrets.ORACLE)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once, through a ledger of its own."""
    return secrets.scan(table(spark, sf_dir, "documents"), scratch(spark, "secret-ledger"))


@query("op9_exact_top_k", kdtree.ORACLE)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by integer inner product of every hundredth vector."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


@query("op10_embedding_near_dedup", rabit.ORACLE)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return rabit.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_ngram_jaccard", jaccard.ORACLE)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingles have a Jaccard similarity of 0.9."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


@query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start anywhere else too."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_url_filters", urls.ORACLE)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the dated list entries active on the day it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(urls.page_captures(pages), urls.page_list(pages))


@query("op11_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal identifiers in every document, plain and disguised, as spans of its own characters."""
    return identifiers.report(identifiers.identifiers(table(spark, sf_dir, "documents")))


@query("op12_merkle_manifest", merkle.ORACLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the manifest, its proof, and whether its row, tampered or not, leads to the root."""
    return merkle.tampered_audit(table(spark, sf_dir, "documents"), scratch(spark, "merkle"))


@query("op13_conversation_repair", conversations.ORACLE)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: its faults and the cheapest edits that repair it."""
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
