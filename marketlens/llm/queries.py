"""Registered queries of the operators: name -> callable(spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gif, hnsw, htmlmain, langid, mixing, packing, pieces, quality, simhash, spelling, tokencount, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out rows never reach training."""
    return langid.predict_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: the highest score over all windows of its whole text."""
    return toxicity.predict_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; held-out rows never reach training."""
    return quality.predict_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an animated GIF and read back."""
    return gif.digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False)


@query
def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 90 % of the largest entropy over sources, at most two epochs."""
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


TWINS["op4_temperature_mixing"] = mixing.TWIN
TWINS["op8_hnsw_dedup"] = hnsw.TWIN


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokencount.count_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmlmain.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98 within their label."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-piece ids and decoded text of every document, as digests."""
    return pieces.digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with its subtree sums."""
    return trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


TWINS["op12_conversation_trie"] = trie.TWIN


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, dominant forms and roots."""
    return spelling.group_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


TWINS["op11_spelling_variants"] = spelling.TWIN
