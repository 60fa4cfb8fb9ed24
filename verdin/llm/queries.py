"""The ``opN_<name>`` queries: each binds an operator to its whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.llm import (align, bpe_duck, chat_format, decontaminate, langid, lattice_lm, quality_qda, quality_rules, simhash_bk,
                        suffix_dedup, token_store, trigram_secrets, whitening)
from verdin.llm.common import documents, remainder, stored

QUERIES: dict = {}
ORACLE: dict = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance): every benchmark item that is in a document within 8 edits in 100."""
    found = decontaminate.matches(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.item").alias("item_id"), F.col("f.distance").alias("distance"))


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, from a network trained on ids whose remainder by 4 is not 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs, remainder("i", 4) != 2)
    out = langid.predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from the labels of ids whose remainder by 5 is not 0."""
    out = quality_qda.classify(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"),
                               remainder("doc_id", 5) != 0)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the verdict of policy v2."""
    book = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base = ~quality_rules.passes("base")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       quality_rules.passes("v2").alias("kept"), "fail_bits")


ORACLE["op4_quality_rules"] = quality_rules.ORACLE


@register
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word unigram and subword lattice scores of every document, learned from ids whose remainder by 7 is not 2."""
    out = lattice_lm.score(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"),
                           remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", remainder("doc_id", 7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in token-store segments, read back."""
    path = token_store.store_path(spark, "tokens")
    token_store.write_store(documents(spark, sf_dir).select("doc_id", "text"),
                            public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    return token_store.read_store(spark, path)


@register
def op7_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of all documents."""
    return bpe_duck.encode_decode(documents(spark, sf_dir).select("doc_id", "text"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    rules = trigram_secrets.BASE + trigram_secrets.MORE
    found = trigram_secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"), rules)
    base = F.filter("spans", lambda s: s["k"] < len(trigram_secrets.BASE))

    def number(k):   # a second argument of the function would be the place of the span
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{r.kind}") for k, r in enumerate(trigram_secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(trigram_secrets.named(base, rules), 256).alias("base_sha256"),
                        trigram_secrets.named(F.col("spans"), rules).alias("spans"))


@register
def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash_bk.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that remain of every document without its repeated 400-byte strings."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), 400)


@register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted and masked text."""
    chats = chat_format.probe(table(spark, sf_dir, "conversations"))
    return chat_format.digests(stored(chat_format.formatted(chats), "chats"))


ORACLE["op12_chat_format"] = chat_format.ORACLE


@register
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the piece tokens of every document."""
    return align.align(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))
