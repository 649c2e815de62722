"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import (
    chat, decontaminate, html_extract, mixing, pii, pivot_index, prefix_trie, quality, sharding, simhash, token_output, turn_repair,
    url_filter,
)
from flowlab.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


@registered
def op2_systematic_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mixed(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


@registered
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@registered
def op10_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents").select("doc_id", "text"))


@registered
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@registered
def op5_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.found(documents, table(spark, folder, "benchmark"))


@registered
def op6_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, folder, "documents").select("doc_id", "text")
    return token_output.written_and_read(documents, public_tokenizers.path("word_bpe_49k.json"))


@registered
def op3_association_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    # Labels belong to documents; a page shows the document whose number ends its path.
    shown = F.regexp_extract(url_filter.path("url"), "([0-9]{1,18})[^0-9]*$", 1).try_cast("bigint")
    labels = table(spark, folder, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    bad = pages.select("page_id", shown.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return url_filter.judged(pages, bad)


@registered
def op8_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pii.replaced(documents, secret="corpus key")


@registered
def op7_prefix_tree_chat(spark: SparkSession, folder: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_and_read(rows.unionByName(more))


@registered
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@registered
def op1_boosted_dom_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(table(spark, folder, "pages"))


@registered
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    heads = rows.where(conv.isNotNull()).select("conv_id").distinct().select(
        "conv_id", (conv - F.pmod(conv, F.lit(5))).alias("base_id"),
        (F.crc32(conv.cast("string").cast("binary")) % 9).alias("head"),
    )
    return prefix_trie.prefix_trie(rows, heads)


@registered
def op12_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vectors = rows.where(F.col("embedding").isNotNull() & whole).select(
        "vec_id", F.transform(x, lambda v: F.floor(v * 1024.0)).alias("vector")
    )
    return pivot_index.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, stripped of their ends, repeated or given to the user, by a
    checksum of conv_id and turn. Nulls are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = rows.withColumn("_kind", F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).where("_kind != 0")
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), "_kind")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_copy", "_kind")


@registered
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.reports_of_all(rows, damaged(rows))
