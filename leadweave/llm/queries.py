"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadweave.llm import (
    embed_dedup, language, lexical, mixing, quality, secrets, sentencepiece, simhash, spelling, substring, token_store, topk, url_rules,
)
from leadweave.llm.common import table
from leadweave.llm.sql import ORACLE_SQL  # noqa: F401  registered beside the queries
from leadweave.session import shared_path

# Fixed values of the contract: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


# Models and vocabularies are read where they lie on every worker.
PIECE_MODEL, BYTE_VOCABULARY, END_ID = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", 50256


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = sentencepiece.encode_rows(documents, public_tokenizers.path(PIECE_MODEL), decode=True)
    joined = lambda numbers: F.array_join(F.col(numbers).cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("starts", "ends").alias("spans_hash"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"))
    # In training order, by the first position of a document; those not taken come last.
    first = F.get("copies", F.lit(0))["position"]
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"),
        F.size("copies").alias("n_copies"), first.alias("position"),
    ).repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), F.xxhash64("doc_id")
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the shards, as read back from them."""
    folder = shared_path(spark, "shards")
    n = token_store.write_shards(
        table(spark, sf_dir, "documents"), folder,
        public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, END_ID,
    )
    if not n:
        return spark.createDataFrame([], "slot long, shard long, n_ids long, ids_sha256 string")
    slots = token_store.read_slots(spark, folder)
    return slots.select("slot", "shard", (F.octet_length("tokens") / 2).cast("long").alias("n_ids"), F.sha2("tokens", 256).alias("ids_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = documents.select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    kinds = [r.kind for r in secrets.BASE]
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(of(*kinds)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(
        table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identified(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_token_store": op3_token_store,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash": op6_simhash,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_rules": op10_url_rules,
    "op11_language_id": op11_language_id,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}
