"""The corpus pipeline: labelled documents in, encoded documents of the training mix out.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before has kept. All but
the last return the columns of documents.

* quality: documents that the classifier rejects go.
* near_duplicates: of each group of documents that close fingerprints link, the row with the smallest id stays.
* secrets: the spans found are replaced by their kind; no document goes.
* mixing: every source is brought to its target by repeating or leaving out documents, and the
  rows are sorted into training order.
* tokens: every row is encoded.

Defined cases: null texts are empty texts; a row without id is never a copy of another one that is dropped, and
the mix takes it like any other; extra columns are not handed on; an empty table stays empty. Of equal rows with
one id one stays. Different texts under one id are decided each for itself; if their fingerprints are linked, or
rows differ in another column only, the row with the least hash stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.llm import mixing, quality, secrets, sentencepiece, simhash
from leadweave.llm.common import table
from leadweave.session import settle

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3
# Words in a shingle, and the bits in which the fingerprints of near copies may differ.
SHINGLE, DISTANCE = 3, 2
PIECE_MODEL = "piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    kept = docs.select(*DOCUMENT)
    return kept if model is None else kept.where(model.score(quality.statistics(F.col("text"))) >= LEAST_SCORE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, DOCUMENT, width=SHINGLE, distance=DISTANCE)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = docs.select(*DOCUMENT, secrets.secret_spans(F.col("text")).alias("spans"))
    clean = found.withColumn("clean", secrets.redacted(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", length.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*DOCUMENT))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece.encode_rows(docs, public_tokenizers.path(PIECE_MODEL), ("doc_id", "source"))
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", encoded),
]

# The classifier, the fingerprints and the encoder cannot be put in SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
