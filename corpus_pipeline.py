"""From raw documents to token ids: quality, toxicity, near duplicates, test leaks, encoding.

Each stage takes the documents that the one before kept, written as Parquet and read again, and
all but the last return rows of `documents` unchanged. Rows that repeat a doc_id become one at
the near-duplicate stage; rows without a doc_id are judged by their text at every stage but are
never near duplicates. Null texts count as empty. Columns that documents may have besides its
own pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm import bpe, decontam, parity_join, qda, toxicity
from geoquilt.llm.common import prepare, remove, stored, table

#: No SQL expresses the trained classifiers or the merges of the encoder.
ORACLE_SQL = None

#: Ids up to which a list of documents to drop is broadcast; beyond, Spark joins by shuffle.
BROADCAST_IDS = 2_000_000
#: The columns of documents that the encoded rows keep.
CARRIED = ("doc_id", "lang", "source", "n_chars")


def _without(docs: DataFrame, key, dropped: DataFrame) -> DataFrame:
    """docs but for the keys in dropped (one column, __drop)."""
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(dropped, key == dropped["__drop"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    prepare(spark)
    model = qda.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(qda.score(model, F.col("text")) >= qda.THRESHOLD)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates."""
    prepare(spark)
    groups = parity_join.near_duplicates(spark, docs.select("doc_id", "text"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop"))
    kept = _without(docs, docs["doc_id"], others)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again, _ = stored(spark, repeated.select(F.col("doc_id").alias("__drop")), "repeated")
    if again.isEmpty():
        return kept
    rows = kept.join(again, kept["doc_id"] == again["__drop"], "left_semi")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(every, F.struct(F.xxhash64("text"), F.to_json(every))).alias("__row")
    one = rows.groupBy(F.col("doc_id").alias("__id")).agg(first).select("__row.*")
    return _without(kept, kept["doc_id"], again).unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a test item."""
    prepare(spark)
    key = F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))
    named = docs.select(key.alias("doc_id"), "text")
    hits = decontam.document_hits(spark, named, table(spark, sf_dir, "benchmark"))
    leaks, _ = stored(spark, hits.where("contaminated").select(F.col("doc_id").alias("__drop")).distinct(), "leaks")
    return _without(docs, key, leaks)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256, token_ids)."""
    prepare(spark)
    return bpe.encode_documents(
        spark,
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        [c for c in CARRIED if c in docs.columns],
    )


STAGES = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before:
            remove(spark, before)  # the next stage reads the newer table
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
