"""The corpus operators as registered queries: each over its whole table, by its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm import (
    bpe,
    compaction,
    decontam,
    html_consensus,
    matroska,
    parity_join,
    qda,
    toxicity,
    url_filter,
    warc,
)
from geoquilt.llm.common import held_out, prepare, table, workspace

#: DuckDB: A-Z to lower case, null to empty.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

Query = Callable[[SparkSession, str], DataFrame]


def op4_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.document_hits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), m AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _judged(docs: DataFrame, folds: int, held: int, score, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", held_out(folds, held).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, folds=4, held=2)
    return _judged(docs, 4, 2, toxicity.score(model, F.col("text")), toxicity.THRESHOLD)


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


#: Arrivals in which op7 appends the documents.
ARRIVALS = 6


def _arrived(spark: SparkSession, sf_dir: str) -> compaction.ShardStore:
    """A store of documents, appended one arrival after the other: by the id's remainder."""
    store = compaction.ShardStore(spark, workspace(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    for i in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)) == i))
    return store


def op7_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _arrived(spark, sf_dir)
    store.compact()
    store.vacuum()
    return store.read()


OP7_SQL = "SELECT * FROM documents"


def shard_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, n_rows, merged) of op7's store: an arrival a version, then the compacted one, in
    which no tier is left that could be merged and fewer shards than arrivals brought."""
    store = _arrived(spark, sf_dir)
    last = store.compact()
    shards = {v: store.shards(v) for v in (*range(1, ARRIVALS + 1), last)}
    done = not compaction.due(shards[last], compaction.TARGET_BYTES) and len(shards[last]) < len(shards[ARRIVALS])
    rows = None
    for nth, v in enumerate(shards, 1):
        one = store.read(v).agg(F.lit(nth).cast("long").alias("version"), F.count("*").alias("n_rows"), F.lit(v > ARRIVALS and done).alias("merged"))
        rows = one if rows is None else rows.union(one)
    return rows


SHARD_VERSIONS_SQL = f"""
SELECT version::BIGINT AS version, (SELECT count(*) FROM documents WHERE coalesce(doc_id, 0) % {ARRIVALS} < version) AS n_rows,
  version > {ARRIVALS} AS merged FROM range(1, {ARRIVALS + 2}) t(version)
"""


def op8_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = qda.train(docs, labels, folds=5, held=0)
    return _judged(docs, 5, 0, qda.score(model, F.col("text")), qda.THRESHOLD)


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode_documents(
        spark,
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ["doc_id"],
        with_ids=False,
    )


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, ["page_id"], URL_RULES, url_filter.fit(url_filter.SEED_URLS))


def op2_matroska_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return matroska.stored_texts(spark, table(spark, sf_dir, "documents"), ["doc_id"])


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return parity_join.near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM d
  UNION
  SELECT reach.u, linked.v FROM reach JOIN linked ON linked.u = reach.v
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id
"""


def op10_consensus_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_consensus.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_url_filter,
        op2_matroska_payloads,
        op3_parity_sketch_join,
        op4_positional_index_decontamination,
        op5_counterfactual_toxicity,
        op6_warc_normaliser,
        op7_size_tiered_compaction,
        op8_quadratic_discriminant,
        op9_byte_level_bpe,
        op10_consensus_html_extraction,
        shard_versions,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_parity_sketch_join": OP3_SQL,
        "op4_positional_index_decontamination": OP4_SQL,
        "op7_size_tiered_compaction": OP7_SQL,
        "shard_versions": SHARD_VERSIONS_SQL,
    }
