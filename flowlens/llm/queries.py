"""The registered ``opN_*`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest_index, filter_audit, html_extract, line_dedup, lm, mixing, order_minhash, packing, sharding, simhash, token_alignment, topk_search, toxicity
from .common import scratch_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies, by default the byte-level one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.valid_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=True)


def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed_lines", F.lit(0), lambda n, s: n + s["stop"] - s["first"])
    return cut.select("doc_id", "text", removed.cast("long").alias("n_removed"), "removed_lines")


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_chain(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.dedup_batches(table(spark, sf_dir, "documents"), scratch_path(spark, "digest-index"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nra_topk": op1_nra_topk,
    "op2_entropy_mixing": op2_entropy_mixing,
    "op3_bin_completion": op3_bin_completion,
    "op4_wrapper_extraction": op4_wrapper_extraction,
    "op5_line_runs": op5_line_runs,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_external_shuffle": op7_external_shuffle,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_backoff_automaton": op9_backoff_automaton,
    "op10_order_minhash": op10_order_minhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_digest_index": op13_digest_index,
}

ORACLE_SQL: dict[str, str] = {
    "op1_nra_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op12_filter_audit": filter_audit.SQL,
    "op13_digest_index": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
""",
}
