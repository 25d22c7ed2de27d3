"""The registered queries of this subpackage: one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontaminate, jaccard, lines, nearest, phrases, pieces, secrets, spelling, suffix_tree_lm, token_store, toxicity, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.lm_scores(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(marked).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "neighbours", "cosines")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_read(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 50 == 0))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pieces, op2_suffix_tree_lm, op3_line_dedup, op4_decontaminate, op5_toxicity, op6_jaccard, op7_token_store, op8_warc, op9_secrets, op10_bm25, op11_nearest, op12_phrases, op13_spelling)}


#: SHA-1 in base 32 from its hexadecimal digits: five bits from two neighbouring ones.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((
    (strpos('0123456789abcdef', substr(d, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(d, 2 + (5 * i) // 4, 1)) - 1)
    >> (3 - (5 * i) % 4)) & 31))::INT, 1)), '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
                 m AS (SELECT d, max(page_id) AS f FROM p GROUP BY d)
            SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                   CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
            FROM p JOIN m USING (d)""",
    }
