"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.tables import table

SHARDS = 40


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in 40 shards whose row counts are at most one apart; a digest of the sharded rows."""
    from kinweave.llm.sharding import shuffle_into_shards
    from kinweave.llm.tokens import free_name
    from kinweave.staging import stage

    docs = table(spark, sf_dir, "documents")
    # written, so that every column of a row reaches its shard and not only those of the digest
    sharded, _ = stage(shuffle_into_shards(docs, SHARDS), "sharded")
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(utf8) + 16).cast("bigint").alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("rows").alias("law"), F.col(free_name(docs, "shard")).alias("shard"), F.col(free_name(docs, "slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents stay when of equal texts the one with the largest doc_id stays."""
    from kinweave.llm.bloomdedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op2_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a content-addressed store and read back from its files."""
    from kinweave.llm.chunkstore import new_store_path, read_store, write_store

    path = new_store_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path).drop("ids")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; the smallest doc_id of a class stays."""
    from kinweave.llm.dartminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in it, and how many of each kind."""
    from kinweave.llm.surrogates import replace_personal_data, session_key

    done = replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("replaced")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return done.select("doc_id", "text", kinds.alias("replaced"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    from kinweave.llm.dimscan import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    from kinweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files that hold no index."""
    from kinweave.llm.sepscan import roster, scan_separators, write_flat
    from kinweave.staging import stage

    end_id = 50256
    flat, _ = stage(write_flat(table(spark, sf_dir, "documents"), end_id), "flat")
    return scan_separators(flat, end_id).join(roster(flat), ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens", "terminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them, by id, is held out of training."""
    from kinweave.llm.langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level BPE and decoded again."""
    from kinweave.llm.bytebpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_shards, op2_chunk_store, op3_near_dedup, op4_surrogates, op5_nearest, op6_best_fit_packing, op7_exact_dedup, op8_token_counts, op9_language_id, op10_byte_bpe)}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
}
