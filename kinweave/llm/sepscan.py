"""Token counts of documents by a separator scan of flat token files without an index.

A flat file is a row of blocks of ids with an end id after each document and nothing that says where documents are.
Each block is searched at once in numpy, in whichever task reads it. A document may lie across any number of blocks:
a prefix scan over one summary row per block (ids, separators, ids after the last separator) gives what each block's
first separator has to add, and the number of documents before it.

Defined cases: a document without ids counts 0; ids after the last separator of a file are a document with
terminated = false; an empty file has no document. Blocks may have any length, also 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.tokens import byte_ranks, slices, small_batches, vocabulary_path

BLOCK = 1 << 18
_FLAT = "file int, block int, ids binary, first_doc long, doc_ids array<long>"


def write_flat(docs: DataFrame, end_id: int, vocabulary: str | None = None, width: str = "<u2", block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Flat token files, one for each partition: file, block, ids. The roster of document ids (first_doc, doc_ids) holds their order only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding("kinweave", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")), special_tokens={})
        file, number, held, size, first, roster, end = TaskContext.get().partitionId(), 0, [], 0, 0, [], np.array([end_id], width)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size, first, roster
            ids = np.concatenate(held) if held else np.zeros(0, width)
            for a in range(0, len(ids) if last else len(ids) // block * block, block):
                part = ids[a : a + block]
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([roster], pa.list_(pa.int64()))], ["file", "block", "ids", "first_doc", "doc_ids"])
                number, first, roster = number + 1, first + len(roster), []
            rest = ids[len(ids) // block * block :]
            held, size = [rest], len(rest)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                for key, t in zip(keys[a:b], texts[a:b]):
                    found = np.array(encoding.encode_ordinary(t), dtype=width)
                    held += [found, end]
                    size += len(found) + 1
                    roster.append(key)
                    if size >= block:
                        yield from flush(False)
        yield from flush(True)

    return small_batches(docs).select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _FLAT)


def _scan(end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype=width)
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "size", "ends"])

    return run


def scan_separators(blocks: DataFrame, end_id: int, width: str = "<u2") -> DataFrame:
    """A row per document of flat files (columns file, block, ids): file, nth, start, n_tokens, terminated."""
    scanned = blocks.select(F.col("file").cast("int"), F.col("block").cast("int"), F.coalesce("ids", F.lit(bytearray())).cast("binary").alias("ids")).mapInArrow(_scan(end_id, width), "file int, block int, size long, ends array<long>")
    # the scan over blocks runs file by file over one short row a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = scanned.select("file", "block", "size", "ends", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    stitched = base.withColumn("last", last).select(
        "file", "block", "ends", "base", "size",
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("docs"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    tail = F.col("final") & (F.coalesce(F.col("base") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1), F.col("previous")) < F.col("base") + F.col("size") - 1)
    stops = F.concat(F.transform("ends", lambda e: e + F.col("base")), F.when(tail, F.array(F.col("base") + F.col("size"))).otherwise(F.array().cast("array<long>")))
    rows = stitched.select("file", "docs", "previous", stops.alias("stops"), F.size("ends").alias("n")).select("file", "docs", "previous", "stops", "n", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.try_element_at("stops", F.col("k"))) + 1
    return rows.select("file", (F.col("docs") + F.col("k")).alias("nth"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("n")).alias("terminated"))


def roster(blocks: DataFrame) -> DataFrame:
    """file, nth, doc_id of the documents in the files that `write_flat` made."""
    return blocks.select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first_doc") + F.col("k")).alias("nth"), "doc_id")
