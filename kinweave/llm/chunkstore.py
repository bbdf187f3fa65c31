"""A content-addressed store of token streams.

Writing. The documents are dealt by ranges of doc_id and sorted, so that ids are written in ascending doc_id order. Each
task encodes its documents and cuts every id stream where a rolling hash of the last WINDOW ids has its
low bits zero, so that equal passages give equal chunks wherever they stand. A chunk is named by a 128-bit hash of its
bytes. The files of a store, all Parquet:

- `chunks`: each unique chunk once, those of a task in the order of its documents. A chunk that only one place uses also
  names that place.
- `recipes`: by ascending doc_id a row per document: its chunks in order, its place `start` in the stream of all
  ids, its length, and the Merkle root of its chunks.
- `manifest`: for each part of the recipes, in order, the first and last doc_id and the Merkle root of its documents.

Only names shuffle to find repeats: a bounded bit filter of the repeated names lets all other chunks pass straight to
the file, and only the possible repeats are grouped by name.

Reading. Chunks with a place go to it; those used in several places are joined to the recipes by name. Every document
is put together again, its Merkle root is recomputed from the bytes read and must equal the recipe's. Before that the
manifest is made again from the recipes read; a part that is missing, new or different fails.

Defined cases: a null or empty text is its end id alone; equal ids and rows are kept apart by a row number; an empty
table gives an empty store and result; further columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.bloomdedup import bit_filter, filter_bits, marked, position
from kinweave.llm.tokens import hold, slices, small_batches, trim, vocabulary_path, word_encoder
from kinweave.staging import drop_staged, shared_dir, stage

#: Stored bytes of documents in one range, about.
RANGE_BYTES = 16 << 20
WINDOW, SHORTEST, MEAN, LONGEST = 8, 128, 512, 2048
_GEAR = np.array([pow(0x01000193, k, 1 << 32) for k in range(WINDOW)], dtype=np.uint32)
_CUT = "row long, doc_id long, at int, name binary, ids binary, n_tokens long, names array<binary>, root binary"


def _marks(ids: np.ndarray, mean: int) -> np.ndarray:
    """The places behind which the rolling hash of the last WINDOW ids offers a cut."""
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    h = np.zeros(len(ids), dtype=np.uint32)
    for k in range(min(WINDOW, len(ids))):
        h[k:] += mixed[: len(ids) - k] * _GEAR[k]
    h ^= h >> np.uint32(16)
    return np.flatnonzero((h & np.uint32(mean - 1)) == 0) + 1


def _chosen(marks: list[int], n: int, shortest: int, longest: int) -> list[int]:
    """Where the chunks of a stream of `n` ids end, of the places that are offered."""
    if n <= shortest:
        return [n] if n else []
    ends, last = [], 0
    for c in marks:
        if c - last < shortest:
            continue
        while c - last > longest:
            last += longest
            ends.append(last)
        if c - last >= shortest:
            ends.append(c)
            last = c
    while n - last > longest:
        last += longest
        ends.append(last)
    return [*ends, n] if last < n else ends


def cuts(ids: np.ndarray, shortest: int = SHORTEST, mean: int = MEAN, longest: int = LONGEST) -> list[int]:
    """Where the chunks of a stream end. `mean` is a power of two."""
    return _chosen(_marks(ids, mean).tolist() if len(ids) > shortest else [], len(ids), shortest, longest)


def cuts_of_many(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """cuts() of each of the streams that stand one after another in `ids`.

    The hashes of all are made at once: those that reach into the stream before lie within SHORTEST, where none cuts.
    """
    begins, marks = np.concatenate([[0], ends[:-1]]), _marks(ids, MEAN)
    first = np.searchsorted(marks, begins, side="right").tolist()
    marks = marks.tolist()
    found = []
    for begin, end, a, b in zip(begins.tolist(), ends.tolist(), first, [*first[1:], len(marks)]):
        found.append(_chosen([m - begin for m in marks[a:b]], end - begin, SHORTEST, LONGEST))
    return found


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of hashes; an odd node moves up as it is."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cut_documents(docs: DataFrame, vocabulary: str | None, end_id: int, width: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words")
        encoder, row = word_encoder(vocabulary or vocabulary_path("word_bpe_49k.json")), TaskContext.get().partitionId() << 33
        met = set()
        if max(end_id, len(encoder.ends) - 1) > np.iinfo(width).max:
            raise ValueError(f"ids of this vocabulary do not fit {width}")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                out: list[list] = [[] for _ in range(8)]
                ids, until = encoder.encode_flat(texts[a:b])
                ids, until = np.insert(ids, until, end_id), until + np.arange(1, b - a + 1)
                raw, size, begins = ids.astype(width).tobytes(), np.dtype(width).itemsize, [0, *until.tolist()]
                for key, base, last, ends in zip(keys[a:b], begins, begins[1:], cuts_of_many(ids, until)):
                    parts = [raw[size * (base + i) : size * (base + j)] for i, j in zip([0, *ends], ends)]
                    names = [name_of(p) for p in parts]
                    for k, (name, part) in enumerate(zip(names, parts)):
                        # a chunk that the task has met is not sent again; the memory of names is bounded
                        repeat = name in met
                        if not repeat and len(met) < 2_000_000:
                            met.add(name)
                        for column, v in zip(out, (row, key, k, name, None if repeat else part, last - base, names if k == 0 else None, merkle_root(names) if k == 0 else None)):
                            column.append(v)
                    row += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["row", "doc_id", "at", "name", "ids", "n_tokens", "names", "root"])
        trim()

    return small_batches(docs).mapInArrow(run, _CUT)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A manifest row for the part of the recipes that a task holds, in order."""
    roots, first, last, part = [], None, None, None
    for batch in batches:
        if batch.num_rows:
            first, last, part = first if roots else batch.column(1)[0].as_py(), batch.column(1)[-1].as_py(), batch.column(0)[0].as_py()
            roots += batch.column(2).to_pylist()
    if roots:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([len(roots)], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], ["part", "first_doc_id", "last_doc_id", "documents", "root"])


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, width: str = "<u2", text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the documents as a store in the folder `path`. `width` is the numpy type of an id in the files; ids that do not fit it fail."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # equal ids may be many: their texts' lengths and hashes split them
    size, sc = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), docs.sparkSession.sparkContext
    parts = max(4 * sc.defaultParallelism, min(100_000, size // RANGE_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    cut, cut_path = stage(_cut_documents(given.repartitionByRange(parts, *order).sortWithinPartitions(*order), vocabulary, end_id, width), "cut", compression="lz4", dictionary=False)
    bits = filter_bits(cut.count())
    key = F.xxhash64("name")
    # names that stand in more than one place; only names shuffle, combined first
    repeats = cut.groupBy(key.alias("h")).count().where("count > 1").select(position(F.col("h"), bits).alias("pos"))
    spark, filter_path = docs.sparkSession, None
    pieces, filter_path = stage(bit_filter(repeats, bits), "repeats")
    # evaluated once, as a bounded array of bits
    shared = marked(pieces.select("pieces").scalar(), position(key, bits))
    sent = cut.where("ids IS NOT NULL").select("row", "at", "name", "ids", shared.alias("shared"))
    alone = sent.where("NOT shared").select("name", "row", "at", "ids")
    several = sent.where("shared").groupBy("name").agg(F.first("ids").alias("ids")).select("name", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("at"), "ids")
    alone.unionByName(several).write.option("compression", "zstd").option("parquet.enable.dictionary", False).parquet(f"{path}/chunks")

    # rows ascend with doc_id: the upper bits are the range
    ranged = cut.where("at = 0").select(F.shiftright("row", 33).cast("int").alias("part"), "doc_id", "row", "n_tokens", "names", "root")
    parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # a row for each part: no more than partitions
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).select("part", "doc_id", "row", "start", "n_tokens", "names", "root")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    for p in (cut_path, filter_path):
        drop_staged(spark, p)


def manifest_of(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes: a row per part."""
    ordered = recipes.select("part", "doc_id", "root", "start", "row").repartition("part").sortWithinPartitions("part", "start")
    return ordered.select("part", "doc_id", "root").mapInArrow(_manifest, "part int, first_doc_id long, last_doc_id long, documents long, root binary")


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest rows of all the parts that a task holds, each in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        for a, b in zip([0, *(np.flatnonzero(np.diff(part)) + 1)], [*(np.flatnonzero(np.diff(part)) + 1), len(part)]):
            if held and held[0].column(0)[0] != batch.column(0)[int(a)]:
                yield from _roots(iter(held))
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    yield from _roots(iter(held))


def read_store(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """A row per document, from the files alone: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32.

    Fails if a chunk is missing, a document's Merkle root differs from its recipe, or the recipes differ from the manifest.
    """
    recipe_columns = "part int, doc_id long, row long, start long, n_tokens long, names array<binary>, root binary"
    # with a schema: recipes whose files are all lost are no recipes, which the manifest tells
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.schema(recipe_columns).parquet(f"{path}/recipes")
    # a row for each part on both sides; equal rows cancel out
    found, written = manifest_of(recipes), spark.read.parquet(f"{path}/manifest")
    differing = found.withColumn("side", F.lit(1)).unionByName(written.withColumn("side", F.lit(-1))).groupBy(*found.columns).agg(F.sum("side").alias("n")).where("n <> 0")
    bad = [r["part"] for r in differing.select("part").distinct().orderBy("part").limit(10).collect()]
    if bad:
        raise ValueError(f"the store is damaged: recipes differ from the manifest in parts {bad}")
    placed = chunks.where("row IS NOT NULL").select("row", "at", "ids")
    several = chunks.where("row IS NULL").select("name", "ids")
    used = recipes.select("row", F.posexplode("names").alias("at", "name")).join(several, "name").select("row", "at", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts = None, []

        def whole() -> tuple:
            ids = np.frombuffer(b"".join(parts), dtype=width).astype("<u4").tobytes()
            return row, merkle_root([name_of(p) for p in parts]), ids, zlib.crc32(ids), len(ids) // 4

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])], ["row", "found_root", "ids", "ids_crc32", "found_n"])

        for batch in batches:
            found = []
            for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r != row:
                    if parts:
                        found.append(whole())
                    row, parts = r, []
                parts.append(p)
            yield rows(found)
        if parts:
            yield rows([whole()])

    built = placed.unionByName(used).repartition("row").sortWithinPartitions("row", "at").select("row", "ids").mapInArrow(run, "row long, found_root binary, ids binary, ids_crc32 long, found_n long")
    checked = recipes.select("row", "doc_id", "start", "n_tokens", "root").join(built, "row", "left")
    good = F.col("root").eqNullSafe(F.col("found_root")) & (F.col("n_tokens") == F.col("found_n"))
    return checked.select("doc_id", "start", F.when(good, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the store is damaged"))).cast("long").alias("n_tokens"), "ids", "ids_crc32")


def new_store_path(spark: SparkSession, name: str) -> str:
    """A folder for a store that goes with the session."""
    import uuid

    from kinweave.staging import _on_fs

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _on_fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
