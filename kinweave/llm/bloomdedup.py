"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Each pass hashes every text to one bit position of a bounded filter and marks the positions that more than one row
hits. A row whose position is unmarked is certainly alone: it passes straight through. The second pass uses an
independent hash over the survivors of the first, so that few single rows are left among them. Only those rows
shuffle, and equality among them is decided on the SHA-256 of the whole text.

Defined cases: a null text counts as the empty text; of equal texts the row with the largest doc_id stays (a null
doc_id is smaller than any other); of rows equal in text and doc_id exactly one stays; an empty table gives an empty
result; further columns are carried by `exact_dedup` under their own names, whatever they are; of rows equal in text and
doc_id the one stays whose further columns are largest, those that have no order (maps) as JSON.

What travels to build a filter is a bit position of 8 bytes for each row, counted before the shuffle: no text and no
other column. A bitmap for each task, sent whole, would be the larger of the two as soon as a task marks fewer bits than
1/64 of the filter, which is the rule with many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.staging import stage

#: Bits in one stored piece of a filter; bitmap_construct_agg builds pieces of this size.
PIECE = 32768
#: Largest filter, in bits (128 MB). Beyond it more single rows shuffle; the result is the same.
MAX_BITS = 1 << 30


def filter_bits(n_rows: int, bits_per_row: int = 16, most: int = MAX_BITS) -> int:
    """A power of two of at least `bits_per_row` bits a row, one piece at least, `most` at most."""
    return min(most, max(PIECE, 1 << max(1, n_rows * bits_per_row - 1).bit_length()))


def position(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits).cast("bigint"))


def bit_filter(positions: DataFrame, bits: int) -> DataFrame:
    """One row and column `pieces`: the filter as an array of binary pieces, from a column `pos` of bits to set."""
    spark = positions.sparkSession
    n = bits // PIECE
    set_ = positions.groupBy(F.expr(f"pos div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(pos % {PIECE})").alias("bm"))
    every = spark.range(0, n, 1, 1).select(F.col("id").alias("piece"))
    # n pieces at most, a bound that does not grow with the rows
    return every.join(set_, "piece", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("piece", F.coalesce("bm", F.lit(bytearray(1)).cast("binary")).alias("bm")))), lambda x: x["bm"]).alias("pieces")
    )


def marked(pieces: Column, pos: Column) -> Column:
    """Whether the bit `pos` is set. An unset piece is stored as a single zero byte."""
    piece = F.element_at(pieces, (F.floor(pos / F.lit(PIECE)) + 1).cast("int"))
    low = F.pmod(pos, F.lit(PIECE).cast("bigint")).cast("int")
    byte = F.ascii(F.decode(F.substring(piece, F.shiftright(low, 3) + 1, F.lit(1)), "ISO-8859-1"))
    return F.coalesce(F.getbit(byte, F.pmod(low, F.lit(8))) == 1, F.lit(False))


def _repeats(rows: DataFrame, h: Column, bits: int) -> DataFrame:
    """The filter of the bits that more than one row of `rows` hits; counts are combined before the shuffle."""
    return bit_filter(rows.select(position(h, bits).alias("pos")).groupBy("pos").count().where("count > 1").select("pos"), bits)


def possibly_repeated(df: DataFrame, text: Column, max_bits: int = MAX_BITS) -> Column:
    """A condition on rows of `df`: true for each row whose text may occur twice, false only for texts that occur once."""
    t = F.coalesce(text, F.lit(""))
    first, second = F.xxhash64(t), F.xxhash64(t, F.lit(1))
    bits = filter_bits(df.count(), most=max_bits)
    once = marked(_repeats(df, first, bits).scalar(), position(first, bits))
    twice = _repeats(df.where(once), second, bits)
    return once & marked(twice.scalar(), position(second, bits))


def dedup_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    maybe = possibly_repeated(docs, F.col(text), max_bits)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("text_sha256"), maybe.alias("maybe"))
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times"))
    groups, _ = stage(some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    # a hot group is one key of this join: adaptive execution splits it, as the other side is a table of one row a key
    found = some.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("nth"))
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` that stay, all columns. Further columns break ties."""
    maybe = possibly_repeated(docs, F.col(text), max_bits)
    # by position, so that names with dots or of any other kind do no harm
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    ordered = [F.to_json(F.struct(c)) if _unordered(f.dataType) else c for c, f in zip(cols, docs.schema.fields) if f.name != text]
    flagged = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"), F.struct(F.col(doc_id), *ordered).alias("rank"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha"), maybe.alias("maybe"))
    # the largest row of each group, combined before the shuffle: a hot group leaves each task as one row
    best = flagged.where("maybe").groupBy("sha").agg(F.max_by("row", "rank").alias("row")).select("row")
    rows = flagged.where(~F.col("maybe")).select("row").unionByName(best)
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _unordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return _unordered(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))
