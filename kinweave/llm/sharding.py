"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

1. Every source partition permutes its rows by a keyed hash of their place (no shuffle); the permuted rows are staged.
2. The counts of the partitions give the matrix: row p says how many rows of partition p go to each shard, drawn
   from the multivariate hypergeometric law of a uniform shuffle, given the exact shard sizes. A partition sends a
   prefix of its permutation to the first shard, the next piece to the second, and so on.
3. The rows are exchanged and permuted again within their shard: a second keyed hash orders them. A shard is cut into
   ranges of that hash, so that no task holds a whole shard; a table of range counts turns places into slots.

Shard sizes are at most one row apart. Places, not contents, are hashed: equal rows, null ids and ties are dealt
like any others. An empty table gives an empty result. Columns of the input are carried under their own names; where
the input has a column shard or slot, the added one gets underscores in front.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.tokens import free_name
from kinweave.staging import stage

#: Rows in one range of a shard, on average.
RANGE_ROWS = 100_000
#: Most cells of the matrix (64 MB): there are at most MAX_CELLS / shards source partitions.
MAX_CELLS = 8_000_000
_PLACE = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken without return are good. Exact also beyond numpy's limit of 10**9 items."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high, n = max(0, draws - bad), min(draws, good), good + bad
    mean = draws * good / n
    spread = 50 + 12 * math.sqrt(max(1.0, mean * (bad / n) * (n - draws) / max(1, n - 1)))
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    up = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    p = np.concatenate([[0.0], np.cumsum(up)])
    p = np.cumsum(np.exp(p - p.max()))
    return int(k[min(len(k) - 1, np.searchsorted(p, rng.random() * p[-1], side="right"))])


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Rows for each partition (`counts`) and shard (`capacities`), as a uniform shuffle would send them."""
    rng, left = np.random.default_rng(seed), list(map(int, capacities))
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for p, count in enumerate(counts):
        rest, total = int(count), sum(left)
        for s, room in enumerate(left):
            total -= room
            take = hypergeometric(rng, room, total, rest) if rest else 0
            out[p, s] = take
            left[s] -= take
            rest -= take
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with `shard` (int) and `slot` (long, gapless from 0 in each shard)."""
    spark, own = df.sparkSession, [f"c{i}" for i in range(len(df.columns))]
    place: Column = F.monotonically_increasing_id()
    # where there are fewer partitions already, this changes nothing
    local = df.toDF(*own).coalesce(max(1, MAX_CELLS // shards)).withColumn("_key", F.xxhash64(place, F.lit(seed))).sortWithinPartitions("_key")
    staged, _ = stage(local.withColumn("_at", place).drop("_key"), "shards")
    staged = staged.withColumn("_source", F.shiftright("_at", 33)).withColumn("_rank", F.col("_at").bitwiseAND(F.lit(_PLACE)))
    # one row for each source partition: the driver holds a table of partitions, not of rows
    counts = [(r["_source"], r["n"]) for r in staged.groupBy("_source").agg(F.count("*").alias("n")).orderBy("_source").toLocalIterator()]
    n = sum(c for _, c in counts)
    capacities = [n // shards + (s < n % shards) for s in range(shards)]
    ends = communication_matrix([c for _, c in counts], capacities, seed).cumsum(axis=1)
    schema = T.StructType([T.StructField("_source", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    matrix = spark.createDataFrame([(p, e) for (p, _), e in zip(counts, ends.tolist())], schema)
    # MAX_CELLS bounds the matrix: 64 MB
    dealt = staged.join(F.broadcast(matrix), "_source").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))).withColumn("_key", F.xxhash64("_at", F.lit(seed), F.lit(2)))
    ranges = max(1, -(-n // shards // range_rows))
    dealt = dealt.withColumn("_range", F.floor(F.shiftrightunsigned("_key", 32) * F.lit(ranges) / F.lit(1 << 32)).cast("int"))
    sizes = dealt.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy("_key", "_at")
    placed = dealt.withColumn("_nth", F.row_number().over(within) - 1).join(starts, ["shard", "_range"])
    return placed.select(*[F.col(c).alias(name) for c, name in zip(own, df.columns)], F.col("shard").alias(free_name(df, "shard")), (F.col("_start") + F.col("_nth")).alias(free_name(df, "slot")))
