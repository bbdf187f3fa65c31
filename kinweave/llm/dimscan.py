"""Approximate nearest neighbours: inverted lists with an adaptive scan of dimensions (Euclidean distance).

A bounded sample fits the centroids; every vector is rotated by one random orthogonal matrix and filed in the list of
its nearest centroid. A list is cut into chunks of about CHUNK vectors, and a chunk is stored as one row: its ids, its
original vectors, and its rotated vectors in blocks of BLOCK columns, each block contiguous.

A query probes its nearest lists. How many, the sample tells: the least number of lists that hold RECALL of the
nearest neighbours that CALIBRATION vectors of the sample have in the sample. Data in clusters need few lists, data
without structure many. A bounded set of anchors, a part of the sample, gives each query a first limit: the distance
of its k-th nearest anchor. In a chunk the partial distances of a block of queries grow by one column block after the
other; after each, a candidate goes as soon as its partial distance, scaled up, is so far above the limit that a
hypothesis test rejects that it is nearer. Blocks are only read for candidates that some query still holds. Survivors
get their exact distance on the original vectors. The queries of a list are dealt in blocks of about QUERIES, and each
pair of a chunk and a block is one group: no task holds a whole hot list.

`probed=1` with `critical=math.inf` searches exactly.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take
no part; a query is never its own candidate (by id); ties go to the smaller vec_id; a query with fewer candidates
than asked for gets all of them; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.staging import stage

#: Vectors in the sample that fits the centroids, and in its part that sets first limits; most lists; vectors of a chunk; queries of a block.
SAMPLE, ANCHORS, LISTS, CHUNK, QUERIES = 50_000, 2048, 4096, 8192, 8192
#: The share of the sample's neighbours that the probed lists have to hold, and the vectors that measure it.
RECALL, CALIBRATION = 0.96, 512
#: Width of a block of dimensions, and the critical value of the test.
BLOCK, CRITICAL = 16, 2.1
#: Relative rounding of partial distances that the tests leave room for, and queries that are scanned at once.
_ROUNDING, _AT_ONCE = 1e-9, 64


def usable(vector: Column, dim: int) -> Column:
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 1, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.choice(len(sample), lists)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lists_in_order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The lists of each vector, nearest first."""
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argsort(axis=1, kind="stable")


def calibrated(points: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL, asked: int = CALIBRATION) -> int:
    """How many lists a query has to probe so that they hold `recall` of the k nearest that sample points have in the sample."""
    if len(points) <= k + 1 or len(centres) == 1:
        return len(centres)
    q = points[: min(asked, len(points))]
    of, order = _nearest(points, centres), lists_in_order(q, centres)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = []
    for i in range(0, len(q), _AT_ONCE):
        d = (points**2).sum(axis=1) - 2 * q[i : i + _AT_ONCE] @ points.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k, axis=1)[:, :k]
        needed.append(np.take_along_axis(place[i : i + _AT_ONCE], of[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def column_blocks(turned: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """The rotated vectors in blocks of columns, each contiguous."""
    return [np.ascontiguousarray(turned[:, a : a + block]) for a in range(0, turned.shape[1], block)]


def scan(queries: np.ndarray, blocks: list[np.ndarray], squared_limits: np.ndarray, critical: float = CRITICAL) -> np.ndarray:
    """Squared distances [queries, candidates] of rotated vectors; infinite for those that a test abandoned."""
    dim, n = queries.shape[1], len(blocks[0])
    out, alive, part = np.full((len(queries), n), np.inf), np.arange(n), np.zeros((len(queries), n))
    room = _ROUNDING * ((queries**2).sum(axis=1).max(initial=0.0) + sum((b**2).sum(axis=1) for b in blocks).max(initial=0.0))
    done = 0
    for b in blocks:
        held = b if len(alive) == n else b[alive]
        q = queries[:, done : done + b.shape[1]]
        part += (held**2).sum(axis=1) + (q**2).sum(axis=1)[:, None] - 2 * q @ held.T
        done += b.shape[1]
        factor = (1 + critical / math.sqrt(done)) ** 2 * done / dim if done < dim else 1.0
        part[part > squared_limits[:, None] * factor + room] = np.inf
        some = np.isfinite(part).any(axis=0)
        if not some.all():
            alive, part = alive[some], part[:, some]
        if not len(alive):
            return out
    out[:, alive] = part
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of each query by exact distances, of the candidates whose (rounded) squared distance is finite."""
    out = []
    room = 4 * _ROUNDING * ((queries**2).sum(axis=1).max(initial=0.0) + (own**2).sum(axis=1).max(initial=0.0))
    for q, qid, near in zip(queries, query_ids.tolist(), found):
        at = np.flatnonzero(np.isfinite(near) & (ids != qid))
        if len(at) > k:
            at = at[near[at] <= np.partition(near[at], k - 1)[k - 1] + room]
        d = np.sqrt(((own[at] - q) ** 2).sum(axis=1))
        top = np.lexsort((ids[at], d))[:k]
        out += zip([qid] * len(top), ids[at][top].tolist(), d[top].tolist())
    return out


_FOUND = "query_id long, vec_id long, score double"


def _rows(found: list[tuple[int, int, float]]) -> pa.Table:
    columns = list(zip(*found)) or [[], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _pack_chunk(turn: np.ndarray, dim: int):
    """One row for a chunk of vectors (list, chunk, vec_id, vector)."""

    def run(vectors: pa.Table) -> pa.Table:
        own = _matrix(vectors["vector"].combine_chunks(), dim)
        blocks = [b.tobytes() for b in column_blocks(own @ turn)]
        return pa.table({"list": vectors["list"][:1], "chunk": vectors["chunk"][:1], "ids": pa.array([vectors["vec_id"].to_numpy()], pa.list_(pa.int64())), "own": pa.array([own.tobytes()], pa.binary()), "blocks": pa.array([blocks], pa.list_(pa.binary()))})

    return run


def _search_group(k: int, dim: int, critical: float):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if queries.num_rows:
            given, turned = _matrix(queries["vector"].combine_chunks(), dim), _matrix(queries["turned"].combine_chunks(), dim)
            asking, limits = queries["query_id"].to_numpy(), queries["squared_limit"].to_numpy()
            for row in chunks.select(["ids", "own", "blocks"]).to_pylist():
                ids = np.array(row["ids"], dtype=np.int64)
                own = np.frombuffer(row["own"]).reshape(-1, dim)
                blocks = [np.frombuffer(b).reshape(len(ids), -1) for b in row["blocks"]]
                for i in range(0, len(asking), _AT_ONCE):
                    some = slice(i, i + _AT_ONCE)
                    out += best(given[some], asking[some], scan(turned[some], blocks, limits[some], critical), own, ids, k)
        return _rows(out)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", probed: float | None = None, critical: float = CRITICAL, chunk: int = CHUNK, block: int = QUERIES, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which `is_query` holds.

    `probed` is the share of the lists that a query probes; by default the sample decides.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = rows.where("vector IS NOT NULL AND size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), dim))
    n = rows.count()
    part = int(min(1.0, SAMPLE / max(1, n)) * (1 << 62))
    # in the order of a hash, so that the first of them are a sample of their own
    drawn = rows.withColumn("h", F.xxhash64("vec_id", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))).where(F.col("h") <= part).select("h", "vec_id", "vector").limit(2 * SAMPLE).toArrow().sort_by([("h", "ascending"), ("vec_id", "ascending")])
    turn, own = rotation(dim, seed), _matrix(drawn["vector"].combine_chunks(), dim)
    points = own @ turn
    # many more lists than the root of n: finer lists need fewer vectors for the same recall
    lists = int(max(1, min(LISTS, 8 * math.sqrt(n), len(points) / 4)))
    centres = fit_centroids(points, lists, seed) if len(points) else np.zeros((1, dim))
    lists = len(centres)
    share = max(1, math.ceil(probed * lists)) if probed is not None else calibrated(points, centres, k)
    held = min(ANCHORS, n // 16)
    anchors = (drawn["vec_id"].to_numpy()[:held], own[:held]) if held > k else None
    model = spark.sparkContext.broadcast((turn, centres, anchors))

    def file(batches):
        turn, centres, _ = model.value
        for batch in batches:
            near = _nearest(_matrix(batch.column(1), dim) @ turn, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["vec_id", "vector", "asks", "list"])

    filed, _ = stage(rows.mapInArrow(file, "vec_id long, vector array<double>, asks boolean, list int"), "lists")
    sizes = np.zeros(lists, dtype=np.int64)
    for r in filed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    # a query probes further lists until they hold several times as many vectors as it asks for
    least = min(n, 20 * k + 1)

    def probe(batches):
        turn, centres, anchors = model.value
        for batch in batches:
            asking, given = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            turned = given @ turn
            order = lists_in_order(turned, centres)
            enough = np.maximum(share, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
            probes = [o[: min(e, lists)].tolist() for o, e in zip(order, enough)]
            limits, first = np.full(len(asking), np.inf), [[] for _ in asking]
            if anchors is not None:
                near, place = (anchors[1] ** 2).sum(axis=1) + (given**2).sum(axis=1)[:, None] - 2 * given @ anchors[1].T, {q: i for i, q in enumerate(asking.tolist())}
                for q, i, d in best(given, asking, near, anchors[1], anchors[0], k):
                    first[place[q]].append({"vec_id": i, "score": d})
                limits = np.array([f[-1]["score"] ** 2 if len(f) == k else np.inf for f in first]) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, turned.size + 1, dim, dtype=np.int32), pa.array(turned.ravel())), pa.array(probes, pa.list_(pa.int32())), pa.array(limits, pa.float64()), pa.array(first, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))],
                ["query_id", "vector", "turned", "lists", "squared_limit", "first"],
            )

    asked = filed.where("asks").select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(probe, "query_id long, vector array<double>, turned array<double>, lists array<int>, squared_limit double, first array<struct<vec_id long, score double>>")
    asked, _ = stage(asked, "queries")
    loads = np.zeros(lists, dtype=np.int64)
    for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        loads[r["list"]] = r["count"]
    # one row for each list, of which there are at most LISTS
    grid = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(s) // chunk)), max(1, -(-int(q) // block))) for i, (s, q) in enumerate(zip(sizes, loads))], "list int, n_chunks int, n_blocks int"))
    cell = lambda id_, n: F.pmod(F.xxhash64(id_, F.lit(seed + 1)), F.col(n)).cast("int")
    dealt = filed.join(grid, "list").select("list", cell("vec_id", "n_chunks").alias("chunk"), "vec_id", "vector")
    packed, _ = stage(dealt.groupBy("list", "chunk").applyInArrow(_pack_chunk(turn, dim), "list int, chunk int, ids array<long>, own binary, blocks array<binary>"), "chunks")
    one = packed.join(grid, "list").select("list", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "ids", "own", "blocks")
    two = asked.select("query_id", "vector", "turned", "squared_limit", F.explode("lists").alias("list")).join(grid, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), cell("query_id", "n_blocks").alias("block"), "query_id", "vector", "turned", "squared_limit")
    found = one.groupBy("list", "chunk", "block").cogroup(two.groupBy("list", "chunk", "block")).applyInArrow(_search_group(k, dim, critical), _FOUND)
    # an anchor may lie in a list that is not probed; one that does is found twice
    known = asked.select("query_id", F.explode("first").alias("f")).select("query_id", "f.vec_id", "f.score")
    every = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
