"""Near-duplicates by DartMinHash: sparse weighted signatures, banded joining, exact check, classes.

Sketch. Every element (a shingle of WORDS words, with a weight) owns a region of the plane time x weight. A hashed
Poisson process throws darts into each region: the gaps between darts come from hashes of the element, so equal
elements get equal darts in every document. Darts are thrown only up to a time at which about K ln K + 2K darts are
expected in the whole document, whatever its size; each dart belongs to one of K coordinates and the earliest dart of
a coordinate is the signature there. A coordinate that got no dart doubles the time. Two signatures agree in a
coordinate with the probability of the weighted Jaccard similarity.

Join. Documents with equal shingle sets are one node. Signatures are cut into bands; nodes that share a band meet in a
bucket. The hub of a bucket is its member that meets the most others in all its buckets, the centre of a cloud of
copies. Members are checked against their hubs on the exact shingle sets. All buckets of one hub form a group. Where a
group still holds several classes, a second round compares those outside its largest class with all members of other
classes: the group is cut into blocks, and each pair of blocks is compared in one task on second, longer signatures of
one byte a coordinate; only pairs within five standard errors of the threshold leave the task, to be checked exactly.
So no link between documents that share a bucket is lost, and no group is expanded into all its pairs.

Defined cases: words are runs of ASCII letters, digits, underscore or any non-ASCII characters of the lower-case
text; a text of 1 to 4 words is one shingle; texts without words are near-copies only if equal; a null text is the
empty text; rows equal in doc_id and text share one fate; a null doc_id is larger than any other, and of a class
without ids the texts with the smallest hash stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bloomdedup import bit_filter, filter_bits, marked, position
from kinweave.llm.tokens import free_name, hold, slices, small_batches, trim
from kinweave.staging import drop_staged, stage

WORDS, SIMILARITY = 5, 0.8
#: Bands and rows in a band: at a similarity of 0.8 a pair shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
#: Coordinates of the second signatures, and nodes of a block in the second round.
SECOND, BLOCK = 512, 512
_SLICE = 500_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    return np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The hashes of each text's shingles, sorted, repeats included."""
    coded = [t.lower().encode("utf-8") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *coded, b""]), dtype=np.uint8)
    inside = _word_bytes()[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(19, (len(raw) + 1).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    h = mix((sums[ends] - sums[begins]) * down[begins])
    bounds = np.searchsorted(begins, 1 + np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]))
    n = max(0, len(h) - words + 1)
    several = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        several = mix(several * _M3 + h[k : k + n] + np.uint64(k + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.sort(several[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                one = mix(one * _M3 + h[k] + np.uint64(k - a + 1))
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures [documents, k] of weighted sets, unsigned 32-bit. Weights are 1 by default; an empty set gives zeros."""
    n = len(elements)
    out, best = np.zeros((n, k), dtype=np.uint32), np.full((n, k), np.inf)
    total = np.array([len(e) if weights is None else float(w.sum()) for e, w in zip(elements, weights or elements)])
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        doc = np.repeat(todo, [len(elements[i]) for i in todo])
        x = np.concatenate([elements[i] for i in todo])
        w = None if weights is None else np.concatenate([weights[i] for i in todo])
        low, high, strip = 0.0, 1.0, 0
        while True:
            some = slice(None) if w is None else np.flatnonzero(w > low)
            d, seed, most = doc[some], mix(x[some] + np.uint64((strip + 1) * 0x632BE59BD9B4E019 % (1 << 64))), None if w is None else w[some]
            if not len(d):
                break
            time, width = np.zeros(len(d)), high - low
            while len(d):
                seed = mix(seed + _M3)
                time = time - np.log(_unit(seed)) / width
                go = np.flatnonzero(time <= limit[d])
                d, seed, time = d[go], seed[go], time[go]
                dart, at = mix(seed ^ _M1), time
                hit = d
                if most is not None:
                    most = most[go]
                    inside = low + width * _unit(mix(seed ^ _M2)) < most
                    dart, at, hit = dart[inside], time[inside], d[inside]
                cell = hit * k + (dart % np.uint64(k)).astype(np.int64)
                order = np.argsort(-at, kind="stable")
                cell, at, value = cell[order], at[order], (dart >> np.uint64(32)).astype(np.uint32)[order]
                # of several darts in a cell the last one written, the earliest, stays
                flat_best, flat_out = best.reshape(-1), out.reshape(-1)
                before = flat_best[cell]
                better = at < before
                flat_best[cell[better]], flat_out[cell[better]] = at[better], value[better]
            if w is None:
                break
            low, high, strip = high, 2 * high, strip + 1
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        limit[todo] *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit hash for each document and band."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = mix(h * _M3 + parts[:, :, r])
    return h.view(np.int64)


def _node(found: np.ndarray, text: str) -> int:
    """A name for a set of shingles; 64 bits suffice for billions of documents."""
    import hashlib

    raw = found.tobytes() if len(found) else b"\0" + text.encode("utf-8")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("shingles")
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in slices(texts, _SLICE):
            sets = [np.unique(s) for s in shingles(texts[a:b])]
            sig = signatures(sets)
            bands = [h if len(s) else [] for h, s in zip(band_hashes(sig).tolist(), sets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array([_node(s, t) for s, t in zip(sets, texts[a:b])], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "bands"])
    trim()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in slices(texts, _SLICE):
            sets = [np.unique(s) for s in shingles(texts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s, t) for s, t in zip(sets, texts[a:b])], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
    trim()


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(p), len(q)) < threshold * max(len(p), len(q)) - 1e-9:
                    keep.append(False)
                    continue
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(common >= threshold * (len(p) + len(q) - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte for each coordinate of a longer signature."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        for i in range(0, len(sets), 200):
            sig = signatures(sets[i : i + 200], k=SECOND).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sig)), pa.array([x.tobytes() for x in sig], pa.binary())], ["node", "sig"])
    trim()


def _blocks(similarity: float):
    """Pairs of a block of outsiders (side 1) and a block of members (side 0) that may be near; rows come sorted by block pair."""
    agree = similarity + (1 - similarity) / 256
    least = int(SECOND * agree - 5 * math.sqrt(SECOND * agree * (1 - agree)))

    def pairs(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        left, right = x["side"] == 1, x["side"] == 0
        nodes, labels, outside, sig, hub = x["node"][right], x["label"][right], x["outside"][right], x["sig"][right], x["hub"][0]
        for node, label, mine in zip(x["node"][left].tolist(), x["label"][left].tolist(), x["sig"][left]):
            if node == hub:
                continue
            some = np.flatnonzero((labels != label) & (nodes != hub) & (~outside | (nodes > node)))
            if len(some):
                near = nodes[some[(sig[some] == mine).sum(axis=1) >= least]]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(near, node)), pa.array(np.minimum(near, node))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(["hub", "i", "j", "side", "node", "label", "outside"])}
            x["sig"] = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, SECOND)
            ends = [*(np.flatnonzero(np.diff(x["hub"]) | np.diff(x["i"]) | np.diff(x["j"])) + 1).tolist(), batch.num_rows]
            for a, b in zip([0, *ends], ends):
                part = {k: v[a:b] for k, v in x.items()}
                if held and any(held[0][k][0] != part[k][0] for k in ("hub", "i", "j")):
                    yield from pairs(held)
                    held = []
                held.append(part)
        if held:
            yield from pairs(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of the links (a, b), by alternating large and small stars."""
    edges, path = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large, large_path = stage(large, "stars")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = stage(small, "stars")
        changed = not new.exceptAll(edges).isEmpty() or not edges.exceptAll(new).isEmpty()
        for p in (path, large_path):
            drop_staged(links.sparkSession, p)
        edges, path = new, new_path
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _filtered(keys: DataFrame, key: Column, n: int) -> tuple[Column, str]:
    """A condition that holds for every row whose `key` is in `keys` (column h) and for few others; and what to drop later."""
    bits = filter_bits(n)
    pieces, path = stage(bit_filter(keys.select(position(F.col("h"), bits).alias("pos")), bits), "filter")
    return marked(pieces.select("pieces").scalar(), position(key, bits)), path


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, text_hash, class_id (the smallest doc_id of its class), class_size, kept."""
    spark = docs.sparkSession
    given = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"), F.col(text).cast("string").alias("text"))
    sketch, _ = stage(given.mapInArrow(_sketch, "doc_id long, text_hash long, node long, bands array<long>"), "sketch")
    nodes = sketch.groupBy("node").agg(F.first("bands").alias("bands"))
    banded, banded_path = stage(nodes.select("node", F.explode("bands").alias("bucket")), "bands")
    met, met_path = stage(banded.join(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "met")
    drop_staged(spark, banded_path)
    rated, rated_path = stage(met.select("bucket", "node").join(met.groupBy("node").agg(F.sum("n").alias("meets")), "node"), "rated")
    hubs = rated.groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    stars, stars_path = stage(rated.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    for p in (met_path, rated_path):
        drop_staged(spark, p)

    # the shingles of nodes that met another, from a second reading of the texts that may be theirs
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    ids, ids_path = stage(sketch.select("node", "text_hash").groupBy("node").agg(F.min("text_hash").alias("h")).join(wanted, "node").select("h"), "wanted")
    here, here_path = _filtered(ids, F.col("text_hash"), ids.count())
    sets = given.where(here).select("text").mapInArrow(_sets, "node long, shingles binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets, sets_path = stage(sets, "shingles")

    def check(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
        two = one.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
        return two.select("a", "b", "x", "y").mapInArrow(_compare(similarity), "a long, b long")

    links, links_path = stage(check(stars), "links")
    labels = components(links)

    # groups of three or more that still hold several classes; one with two members has been decided
    members = stars.select(F.col("b").alias("hub"), F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("hub"), F.col("b").alias("node")).distinct())
    labelled, labelled_path = stage(members.join(labels, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label")), "members")
    sizes = labelled.groupBy("hub", "label").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("classes"), F.sum("n").alias("n"))
    opened, opened_path = stage(labelled.join(sizes.where("classes > 1 AND n > 2").select("hub", "main", "n"), "hub"), "open")
    paths = [stars_path, ids_path, here_path, sets_path, labelled_path, opened_path]
    if not opened.isEmpty():
        second, second_path = stage(sets.join(opened.select("node").distinct(), "node", "left_semi").mapInArrow(_second, "node long, sig binary"), "second")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        rows = opened.select("hub", "node", "label", (F.col("label") != F.col("main")).alias("outside"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        zero, one = F.lit(0).alias("side"), F.lit(1).alias("side")
        grid = rows.select("hub", F.col("other").alias("i"), F.col("own").alias("j"), zero, "node", "label", "outside").unionByName(rows.where("outside").select("hub", F.col("own").alias("i"), F.col("other").alias("j"), one, "node", "label", "outside"))
        near = grid.join(second, "node").select("hub", "i", "j", "side", "node", "label", "outside", "sig").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(_blocks(similarity), "a long, b long").distinct()
        near, near_path = stage(near, "near")
        again, again_path = stage(check(near), "links")
        if not again.isEmpty():
            labels = components(links.unionByName(again))
        paths += [second_path, near_path]
    for p in paths:
        drop_staged(spark, p)

    of = sketch.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("label"))
    of, _ = stage(of, "labels")
    # a table of one row a class, so that adaptive execution can split a large class in the join
    classes, _ = stage(of.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.when(F.col("doc_id").isNull(), F.col("text_hash"))).alias("least")), "classes")
    stays = F.when(F.col("class_id").isNull(), F.col("text_hash") == F.col("least")).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
    return of.join(classes, "label").select("doc_id", "text_hash", "class_id", "class_size", stays.alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each class, all columns. Only rows that may go are shuffled."""
    gone, _ = stage(near_duplicates(docs, text, doc_id, similarity).where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct(), "gone")
    text_hash = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    maybe, _ = _filtered(gone, text_hash, gone.count())
    id_, h = free_name(docs, "id"), free_name(docs, "h")
    lost = gone.select(F.col("id").alias(id_), F.col("h").alias(h))
    held = docs.where(maybe).join(lost, text_hash.eqNullSafe(F.col(h)) & F.col(doc_id).cast("long").eqNullSafe(F.col(id_)), "left_anti")
    return docs.where(~maybe).unionByName(held)
