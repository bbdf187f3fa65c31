"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled documents in tasks and sums them by language and bucket. The
sample is drawn by a hash of id and text, about TRAIN_DOCS documents, and never more than twice as many, however often
one row repeats. The matrix of log probabilities (at most MAX_LANGS languages x a fixed number of buckets) is broadcast;
prediction gathers its rows for the n-grams of a batch and sums them by document in numpy. A long text is worked on in
pieces whose n-grams reach back into the piece before, so that memory does not grow with a text times the languages.

Defined cases: a null text, a text without a letter, or no labelled document at all gives `und` with score 0; equal
scores give the language that sorts first; a null doc_id counts as not held out; more than MAX_LANGS labels are an
error; further columns are carried; where the input has a column of the name of an added one (lang_pred, score,
evidence), the added one gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.tokens import free_name, hold, small_batches, trim

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled documents that training takes, about; languages that a model can have (a matrix of 134 MB).
TRAIN_DOCS, MAX_LANGS = 40_000, 512
UNKNOWN = "und"
_PARTS, _CELLS = 16, 2_000_000
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point to code point: letters as they are, everything else as a space."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def pieces(texts: list[str], most: int, back: int) -> Iterator[list[tuple[int, str, int, bool]]]:
    """Lower-case pieces of about `most` characters in all: the text's number, the piece, the characters that it repeats from the one before, and whether it is the last."""
    held, size = [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        for a in range(0, max(1, len(t)), most):
            skip = min(a, back)
            held.append((i, t[a - skip : a + most], skip, a + most >= len(t)))
            size += len(held[-1][1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(part: list[tuple[int, str, int, bool]], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams at each place (an array for each order), the places [begin, end) that count for each piece, and whether it has a letter.

    The last piece of a text has `lead` places more, for the n-grams that run over its end.
    """
    lead = max(orders)
    chars = np.frombuffer(("\0" * lead).join(["", *(t for _, t, _, _ in part), ""]).encode("utf-32-le", "replace"), dtype="<u4")
    edge = chars == 0
    chars = _fold()[chars]
    chars[edge] = 0
    sizes = np.array([len(t) for _, t, _, _ in part], dtype=np.int64)
    begins = lead + np.concatenate([[0], np.cumsum(sizes[:-1] + lead)])
    last = np.array([x for _, _, _, x in part], dtype=bool)
    bounds = np.stack([begins + [k for _, _, k, _ in part], begins + sizes + lead * last], axis=1)
    found = []
    for n in orders:
        h = np.full(len(chars), n, dtype=np.uint32)
        for k in range(n):
            h[k:] += (chars[: len(chars) - k] + np.uint32(1)) * _ODD[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        found.append((h & np.uint32(buckets - 1)).astype(np.int64))
    letters = np.concatenate([[0], np.cumsum((chars != 0) & (chars != 32))])
    return found, bounds, letters[bounds[:, 1]] > letters[bounds[:, 0]]


def _by_piece(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows over the places of each piece."""
    some = bounds[:, 1] > bounds[:, 0]
    out = np.zeros((len(bounds), rows.shape[1]))
    if some.any():
        padded = np.concatenate([rows, np.zeros((1, rows.shape[1]))])
        out[some] = np.add.reduceat(padded, bounds[some].ravel(), axis=0)[::2]
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities [buckets + 1, languages]; its last row holds the priors."""
    rows = small_batches(docs).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(*[F.col(c) for c in (doc_id, text) if c in docs.columns]).bitwiseAND(F.lit((1 << 62) - 1)).alias("h"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    labels = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(labels) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = min(1.0, train_docs / max(1, sum(r["n"] for r in labels)))
    if share < 1:
        rows = rows.where(F.col("h") < int(share * (1 << 62))).limit(2 * train_docs)
    most = max(1000, _CELLS // max(1, len(labels)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid")
        names: dict[str, int] = {}
        sums: list[np.ndarray] = []
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in langs:
                if x not in names:
                    names[x] = len(names)
                    sums.append(np.zeros(buckets + 1, dtype=np.int64))
                sums[names[x]][-1] += 1
            for part in pieces(texts, most, max(orders) - 1):
                found, bounds, _ = grams(part, orders, buckets)
                for (i, _, _, _), (a, b) in zip(part, bounds.tolist()):
                    for f in found:
                        at, n = np.unique(f[a:b], return_counts=True)
                        sums[names[langs[i]]][at] += n
        for name, k in names.items():
            some = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int64()), pa.array(sums[k][some], pa.int64())], ["lang", "bucket", "n"])

    # the sample is bounded, and so are its parts: each yields at most languages x buckets rows
    counts = rows.select("text", "lang").repartition(_PARTS).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    matrix = np.zeros((buckets + 1, len(langs)))
    matrix[counts["bucket"].to_numpy(), [langs.index(x) for x in counts["lang"]]] = counts["n"].to_numpy()
    matrix[:-1] = np.log((matrix[:-1] + 1) / (matrix[:-1].sum(axis=0) + buckets))
    matrix[-1] = np.log(matrix[-1] / max(1, matrix[-1].sum())) if langs else 0
    return langs, matrix


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", orders: tuple[int, ...] = ORDERS, evidence: bool = False) -> DataFrame:
    """`docs` with lang_pred and score (the posterior probability of lang_pred).

    With `evidence` also the column evidence: by how much an n-gram of the text is likelier in lang_pred than one drawn
    at random from all buckets, as the mean of logarithms. It is below 0 for text that no learned language explains.
    """
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), docs.columns
    added = ["lang_pred", "score", "evidence"][: 3 if evidence else 2]
    own = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid")
        langs, matrix = shared.value
        buckets, most = len(matrix) - 1, max(1000, _CELLS // max(1, len(langs)))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            best, score, mean = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if langs:
                sums, letters, n = np.tile(matrix[-1], (len(texts), 1)), np.zeros(len(texts), bool), np.zeros(len(texts))
                for part in pieces(texts, most, max(orders) - 1):
                    found, bounds, some = grams(part, orders, buckets)
                    of = np.array([i for i, _, _, _ in part])
                    np.add.at(sums, of, sum(_by_piece(matrix[f], bounds) for f in found))
                    np.logical_or.at(letters, of, some)
                    np.add.at(n, of, len(orders) * (bounds[:, 1] - bounds[:, 0]))
                top = sums.argmax(axis=1)
                p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                gain = (sums.max(axis=1) - matrix[-1][top]) / np.maximum(n, 1) + np.log(buckets)
                for i in np.flatnonzero(letters):
                    best[i], score[i], mean[i] = langs[top[i]], float(p[i]), float(gain[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(mean, pa.float64())][: len(own) + len(added)], [*own, *added])
        trim()

    # by place: mapInArrow cannot read names with dots
    fields = [T.StructField(c, f.dataType, True) for c, f in zip(own, docs.schema.fields)]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in added)])
    return small_batches(docs).toDF(*own).mapInArrow(run, schema).toDF(*names, *(free_name(docs, c) for c in added))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept for testing: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
