"""Byte-level BPE, encoding and decoding, on padded numpy matrices.

The distinct pieces of a batch (matches of the pattern) are bucketed by length into padded matrices of token ids. In
each round every row merges its leftmost pair of the smallest rank; ranks come from a hashed table of pairs, a merged
row closes up by one column, and rows without a pair leave the matrix. A piece longer than LONGEST bytes is a matrix of
its own, of one row, in which a round makes all the merges that the rule would make one after another with that rank.
Decoding gathers token bytes by id.

Defined cases: a null text is the empty text, which has no ids; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tokens import Memory, byte_ranks, hold, slices, small_batches, trim, vocabulary_path

LONGEST = 1024
NONE = np.int32(2**31 - 1)
_CELLS = 1 << 20


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.width = max(ranks.values()) + 1
        by_id = [b""] * self.width
        for token, i in ranks.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.decimal = [str(i) for i in range(self.width)]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a * self.width + b for a, b in pairs], dtype=np.int64)
        self._build(keys, np.array(list(pairs.values()), dtype=np.int32))
        self.memory = Memory()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds: in each, one key takes each free slot."""
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE; a negative id is padding."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) * self.width + b)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        todo = np.flatnonzero((out == NONE) & (self.keys[at] >= 0) & (keys >= 0))
        at = at[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (self.keys[at] >= 0)
            todo, at = todo[go], at[go]
        return out

    def merge_matrix(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of at most `width` bytes."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        ids = self.of_byte[raw]
        ids[np.arange(width) >= np.array([len(w) for w in words])[:, None]] = -1
        rows, out = np.arange(n), [None] * n
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            j = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, j]
            done = best == NONE
            if done.any():
                left = ids[done]
                for r, row, k in zip(rows[done].tolist(), left.tolist(), (left >= 0).sum(axis=1).tolist()):
                    out[r] = row[:k]
                go = ~done
                rows, ids, ranks, j, best, every = rows[go], ids[go], ranks[go], j[go], best[go], np.arange(int(go.sum()))
                if not len(rows):
                    break
            w = ids.shape[1]
            ids[every, j] = best
            ids = ids[np.arange(w) != (j + 1)[:, None]].reshape(len(rows), w - 1)
            ranks = ranks[np.arange(w - 1) != j[:, None]].reshape(len(rows), w - 2)
            if w == 2:
                ranks = np.full((len(rows), 1), NONE, dtype=np.int32)
                ids = np.concatenate([ids, np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
                continue
            for at in (j - 1, j):
                some = np.flatnonzero((at >= 0) & (at < w - 2))
                if len(some):
                    ranks[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])
        return out

    def merge_row(self, word: bytes) -> list[int]:
        """The same merges for a matrix of one long row, several of them in a round.

        The pairs of the smallest rank are merged from the left. A merge that makes a pair of a smaller rank ends the
        round, since that pair comes before those to its right.
        """
        ids = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # of pairs that overlap the left one: in each run of neighbours every other one
            begins = np.concatenate([[True], np.diff(at) > 1])
            run = np.cumsum(begins) - 1
            at = at[(at - at[begins][run]) % 2 == 0]
            merged = ids.copy()
            merged[at] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            # a round ends behind the first merge whose new pairs rank below `least`
            after = np.minimum(at + 2, len(ids) - 1)
            right = np.where(at + 2 < len(ids), self.rank(merged[at], ids[after]), NONE)
            left = np.where(at > 0, self.rank(np.where((at > 1) & ~keep[at - 1], merged[at - 2], ids[at - 1]), merged[at]), NONE)
            early = np.flatnonzero(np.minimum(left, right) < least)
            if len(early) and early[0] + 1 < len(at):
                at = at[: early[0] + 1]
                merged, keep = ids.copy(), np.ones(len(ids), dtype=bool)
                merged[at], keep[at + 1] = least, False
            places = np.cumsum(keep)[at] - 1
            ids = merged[keep]
            # the pair that begins at a merged place is gone, and so is the rank at the place that closes up
            ranks = ranks[keep[1:]]
            for i in (places - 1, places):
                i = i[(i >= 0) & (i + 1 < len(ids))]
                ranks[i] = self.rank(ids[i], ids[i + 1])
        return ids.tolist()

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each piece with its ids, in any order."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            w = p.encode("utf-8")
            if (whole := self.ranks.get(w)) is not None:
                yield p, [whole]
            elif len(w) > LONGEST:
                yield p, self.merge_row(w)
            else:
                buckets.setdefault(max(4, 1 << (len(w) - 1).bit_length() if len(w) > 16 else (len(w) + 3) // 4 * 4), []).append((p, w))
        for width, found in buckets.items():
            step = max(1, _CELLS // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                yield from zip((p for p, _ in part), self.merge_matrix([w for _, w in part], width))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and as decimals joined by commas."""
        split = [self.find(t) for t in texts]
        for p, ids in self.encode_pieces(self.memory.missing(split)):
            self.memory.known[p] = (np.array(ids, dtype="<u4").tobytes(), ",".join([self.decimal[i] for i in ids]))
        known = self.memory.known
        found = [[known[p] for p in s] for s in split]
        self.memory.forget()
        return [(b"".join([x[0] for x in s]), ",".join([x[1] for x in s])) for s in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(byte_ranks(path), pattern)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (binary) and decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        hold("bytes")
        bpe = byte_bpe(vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                n, sha, back, own, whole = [], [], [], [], []
                for ids, decimals in bpe.encode(texts[a:b]):
                    decoded = bpe.decode(np.frombuffer(ids, dtype="<u4"))
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        own.append(ids)
                        whole.append(decoded.decode("utf-8"))
                columns = [keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.binary()), pa.array(whole, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
