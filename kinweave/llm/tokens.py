"""Whole texts to token ids, with caches of bounded size in each Python worker."""

from __future__ import annotations

import base64
import ctypes
import gc
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa

#: Distinct words that a worker remembers.
CACHED_WORDS = 350_000
#: Words whose ids a worker remembers.
WORDS_WITH_IDS = 500_000
#: Characters that are worked on at once.
SLICE_CHARS = 2_000_000
#: Words whose places are worked on at once; only a text longer than a slice has more.
WORDS_AT_ONCE = 4_000_000
#: A noncharacter: no text of any language holds it, and words that do are encoded one by one.
_MARK = "\ufdd0"


#: Documents in one Arrow batch between the JVM and Python. Texts are long, so Spark's default of 10,000 takes much memory.
BATCH_DOCS = 1000


def small_batches(df):
    """`df`, after lowering the session's Arrow batches to BATCH_DOCS rows where they are larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_DOCS:
        conf.set(name, BATCH_DOCS)
    return df


_holder = ""


def hold(owner: str) -> None:
    """Called where a task begins. A worker serves one operator after another: the caches of the one before go."""
    global _holder
    if owner != _holder:
        _holder = owner
        word_encoder.cache_clear()
        if (other := sys.modules.get("kinweave.llm.bytebpe")) is not None:
            other.byte_bpe.cache_clear()
        trim()


def trim() -> None:
    """Called where a task ends: freed memory goes back to the system, where the C library offers that."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def vocabulary_path(name: str) -> str:
    """The file of a public tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `most` characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Memory:
    """A bounded dictionary of words; when it is full, only words met in more than one slice stay."""

    def __init__(self, most: int = CACHED_WORDS, longest: int = 200):
        self.most, self.longest, self.known, self.again, self.brief = most, longest, {}, set(), []

    def missing(self, split: list[list[str]]) -> list[str]:
        """The words of a slice that are not known; `known` has room for them."""
        words = set().union(*split)
        new = words.difference(self.known)
        self.again |= words - new
        if len(self.known) + len(new) > self.most:
            keep = self.again if len(self.again) + len(new) <= self.most else self.again & words
            self.known, self.again = {w: self.known[w] for w in keep}, set()
        self.brief = [w for w in new if len(w) > self.longest]
        return list(new)

    def forget(self) -> None:
        """Drop the long words of the slice."""
        for w in self.brief:
            del self.known[w]


class WordIds:
    """Ids of a bounded number of words, in one array; when it is full, only words met in more than one slice stay."""

    def __init__(self, most: int = WORDS_WITH_IDS, longest: int = 200):
        self.most, self.longest, self.brief = most, longest, []
        #: The place of each word; places ascend as the words were added.
        self.known: dict[str, int] = {}
        self.ids, self.bounds, self.again = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def __getitem__(self, word: str) -> bytes:
        at = self.known[word]
        return self.ids[self.bounds[at] : self.bounds[at + 1]].tobytes()

    def find(self, words: list[str]) -> np.ndarray:
        """The places of the distinct words of a slice, -1 where one is not known; there is room for those."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        met = at >= 0
        self.again[at[met]] = True
        new = len(words) - int(met.sum())
        if len(self.known) + new > self.most:
            keep = self.again
            if int(keep.sum()) + new > self.most:
                keep = np.zeros(len(self.known), bool)
                keep[at[met]] = True
            at[met] = (np.cumsum(keep) - 1)[at[met]]
            n = np.diff(self.bounds)
            self.known = {w: i for i, w in enumerate(compress(self.known, keep.tolist()))}
            self.ids, self.bounds, self.again = self.ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), np.zeros(len(self.known), bool)
        return at

    def add(self, found: dict[str, bytes]) -> None:
        """Remember new words; long ones come last, for forget()."""
        self.brief = [w for w in found if len(w) > self.longest]
        words = [*(w for w in found if len(w) <= self.longest), *self.brief] if self.brief else list(found)
        raw = [found[w] for w in words]
        self.known.update(zip(words, count(len(self.known))))
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n)])
        self.again = np.concatenate([self.again, np.zeros(len(raw), bool)])

    def forget(self) -> None:
        """Drop the long words of the slice."""
        for w in self.brief:
            del self.known[w]
        if self.brief:
            self.brief, left = [], len(self.known)
            self.bounds, self.again = self.bounds[: left + 1].copy(), self.again[:left].copy()
            self.ids = self.ids[: self.bounds[-1]].copy()


def ragged(values: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[b : b + k] for each b and k of `begins` and `n`, one after another."""
    ends = np.cumsum(n)
    return values[np.repeat(begins - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


#: Characters beyond Latin, whose lower case or composition may depend on their neighbours, and control characters.
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f]")
#: A full stop or comma beside another mark, with which it forms one piece.
_RUN = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))")
#: Where a run of marks follows a letter: a piece always begins there.
_AFTER_LETTER = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])(?=[!-/:-@\\[-`{-~])")


#: Words of these alone (lower-case Latin letters, ASCII digits and marks) are taken apart here as the pre-tokenizer does.
_PLAIN = re.compile("[!-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")


def _spaced(text: str) -> str:
    """A text whose parts between spaces a lower-casing, space-dropping pre-tokenizer takes apart as well."""
    latin = not any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) if text.isascii() else _OTHER.search(text) is None
    if latin:
        text = text.lower()
        text = text.replace(".", " .").replace(",", " ,") if _RUN.search(text) is None else _AFTER_LETTER.sub(" ", text)
    return text.replace("\n", " ")


class WordEncoder:
    """Ids of whole texts by a vocabulary of the tokenizers library that lower-cases and drops white space.

    Its pre-tokenizer never joins what a space or line feed separates, so the words between them are encoded once
    each and their ids joined; Latin words are told apart from the marks behind them and lower-cased before, so that
    fewer are distinct. A text that may hold the string of an added token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begins = sorted({t[0] if not t[0].isalnum() else t for t in added})
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.memory = WordIds()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # bytes that no character shows become characters from 256 on, in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_level = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        probe = "ab12.-c's_\u00e9d'"
        pieces = [p.encode().decode("latin-1").translate(self.byte_level) for p in _PIECES.findall(probe)]
        self.plain = pieces == [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        self.mark = np.array(self.tokenizer.encode(_MARK, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words and of what they are made of, many encoded in one call."""
        found: dict[str, bytes] = {}
        if not self.ends.any():
            self._learn_marked(words, found)
            return found
        plain, apart, rest = [], {}, []
        for w in words:
            if not self.plain or not _PLAIN.fullmatch(w):
                rest.append(w)
            elif w.isalpha():
                plain.append(w)
            else:
                apart[w] = _PIECES.findall(w)
        # letters, digits and marks that a word is made of: often known, and nothing is left to normalise in them
        parts = set().union(*apart.values())
        known = {p: self.memory[p] for p in parts if p in self.memory.known}
        self._learn_pieces(plain + list(parts.difference(known, plain)), found)
        for w, pieces in apart.items():
            found[w] = b"".join([known[p] if p in known else found[p] for p in pieces])
        self._learn_letters([w for w in rest if w.isalpha()], found)
        self._learn_marked([w for w in rest if not w.isalpha()], found)
        return found

    def _learn_pieces(self, pieces: list[str], found: dict[str, bytes]) -> None:
        """Lower-case pieces as the pre-tokenizer would leave them: by the model alone."""
        ids, ends, tokens = [], [], self.tokenizer.model.tokenize
        for p in pieces:
            ids += [t.id for t in tokens(p if p.isascii() else p.encode().decode("latin-1").translate(self.byte_level))]
            ends.append(4 * len(ids))
        self._keep(pieces, np.array(ids, dtype="<u4").tobytes(), [0, *ends], ends, found)

    def _learn_letters(self, words: list[str], found: dict[str, bytes]) -> None:
        """Words of letters only are one piece each, and the last id of a piece ends a word."""
        for part, e in self._encode_joined(words, " "):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                self._keep(part, ids.tobytes(), [0, *(at[:-1] * 4).tolist()], (at * 4).tolist(), found)
            else:
                self._learn_marked(part, found)

    def _learn_marked(self, words: list[str], found: dict[str, bytes]) -> None:
        """Any words: with a mark between them, by which their ids are told apart."""
        alone = [w for w in words if _MARK in w]
        for w in alone:
            found[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        k = len(self.mark)
        for part, e in self._encode_joined([w for w in words if _MARK not in w] if alone else words, f" {_MARK} "):
            ids = np.array(e.ids, dtype="<u4")
            n = len(ids) - k + 1
            at = np.flatnonzero(np.logical_and.reduce([ids[i : n + i] == m for i, m in enumerate(self.mark)])) if n > 0 else np.zeros(0, int)
            if len(at) != len(part) - 1:
                raise ValueError("the vocabulary joins what white space separates")
            self._keep(part, ids.tobytes(), [0, *((at + k) * 4).tolist()], [*(at * 4).tolist(), 4 * len(ids)], found)

    def _encode_joined(self, words: list[str], between: str) -> Iterator[tuple[list[str], object]]:
        parts = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        yield from zip(parts, self.tokenizer.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False))

    def _keep(self, words: list[str], raw: bytes, begins: list[int], ends: list[int], found: dict[str, bytes]) -> None:
        for w, a, b in zip(words, begins, ends):
            found[w] = raw[a:b]

    def _encode_spaced(self, raw: bytes, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that a space follows each; how many ids are before each word that `after` counts."""
        begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20) + 1])
        out, counts = [], [np.zeros(1, np.int64)]
        for a in range(0, len(begins) - 1, WORDS_AT_ONCE):
            part = begins[a : a + WORDS_AT_ONCE + 1]
            # each distinct word is looked up once; its ids are copied to its places below
            coded = pa.LargeStringArray.from_buffers(len(part) - 1, pa.py_buffer(part), pa.py_buffer(raw)).dictionary_encode()
            distinct = coded.dictionary.buffers()[2].to_pybytes().decode().split(" ")[:-1]
            at = self.memory.find(distinct)
            if new := [distinct[i] for i in np.flatnonzero(at < 0).tolist()]:
                self.memory.add(self._learn(new))
                at[at < 0] = [self.memory.known[w] for w in new]
            begin = self.memory.bounds[at]
            n = self.memory.bounds[at + 1] - begin
            ids, begin = ragged(self.memory.ids, begin, n), np.cumsum(n) - n
            self.memory.forget()
            word = coded.indices.to_numpy()
            out.append(ragged(ids, begin[word], n[word]))
            counts.append(np.cumsum(n[word]) + counts[-1][-1])
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.concatenate(counts)[after]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another as little-endian unsigned 32-bit integers, and where those of each text end."""
        whole = {i for i, t in enumerate(texts) if any(map(t.__contains__, self.begins)) and self.added.search(t)}
        spaced = [b"" if i in whole else _spaced(t).encode() + b" " for i, t in enumerate(texts)]
        ids, ends = self._encode_spaced(b"".join(spaced), np.cumsum([s.count(b" ") for s in spaced], dtype=np.int64))
        if whole:
            parts = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat(texts)
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
