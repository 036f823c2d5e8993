"""Encoding of texts with a byte-level BPE vocabulary: speculate by longest match, verify adjacent pairs, merge the rest."""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# How the vocabulary's texts are cut into words before merging. Fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Words and pairs a Python worker remembers; when full, it starts afresh.
REMEMBERED = 500_000
LONGEST_WORD = 64

_loaded: dict[str, SpeculativeBpe] = {}


class SpeculativeBpe:
    """Token ids of byte strings. ``ranks`` maps each token's bytes to its id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes = {i: t for t, i in ranks.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)

    @classmethod
    def load(cls, path: str) -> SpeculativeBpe:
        with open(path, "rb") as f:
            return cls.parse(path, f.read())

    @classmethod
    def parse(cls, name: str, ranks: bytes) -> SpeculativeBpe:
        """From lines of a token in base 64 and its id; kept under ``name`` in this process."""
        if name not in _loaded:
            _loaded[name] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
        return _loaded[name]

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: of all adjacent parts the pair with the lowest rank is joined, the leftmost first."""
        n, ranks = len(word), self.ranks
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def _guess(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        while i < n:
            for stop in range(min(n, i + self.longest), i, -1):
                if (t := self.ranks.get(word[i:stop])) is not None:
                    out.append(t)
                    i = stop
                    break
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each code left * 2**32 + right: whether merging both tokens' bytes gives the two tokens again."""
        codes, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, codes)
        new = codes[(at >= len(self.known)) | (self.known[np.minimum(at, max(0, len(self.known) - 1))] != codes)] if len(self.known) else codes
        if len(new):
            ok = [self.merged(self.bytes[a] + self.bytes[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())]
            known, fits = np.concatenate([self.known, new]), np.concatenate([self.fits, np.array(ok, bool)])
            order = np.argsort(known)
            self.known, self.fits = known[order], fits[order]
        found = self.fits[np.searchsorted(self.known, codes)][where]
        if len(self.known) > REMEMBERED:
            self.known, self.fits = self.known[:0], self.fits[:0]
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words not yet remembered. A guess is right if all its adjacent pairs are compatible."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self._guess(w) for w in raw]
        sizes = np.array([len(g) for g in guesses])
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(flat), bool)
        inner[first] = False
        right = np.flatnonzero(inner)
        fine = np.ones(len(flat), bool)
        if len(right):
            fine[right] = self._compatible(flat[right - 1] << 32 | flat[right])
        whole = np.logical_and.reduceat(fine, first)
        for w, b, g, ok in zip(words, raw, guesses, whole.tolist()):
            self.words[w] = tuple(g) if ok else tuple(self.merged(b))

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """For each text its words' token ids; none for null and empty texts."""
        cut = regex.compile(WORDS)
        split = [cut.findall(t) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = {w for ws in split for w in ws if w not in self.words}
        if new:
            self.learn(list(new))
        out = [[self.words[w] for w in ws] for ws in split]
        for w in new:
            if len(w) > LONGEST_WORD:
                del self.words[w]
        return out


def encode_texts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ids (array of int), one row per row of ``docs``; null and empty texts get an
    empty array.

    Whole texts are encoded, blank ones to the tokens of their spaces; no special token is added or recognised. The
    work is one pass over the documents, each row on its own, so that no repeated text or word needs a shuffle;
    workers remember words. ``vocabulary`` is a path that the driver can read; the file, of some hundred kilobytes, is
    broadcast.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = SpeculativeBpe.parse(vocabulary, raw.value)
        for b in batches:
            # Some hundred texts at a time, so that one batch's words never fill the memory.
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                docs_ = bpe.encode(part.column(1).to_pylist())
                lengths = [sum(map(len, d)) for d in docs_]
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(docs_)), np.int32, sum(lengths))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, *keep, "ids"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{kinds}, ids array<int>")
