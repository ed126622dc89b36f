"""Encoding with a byte-level BPE vocabulary by a pair occurrence index.

The distinct pre-tokens of a batch are laid out in one array. An index maps the id of every possible merge to all its
positions in that array; active merges are applied in ascending rank, each at all its positions, and only the lists of
the neighbouring pairs are updated. A pre-token is thus encoded once however often the batch holds it, and the encoded
forms are remembered by the worker, up to ``CACHE_WORDS`` of them.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import env, spread

#: Fixed value: the public pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the public vocabularies lie; a parameter of every query through QUILLSIEVE_TOKENIZERS.
FOLDER = "/opt/tokenizers"
CACHE_WORDS = 400_000
#: Characters handed to one layout, so that the position arrays stay small.
LAYOUT_BYTES = 4_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return f"{folder or env('QUILLSIEVE_TOKENIZERS', FOLDER)}/{name}"


class PairIndexEncoder:
    """Encoder for one vocabulary file (lines of base64 token and rank, the rank being the id)."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.partition(b" ")
                self.ids[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.words: dict[str, array] = {}
        self.split = regex.compile(PATTERN).findall

    def merged(self, a: int, b: int) -> int:
        """The id that the pair merges into, or -1."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.ids.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[(a, b)] = got
        return got

    def encode_layout(self, words: list[str]) -> list[array]:
        """The ids of each word; the words share one layout and one pair index."""
        tok: list[int] = []
        starts: list[int] = []
        single = self.single
        for w in words:
            starts.append(len(tok))
            tok.extend([single[b] for b in w.encode("utf-8", "surrogatepass")])
        n = len(tok)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts:
            if s < n:
                before[s] = -1
                if s:
                    following[s - 1] = -1
        if n:
            following[n - 1] = -1
        index: dict[int, list[int]] = {}
        merged = self.merged
        for p in range(n):
            q = following[p]
            if q >= 0 and (m := merged(tok[p], tok[q])) >= 0:
                index.setdefault(m, []).append(p)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for p in places:
                q = following[p]
                if tok[p] < 0 or q < 0 or merged(tok[p], tok[q]) != rank:
                    continue
                tok[p], tok[q] = rank, -1
                after = following[p] = following[q]
                if after >= 0:
                    before[after] = p
                    self._note(index, active, merged(rank, tok[after]), p)
                if (left := before[p]) >= 0:
                    self._note(index, active, merged(tok[left], rank), left)
        out = []
        for k, s in enumerate(starts):
            ids = array("i")
            p = s if s < (starts[k + 1] if k + 1 < len(starts) else n) else -1
            while p >= 0:
                ids.append(tok[p])
                p = following[p]
            out.append(ids)
        return out

    @staticmethod
    def _note(index: dict[int, list[int]], active: list[int], rank: int, place: int) -> None:
        if rank >= 0:
            if (places := index.get(rank)) is None:
                index[rank] = [place]
                heapq.heappush(active, rank)
            else:
                places.append(place)

    def encode(self, texts: Iterable[str | None]) -> list[array]:
        """The ids of each text; a null and an empty text have none."""
        split, known = [self.split(t) if t else [] for t in texts], self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        new: list[str] = []
        seen: set[str] = set()
        size = 0
        for words in split:
            for w in words:
                if w not in known and w not in seen:
                    seen.add(w)
                    new.append(w)
                    size += len(w)
                    if size > LAYOUT_BYTES:
                        known.update(zip(new, self.encode_layout(new)))
                        new, size = [], 0
                        seen.clear()
        known.update(zip(new, self.encode_layout(new)))
        out = []
        for words in split:
            ids = array("i")
            for w in words:
                ids.extend(known[w])
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexEncoder:
    """The worker's encoder for a vocabulary file."""
    return PairIndexEncoder(path)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _list_column(lists: list[array]) -> pa.ListArray:
    flat, offsets = array("i"), array("i", [0])
    for x in lists:
        flat.extend(x)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens.

    A null and an empty text give an empty list, a null key stays null, repeated rows are each encoded, an empty table
    gives an empty one. Other columns, whatever their names, are not read.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _list_column(enc.encode(b.column(1).to_pylist()))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens): as ``token_ids``, but only how many; 0 for null and empty texts."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in enc.encode(b.column(1).to_pylist())], pa.int64())], [key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
