"""Byte-level BPE by corpus-level merge replay.

Each task collects the distinct pre-tokens of a run of documents that it has not met before, lays
their bytes out as linked symbols, and indexes them: from a pair of token ids to the positions where
the pair stands. Merges are then replayed over all of these words at once, in rank order; a merge
visits only the positions its pair has in the index and re-indexes only the neighbours that it
touches. The ids of each distinct word are kept, so a word is merged once per Python worker and the
documents are put together from them by lookup.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct words that a worker remembers before it starts anew; this bounds memory, not results.
MEMORY_WORDS = 1_000_000
#: Longest word, in characters, that is remembered.
MEMORY_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many words at once under one table of ranks.

    A pair of ids may merge if the concatenated bytes have a rank; the rank is also the id. Of the
    pairs in a word the one of least rank merges first, the leftmost first among equals. Replaying
    ranks over the whole vocabulary gives each word the same result, as words do not touch: a pair
    that a merge creates may have a smaller rank than the one at work, so the heap serves it next.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.text = {v: k for k, v in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of the pair, -1 if it doesn't merge."""
        key = (a, b)
        r = self.joined.get(key)
        if r is None:
            r = self.joined[key] = self.ranks.get(self.text[a] + self.text[b], -1)
        return r

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        ids: list[int] = []
        right: list[int] = []
        left: list[int] = []
        starts: list[int] = []
        whole: dict[int, int] = {}
        single = self.single
        for k, w in enumerate(words):
            starts.append(len(ids))
            if (r := self.ranks.get(w)) is not None:  # a token itself: no merge can end elsewhere
                whole[k] = r
                continue
            at = len(ids)
            ids.extend([single[b] for b in w])
            left.extend(range(at - 1, at + len(w) - 1))
            right.extend(range(at + 1, at + len(w) + 1))
            if w:
                left[at], right[-1] = -1, -1
        index: dict[tuple[int, int], list[int]] = {}
        heap: list[tuple[int, tuple[int, int]]] = []
        known = self.joined
        for i, j in enumerate(right):
            if j >= 0:
                pair = (ids[i], ids[j])
                found = index.get(pair)
                if found is not None:
                    found.append(i)
                    continue
                r = known.get(pair)
                if r is None:
                    r = self.rank(*pair)
                if r >= 0:
                    index[pair] = [i]
                    heap.append((r, pair))
        heapq.heapify(heap)
        while heap:
            r, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            if len(places) > 1:
                places.sort()  # leftmost first: in a run such as aaa the first two merge
            for i in places:
                j = right[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue  # a neighbour has changed since the place was indexed
                ids[i], ids[j] = r, -1
                n = right[i] = right[j]
                right[j] = -1
                if n >= 0:
                    left[n] = i
                    self._add(index, heap, i, r, ids[n])
                p = left[i]
                if p >= 0:
                    self._add(index, heap, p, ids[p], r)
        out = []
        for k, (s, w) in enumerate(zip(starts, words)):
            if k in whole:
                out.append([whole[k]])
                continue
            got, i = [], s if w else -1
            while i >= 0:
                got.append(ids[i])
                i = right[i]
            out.append(got)
        return out

    def _add(self, index, heap, at: int, a: int, b: int) -> None:
        pair = (a, b)
        found = index.get(pair)
        if found is not None:
            found.append(at)
            return
        r = self.joined.get(pair)
        if r is None:
            r = self.rank(a, b)
        if r >= 0:
            index[pair] = [at]
            heapq.heappush(heap, (r, pair))


class Encoder:
    """Whole texts to ids, by way of their distinct pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find = MergeReplay(ranks), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.bytes_of = self.replay.text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.known) > MEMORY_WORDS:
            self.known = {}
        known = self.known
        new = list(set().union(*split) - known.keys())
        local = {}
        for w, ids in zip(new, self.replay.encode_words([w.encode() for w in new])):
            packed = b"".join([i.to_bytes(4, "little") for i in ids])
            (known if len(w) <= MEMORY_CHARS else local)[w] = packed
        for words in split:
            if local:
                yield b"".join([known[w] if w in known else local[w] for w in words])
            else:
                yield b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[tuple, Encoder] = {}


def _encoder(packed: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary, kept for its next tasks."""
    key = (hashlib.sha256(packed).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.splitlines() if x.strip())}
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encodes each text and decodes the ids again: (id, ids array<int>, decoded binary) or, with
    digests, (id, n_tokens, ids_sha256, decoded_sha256), which saves moving the ids.

    Null and empty texts have no ids and decode to no bytes. Rows are independent: repeated rows and
    null ids come back as they are. Other columns of docs are not read. The driver reads the rank
    file (bounded by the vocabulary) and ships it with the task.
    """
    with open(ranks_path, "rb") as f:
        packed = f.read()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(packed, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, plain = [], []
            for x in enc.encode(texts):
                back = enc.decode(x)
                ids.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back).hexdigest()) if digests else list(memoryview(x).cast("I")))
                plain.append(back)
            if digests:
                n, one, two = zip(*ids) if ids else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.binary())], names=["id", "ids", "decoded"])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return src.mapInArrow(run, f"id {kind}, {rest}").withColumnRenamed("id", id_col)
