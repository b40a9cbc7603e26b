"""Jaccard join on word shingles by T-occurrence search (DivideSkip).

1. Every document becomes its set of hashed shingles. Documents with equal sets form a class; the
   smallest id stands for it.
2. Candidates: the hash space is cut into m ranges, some more than the d shingles by which two linked
   sets of that size can differ. Linked sets then agree on m - d ranges. What of each range a document
   has is one fixed-size entry, merged per task before the shuffle, so a hot range is one entry of each
   task. A document that shares fewer than m - d of its ranges with any others links with nothing and
   is done with; the rest, few, are joined into blocks where they agree on a range. Since linked sets
   agree on m - d, each document leaves out the m - d - 1 of its ranges that most documents share, in one
   order for all: of what two linked sets share, the rarest stays in both. So a passage that many
   documents quote ties no block together.
3. Within a block, inverted lists from shingle to documents answer for each document which others share
   T shingles: short lists are merged by a heap that skips ahead, long ones are probed by binary search
   for what the merge left over. Only links that join two components are reported, and each is checked
   on the words themselves.
4. Components of the links.

A block that is too large for a task is cut anew with other ranges, again and again. If it stays too large
it is dealt into parts. Each part is searched by itself, then the least documents of the components so found are
compared; what then still stands outside a block's largest component is compared with all of the block,
part by part. Memory is bounded, every pair that could join two components meets, and a large group of
near copies costs its size, not the square of it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, Scratch
from .components import connected_components

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
U = np.uint64
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: The first n bytes of eight.
ONE = np.ones(1, bool)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Shingles that the documents of a block hold at most in one task.
BLOCK = 250_000
#: Times that blocks are cut, each time with other ranges, before those still too large are dealt into parts.
CUTS = 4
#: Entries that a task collects before it hands them on, and that it unpacks at a time.
ENTRIES = 400_000
#: Bytes from which a word is hashed on its own.
LONG = 256
#: Postings up to which short lists go through the heap; more are merged by counting, to the same outcome.
HEAP = 20_000
#: Orders by which the documents of a block are laid side by side before the search.
SWEEPS = 4


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than \\x20 and \\t to \\r, A-Z lower-cased."""
    return (text or "").encode().translate(LOWER).split()


def word_hashes(text: str | None) -> np.ndarray:
    """64 bits for each word of a text, by eight bytes at a time, each mixed into what came before. Words of
    up to eight bytes and one length have hashes of their own; long ones take theirs from BLAKE2b."""
    raw = (text or "").encode().translate(LOWER)
    b = np.frombuffer(raw + bytes(8), np.uint8)
    edge = np.flatnonzero(np.diff(BLANK[b[: len(raw)]].view(np.int8), prepend=1, append=1))
    at, ends = edge[::2], edge[1::2]
    size = ends - at
    eight = np.ndarray((len(raw) + 1,), "<u8", b, strides=(1,))  # the eight bytes from each place on
    h = mix((eight[at] & MASKS[np.minimum(size, 8)]) ^ (size.astype(U) * U(BASE)))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    step = 8
    while len(more):
        h[more] = mix(h[more] ^ (eight[at[more] + step] & MASKS[np.minimum(size[more] - step, 8)]))
        step += 8
        more = more[size[more] > step]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[at[k] : ends[k]], digest_size=8).digest(), "little")
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h if keep.all() else h[keep]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; of all its words if they are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for i in range(k):
        h = h * U(0x2545F4914F6CDD1D) + w[i : len(w) - k + 1 + i]
    return distinct(mix(h))


def linked(a: str, b: str, words: int, num: int, den: int) -> bool:
    """Whether two texts link, by the words of their shingles."""
    x, y = ({tuple(w[i : i + min(words, len(w))]) for i in range(len(w) - min(words, len(w)) + 1)} for w in (words_of(a), words_of(b)))
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both) > 0


def set_key(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


class Ranges:
    """How sets of given sizes are cut. Sets of sizes n and up to n / threshold can link, so sizes are
    grouped in levels, and each set is cut at its own level and at those of larger ones in reach. At a level, linked sets differ in no more than d shingles; of d + 1 + z ranges
    they agree on more than z. A set with more than z empty ranges could agree on empty ones alone;
    it agrees with such sets only, and gets its first shingles as further entries."""

    RATIO = 0.7

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.known: dict[int, tuple[int, int]] = {}

    def levels(self, n: int) -> list[int]:
        at = lambda x: int(math.log(x) / -math.log(self.RATIO) + 1e-9)
        return list(range(at(n), at(n * self.den // self.num) + 1))

    def cuts(self, level: int) -> tuple[int, int]:
        """(ranges, empty ones allowed)."""
        if level not in self.known:
            top = int(self.RATIO ** -(level + 1)) + 1
            d = 2 * top * (self.den - self.num) // (self.den + self.num)
            low = self.RATIO**-level * self.num / self.den
            z = 2 + math.ceil(2 * (d + 1) * math.exp(-low / (d + 1)))
            self.known[level] = d + 1 + z, z
        return self.known[level]

    def entries(self, s: np.ndarray, seed: int = 0) -> list[tuple[int, np.ndarray, int]]:
        """(level, 64-bit entries, how many of them a set shares with one that it links with)."""
        out = []
        h = s if not seed else np.sort(mix(s ^ U(seed * 0x9E3779B9)))
        spread, high = mix(h + U(1)), h >> U(32)
        for level in self.levels(len(s)):
            m, z = self.cuts(level)
            at = high * U(m) >> U(32)  # range of each, ascending as the hashes are
            first = np.flatnonzero(np.concatenate((ONE, at[1:] != at[:-1])))
            sig = mix(np.add.reduceat(spread, first) ^ (at[first] + U(level << 32)) * U(0xD1342543DE82EF95))
            share = z + 1 - (m - len(sig))
            if share < 1:
                need = -(-self.num * len(s) // self.den)
                sig = np.concatenate((sig, mix(h[: len(h) - need + 1] ^ U((level << 8) + 255))))
            out.append((level, sig, max(1, share)))
        return out


def _shared(ranges: Ranges, words: int, parts: int):
    """Entries by part, packed for counting: (part, kind, a, b, ids). Kind 0: five bytes of each entry,
    place of its document in ids, and level with 128 added if the document was seen to share it. Kind 1:
    (document, level, number of entries) that were seen to be shared within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, levels, n = [], [], [], 0

        def flush():
            h, d, v = np.concatenate(hashes), np.concatenate(docs), np.concatenate(levels)
            order = np.argsort(h)
            h, d, v = h[order], d[order], v[order]
            first, size, many = _many(h, d)
            flag = v[first] | np.where(many[first], np.uint8(128), np.uint8(0))
            part = ((h[first] >> U(32)) % U(parts)).astype(np.int32)
            rows = []
            if many.any():
                key, count = _summed([np.stack((d[many], v[many].astype(np.int64)), 1)], [np.ones(int(many.sum()), np.int64)])
                rows.append((int(part[0]), 1, key[:, 0].tobytes(), np.stack((key[:, 1], count), 1).astype(np.int32).tobytes(), b""))
            h, d = h[first], d[first]
            order = np.argsort(part, kind="stable")
            here, cut = np.unique(part[order], return_index=True)
            cut = np.append(cut, len(order))
            low = h.view(np.uint8).reshape(-1, 8)[:, :5][order]
            d, flag = d[order], flag[order]
            for p, x, y in zip(here.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                ids, at = np.unique(d[x:y], return_inverse=True)
                rows.append((p, 0, low[x:y].tobytes(), np.rec.fromarrays((at.astype(np.uint32), flag[x:y]), dtype=[("i", "<u4"), ("f", "u1")]).tobytes(), ids.tobytes()))
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 512]), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "kind", "a", "b", "ids"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(t.as_py(), words)
                for level, e, _ in ranges.entries(s) if len(s) else ():
                    hashes.append(e)
                    docs.append(np.full(len(e), i, np.int64))
                    levels.append(np.full(len(e), level, np.uint8))
                    n += len(e)
                if n > ENTRIES:
                    yield from flush()
                    hashes, docs, levels, n = [], [], [], 0
        if n:
            yield from flush()

    return run


def _many(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted entries: where each begins, how often it is there, and for each place whether documents
    share it. An entry that one document has twice is not shared."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    return first, size, np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), size)


def _summed(key: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (id, level) rows and the sums of their counts."""
    k, n = np.concatenate(key), np.concatenate(count)
    order = np.lexsort((k[:, 1], k[:, 0]))
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))
    return k[first], np.add.reduceat(n, first)


def _count_shared(parts: int):
    """Entries that a document shares, as far as this task's parts tell, from packed entries sorted by part:
    (part, ids and levels, counts), packed by the part that adds a document's counts up. One part is
    unpacked at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, parts)

    return run


def _counted(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    keys, counts, part, packs = [], [], None, []

    def close():
        h = np.concatenate([np.pad(np.frombuffer(a, np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view("<u8").ravel() for a, _, _ in packs])
        recs = [np.frombuffer(b, [("i", "<u4"), ("f", "u1")]) for _, b, _ in packs]
        d = np.concatenate([np.frombuffer(ids, np.int64)[r["i"]] for r, (_, _, ids) in zip(recs, packs)])
        f = np.concatenate([r["f"] for r in recs])
        order = np.argsort(h)
        h, d, f = h[order], d[order], f[order]
        many = _many(h, d)[2] & (f < 128)
        if many.any():
            k, n = _summed([np.stack((d[many], (f[many] & 127).astype(np.int64)), 1)], [np.ones(many.sum(), np.int64)])
            keys.append(k)
            counts.append(n)

    def flush():
        k, n = _summed(keys, counts)
        where = ((k[:, 0].view(U) * U(BASE)) >> U(32)) % U(parts)
        order = np.argsort(where, kind="stable")
        some, cut = np.unique(where[order], return_index=True)
        cut = np.append(cut, len(order))
        k, n = k[order], n[order]
        for x in range(0, len(some), 512):
            own = range(x, min(x + 512, len(some)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[x : x + 512].astype(np.int32)), pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()), pa.array([n[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in own], pa.binary())], names=["part", "k", "n"]
            )

    for batch in batches:
        for p, kind, a, b, ids in zip(*batch.columns):
            p, a, b = p.as_py(), a.as_py(), b.as_py()
            if kind.as_py():
                pairs = np.frombuffer(b, np.int32).reshape(-1, 2).astype(np.int64)
                keys.append(np.stack((np.frombuffer(a, np.int64), pairs[:, 0]), 1))
                counts.append(pairs[:, 1])
                continue
            if p != part and packs:
                close()
                packs.clear()
            part = p
            packs.append((a, b, ids.as_py()))
        if sum(map(len, counts)) > ENTRIES:
            yield from flush()
            keys.clear(), counts.clear()
    if packs:
        close()
    if keys:
        yield from flush()


def _add_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, level, got) from packed counts, part by part."""
    part, keys, counts = None, [], []

    def close():
        k, n = _summed(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1].astype(np.int32)), pa.array(n)], names=["id", "level", "got"])

    for batch in batches:
        for p, k, n in zip(*batch.columns):
            if (p := p.as_py()) != part and keys:
                yield close()
                keys.clear(), counts.clear()
            part = p
            keys.append(np.frombuffer(k.as_py(), np.int64).reshape(-1, 2))
            counts.append(np.frombuffer(n.as_py(), np.int32).astype(np.int64))
            if sum(map(len, counts)) > ENTRIES:  # what the tasks counted, summed early
                k, n = _summed(keys, counts)
                keys[:], counts[:] = [k], [n]
    if keys:
        yield close()


def _entries(ranges: Ranges, words: int, seed: int):
    """(entry, id, row, need) of every document, entries of different blocks kept apart; row: a text's set at
    one level, need: how many of its entries it shares with any that it links with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids, rows, needs = [], [], [], []
            for i, t, g in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(t, words)
                for level, e, need in ranges.entries(s, seed):
                    out.append(mix(e ^ U(g * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
                    ids.append(np.full(len(e), i, np.int64))
                    rows.append(np.full(len(e), set_key(s)[0] ^ level, np.int64))
                    needs.append(np.full(len(e), need, np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *[pa.array(np.concatenate(c)) for c in (ids, rows, needs)]], names=["e", "id", "row", "need"])

    return run


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Numbers that are in `least` of the ascending lists or more, and in how many: the heads of all lists lie in a heap.
    Where fewer lists agree on the top, as many more are taken off as make `least` - 1, and these jump
    to the new top by binary search, since nothing before it can be in enough lists."""
    heads = [(x[0], k) for k, x in enumerate(lists) if x]
    at = [0] * len(lists)
    heapq.heapify(heads)
    found = []
    while len(heads) >= least:
        top = heads[0][0]
        off = []
        while heads and heads[0][0] == top:
            off.append(heapq.heappop(heads)[1])
        if len(off) >= least:
            found.append((top, len(off)))
            for k in off:
                at[k] += 1
        else:
            while heads and len(off) < least - 1:
                off.append(heapq.heappop(heads)[1])
            if not heads:
                break
            to = heads[0][0]
            for k in off:
                at[k] = bisect_left(lists[k], to, at[k])
        for k in off:
            if at[k] < len(lists[k]):
                heapq.heappush(heads, (lists[k][at[k]], k))
    return found


def t_occurrence_links(ids: list[int], texts: list[str], words: int, num: int, den: int, labels: list[int] | None = None, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) of a block that join two of its components, by DivideSkip. labels: components known
    before. With side, only documents of different sides are compared. Documents of the largest component
    are no queries: what links with them finds them."""
    sets = [shingle_set(t, words) for t in texts]
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets, texts = [ids[k] for k in order], [sets[k] for k in order], [texts[k] for k in order]
    side = np.array([side[k] for k in order]) if side else None
    sizes = np.array([len(s) for s in sets])
    label = np.array([labels[k] for k in order]) if labels else np.array(ids)
    links: list[tuple[int, int]] = []
    n = len(ids)

    def join(p: int, q: int) -> None:
        """After the hashes agree: the words decide."""
        if linked(texts[p], texts[q], words, num, den):
            links.append((ids[q], ids[p]))
            a, b = int(label[p]), int(label[q])
            label[label == max(a, b)] = min(a, b)

    for sweep in range(SWEEPS):  # near copies stand side by side in some order of their least hashes
        key = np.array([mix(s ^ U(0x9E3779B97F4A7C15 * (sweep + 1) & 0xFFFFFFFFFFFFFFFF)).min() if len(s) else 0 for s in sets], U)
        row = np.lexsort((np.arange(n), key))
        for k in np.flatnonzero((key[row[1:]] == key[row[:-1]]) & (label[row[1:]] != label[row[:-1]])).tolist():
            p, q = int(row[k]), int(row[k + 1])
            if label[p] != label[q]:
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both and den * both >= num * (len(sets[p]) + len(sets[q]) - both):
                    join(p, q)
    names, many = np.unique(label, return_counts=True)
    if len(names) == 1:
        return links
    ask = label != names[np.argmax(many)]

    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    token = np.concatenate(sets)
    by = np.lexsort((owner, token))
    owner, token = owner[by], token[by]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    df = np.diff(np.append(start, len(token)))
    keep = df > 1
    vocab, start, df = token[start[keep]], start[keep], df[keep]
    del token, by
    place = np.repeat(np.arange(len(vocab)), df) * n  # (list, document) as one number: long lists are probed in it
    postings = place + owner[np.repeat(start, df) + np.arange(len(place)) - np.repeat(np.cumsum(df) - df, df)]
    for q in np.flatnonzero(ask).tolist():
        size = int(sizes[q])
        at = np.searchsorted(vocab, sets[q])
        at = at[vocab[np.minimum(at, len(vocab) - 1)] == sets[q]] if len(vocab) else at[:0]
        least = -(-num * size // den)  # of the smallest partner
        need = -(-num * (size + least) // (den + num))
        if len(at) < need:
            continue
        lists = at[np.argsort(df[at], kind="stable")]
        long = min(need - 1, int(need / (0.0085 * math.log2(max(2, int(df[lists[-1]]))) + 1)))
        short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
        lo, hi = int(np.searchsorted(sizes, least)), int(np.searchsorted(sizes, size * den // num, "right"))
        want = need - long
        listed = lambda some: np.concatenate([owner[start[t] : start[t] + df[t]] for t in some.tolist()])
        if int(df[short].sum()) <= HEAP:
            got = np.array(merge_skip([owner[start[t] : start[t] + df[t]].tolist() for t in short.tolist()], want), np.int64).reshape(-1, 2)
            found, have = got[:, 0], got[:, 1]
        else:
            have = np.bincount(listed(short), minlength=n)
            found = np.flatnonzero(have >= want)
            have = have[found]
        ok = (found >= lo) & (found < hi) & (label[found] != label[q]) & ((found < q) | ~ask[found])  # two that both ask meet once
        ok &= have + len(rest) >= -(-num * (size + sizes[found]) // (den + num))
        if side is not None:
            ok &= side[found] != side[q]
        found, have = found[ok], have[ok]
        if len(found) and len(rest):  # long lists: probed by binary search, or run through where that is less
            if len(found) * len(rest) <= int(df[rest].sum()):
                probe = (rest[None, :] * n + found[:, None]).ravel()
                spot = np.minimum(np.searchsorted(postings, probe), len(postings) - 1)
                have = have + (postings[spot] == probe).reshape(len(found), -1).sum(1)
            else:
                have = have + np.bincount(listed(rest), minlength=n)[found]
        for k in found[have >= -(-num * (size + sizes[found]) // (den + num))].tolist():
            if label[k] != label[q]:
                join(k, q)
    return links


def _search(num: int, den: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, labels, side = None, [], [], [], []
        links: list[tuple[int, int]] = []

        def close():
            if len(ids) > 1:
                links.extend(t_occurrence_links(ids, texts, words, num, den, labels, side if key[1] != key[2] else None))

        def out():
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for block, i, j, part, doc, label, text in zip(*(c.to_pylist() for c in b.columns[:-1]), b.column(6)):
                if (block, i, j) != key:
                    close()
                    key, ids, texts, labels, side = (block, i, j), [], [], [], []
                ids.append(doc)
                texts.append(text.as_py())
                labels.append(label)
                side.append(part)
            if len(links) > 10_000:
                yield out()
                links = []
        close()
        yield out()

    return run


def _blocks(src: DataFrame, scratch: Scratch, ranges: Ranges, words: int, seed: int) -> DataFrame:
    """node, component over documents (id, text, block) of a block that share an entry."""
    entries = scratch.put(src.select("id", "text", "block").mapInArrow(_entries(ranges, words, seed), "e long, id long, row long, need int"))
    shared = lambda d: d.groupBy("e").agg(F.min("id").alias("b"), F.max("id").alias("z"), F.count("*").alias("docs")).where("b <> z")
    often = scratch.put(shared(entries).select("e", "docs"))
    # entries that no other document has are the rarest, and are of no use
    ranked = entries.join(often, "e").withColumn("rank", F.row_number().over(Window.partitionBy("id", "row").orderBy(F.desc("docs"), "e")))
    rare = scratch.put(ranked.where("rank >= need").select("e", "id"))
    scratch.drop(entries, often)
    scratch.forget()
    heads = scratch.put(shared(rare).select("e", "b"))
    edges = rare.join(heads, "e").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    found = connected_components(edges, scratch)
    scratch.drop(rare, heads)
    scratch.forget()
    return found


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id: for each distinct key of docs (key) a long that orders like the keys."""
    return scratch.put(docs.where("key is not null").select("key").distinct().orderBy("key").withColumn("id", F.monotonically_increasing_id()))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id, the smallest id that can be reached
    by links. Two documents link if den * common shingles >= num * all their shingles.

    Words are runs of other than blanks (\\x20, \\t to \\r), A-Z lower-cased. With fewer than `words`
    words all of them are one shingle. Null, empty and blank texts have no shingles and link with
    nothing, so their component is their own id. Whole numbers as ids are compared as numbers, ids of
    any other type that can be sorted in their own order. Shingles are told apart by 64-bit hashes,
    links are confirmed on the words. Rows that repeat an id are one document: links
    of any of them count, and each comes back. Rows without an id link with nothing and have no
    component. An empty table gives an empty result. Other columns of docs are not read.
    """
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    scratch = Scratch(docs.sparkSession, "jaccard")
    if whole:
        return _components(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), scratch, words, num, den, block).toDF(id_col, "n_shingles", "component_id")
    plain = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    names = _numbered(plain, scratch)
    found = _components(plain.join(names, "key", "left").select("id", "text"), scratch, words, num, den, block)
    got = found.join(names, "id", "left").join(names.select(F.col("key").alias("least"), F.col("id").alias("component_id")), "component_id", "left")
    return got.select("key", "n_shingles", "least").toDF(id_col, "n_shingles", "component_id")


def _components(src: DataFrame, scratch: Scratch, words: int, num: int, den: int, block: int) -> DataFrame:
    """id, n_shingles, component over src (id: long, text)."""
    ranges = Ranges(num, den)

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                need = [(v, k, len(e)) for v, e, k in ranges.entries(s)] if len(s) else []
                rows.append((len(s), *set_key(s), sum(m for _, _, m in need), [v for v, _, _ in need], [k for _, k, _ in need]))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.list_(pa.int32())) for c in cols[4:]]], names=["id", "n", "k1", "k2", "entries", "levels", "needs"])

    sized = scratch.put(src.mapInArrow(classes, "id long, n long, k1 long, k2 long, entries long, levels array<int>, needs array<int>"))
    # the smallest id of equal sets stands for them
    heads = scratch.put(sized.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("head")))
    member = scratch.put(sized.join(heads, ["n", "k1", "k2"], "left").select("id", "n", "head", "levels", "needs"))
    entries = sized.agg(F.sum("entries")).first()[0] or 0
    scratch.drop(sized, heads)
    scratch.forget()
    same = member.where("head is not null and head <> id").select(F.col("id").alias("a"), F.col("head").alias("b"))

    known = src.where("id is not null")
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = parts * min(4096, -(-2 * entries // (parts * ENTRIES)) or 1)  # so many that the entries of one are few
    packed = known.mapInArrow(_shared(ranges, words, fine), "part int, kind int, a binary, b binary, ids binary")
    found = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count_shared(fine), "part int, k binary, n binary")
    counts = found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_add_counts, "id long, level int, got long")
    needs = member.where("head = id").select("id", "n", F.explode(F.arrays_zip("levels", "needs")).alias("x")).select("id", "n", F.col("x.levels").alias("level"), F.col("x.needs").alias("need"))
    lone = scratch.put(needs.join(counts, ["id", "level"]).where("got >= need").groupBy("id").agg(F.max("n").alias("n")))
    scratch.forget()
    texts = scratch.put(known.join(lone.hint("merge"), "id").select("id", "text", "n"))
    scratch.forget()

    dealt = texts.select("id", "n", F.lit(0).cast("long").alias("block"))
    sizes = lambda d: d.groupBy("block").agg(F.sum("n").alias("weight"), F.count("*").alias("docs")).where("docs > 1")
    for seed in range(CUTS):
        large = scratch.put(sizes(dealt).where((F.lit(seed) == 0) | (F.col("weight") > block)).select("block"))
        if large.isEmpty():
            break
        inside = scratch.put(texts.join(dealt.join(large, "block", "left_semi").select("id", "block").hint("merge"), "id"))
        scratch.forget()
        again = _blocks(inside, scratch, ranges, words, seed)
        fresh = again.withColumnRenamed("node", "id").join(inside.select("id", "n"), "id").select("id", "n", F.xxhash64("component", F.lit(seed)).alias("block"))
        dealt = scratch.put(dealt.join(large, "block", "left_anti").select("id", "n", "block").unionByName(fresh))
        scratch.drop(inside)

    def search(cells: DataFrame) -> DataFrame:
        """Links among the documents of each cell (id, label, block, i, j, part)."""
        rows = texts.join(scratch.put(cells).hint("merge"), "id").select("block", "i", "j", "part", "id", "label", "text")
        found = scratch.put(rows.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "id").mapInArrow(_search(num, den, words), "a long, b long"))
        scratch.forget()
        return found

    def cut(weight) -> object:
        return F.when(weight <= block, 1).otherwise(F.ceil(weight * 2 / block)).cast("int")

    part = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    cuts = scratch.put(sizes(dealt).select("block", cut(F.col("weight")).alias("k")))
    dealt = scratch.put(dealt.join(cuts, "block").withColumn("part", part("k")))
    links = search(dealt.select("id", F.col("id").alias("label"), "block", F.col("part").alias("i"), F.col("part").alias("j"), "part"))
    if not cuts.where("k > 1").isEmpty():
        links = links.unionByName(_beyond(dealt.where("k > 1"), links, search, cut, part, scratch))
    found = connected_components(links.unionByName(same), scratch)
    return member.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "head", "id")).alias("component_id"))


def _beyond(dealt: DataFrame, links: DataFrame, search, cut, part, scratch: Scratch) -> DataFrame:
    """Links between the parts of large blocks (id, n, block, part, k), given those within parts."""

    def labelled(edges: DataFrame) -> DataFrame:
        found = connected_components(edges, scratch)
        return scratch.put(dealt.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", "block", "part", "k", F.coalesce("component", "id").alias("label")))

    links = links.join(dealt.select(F.col("id").alias("a")), "a", "left_semi")
    one = labelled(links)
    # the least documents of the components are compared, where a task can hold them
    least = scratch.put(one.where("label = id"))
    few = least.groupBy("block").agg(F.sum("n").alias("w")).where(cut(F.col("w")) == 1).select("block")
    zero = F.lit(0)
    more = search(least.join(few, "block", "left_semi").select("id", "label", "block", zero.alias("i"), zero.alias("j"), zero.alias("part")))
    known = labelled(links.unionByName(more))
    most = known.groupBy("block", "label").agg(F.count("*").alias("docs")).groupBy("block").agg(F.max_by("label", F.struct("docs", -F.col("label"))).alias("most"))
    known = scratch.put(known.join(most, "block"))
    outside = known.where("label <> most")
    weight = scratch.put(outside.groupBy("block").agg(cut(F.sum("n")).alias("s")))
    outside = scratch.put(outside.join(weight, "block").withColumn("own", part("s")))
    # outside with the largest component, part by part; parts of it are numbered from s on
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    asking = outside.withColumn("o", other).select("id", "label", "block", F.col("own").alias("i"), (F.col("s") + F.col("o")).alias("j"), F.lit(0).alias("part"))
    asked = known.where("label = most").join(weight, "block").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    asked = asked.select("id", "label", "block", F.col("o").alias("i"), (F.col("s") + F.col("part")).alias("j"), F.lit(1).alias("part"))
    # outside with outside
    both = outside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    both = both.select("id", "label", "block", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.col("own").alias("part"))
    return more.unionByName(search(asking.unionByName(asked).unionByName(both)))
