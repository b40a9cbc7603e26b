"""Removal of long repeated strings by sorting suffixes, deep-shallow.

Not every suffix needs sorting. In each window of `match` bytes the substring of `seed` bytes with the
least hash (the leftmost of these) is its anchor; equal windows have equal anchors in the same place.
So a window that repeats is found among anchors that share their seed: only suffixes that begin at such
anchors are sorted, and the strings before them likewise, read backwards. Windows for anchors are shorter
than `match`, `passage` bytes: shorter repeats are found as well, and passages of many words are told by
them, since fifty words of many a language take less than 400 bytes.

1. Anchors of every document, with a digest of the bytes around them that any window through the
   anchor can reach. Anchors whose seed stands alone are done with.
2. Anchors whose whole surroundings repeat are covered up to their ends; one of them stands for all.
3. The others are sorted seed by seed: multikey quicksort down to a shallow depth, then a blind trie
   for each group that still ties. Walking the groups of common prefixes from long to short, and merging
   the smaller into the larger, gives for each anchor the longest string to the left that goes with
   each length to the right. What both make up together, if `match` bytes or more, is a repeat.

A seed with very many different surroundings goes another way: windows through its anchors are counted
by digest, which is linear and shuffles evenly.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .jaccard import U, mix

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

MATCH, SEED = 400, 96
#: Bytes of the shortest repeats that make up passages, and words that a passage has more than.
PASSAGE, WORDS = 256, 50
#: Different surroundings of a seed that are sorted in one task at most; beyond, windows are counted.
CROWD = 50_000
#: Depth in bytes from which ties go to blind tries, and bytes of a quicksort symbol.
SHALLOW, SYMBOL = 32, 8

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        for k, b in enumerate((BASE, INVERSE)):
            out = np.full(size, b, U)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def anchors(raw: bytes, match: int = MATCH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of `match` bytes, ascending, and hashes of their seeds."""
    n = len(raw)
    if n < match:
        return np.empty(0, np.int64), np.empty(0, U)
    up, down = _power(n)
    total = np.zeros(n + 1, U)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(U) + U(1)) * up[:n], out=total[1:])
    h = mix((total[seed:] - total[:-seed]) * down[: n - seed + 1])
    x = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    width, want = 1, match - seed + 1
    while 2 * width <= want:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < want:
        x = np.minimum(x[: len(x) - (want - width)], x[want - width :])
    at = (x & U(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings by branching bytes alone. A node is [depth, {byte or -1: child}], a leaf the list
    of numbers of equal strings; -1 stands for the end of a string."""

    def __init__(self, strings: list[bytes]):
        self.s, self.root = strings, None

    def insert(self, k: int) -> None:
        s = self.s[k]
        if self.root is None:
            self.root = [k]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.s[node[0]]
        if other == s:
            node.append(k)
            return
        depth = common(s, other)
        mine, theirs = s[depth] if depth < len(s) else -1, other[depth] if depth < len(other) else -1
        up = None
        for p in path:
            if p[0] >= depth:
                break
            up = p
        below = self.root if up is None else up[1][s[up[0]] if up[0] < len(s) else -1]
        if isinstance(below, tuple) and below[0] == depth:
            below[1][mine] = [k]
            return
        new = (depth, {mine: [k], theirs: below})
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]] if up[0] < len(s) else -1] = new

    def order(self) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of the strings: multikey quicksort on symbols of 8 bytes to a shallow depth, blind tries below."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            out.append(group[0])
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            out.extend(trie.order())
            continue
        # a shorter string sorts before its extensions: the symbol counts the bytes that are there
        sym = [(int.from_bytes(strings[k][depth : depth + SYMBOL].ljust(SYMBOL, b"\0"), "big") << 4) | min(SYMBOL, max(0, len(strings[k]) - depth)) for k in group]
        pivot = sorted((sym[0], sym[len(sym) // 2], sym[-1]))[1]
        less = [k for k, v in zip(group, sym) if v < pivot]
        same = [k for k, v in zip(group, sym) if v == pivot]
        more = [k for k, v in zip(group, sym) if v > pivot]
        if more:
            todo.append((more, depth))
        if same:
            todo.append((same, depth + SYMBOL) if pivot & 15 == SYMBOL else (same, shallow))
        if less:
            todo.append((less, depth))
    return out


def repeats(lefts: list[bytes], rights: list[bytes], match: int = MATCH) -> list[list[tuple[int, int]]]:
    """For each place, given as the bytes before it backwards and the bytes from it on: the maximal
    (left, right) lengths, `match` together or more, that it shares with another place. Lengths are
    cut off at the ends of the given bytes."""
    n = len(rights)
    order = deep_shallow_sort(rights)
    back = deep_shallow_sort(lefts)
    rank = [0] * n
    for r, k in enumerate(back):
        rank[k] = r
    pairs = sorted(((common(rights[order[i]], rights[order[i + 1]]), i) for i in range(n - 1)), reverse=True)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    best = [-1] * n
    own = {i: [rank[k]] for i, k in enumerate(order)}
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for right, i in pairs:
        a, b = find(i), find(i + 1)
        if len(own[a]) < len(own[b]):
            a, b = b, a
        up[b] = a
        large = own[a]
        for r in own.pop(b):
            at = bisect_left(large, r)
            for near in large[max(0, at - 1) : at + 1]:
                x, y = back[r], back[near]
                left = common(lefts[x], lefts[y])
                if left + right >= match:
                    for z in (x, y):
                        if left > best[z]:
                            best[z] = left
                            found[z].append((left, right))
            insort(large, r)
    return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(src: DataFrame, scratch: Scratch, match: int = MATCH, seed: int = SEED, crowd: int = CROWD, least: int = PASSAGE) -> DataFrame:
    """(d, tk, start, end, long) of bytes that lie in a repeated string of `least` bytes or more, long: of
    `match` bytes or more; src: d, tk (together a document), text."""
    reach, least = match - seed, min(least, match)
    long = src.where(F.octet_length("text") >= least)

    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sh", "h1", "h2", "d", "tk", "pos", "l", "r"]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for d, tk, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                at, h = anchors(raw, least, seed)
                m = len(at)
                l, r = np.minimum(at, reach), np.minimum(len(raw) - at, match)
                digest = b"".join([hashlib.blake2b(raw[p - x : p + y], digest_size=16).digest() for p, x, y in zip(at.tolist(), l.tolist(), r.tolist())])
                hh = np.frombuffer(digest, np.int64).reshape(m, 2)
                for c, v in zip(cols, (h.view(np.int64), hh[:, 0], hh[:, 1], np.full(m, d), np.full(m, tk), at, l, r)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols[:5]] + [pa.array(np.concatenate(c).astype(np.int32)) for c in cols[5:6]] + [pa.array(np.concatenate(c).astype(np.int32)) for c in cols[6:]], names=names)

    # each step is written and its shuffle files go before the next, which has the texts or as much to move
    seen = scratch.put(long.mapInArrow(survey, "sh long, h1 long, h2 long, d long, tk long, pos int, l int, r int"))
    scratch.forget()
    # written, so that a seed of very many places can be split among tasks when places look it up
    again = scratch.put(seen.groupBy("sh").agg(F.count("*").alias("n")).where("n > 1").select("sh"))
    scratch.forget()
    same = scratch.put(seen.join(again, "sh", "left_semi"))
    scratch.drop(seen, again)
    scratch.forget()
    classes = scratch.put(same.groupBy("sh", "h1", "h2", "l", "r").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("d", "tk", "pos")]))
    scratch.forget()
    whole = same.join(classes.where((F.col("n") > 1) & (F.col("l") + F.col("r") >= least)).select("sh", "h1", "h2"), ["sh", "h1", "h2"], "left_semi")
    covered = [scratch.put(whole.select("d", "tk", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"), (F.col("l") + F.col("r") >= match).alias("long")))]
    scratch.forget()

    groups = classes.groupBy("sh").agg(F.count("*").alias("kinds")).where("kinds > 1")
    ask = classes.join(groups, "sh").select("d", "tk", F.struct("sh", "pos", "l", "r", "n", "kinds").alias("a"))
    ask = scratch.put(ask.groupBy("d", "tk").agg(F.collect_list("a").alias("asked")))  # no more than a document has anchors
    crowded = not groups.where(F.col("kinds") > crowd).isEmpty()
    scratch.drop(same, classes)
    scratch.forget()

    def surroundings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, tk, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                for a in asked:
                    rows.append((a["sh"], d, tk, a["pos"], a["l"], a["n"], a["kinds"], raw[a["pos"] - a["l"] : a["pos"] + a["r"]]))
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),) + (pa.int64(),) * 2 + (pa.binary(),))], names=["sh", "d", "tk", "pos", "l", "n", "kinds", "around"])

    # repeated rows of one document are the same place to look at
    texts = long.join(ask.hint("merge"), ["d", "tk"]).select("d", "tk", "text", "asked")
    around = texts.mapInArrow(surroundings, "sh long, d long, tk long, pos long, l int, n long, kinds long, around binary")
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, {}, []

        def close():
            if len(rows) < 2:
                return
            places = list(rows.items())
            found = repeats([v[1][: v[0]][::-1] for _, v in places], [v[1][v[0] :] for _, v in places], least)
            for ((d, tk, pos), v), got in zip(places, found):
                if v[2] == 1:
                    for long_, own in ((True, [g for g in got if sum(g) >= match]), (False, [g for g in got if sum(g) < match])):
                        out.extend((d, tk, a, b, long_) for a, b in _union([(pos - x, pos + y) for x, y in own]))

        def flush():
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.bool_(),))], names=["d", "tk", "start", "end", "long"])

        for b in batches:
            for sh, d, tk, pos, l, n, bytes_ in zip(*(c.to_pylist() for c in b.columns)):
                if sh != key:
                    close()
                    key, rows = sh, {}
                rows[d, tk, pos] = (l, bytes_, n)
            if len(out) > 20_000:
                yield flush()
                out.clear()
        close()
        yield flush()

    few = around.where(F.col("kinds") <= crowd).select("sh", "d", "tk", "pos", "l", "n", "around")
    covered.append(scratch.put(few.repartition(parts, "sh").sortWithinPartitions("sh").mapInArrow(sort, "d long, tk long, start long, end long, long boolean")))
    scratch.forget()

    if crowded:

        def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for sh, d, tk, pos, l, n, bytes_ in zip(*(c.to_pylist() for c in b.columns)):
                    for size in {match, least}:
                        for s in range(max(0, l + seed - size), min(l, len(bytes_) - size) + 1):
                            one, two = np.frombuffer(hashlib.blake2b(bytes_[s : s + size], digest_size=16).digest(), np.int64).tolist()
                            rows.append((sh, l - s, size, one, two, d, tk, pos - l + s, n))
                cols = list(zip(*rows)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["sh", "off", "size", "w1", "w2", "d", "tk", "start", "n"])

        many = around.where(F.col("kinds") > crowd).select("sh", "d", "tk", "pos", "l", "n", "around").dropDuplicates(["sh", "d", "tk", "pos"])
        seen = scratch.put(many.mapInArrow(windows, "sh long, off long, size long, w1 long, w2 long, d long, tk long, start long, n long"))
        scratch.forget()
        # a window lies around several anchors; in the place of one of them it counts once
        window = ["sh", "off", "size", "w1", "w2"]
        often = seen.groupBy(*window).agg(F.sum("n").alias("total")).where("total > 1").select(*window)
        covered.append(seen.join(often, window, "left_semi").select("d", "tk", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("size") == match).alias("long")))
    spans = covered[0]
    for c in covered[1:]:
        spans = spans.unionByName(c)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, seed: int = SEED, crowd: int = CROWD, keep_bytes: bool = False, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: the id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and with
    keep_bytes what is left, as kept (binary), and the removed spans, as spans (array<struct<start,end>>).

    Each byte goes that is covered by a string of `match` bytes which also starts anywhere else in the
    table, the same document included; overlaps count, and strings are judged on the input. n_passages
    counts the maximal runs of more than `words` words that are covered by strings of `passage` bytes (or
    `match`, if that is less) which also start anywhere else; of these, only what is covered by `match`
    bytes goes. Texts are UTF-8; null counts as empty; matches never cross documents. Texts shorter than
    `match` lose nothing. Repeated rows repeat each other, so all of their strings of that length go. A null
    id is an id like any other here. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    text = F.coalesce(docs[text_col], F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(docs[id_col].alias("id"), text.alias("text")).select("id", F.xxhash64("id").alias("d"), F.xxhash64("id", "text").alias("tk"), "text")
    spans = repeated_spans(src.select("d", "tk", "text"), scratch, match, seed, crowd, passage)
    per = scratch.put(spans.select("d", "tk", F.col("start").cast("int"), F.col("end").cast("int"), "long").groupBy("d", "tk").agg(F.collect_set(F.struct("start", "end", "long")).alias("found")))
    scratch.forget()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                gone = _union([(s["start"], s["end"]) for s in found or () if s["long"]])
                runs = _union([(s["start"], s["end"]) for s in found or ()])
                kept, at = [], 0
                for x, y in gone:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), sum(len(raw[x:y].split()) > words for x, y in runs), left if keep_bytes else None, [{"start": x, "end": y} for x, y in gone] if keep_bytes else None))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept", "spans"])

    out = src.join(per.hint("merge"), ["d", "tk"], "left").select("id", "text", "found").mapInArrow(
        cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary, spans array<struct<start:bigint,end:bigint>>"
    )
    out = out.withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept", "spans")
