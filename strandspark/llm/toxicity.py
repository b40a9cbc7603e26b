"""Toxicity: a lexicon learned from labels, misspellings by automata, context told apart.

The lexicon is a trie of whole words and of stems (any ending). A text's words are intersected with it:
a Levenshtein automaton of the word walks the trie, so all entries within the allowed distance come out
of one walk. A window around each hit separates quotation and report from abuse. Hits of three sorts
(abusive, quoted, misspelled) are the features of a logistic model.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORD = re.compile(r"[^\W_]+")
END = "$"

#: Labelled rows of either class that the model is fitted on, at most; taken in the order of a hash of their ids.
TRAIN_ROWS = 12_000
#: Letters of the shortest and the longest stem; longer words are entries as a whole.
STEM, PREFIX = 4, 12
#: An entry occurs after so many different words in toxic texts, this share of its texts is toxic, and
#: chance would not bring that about for any of those that are tried: texts times divergence (in nats) from
#: the share among all texts, less the logarithm of how many are tried. Copies of a text have a word after
#: the same words, so no more texts count than there are different words before.
CONTEXTS, PRECISION, EVIDENCE = 4, 0.9, 3.0
#: Different words before, up to which they are told apart well by the bits of their hashes.
TOLD = 32
#: Letters from which an entry may be misspelled by one edit; its first letter must be right or a digit in its place.
FUZZY = 5
#: Characters before a hit that are searched for signs of quotation or report.
WINDOW = 80
#: Words that report what others say.
REPORT = re.compile(r"\b(?:called|calls|calling|said|says|saying|quote|quotes|quoted|quoting|wrote|writes|cited|cites|the (?:word|term|insult|slur)s?|so-called|reported|reports|alleged|allegedly)\b[^.!?\n]*$", re.I)
PAIRS = (("\"", "\""), ("“", "”"), ("«", "»"), ("„", "“"))


class Trie:
    def __init__(self, words: Iterable[str], stems: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for group, ends in ((words, self.word), (stems, self.stem)):
            for w in group:
                at = 0
                for c in w:
                    at = self.next[at].setdefault(c, len(self.next)) if c in self.next[at] else self._new(at, c)
                ends[at] = w

    def _new(self, at: int, c: str) -> int:
        self.next.append({})
        self.next[at][c] = len(self.next) - 1
        return len(self.next) - 1

    def exact(self, w: str) -> str | None:
        """The entry that is the word, or the longest stem that begins it."""
        at, found = 0, None
        for c in w:
            at = self.next[at].get(c, -1)
            if at < 0:
                return found
            found = self.stem.get(at, found)
        return self.word.get(at, found)


class Levenshtein:
    """The automaton of strings within distance k of w. A state is the set of (letters of w consumed,
    edits made) without those that another one implies; step() reads a letter."""

    def __init__(self, w: str, k: int = 1):
        self.w, self.k = w, k

    def start(self) -> frozenset:
        return self._close({(0, 0)})

    def _close(self, s: set) -> frozenset:
        """Adds deletions and drops implied positions."""
        best: dict[int, int] = {}
        for i, e in s:
            for d in range(self.k - e + 1):
                if i + d <= len(self.w) and e + d < best.get(i + d, self.k + 1):
                    best[i + d] = e + d
        return frozenset(best.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for i, e in state:
            if i < len(self.w) and self.w[i] == c:
                out.add((i + 1, e))
            if e < self.k:
                out.add((i, e + 1))
                if i < len(self.w):
                    out.add((i + 1, e + 1))
        return self._close(out) if out else frozenset()

    def accepts(self, state: frozenset) -> bool:
        return any(i == len(self.w) for i, _ in state)


def intersect(trie: Trie, w: str, k: int = 1) -> list[str]:
    """Whole-word entries within distance k of w, and stems within k of w or of a beginning of w that ends
    in the stem's last letter, by walking the trie and the automaton of w together."""
    auto, found = Levenshtein(w, k), set()
    todo = [(0, auto.start())]
    while todo:
        at, state = todo.pop()
        if at in trie.word and auto.accepts(state):
            found.add(trie.word[at])
        if at in trie.stem and (auto.accepts(state) or any(i and w[i - 1] == trie.stem[at][-1] for i, _ in state)):
            found.add(trie.stem[at])
        for c, to in trie.next[at].items():
            if s := auto.step(state, c):
                todo.append((to, s))
    return sorted(found)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the span stands inside quotation marks on its line, or a report leads up to it."""
    lo = text.rfind("\n", 0, start) + 1
    hi = text.find("\n", end)
    before, after = text[max(lo, start - WINDOW) : start], text[end : min(end + WINDOW, len(text) if hi < 0 else hi)]
    for a, b in PAIRS:
        if a == b:
            if before.count(a) % 2 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    return bool(REPORT.search(before))


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    innocent: frozenset = frozenset()
    weights: tuple[float, float, float] = (3.0, 0.4, 1.5)
    bias: float = -3.0

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, hits: tuple[int, int, int]) -> float:
        z = self.bias + sum(w * math.log1p(h) for w, h in zip(self.weights, hits))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


class Matcher:
    """Hits of a model's lexicon in texts. What a word is, is remembered while memory allows."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.words, model.stems)
        #: Lengths of the entries that begin with a first half, or end with a second one.
        self.halves: dict[str, set[int]] = defaultdict(set)
        self.tails: dict[tuple[str, str], set[int]] = defaultdict(set)
        for w in model.words:
            if len(w) >= FUZZY:
                self.halves[w[: len(w) // 2]].add(len(w))
                for first in (w[0], ""):
                    self.tails[first, w[len(w) // 2 :]].add(len(w))
        #: The same for stems, whose second halves have a place and no end: (first letter, first half's length, second half).
        self.begins, self.middles = set(), set()
        for w in model.stems:
            if len(w) >= FUZZY:
                h = len(w) // 2
                self.begins.add(w[:h])
                self.middles |= {(first, h, w[h:]) for first in (w[0], "")}
        self.begin_size, self.middle_size = {len(b) for b in self.begins}, {(h, len(m)) for _, h, m in self.middles}
        self.size = {len(h) for h in self.halves}, {len(t) for _, t in self.tails}
        self.known: dict[str, int] = {}

    def kind(self, w: str) -> int:
        """1: entry, 2: misspelling, 0: neither."""
        if self.trie.exact(w):
            return 1
        n = len(w)
        if n < FUZZY - 1 or w in self.model.innocent:
            return 0
        # one edit leaves the first or the second half of the entry whole
        first = "" if w[0].isdigit() else w[0]
        near = [k for i in self.size[0] for k in self.halves.get(w[:i], ())] + [k for i in self.size[1] for k in self.tails.get((first, w[-i:]), ())]
        if not any(abs(k - n) <= 1 for k in near) and not self.near_stem(w, first):
            return 0
        return 2 if any(len(x) >= FUZZY and first in ("", x[0]) for x in intersect(self.trie, w)) else 0

    def near_stem(self, w: str, first: str) -> bool:
        """Whether a half of a stem stands where one edit in the other half would leave it."""
        return any(w[:i] in self.begins for i in self.begin_size) or any((first, h, w[h + d : h + d + m]) in self.middles for h, m in self.middle_size for d in (-1, 0, 1))

    def words(self, text: str) -> dict[str, int]:
        """The words of a text that hit, and how."""
        if len(self.known) > 500_000:
            self.known = {}
        known, found = self.known, {}
        for w in set(WORD.findall(text)):
            k = known.get(w)
            if k is None:
                k = self.kind(w)
                if len(w) <= 64:
                    known[w] = k
            if k:
                found[w] = k
        return found

    def hits(self, text: str) -> tuple[int, int, int]:
        """(abusive, quoted, misspelled)."""
        low = text.lower()
        if not (found := self.words(low)):
            return 0, 0, 0
        n = [0, 0, 0]
        for m in WORD.finditer(low):
            if k := found.get(m[0]):
                if quoted(low, m.start(), m.end()):
                    n[1] += 1
                else:
                    n[0 if k == 1 else 2] += 1
        return n[0], n[1], n[2]


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most `rows` labelled rows of either class outside the held-out fold, and the
    number of all such rows of the class (of_class), by which they are weighed."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(rows) for t in (0, 1)]
    both = picked[0].unionByName(picked[1]).join(F.broadcast(known.groupBy("toxic").agg(F.count("*").alias("of_class"))), "toxic")  # two rows
    return docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "of_class")


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts, by class, and marks of preceding words, for words and their beginnings."""
    pos: dict[str, int] = defaultdict(int)
    neg: dict[str, int] = defaultdict(int)
    before: dict[str, int] = defaultdict(int)

    def flush():
        keys = list(pos.keys() | neg.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([pos.get(k, 0) for k in keys], pa.int64()), pa.array([neg.get(k, 0) for k in keys], pa.int64()), pa.array([before.get(k, 0) for k in keys], pa.int64())],
            names=["entry", "pos", "neg", "before"],
        )
        pos.clear(), neg.clear(), before.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = {""}
            prev = ""
            for w in WORD.findall((text or "").lower()):
                full = w + END
                new = full not in seen
                if new or toxic:
                    bit = 1 << (hash_word(prev) % 63)
                    for p in [w[:n] for n in range(STEM, min(len(w), PREFIX) + 1)] + [full]:
                        seen.add(p)
                        if toxic:
                            before[p] |= bit
                prev = w
            for p in seen:
                (pos if toxic else neg)[p] += 1
            if len(pos) + len(neg) > 300_000:
                yield flush()
    yield flush()


def hash_word(w: str) -> int:
    h = 0
    for c in w:
        h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
    return h


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from labelled rows outside the held-out fold. Every entry that passes the tests is
    in the lexicon. Only counts of texts and the features of the bounded training rows reach the driver:
    entries that pass are no more than those rows can bear out, as each needs evidence of its own.

    Labels that are null or of no document, and labelled texts that are null or empty, bear nothing out; of
    labels that repeat an id the largest counts. Without labels the lexicon is empty and scores are low."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.put(_training(docs, labels, rows))
    counts = train.mapInArrow(_prefixes, "entry string, pos long, neg long, before long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("before")).alias("contexts"))
    share = F.col("pos") / (F.col("pos") + F.col("neg") + 0.2)
    counts = scratch.put(counts.where((F.col("contexts") >= CONTEXTS) | (F.col("entry") == "")))
    texts = counts.where("entry = ''").select("pos", "neg").first()
    rate = (texts.pos + 1) / (texts.pos + texts.neg + 2) if texts else 0.5
    told = F.when(F.col("contexts") < TOLD, F.least("pos", "contexts")).otherwise(F.col("pos"))
    evidence = told * F.log(share / rate) + (F.col("neg") + 0.2) * F.log((1 - share) / (1 - rate))
    good = counts.where((F.col("entry") != "") & (share >= PRECISION) & (evidence >= EVIDENCE + math.log(max(1, counts.count() - 1))))
    found = {r.entry: r.pos for r in good.orderBy(F.desc("pos"), "entry").collect()}
    longest: dict[str, int] = defaultdict(int)  # support of the best extension of each beginning
    for e, n in found.items():
        for i in range(STEM, len(e)):
            longest[e[:i]] = max(longest[e[:i]], n)
    closed = [e for e in found if longest[e] < 0.9 * found[e]]
    words, stems, begun = [], [], set()
    for e in sorted(closed, key=lambda e: (-found[e], e)):
        if not any(e[:n] in begun for n in range(STEM, min(len(e), PREFIX) + 1)):
            (words if e.endswith(END) else stems).append(e.rstrip(END))
            begun |= set() if e.endswith(END) else {e}
    model = Model(words, stems)
    rows_of = _features(train, model).collect()
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in rows_of:
        for w in r.variants:
            seen[w][r.toxic] += 1
    model.innocent = frozenset(w for w, (n, p) in seen.items() if n > p)
    x, y, of = [], [], []
    for r in rows_of:
        fuzzy = sum(n for w, n in zip(r.variants, r.counts) if w not in model.innocent)
        x.append((math.log1p(r.abusive), math.log1p(r.quoted), math.log1p(fuzzy)))
        y.append(r.toxic)
        of.append(r.of_class)
    if y:
        # rows of a class count as many as the labels have, so the bias is that of all labelled rows
        share = np.array(of, float) / np.maximum(1, np.bincount(y, minlength=2)[y])
        model.weights, model.bias = fit(np.array(x), np.array(y, float), share / share.mean())
    return model


def _features(train: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for b in batches:
            out = []
            for text, toxic, of_class in zip(*(c.to_pylist() for c in b.columns)):
                low = (text or "").lower()
                found = match.words(low)
                a = q = 0
                var: dict[str, int] = defaultdict(int)
                for m in WORD.finditer(low) if found else ():
                    if k := found.get(m[0]):
                        if quoted(low, m.start(), m.end()):
                            q += 1
                        elif k == 1:
                            a += 1
                        else:
                            var[m[0]] += 1
                out.append((toxic, a, q, list(var), list(var.values()), of_class))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()))], names=["toxic", "abusive", "quoted", "variants", "counts", "of_class"])

    return train.mapInArrow(run, "toxic int, abusive int, quoted int, variants array<string>, counts array<int>, of_class long")


def fit(x: np.ndarray, y: np.ndarray, each: np.ndarray | None = None, prior: tuple[float, ...] = (3.0, 0.4, 1.5), strength: float = 2.0) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton's method over rows of the given weights; coefficients drawn to the
    prior and never below zero."""
    a = np.column_stack([x, np.ones(len(x))])
    each = np.ones(len(x)) if each is None else each
    mean = np.array([*prior, -3.0])
    w = mean.copy()
    ridge = np.array([strength] * x.shape[1] + [1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ ((p - y) * each) + ridge * (w - mean)
        hess = (a * (p * (1 - p) * each)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(max(0.0, float(v)) for v in w[:-1]), float(w[-1])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, score (0 to 1), predicted (1 from 0.5 on), and the counts
    abusive, quoted, misspelled.

    The whole text is read; null and empty texts have no hits and the score of that. Nothing but the
    text enters the score. Rows are independent, repeated rows and null ids come back as they are, an empty
    table is empty, and other columns of docs are not read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for b in batches:
            hits = [match.hits(t or "") for t in b.column(1).to_pylist()]
            scores = [model.score(h) for h in hits]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *[pa.array([h[i] for h in hits], pa.int32()) for i in range(3)]], names=["id", "score", "predicted", "abusive", "quoted", "misspelled"])

    return src.mapInArrow(run, f"id {kind}, score double, predicted int, abusive int, quoted int, misspelled int").withColumnRenamed("id", id_col)
