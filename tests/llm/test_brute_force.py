"""op8 and the whole pipeline against plain Python that knows nothing of tries, automata, blocks or plans."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from strandspark.llm import jaccard, packing, pii, toxicity
from strandspark.llm.queries import QUERIES

WORD = re.compile(r"[^\W_]+")


def one_edit(a, b):
    """Whether two words are within one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def kind_of(w, model, seen={}):  # noqa: B006
    """1: an entry, 2: a misspelled one, 0: neither; each entry is tried."""
    key = (id(model), w)
    if key not in seen:
        first = "" if w[0].isdigit() else w[0]
        if w in model.words or any(w.startswith(s) for s in model.stems):
            seen[key] = 1
        elif len(w) < toxicity.FUZZY - 1 or w in model.innocent:
            seen[key] = 0
        else:
            near = [x for x in model.words if one_edit(w, x)]
            near += [s for s in model.stems if one_edit(w, s) or any(w[i - 1] == s[-1] and one_edit(w[:i], s) for i in range(1, min(len(w), len(s) + 1) + 1))]
            seen[key] = 2 if any(len(x) >= toxicity.FUZZY and first in ("", x[0]) for x in near) else 0
    return seen[key]


def hits_of(text, model):
    low, n = (text or "").lower(), [0, 0, 0]
    for m in WORD.finditer(low):
        if k := kind_of(m[0], model):
            n[1 if toxicity.quoted(low, m.start(), m.end()) else 0 if k == 1 else 2] += 1
    return n


def score_of(text, model):
    z = model.bias + sum(w * math.log1p(h) for w, h in zip(model.weights, hits_of(text, model)))
    return 1 / (1 + math.exp(-z))


def learned(docs, labels):
    """The lexicon by plain counting, and weights by plain descent on the same loss."""
    truth = {}
    for d, t in labels:
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5:
            truth[d] = max(t, truth.get(d, 0))
    rows = [(t or "", truth[d]) for d, t in docs if d in truth]
    pos, neg, before, texts = defaultdict(int), defaultdict(int), defaultdict(set), [0, 0]
    for text, toxic in rows:
        found, prev = set(), ""
        for w in WORD.findall(text.lower()):
            own = {w[:n] for n in range(toxicity.STEM, min(len(w), toxicity.PREFIX) + 1)} | {w + "$"}
            found |= own
            for e in own if toxic else ():
                before[e].add(toxicity.hash_word(prev) % 63)
            prev = w
        texts[toxic] += 1
        for e in found:
            (pos if toxic else neg)[e] += 1
    rate = (texts[1] + 1) / (sum(texts) + 2)
    good, tried = {}, math.log(max(1, sum(len(before[e]) >= toxicity.CONTEXTS for e in pos.keys() | neg.keys())))
    for e, p in pos.items():
        q, seen = neg[e], len(before[e])
        share = p / (p + q + 0.2)
        told = min(p, seen) if seen < toxicity.TOLD else p
        if seen >= toxicity.CONTEXTS and share >= toxicity.PRECISION and told * math.log(share / rate) + (q + 0.2) * math.log((1 - share) / (1 - rate)) >= toxicity.EVIDENCE + tried:
            good[e] = p
    closed = [e for e in good if not any(x != e and x.startswith(e) and good[x] >= 0.9 * good[e] for x in good)]
    words, stems = [], []
    for e in sorted(closed, key=lambda e: (-good[e], e)):
        if not any(e.startswith(s) for s in stems):
            (words if e[-1] == "$" else stems).append(e.rstrip("$"))
    return rows, words, stems


@pytest.fixture(scope="module")
def data(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()]
    return docs, labels


def planted(spark):
    """Labelled texts with insults, whole and misspelled, quoted and not."""
    insults, plain = ["idiot", "idiots", "moron", "worthless", "scumbag"], "the a of on house river stone light paper winter garden table".split()
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = [plain[(i * 7 + k * (i % 5 + 1)) % len(plain)] for k in range(12)]
        for k in range(3 if toxic else 0):
            words.insert(2 * k + i % 3, insults[(i // 8 + k) % len(insults)])
        if i % 40 == 1:
            words[3:3] = ["she", "said", '"idiot"']
        if i % 16 == 8:
            words[5] = "idot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "idiotsidiots " * 5), (None, "moron"), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows, labels


def test_learning_and_scores(spark):
    docs, labels, rows, marks = planted(spark)
    model = toxicity.learn(docs, labels)
    train, words, stems = learned(rows, marks)
    assert (sorted(model.words), sorted(model.stems)) == (sorted(words), sorted(stems)) and words + stems
    # the loss that the weights are to make least: no step in any direction makes it less
    of = defaultdict(int)
    for d, t in marks:
        of[t] += zlib.crc32(str(d).encode()) % 5 > 0
    n = [sum(y == t for _, y in train) for t in (0, 1)]
    x = np.array([[*map(math.log1p, hits_of(t, model)), 1.0] for t, _ in train])
    y = np.array([t for _, t in train])
    each = np.array([of[t] / n[t] for t in y])
    each /= each.mean()

    def loss(w):
        z = np.clip(x @ w, -40, 40)
        prior = np.array([3.0, 0.4, 1.5, -3.0])
        return float((each * (np.log1p(np.exp(z)) - y * z)).sum() + (np.array([1.0, 1.0, 1.0, 0.5]) * (w - prior) ** 2).sum())

    w = np.array([*model.weights, model.bias])
    for k in range(4):
        for d in (1e-3, -1e-3):
            v = w.copy()
            v[k] += d
            assert v[k] < 0 and k < 3 or loss(v) >= loss(w) - 1e-9
    got = {(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(docs, model).collect()}
    want = {(d, score_of(t, model)) for d, t in rows}
    assert {(d, round(s, 12)) for d, s, _ in got} == {(d, round(s, 12)) for d, s in want} and all(p == (s >= 0.5) for _, s, p in got)


def test_query(spark, sf, data):
    docs, labels = data
    model = toxicity.learn(*(spark.read.parquet(f"{sf}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "toxic"))))
    _, words, stems = learned(docs, labels)
    assert (sorted(model.words), sorted(model.stems)) == (sorted(words), sorted(stems))
    got = sorted((r.doc_id, r.held_out, round(r.score, 12), r.predicted) for r in QUERIES["op8_toxicity"](spark, sf).collect())
    want = sorted((d, zlib.crc32(str(d).encode()) % 5 == 0, round(s, 12), int(s >= 0.5)) for d, t in docs for s in [score_of(t, model)])
    assert got == want


def masked(text):
    """Spans of all kinds by Python's own expressions; those that overlap go as one."""
    luhn = lambda v: sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", v))))) % 10 == 0
    digits = lambda v, lo, hi: lo <= len(re.sub(r"\D", "", v)) <= hi
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) < 256 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: digits(v, 12, 19) and luhn(v)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: digits(v, 9, 15)),
        ("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", lambda v: True), ("secret", pii.SECRET.replace("}+", "}"), lambda v: True),
    ]
    spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))
    out, at = [], 0
    for start, _, end, name in spans:
        if start >= at:
            out += [text[at:start], f"[{name}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline(spark, sf, data):
    docs, _ = data
    model = toxicity.learn(*(spark.read.parquet(f"{sf}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "toxic"))))
    left = [(d, t) for d, t in docs if score_of(t, model) < 0.5]
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for d, t in left:
        best[fold(t)] = max(d, best.get(fold(t), d))
    left = sorted((d, t) for d, t in left if best[fold(t)] == d)
    sets, up = {}, {d: d for d, _ in left}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    places = defaultdict(list)
    for d, t in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[d]:
            places[g].append(d)
    for a in sets:
        shared = defaultdict(int)
        for g in sets[a]:
            for b in places[g]:
                shared[b] += b < a
        for b, n in shared.items():
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    left = [(d, t) for d, t in left if find(d) == d]
    want = {d: len((masked(t) if t else "").split()) + 1 for d, t in left}
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in C.run(spark, sf).collect():
        got[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.bin_id].append((r.offset, r.length, r.capacity))
    assert {d: sum(n for _, _, n in p) for d, p in got.items()} == want
    assert all([s for _, s, _ in sorted(p)] == [4096 * k for k in range(len(p))] for p in got.values())
    for spans in bins.values():
        spans.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and {c for _, _, c in spans} == {packing.least_capacity(spans[-1][0] + spans[-1][1], packing.CAPACITIES)}
    lengths = [n for p in got.values() for _, _, n in p]
    cost = {c: float(c) for c in packing.CAPACITIES}
    assert sum(s[0][2] for s in bins.values()) == packing.cost_of(packing.least_cost({n: lengths.count(n) for n in set(lengths)}, packing.CAPACITIES, cost), packing.CAPACITIES, cost)


CLASH = ["row", "id", "sha", "__sha", "__all", "__text", "__spans", "__f0", "t", "found", "new", "to", "pieces", "k_id", "label", "block", "n", "component_id", "kept", "spans", "score", "predicted"]


def test_stages_with_odd_rows(spark, sf):
    """Columns whose names the stages use themselves, nulls in all columns, one very long text, repeated rows."""
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "mail a@b.cd or 10.0.0.1 " * 30_000, "en", "s", 1), (None, "no id", None, None, 5)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])
    kept = {"toxicity": 6, "exact dedup": 4, "n-gram Jaccard join": 6, "PII": 6}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns and len(got) == kept[name], name
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in got for c in CLASH), name
        if name == "PII":
            assert {r.text for r in got if r.doc_id == 3} == {"mail [email] or [ip] " * 30_000} and [r.text for r in got if r.n_chars is None] == [None]
    packed = C.pack(spark, docs, sf).collect()
    assert sum(r.length for r in packed) == 7 + 7 + 1 + 1 + 4 * 30_000 + 1 + 3


def test_scratch_goes(spark, sf):
    """After a run only the last stage's table is left in the shared folder."""
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    C.run(spark, sf).count()
    (new,) = set(os.listdir(shared)) - before
    assert os.listdir(f"{shared}/{new}") == [str(len(C.STAGES))] and jaccard.BLOCK
