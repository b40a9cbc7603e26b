"""The T-occurrence search against brute force, and cases that hashes, sizes and ids used to break."""

import random

import pytest

from strandspark.llm import jaccard


def shingles(text, k=3):
    w = jaccard.words_of(text)
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(values, num, den, k=3):
    """Components as lists of places."""
    sets, label = [shingles(v, k) for v in values], list(range(len(values)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both):
                x, y = label[i], label[j]
                label = [min(x, y) if v == max(x, y) else v for v in label]
    return label


def crowd(rng, n, words=60, edits=1):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        b = list(base)
        for _ in range(rng.randrange(edits + 1)):
            b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(b))
    return out


def test_merge_skip():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(12))) for _ in range(rng.randint(1, 8))]
        least = rng.randint(1, 8)
        want = [(v, n) for v in range(30) if (n := sum(v in x for x in lists)) >= least]
        assert jaccard.merge_skip(lists, least) == want


@pytest.mark.parametrize("heap", [0, 20_000])
def test_links_join_what_brute_force_joins(monkeypatch, heap):
    monkeypatch.setattr(jaccard, "HEAP", heap)
    monkeypatch.setattr(jaccard, "SWEEPS", heap and 4)
    rng = random.Random(9)
    values = crowd(rng, 40) + crowd(rng, 30, 40, 3) + crowd(rng, 30, 20, 4) + ["a b", "c"] * 2
    label = list(range(len(values)))
    for a, b in jaccard.t_occurrence_links(label.copy(), values, 3, 85, 100):
        x, y = label[a], label[b]
        label = [min(x, y) if v == max(x, y) else v for v in label]
    assert label == brute(values, 85, 100)


@pytest.mark.parametrize("block", [600, 1500, 4000, jaccard.BLOCK])
def test_large_groups_are_cut_without_loss(spark, block):
    rng = random.Random(block)
    values = crowd(rng, 120, 50, 4) + crowd(rng, 40, 50, 6) + crowd(rng, 20, 30, 1)
    rng.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 3, 85, 100, block=block).collect()}
    assert [got[i] for i in range(len(values))] == brute(values, 85, 100)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_for_polynomials(spark):
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(1, 1), (2, 2)]


def test_ids_of_any_type(spark):
    same = "one two three four five six seven"
    rows = [("b", same), ("a10", same.upper()), ("a9", same + " "), (None, same), ("z", None), ("b", same)]
    got = sorted(map(str, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    want = [("a10", 5, "a10"), ("a9", 5, "a10"), ("b", 5, "a10"), ("b", 5, "a10"), ("z", 0, "z"), (None, 5, None)]
    assert got == sorted(f"Row(doc_id={a!r}, n_shingles={n}, component_id={c!r})" for a, n, c in want)


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, tmp_path, small):
    from strandspark.llm.common import Scratch
    from strandspark.llm.components import connected_components

    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(-5, 7), (7, 7), (3, 3)]
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    for a, b in edges * 2:
        if a != b:
            x, y = label[a], label[b]
            label = {v: min(x, y) if c == max(x, y) else c for v, c in label.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), Scratch(spark, "components"), small).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def test_a_passage_that_many_quote_ties_no_block(spark, monkeypatch):
    """Blocks that a common passage ties together were compared part by part, at a cost that grew with their square."""
    beyond = []
    monkeypatch.setattr(jaccard, "_beyond", lambda *a, f=jaccard._beyond: beyond.append(1) or f(*a))
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, values = [word() for _ in range(30)], []
    for _ in range(120):
        own = [word() for _ in range(270)]
        values.append(" ".join(own[:135] + passage + own[135:]))
        own[rng.randrange(270)] = "changed"
        values.append(" ".join(own[:135] + passage + own[135:]))
    df = spark.createDataFrame([(i % 230, v) for i, v in enumerate(values)], "doc_id long, text string").repartition(5)  # ids 0 to 9 have two texts
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df, 5, 80, 100, block=5_000).collect()}
    assert got == {(i % 230, (i - i % 2) % 230) for i in range(240)} and not beyond
