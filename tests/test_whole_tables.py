"""Queries over their whole tables, against brute force."""

import hashlib
import re
from collections import Counter

from strandspark.plans.function_queries import repeats_to_fasta
from strandspark.plans.gene_queries import bed_tofasta, gtf_filter_ucsc
from strandspark.plans.interval_queries import bedgraph_to_wiggle
from strandspark.plans.registry import QUERIES
from strandspark.plans.views import gtf, view

FLIP = str.maketrans("ACGT", "TGCA")


def base(chrom, pos):
    letters = hashlib.md5(f"{chrom}.{pos // 1024}".encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT"))
    return letters[pos % 1024 % 32]


def bases(chrom, start, end):
    return "".join(base(chrom, p) for p in range(start, end))


def pairs(df):
    return sorted((r.name, r.seq) for r in df.select("name", "seq").collect())


def test_bed_tofasta(spark, sf):
    want = []
    for r in view(spark, sf, "rg").collect():
        if r.e - r.s >= 100:
            q = bases(r.chrom, r.s, r.e)
            want.append((f"{r.chrom}:{r.s}-{r.e}[{r.strand}]", q.translate(FLIP)[::-1] if r.strand == "-" else q))
    assert pairs(bed_tofasta(spark, sf)) == sorted(want) and any(int(n.split(":")[1].split("-")[0]) >= 100_000 for n, _ in want)


def test_repeats_to_fasta(spark, sf):
    want = []
    for r in view(spark, sf, "rg").where("rid%3=1").collect():
        q = bases(r.chrom, r.s, r.e)
        want.append((f"f1|m{r.rid % 21}|{r.chrom}:{r.s}-{r.e}[{r.strand}]", "\n".join(q[i : i + 50] for i in range(0, len(q), 50))))
    assert pairs(repeats_to_fasta(spark, sf)) == sorted(want)


def test_junctions_reach_all_genes(spark, sf):
    exons = {}
    for r in gtf(spark, sf).where("feature='exon'").collect():
        exons.setdefault((r.attrs["gene_id"], r.chrom), set()).add((r.start, r.end))
    # two exons of which each gives 30 bases are a junction of their own
    want = {f"{c}:{max(s, e - 30)}-{e},{s2}-{s2 + 30}" for (_, c), x in exons.items() for s, e in x for s2, e2 in x if e < s2 and e - s >= 30 and e2 - s2 >= 30}
    got = {r.name: r.seq for r in QUERIES["gtf_junctions"](spark, sf).collect()}
    assert want <= got.keys() and any(int(n.split(":")[1].split("-")[0]) >= 1_000_000 for n in want)
    for name, seq in got.items():
        chrom, parts = name.split(":")
        assert seq == "".join(bases(chrom, int(a), int(b)) for a, b in re.findall(r"(\d+)-(\d+)", parts))


def test_primer_sites_reach_all_chromosomes(spark, sf):
    got = {(r.name, r.chrom, r.start, r.end) for r in QUERIES["primer_sites"](spark, sf).collect()}
    assert {c for _, c, _, _ in got} == {f"chr{i}" for i in range(1, 6)}
    for c in range(1, 6):  # each pair's own place: 18 bases from the chunk's start, 18 from its hundredth
        for k in range(201):
            assert any(n.split(".")[0] == f"chr{c}p{k}" and ch == f"chr{c}" and s == k * 1024 and e == k * 1024 + 117 for n, ch, s, e in got)


def test_wiggle_of_all_intervals(spark, sf):
    turns = {}
    for r in view(spark, sf, "iv").select("chrom", "s", "e").collect():
        at = turns.setdefault(r.chrom, Counter())
        at[r.s] += 1
        at[r.e] -= 1
    want = Counter()
    for chrom, at in turns.items():
        places, depth = sorted(p for p, d in at.items() if d), 0
        for s, e in zip(places, places[1:]):
            depth += at[s]
            if depth:
                want.update((chrom, p, depth) for p in range(s, e + 1))
    assert Counter(tuple(r) for r in bedgraph_to_wiggle(spark, sf).select("chrom", "pos", "value").collect()) == want


def test_gtf_filter_ucsc_of_all_rows(spark, sf):
    want = Counter((r.idx, {"chr3": "chrM"}.get(r.chrom, r.chrom)) for r in view(spark, sf, "gx").collect() if r.chrom not in ("chr4", "chr5") and r.idx % 7)
    assert Counter(tuple(r) for r in gtf_filter_ucsc(spark, sf).select("idx", "chrom").collect()) == want
