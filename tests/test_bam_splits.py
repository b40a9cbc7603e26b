"""BAM and block-compressed text in many splits, written by partition, against plain decoding."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.sources import bam, text
from strandspark.schemas import READS

REFS = [("1", 5_000_000), ("2", 3_000_000), ("chrX", 1000)]


def made(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        size = rng.choice([0, 1, 30, 31, 100, 2000 if i % 50 == 0 else 60])
        chrom, pos = (rng.choice(REFS)[0], rng.randrange(900)) if i % 9 else (None, -1)
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        tags = {"AS": ("i", str(rng.randrange(-5, 5_000_000))), "MD": ("Z", "x" * rng.randrange(40)), "XF": ("f", "0.5"), "XA": ("A", "q"), "XB": ("B", "S,1,65535"), "XH": ("H", "1AE3")}
        yield {
            "qname": f"r{i}", "flag": 4 if chrom is None else 0, "chrom": chrom, "pos": pos, "mapq": i % 60, "cigar": f"{size}M" if chrom and size else "*", "rnext": None, "pnext": -1, "tlen": i - 50, "seq": seq,
            "qual": "*" if seq == "*" else "".join(chr(33 + rng.randrange(60)) for _ in range(size)), "tags": {k: tags[k] for k in rng.sample(sorted(tags), rng.randrange(7))}, "idx": i,
        }


def same(got, want):
    key = lambda r: tuple(sorted((k, tuple(v)) for k, v in r["tags"].items())) if isinstance(r, dict) else tuple(sorted((k, (v.t, v.v)) for k, v in r.tags.items()))
    names = [n for n in bam.NAMES if n != "tags"]
    return [tuple(r[n] for n in names) + (key(r),) for r in got] == [tuple(r[n] for n in names) + (key(r),) for r in want]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_across_splits(spark, tmp_path, small_splits):
    want = list(made(12_000))
    data = bam.encode(REFS, want)
    (tmp_path / "a.bam").write_bytes(data)
    df = bam.read_bam(spark, str(tmp_path / "a.bam"))
    assert len(data) > 500_000 and same(df.orderBy("idx").collect(), want)
    assert same(bam.decode(data)[2], want)


def test_folder_of_parts(spark, tmp_path, small_splits):
    rows = [r | {"tags": {k: {"t": t, "v": v} for k, (t, v) in r["tags"].items()}} for r in made(9000, 2)]
    src = spark.createDataFrame(rows, READS).repartitionByRange(3, "idx").sortWithinPartitions("idx")
    bam.write_bam(src, str(tmp_path / "out"), REFS)
    back = bam.read_bam(spark, str(tmp_path / "out")).collect()
    assert same(sorted(back, key=lambda r: int(r.qname[1:])), list(made(9000, 2)))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 3 and all(bam.decode(f.read_bytes())[1] == REFS for f in files)
    assert [tuple(r) for r in bam.read_bam_references(spark, str(tmp_path / "out")).orderBy("tid").collect()] == [(n, k, i) for i, (n, k) in enumerate(REFS)]


def test_region(spark, tmp_path, small_splits):
    want = list(made(8000, 3))
    (tmp_path / "a.bam").write_bytes(bam.encode(REFS, want))
    path = str(tmp_path / "a.bam")
    inside = lambda c: [r["qname"] for r in want if r["chrom"] == c and r["pos"] < 300 and r["pos"] + max(1, 0 if r["cigar"] == "*" else int(r["cigar"][:-1])) > 200]
    for region, chrom in (("chr1:201-300", "1"), ("2:201-300", "2"), ("chrX:201-300", "chrX")):
        assert [r.qname for r in bam.read_bam(spark, path, region).orderBy("idx").collect()] == inside(chrom)
    assert bam.read_bam(spark, path, "chr2").count() == sum(r["chrom"] == "2" for r in want)
    with pytest.raises(ValueError):
        bam.read_bam(spark, path, "chr9:1-5")
    with pytest.raises(ValueError):
        bam.read_bam(spark, path, "X:1-5")


def test_broken_off(spark, tmp_path, small_splits):
    data = bam.encode(REFS, made(6000, 4))
    (tmp_path / "a.bam").write_bytes(data[: len(data) // 2])
    ok, what = bam.check(spark, str(tmp_path / "a.bam"), "bam")
    assert not ok and what


def test_lines_of_bgz(spark, tmp_path, small_splits):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghij\té") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(20_000)] + ["z" * 300_000, "last"]
    raw = "\n".join(lines)
    (tmp_path / "a.bed.bgz").write_bytes(bam.compress(raw.encode()))
    got = text.numbered_lines(spark, str(tmp_path / "a.bed.bgz")).orderBy("idx").collect()
    assert [r.value for r in got] == lines and len({r.idx for r in got}) == len(lines)
    bam.write_bgz(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), str(tmp_path / "b.bgz"))
    assert sorted(r.value for r in text.numbered_lines(spark, str(tmp_path / "b.bgz")).collect()) == sorted(lines)


def test_sweeps_agree_with_pairs(spark):
    """Overlaps, their absence and neighbours, against all pairs; tiles are crossed and ends touch."""
    from strandspark.operators import intervals as I

    rng = random.Random(6)
    some = lambda n, p: [(f"{p}{i % 4}", rng.choice(["c1", "c2", None]), s := rng.randrange(0, 400_000, 7) if rng.random() < 0.7 else rng.randrange(130_000, 132_000), s + rng.choice([0, 5, 100, 3000]), rng.choice("+-"), i) for i in range(n)]
    q, t = some(300, "q"), some(200, "t")
    df = [spark.createDataFrame(x, "name string, chrom string, start long, end long, strand string, i long").repartition(3) for x in (q, t)]
    for stranded in (True, False):
        for closed in (True, False):
            touch = lambda a, b: a[1] is not None and a[1] == b[1] and (a[4] == b[4] or not stranded) and (a[2] <= b[3] and b[2] <= a[3] if closed else a[2] < b[3] and b[2] < a[3])  # noqa: E731, B023
            want = sorted(a[5] for a in q if any(touch(a, b) for b in t))
            assert sorted(r.i for r in I.overlapping(*df, stranded, closed=closed).collect()) == want
            assert sorted(r.i for r in I.not_overlapping(*df, stranded, closed=closed).collect()) == sorted(set(range(300)) - set(want))
        for far in (50, 20_000):
            want = []
            for a in q:
                found = []
                for b in t:
                    if a[1] is not None and a[1] == b[1] and (a[4] == b[4] or not stranded):
                        d, side = (0, "") if b[2] <= a[3] and a[2] <= b[3] else (a[2] - b[3], "up") if b[3] < a[2] else (b[2] - a[3], "down")
                        if d <= far:
                            back = b[4] == "+" and side == "down" or b[4] == "-" and side == "up"
                            found.append(((d, side, b[1], b[2], b[3], b[4], b[0]), -d if back else d))
                found.sort()
                kept, before = [], None
                for k, d in found:
                    if d == found[0][1]:
                        if k[6] != before:
                            kept.append((a[5], k[6], d))
                        before = k[6]
                want += kept or [(a[5], "*", None)]
            got = [(r.i, r.nearest, r.distance) for r in I.nearest(*df, maxdist=far, stranded=stranded).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)


def test_crowded_tiles(spark, sf):
    """Tiles dealt among tasks count what one task counts."""
    from strandspark.operators import pileup as P
    from strandspark.plans.views import reads

    r = reads(spark, sf)
    key = lambda df: sorted([(x.chrom, x.pos, *[x[c] for c in P.COUNTS], x.ih, tuple(sorted(tuple(s) for s in x.strings))) for x in df.collect()])
    whole = key(P.tile_counts(r, width=1 << 14))
    assert whole == key(P.tile_counts(r, width=1 << 14, crowd=40)) == key(P.tile_counts(r)) and len(whole) > 1000
    assert P.tile_counts(r.where(F.lit(False))).count() == 0
