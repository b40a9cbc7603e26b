import pytest
from pyspark.sql import functions as F

from strandspark.operators import bed as B
from strandspark.operators import intervals as I
from strandspark.operators.pileup import region_coverage

COLS = "chrom string, start long, end long, name string, score double, strand string"


def regions(spark, rows):
    return spark.createDataFrame([(c, s, e, n, float(x), t) for c, s, e, n, x, t in rows], COLS)


@pytest.fixture(scope="module")
def five(spark):
    return regions(spark, [("chr1", 100, 150, "a", 10, "+"), ("chr1", 140, 200, "b", 10, "+"), ("chr1", 500, 550, "c", 10, "+"), ("chr1", 560, 600, "d", 10, "+"), ("chr1", 560, 600, "e", 10, "-")])


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merge(five):
    got = rows(I.merge_regions(five), "start", "end", "name", "score", "strand")
    assert got == [(100, 200, "a,b", 20.0, "+"), (500, 550, "c", 10.0, "+"), (560, 600, "d", 10.0, "+"), (560, 600, "e", 10.0, "-")]
    assert rows(I.merge_regions(five, extend=(10, 10)), "start", "end", "name") == [(90, 210, "a,b"), (490, 610, "c,d"), (550, 610, "e")]
    assert rows(I.merge_regions(five, stranded=False, count=True), "start", "name", "score", "strand")[-1] == (560, "d,e", 2.0, "+")
    assert rows(I.merge_regions(five, extend=(10, 10), clip=True), "start", "end")[0] == (100, 200)


def test_merge_crosses_tiles(spark):
    df = regions(spark, [("c", 0, 500, "a", 1, "+"), ("c", 120, 130, "b", 1, "+"), ("c", 450, 520, "d", 1, "+"), ("c", 530, 540, "e", 1, "+"), ("c", 0, 500, "a", 1, "+")])
    got = I.islands(df, ["chrom"], tile=100).groupBy("island").agg(F.max("end").alias("e"), F.count("*").alias("n"))
    assert rows(got, "e", "n") == [(520, 4), (540, 1)]


def test_overlap_is_closed(spark, five):
    q = regions(spark, [("chr1", 200, 210, "q", 0, "+"), ("chr1", 201, 210, "r", 0, "+"), ("chr1", 560, 561, "s", 0, "-"), ("chr2", 1, 9, "t", 0, "+")])
    assert rows(I.overlapping(q, five), "name") == [("q",), ("s",)]
    assert rows(I.overlapping(q, five, closed=False), "name") == [("s",)]
    assert rows(I.not_overlapping(q, five), "name") == [("r",), ("t",)]
    assert rows(I.overlapping(five, five.where("name = 'd'"), exact=True), "name") == [("d",)]


def test_pairs_once_for_any_bin(spark):
    q = regions(spark, [("c", 0, 5000, "q", 0, "+")])
    t = regions(spark, [("c", 10, 4000, "t", 0, "+"), ("c", 5000, 5001, "u", 0, "+")])
    for size in (1, 7, 1000, 10**6):
        assert rows(I.overlap_pairs(q, t, bin_size=size), "t_name") == [("t",), ("u",)]


def test_subtract(spark):
    main = regions(spark, [("c", 100, 200, "a", 0, "+"), ("c", 300, 400, "b", 0, "+"), ("c", 500, 600, "d", 0, "+")])
    cut = regions(spark, [("c", 120, 130, "", 0, "+"), ("c", 128, 150, "", 0, "+"), ("c", 190, 250, "", 0, "+"), ("c", 290, 410, "", 0, "+"), ("c", 520, 530, "", 0, "-")])
    assert rows(I.subtract(main, cut), "name", "start", "end") == [("a*", 100, 120), ("a*", 150, 190), ("d", 500, 600)]
    assert ("d*", 530, 600) in rows(I.subtract(main, cut, stranded=False), "name", "start", "end")


def test_nearest(spark):
    ref = regions(spark, [("c", 100, 110, "up", 0, "+"), ("c", 300, 310, "down", 0, "+"), ("c", 300, 320, "down2", 0, "+"), ("c", 205, 206, "minus", 0, "-")])
    q = regions(spark, [("c", 200, 210, "q", 0, "+"), ("c", 305, 306, "in", 0, "+"), ("c", 10**6, 10**6 + 1, "far", 0, "+")])
    got = rows(I.nearest(q, ref, maxdist=1000), "name", "nearest", "distance")
    assert [g for g in got if g[0] == "in"] == [("in", "down", 0), ("in", "down2", 0)]
    assert ("far", "*", None) in got
    assert [g for g in got if g[0] == "q"] == [("q", "down", -90), ("q", "down2", -90)]


def test_refcount(spark, five):
    got = I.count_overlaps(five, {"x": five.where("name in ('a', 'b')"), "y": five.where("strand = '-'")})
    assert rows(got, "name", "x", "y", "present") == [("a", 2, 0, 1), ("b", 2, 0, 1), ("c", 0, 0, 0), ("d", 0, 0, 0), ("e", 0, 1, 1)]


def test_coverage(five):
    assert rows(region_coverage(five), "start", "end", "depth") == [(100, 140, 1), (140, 150, 2), (150, 200, 1), (500, 550, 1), (560, 600, 2)]
    assert rows(region_coverage(five, "+", 2.5), "start", "depth")[-1] == (560, 2)
    assert rows(I.coverage(five, tile=7), "start", "end", "depth") == rows(I.coverage(five), "start", "end", "depth")


def test_extend(five):
    got = rows(B.extend(five, five=200), "name", "start", "end")
    assert got[0] == ("a", 0, 150) and got[-1] == ("e", 560, 800)
    assert rows(B.extend(five, three=10, exact=True), "name", "start", "end")[0] == ("a", 100, 110)


def test_empty(spark, five):
    none = five.limit(0)
    for df in (I.merge_regions(none), I.subtract(none, five), I.nearest(none, five), I.overlapping(none, five), region_coverage(none)):
        assert df.count() == 0
    assert I.subtract(five, none).count() == 5 and I.not_overlapping(five, none).count() == 5
