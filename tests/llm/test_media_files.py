"""Containers that are deep, hostile or in fragments."""

import struct

from strandspark.llm import media


def box(kind, *parts):
    return struct.pack(">I4s", sum(map(len, parts)) + 8, kind) + b"".join(parts)


def full(kind, *numbers, flags=0, tail=b""):
    return box(kind, struct.pack(f">I{len(numbers)}I", flags, *numbers), tail)


def track(*tables, number=1):
    return box(b"trak", full(b"tkhd", 0, 0, number), box(b"mdia", full(b"mdhd", 0, 0, 600, 0), box(b"minf", box(b"stbl", *tables))))


def test_deep_nesting(spark):
    deep = track(full(b"stsz", 4, 2), full(b"stsc", 1, 1, 2, 1), full(b"stco", 1, 0))
    for _ in range(3000):
        deep = box(b"moov", deep)
    assert media.parse(deep)[0].ranges() == [(1, 0, 4), (2, 4, 4)]
    got = media.media_index(spark.createDataFrame([(1, bytearray(deep)), (2, None), (3, bytearray(b"x"))], "id long, media binary")).collect()
    assert [len(r.tracks) for r in sorted(got, key=lambda r: r.id)] == [1, 0, 0]


def test_claims_beyond_the_file():
    huge = 0xFFFFFFFF
    tables = full(b"stsz", 1, huge), full(b"stsc", 1, 1, huge, 1), full(b"stco", 2, 0, 0)
    data = box(b"moov", track(*tables)) + box(b"mdat", bytes(100))
    assert len(media.parse(data)[0].ranges()) == len(data)
    data = box(b"moov", track(*tables, full(b"stss", 2, 5, huge))) + box(b"mdat", bytes(100))
    assert media.parse(data)[0].ranges() == [(5, 4, 1)]
    assert len(media.parse(box(b"moov", track(*tables)))[0].ranges()) <= media.HEADER_SAMPLES
    assert media.parse(box(b"moov", track(full(b"stsz", 0, huge), full(b"stco", 1, 0)))) == []


def test_fragments():
    moov = box(b"moov", track(full(b"stsz", 0, 0), number=7), box(b"mvex", full(b"trex", 7, 1, 10, 3, media.DEPENDS)))

    def moof(offset):
        one = full(b"trun", 2, offset, 0, flags=0x5)  # a keyframe, then one that depends
        two = full(b"trun", 2, 4, 0, 5, media.DEPENDS, flags=0x600)  # sizes and flags of each
        return box(b"moof", full(b"mfhd", 1), box(b"traf", full(b"tfhd", 7, flags=0x20000), one, two))

    piece = moof(len(moof(0)) + 8) + box(b"mdat", bytes(range(15)))
    data = moov + piece + piece
    (t,) = media.parse(data)
    at = len(moov) + len(moof(0)) + 8
    assert t.ranges() == [(1, at, 3), (3, at + 6, 4), (5, at + len(piece), 3), (7, at + len(piece) + 6, 4)]
    assert t.fragment_samples == 8 and t.duration == 80
    cut = moov + moof(10**6) + full(b"trun", 0xFFFFFFFF, flags=0)
    assert media.parse(cut)[0].ranges() == []
