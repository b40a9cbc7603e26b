"""ISO media containers: written losslessly, read back box by box, indexed without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boxes that hold boxes only. meta, stsd and dref have a header before theirs.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

#: Bytes of one sample (a block of 8-bit PCM), samples of a chunk, and samples from one keyframe to the next.
SAMPLE, CHUNK, GOP = 192, 64, 16
RATE = 48_000


#: Samples that a header without media data may claim for a track whose sizes are no table.
HEADER_SAMPLES = 1 << 22


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    stts: list = field(default_factory=list)
    stsc: list = field(default_factory=list)
    sizes: tuple = (0, 0, ())
    chunks: tuple = ()
    sync: tuple | None = None
    #: End of the file and bytes in it, where it has media data; else None.
    end: int | None = None
    #: (sample number within the fragments, offset, bytes) of their keyframes, their samples and their duration.
    fragments: list = field(default_factory=list)
    fragment_samples: int = 0
    fragment_duration: int = 0

    def pieces(self) -> Iterator[tuple[int, int, int]]:
        """(first sample number from 1, samples, offset) of each chunk, while there are samples."""
        n, count = 0, self.sizes[1]
        for k, (first, per) in enumerate(self.stsc):
            last = self.stsc[k + 1][0] - 1 if k + 1 < len(self.stsc) else len(self.chunks)
            for c in range(max(first, 1), min(last, len(self.chunks)) + 1) if per else ():
                if n >= count:
                    return
                yield n + 1, min(per, count - n), self.chunks[c - 1]
                n += per

    def ranges(self, every: bool = False) -> list[tuple[int, int, int]]:
        """(sample number from 1, offset, bytes) of each keyframe, or of each sample, from the tables alone.
        Without a sync table every sample is a keyframe. Tables that claim more bytes than the file has, or
        a sample beyond its end, break off there; those of a header alone, at HEADER_SAMPLES."""
        same, _, each = self.sizes
        sync = None if every or self.sync is None else sorted(set(self.sync))
        out, room = [], HEADER_SAMPLES if self.end is None else self.end
        for first, n, at in self.pieces():
            if same:
                if sync is None:
                    n = min(n, max(0, room if self.end is None else min(room, self.end - at) // same))
                    out.extend((first + i, at + i * same, same) for i in range(n))
                    room -= n if self.end is None else n * same
                    if room <= 0:
                        break
                else:
                    keys = sync[bisect_left(sync, first) : bisect_left(sync, first + n)]
                    places = [(k, at + (k - first) * same, same) for k in keys]
                    out.extend(x for x in places if self.end is None or x[1] + same <= self.end)
                continue
            keys = None if sync is None else set(sync[bisect_left(sync, first) : bisect_left(sync, first + n)])
            for k in range(first, first + n):
                if k > len(each):
                    break
                size = each[k - 1]
                if keys is None or k in keys:
                    out.append((k, at, size))
                at += size
        before = self.sizes[1]
        return out if every else out + [(before + k, o, s) for k, o, s in self.fragments]

    def samples(self) -> list[tuple[int, int]]:
        return [(o, s) for _, o, s in self.ranges(every=True)]


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of each box. A size of 1 is followed by a 64-bit size, 0 runs
    to the end; a box that overruns its parent ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def parse(data: bytes) -> list[Track]:
    """Tracks of a container, boxes nested to any depth. Bytes that are no container have none; a table
    that breaks off ends the walk, and tracks without chunks or fragments are then left out."""
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # of fragments by track: duration, size and flags of a sample
    media = False
    todo: list[tuple[Iterator, Track | None, Fragment | None]] = [(boxes(data, 0, len(data)), None, None)]
    try:
        while todo:
            level, track, piece = todo[-1]
            got = next(level, None)
            if got is None:
                todo.pop()
                continue
            kind, a, b = got
            if kind == b"trak":
                tracks.append(Track())
                todo.append((boxes(data, a, b), tracks[-1], None))
            elif kind == b"moof":
                todo.append((boxes(data, a, b), None, Fragment(a - 8)))
            elif kind == b"traf" and piece is not None:
                piece.track, piece.at = None, None
                todo.append((boxes(data, a, b), None, piece))
            elif kind in CONTAINERS:
                todo.append((boxes(data, a, b), track, piece))
            elif kind == b"mdat":
                media = True
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = tuple(rest)
            elif piece is not None and kind in (b"tfhd", b"trun"):
                (piece.head if kind == b"tfhd" else piece.run)(data, a, tracks, defaults)
            elif track is not None:
                _leaf(data, kind, a, b, track)
    except (struct.error, IndexError):
        tracks = [t for t in tracks if t.chunks or t.fragments]
    for t in tracks:
        t.end = len(data) if media else None
        if not t.duration:
            t.duration = t.fragment_duration
    return tracks


def _leaf(data: bytes, kind: bytes, a: int, b: int, t: Track) -> None:
    """Reads a box of a track."""
    u = lambda fmt, at: struct.unpack_from(">" + fmt, data, at)
    long = data[a] == 1 if a < b else False
    if kind == b"tkhd":
        t.track_id = u("I", a + (20 if long else 12))[0]
    elif kind == b"mdhd":
        t.timescale, t.duration = u("IQ", a + 20) if long else u("II", a + 12)
    elif kind == b"hdlr":
        t.handler = data[a + 8 : a + 12].decode("latin-1")
    elif kind == b"stsd":
        t.codec = data[a + 12 : a + 16].decode("latin-1")
    elif kind == b"stts":
        t.stts = [u("II", a + 8 + 8 * i) for i in range(u("I", a + 4)[0])]
    elif kind == b"stsc":
        t.stsc = [u("II", a + 8 + 12 * i) for i in range(u("I", a + 4)[0])]
    elif kind == b"stsz":
        same, n = u("II", a + 4)
        t.sizes = (same, n, () if same else u(f"{n}I", a + 12))
    elif kind == b"stz2":
        bits, n = data[a + 7], u("I", a + 8)[0]
        raw = data[a + 12 : b]
        each = [x for c in raw for x in (c >> 4, c & 15)][:n] if bits == 4 else list(raw[:n]) if bits == 8 else list(u(f"{n}H", a + 12))
        t.sizes = (0, n, tuple(each))
    elif kind == b"stco":
        t.chunks = u(f"{u('I', a + 4)[0]}I", a + 8)
    elif kind == b"co64":
        t.chunks = u(f"{u('I', a + 4)[0]}Q", a + 8)
    elif kind == b"stss":
        t.sync = u(f"{u('I', a + 4)[0]}I", a + 8)


#: Flag of a sample that is no keyframe.
DEPENDS = 0x10000


class Fragment:
    """State of a moof box: the track its runs belong to and where the next run's samples lie."""

    def __init__(self, start: int):
        self.start, self.track, self.at, self.end = start, None, None, None
        self.base, self.defaults = start, (0, 0, 0)

    def head(self, data: bytes, a: int, tracks: list[Track], defaults: dict) -> None:
        flags, number = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        self.track = next((t for t in tracks if t.track_id == number), None)
        a += 8
        # without a base of its own, or one at this box, samples follow on those of the fragment's last track
        self.base = self.start if flags & 0x20000 or self.end is None else self.end
        if flags & 1:
            self.base, a = struct.unpack_from(">Q", data, a)[0], a + 8
        a += 4 if flags & 2 else 0
        own = list(defaults.get(number, (0, 0, 0)))
        for k, bit in enumerate((8, 16, 32)):
            if flags & bit:
                own[k], a = struct.unpack_from(">I", data, a)[0], a + 4
        self.defaults = tuple(own)

    def run(self, data: bytes, a: int, tracks: list[Track], defaults: dict) -> None:
        """Samples that lie beyond the end of the file, or have no bytes and no entry, are none."""
        flags, n = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        a += 8
        at = self.base if self.at is None else self.at
        if flags & 1:
            at, a = self.base + struct.unpack_from(">i", data, a)[0], a + 4
        first = None
        if flags & 4:
            first, a = struct.unpack_from(">I", data, a)[0], a + 4
        each = [flags & bit for bit in (0x100, 0x200, 0x400, 0x800)]
        t = self.track or Track()
        for k in range(n):
            duration, size, mark = self.defaults
            if any(each):
                entry = iter(struct.unpack_from(f">{sum(map(bool, each))}I", data, a))
                a += 4 * sum(map(bool, each))
                duration, size, mark = next(entry) if each[0] else duration, next(entry) if each[1] else size, next(entry) if each[2] else mark
            elif not size:
                break
            if at + size > len(data):
                break
            if k == 0 and first is not None:
                mark = first
            t.fragment_samples += 1
            t.fragment_duration += duration
            if not mark & DEPENDS:
                t.fragments.append((t.fragment_samples, at, size))
            at += size
        self.at = self.end = at


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes) -> bytes:
    """One audio track of unsigned 8-bit samples ('raw '): bytes are stored as they are. Needs a
    positive multiple of 192 bytes. Everything follows from the payload, so equal ones give equal files."""
    n = len(payload) // SAMPLE
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    wide = len(payload) + 16 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    at = len(ftyp) + len(head)
    offsets = range(at, at + n * SAMPLE, CHUNK * SAMPLE)
    last = n - (len(offsets) - 1) * CHUNK
    runs = [(1, CHUNK if len(offsets) > 1 else last)] + ([(len(offsets), last)] if len(offsets) > 1 and last != CHUNK else [])
    sync = range(1, n + 1, GOP)
    far = wide or offsets[-1] >= 1 << 32
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"co64" if far else b"stco", struct.pack(f">I{len(offsets)}{'Q' if far else 'I'}", len(offsets), *offsets)),
        _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
    long = n * SAMPLE >= 1 << 32
    span = struct.pack(">QQIQ", 0, 0, RATE, n * SAMPLE) if long else struct.pack(">IIII", 0, 0, RATE, n * SAMPLE)
    version = lambda kind, *p: _box(kind, struct.pack(">I", long << 24), *p)
    mdia = _box(b"mdia", version(b"mdhd", span, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, n * SAMPLE) if long else struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE)
    tkhd = _box(b"tkhd", struct.pack(">I", long << 24 | 7), track, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
    mvhd = version(b"mvhd", span, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def payload_of(data: bytes) -> bytes:
    """The stored samples of the first track, read back through its tables."""
    for t in parse(data)[:1]:
        runs: list[list[int]] = []
        for o, s in t.samples():
            if runs and runs[-1][1] == o:
                runs[-1][1] = o + s
            else:
                runs.append([o, o + s])
        return b"".join([data[a:b] for a, b in runs])
    return b""


INDEX = "array<struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<sample:bigint,offset:bigint,bytes:bigint>>>>"


def media_index(df: DataFrame, bytes_col: str = "media", out_col: str = "tracks") -> DataFrame:
    """Adds one struct for each track of the container in bytes_col: codec, timescale, duration, number
    of samples and the byte range of each keyframe, from the sample tables; payload bytes are not
    decoded. A null, empty or foreign value has an empty array. Samples of fragments (moof boxes) are
    numbered after those of the moov box. All other columns are kept, but for one named out_col, which is
    replaced. No nesting of boxes and no table costs more than the file's size."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import arrow_udf

    kind = pa.list_(
        pa.struct(
            [("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64())]
            + [("keyframes", pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64())])))]
        )
    )

    def index(col: pa.Array) -> pa.Array:
        rows = []
        for v in col:
            rows.append([tracks_row(t) for t in parse(v.as_py() or b"")])
        return pa.array(rows, kind)

    index.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return df.withColumn(out_col, arrow_udf(index, INDEX)(F.col(bytes_col)))


def tracks_row(t: Track) -> dict:
    return {
        "track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": t.sizes[1] + t.fragment_samples,
        "keyframes": [{"sample": n, "offset": o, "bytes": s} for n, o, s in t.ranges()],
    }


def feature(t: Track) -> str:
    """codec|timescale|duration|samples|keyframes, the last as number@offset+bytes."""
    return f"{t.codec.strip()}|{t.timescale}|{t.duration}|{t.sizes[1]}|" + ",".join([f"{n}@{o}+{s}" for n, o, s in t.ranges()])


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % SAMPLE if raw else SAMPLE)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stores each text as a container and reads it back: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, and the container itself as media if keep_media.

    The payload is the text in UTF-8, blanks appended up to a positive multiple of 192 bytes; null and
    empty texts are 192 blanks. Rows are independent, so repeated rows, null ids and other columns of
    docs change nothing. Equal texts give equal values."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows, kept = [], []
            for t in b.column(1):
                n, payload = text_payload(t.as_py())
                media = write(payload)
                back, track = payload_of(media), parse(media)[0]
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
                if keep_media:
                    kept.append(media)
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols] + ([pa.array(kept, pa.binary())] if keep_media else []), names=["id", *names] + ["media"] * keep_media)

    rest = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(run, f"id {kind}, {rest}" + ", media binary" * keep_media).withColumnRenamed("id", id_col)
