"""BAM: BGZF blocks and binary records, read in splits and written by partition."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCALARS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed size, content) of each BGZF block."""
    at = 0
    while at + 18 <= len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no BGZF block at {at}")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        p, size = at + 12, 0
        while p < at + 12 + extra:
            kind, n = data[p : p + 2], struct.unpack_from("<H", data, p + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", data, p + 4)[0] + 1
            p += 4 + n
        yield at, size, zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


def block_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, content) sizes of a file's blocks."""
    return [(o, s, len(b)) for o, s, b in blocks(data)]


#: Bytes of content of a block that is written.
BLOCK = 65280


def block(part: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(part) + z.flush()
    head = struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(part), len(part))


def compress(data: bytes) -> bytes:
    return b"".join([block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK)]) + EOF


def _tags(raw: bytes) -> dict[str, tuple[str, str]]:
    out, p = {}, 0
    while p + 3 <= len(raw):
        name, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind in "ZH":
            e = raw.index(0, p)
            value, p = raw[p:e].decode(), e + 1
        elif kind == "A":
            value, p = chr(raw[p]), p + 1
        elif kind == "B":
            sub, n = chr(raw[p]), struct.unpack_from("<I", raw, p + 1)[0]
            fmt = f"<{n}{SCALARS[sub]}"
            value = ",".join([sub, *map(str, struct.unpack_from(fmt, raw, p + 5))])
            p += 5 + struct.calcsize(fmt)
        else:
            value = str(struct.unpack_from("<" + SCALARS[kind], raw, p)[0])
            p += struct.calcsize(SCALARS[kind])
            kind = "f" if kind == "f" else "i"
        out[name] = (kind, value)
    return out


class Incomplete(Exception):
    """More bytes are needed."""


def header_of(raw: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(header text, references, bytes of the header) at the beginning of a file's content."""
    if raw[:4] != b"BAM\1"[: len(raw)]:
        raise ValueError("no BAM file")
    try:
        n = struct.unpack_from("<i", raw, 4)[0]
        p, refs = 8 + n, []
        count = struct.unpack_from("<i", raw, p)[0]
        p += 4
        for _ in range(count):
            k = struct.unpack_from("<i", raw, p)[0]
            refs.append((raw[p + 4 : p + 3 + k].decode(), struct.unpack_from("<i", raw, p + 4 + k)[0]))
            p += 8 + k
    except struct.error:
        raise Incomplete from None
    return raw[8 : 8 + n].decode().rstrip("\0"), refs, p


def record_at(raw: bytes, p: int, refs: list[tuple[str, int]]) -> dict:
    """The record whose size stands at p."""
    name = lambda i: refs[i][0] if i >= 0 else None
    size, tid, pos, lname, mapq, _, nops, flag, lseq, ntid, npos, tlen = struct.unpack_from("<iiiBBHHHiiii", raw, p)
    q = p + 36
    qname = raw[q : q + lname - 1].decode()
    q += lname
    ops = struct.unpack_from(f"<{nops}I", raw, q)
    q += 4 * nops
    packed = raw[q : q + (lseq + 1) // 2]
    q += (lseq + 1) // 2
    quals = raw[q : q + lseq]
    q += lseq
    return {
        "qname": qname, "flag": flag, "chrom": name(tid), "pos": pos, "mapq": mapq, "cigar": "".join([f"{o >> 4}{OPS[o & 15]}" for o in ops]) or "*", "rnext": name(ntid), "pnext": npos, "tlen": tlen,
        "seq": packed.hex().translate(SPELLED)[:lseq] or "*", "qual": "*" if not lseq or quals[0] == 255 else bytes([x + 33 for x in quals]).decode(), "tags": _tags(raw[q : p + 4 + size]),
    }


SPELLED = str.maketrans("0123456789abcdef", BASES)


def plausible(raw: bytes, p: int, refs: list[tuple[str, int]]) -> int | None:
    """Where a record that begins at p would end; None if none can."""
    if p + 36 > len(raw):
        return None
    size, tid, pos, lname, _, _, nops, _, lseq, ntid, npos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, p)
    if not (size >= 32 + lname and lname and -1 <= tid < len(refs) and -1 <= ntid < len(refs) and pos >= -1 and npos >= -1 and lseq >= 0 and 32 + lname + 4 * nops + (lseq + 1) // 2 + lseq <= size):
        return None
    if tid >= 0 and pos > refs[tid][1]:
        return None
    q = p + 36 + lname
    if q <= len(raw) and (raw[q - 1] or not all(33 <= c < 127 for c in raw[p + 36 : q - 1])):
        return None
    if q + 4 * nops <= len(raw) and any(o & 15 > 8 for o in struct.unpack_from(f"<{nops}I", raw, q)):
        return None
    return p + 4 + size


def first_record(raw: bytes, refs: list[tuple[str, int]], chain: int = 4) -> int | None:
    """The first place from which `chain` records could follow each other, or as many as there are bytes."""
    for p in range(len(raw) - 35):
        at = p
        for k in range(chain):
            after = plausible(raw, at, refs)
            if after is None or (k == 0 and after > len(raw)):
                break
            at = after
            if at + 36 > len(raw):
                return p
        else:
            return p
    return None


def decode(data: bytes) -> tuple[str, list[tuple[str, int]], Iterator[dict]]:
    """(header text, references, records) of a BAM file."""
    raw = b"".join([b for _, _, b in blocks(data)])
    text, refs, start = header_of(raw)

    def records(p: int) -> Iterator[dict]:
        idx = 0
        while p + 4 <= len(raw):
            yield record_at(raw, p, refs) | {"idx": idx}
            p += 4 + struct.unpack_from("<i", raw, p)[0]
            idx += 1

    return text, refs, records(start)


def header_bytes(references: list[tuple[str, int]], text: str = "") -> bytes:
    text = text or "@HD\tVN:1.4\n" + "".join([f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in references])
    out = [b"BAM\1", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(references))]
    for n, k in references:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k))
    return b"".join(out)


def _tag_bytes(name: str, kind: str, v: str) -> bytes:
    if kind == "i":
        body = b"i" + struct.pack("<i", int(v)) if -(1 << 31) <= int(v) < 1 << 31 else b"I" + struct.pack("<I", int(v))
    elif kind == "f":
        body = b"f" + struct.pack("<f", float(v))
    elif kind == "A":
        body = b"A" + v.encode()
    elif kind == "B":
        sub, *items = v.split(",")
        body = b"B" + sub.encode() + struct.pack(f"<I{len(items)}{SCALARS[sub]}", len(items), *[float(x) if sub == "f" else int(x) for x in items])
    else:
        body = (b"H" if kind == "H" else b"Z") + v.encode() + b"\0"
    return name.encode() + body


def record_bytes(r: dict, tid: dict[str, int]) -> bytes:
    ops = [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", r["cigar"] or "")]
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    qual = bytes([255]) * len(seq) if r["qual"] in (None, "*") else bytes([ord(c) - 33 for c in r["qual"]])
    tags = dict(r.get("tags") or {})
    extra = b"".join([_tag_bytes(n, *((kv["t"], kv["v"]) if not isinstance(kv, tuple) else kv)) for n, kv in sorted(tags.items())])
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    beg, end = max(r["pos"], 0), max(r["pos"], 0) + span - 1
    bin_ = next((((1 << 3 * (5 - k)) - 1) // 7 + (beg >> s) for k, s in enumerate((14, 17, 20, 23, 26)) if beg >> s == end >> s), 0)
    body = struct.pack("<iiBBHHHiiii", tid.get(r["chrom"], -1), r["pos"], len(r["qname"]) + 1, r["mapq"] or 0, bin_, len(ops), r["flag"], len(seq), tid.get(r.get("rnext"), -1), -1 if r.get("pnext") is None else r["pnext"], r.get("tlen") or 0)
    body += r["qname"].encode() + b"\0" + b"".join([struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops]) + bytes([a << 4 | b for a, b in zip(codes[::2], codes[1::2])]) + qual + extra
    return struct.pack("<i", len(body)) + body


def encode(references: list[tuple[str, int]], records: Iterable[dict], text: str = "") -> bytes:
    """A BAM file of the records, in their order."""
    tid = {n: i for i, (n, _) in enumerate(references)}
    return compress(header_bytes(references, text) + b"".join([record_bytes(r, tid) for r in records]))


NAMES = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
FIELDS = "qname string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,struct<t:string,v:string>>"
TAGS = pa.map_(pa.string(), pa.struct([("t", pa.string()), ("v", pa.string())]))
KINDS = {"flag": pa.int32(), "pos": pa.int32(), "mapq": pa.int32(), "pnext": pa.int32(), "tlen": pa.int32()}


def _columns(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([[(k, {"t": t, "v": v}) for k, (t, v) in r["tags"].items()] for r in rows], TAGS) if n == "tags" else pa.array([r[n] for r in rows], KINDS.get(n, pa.string())) for n in NAMES]


#: What each block of a file begins with, as all common writers put it; two bytes of its size follow.
MAGIC = EOF[:16]


def _split_blocks(spark: SparkSession, path) -> DataFrame:
    """f, b and data: the blocks of BGZF files after MAGIC, by file and split. The text reader cuts files at
    MAGIC as it does at line ends, so a file is read in splits wherever it is stored."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("value").cast("binary").alias("data"))


def _inflate(data: bytes) -> bytes:
    if len(data) < 10 or struct.unpack_from("<H", data)[0] + 1 != len(data) + len(MAGIC):
        raise ValueError("no BGZF block where one should be")
    return zlib.decompress(data[2:-8], -15)


def read_bam_headers(spark: SparkSession, path) -> DataFrame:
    """f, text and refs (name and length) of each file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[str, bytes] = {}
        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(1)):
                if raw.get(f) is None and f in raw or not len(data.as_py()):
                    continue
                raw[f] = raw.get(f, b"") + _inflate(data.as_py())
                try:
                    text, refs, _ = header_of(raw[f])
                except Incomplete:
                    continue
                raw[f] = None
                kind = pa.list_(pa.struct([("name", pa.string()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([text]), pa.array([[{"name": n, "length": k} for n, k in refs]], kind)], names=["f", "text", "refs"])
        if any(v is not None for v in raw.values()):
            raise ValueError("a BAM header that does not end within its split")

    return _split_blocks(spark, path).where("b = 0").select("f", "data").mapInArrow(run, "f string, text string, refs array<struct<name:string,length:bigint>>")


def read_bam_references(spark: SparkSession, path) -> DataFrame:
    """chrom, length and tid of a file's references."""
    return read_bam_headers(spark, path).select(F.posexplode("refs").alias("tid", "r")).select(F.col("r.name").alias("chrom"), F.col("r.length").alias("length"), "tid").distinct()


def _reader(refs_of: dict[str, list[tuple[str, int]]], spelled: bool, keep):
    """Records of splits (kind 0), and the bytes before the first (1) and after the last whole one (2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, at, synced, n = None, b"", 0, False, 0
        rows: list[dict] = []
        marks: list[tuple] = []  # f, b, kind, part, nth

        def flush():
            cols = _columns([r or dict.fromkeys(NAMES) | {"tags": {}} for r in rows])
            cols += [pa.array([m[i] for m in marks], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
            rows.clear(), marks.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*NAMES, "f", "b", "kind", "part", "nth"])

        def mark(kind: int, part: bytes) -> None:
            rows.append(None)
            marks.append((*key, kind, part, 0))

        def parse(last: bool) -> None:
            nonlocal raw, at, synced, n
            refs = refs_of[key[0]]
            if not synced:
                if key[1] == 0:
                    try:
                        at = header_of(raw)[2]
                    except Incomplete:
                        return
                elif not last and len(raw) < 1 << 18:
                    return
                else:
                    at = first_record(raw, refs)
                    at = len(raw) if at is None else at
                    if at == len(raw) and not last:
                        raise ValueError("a BAM record as long as a split: raise spark.sql.files.maxPartitionBytes")
                    if not spelled:
                        mark(1, raw[:at])
                synced = True
            while at + 4 <= len(raw):
                size = struct.unpack_from("<i", raw, at)[0]
                if at + 4 + size > len(raw):
                    break
                if spelled and keep(raw, at, refs):
                    rows.append(record_at(raw, at, refs))
                    marks.append((*key, 0, None, n))
                n += 1
                at += 4 + size
            raw, at = raw[at:], 0

        def close() -> None:
            if key is not None:
                parse(True)
                if not synced:
                    raise ValueError("a BAM header that does not end within its split")
                if not spelled:
                    mark(2, raw)

        for batch in batches:
            for f, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (f, b) != key:
                    close()
                    key, raw, at, synced, n = (f, b), b"", 0, False, 0
                if len(data := data.as_py()):
                    raw += _inflate(data)
                    if len(raw) > 1 << 18 or key[1] == 0 and not synced:
                        parse(False)
                if len(rows) > 5000:
                    yield flush()
        close()
        yield flush()

    return run


def read_bam(spark: SparkSession, path, region: str | None = None) -> DataFrame:
    """Alignments of BAM files. Files are read in splits, wherever they are stored: blocks are found by what
    they begin with, the first record of a split by what records look like. Records that lie across two
    splits are put together from both, and an error tells if they don't fit, so no wrong start goes unseen.
    idx grows in the order of files and records.

    region: only alignments that overlap chrom:start-end (counted from 1) or a whole chrom; for chrN that a
    file has not, N is looked for, and neither is an error. Others are passed over before they are spelled.
    """
    refs_of = {r.f: [(x.name, x.length) for x in r.refs] for r in read_bam_headers(spark, path).collect()}  # one row for each file
    place = None
    if region is not None:
        from ..operators.align import parse_region

        chrom, start, end = parse_region(region) if ":" in region else (region, 0, 1 << 40)
        place = {}
        for f, refs in refs_of.items():
            names = [n for n, _ in refs]
            own = chrom if chrom in names else chrom[3:] if chrom.startswith("chr") and chrom[3:] in names else None
            if own is None:
                raise ValueError(f"no reference {chrom} in {f}")
            place[id(refs)] = names.index(own)
        wanted = {f: place[id(refs)] for f, refs in refs_of.items()}
        numbers = set(wanted.values())
        if len(numbers) > 1:
            raise ValueError("files whose references are numbered differently: read them one by one")
        (tid,) = numbers

        def keep(raw: bytes, p: int, refs: list) -> bool:
            _, t, pos, lname, _, _, nops = struct.unpack_from("<iiiBBHH", raw, p)
            if t != tid or pos >= end:
                return False
            return pos + (sum(o >> 4 for o in struct.unpack_from(f"<{nops}I", raw, p + 36 + lname) if OPS[o & 15] in "MDN=X") or 1) > start

    else:
        keep = lambda raw, p, refs: True
    lines = _split_blocks(spark, path)
    marked = ", f string, b long, kind int, part binary, nth long"
    found = lines.mapInArrow(_reader(refs_of, True, keep), FIELDS + marked)
    splits = lines.select("f", "b").distinct()
    ranks = splits.select("f", "b", (F.row_number().over(Window.orderBy("f", "b")) - 1).cast("long").alias("rank"), F.lead("b").over(Window.partitionBy("f").orderBy("b")).alias("next"))  # one row for each split
    if ranks.where("next is not null").isEmpty():
        whole = found.where("kind = 0").select(*NAMES, "f", "b", "nth")
    else:
        ends = lines.mapInArrow(_reader(refs_of, False, keep), FIELDS + marked).where("kind > 0").select("f", "b", "kind", "part")
        tails = ends.where("kind = 2").select("f", "b", F.col("part").alias("tail")).join(ranks.select("f", "b", "next"), ["f", "b"])
        heads = ends.where("kind = 1").select(F.col("f").alias("f2"), F.col("b").alias("b2"), F.col("part").alias("head"))
        across = tails.join(heads, (F.col("f") == F.col("f2")) & (F.col("next") == F.col("b2")), "left").select("f", "b", "tail", "head")

        def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, marks = [], []
                for f, at, tail, head in zip(*(c.to_pylist() for c in b.columns)):
                    raw, p = (tail or b"") + (head or b""), 0
                    while p < len(raw):
                        if p + 4 > len(raw) or p + 4 + struct.unpack_from("<i", raw, p)[0] > len(raw):
                            raise ValueError(f"{f} breaks off, or a record was taken for what it isn't, near the split at {at}")
                        if keep(raw, p, refs_of[f]):
                            rows.append(record_at(raw, p, refs_of[f]))
                            marks.append((f, at, (1 << 31) + p))
                        p += 4 + struct.unpack_from("<i", raw, p)[0]
                yield pa.RecordBatch.from_arrays(_columns(rows) + [pa.array([m[i] for m in marks], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=[*NAMES, "f", "b", "nth"])

        whole = found.where("kind = 0").select(*NAMES, "f", "b", "nth").unionByName(across.mapInArrow(put_together, FIELDS + ", f string, b long, nth long"))
    return whole.join(ranks.select("f", "b", "rank"), ["f", "b"]).select(*NAMES, (F.col("rank") * (1 << 32) + F.col("nth")).alias("idx"))


def write_bam(reads: DataFrame, path: str, references: list[tuple[str, int]], text: str = "") -> None:
    """A folder of BAM files, one for each partition of reads in its order, each with header and end mark.
    The last byte of a block is zero, as blocks are small, so the text writer's line ends complete blocks
    and any store that Spark writes will do."""
    tid = {n: i for i, (n, _) in enumerate(references)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = header_bytes(references, text)

        def out(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in parts], pa.binary())], names=["value"])

        yield out([block(left[k : k + BLOCK]) for k in range(0, len(left), BLOCK)])
        left = b""
        for b in batches:
            for r in b.to_pylist():
                r["tags"] = dict(r["tags"] or ())
                left += record_bytes(r, tid)
                if len(left) >= 1 << 20:
                    whole = len(left) // BLOCK * BLOCK
                    yield out([block(left[k : k + BLOCK]) for k in range(0, whole, BLOCK)])
                    left = left[whole:]
        yield out([block(left[k : k + BLOCK]) for k in range(0, len(left), BLOCK)] + [EOF])

    rows = reads.select(*NAMES).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def read_bgz(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """value and idx of the lines of block-compressed text, read in splits; idx grows in the order of files
    and lines. What a split has before its first line end belongs to the line that the one before broke off."""
    end = (line_sep or "\n").encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, n, first = None, b"", 0, True
        rows: list[tuple] = []  # f, b, nth, kind (0 line, 1 up to the first end, 2 after the last), value

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["f", "b", "nth", "kind", "value"])
            rows.clear()
            return got

        def lines(last: bool) -> None:
            nonlocal raw, n, first
            *whole, raw = raw.split(end)
            for x in whole:
                rows.append((*key, n, int(first and key[1] > 0), x))
                n, first = n + 1, False
            if last:
                rows.append((*key, n, 3 if first and key[1] > 0 else 2, raw))

        for batch in batches:
            for f, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (f, b) != key:
                    if key is not None:
                        lines(True)
                    key, raw, n, first = (f, b), b"", 0, True
                if len(data := data.as_py()):
                    raw += _inflate(data)
                    if end in raw:
                        lines(False)
                if len(rows) > 20_000:
                    yield flush()
        if key is not None:
            lines(True)
        yield flush()

    found = _split_blocks(spark, path).mapInArrow(run, "f string, b long, nth long, kind int, value binary")
    # pieces of broken lines: few, one or two for each split; a line ends with the piece that a line end follows
    pieces = found.where("kind > 0")
    order = Window.partitionBy("f").orderBy("b", "nth")
    pieces = pieces.withColumn("line", F.coalesce(F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = F.array_sort(F.collect_list(F.struct("b", "nth", F.hex("value").alias("v"))))
    joined = pieces.groupBy("f", "line").agg(F.min(F.struct("b", "nth")).alias("at"), F.unhex(F.array_join(F.transform(each, lambda x: x["v"]), "")).alias("value"), F.max("kind").alias("ended"), F.count_if(F.col("kind") == 1).alias("ends"))
    joined = joined.where((F.col("ends") > 0) | (F.length("value") > 0)).select("f", F.col("at.b").alias("b"), F.col("at.nth").alias("nth"), "value")
    every = found.where("kind = 0").select("f", "b", "nth", "value").unionByName(joined)
    splits = _split_blocks(spark, path).select("f", "b").distinct()
    ranks = splits.select(F.col("f").alias("f2"), F.col("b").alias("b2"), (F.row_number().over(Window.orderBy("f", "b")) - 1).cast("long").alias("rank"))  # one row for each split
    return every.join(ranks, (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2"))).select(F.col("value").cast("string").alias("value"), (F.col("rank") * (1 << 32) + F.col("nth")).alias("idx"))


def write_bgz(lines: DataFrame, path: str) -> None:
    """A folder of block-compressed text, one file for each partition of lines (value)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = b""
        for b in batches:
            left += b"".join([x.encode() + b"\n" for x in b.column(0).to_pylist()])
            whole = len(left) // BLOCK * BLOCK
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([block(left[k : k + BLOCK])[:-1] for k in range(0, whole, BLOCK)], pa.binary())], names=["value"])
                left = left[whole:]
        yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in ([block(left)] if left else []) + [EOF]], pa.binary())], names=["value"])

    rows = lines.select("value").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def check(spark: SparkSession, path, fmt: str = "sam") -> tuple[bool, str]:
    """(whether every record can be read, number of records or what is wrong)."""
    from .text import read_sam

    try:
        df = read_bam(spark, path) if fmt == "bam" else read_sam(spark, path)
        return True, str(df.where("flag is not null").count())
    except Exception as e:  # a reader's error is the answer
        said = [x.strip() for x in str(e).splitlines() if x.strip()]
        return False, next((x for x in said if x.startswith(("ValueError", "zlib.error", "struct.error"))), said[0] if said else type(e).__name__)
