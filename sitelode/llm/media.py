"""ISO base media containers: writing texts as 8-bit sample tracks, and walking any container's boxes.

``probe`` reads a container without touching its payload: it walks nested boxes (32-bit, 64-bit and to-the-end sizes),
decodes the sample tables (sizes, chunk runs, 32- and 64-bit chunk offsets, durations, sync samples) and returns codec,
timescale, duration and the byte range of every key sample. ``wrap`` stores bytes as one track of fixed-size samples.

Samples of movie fragments (``moof`` with ``tfhd`` and ``trun`` under the defaults of ``trex``) follow those of the sample
tables. A file has a row for its first track, and an array with all of them.

A null or damaged container gives an ``error`` and null fields, never a failed job; a null text counts as empty. Repeated
rows and ids are described each on their own; an empty table gives no rows; only the id column and the text or media column
are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 64  # bytes in a sample
KEY_EVERY = 16  # every so many samples is a key sample
CHUNK = 32  # samples in a chunk
RATE = 8000  # samples (bytes) a second
CODEC = b"raw "
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes below this depth are not opened; real files stay under ten.
DEEPEST = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes, codec: bytes = CODEC) -> bytes:
    """A container with one track that holds ``payload``, whose length must be a multiple of SAMPLE."""
    n, size = len(payload) // SAMPLE, len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    head = struct.pack(">I4s", 8 + size, b"mdat") if size + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", 16 + size)
    first = len(ftyp) + len(head)
    chunks = -(-n // CHUNK)
    offsets = [first + i * CHUNK * SAMPLE for i in range(chunks)]
    wide = bool(offsets) and offsets[-1] >= 1 << 32
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK), (chunks, n % CHUNK)] if chunks > 1 else [(1, n)]
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full(b"stts", 0, 0, struct.pack(">III", 1, n, SAMPLE)),
        full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
        full(b"stsz", 0, 0, struct.pack(">II", SAMPLE, n)),
        full(b"co64", 0, 0, struct.pack(f">I{chunks}Q", chunks, *offsets)) if wide else full(b"stco", 0, 0, struct.pack(f">I{chunks}I", chunks, *offsets)),
    )
    long = size >= 1 << 32
    times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, RATE, size)
    mdia = box(b"mdia", full(b"mdhd", int(long), 0, times, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(13)), box(b"minf", full(b"smhd", 0, 0, bytes(4)), stbl))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    mvhd = full(b"mvhd", int(long), 0, times, struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    place = struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, size)
    tkhd = full(b"tkhd", int(long), 7, place, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
    return ftyp + head + payload + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(start, kind, start of body, end, depth) of every box, parents first."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} ends at {stop}, outside {end}")
        yield start, kind, body, stop, depth
        if kind in NESTED and depth < DEEPEST:
            yield from walk(data, body, stop, depth + 1)
        start = stop
    if start != end:
        raise ValueError(f"{end - start} bytes after the last box")


def _table(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    if n * kind.itemsize > end - at:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def probe(data: bytes) -> list[dict]:
    """One dict per track: codec, timescale, duration, offsets and sizes of all samples, and which are key samples."""
    view, tracks, now = memoryview(data), [], {}
    defaults: dict[int, tuple[int, int, int]] = {}  # by track: duration, size and flags of a fragment's samples
    moof = run = 0
    for start, kind, at, end, _ in walk(view, 0, len(view)):
        if kind == b"trak":
            tracks.append(now := {})
        elif kind == b"tkhd":
            (now["id"],) = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))
        elif kind == b"mdhd":
            long = view[at] == 1
            now["timescale"], now["duration"] = struct.unpack_from(">IQ" if long else ">II", view, at + (20 if long else 12))
        elif kind == b"stsd":
            now["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", view, at + 4)
            now["sizes"] = np.full(min(n, len(view)), size, np.int64) if size else _table(view, at + 12, end, n, ">u4")
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", view, at + 4)
            runs = _table(view, at + 8, end, 2 * n, ">u4").reshape(-1, 2)
            now["ticks"] = int((runs[:, 0] * runs[:, 1]).sum())
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", view, at + 4)
            now["runs"] = _table(view, at + 8, end, 3 * n, ">u4").reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", view, at + 4)
            now["chunks"] = _table(view, at + 8, end, n, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", view, at + 4)
            now["keys"] = _table(view, at + 8, end, n, ">u4") - 1
        elif kind == b"trex":
            track, _, *values = struct.unpack_from(">5I", view, at + 4)
            defaults[track] = tuple(values)
        elif kind == b"moof":
            moof = run = start
        elif kind == b"tfhd":
            now, base, fallback = _fragment_head(view, at, tracks, defaults, moof, run)
            run = base
        elif kind == b"trun":
            run = _fragment_run(view, at, end, now, base, fallback, run)
    return [_placed(t, len(view)) for t in tracks]


# The flag of a sample that is no key sample, and what the flags of a fragment's boxes announce.
NOT_SYNC = 0x10000


def _fragment_head(view: memoryview, at: int, tracks: list[dict], defaults: dict, moof: int, run: int) -> tuple[dict, int, list[int]]:
    """(track, base offset, default duration, size and flags) of a track fragment."""
    flags, number = struct.unpack_from(">II", view, at)
    flags &= 0xFFFFFF
    track = next((t for t in tracks if t.get("id") == number), None)
    if track is None:
        raise ValueError(f"a fragment of track {number}, which is not there")
    at += 8
    base = moof if flags & 0x20000 else run
    if flags & 0x1:
        (base,) = struct.unpack_from(">Q", view, at)
        at += 8
    at += 4 * bool(flags & 0x2)
    values = list(defaults.get(number, (0, 0, 0)))
    for i, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            (values[i],) = struct.unpack_from(">I", view, at)
            at += 4
    return track, base, values


def _fragment_run(view: memoryview, at: int, end: int, track: dict, base: int, fallback: list[int], run: int) -> int:
    """Adds the samples of a run to its track; where the next one begins."""
    flags, n = struct.unpack_from(">II", view, at)
    flags &= 0xFFFFFF
    at += 8
    if flags & 0x1:
        run = base + struct.unpack_from(">i", view, at)[0]
        at += 4
    first = None
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", view, at)
        at += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if not fields and n > len(view):
        raise ValueError("a run has more samples than the file bytes")
    table = _table(view, at, end, n * len(fields), ">u4").reshape(n, len(fields))
    column = lambda bit, i: table[:, fields.index(bit)] if bit in fields else np.full(n, fallback[i], np.int64)
    durations, sizes, marks = column(0x100, 0), column(0x200, 1), column(0x400, 2).copy()
    if first is not None and n:
        marks[0] = first
    track.setdefault("more", []).append((run + np.cumsum(sizes) - sizes, sizes, (marks & NOT_SYNC) == 0, int(durations.sum())))
    return run + int(sizes.sum())


def _placed(track: dict, length: int) -> dict:
    """Resolves chunk runs to the byte offset of each sample."""
    sizes, chunks, runs = track["sizes"], track["chunks"], track["runs"]
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
    if per.sum() != len(sizes):
        raise ValueError(f"chunks hold {per.sum()} samples, the size table {len(sizes)}")
    firsts = np.cumsum(per) - per
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - (before[firsts] if len(firsts) else 0), per) + before
    keys = track.get("keys", np.arange(len(sizes)))  # no sync table: every sample is a key sample
    keys, more = keys[keys < len(sizes)], track.get("more", [])
    if more:
        held = len(sizes) + np.cumsum([0, *(len(m[1]) for m in more)])
        keys = np.concatenate([keys, *(a + np.flatnonzero(m[2]) for a, m in zip(held[:-1], more, strict=True))])
        offsets, sizes = (np.concatenate([x, *(m[i] for m in more)]) for i, x in ((0, offsets), (1, sizes)))
    if len(sizes) and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > length):
        raise ValueError("a sample lies outside the file")
    ticks = track.get("ticks", 0) + sum(m[3] for m in more)
    return {"codec": track["codec"], "timescale": track["timescale"], "duration": (0 if more else track.get("duration")) or ticks, "offsets": offsets, "sizes": sizes, "keys": keys}


TRACK = "codec string, timescale long, duration long, n_samples long, key_offsets array<long>, key_sizes array<long>"
PROBED = f"{TRACK}, error string"


def track_row(track: dict) -> dict:
    keys = track["keys"]
    return {"codec": track["codec"], "timescale": track["timescale"], "duration": track["duration"], "n_samples": len(track["sizes"]), "key_offsets": track["offsets"][keys].tolist(), "key_sizes": track["sizes"][keys].tolist()}


def probed_row(data: bytes | None) -> dict:
    """The columns of PROBED for a container's first track, and ``tracks`` for all of them."""
    row = dict.fromkeys(x.split()[0] for x in PROBED.split(", ")) | {"tracks": None}
    if data is None:
        return row | {"error": "null"}
    try:
        tracks = [track_row(t) for t in probe(data)]
        return row | tracks[0] | {"tracks": tracks}
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return row | {"error": f"{type(e).__name__}: {e}"[:200]}


def probe_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, PROBED and ``tracks`` for a column of containers; only the boxes are read, no sample."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = pa.schema([*_PROBED_ARROW, pa.field("tracks", pa.list_(pa.struct(_PROBED_ARROW)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [probed_row(x) for x in batch.column(1).to_pylist()]
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["_id", *made.schema.names])

    inner = ", ".join(f"{n}: {k}" for n, k in (x.split(" ", 1) for x in PROBED.split(", ")))
    return slim.mapInArrow(run, f"_id {kind}, {PROBED}, tracks array<struct<{inner}>>").withColumnRenamed("_id", id_col)


_PROBED_ARROW = pa.schema([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("key_offsets", pa.list_(pa.int64())), ("key_sizes", pa.list_(pa.int64())), ("error", pa.string())])


def padded(text: bytes) -> bytes:
    """Zeros up to a positive multiple of SAMPLE."""
    return text + bytes(-len(text) % SAMPLE if text else SAMPLE)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text in a container, reads the container back and describes it; ``keep_media`` adds the container.

    The digests are taken over the samples found through the decoded tables, not over the input.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {PROBED}" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *_PROBED_ARROW, *([("media", pa.binary())] if keep_media else [])]
        schema = pa.schema([f if isinstance(f, pa.Field) else pa.field(*f) for f in fields])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.RecordBatch.from_pylist([_described(x.as_py(), keep_media) for x in part.column(1)], schema=schema)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], names=["_id", *schema.names])

    return slim.mapInArrow(run, shape).withColumnRenamed("_id", id_col)


def _described(text: bytes, keep_media: bool) -> dict:
    media = wrap(padded(text))
    track = probe(media)[0]
    row = track_row(track) | {"error": None}
    read = read_samples(media, track)
    ranges = ",".join(f"{a}+{b}" for a, b in zip(row["key_offsets"], row["key_sizes"], strict=True))
    feature = f"{row['codec'].strip()}|{row['timescale']}|{row['duration']}|{row['n_samples']}|{len(row['key_offsets'])}|{hashlib.sha256(ranges.encode()).hexdigest()[:16]}"
    return row | {"n_bytes": len(text), "payload_bytes": len(read), "payload_sha256": hashlib.sha256(read).hexdigest(), "tail_crc32": zlib.crc32(read[-SAMPLE:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature} | ({"media": media} if keep_media else {})


def read_samples(media: bytes, track: dict) -> bytes:
    """All samples in order; samples that follow each other in the file are read together."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.append(0, breaks)]
    ends = (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
