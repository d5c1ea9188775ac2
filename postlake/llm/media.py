"""Media columns: ISO base media files in a binary column, described without decoding their samples.

`write` makes a movie of one raw 8-bit grey video track: each sample is one frame of 24 x 24 bytes, and every
KEY_EVERY-th frame is marked a sync sample. `describe` walks the nested boxes of any such file, decodes the
sample tables (stts, stsz or stz2, stsc, stco or co64, stss) and gives codec, duration and the byte ranges of
key frames; sample bytes are only addressed. A file that can't be read gives a null description and the reason.

Null text counts as empty, and empty content still has one frame of padding. Equal texts give equal files:
nothing in a file depends on time or place.
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

from .common import new_path, over_batches, prepare

SIDE = 24
FRAME = SIDE * SIDE
KEY_EVERY = 12
RATE = 25
CHUNK_FRAMES = 64
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def payload_of(data: bytes) -> bytes:
    """The bytes, then bytes 255 up to a positive multiple of the frame."""
    frames = max(1, -(-len(data) // FRAME))
    return data + b"\xff" * (frames * FRAME - len(data))


def write(payload: bytes) -> bytes:
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK_FRAMES)
    keys = range(1, frames + 1, KEY_EVERY)

    def movie(offsets: list[int]) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        reference = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), reference, table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), info)
        head = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        whole = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", whole, _box(b"trak", head, media))

    brand = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    first = len(brand) + len(movie([0] * chunks)) + 16
    offsets = [first + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
    return brand + movie(offsets) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, start and end of content) of every box, nested ones after their parent, at any depth."""
    start, end, path, outer = 0, len(data), (), []
    while start + 8 <= end or outer:
        if start + 8 > end:  # back to where the box around ends
            start, (end, path) = end, outer.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            outer.append((end, path))
            start, end, path = start + head, start + size, (*path, kind)
        else:
            start += size


def _table(data: bytes, at: int, kind: str, columns: int = 1) -> np.ndarray:
    """A count, then so many big-endian rows."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def tracks(data: bytes) -> list[dict]:
    """One entry a track: codec, timescale, duration, and offset, size and sync mark of every sample."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in boxes(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (start, end))
    out = []
    for t in found:
        at = {k: v[0] for k, v in t.items()}
        codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1")
        wide = data[at[b"mdhd"]] == 1
        timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, at[b"mdhd"] + (20 if wide else 12))
        if b"stsz" in at:
            each, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
            if n * max(each, 4 * (not each)) > len(data):
                raise ValueError("more samples than the file has room for")
            sizes = np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, at[b"stsz"] + 12).astype(np.int64)
        else:
            bits, n = struct.unpack_from(">II", data, at[b"stz2"] + 4)
            raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), at[b"stz2"] + 12)
            sizes = (np.stack([raw >> 4, raw & 15], 1).ravel()[:n] if bits == 4 else raw if bits == 8 else raw.view(">u2")).astype(np.int64)
        offsets = (_table(data, at[b"co64"], ">u8") if b"co64" in at else _table(data, at[b"stco"], ">u4")).ravel()
        runs = _table(data, at[b"stsc"], ">u4", 3)
        if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(offsets)):
            raise ValueError("the runs of chunks are out of order")
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(offsets) + 1)))
        if per_chunk.sum() != len(sizes):
            raise ValueError("the sample tables disagree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        places = np.repeat(offsets, per_chunk) + before - np.repeat(before[np.minimum(first, max(0, len(before) - 1))] if len(before) else first, per_chunk)
        if len(places) and (places + sizes).max() > len(data):
            raise ValueError("a sample lies outside the file")
        sync = np.ones(len(sizes), bool)
        if b"stss" in at:
            sync[:] = False
            marks = _table(data, at[b"stss"], ">u4").ravel() - 1
            if len(marks) and (marks.min() < 0 or marks.max() >= len(sizes)):
                raise ValueError("a sync mark lies outside the samples")
            sync[marks] = True
        out.append({"codec": codec, "timescale": timescale, "duration": duration, "ticks": int(np.prod(_table(data, at[b"stts"], ">u4", 2), axis=1).sum()), "offsets": places, "sizes": sizes, "sync": sync})
    return out


DESCRIPTION = "codec string, timescale long, duration long, samples long, keyframes array<struct<offset:long,size:long>>, error string"


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """The columns of DESCRIPTION about the first track beside all others; null media give nulls."""

    @F.pandas_udf(DESCRIPTION)
    def read(files):
        import pandas as pd

        rows = []
        for data in files:
            row = dict.fromkeys(("codec", "timescale", "duration", "samples", "keyframes", "error"))
            try:
                if data is not None:
                    t = tracks(bytes(data))[0]
                    keys = [{"offset": int(o), "size": int(s)} for o, s in zip(t["offsets"][t["sync"]], t["sizes"][t["sync"]], strict=True)]
                    row |= {"codec": t["codec"], "timescale": t["timescale"], "duration": t["ticks"], "samples": len(t["sizes"]), "keyframes": keys}
            except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
                row["error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        return pd.DataFrame(rows, columns=["codec", "timescale", "duration", "samples", "keyframes", "error"])

    return media.withColumn("description", read(column)).select(*media.columns, "description.*")


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media file of every text, written to shared storage and read again."""
    spark = prepare(documents.sparkSession)

    def build(batch: pa.RecordBatch) -> dict:
        data = [t or b"" for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array([write(payload_of(d)) for d in data], pa.binary())}

    path = new_path(spark, "media")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    over_batches(rows, build, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def digest(stored: DataFrame) -> DataFrame:
    """Read the samples back from the stored files by their tables, sum files and payloads up, and list key-frame ranges."""

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes")}
        for data in batch["media"].to_pylist():
            t = tracks(data)[0]
            cuts = np.flatnonzero(t["offsets"][1:] != t["offsets"][:-1] + t["sizes"][:-1]) + 1
            parts = [data[t["offsets"][s[0]] : t["offsets"][s[-1]] + t["sizes"][s[-1]]] for s in np.split(np.arange(len(t["sizes"])), cuts)]
            payload = b"".join(parts)
            keys = np.stack([t["offsets"][t["sync"]], t["sizes"][t["sync"]]], 1).astype("<i8")
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["keyframes"].append([{"offset": int(o), "size": int(n)} for o, n in keys.tolist()])
            out["feature"].append(f"codec={t['codec'].strip()};duration={t['ticks']}/{t['timescale']};samples={len(t['sizes'])};keyframes={len(keys)};first={keys[0, 0]};ranges={zlib.crc32(keys.tobytes()):08x}")
        kinds = dict.fromkeys(("payload_sha256", "media_sha256", "feature"), pa.string()) | {"keyframes": pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))}
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"]} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<offset:long,size:long>>"
    return over_batches(stored, read, schema)
