"""Media columns: AVI files of lossless motion-JPEG, their clips, and payloads stored in them.

A payload becomes frames of 24 x 24 grey samples, each a JPEG of the lossless process (SOF3, 8 bits, predictor 1), in a
RIFF AVI with an idx1 index. The Huffman table gives a difference of s bits a code of 9 - s bits, so that every sample takes
9 bits, code and extra bits together: a legal table (only the all-ones code is left over, as the standard asks) that numpy
can decode without a loop over samples. Readers go by the index: parse RIFF, find frames, parse markers, decode; files of other makers
with baseline or lossless frames are read too (jpeg.py), whatever their size and rate.

Shots: grey histograms of neighbouring frames are compared; a cut is where the difference stands out from the mean and
deviation of the differences around it. Clips carry their frames and times.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import jpeg
from .common import blob, chunks, flat, table

SIDE = 24
FRAME = SIDE * SIDE
RATE = 24
BINS = 16
#: Frames on each side that the adaptive threshold looks at, its deviations, and the least difference of a cut.
REACH, DEVIATIONS, LEAST = 8, 3.0, 0.15

_CODED = FRAME * 9 // 8
# categories 8, 7, .. 0 have codes of 1, 2, .. 9 bits
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = (
    b"\xff\xd8"
    + _DHT
    + b"\xff\xc3"
    + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1)
    + bytes([1, 0x11, 0])
    + b"\xff\xda"
    + struct.pack(">HB", 8, 1)
    + bytes([1, 0, 1, 0, 0])
)
_TAIL = b"\xff\xd9"


def _field_of() -> np.ndarray:
    """The 9-bit field of each difference from -255 to 255: category code, then the extra bits."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2 if s < 9 else 0  # ones, then a zero
        extra = d if d >= 0 else d + (1 << s) - 1
        out[d + 255] = code << s | extra
    return out


_FIELD = _field_of()
_DIFFERENCE = np.zeros(512, np.int16)
_DIFFERENCE[_FIELD] = np.arange(-255, 256)


def _pack(fields: np.ndarray) -> np.ndarray:
    """9-bit fields, eight to nine bytes."""
    f = fields.reshape(-1, 8).astype(np.uint16)
    out = np.empty((len(f), 9), np.uint8)
    out[:, 0] = f[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (f[:, i - 1] << (8 - i) | f[:, i] >> (i + 1)) & 0xFF
    out[:, 8] = f[:, 7] & 0xFF
    return out.reshape(-1)


def _unpack(coded: np.ndarray) -> np.ndarray:
    b = coded.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        out[:, i] = (b[:, i] << (i + 1) | b[:, i + 1] >> (7 - i)) & 0x1FF
    return out.reshape(-1)


def _predicted(samples: np.ndarray) -> np.ndarray:
    """Predictor 1: the left neighbour; the sample above at a line's start; 128 for the first. samples: (n, 24, 24)."""
    out = np.empty_like(samples)
    out[:, :, 1:] = samples[:, :, :-1]
    out[:, 1:, 0] = samples[:, :-1, 0]
    out[:, 0, 0] = 128
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI whose frames hold the payload, a positive multiple of 576 bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).astype(np.int16)
    n = len(samples)
    coded = _pack(_FIELD[(samples - _predicted(samples)).reshape(-1) + 255])
    # a byte 255 in coded data is followed by a stuffed 0
    full = np.flatnonzero(coded == 0xFF)
    stuffed = np.zeros(len(coded) + len(full), np.uint8)
    at = np.arange(len(coded)) + np.searchsorted(full, np.arange(len(coded)))
    stuffed[at] = coded
    ends = np.arange(1, n + 1) * _CODED
    ends = ends + np.searchsorted(full, ends)
    body = stuffed.tobytes()
    parts, index, offset, first = [], [], 4, 0
    for end in ends.tolist():
        size = len(_HEAD) + end - first + 2
        parts.append(b"00dc" + struct.pack("<I", size) + _HEAD + body[first:end] + _TAIL + b"\0" * (size % 2))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, offset, size))
        offset += 8 + size + size % 2
        first = end
    largest = max(len(p) for p in parts)
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl)
    movi = _chunk(b"LIST", b"movi" + b"".join(parts))
    riff = b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def _chunks_of(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the RIFF chunks between two places; LIST chunks by their list type, their body behind it."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", media, at)
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk passes its parent's end")
        if name == b"LIST":
            yield media[at + 8 : at + 12], at + 12, at + 8 + size
        else:
            yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def _lists_of(media: bytes) -> dict[bytes, tuple[int, int]]:
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI")
    found: dict[bytes, tuple[int, int]] = {}
    for name, a, b in _chunks_of(media, 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0])):
        found.setdefault(name, (a, b))
    if b"movi" not in found:
        raise ValueError("no movi list")
    return found


def read_index(media: bytes) -> np.ndarray:
    """(begin, end) of each video frame in the file, from idx1, or from the movi list where there is no index."""
    parts = _lists_of(media)
    movi = parts[b"movi"]
    if b"idx1" not in parts:
        flat_list = [c for name, a, b in _chunks_of(media, *movi) for c in (_chunks_of(media, a, b) if name == b"rec " else [(name, a, b)])]
        return np.array([(a, b) for name, a, b in flat_list if name[2:] in (b"dc", b"db")], np.int64).reshape(-1, 2)
    a, b = parts[b"idx1"]
    rows = np.frombuffer(media, np.uint8, (b - a) // 16 * 16, a).reshape(-1, 16)
    rows = rows[(rows[:, 2] == ord("d")) & ((rows[:, 3] == ord("c")) | (rows[:, 3] == ord("b")))]
    place, size = (np.ascontiguousarray(rows[:, i : i + 4]).view("<u4")[:, 0].astype(np.int64) for i in (8, 12))
    if not len(rows):
        return np.empty((0, 2), np.int64)
    for base in (movi[0] - 4, 0):  # offsets count from the list's type, in some files from the file's beginning
        first = base + int(place[0])
        if media[first : first + 4] == rows[0, :4].tobytes():
            break
    else:
        raise ValueError("the index points at no frame")
    begin = place + base + 8
    if (begin + size > len(media)).any():
        raise ValueError("the index passes the file's end")
    return np.stack((begin, begin + size), 1)


def read_rate(media: bytes) -> float:
    """Frames a second by the video stream's header, RATE where it does not say."""
    at = _lists_of(media).get(b"hdrl", (0, 0))
    for name, a, b in _chunks_of(media, *at):
        for inner, x, y in _chunks_of(media, a, b) if name == b"strl" else ():
            if inner == b"strh" and media[x : x + 4] == b"vids" and y - x >= 28:
                scale, rate = struct.unpack_from("<II", media, x + 20)
                if scale and rate:
                    return rate / scale
    return float(RATE)


def read_frames(media: bytes) -> np.ndarray:
    """All frames as (n, height, width) grey samples, decoded from the stored bytes by the index; ValueError if unreadable."""
    try:
        spans = read_index(media)
    except (struct.error, IndexError) as e:
        raise ValueError("a broken RIFF file") from e
    if not len(spans):
        raise ValueError("no video frame")
    if all(media[a : a + len(_HEAD)] == _HEAD and media[b - 2 : b] == _TAIL for a, b in spans.tolist()):
        frames = _own_frames(media, spans)
        if frames is not None:
            return frames
    frames = [jpeg.decode(media[a:b]) for a, b in spans.tolist() if b > a]  # an empty chunk repeats the frame before
    if len({f.shape for f in frames}) != 1:
        raise ValueError("frames of different sizes")
    return np.stack(frames)


def _own_frames(media: bytes, spans: np.ndarray) -> np.ndarray | None:
    """Frames under write_avi's header, all at once; None if their coded data has another length."""
    data = np.frombuffer(media, np.uint8)
    begin, end = spans[:, 0] + len(_HEAD), spans[:, 1] - 2
    size = end - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    coded = data[at]
    keep = np.ones(len(coded), bool)
    keep[1:] = (coded[1:] != 0) | (coded[:-1] != 0xFF)
    coded = coded[keep]
    if len(coded) != len(spans) * _CODED:
        return None
    d = _DIFFERENCE[_unpack(coded)].reshape(-1, SIDE, SIDE).astype(np.int64)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2).astype(np.uint8)


def shots_of(frames: np.ndarray) -> np.ndarray:
    """The first frame of every shot."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat_frames = frames.reshape(n, -1)
    cell = (np.arange(n)[:, None] * BINS + (flat_frames >> 4)).reshape(-1)
    histogram = np.bincount(cell, minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * flat_frames.shape[1])
    m = len(change)
    sums, squares = np.concatenate(([0], np.cumsum(change))), np.concatenate(([0], np.cumsum(change**2)))
    low, high = np.maximum(np.arange(m) - REACH, 0), np.minimum(np.arange(m) + REACH + 1, m)
    k = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change) / k
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - change**2) / k - mean**2, 0))
    cut = (change >= LEAST) & (change > mean + DEVIATIONS * deviation)
    return np.concatenate(([0], np.flatnonzero(cut) + 1))


_CLIP = pa.struct([("shot", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64())])


def clips_of(frames: np.ndarray, rate: float = RATE) -> list[dict]:
    first = shots_of(frames)
    last = np.append(first[1:], len(frames))
    light = np.add.reduceat(frames.reshape(len(frames), -1).sum(axis=1, dtype=np.int64), first) / ((last - first) * frames[0].size)
    return [
        {"shot": i, "first_frame": int(a), "frames": int(b - a), "start_s": int(a) / rate, "end_s": int(b) / rate, "mean": float(m)}
        for i, (a, b, m) in enumerate(zip(first, last, light, strict=True))
    ]


def store(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns), n_bytes and media (an AVI file) for every row.

    The UTF-8 bytes of the text, with bytes 255 up to a positive multiple of 576, are the payload; null texts are empty. Equal
    texts give equal files.
    """
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*carry).alias("row"), blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string("n_bytes long, media binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                media = []
                for i in range(a, b):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    media.append(write_avi(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], ["row", "n_bytes", "media"]
                )

    return rows.mapInArrow(run, schema)


def decode(files: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all but the media), media, payload (all samples read back), clips (timed
    shots) and status of every row of files.

    status is "ok", or says why a file cannot be read: null or empty media, no RIFF AVI, cut-off chunks, frames of another
    process. Such a row has a null payload and no clips; the job goes on. Repeated rows are each decoded, an empty table gives no
    rows, carried columns may have any name. Rows are taken by their bytes, a long file alone.
    """
    carry = [c for c in files.columns if c != media_col] if carry is None else carry
    rows = files.select(F.struct(*carry).alias("row"), F.col(media_col).cast("binary").alias("media"))
    rest = "media binary, payload binary, clips array<struct<shot:int,first_frame:int,frames:int,start_s:double,end_s:double,mean:double>>, status string"
    schema = StructType([rows.schema["row"], *_parse_datatype_string(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column("media"))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                payload, clips, status = [], [], []
                for media in part.column("media"):
                    raw, frames, said = media.as_py(), None, "ok"
                    try:
                        if not raw:
                            raise ValueError("no media")
                        frames = read_frames(raw)
                    except ValueError as e:
                        said = str(e)
                    payload.append(None if frames is None else frames.tobytes())
                    clips.append([] if frames is None else clips_of(frames, read_rate(raw)))
                    status.append(said)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("media"), pa.array(payload, pa.binary()), pa.array(clips, pa.list_(_CLIP)), pa.array(status, pa.string())],
                    ["row", "media", "payload", "clips", "status"],
                )

    return rows.mapInArrow(run, schema)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """row and one clip's columns for each clip."""
    return decoded.select("row", F.inline("clips"))


def feature(clips: Column) -> Column:
    """frames, shots, longest shot and mean light of a file, as one string."""
    frames = F.aggregate(clips, F.lit(0), lambda s, c: s + c["frames"])
    longest = F.array_max(F.transform(clips, lambda c: c["frames"]))
    light = F.aggregate(clips, F.lit(0.0), lambda s, c: s + c["mean"] * c["frames"]) / frames
    return F.format_string("frames=%d;shots=%d;longest=%d;light=%.3f", frames, F.size(clips), longest, light)


def op9_motion_jpeg(spark, sf_dir: str) -> DataFrame:
    out = decode(store(table(spark, sf_dir, "documents"), carry=["doc_id"]))
    return out.select(
        "row.row.doc_id",
        "row.n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature(F.col("clips")).alias("feature"),
    )
