"""Media columns: AVI files with motion-JPEG video, their frames, shots and timed clips.

A payload of bytes is stored as 8-bit grey samples, 64 a line, in lossless JPEG frames (process 14, predictor 1,
ITU-T T.81 annex H) inside a RIFF AVI file with an `idx1` index. All frames of a file share one size; the
last one is filled up with zeros and the payload's length is kept in a `plen` chunk of the header list.

The Huffman table gives the category of a difference of s extra bits a code of 9 - s bits (9 for s = 0, which
leaves the code of all ones unused), so each sample takes 9 bits and whole frames are coded and decoded as
arrays. The reader takes other files too: baseline motion JPEG with any tables, of which it keeps the luminance, and
lossless frames with any table; see `jpeg`. It finds frames by the index, whose places count from the `movi` list or from
the file's start, and by walking that list where there is no index.

Shots: a cut stands before frame i where the grey histograms of frames i - 1 and i differ (half the L1
distance of 16 bins, as a share of samples) by more than both `least` and mean + `k` deviations of the
previous `memory` differences since the last cut. Clips are the runs of frames between cuts, with times.

Defined results: a null or empty payload is stored as 64 zero bytes; equal payloads, repeated rows too, give equal
files; very long texts are stored whole; a media value that isn't such a file, or is null, has no frames, no clips and
a null payload; an empty table gives none; other columns pass through but for the outputs' names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .arrays import chunks
from .spark_util import in_arrow

WIDTH, HEIGHT, RATE = 64, 32, 25
#: Fixed values of the JPEG (T.81) and RIFF AVI formats.
SOI, EOI, SOF3, DHT, SOS = b"\xff\xd8", b"\xff\xd9", 0xC3, 0xC4, 0xDA
KEYFRAME, HAS_INDEX = 0x10, 0x10


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """9-bit words by difference + 255, and differences by word (999: none)."""
    words, back = np.zeros(511, np.uint16), np.full(512, 999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        bits = 9 - s if s else 9
        code = (1 << bits) - 2
        extra = d if d >= 0 else d + (1 << s) - 1
        words[d + 255] = code << s | extra
        back[words[d + 255]] = d
    return words, back


WORDS, DIFFERENCES = _code_table()
_SHIFTS = np.arange(8, -1, -1, dtype=np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Codes of 1 to 8 bits stand for 8 to 1 extra bits, the one of 9 bits for none.
_TABLE = _segment(DHT, bytes([0, *([1] * 9), *([0] * 7), 8, 7, 6, 5, 4, 3, 2, 1, 0]))


def _frame_head(height: int) -> bytes:
    return SOI + _TABLE + _segment(SOF3, struct.pack(">BHHB", 8, height, WIDTH, 1) + bytes([1, 0x11, 0])) + _segment(SOS, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of frames (n, height, 64) of 8-bit samples."""
    n, height, width = samples.shape
    x = samples.astype(np.int16)
    diff = x.copy()
    diff[:, :, 1:] -= x[:, :, :-1]
    diff[:, 1:, 0] -= x[:, :-1, 0]
    diff[:, 0, 0] -= 128
    words = WORDS[diff.reshape(n, -1) + 255]
    bits = ((words[:, :, None] >> _SHIFTS) & 1).astype(np.uint8).reshape(n, -1)
    packed = np.packbits(bits, axis=1)
    head = _frame_head(height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + EOI for row in packed]


def decode_frame(data: bytes) -> np.ndarray:
    """Samples (height, width) of a JPEG file: whole arrays at once where it has the table above, else code by code."""
    start = len(SOI) + len(_TABLE)
    head = data[start : start + 2 + 2 + 11]
    if data[:start] != SOI + _TABLE or len(head) < 15 or head != _frame_head(*struct.unpack_from(">H", head, 5))[start : start + 2 + 2 + 11]:
        return jpeg.decode(data)
    shape = (*struct.unpack_from(">H", head, 5), WIDTH)
    at = len(_frame_head(shape[0]))
    if data[:at] != _frame_head(shape[0]):
        return jpeg.decode(data)
    packed = np.frombuffer(data[at : data.rindex(EOI)].replace(b"\xff\x00", b"\xff"), np.uint8)
    count = shape[0] * shape[1]
    if 8 * len(packed) < 9 * count:
        raise ValueError("a frame is too short")
    bits = np.unpackbits(packed, count=9 * count).reshape(count, 9)
    diff = DIFFERENCES[bits.astype(np.uint16) @ (1 << _SHIFTS).astype(np.uint16)].astype(np.int32).reshape(shape)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return np.cumsum(diff, axis=1).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(payload: bytes, rate: int = RATE, height: int = HEIGHT) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 64."""
    lines = len(payload) // WIDTH
    high = min(height, lines)
    count = -(-lines // high)
    raw = np.zeros(count * high * WIDTH, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(raw.reshape(count, high, WIDTH))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, HAS_INDEX, count, 0, 1, largest, WIDTH, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, high, 1, 8, b"MJPG", WIDTH * high, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)) + _chunk(b"plen", struct.pack("<Q", len(payload))))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", KEYFRAME, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> dict:
    """payload length, frame rate and the frames' places (start, length) of an AVI file; raises ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    found: dict = {"length": None, "rate": RATE, "frames": []}
    movi = index = None
    todo = [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"strh":
                scale, rate = struct.unpack_from("<II", data, at + 28)
                found["rate"] = rate / max(scale, 1)
            elif name == b"plen":
                found["length"] = struct.unpack_from("<Q", data, at + 8)[0]
            elif name == b"idx1":
                index = (at + 8, at + 8 + size)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no frames")
    if index:
        entries = [struct.unpack_from("<4sIII", data, at) for at in range(index[0], index[1] - 15, 16)]
        entries = [(name, offset, size) for name, _, offset, size in entries if name[2:] in (b"dc", b"db")]
        base = movi[0] if entries and data[movi[0] + entries[0][1] : movi[0] + entries[0][1] + 4] == entries[0][0] else 0
        found["frames"] = [(base + offset + 8, size) for _, offset, size in entries]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                found["frames"].append((at + 8, size))
            at += 12 if data[at : at + 4] == b"LIST" else 8 + size + (size & 1)  # records of a list stand in it
    return found


def decode_avi(data: bytes) -> tuple[np.ndarray, float, bytes]:
    """Frames, their rate and the payload; frames are decoded each from its own place in the index."""
    head = read_avi(data)
    if not head["frames"]:
        raise ValueError("no frames")
    frames = np.stack([decode_frame(data[a : a + n]) for a, n in head["frames"]])
    raw = frames.tobytes()
    return frames, head["rate"], raw[: head["length"]] if head["length"] is not None else raw


def shots(frames: np.ndarray, least: float = 0.25, k: float = 3.0, memory: int = 8) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and the histogram differences between neighbours."""
    n = len(frames)
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    histogram = np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16) / bins.shape[1]
    change = np.abs(np.diff(histogram, axis=0)).sum(1) / 2
    starts, since = [0], 0
    for i, c in enumerate(change):
        past = change[max(since, i - memory) : i]
        if c > least and (not len(past) or c > past.mean() + k * past.std()):
            starts.append(i + 1)
            since = i + 1
    return starts, change


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the AVI file of each whole text's UTF-8 bytes, with zeros up to a positive multiple of 64."""
    own = [c for c in df.columns if c != media]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text, 4 << 20):
                made = []
                for value in part.column(text).cast(pa.binary()).to_pylist():
                    data = value or b""
                    made.append(write_avi(data + b"\0" * (-len(data) % 64 or (64 if not data else 0))))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(made, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


FEATURES = "payload binary, frames int, width int, height int, rate double, shot_starts array<int>, changes array<double>"


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds `video`, read back from the stored file: payload, frame count and size, rate, shots and differences."""
    own = [c for c in df.columns if c != "video"]
    fields = T.StructType.fromDDL(FEATURES)
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField("video", fields)])

    def one(data):
        try:
            frames, rate, payload = decode_avi(data)
        except (ValueError, struct.error, TypeError, IndexError):
            return None
        starts, change = shots(frames)
        return {"payload": payload, "frames": len(frames), "width": frames.shape[2], "height": frames.shape[1], "rate": float(rate), "shot_starts": starts, "changes": change.tolist()}

    kind = pa.struct([("payload", pa.binary()), ("frames", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rate", pa.float64()), ("shot_starts", pa.list_(pa.int32())), ("changes", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = pa.array([one(x) for x in part.column(media).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays(part.columns + [made], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def clips(df: DataFrame) -> DataFrame:
    """A row per shot of a table with `video`: clip, first_frame, end_frame, start_s, end_s (seconds)."""
    v = F.col("video")
    ends = F.concat(F.slice(v["shot_starts"], 2, F.greatest(F.size(v["shot_starts"]) - 1, F.lit(0))), F.array(v["frames"]))
    rows = df.select("*", F.posexplode(F.arrays_zip(v["shot_starts"].alias("first_frame"), ends.alias("end_frame"))).alias("clip", "span"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != "video"], "clip", "span.first_frame", "span.end_frame", (F.col("span.first_frame") / v["rate"]).alias("start_s"), (F.col("span.end_frame") / v["rate"]).alias("end_s"))


def op5_media(spark, sf_dir: str) -> DataFrame:
    """Every whole text stored as an AVI file, read back, with digests and features of its shots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = features(store(docs))
    v = F.col("video")
    return made.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length(v["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(v["payload"], 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(video.payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.concat_ws("x", v["width"], v["height"], v["frames"]), F.array_join(v["shot_starts"].cast("array<string>"), ","), F.array_join(F.transform(v["changes"], lambda x: F.format_number(x, 4)), ",")).alias("feature"),
    )

