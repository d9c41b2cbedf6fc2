"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

A media column holds whole WAV files. mu-law and A-law expand by 256-entry tables that are built from the codecs'
segment rule. ADPCM blocks start with their own state, so that numpy decodes one nibble of all blocks of a slice at
a time. PCM is resampled by linear interpolation in integers, the same on any machine.

kept() writes the media column, reads it back, writes the resampled PCM as a column beside the digests of what was read,
and deletes the media files as it goes, in up to GROUPS groups of files, so that both are never there as a whole.
described() computes the feature from the stored PCM.

Defined cases: a null payload counts as empty and is padded like any other; a null or broken WAV file has null
results; equal payloads give equal files and values; an empty table gives an empty table; other columns don't
matter. Memory is bounded by slices of SLICE_BYTES beside the largest single payload and its PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexforge.llm.common import delete_path, shared_dir, slices

RATE, TARGET_RATE, UNIT, BLOCK = 8000, 16000, 576, 288
SLICE_BYTES, GROUPS = 1 << 19, 8
#: How the columns are packed: PCM repeats what the media repeats, at greater distances.
PACKING = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.block.size": str(32 << 20)}
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    exponent, mantissa = code >> 4 & 7, code & 15
    size = ((mantissa << 3) + 132 << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 85
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """IMA's 89 step sizes, from 7 up by a tenth each, in the rounding of the published table."""
    # Fixed values of the IMA ADPCM format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int32)


MULAW, ALAW, STEPS = _mulaw(), _alaw(), _steps()
#: By the three low bits of a nibble: fixed values of the IMA ADPCM format.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) of uint8 to (blocks, samples) of int16: the loop runs over nibbles, each step over all blocks.

    A state index beyond the table counts as its end, as the payload may be any bytes.
    """
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(1, len(out)):
        byte = codes[(k - 1) >> 1]
        nibble = (byte >> 4) if k & 1 == 0 else byte & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[nibble], 0, 88)
        out[k] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    n = -(-len(pcm) * to // rate)
    if not len(pcm) or rate == to:
        return pcm
    x = pcm.astype(np.int32)
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[::2] = x
        out[1:-1:2] = x[:-1] + x[1:] >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(n, dtype=np.int64) * rate
    k, part = at // to, at % to
    return (x[k] + (x[np.minimum(k + 1, len(x) - 1)] - x[k]) * part // to).astype(np.int16)


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is the payload as it is."""
    tag, samples = TAGS[codec], len(payload)
    if codec == "adpcm":
        per = 1 + 2 * (BLOCK - 4)
        samples = len(payload) // BLOCK * per
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(data: bytes | None) -> tuple[str, int, bytes] | None:
    """(codec, rate, payload) of a WAV file in one of the three codecs, or None."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            fmt = struct.unpack_from("<HHI", data, at + 8)
        if name == b"data":
            codec = next((c for c, t in TAGS.items() if fmt and fmt[0] == t), None)
            return (codec, fmt[2], data[at + 8 : at + 8 + size]) if codec and at + 8 + size <= len(data) else None
        at += 8 + size + (size & 1)
    return None


def decode(files: list[bytes | None], to: int = TARGET_RATE) -> list[np.ndarray | None]:
    """The resampled PCM of each file; the ADPCM blocks of all files are decoded together."""
    parsed = [parse(f) for f in files]
    blocks = [np.frombuffer(p[2], np.uint8)[: len(p[2]) // BLOCK * BLOCK].reshape(-1, BLOCK) if p and p[0] == "adpcm" else None for p in parsed]
    some = [b for b in blocks if b is not None and len(b)]
    pcm, at, out = adpcm_blocks(np.concatenate(some)) if some else None, 0, []
    for p, b in zip(parsed, blocks, strict=True):
        if p is None:
            out.append(None)
        elif b is not None:
            out.append(resample(pcm[at : at + len(b)].reshape(-1) if len(b) else np.empty(0, np.int16), p[1], to))
            at += len(b)
        else:
            out.append(resample((MULAW if p[0] == "mulaw" else ALAW)[np.frombuffer(p[2], np.uint8)], p[1], to))
    return out


def feature(pcm: np.ndarray) -> str:
    """Samples, mean square, zero crossings, peak and mean step of PCM: integers, joined by colons."""
    if not len(pcm):
        return "0:0:0:0:0"
    x = pcm.astype(np.int32)
    wide = x.astype(np.int64)
    square = int(np.dot(wide, wide)) // len(x)
    sign = pcm < 0
    return f"{len(x)}:{square}:{int(np.count_nonzero(sign[1:] != sign[:-1]))}:{int(np.abs(x).max())}:{int(np.abs(np.diff(x)).sum(dtype=np.int64)) // len(x)}"


def padded(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT, b"\xff")


def codec_of(payload: bytes) -> str:
    """A codec by content, so that equal payloads are stored alike."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's padded UTF-8 as a WAV file."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for first, end in slices([len(t.as_py() or b"") for t in texts], SLICE_BYTES):
                raw = [t.as_py() or b"" for t in texts[first:end]]
                files = [wav(p, codec_of(p)) for p in map(padded, raw)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


def decoded(media: DataFrame, to: int = TARGET_RATE) -> DataFrame:
    """(key, n_bytes, payload and media digests, codec, pcm) of what a media column really holds; pcm is 16-bit little-endian at the target rate."""
    kind = media.schema["key"].dataType.simpleString()
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            for first, end in slices([len(x.as_buffer()) if x.is_valid else 0 for x in column], SLICE_BYTES):
                files, rows = [x.as_py() for x in column[first:end]], []
                for f, pcm in zip(files, decode(files, to), strict=True):
                    p = parse(f)
                    if p is None:
                        rows.append((None,) * 7)
                        continue
                    rows.append((len(p[2]), hashlib.sha256(p[2]).hexdigest(), zlib.crc32(p[2][-32:]), len(f), hashlib.sha256(f).hexdigest(), p[0], pcm.astype("<i2").tobytes()))
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], b.column(1)[first:end], *out], names)

    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm binary"
    return media.select("key", "n_bytes", "media").mapInArrow(run, schema)


def kept(media: DataFrame, to: int = TARGET_RATE) -> DataFrame:
    """decoded() as a stored table, of a media column that is written and read back first."""
    spark, here, there = media.sparkSession, shared_dir(media.sparkSession), shared_dir(media.sparkSession)
    media.write.options(**PACKING).parquet(here)
    files = sorted(spark.read.schema(media.schema).parquet(here).inputFiles())
    step = max(1, -(-len(files) // GROUPS), min(len(files), spark.sparkContext.defaultParallelism))
    for at in range(0, len(files), step):
        own = files[at : at + step]
        decoded(spark.read.schema(media.schema).parquet(*own), to).write.mode("append").options(**PACKING).parquet(there)
        for f in own:
            delete_path(spark, f)
    delete_path(spark, here)
    schema = decoded(media, to).schema
    return spark.read.schema(schema).parquet(there) if files else spark.createDataFrame([], schema)


def described(held: DataFrame) -> DataFrame:
    """The columns of kept() with pcm_bytes, pcm_sha256 and the feature of the stored PCM in its place."""
    names = [c for c in held.columns if c != "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for codec, x in zip(b.column(len(names) - 1), b.column(len(names)), strict=True):
                pcm = x.as_buffer() if x.is_valid else None
                rows.append((None,) * 3 if pcm is None else (len(pcm), hashlib.sha256(pcm).hexdigest(), f"{codec}:{feature(np.frombuffer(pcm, '<i2'))}"))
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*names, "pcm_bytes", "pcm_sha256", "feature"])

    schema = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in names)
    return held.select(*names, "pcm").mapInArrow(run, f"{schema}, pcm_bytes long, pcm_sha256 string, feature string")
