"""Telephony audio columns: G.711 and IMA ADPCM bytes to PCM.

mu-law and A-law codes are expanded by tables of 256 entries. ADPCM blocks are
decoded side by side: numpy takes one nibble step for all blocks of a slice of
documents at once. PCM is resampled by linear interpolation and stored as WAV
in a table of its own, from which it is read back.
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

from .common import written
from .words import slices

RATE = 8000
#: Payload unit: also the size of an ADPCM block (4 bytes of state, then two samples a byte).
UNIT = 576
PAD = b"\xff"
#: Bytes of text or media handled at once.
SLICE = 1 << 20
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}

#: The index changes and step sizes of IMA ADPCM.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
IMA_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 132) << ((code & 0x70) >> 4)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, sign set for positive, exponent 0 linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (rows of bytes): one row of samples per block."""
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    row = 1
    for byte in body:
        for nibble in (byte & 15, byte >> 4):
            step = IMA_STEP[index]
            change = step >> 3
            change += np.where(nibble & 4, step, 0)
            change += np.where(nibble & 2, step >> 1, 0)
            change += np.where(nibble & 1, step >> 2, 0)
            value += np.where(nibble & 8, -change, change)
            np.clip(value, -32768, 32767, out=value)
            index += IMA_INDEX[nibble]
            np.clip(index, 0, 88, out=index)
            out[row] = value
            row += 1
    return out.T


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Linear interpolation at up / down times the rate; the last sample holds."""
    n = len(pcm) * up // down
    at = np.arange(n, dtype=np.int64) * down
    left, part = at // up, at % up
    wide = pcm.astype(np.int32)
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((wide[left] * (up - part) + wide[right] * part) // up).astype(np.int16)


def wav(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file around coded bytes."""
    bits = {"pcm": 16, "ima_adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "ima_adpcm": UNIT}.get(codec, 1)
    samples = {"pcm": len(data) // 2, "ima_adpcm": len(data) // UNIT * (2 * (UNIT - 4) + 1)}.get(codec, len(data))
    extra = struct.pack("<HH", 2, 2 * (UNIT - 4) + 1) if codec == "ima_adpcm" else struct.pack("<H", 0)
    speed = rate * align if codec != "ima_adpcm" else rate * UNIT // (2 * (UNIT - 4) + 1)
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, speed, align, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and coded bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    names = {v: k for k, v in FORMATS.items()}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = names[kind]
        elif name == b"data" and codec:
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + PAD * (max(1, -(-len(data) // unit)) * unit - len(data))


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media: a WAV file whose 8-bit codes are the text's bytes, padded to units.

    * null and empty texts store one unit of padding
    * a null id is carried through; repeated rows give equal files
    * an empty table gives an empty result; further columns of docs are ignored
    """
    if codec not in ("mulaw", "alaw", "ima_adpcm"):
        raise ValueError(f"no codec {codec!r}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                texts = batch.column("text").to_pylist()
                media = [wav(padded(t), codec) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _levels(pcm: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Root mean square, peak and sign changes of the parts of a signal."""
    wide = pcm.astype(np.int64)
    first, size = offsets[:-1], np.diff(offsets)
    power = np.sqrt(np.add.reduceat(wide * wide, first) // size).astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), first)
    sign = pcm < 0
    turns = np.zeros(len(pcm), np.int64)
    turns[1:] = sign[1:] != sign[:-1]
    turns[first] = 0
    return [power, peak, np.add.reduceat(turns, first)]


def expand(data: np.ndarray, codec: str) -> np.ndarray:
    """PCM of coded bytes; those of ADPCM are whole blocks."""
    if codec == "ima_adpcm":
        return decode_ima(data.reshape(-1, UNIT)).reshape(-1)
    return {"mulaw": MULAW, "alaw": ALAW}[codec][data]


def decode_audio(media: DataFrame, up: int = 2, down: int = 1) -> DataFrame:
    """Reads media files (doc_id, n_bytes, media) back and decodes them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, levels, pcm. pcm is the WAV file of the signal resampled by
    up / down. levels gives root mean square, peak and sign changes of the bytes
    read as mu-law, as A-law and as ADPCM blocks.

    * media is never null and holds at least one unit: store_audio() pads null and empty texts, and a very long one is decoded whole
    * a null id is carried through; repeated rows get equal results
    * an empty table gives an empty result; further columns of media are ignored
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "levels", "pcm"]
    kinds = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, levels string, pcm binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", SLICE):
                files = batch.column("media").to_pylist()
                codecs, _, payloads = zip(*map(read_wav, files))
                data = np.frombuffer(b"".join(payloads), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
                mu, al = _levels(MULAW[data], offsets), _levels(ALAW[data], offsets)
                ima = decode_ima(data.reshape(-1, UNIT))
                ad = _levels(ima.reshape(-1), offsets // UNIT * ima.shape[1])
                levels = [f"mulaw:{mu[0][i]},{mu[1][i]},{mu[2][i]};alaw:{al[0][i]},{al[1][i]},{al[2][i]};adpcm:{ad[0][i]},{ad[1][i]},{ad[2][i]}" for i in range(len(files))]
                pcm = [wav(resample(expand(data[a:b], c), up, down).astype("<i2").tobytes(), "pcm", RATE * up // down) for c, a, b in zip(codecs, offsets[:-1], offsets[1:])]
                columns = [
                    batch.column("doc_id"), batch.column("n_bytes"),
                    pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array(map(len, files), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files]),
                    pa.array(levels), pa.array(pcm, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return media.mapInArrow(read, kinds)


def store_pcm(media: DataFrame, up: int = 2, down: int = 1) -> DataFrame:
    """decode_audio() as a table in the shared folder: all its cases hold, and an empty table is written as such."""
    return written(decode_audio(media, up, down), "telephony-pcm", level=6, block=32 << 20)


def read_pcm(stored: DataFrame) -> DataFrame:
    """Reads stored PCM files back: the columns of decode_audio() with `feature` for levels and pcm.

    feature adds to the levels the rate, bytes, root mean square, peak, sign
    changes and crc32 of the stored samples.

    * stored comes from store_pcm(): pcm and levels are never null
    * a null id is carried through; repeated rows get equal results
    * an empty table gives an empty result; further columns of stored come along unless they clash with `feature`
    """
    names = [c for c in stored.columns if c not in ("levels", "pcm")] + ["feature"]
    kinds = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in names[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "pcm", 2 * SLICE):
                _, rates, samples = zip(*map(read_wav, batch.column("pcm").to_pylist()))
                offsets = np.concatenate([[0], np.cumsum([len(p) // 2 for p in samples])])
                power, peak, turns = _levels(np.frombuffer(b"".join(samples), "<i2"), offsets)
                feature = [f"{levels};pcm{rates[i]}:{len(samples[i])},{power[i]},{peak[i]},{turns[i]},{zlib.crc32(samples[i]):08x}" for i, levels in enumerate(batch.column("levels").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(feature)], names=names)

    return stored.mapInArrow(read, kinds + ", feature string")
