"""Telephony audio in binary columns: mu-law, A-law and ADPCM to PCM.

Companded samples are expanded by tables of 256 entries. ADPCM blocks (a predictor and a step index, then two 4-bit codes a byte)
depend on their own header alone, so numpy decodes all blocks of a batch side by side, one code of each at a time. ``store``
wraps samples as a WAVE file, ``load`` reads it back, ``resample`` changes the rate by linear interpolation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import pieces

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
#: Bytes of an ADPCM block, and the unit to which payloads are filled up.
BLOCK = 576


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132) << ((code >> 4) & 7)
    return np.where(code & 128, 132 - size, size - 132).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    part, size = (code >> 4) & 7, ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(part > 0, (size + 256) << np.maximum(part.astype(np.int32) - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The 89 step sizes: each a tenth more than the last, cut to whole numbers by the rule of the format's table."""
    # Fixed values of the format.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


MULAW_TABLE, ALAW_TABLE, STEPS = _mulaw(), _alaw(), _steps()
#: For each (step index, code): the change of the predictor, and the next index.
_CODE = np.arange(16)
_CHANGE = (STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_CODE & 1) + (STEPS[:, None] >> 1) * (_CODE >> 1 & 1) + STEPS[:, None] * (_CODE >> 2 & 1)
CHANGE = np.where(_CODE & 8, -_CHANGE, _CHANGE).astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2), 0, 88).astype(np.int32).ravel() * 16


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks, samples) of mono blocks (blocks, bytes): the first sample is the header's. Step indexes over 88 count as 88."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    row = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * codes.shape[0], blocks.shape[0]), dtype=np.int16)
    out[0] = head
    for i, both in enumerate(codes):
        for k, code in ((1, both & 15), (2, both >> 4)):
            at = row + code
            head = np.clip(head + CHANGE[at], -32768, 32767)
            row = NEXT[at]
            out[2 * i + k] = head
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, from one rate to the other."""
    n = len(pcm) * to // rate
    if not n:
        return np.zeros(0, np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to).astype(np.int16)


def store(samples: bytes, kind: int = MULAW, rate: int = 8000) -> bytes:
    """A mono WAVE file of these bytes."""
    bits = {PCM: 16, ADPCM: 4}.get(kind, 8)
    align = {PCM: 2, ADPCM: BLOCK}.get(kind, 1)
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    second = rate * 2 if kind == PCM else rate * BLOCK // (2 * (BLOCK - 4) + 1) if kind == ADPCM else rate
    head = struct.pack("<HHIIHH", kind, 1, rate, second, align, bits) + extra
    count = {PCM: len(samples) // 2, ADPCM: len(samples) // BLOCK * (2 * (BLOCK - 4) + 1)}.get(kind, len(samples))
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(media: bytes) -> tuple[int, int, bytes]:
    """(kind, rate, sample bytes) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate, data = 12, 0, 0, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if data is None or not rate:
        raise ValueError("no samples")
    return kind, rate, data


def to_pcm(media: bytes, rate: int = 16000) -> np.ndarray:
    """PCM of a stored file of any of the four kinds, at this rate."""
    kind, own, data = load(media)
    codes = np.frombuffer(data, np.uint8)
    if kind == ADPCM:
        pcm = decode_adpcm(codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    else:
        pcm = np.frombuffer(data, "<i2") if kind == PCM else {MULAW: MULAW_TABLE, ALAW: ALAW_TABLE}[kind][codes]
    return resample(pcm, own, rate)


def pcm_column(media: DataFrame, id_col: str, media_col: str, rate: int = 16000) -> DataFrame:
    """Decode a column of stored files to one of PCM WAVE files at this rate: (id, media). A null file stays null.

    Repeated rows are rows of their own; an empty table gives an empty result; other columns are not read. A file that is no WAVE
    file fails the task, with its reason.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = media.select(F.col(id_col), F.col(media_col).alias("_media"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for ids, files in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([None if f is None else store(to_pcm(f, rate).astype("<i2").tobytes(), PCM, rate) for f in files], pa.binary())], [id_col, "media"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, media binary")


def payload(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 length, the bytes filled up with 255 to a positive multiple of BLOCK)."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's payload as mu-law samples, read it back and describe it: one row a row.

    The feature has, of the samples read back, the mean square and the sign changes of the mu-law reading, the peak of the A-law
    reading, the sum of magnitudes of the ADPCM reading, and the CRC-32 of the mu-law reading resampled from 8 to 16 kHz. All are
    whole numbers that depend on the text alone. Null and empty texts are one block of 255. Repeated rows are rows of their own; an
    empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for ids, texts in pieces(batches):
            out, datas = [], []
            for text in texts:
                n, data = payload(text)
                media = store(data)
                _, rate, back = load(media)
                pcm = MULAW_TABLE[np.frombuffer(back, np.uint8)].astype(np.int64)
                wide = resample(pcm.astype(np.int16), rate, 2 * rate)
                alaw = int(np.abs(ALAW_TABLE[np.frombuffer(back, np.uint8)].astype(np.int32)).max())
                out.append([n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"ms={int((pcm * pcm).sum()) // len(pcm)};zc={int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())};peak={alaw};", zlib.crc32(wide.astype("<i2").tobytes())])
                datas.append(back)
            blocks = np.frombuffer(b"".join(datas), np.uint8).reshape(-1, BLOCK)
            loud = np.concatenate([np.abs(decode_adpcm(blocks[i : i + 8192]).astype(np.int32)).sum(1, dtype=np.int64) for i in range(0, len(blocks), 8192)])
            starts = np.cumsum([0, *(len(d) // BLOCK for d in datas)])[:-1]
            for row, total in zip(out, np.add.reduceat(loud, starts), strict=True):
                row[6] += f"adpcm={int(total)};crc16k={row.pop()}"
            arrays = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *arrays], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
