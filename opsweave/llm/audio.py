"""Telephony audio in columns: mu-law, A-law and ADPCM blocks to resampled PCM.

mu-law and A-law expand by tables of 256 samples. ADPCM blocks are decoded together: one numpy step for each sample
position, over all blocks of a batch. Media are WAVE files in binary columns. Nulls and files that aren't WAVE of one
of these formats decode to null.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, kept_id

#: Format tags of WAVE files (fixed values).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "ima"}
RATE, OUT_RATE, BLOCK = 8000, 16000, 64

#: IMA ADPCM step sizes and index changes (fixed values).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@functools.cache
def law_table(tag: int) -> np.ndarray:
    """The 256 samples of mu-law or A-law (ITU-T G.711)."""
    code = np.arange(256)
    if tag == MULAW:
        code = ~code & 0xFF
        size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
        return np.where(code & 128, -size, size).astype(np.int16)
    code = code ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part > 0, low + 256 << np.maximum(part - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM samples of ADPCM blocks (a row each: predictor, index, 0, then nibbles, low first), a row for each block."""
    n, size = blocks.shape
    out = np.empty((n, (size - 4) * 2 + 1), np.int16)
    value = blocks[:, :2].copy().view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range((size - 4) * 2):
        nibble = (blocks[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[nibble], 0, 88)
        out[:, k + 1] = value
    return out


def wave(tag: int, data: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAVE file."""
    bits, align = {PCM: (16, 2), IMA_ADPCM: (4, block)}.get(tag, (8, 1))
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == IMA_ADPCM else struct.pack("<H", 0)
    per_second = rate * align if tag != IMA_ADPCM else rate * block // ((block - 4) * 2 + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    odd = b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(format tag, sample rate, block size, data), or None."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            head = (tag, rate, align) if channels == 1 and tag in NAMES and (tag != IMA_ADPCM or align > 4) else None
        elif name == b"data" and head:
            return *head, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, between neighbours in straight lines, rounded half up; integers throughout."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    a = pcm[i].astype(np.int64)
    b = pcm[np.minimum(i + 1, len(pcm) - 1)]
    return ((a * (to - part) + b * part + to // 2) // to).astype(np.int16)


def decode_many(files: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, samples) of each file; ADPCM blocks of equal size from all files go through numpy together."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(files)
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        if (found := parse_wave(media)) is None:
            continue
        tag, rate, align, data = found
        raw = np.frombuffer(data, np.uint8)
        if tag == PCM:
            out[i] = rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif tag == IMA_ADPCM:
            waiting.setdefault(align, []).append((i, rate, raw[: len(raw) // align * align].reshape(-1, align)))
        else:
            out[i] = rate, law_table(tag)[raw]
    for group in waiting.values():
        pcm, at = decode_blocks(np.concatenate([blocks for *_, blocks in group])), 0
        for i, rate, blocks in group:
            out[i] = rate, pcm[at : at + len(blocks)].reshape(-1)
            at += len(blocks)
    return out


def store_pcm(media: DataFrame, column: str = "media", out: str = "pcm", rate: int = OUT_RATE) -> DataFrame:
    """media with a column of WAVE files in 16-bit PCM at one rate; null where column can't be decoded."""

    @F.pandas_udf("binary")
    def convert(files: pd.Series) -> pd.Series:
        values = files.tolist()
        done: list[bytes | None] = []
        for a, b in in_slices([len(x or b"") for x in values], 1 << 22):
            done += [None if x is None else wave(PCM, resample(x[1], x[0], rate).astype("<i2").tobytes(), rate) for x in decode_many(values[a:b])]
        return pd.Series(done, dtype=object)

    return media.withColumn(out, convert(F.col(column)))


def feature(tag: int, pcm: np.ndarray, resampled: bytes) -> str:
    """Codec, samples, peak, energy, sign changes of the samples, and CRC-32 of them resampled."""
    x = pcm.astype(np.int64)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{NAMES[tag]};{len(x)};{int(np.abs(x).max(initial=0))};{int((x * x).sum())};{changes};{zlib.crc32(resampled):08x}"


def payload(text: str | None, multiple: int = BLOCK) -> tuple[int, bytes]:
    """Bytes of a text (null: none) and these with zeros up to a positive multiple."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % multiple if raw else multiple)


def audio_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes, pcm_sha256.

    Each text's bytes are stored as the samples of a telephony file, in a codec that its CRC-32 chooses (mu-law,
    A-law, ADPCM: all store bytes as they are), read back from the file, decoded, and stored as PCM resampled to 16 kHz, as store_pcm() does.
    A row for each row of docs; null texts are empty, equal texts have equal values, an empty table gives no rows.
    """

    def run(batches):
        tags = (MULAW, ALAW, IMA_ADPCM)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].tolist()
            rows = []
            for a, b in in_slices([len(t or "") for t in texts], 1 << 21):
                raw = [payload(t) for t in texts[a:b]]
                files = [wave(tags[zlib.crc32(data) % 3], data) for _, data in raw]
                for (n, _), media, decoded in zip(raw, files, decode_many(files), strict=True):
                    tag, _, _, back = parse_wave(media)
                    rate, pcm = decoded
                    resampled = resample(pcm, rate, OUT_RATE).astype("<i2").tobytes()
                    stored = wave(PCM, resampled, OUT_RATE)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tag, pcm, resampled), len(stored), hashlib.sha256(stored).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"])
            out.insert(0, "doc_id", ids.reset_index(drop=True))
            yield out

    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept_id(source.mapInPandas(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"))
