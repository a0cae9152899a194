"""Audio header facts from binary files: RIFF by its chunk list, MPEG audio by frame headers found with NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "path string, codec string, sample_rate int, channels int, bitrate_kbps int, duration_seconds double"

# Fixed values of MPEG layer III headers, by bit-rate index, and by version and rate index.
MPEG1_KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_KBPS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes of side information behind a frame header, by (MPEG 1, mono); a VBR tag stands right behind them.
SIDE_BYTES = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
EMPTY = ("", None, None, None, None)


def _number(data: bytes, at: int, size: int, order: str = "little") -> int:
    return int.from_bytes(data[at : at + size], order)


def riff_chunks(data: bytes) -> dict[bytes, tuple[int, int]]:
    """The first chunk of each name: where its body starts, and its stated size. Bodies begin at even offsets."""
    found: dict[bytes, tuple[int, int]] = {}
    head = 12
    while head <= len(data) - 8:
        size = _number(data, head + 4, 4)
        found.setdefault(data[head : head + 4], (head + 8, size))
        head += 8 + size + (size & 1)
    return found


def riff_facts(data: bytes) -> tuple:
    chunks = riff_chunks(data)
    form, _ = chunks.get(b"fmt ", (len(data), 0))
    if form + 16 > len(data):
        return ("wav", None, None, None, None)
    channels, rate, depth = _number(data, form + 2, 2), _number(data, form + 4, 4), _number(data, form + 14, 2)
    per_second = rate * channels * depth
    if b"data" not in chunks or not per_second:
        return ("wav", rate, channels, None, None)
    body, size = chunks[b"data"]
    frame = channels * depth // 8
    seconds = min(size, len(data) - body) / (frame * rate) if frame else None
    return ("wav", rate, channels, per_second // 1000, seconds)


class FrameHeaders:
    """All places of a stream that could be a layer III frame header, with what the header says there."""

    def __init__(self, data: bytes, start: int) -> None:
        b = np.frombuffer(data, np.uint8)[start:]
        at = np.flatnonzero((b[:-3] == 0xFF) & (b[1:-2] & 0xE0 == 0xE0)) if len(b) > 3 else np.zeros(0, np.int64)
        second, third = b[at + 1], b[at + 2]
        self.version, layer = second >> 3 & 3, second >> 1 & 3
        rate_index, kbps_index = third >> 2 & 3, third >> 4
        fits = (self.version != 1) & (layer == 1) & (rate_index < 3) & (kbps_index > 0) & (kbps_index < 15)
        at, rate_index, kbps_index, pad = at[fits], rate_index[fits], kbps_index[fits], third[fits] >> 1 & 1
        self.version = self.version[fits]
        first = self.version == 3
        rates = np.array([MPEG_RATES[0], (1, 1, 1), MPEG_RATES[2], MPEG_RATES[3]])
        self.rate = rates[self.version, rate_index]
        self.kbps = np.where(first, np.array(MPEG1_KBPS)[kbps_index], np.array(MPEG2_KBPS)[kbps_index])
        self.samples = np.where(first, 1152, 576)
        self.mono = b[at + 3] >> 6 == 3
        self.at, self.next = at + start, at + start + self.samples // 8 * self.kbps * 1000 // self.rate + pad

    def first(self) -> int | None:
        """The first header whose frame ends at another header or at the stream's end; failing that, the first of all."""
        if not len(self.at):
            return None
        followed = np.flatnonzero(np.isin(self.next, self.at))
        return int(followed[0]) if len(followed) else 0


def mpeg_facts(data: bytes) -> tuple:
    start = 0
    if data.startswith(b"ID3") and len(data) >= 10:
        start = 10 + sum((x & 0x7F) << 7 * (3 - k) for k, x in enumerate(data[6:10]))
    heads = FrameHeaders(data, start)
    k = heads.first()
    if k is None:
        return EMPTY
    at, rate, kbps, mono = int(heads.at[k]), int(heads.rate[k]), int(heads.kbps[k]), bool(heads.mono[k])
    tag = at + 4 + SIDE_BYTES[bool(heads.version[k] == 3), mono]
    seconds = (len(data) - at) / (kbps * 125)
    if data[tag : tag + 4] in (b"Xing", b"Info") and data[tag + 7 : tag + 8] and data[tag + 7] & 1:
        frames = _number(data, tag + 8, 4, "big")
        if frames:
            seconds = frames * int(heads.samples[k]) / rate
    return ("mp3", rate, 1 if mono else 2, kbps, seconds)


def header_facts(data: bytes) -> tuple:
    """(codec, rate, channels, kbps, seconds) of whole content; unknown content has an empty codec."""
    return riff_facts(data) if data[:4] == b"RIFF" and data[8:12] == b"WAVE" else mpeg_facts(data)


def probe(files: DataFrame) -> DataFrame:
    """Facts per file for rows with path and content; content that is null is unknown."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = [f.split()[0] for f in FACTS.split(", ")]

    def work(batches):
        for b in batches:
            rows = [header_facts(c.as_buffer().to_pybytes()) if c.is_valid else EMPTY for c in b.column(1)]
            columns = [pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    return files.select("path", "content").mapInArrow(work, FACTS)
