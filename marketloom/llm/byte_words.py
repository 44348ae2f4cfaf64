"""Words of whole texts found in their UTF-8 bytes, for operators that count words in Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Bytes with A-Z in lower case; all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a word: those of ``ranges`` and all of characters beyond ASCII."""
    held = np.zeros(256, bool)
    held[128:] = True
    for first, last in ranges:
        held[first : last + 1] = True
    return held


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text array without nulls, and where each text begins and the last ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, (ends - ends[0]).astype(np.int64)


def word_bounds(data: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of its text; a word never crosses two texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = held[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    firsts = offsets[:-1]
    new[firsts] |= inside[firsts]
    starts = np.flatnonzero(new)
    stops = np.zeros(len(data) + 1, bool)  # a word ends at the first byte outside, or where the next begins
    stops[1:] = inside[:-1] & (~inside[1:] | new[1:])
    stops = np.flatnonzero(stops)
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> 1), out >> 1).astype(np.uint32)
    return out


CRC_TABLE = _crc_table()
#: Words with more bytes go through zlib one by one.
SHORT = 64


def crc_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of every slice of ``data``, or of what ``before`` is the CRC-32 of with the slice behind it."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    size = stops - starts
    long = np.flatnonzero(size > SHORT)
    state = ~crc
    short = np.flatnonzero((size > 0) & (size <= SHORT))
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = starts[short], size[short]
    own = state[short]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # the first n have more than k bytes
        own[:n] = CRC_TABLE[(own[:n] ^ data[at[:n] + k]) & 255] ^ (own[:n] >> 8)
    state[short] = own
    out = ~state
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : stops[i]].tobytes(), int(crc[i]))
    return out
