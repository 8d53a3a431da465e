"""Static range asymmetric numeral system over interleaved lanes, in numpy.

Symbol i of a block belongs to lane i mod LANES; all lanes step together, so
one numpy operation codes LANES symbols.  States are 64-bit and give up 32-bit
words.  A block is independent of all others; inside it, every ``every`` steps
a checkpoint keeps the place in the word stream and all lane states, so parts
of a block can be decoded in parallel or alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 1_024
SCALE_BITS = 18
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<IIII")


class Table:
    """Frequencies that sum to 2**SCALE_BITS, every counted symbol at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        used = np.flatnonzero(counts)
        total, room = int(counts.sum()), 1 << SCALE_BITS
        if len(used) > room:
            raise ValueError("too many symbols for the scale")
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            freq[used] = np.maximum(1, (counts[used].astype(np.float64) * room / total).astype(np.int64))
            rest = room - int(freq.sum())
            if rest >= 0:
                freq[used[np.argmax(counts[used])]] += rest
            for i in np.argsort(-freq, kind="stable") if rest < 0 else ():
                take = min(-rest, int(freq[i]) - 1)
                freq[i] -= take
                rest += take
                if rest == 0:
                    break
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(symbols: np.ndarray, table: Table, every: int = 256) -> bytes:
    """A block: header, checkpoints, words and a checksum of all that stands before it."""
    n = len(symbols)
    steps = -(-n // LANES)
    freq, start = table.freq[symbols], table.start[symbols]
    state = np.full(LANES, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written, shift, limit = 0, np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << limit)
        out = x[full].astype(np.uint32)
        if len(out):
            words.append(out)
            written += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        high = x // f
        state[: len(f)] = (high << shift) + (x - high * f) + c
        if step % every == 0:
            marks.append((written, state.copy()))
    payload = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    places = b"".join(struct.pack("<I", written - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
    body = _HEAD.pack(n, every, len(marks), written) + places + payload
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols [first, last) of a block, from the nearest checkpoint on."""
    body, check = block[:-4], struct.unpack("<I", block[-4:])[0]
    if zlib.crc32(body) != check:
        raise ValueError("a block's checksum does not match")
    n, every, marks, written = _HEAD.unpack_from(body)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    width = 4 + 8 * LANES
    words = np.frombuffer(body, dtype="<u4", count=written, offset=_HEAD.size + marks * width).astype(np.uint64)
    mark = first // LANES // every
    at = struct.unpack_from("<I", body, _HEAD.size + mark * width)[0]
    state = np.frombuffer(body, dtype="<u8", count=LANES, offset=_HEAD.size + mark * width + 4).astype(np.uint64)
    begin, end = mark * every, -(-last // LANES)
    out = np.empty((end - begin) * LANES, dtype=np.uint32)
    mask, shift, word = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for step in range(begin, end):
        width_now = min(LANES, n - step * LANES)
        x = state[:width_now]
        slot = x & mask
        symbol = table.symbol[slot]
        out[(step - begin) * LANES : (step - begin) * LANES + width_now] = symbol
        x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << word) | words[at : at + len(low)]
            at += len(low)
        state[:width_now] = x
    return out[first - begin * LANES : last - begin * LANES]
