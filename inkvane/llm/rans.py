"""Interleaved range asymmetric numeral system coding with static tables.

A block is coded on its own by LANES states that advance together (numpy does
one step of all lanes at once). Its header holds the decoder's states; further
checkpoints inside it hold the states and the place in the word stream every
CHECKPOINT steps, so that a reader may start at any of them. Every span between
checkpoints has a CRC-32 of its own over its words and states, and the header
one over itself, so a reader checks what it reads and no more. The header names
the frequency table by its checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 2048
CHECKPOINT = 64
LOW = np.uint64(1 << 31)
MAGIC = b"RANS"
VERSION = 2
HEAD = struct.Struct("<4sHHIQQI")  # magic, version, lanes, checksum of the table, symbols, words, checkpoints
MARK = struct.Struct("<QQI")  # of a checkpoint: step, place among the words, checksum of its states and of the words up to the next one


class Frequencies:
    """Counts scaled to a power of two; every symbol that occurs keeps a place."""

    def __init__(self, counts: np.ndarray):
        self.checksum = zlib.crc32(np.asarray(counts, "<i8").tobytes())
        counts = np.asarray(counts, np.float64)
        total, size = counts.sum(), 1 << SCALE_BITS
        if np.count_nonzero(counts) > size:
            raise ValueError("more symbols than places")
        f = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / max(total, 1)))), 0).astype(np.int64)
        while total and (extra := f.sum() - size):  # what rounding left over, taken from or given to the largest
            big = np.argsort(-f, kind="stable")
            if extra < 0:
                f[big[0]] -= extra
            else:
                for k in big:
                    take = min(extra, max(0, f[k] - 1), max(1, f[k] // 2))
                    f[k] -= take
                    extra -= take
                    if not extra:
                        break
        self.freq = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)


def encode_block(symbols: np.ndarray, table: Frequencies) -> bytes:
    n = len(symbols)
    steps = -(-n // LANES)
    padded = np.concatenate([symbols, np.full(steps * LANES - n, symbols[0] if n else 0, symbols.dtype)]).reshape(steps, LANES)
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    emitted = 0
    bits, low32 = np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        s = padded[t]
        f, c = table.freq[s], table.start[s]
        full = (x >> np.uint64(63 - SCALE_BITS)) >= f
        if full.any():
            out = (x[full] & low32).astype("<u4")
            words.append(out)
            emitted += len(out)
            x[full] >>= np.uint64(32)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if t % CHECKPOINT == 0:
            marks.append((t, emitted, x.astype("<u8").tobytes()))
    payload = b"".join(w.tobytes() for w in reversed(words))
    marks.reverse()
    places = [emitted - e for _, e, _ in marks] + [emitted]
    spans = [MARK.pack(t, at, zlib.crc32(payload[4 * at : 4 * end], zlib.crc32(states))) + states for (t, _, states), at, end in zip(marks, places[:-1], places[1:], strict=True)]
    head = HEAD.pack(MAGIC, VERSION, LANES, table.checksum, n, emitted, len(marks)) + b"".join(x[: MARK.size] for x in spans)
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(x[MARK.size :] for x in spans) + payload


def decode_block(data: bytes, table: Frequencies, from_checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """Symbols from a checkpoint on (0: the whole block), through so many checkpoints' spans."""
    magic, version, lanes, checksum, n, count, marks = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    head = HEAD.size + marks * MARK.size
    if zlib.crc32(data[:head]) != struct.unpack_from("<I", data, head)[0]:
        raise ValueError("checksum mismatch: the block's head is damaged")
    if checksum != table.checksum:
        raise ValueError("the block was coded with another frequency table")
    if not n:
        return np.empty(0, np.uint32)
    size, states_at = 8 * lanes, head + 4
    payload = states_at + marks * size
    spans = [MARK.unpack_from(data, HEAD.size + k * MARK.size) for k in range(marks)] + [(None, count, None)]
    until = marks if checkpoints is None else min(marks, from_checkpoint + checkpoints)
    for k in range(from_checkpoint, until):
        words = data[payload + 4 * spans[k][1] : payload + 4 * spans[k + 1][1]]
        if zlib.crc32(words, zlib.crc32(data[states_at + k * size : states_at + (k + 1) * size])) != spans[k][2]:
            raise ValueError("checksum mismatch: the block is damaged")
    words = np.frombuffer(data, "<u4", count, payload)
    first, place, _ = spans[from_checkpoint]
    x = np.frombuffer(data, "<u8", lanes, states_at + from_checkpoint * size).astype(np.uint64)
    steps = -(-n // lanes)
    last = steps if checkpoints is None else min(steps, first + checkpoints * CHECKPOINT)
    out = np.empty((last - first, lanes), np.uint32)
    mask, bits, w32 = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(last - first):
        slot = x & mask
        s = out[t] = table.symbol[slot]
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << w32) | words[place : place + k].astype(np.uint64)
            place += k
    return out.reshape(-1)[: max(0, min(n, last * lanes) - first * lanes)]
