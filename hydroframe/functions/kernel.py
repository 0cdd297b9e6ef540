"""Bit-level frame encoding and decoding in numpy.

A frame is encoded as one list of (value, width) fields that is turned into bits at once.  Decoding
walks the bit string block by block; stop bits are looked up in a table of the next 1, and samples
are integrated for the whole frame at the end.
"""

from __future__ import annotations

import binascii

import numpy as np

from .params import MAX_RICE_INDEX, MIN_BFP_WIDTH, CodecParams, FormatError, check_channels


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """CRC-16, polynomial 0x1021, most significant bit first, no final exclusive or."""
    return binascii.crc_hqx(data, start)


def zigzag(d: np.ndarray) -> np.ndarray:
    return np.where(d < 0, -2 * d - 1, 2 * d)


def unzigzag(i: np.ndarray) -> np.ndarray:
    return np.where(i & 1, -((i + 1) >> 1), i >> 1)


def bit_length(m: np.ndarray) -> np.ndarray:
    return np.frexp(m.astype(np.float64))[1]


def pack_fields(value: np.ndarray, width: np.ndarray, align: int = 1) -> bytes:
    """Fields, most significant bit first, padded with zeros to a multiple of ``align`` bytes."""
    total = int(width.sum())
    field = np.repeat(np.arange(len(width)), width)
    shift = np.repeat(np.cumsum(width), width) - 1 - np.arange(total)
    raw = np.packbits(((value[field] >> shift) & 1).astype(np.uint8)).tobytes()
    return raw + bytes(-len(raw) % align)


def encode_frame(pcm: np.ndarray, params: CodecParams = CodecParams()) -> bytes:
    """``pcm``: int16 samples, one row for each time, one column for each channel."""
    n, channels = pcm.shape
    check_channels(channels)
    if not 1 <= n <= params.samples_per_frame:
        raise ValueError("a frame holds 1 to samples_per_frame samples")
    x = pcm.astype(np.int64)
    values, widths, keys = [x[0] & 0xFFFF], [np.full(channels, 16)], [np.arange(channels) - channels]
    if n > 1:
        d = np.diff(x, axis=0)
        block = np.arange(n - 1) // params.block_len
        first = np.arange(0, n - 1, params.block_len)
        for c in range(channels):
            peak = np.maximum.reduceat(np.abs(d[:, c]), first)
            kind = np.searchsorted(np.array(params.thresholds), peak)  # 0..2 Rice, 3 packed
            b = np.minimum(bit_length(peak), 15)
            values.append(np.where(kind < 3, kind + 1, b))
            widths.append(np.where(kind < 3, 2, 6))
            keys.append((np.arange(len(first)) * channels + c) * (params.block_len + 1))
            k, bb = kind[block], b[block]
            order = np.array([*params.orders, 0])[k]
            index = zigzag(d[:, c])
            rice_value, rice_width = (1 << order) | (index & ((1 << order) - 1)), (index >> order) + 1 + order
            packed_value = np.where(bb >= 15, x[1:, c] & 0xFFFF, d[:, c] & ((1 << (bb + 1)) - 1))
            values.append(np.where(k < 3, rice_value, packed_value))
            widths.append(np.where(k < 3, rice_width, np.where(bb >= 15, 16, bb + 1)))
            keys.append((block * channels + c) * (params.block_len + 1) + 1 + np.arange(n - 1) % params.block_len)
    order = np.argsort(np.concatenate(keys), kind="stable")
    return pack_fields(np.concatenate(values)[order], np.concatenate(widths)[order], align=2)


def max_payload_bytes(frames: int, channels: int, params: CodecParams = CodecParams()) -> int:
    """An upper bound of a frame's payload: every block stored as literals."""
    blocks = -(-max(frames - 1, 0) // params.block_len)
    return 2 * -(-(16 * channels + channels * (6 * blocks + 16 * max(frames - 1, 0))) // 16)


def swap_pairs(data: bytes) -> bytes:
    """The bytes of each 16-bit pair exchanged; an odd last byte stays."""
    raw = np.frombuffer(data, dtype=np.uint8)
    even = len(raw) & ~1
    return raw[:even].reshape(-1, 2)[:, ::-1].tobytes() + raw[even:].tobytes()


class BitReader:
    """Most significant bit first."""

    def __init__(self, data: bytes, swap: bool = False):
        self.bits = np.unpackbits(np.frombuffer(swap_pairs(data) if swap else data, dtype=np.uint8))
        ones = np.flatnonzero(self.bits)
        nxt = np.full(len(self.bits) + 1, -1, dtype=np.int64)
        if len(ones):
            at = np.searchsorted(ones, np.arange(len(self.bits)))
            found = at < len(ones)
            nxt[:-1][found] = ones[at[found]]
        self.next_one, self.pos = nxt.tolist(), 0

    @property
    def remaining(self) -> int:
        return len(self.bits) - self.pos

    def read(self, width: int) -> int:
        if width > self.remaining:
            raise FormatError("the bit stream ends too early")
        out = int("".join(map(str, self.bits[self.pos : self.pos + width].tolist())), 2) if width else 0
        self.pos += width
        return out

    def zeros(self) -> int:
        """Zeros up to the next 1, which is left to be read."""
        stop = self.next_one[self.pos]
        if stop < 0:
            raise FormatError("no stop bit before the end")
        n, self.pos = stop - self.pos, stop
        return n

    def rice(self, n: int, order: int) -> np.ndarray:
        """n residuals of Rice codes."""
        nxt, pos, end = self.next_one, self.pos, len(self.bits)
        stops = []
        for _ in range(n):
            if pos >= end or (stop := nxt[pos]) < 0:
                raise FormatError("the bit stream ends too early")
            stops.append(stop)
            pos = stop + 1 + order
        if pos > end:
            raise FormatError("the bit stream ends too early")
        at = np.array(stops)
        index = (at - np.concatenate([[self.pos], at[:-1] + 1 + order])) << order
        for k in range(order):
            index |= self.bits[at + 1 + k].astype(np.int64) << (order - 1 - k)
        if n and index.max() > MAX_RICE_INDEX:
            raise FormatError("a Rice index is out of range")
        self.pos = pos
        return unzigzag(index)

    def packed(self, n: int, width: int) -> np.ndarray:
        """n two's complement numbers of ``width`` bits."""
        if n * width > self.remaining:
            raise FormatError("the bit stream ends too early")
        m = self.bits[self.pos : self.pos + n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1))
        self.pos += n * width
        return np.where(m >= 1 << (width - 1), m - (1 << width), m)


def decode_frame(payload: bytes, n: int, channels: int, block_len: int = 20, orders=(0, 1, 3), swap: bool = False) -> np.ndarray:
    """int16 samples of n x channels."""
    check_channels(channels)
    if n < 1:
        return np.zeros((0, channels), np.int16)
    r = BitReader(payload, swap)
    step = np.zeros((n, channels), dtype=np.int64)
    literal = np.zeros((n, channels), dtype=bool)
    step[0], literal[0] = r.packed(channels, 16), True
    at = 1
    while at < n:
        size = None
        for c in range(channels):
            count = min(block_len, n - at)
            code = r.read(2)
            wide = r.read(4) if code == 0 else 0
            if code == 0 and wide == 0:
                count = r.read(6) + 1
                code = r.read(2)
                wide = r.read(4) if code == 0 else 0
                if count > n - at:
                    raise FormatError("a short block is longer than its frame")
            if size is not None and count != size:
                raise FormatError("channels have blocks of different length")
            size = count
            if code:
                step[at : at + count, c] = r.rice(count, orders[code - 1])
            else:
                if wide + 1 < MIN_BFP_WIDTH:
                    raise FormatError("a block's sample width is out of range")
                step[at : at + count, c] = r.packed(count, wide + 1)
                literal[at : at + count, c] = wide == 15
        at += size
    base = np.maximum.accumulate(np.where(literal, np.arange(n)[:, None], 0), axis=0)
    run = np.cumsum(np.where(literal, 0, step), axis=0)
    out = np.take_along_axis(step, base, axis=0) + run - np.take_along_axis(run, base, axis=0)
    return ((out + 32768) & 65535).astype(np.int64).__sub__(32768).astype(np.int16)
