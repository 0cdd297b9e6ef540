"""Codec arithmetic as column expressions (code generation stays whole)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .params import CodecParams


def wrap16(x: Column) -> Column:
    """An int's value as a wrapped 16-bit sample (casting would raise under ANSI rules)."""
    return (((x + 32768).bitwiseAND(65535)) - 32768).cast("int")


def to_float(v: Column) -> Column:
    """Samples as [-1, 1) floats; a division by a power of two is exact."""
    return (v.cast("float") / F.lit(32768).cast("float")).cast("float")


def rice_index(d: Column) -> Column:
    return F.when(d < 0, -2 * d - 1).otherwise(2 * d).cast("int")


def rice_residual(i: Column) -> Column:
    return F.when(i % 2 == 1, -F.floor((i + 1) / 2)).otherwise(F.floor(i / 2)).cast("int")


def bit_length(m: Column) -> Column:
    """Bits of a non-negative number (0 for 0)."""
    return F.when(m == 0, 0).otherwise(F.length(F.bin(m.cast("long")))).cast("int")


def block_code(peak: Column, p: CodecParams = CodecParams()) -> Column:
    t = p.thresholds
    return F.when(peak <= t[0], f"RICE{p.orders[0]}").when(peak <= t[1], f"RICE{p.orders[1]}").when(peak <= t[2], f"RICE{p.orders[2]}").when(bit_length(peak) <= 14, "BFP").otherwise("LITERAL")


def code_bits(n: Column, peak: Column, sums: list[Column], p: CodecParams = CodecParams()) -> Column:
    """Bits of a block; ``sums`` holds the block's sums of the Rice index shifted by each order."""
    out = None
    for t, o, s in zip(p.thresholds, p.orders, sums):
        bits = 2 + s + (1 + o) * n
        out = F.when(peak <= t, bits) if out is None else out.when(peak <= t, bits)
    return out.when(bit_length(peak) <= 14, 6 + n * (bit_length(peak) + 1)).otherwise(6 + 16 * n).cast("long")


def rice_bits(index: Column, order: int) -> Column:
    """A Rice code as a bit string."""
    z = F.shiftright(index, order)
    tail = F.lpad(F.bin(index.cast("long").bitwiseAND((1 << order) - 1)), order, "0") if order else F.lit("")
    return F.concat(F.repeat(F.lit("0"), z), F.lit("1"), tail)


def packed_bits(v: Column, width: Column) -> Column:
    """A two's complement number of ``width`` bits as a bit string."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    return F.lpad(F.bin(v.cast("long").bitwiseAND(mask)), width, "0")


def byte_at(data: Column, i: Column) -> Column:
    """The i-th byte (from 1) of a binary column, as an unsigned int."""
    return F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int")


def unsigned(data: Column, start: int, size: int) -> Column:
    """A big-endian unsigned number of ``size`` bytes at ``start`` (from 0)."""
    return F.conv(F.hex(F.substring(data, start + 1, size)), 16, 10).cast("long")


def crc16(data: Column) -> Column:
    """CRC-16 of a short binary column (headers); payloads go through the kernel's version."""

    def bit(c: Column, _: Column) -> Column:
        up = F.shiftleft(c, 1)
        return F.when(c.bitwiseAND(0x8000) != 0, up.bitwiseXOR(F.lit(0x1021))).otherwise(up).bitwiseAND(0xFFFF)

    def byte(c: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(F.shiftleft(byte_at(data, i), 8)), bit)

    return F.when(F.length(data) == 0, F.lit(0xFFFF)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1))), F.lit(0xFFFF), byte))


def be_hex(n: Column, size: int) -> Column:
    """A non-negative number as ``size`` big-endian bytes in hex."""
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def frame_time_ns(sample_offset: Column, rate: Column) -> Column:
    """Nanoseconds from the recording's start, without overflow; null for a rate of 0."""
    ok = F.when(rate > 0, rate.cast("long"))
    whole = F.floor(sample_offset / ok)
    rest = sample_offset % ok
    return (whole * F.lit(1_000_000_000).cast("long") + F.floor(rest * F.lit(1_000_000_000).cast("long") / ok)).cast("long")
