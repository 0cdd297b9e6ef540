"""Coding parameters and errors."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the format.
ARCHIVE_MAGIC = b"X3ARCHIV"
FRAME_KEY = 0x7833
FRAME_HEADER = 20
SYNC = b"\x52\xa9"
SYNC_SEARCH = 65536
RECORD_HEADER = 20
DEFAULT_RATE, DEFAULT_BITS, DEFAULT_CHANNELS = 576000, 16, 1
MAX_CHANNELS, MAX_RICE_INDEX, MIN_BFP_WIDTH = 8, 512, 6


class FormatError(OSError):
    """The bytes are no valid archive, recorder file, WAV file or coded frame."""


@dataclass(frozen=True)
class CodecParams:
    """Block length, blocks in a frame, Rice orders and their thresholds."""

    block_len: int = 20
    blocks_per_frame: int = 500
    orders: tuple[int, int, int] = (0, 1, 3)
    thresholds: tuple[int, int, int] = (3, 8, 20)

    def __post_init__(self):
        if not 1 <= self.block_len <= 64:
            raise ValueError("block_len must be 1 to 64")
        if self.blocks_per_frame < 1 or self.samples_per_frame > 65535:
            raise ValueError("a frame must hold 1 to 65535 samples a channel")
        if len(self.orders) != 3 or len(self.thresholds) != 3:
            raise ValueError("three Rice orders and three thresholds are needed")
        if any(o < 0 or o > 15 for o in self.orders) or list(self.thresholds) != sorted(set(self.thresholds)) or self.thresholds[0] < 0:
            raise ValueError("orders must be 0 to 15 and thresholds must grow")
        # Residuals above the last threshold are packed in blocks of at least MIN_BFP_WIDTH bits.
        if (self.thresholds[2] + 1).bit_length() + 1 < MIN_BFP_WIDTH:
            raise ValueError("the last threshold must be 15 or more, or narrow blocks could not be read back")
        for t, o in zip(self.thresholds, self.orders):
            if 2 * t > MAX_RICE_INDEX or (2 * t >> o) + 1 + o > 32:
                raise ValueError("a Rice code would be longer than can be read back")

    @property
    def samples_per_frame(self) -> int:
        return self.block_len * self.blocks_per_frame


def check_channels(channels: int) -> None:
    if not 1 <= channels <= MAX_CHANNELS:
        raise ValueError(f"channels must be 1 to {MAX_CHANNELS}")
