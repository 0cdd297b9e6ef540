"""Kernels: known answers, round trips, faults."""

import numpy as np
import pytest

from hydroframe.functions import kernel
from hydroframe.functions.params import CodecParams, FormatError
from hydroframe.sources import formats

#: A published coded block and its checks.
RICE1_PAYLOAD = bytes.fromhex(
    "f276b18214d0040458183020698604fcc2f8aa7fa10afaadbc9d8d13c966ea05a36394c9f4884eb306c9db8f7080b38b6b14885f6c2faa5aaef42946d912434b4fd6eb24a848c63d1ab87172b568b45ba17cb2485f67d91b6500"
)


def signals():
    k = np.arange(64)
    yield "quiet", 100 + np.cumsum((k % 5) - 2)[:, None]
    yield "sine", (np.sin(np.arange(4000) * 0.01) * 12000)[:, None]
    yield "jumps", (np.sin(np.arange(100) * 0.2) * 8000)[:, None]
    yield "stereo", np.stack([3 * np.arange(40), -2 * np.arange(40)], axis=1)
    yield "zigzag", np.cumsum(np.where(np.arange(40) % 2, -90, 100))[:, None]
    yield "noise", np.random.default_rng(1).integers(-32768, 32768, (999, 2))
    yield "one", np.array([[-5]])
    yield "extremes", np.tile([32767, -32768], 50)[:, None]


@pytest.mark.parametrize("name,x", list(signals()))
@pytest.mark.parametrize("block", [16, 20, 1, 64])
def test_round_trip(name, x, block):
    x = x.astype(np.int64).astype(np.int16)
    p = CodecParams(block_len=block)
    raw = kernel.encode_frame(x[: p.samples_per_frame], p)
    n = min(len(x), p.samples_per_frame)
    assert len(raw) % 2 == 0 and len(raw) <= kernel.max_payload_bytes(n, x.shape[1], p)
    assert np.array_equal(kernel.decode_frame(raw, n, x.shape[1], block), x[:n])
    assert np.array_equal(kernel.decode_frame(kernel.swap_pairs(raw), n, x.shape[1], block, swap=True), x[:n])


def test_known_vectors():
    got = kernel.decode_frame(RICE1_PAYLOAD, 20, 1, 20).ravel()
    assert got[:4].tolist() == [-3466, -3467, -3471, -3466] and got[-1] == -3462
    assert kernel.crc16(bytes.fromhex("78330101271019d0") + bytes(8)) == 0xADDB
    assert kernel.crc16(b"234", kernel.crc16(b"1")) == kernel.crc16(b"1234") and kernel.crc16(b"") == 0xFFFF
    assert kernel.pack_fields(np.array([0, 3]), np.array([9, 2])).hex() == "0060"
    assert kernel.pack_fields(np.array([0x1FF, 3]), np.array([9, 2])).hex() == "ffe0"
    assert kernel.pack_fields(np.array([0, 0x1FF]), np.array([13, 9])).hex() == "0007fc"
    assert kernel.zigzag(np.array([0, -1, 1, -2, 2])).tolist() == [0, 1, 2, 3, 4]
    assert kernel.unzigzag(np.arange(5)).tolist() == [0, -1, 1, -2, 2]


def test_bit_reader():
    r = kernel.BitReader(bytes.fromhex("000ff000"))
    assert (r.zeros(), r.zeros(), r.read(7), r.read(1)) == (12, 0, 0x7F, 1)
    with pytest.raises(FormatError):
        r.zeros()
    r = kernel.BitReader(bytes.fromhex("0123456789"))
    assert (r.read(20), r.read(4), r.read(16)) == (0x01234, 5, 0x6789)
    with pytest.raises(FormatError):
        r.read(1)
    assert kernel.BitReader(bytes.fromhex("f0ff"), swap=True).read(16) == 0xFFF0
    assert kernel.BitReader(b"\0\0\0\0\0\0\0\x01").zeros() == 63  # runs over many words count right


def test_short_blocks():
    # A seed, a short block of 3 residuals (Rice order 0), then the rest of the block length.
    fields = [(7, 16), (0, 2), (0, 4), (2, 6), (1, 2), (1, 1), (1, 2), (1, 3), (1, 2), (1, 1), (1, 1)]
    raw = kernel.pack_fields(np.array([v for v, _ in fields]), np.array([w for _, w in fields]), 2)
    assert kernel.decode_frame(raw, 6, 1, 20).ravel().tolist() == [7, 7, 6, 7, 7, 7]
    with pytest.raises(FormatError):
        kernel.decode_frame(raw, 3, 1, 20)  # longer than its frame


def test_faults():
    raw = kernel.encode_frame(np.arange(200, dtype=np.int16)[:, None])
    with pytest.raises(FormatError):
        kernel.decode_frame(raw[:6], 200, 1)
    narrow = kernel.pack_fields(np.array([0, 3, 0]), np.array([16, 6, 40]), 2)
    with pytest.raises(FormatError):
        kernel.decode_frame(narrow, 10, 1)
    index = kernel.pack_fields(np.array([0, 1, 1]), np.array([16, 2, 600]), 2)
    with pytest.raises(FormatError):
        kernel.decode_frame(index, 2, 1)
    for bad in ({"block_len": 0}, {"orders": (0, 1)}, {"thresholds": (3, 8, 10)}, {"thresholds": (8, 3, 20)}, {"thresholds": (40, 50, 60)}, {"blocks_per_frame": 4000}):
        with pytest.raises(ValueError):
            CodecParams(**bad)
    for shape in ((0, 1), (10001, 1), (5, 9)):
        with pytest.raises(ValueError):
            kernel.encode_frame(np.zeros(shape, np.int16))


def archive(n=50_137, channels=1, rate=48000):
    k = np.arange(n)[:, None]
    x = (np.sin(k * 0.003 + np.arange(channels)) * 9000 + np.random.default_rng(3).integers(0, 256, (n, channels))).astype(np.int16)
    return x, formats.encode_archive(x, rate)


def decode_all(data, **kw):
    f, size = formats.from_bytes(data)
    rec = formats.open_recording(f, size)
    parts = []
    for fr in formats.frames_of(f, size, rec, **kw):
        f.seek(fr.byte_offset)
        parts.append(formats.decode(f.read(fr.chunk_length), fr, rec))
    return rec, np.concatenate(parts) if parts else np.zeros((0, rec.channels), np.int16)


@pytest.mark.parametrize("channels", [1, 2])
def test_archive(channels):
    x, data = archive(channels=channels)
    rec, y = decode_all(data, verify=True)
    assert np.array_equal(x, y) and (rec.sample_rate, rec.channels, rec.frames, rec.block_len, rec.rice_orders) == (48000, channels, 50137, 20, (0, 1, 3))
    frames = list(formats.scan_archive(*formats.from_bytes(data)))
    assert [f.sample_offset for f in frames] == [0, 10000, 20000, 30000, 40000, 50000] and frames[1].time_ns == 10000 * 10**9 // 48000


def test_archive_faults():
    _, data = archive(25_000)
    at = 28 + len(formats.build_xml(48000))
    broken = bytearray(data)
    broken[at + 24] ^= 0xFF
    list(formats.scan_archive(*formats.from_bytes(bytes(broken))))
    with pytest.raises(FormatError):
        list(formats.scan_archive(*formats.from_bytes(bytes(broken)), verify=True))
    broken = bytearray(data)
    broken[at + 5] ^= 0xFF
    with pytest.raises(FormatError):
        list(formats.scan_archive(*formats.from_bytes(bytes(broken))))
    with pytest.raises(FormatError):
        formats.archive_recording(*formats.from_bytes(b"certainly no archive, but long enough"))
    assert not formats.is_archive(b"X3") and formats.is_archive(data)
    assert decode_all(data[:-100])[1].shape == (20_000, 1)  # a cut-off frame ends the scan
    assert decode_all(data + b"padding at the end, longer than a header")[1].shape == (25_000, 1)
    x, stereo = archive(100, 2)
    with pytest.raises(FormatError):
        list(formats.scan_archive(*formats.from_bytes(data + stereo[28 + len(formats.build_xml(48000)) :])))
    with pytest.raises(ValueError):
        formats.frame_header(1, 1, 10, bytes(70_000), 0)


SUD_TEXT = [
    "<EVENT>\n<HARDWARE_ID> ST600 </HARDWARE_ID>\n</EVENT>\n",
    '<CFG ID="1">\n<PROC> AUDIO </PROC>\n<NCHS> 1 </NCHS>\n<FS UNIT="Hz"> 192000 </FS>\n<NBITS> 16 </NBITS>\n</CFG>\n',
    '<CFG ID="3" FTYPE="X3V2">\n<BLKLEN> 16 </BLKLEN>\n</CFG>\n',
    '<CFG ID="4" FTYPE="wav" CODEC="3">\n<FS> 48000 </FS>\n<NBITS> 16 </NBITS>\n<NCHS> 1 </NCHS>\n</CFG>\n',
]


def sud_file(texts=SUD_TEXT, chunks=((0, 300), (300, 1000))):
    x = (np.sin(np.arange(1000) * 0.05) * 3000).astype(np.int16)[:, None]
    meta = [formats.sud_record(kernel.swap_pairs((t + "\0" * (len(t) % 2)).encode()), 1) for t in texts]
    audio = [formats.sud_record(kernel.swap_pairs(kernel.encode_frame(x[a:b], CodecParams(block_len=16))), b - a) for a, b in chunks]
    return x, b"\0" * 100 + b"".join([*meta[:2], *audio[:1], *meta[2:], *audio[1:]])


def test_recorder_file():
    x, data = sud_file()
    rec, y = decode_all(data)
    assert np.array_equal(x, y) and (rec.sample_rate, rec.channels, rec.bit_depth, rec.device_id, rec.block_len, rec.frames) == (48000, 1, 16, "ST600", 16, 1000)
    assert rec.xml == "<SUD_METADATA>\n" + "".join(SUD_TEXT) + "</SUD_METADATA>\n"
    assert decode_all(sud_file(SUD_TEXT[:2])[1])[0].sample_rate == 192000
    assert decode_all(data + b"lost sync")[1].shape == (1000, 1)
    none = decode_all(bytes(256))[0]
    assert (none.sample_rate, none.channels, none.bit_depth, none.device_id, none.frames, none.status) == (576000, 1, 16, "UNKNOWN", 0, "no_sync")


def test_record_index():
    record = lambda n, kind: formats.sud_record(bytes(n), kind)
    data = record(4, 1) + record(100, 32) + record(120, 48) + record(4, 1)
    f = list(formats.sud_frames(*formats.from_bytes(data), 48000, 1))
    assert [(x.sample_offset, x.byte_offset - 20, x.time_ns) for x in f] == [(0, 24, 0), (32, 144, 666666)]


def test_wav():
    x = np.arange(-50, 50, dtype=np.int16).reshape(-1, 2)
    head = formats.wav_header(16000, 2, 50)
    rec, y = decode_all(head + x.tobytes())
    assert len(head) == 44 and np.array_equal(x, y) and (rec.sample_rate, rec.channels, rec.frames) == (16000, 2, 50)
    extra = head[:36] + b"LIST\x03\0\0\0abc\0" + head[36:]
    assert np.array_equal(decode_all(extra + x.tobytes())[1], x)
    assert decode_all(head + x.tobytes()[:-3])[1].shape == (49, 2)
    for bad in (head[:20] + b"\x03\0" + head[22:], b"RIFX" + head[4:], head[:36] + bytes(8)):
        with pytest.raises(FormatError):
            formats.wav_recording(*formats.from_bytes(bad + x.tobytes()))


def test_times():
    assert formats.time_ns(172_813_552, 48000) == 172_813_552 * 10**9 // 48000 and formats.time_ns(5, 0) == 0
    assert formats.time_ns(10**11, 576000) == 10**11 * 10**9 // 576000  # no overflow
