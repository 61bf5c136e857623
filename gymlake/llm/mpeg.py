"""MPEG-1 layer III audio: frames, tags, seek tables, checksums.

`build` stores bytes in a valid file: an ID3v2.3 tag, a frame with a Xing table
and frames whose granules code no samples, so that everything after their side
information is ancillary data, which the format leaves to the user. `parse` reads
any layer III file: it skips tags, finds frame headers (again, after damage),
verifies the CRC of protected frames, reads the Xing table and returns the exact
duration, the byte offset of every frame and the ancillary bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of the format: kbit/s by index of MPEG-1 layer III, and of MPEG-2/2.5; Hz by version.
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE_INDEX, RATE = 2, 32000  # frames of this rate need no padding
SAMPLES = 1152
SIDE = 32  # two channels
OVERHEAD = 4 + 2 + SIDE
XING_FRAMES, XING_BYTES, XING_TOC = 1, 2, 4
PAYLOAD_TAG = "payload-bytes"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = ((value << 1) ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def frame_crc(protected: bytes) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the last two header bytes and the side information."""
    value = 0xFFFF
    for byte in protected:
        value = ((value << 8) & 0xFFFF) ^ _TABLE[(value >> 8) ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    length: int
    samples: int
    rate: int
    kbps: int
    side: int
    protected: bool
    kind: tuple


@lru_cache(maxsize=4096)
def read_header(raw: bytes) -> Header | None:
    """A layer III header with a length, or None."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, raw[1] >> 1 & 3
    bitrate, rate, padding, mode = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1, raw[3] >> 6
    if version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
        return None
    one = version == 3
    kbps, hertz = (BITRATES_1 if one else BITRATES_2)[bitrate], RATES[version][rate]
    samples = 1152 if one else 576
    side = (17 if mode == 3 else 32) if one else (9 if mode == 3 else 17)
    return Header(samples // 8 * kbps * 1000 // hertz + padding, samples, hertz, kbps, side, not raw[1] & 1, (version, rate))


@lru_cache(maxsize=16)
def _start(bitrate: int) -> bytes:
    """Header, checksum and empty side information of a frame."""
    header = bytes((0xFF, 0xFA, bitrate << 4 | RATE_INDEX << 2, 0))
    side = bytes(SIDE)
    return header + frame_crc(header[2:] + side).to_bytes(2, "big") + side


_LENGTHS = [SAMPLES // 8 * k * 1000 // RATE for k in BITRATES_1]


def _smallest(n: int) -> int:
    """The least bitrate whose frame has room for n ancillary bytes."""
    return next(i for i in range(1, 15) if _LENGTHS[i] - OVERHEAD >= n)


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def build(payload: bytes) -> bytes:
    room = _LENGTHS[14] - OVERHEAD
    frames = [_start(14) + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(payload) - len(payload) % room :]:
        last = _smallest(len(rest))
        frames.append((_start(last) + rest).ljust(_LENGTHS[last], b"\0"))
    info = _smallest(120)
    sizes = [_LENGTHS[info], *map(len, frames)]
    total, seek, at, k = sum(sizes), bytearray(), 0, 0
    for percent in range(100):  # each entry: the file part, in 256ths, at which that part of the time begins
        while k < percent * len(sizes) // 100:
            at += sizes[k]
            k += 1
        seek.append(min(255, at * 256 // total))
    xing = b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC, len(frames), total) + bytes(seek)
    text = b"\0" + f"{PAYLOAD_TAG}\0{len(payload)}".encode("latin-1")
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + (_start(info) + xing).ljust(_LENGTHS[info], b"\0") + b"".join(frames)


@dataclass
class Audio:
    tags: dict = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    vbr_seek: bytes = b""
    offsets: list = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbps: set = field(default_factory=set)
    bad_checksums: int = 0
    skipped: int = 0
    data: bytes = b""

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _tags(raw: bytes, out: Audio) -> int:
    """Read ID3v2 tags at the start; where the audio begins."""
    at = 0
    while raw[at : at + 3] == b"ID3" and len(raw) >= at + 10:
        size = raw[at + 6] << 21 | raw[at + 7] << 14 | raw[at + 8] << 7 | raw[at + 9]
        body, version, p = raw[at + 10 : at + 10 + size], raw[at + 3], 0
        while p + 10 <= len(body) and body[p] and version in (3, 4):
            n = int.from_bytes(body[p + 4 : p + 8], "big") if version == 3 else body[p + 4] << 21 | body[p + 5] << 14 | body[p + 6] << 7 | body[p + 7]
            name, value = body[p : p + 4].decode("latin-1"), body[p + 10 : p + 10 + n]
            if name[0] == "T" and value[:1] == b"\0":
                parts = value[1:].decode("latin-1").split("\0")
                out.tags[parts[0] if name == "TXXX" else name] = parts[1] if name == "TXXX" and len(parts) > 1 else parts[0]
            p += 10 + n
        at += 10 + size
    return at


def _resync(raw: bytes, at: int, end: int, kind: tuple | None) -> int:
    """The next offset with a header that another header (or the end) follows where its frame ends."""
    while (at := raw.find(b"\xff", at, end)) >= 0:
        head = read_header(raw[at : at + 4])
        if head and (kind is None or head.kind == kind):
            after = at + head.length
            if after == end or after < end and (follow := read_header(raw[after : after + 4])) and follow.kind == head.kind:
                return at
        at += 1
    return end


def parse(raw: bytes) -> Audio:
    """Everything there is to know of a file; damaged stretches and frames cut short are skipped and counted."""
    out, kind = Audio(), None
    at = _tags(raw, out)
    end = len(raw) - 128 if raw[-128:-125] == b"TAG" else len(raw)
    parts, first = [], True
    while at < end:
        head = read_header(raw[at : at + 4])
        if head is None or kind not in (None, head.kind) or at + head.length > end:
            after = _resync(raw, at + 1, end, kind)
            out.skipped += after - at
            at = after
            continue
        kind = head.kind
        side = at + (6 if head.protected else 4)
        body = side + head.side
        if head.protected and frame_crc(raw[at + 2 : at + 4] + raw[side:body]) != int.from_bytes(raw[at + 4 : side], "big"):
            out.bad_checksums += 1
        elif first and raw[body : body + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(raw[body + 4 : body + 8], "big"), body + 8
            if flags & XING_FRAMES:
                out.vbr_frames, p = int.from_bytes(raw[p : p + 4], "big"), p + 4
            if flags & XING_BYTES:
                out.vbr_bytes, p = int.from_bytes(raw[p : p + 4], "big"), p + 4
            if flags & XING_TOC:
                out.vbr_seek = raw[p : p + 100]
        else:
            out.offsets.append(at)
            out.samples += head.samples
            out.rate = head.rate
            out.kbps.add(head.kbps)
            parts.append(raw[body : at + head.length])
        first = False
        at += head.length
    data = b"".join(parts)
    kept = out.tags.get(PAYLOAD_TAG, "")
    out.data = data[: int(kept)] if kept.isdigit() else data
    return out
