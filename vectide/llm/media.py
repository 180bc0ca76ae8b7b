"""Media columns: MPEG audio.

``encode_mpeg`` puts bytes losslessly into a variable-bitrate MPEG-1 Layer III stream: an ID3v2 tag with the payload's
length, a Xing frame with frame count, size and a table of contents, and CRC-protected mono frames. Their side
information declares no coded samples, so decoders play silence and the payload travels in each frame's ancillary
bytes. ``parse_mpeg`` reads any MPEG audio stream (versions 1, 2 and 2.5, layers I to III): it skips tags, finds frame
headers again after damage, reads Xing, Info and VBRI tables, verifies the checksums of all three layers, and gives
the exact duration as samples over rate and the offset of every frame. Free-format frames, whose headers name no
bitrate, count as damage.

Frames are walked from header to header, and a tag is looked for only where a frame has ended or none has begun yet,
so bytes inside a frame are never taken for a tag.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import as_text, table
from vectide.llm.words import blocks

# Fixed values of the MPEG audio format: bitrates in kbit/s by (version 1?, layer), sample rates in Hz of version 1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Fixed values of Layer II: bits of the allocation of each subband; by version, rate and bitrate of a channel.
ALLOCATION = {
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
    "8": (4,) * 2 + (3,) * 6,
    "12": (4,) * 2 + (3,) * 10,
    "27": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "30": (4,) * 11 + (3,) * 12 + (2,) * 7,
}
#: What this module writes: version 1, layer III, mono at 32 kHz with checksums; header, checksum and side information in bytes.
RATE, MONO_SIDE, HEAD = 32000, 17, 4 + 2 + 17
OWNER = b"vectide payload\0"
PAD = 64


@dataclass(frozen=True)
class Header:
    v1: bool
    layer: int
    crc: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool
    bound: int  # the first subband that both channels share, 32 for none

    @property
    def side(self) -> int:
        return ((17 if self.mono else 32) if self.v1 else (9 if self.mono else 17)) if self.layer == 3 else 0

    def alike(self, other: Header) -> bool:
        return (self.v1, self.layer, self.rate) == (other.v1, other.layer, other.rate)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header's meaning; None if the four bytes aren't one, or have no fixed length (free format)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, bitrate = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or bitrate in (0, 15) or four[3] & 3 == 2:
        return None
    v1 = version == 3
    hz, kbps, pad = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version], BITRATES[v1, layer][bitrate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or v1 else 576
    length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    bound = 4 * (1 + (four[3] >> 4 & 3)) if four[3] >> 6 == 1 else 32
    return Header(v1, layer, not four[1] & 1, kbps, hz, length, samples, four[3] >> 6 == 3, bound)


@lru_cache(1024)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005 from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16 of the first bits of data only."""
    crc = crc16(data[: bits // 8])
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


def _allocation(h: Header) -> tuple[int, ...]:
    """The bits of each subband's allocation in a frame of Layer I or II."""
    if h.layer == 1:
        return (4,) * 32
    own = h.kbps // (1 if h.mono else 2)
    if not h.v1:
        return ALLOCATION["low"]
    if own <= 48:
        return ALLOCATION["12" if h.rate == 32000 else "8"]
    return ALLOCATION["27" if own <= 80 or h.rate == 48000 else "30"]


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: Layer III's side information, else allocations and, in Layer II, the choice of scale factors of each subband that has samples."""
    if h.layer == 3:
        return 8 * h.side
    number, left = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512
    bits = used = 0
    for k, size in enumerate(_allocation(h)):
        own = 1 if h.mono or k >= h.bound else 2
        for _ in range(own):
            left -= size
            # a shared allocation counts for both channels' scale factors
            used += (1 if own == 2 or h.mono else 2) * (number >> left & (1 << size) - 1 > 0)
            bits += size
    return bits + 2 * used if h.layer == 2 else bits


def checksum_holds(h: Header, frame: bytes) -> bool:
    """Whether a protected frame's checksum is that of its header and of what else it covers."""
    bits = protected_bits(h, frame[6:])
    covered = frame[2:4] + frame[6 : 6 + (bits + 7) // 8]
    return len(covered) >= 2 + (bits + 7) // 8 and crc16_bits(covered, 16 + bits) == int.from_bytes(frame[4:6], "big")


def _own(index: int) -> bytes:
    four = bytes((0xFF, 0xFA, index << 4 | RATES.index(RATE) << 2, 0xC0))
    side = bytes(MONO_SIDE)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side


OWN = {header(_own(i)[:4]).length - HEAD: _own(i) for i in range(1, 15)}
ROOM = sorted(OWN)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode_mpeg(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A payload as an MPEG stream; the tag also keeps n_bytes, the length before padding."""
    frames, at, end = [], 0, len(payload)
    while at < end:
        room = ROOM[-1] if end - at >= ROOM[-1] else next(r for r in ROOM if r >= end - at)
        body = payload[at : at + room]
        frames.append(OWN[room] + (body if len(body) == room else body.ljust(room, b"\0")))
        at += room
    private = OWNER + struct.pack(">QQ", end if n_bytes is None else n_bytes, end)
    priv = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    xing_room = next(r for r in ROOM if r >= 120)
    size = sum(map(len, frames)) + HEAD + xing_room
    ends, total = [], HEAD + xing_room
    for f in frames:
        ends.append(total)
        total += len(f)
    toc = bytes(min(255, 256 * ends[k * len(ends) // 100] // size) for k in range(100)) if ends else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    return b"".join((b"ID3\x04\0\0", _syncsafe(len(priv)), priv, OWN[xing_room], xing.ljust(xing_room, b"\0"), *frames))


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames, in bytes from the start
    samples: int = 0
    rate: int = 0
    tags: list[str] = field(default_factory=list)
    table: str = ""  # Xing, Info or VBRI
    table_frames: int = -1
    table_bytes: int = -1
    toc: bytes = b""
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag
    bitrates: set[int] = field(default_factory=set)
    private: bytes = b""

    def seek(self, seconds: float) -> int:
        """The offset of the frame that sounds at a time."""
        per = self.samples // len(self.offsets)
        return self.offsets[min(len(self.offsets) - 1, int(seconds * self.rate) // per)]


def _tag_size(b: bytes, at: int) -> int:
    s = b[at + 6 : at + 10]
    return 10 + (s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3]) + 10 * bool(b[at + 5] & 0x10)


def _id3(b: bytes, at: int, end: int, out: Stream) -> None:
    wide, at = b[at + 3] < 4, at + 10
    while at + 10 <= end and b[at : at + 4].isalnum():
        s = b[at + 4 : at + 8]
        n = int.from_bytes(s, "big") if wide else s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3]
        if b[at : at + 4] == b"PRIV":
            out.private = b[at + 10 : at + 10 + n]
        at += 10 + n


def _vbr(b: bytes, at: int, h: Header, out: Stream) -> bool:
    """Read a table that a first Layer III frame may hold instead of audio."""
    x = at + 4 + 2 * h.crc + h.side
    kind = b[x : x + 4]
    if kind in (b"Xing", b"Info"):
        out.table, x = kind.decode(), x + 8
        flags = int.from_bytes(b[x - 4 : x], "big")
        if flags & 1:
            out.table_frames, x = int.from_bytes(b[x : x + 4], "big"), x + 4
        if flags & 2:
            out.table_bytes, x = int.from_bytes(b[x : x + 4], "big"), x + 4
        if flags & 4:
            out.toc = b[x : x + 100]
        return True
    x = at + 36
    if b[x : x + 4] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, scale, width = struct.unpack(">IIHHH", b[x + 10 : x + 24])
        out.toc = b[x + 26 : x + 26 + n * width]
        return True
    return False


def _at_id3v2(b: bytes, at: int, end: int) -> bool:
    return b[at : at + 3] == b"ID3" and at + 10 <= end and b[at + 3] < 0xFF and not max(b[at + 6 : at + 10]) & 0x80


def _next_start(b: bytes, at: int, end: int) -> int:
    """The next place after some damage where a frame or a tag can begin, the end for none."""
    last = end - 128
    found = [x for x in (b.find(b"\xff", at, end), b.find(b"ID3", at, end)) if x >= 0]
    if last >= at and b[last : last + 3] == b"TAG":
        found.append(last)
    return min(found, default=end)


def parse_mpeg(b: bytes) -> Stream:
    """Every frame of a stream. A first header, or one after damage, counts only if the next frame's header, a tag or the end follows it."""
    out, at, end, synced, last = Stream(), 0, len(b), False, None
    while at < end:
        if _at_id3v2(b, at, end):
            n = _tag_size(b, at)
            _id3(b, at, min(end, at + n), out)
            out.tags.append(f"ID3v2.{b[at + 3]}")
            at += n
            continue
        if at == end - 128 and b[at : at + 3] == b"TAG":
            out.tags.append("ID3v1")
            break
        h = header(b[at : at + 4])
        ok = h is not None and at + h.length <= end and (last is None or h.alike(last))
        if ok and not synced:
            after = at + h.length
            nxt = header(b[after : after + 4])
            tag = _at_id3v2(b, after, end) or (after == end - 128 and b[after : after + 3] == b"TAG")
            ok = after == end or tag or (nxt is not None and nxt.alike(h))
        if not ok:
            nxt = _next_start(b, at + 1, end)
            out.skipped, at, synced = out.skipped + nxt - at, nxt, False
            continue
        first, last, synced = last is None, h, True
        if h.crc:
            good = checksum_holds(h, b[at : at + min(h.length, 6 + 64 + 32)])
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        if not (first and h.layer == 3 and _vbr(b, at, h, out)):
            out.offsets.append(at)
            out.samples += h.samples
            out.bitrates.add(h.kbps)
        out.rate = h.rate
        at += h.length
    return out


def payload_of(b: bytes, s: Stream) -> tuple[bytes, int]:
    """The payload and n_bytes that encode_mpeg has put in; ValueError for a stream that it has not written, or that lost bytes."""
    if not s.private.startswith(OWNER) or len(s.private) != len(OWNER) + 16:
        raise ValueError("the stream holds no payload")
    n_bytes, n = struct.unpack(">QQ", s.private[len(OWNER) :])
    view, parts = memoryview(b), []
    for at in s.offsets:
        parts.append(view[at + HEAD : at + header(b[at : at + 4]).length])
    payload = b"".join(parts)[:n]
    if len(payload) != n:
        raise ValueError(f"{len(payload)} of {n} payload bytes are left")
    return payload, n_bytes


FACTS = T.StructType()
for _names, _type in (
    ("n_bytes payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32 media_bytes", T.LongType()),
    ("media_sha256 feature", T.StringType()), ("samples sample_rate frames table_frames", T.LongType()), ("vbr", T.BooleanType()),
    ("crc_good crc_bad skipped", T.LongType()), ("offsets", T.ArrayType(T.LongType())),
):
    for _name in _names.split():
        FACTS.add(_name, _type)


def stored_form(text: bytes) -> bytes:
    """A text's bytes, padded with 0 to a positive multiple of 64, as an MPEG stream."""
    return encode_mpeg(text + bytes(-len(text) % PAD if text else PAD), len(text))


@F.pandas_udf(T.BinaryType())
def mpeg_column(data: pd.Series) -> pd.Series:
    """Bytes as MPEG streams; null counts as no bytes."""
    return pd.Series([stored_form(bytes(x or b"")) for x in data], dtype=object)


def feature_of(s: Stream) -> str:
    """Duration, frames, table, bitrates, checksums and tags as one line."""
    rates = f"{min(s.bitrates)}-{max(s.bitrates)}" if s.bitrates else "none"
    return (
        f"{s.samples}/{s.rate}s;frames={len(s.offsets)};table={s.table}:{s.table_frames};kbps={rates};"
        f"crc={s.crc_good}/{s.crc_good + s.crc_bad};tags={'+'.join(s.tags)};skipped={s.skipped}"
    )


def facts_of(media: bytes) -> tuple:
    """The values of FACTS for a stream that encode_mpeg has written."""
    s = parse_mpeg(media)
    payload, n = payload_of(media, s)
    return (
        n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]),
        len(media), hashlib.sha256(media).hexdigest(), feature_of(s),
        s.samples, s.rate, len(s.offsets), s.table_frames, len(s.bitrates) > 1,
        s.crc_good, s.crc_bad, s.skipped, s.offsets,
    )


def media_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the facts read back from its text stored as MPEG audio.

    A null or empty text is 64 zero bytes. Equal texts give equal rows but for the id, and repeated rows repeat. An
    empty table gives no rows, and other input columns may have any names. Texts of any length are stored whole: a task
    holds the streams of a block of about 3 MB of texts, or of one text that is longer.
    """
    rows = docs.select(F.col(id_col).alias(id_col), as_text(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], *FACTS.fields])
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array": pa.list_(pa.int64())}
    arrow = [kinds[f.dataType.typeName()] for f in FACTS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, kept in blocks((b.rename_columns(["id", "text"]) for b in batches), "text", ["id"]):
            found = zip(*(facts_of(stored_form(t)) for t in texts), strict=True)
            columns = [pa.array(list(x), kind) for x, kind in zip(found, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([kept.column(0), *columns], names=schema.names)

    return rows.mapInArrow(work, schema)


def op2_mpeg_media(spark, sf_dir):
    return media_facts(table(spark, sf_dir, "documents"))
