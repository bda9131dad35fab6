"""Records of capture files by byte ranges: classic pcap and pcapng.

A file is cut at any byte.  A range owns the records that start in it; its first one is
found by a chain of plausible records, and the range before ends where that one starts,
which is checked.  pcapng blocks are read with the interfaces of their section, whose
clocks and byte order may differ.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

LARGEST_RECORD = 262_144    # no capture tool stores longer frames
LARGEST_BLOCK = 16 << 20    # nor blocks of other kinds that are longer
CHAIN = 16                  # records in a row that make a place a start of records
YEAR = 366 * 86_400         # records of a file lie no further apart, in seconds
GLOBAL_HEADER, RECORD_HEADER = 24, 16
CHUNK = 8 << 20             # bytes of a file read at once

# Magic numbers: (byte order, ticks per second) of the time stamps (fixed values).
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10 ** 6), b"\xa1\xb2\xc3\xd4": (">", 10 ** 6),
          b"\x4d\x3c\xb2\xa1": ("<", 10 ** 9), b"\xa1\xb2\x3c\x4d": (">", 10 ** 9)}
# Block types of pcapng and the byte order mark of a section (fixed values).
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
_SECTION_BYTES, _ORDER_MARK = b"\x0a\x0d\x0d\x0a", 0x1A2B3C4D
_RESOLUTION, _OFFSET = 9, 14        # options of an interface: ticks of its clock, seconds added to it

Record = tuple[int, int | None, int, bytes]     # position, microseconds, wire length, frame


def open_file(path: str):
    """A seekable stream of a mounted path or of a URI that Arrow knows."""
    if "://" in path and not path.startswith("file:"):
        fs, name = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(name)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def size_of(stream) -> int:
    stream.seek(0, io.SEEK_END)
    return stream.tell()


class DamagedCapture(ValueError):
    pass


@dataclass
class Classic:
    """A pcap file: fixed records after one header."""

    order: str
    ticks: int
    size: int
    first_second: int | None = None

    begin = GLOBAL_HEADER

    @classmethod
    def of(cls, stream) -> Classic:
        size = size_of(stream)
        stream.seek(0)
        head = stream.read(GLOBAL_HEADER + RECORD_HEADER)
        order, ticks = _MAGIC[head[:4]]
        first = struct.unpack(order + "I", head[GLOBAL_HEADER:GLOBAL_HEADER + 4])[0] if len(head) == GLOBAL_HEADER + RECORD_HEADER else None
        return cls(order, ticks, size, first)

    def _header(self, stream, at: int) -> tuple[int, int, int, int] | None:
        stream.seek(at)
        head = stream.read(RECORD_HEADER)
        return struct.unpack(self.order + "IIII", head) if len(head) == RECORD_HEADER else None

    def _plausible(self, seconds, fraction, captured, length):
        near = np.abs(np.asarray(seconds, np.int64) - (self.first_second or 0)) <= YEAR
        return near & (fraction < self.ticks) & (captured <= LARGEST_RECORD) & (length <= LARGEST_RECORD)

    def _chain(self, stream, at: int) -> tuple[int, bool]:
        """Whole records that follow each other from here, and whether these are CHAIN or end with the file."""
        for n in range(CHAIN):
            if at == self.size:
                return n, n > 0
            head = self._header(stream, at)
            if head is None or not self._plausible(*head):
                return n if head is None else -1, False
            if at + RECORD_HEADER + head[2] > self.size:
                return n, False
            at += RECORD_HEADER + head[2]
        return CHAIN, True

    def next_start(self, stream, at: int) -> int:
        """Start of the first record at ``at`` or after, the size of the file if there is no whole one.

        Where the file ends inside a record, the start that most whole records follow counts.
        """
        if at <= self.begin:
            return self.begin
        stream.seek(at)
        raw = np.frombuffer(stream.read(LARGEST_RECORD + 2 * RECORD_HEADER), np.uint8)
        n = len(raw) - RECORD_HEADER + 1
        if n <= 0:
            return self.size
        words = np.lib.stride_tricks.sliding_window_view(raw, 4)
        fields = [np.ascontiguousarray(words[4 * k:4 * k + n]).view(self.order + "u4").ravel() for k in range(4)]
        best, place = 0, self.size
        for spot in np.flatnonzero(self._plausible(*fields)).tolist():
            whole, sure = self._chain(stream, at + spot)
            if sure:
                return at + spot
            if whole > best:
                best, place = whole, at + spot
        return place

    def walk(self, stream, start: int, end: int, bodies: bool, expect: int | None = None) -> Iterator[Record]:
        """Records that start in [start, end); without ``bodies`` frames are empty and only headers are read."""
        at = start
        while at < min(end, self.size):
            head = self._header(stream, at)
            if head is None:
                return
            seconds, fraction, captured, length = head
            if expect is not None and captured != expect:
                raise DamagedCapture(f"record at {at} holds {captured} bytes, not {expect}")
            if captured > LARGEST_RECORD:
                raise DamagedCapture(f"record at {at} claims {captured} bytes: the capture is damaged here")
            if at + RECORD_HEADER + captured > self.size:
                return      # the capture ends inside a record
            yield at, seconds * 10 ** 6 + fraction * 10 ** 6 // self.ticks, length, stream.read(captured) if bodies else b""
            at += RECORD_HEADER + captured

    def after(self, stream, last: int) -> int:
        """Where the record after the one at ``last`` starts; the size of the file if that is cut off or absent."""
        at = last + RECORD_HEADER + self._header(stream, last)[2]
        head = self._header(stream, at)
        return at if head is not None and at + RECORD_HEADER + head[2] <= self.size else self.size

    def arrays(self, stream, start: int, end: int, expect: int | None = None) -> Iterator[tuple[list, list, list, pa.Array]]:
        """:meth:`walk` with bodies as columns, a chunk of the file at a time."""
        at = start
        while at < min(end, self.size):
            stream.seek(at)
            chunk = stream.read(CHUNK)
            base, pos = at, 0
            places, times, lengths, cuts = [], [], [], []
            while base + pos < end and pos + RECORD_HEADER <= len(chunk):
                seconds, fraction, captured, length = struct.unpack_from(self.order + "IIII", chunk, pos)
                if expect is not None and captured != expect:
                    raise DamagedCapture(f"record at {base + pos} holds {captured} bytes, not {expect}")
                if captured > LARGEST_RECORD:
                    raise DamagedCapture(f"record at {base + pos} claims {captured} bytes: the capture is damaged here")
                if pos + RECORD_HEADER + captured > len(chunk):
                    break
                places.append(base + pos)
                times.append(seconds * 10 ** 6 + fraction * 10 ** 6 // self.ticks)
                lengths.append(length)
                pos += RECORD_HEADER + captured
                cuts += [pos - captured, pos]
            if not places:
                return      # the capture ends inside a record
            # frames and what is between them in turn, of which every other one is taken
            both = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(chunk)])
            yield places, times, lengths, both.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
            at = base + pos


@dataclass
class Section:
    """Byte order of a pcapng section and its interfaces so far: (ticks per second, seconds added, snap length)."""

    order: str
    interfaces: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Blocks:
    """A pcapng file: blocks that name their length at both ends."""

    size: int
    section: Section | None = None
    scope: list[tuple[int, bytes]] = field(default_factory=list)    # section and interface blocks met on the way

    begin = 0

    @classmethod
    def of(cls, stream, scope: list[tuple[int, bytes]] = ()) -> Blocks:
        """``scope``: earlier section and interface blocks of the file, in order."""
        found = cls(size_of(stream))
        for at, block in scope:
            found._enter(at, block)
        found.scope = []
        return found

    def _length(self, stream, at: int, order: str | None) -> tuple[int, int, str] | None:
        """Type, length and byte order of the block here, if both its ends name that length."""
        stream.seek(at)
        head = stream.read(12)
        if len(head) < 12:
            return None
        if head[:4] == _SECTION_BYTES:      # the same in both byte orders; its mark tells which
            order = next((o for o in "<>" if struct.unpack(o + "I", head[8:12])[0] == _ORDER_MARK), None)
        if order is None:
            return None
        kind, length = struct.unpack(order + "II", head[:8])
        if length < 12 or length % 4 or length > LARGEST_BLOCK or at + length > self.size:
            return None
        stream.seek(at + length - 4)
        return (kind, length, order) if struct.unpack(order + "I", stream.read(4))[0] == length else None

    def next_start(self, stream, at: int) -> int:
        """Start of the first block at ``at`` or after: blocks begin at multiples of four bytes."""
        at += -at % 4
        if at == 0:
            return 0
        orders = ("<", ">")
        while at < self.size:
            for order in orders:
                place, known = at, order
                for n in range(CHAIN):
                    found = self._length(stream, place, known)
                    if found is None:
                        if n and self._cut_off(stream, place, known):
                            return at
                        break
                    place, known = place + found[1], found[2]
                    if place == self.size:
                        return at
                else:
                    return at
            at += 4
        return self.size

    def _enter(self, at: int, block: bytes) -> None:
        kind = block[:4]
        if kind == _SECTION_BYTES:
            self.section = Section("<" if struct.unpack("<I", block[8:12])[0] == _ORDER_MARK else ">")
        else:
            self.section.interfaces.append(_interface(block, self.section.order))
        self.scope.append((at, block))

    def walk(self, stream, start: int, end: int, bodies: bool, expect: int | None = None) -> Iterator[Record]:
        """Packets of the blocks that start in [start, end); sections and interfaces are entered on the way.

        Without ``bodies`` nothing is given back and only heads and scope are read.
        """
        at = start
        while at < min(end, self.size):
            found = self._length(stream, at, self.section.order if self.section else self._guess(stream, at))
            if found is None:
                if bodies and not self._cut_off(stream, at, self.section.order if self.section else "<"):
                    raise DamagedCapture(f"block at {at}: the capture is damaged here")
                break
            kind, length, order = found
            if kind in (SECTION, INTERFACE):
                stream.seek(at)
                block = stream.read(length)
                if bodies or kind == SECTION or self.section:
                    self._enter(at, block)
                else:
                    self.scope.append((at, block))
            elif bodies and kind in (PACKET, OLD_PACKET, SIMPLE_PACKET):
                stream.seek(at)
                yield _packet(at, kind, stream.read(length), self.section)
            at += length
        self.stopped = at

    def _guess(self, stream, at: int) -> str | None:
        return next((o for o in "<>" if self._length(stream, at, o) is not None), None)

    def _cut_off(self, stream, at: int, order: str) -> bool:
        """Whether the file ends inside the block here."""
        stream.seek(at)
        head = stream.read(8)
        if len(head) < 8 or at + 12 > self.size:
            return True
        length = struct.unpack(order + "II", head)[1]
        return length <= LARGEST_BLOCK and at + length > self.size


def _interface(block: bytes, order: str) -> tuple[int, int, int]:
    snap = struct.unpack(order + "I", block[12:16])[0]
    ticks, added, at = 10 ** 6, 0, 16
    while at + 4 <= len(block) - 4:
        code, size = struct.unpack(order + "HH", block[at:at + 4])
        value = block[at + 4:at + 4 + size]
        if code == 0:
            break
        if code == _RESOLUTION and size == 1:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == _OFFSET and size == 8:
            added = struct.unpack(order + "q", value)[0]
        at += 4 + size + -size % 4
    return ticks, added, snap


def _packet(at: int, kind: int, block: bytes, section: Section) -> Record:
    order = section.order
    if kind == SIMPLE_PACKET:       # no clock, and no length of what was kept
        length = struct.unpack(order + "I", block[8:12])[0]
        snap = section.interfaces[0][2] if section.interfaces else 0
        kept = min(length, len(block) - 16, snap or length)
        return at, None, length, block[12:12 + kept]
    if kind == PACKET:
        number, high, low, kept, length = struct.unpack(order + "IIIII", block[8:28])
    else:
        number, high, low, kept, length = struct.unpack(order + "HxxIIII", block[8:28])
    if number >= len(section.interfaces) or kept > len(block) - 32:
        raise DamagedCapture(f"packet at {at} names interface {number} and {kept} bytes")
    ticks, added, _ = section.interfaces[number]
    return at, added * 10 ** 6 + (high << 32 | low) * 10 ** 6 // ticks, length, block[28:28 + kept]


def layout(stream, scope: list[tuple[int, bytes]] = ()) -> Classic | Blocks:
    stream.seek(0)
    magic = stream.read(4)
    if magic == _SECTION_BYTES:
        return Blocks.of(stream, scope)
    if magic not in _MAGIC:
        raise ValueError("not a pcap file")
    return Classic.of(stream)


@dataclass
class Found:
    """What the heads of a range tell: its first record, the first after it, and the scope blocks in it."""

    start: int
    stop: int
    scope: list[tuple[int, bytes]]


def survey(stream, begin: int, end: int, start: int | None = None) -> Found:
    """Walk the heads of a range, from ``start`` if it is known.

    Where they stop making sense, ``stop`` is -1: the start was wrong, or the file is damaged.
    """
    kind = layout(stream)
    start = kind.next_start(stream, begin) if start is None else start
    try:
        if isinstance(kind, Blocks):
            kind.stopped = start
            for _ in kind.walk(stream, start, end, bodies=False):
                pass
            return Found(start, max(kind.stopped, start), kind.scope)
        at = None
        for at, *_ in kind.walk(stream, start, end, bodies=False):
            pass
        return Found(start, start if at is None else kind.after(stream, at), [])
    except DamagedCapture:
        return Found(start, -1, [])
