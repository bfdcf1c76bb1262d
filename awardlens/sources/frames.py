"""Where the frames of a zstd file begin, so that tasks can unpack parts of one file.

A zstd file is a row of frames that are unpacked independently of each other; parallel
compressors write one every few megabytes. Their places are found without unpacking: from
the seek table at the end of the file if there is one, else by walking over the headers of
the blocks, which say how long each block is.
"""

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle

# Fixed values of the format.
FRAME = 0xFD2FB528
SKIPPABLE = 0x184D2A50  # the last four bits are free
SEEK_TABLE = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
RLE_BLOCK, RESERVED_BLOCK = 1, 3

STEP = 4 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class NoFrame(ValueError):
    """The file is cut off or no zstd file."""


@dataclass
class _Walk:
    """A stream that is read forwards in large steps, and mostly passed over."""

    source: object
    held: bytes = b""
    at: int = field(default=0, init=False)  # of what is held next, in the file

    def peek(self, size: int) -> bytes:
        while len(self.held) < size and (more := self.source.read(STEP)):
            self.held += more
        return self.held[:size]

    def skip(self, size: int) -> None:
        self.at += size
        while size > len(self.held):
            size -= len(self.held)
            self.held = self.source.read(STEP)
            if not self.held:
                raise NoFrame("file ends inside a compressed frame")
        self.held = self.held[size:]


def walk_frames(source) -> Iterator[tuple[int, int]]:
    """Offset and length of each frame, skippable ones included, by their block headers."""
    import zstandard

    walk = _Walk(source)
    while start := walk.peek(18):
        offset = walk.at
        if len(start) < 8:
            raise NoFrame("file ends inside a compressed frame")
        magic, size = struct.unpack_from("<II", start)
        if magic & ~15 == SKIPPABLE:
            walk.skip(8 + size)
        elif magic != FRAME:
            raise NoFrame(f"no zstd frame at byte {offset}")
        else:
            has_checksum = zstandard.get_frame_parameters(start).has_checksum
            walk.skip(zstandard.frame_header_size(start))
            last = False
            while not last:
                head = walk.peek(3)
                if len(head) < 3:
                    raise NoFrame("file ends inside a compressed frame")
                block = int.from_bytes(head, "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                if kind == RESERVED_BLOCK:
                    raise NoFrame(f"bad block at byte {walk.at}")
                walk.skip(3 + (1 if kind == RLE_BLOCK else size))
            walk.skip(4 * has_checksum)
        yield offset, walk.at - offset


def seek_table(file, length: int) -> list[tuple[int, int]] | None:
    """Offset and length of the frames by the table at the end of the file, if it has one.

    ``file`` can seek. A table that doesn't add up to the length of the file is none.
    """
    if length < 17:
        return None
    file.seek(length - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    entry = 12 if flags & 0x80 else 8
    size = 8 + count * entry + 9
    if magic != SEEK_FOOTER or size > length:
        return None
    file.seek(length - size)
    table = file.read(size)
    if struct.unpack_from("<II", table) != (SEEK_TABLE, size - 8):
        return None
    frames, at = [], 0
    for (packed,) in struct.iter_unpack(f"<I{entry - 4}x", table[8:-9]):
        frames.append((at, packed))
        at += packed
    return [*frames, (at, size)] if at + size == length else None


def runs_of(frames: list[tuple[int, int]], size: int, least: int = 0) -> list[tuple[int, int]]:
    """Runs of frames of at least ``size`` bytes, the last may be shorter.

    The first run reaches beyond ``least``.
    """
    out, start, end = [], 0, 0
    for offset, length in frames:
        if end - start >= size and (out or end >= least):
            out.append((start, end - start))
            start = offset
        end = offset + length
    return [*out, (start, end - start)] if end > start else out
