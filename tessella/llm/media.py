"""Media columns by signature sniffing (operator 3).

Payloads are stored as 8-bit PCM samples in a RIFF/WAVE container. Reading
trusts no declared type: an Aho-Corasick automaton finds the magic bytes of all
known formats in one pass, a validator for each format confirms structure and
lengths, the file's type is that of the format confirmed at its start, and
confirmed formats further in are media embedded in it, which can be carved out.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import persist, small_batches, text_or_empty

BLOCK = 64
RATE = 8000

# Magic bytes of the formats.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
}


#: Bytes that are unpacked at once, and between sums that are kept.
_PIECE, _STEP = 1 << 16, 1 << 12
_PDF_MARKS = re.compile(rb"%PDF-|startxref\s+[0-9]+\s+%%EOF")


def _sums(bits: int, polynomial: int) -> list[int]:
    """The table of a cyclic redundancy check, most significant bit first."""
    top, all_ = 1 << bits - 1, (1 << bits) - 1
    table = []
    for byte in range(256):
        rest = byte << bits - 8
        for _ in range(8):
            rest = (rest << 1 & all_) ^ (polynomial if rest & top else 0)
        table.append(rest)
    return table


# The polynomial of FLAC's sum over frame headers.
_FLAC_HEADS = _sums(8, 0x07)


class _Seen:
    """What searches and walks over one file have found, so that many candidates in it do not repeat them.

    Every walk from place to place leaves its outcome at all places that it
    came by, so a place is walked on from once, whatever the number of
    candidates that lead to it.
    """

    def __init__(self, data: memoryview):
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.ends: dict[int, tuple[int, int, int, int]] = {}
        self.sums: list[int] | None = None
        self.flac: _Flac | None = None
        self.described: dict[int, list[int]] | None = None
        # By walk: where from each place it comes to.
        self.walked: dict[str, dict] = defaultdict(dict)

    def find(self, what: bytes, at: int) -> int:
        """As bytes.find, by places found once."""
        if what not in self.places:
            self.places[what] = [m.start() for m in re.finditer(re.escape(what), self.data)]
        spots = self.places[what]
        i = bisect_left(spots, at)
        return spots[i] if i < len(spots) else -1

    def crc32(self, a: int, b: int) -> int:
        """The sum of data[a:b]; of long spans from sums kept at steps of _STEP."""
        if b - a <= 8 * _STEP:
            return zlib.crc32(self.data[a:b])
        if self.sums is None:
            self.sums = [0]
            for at in range(0, len(self.data), _STEP):
                self.sums.append(zlib.crc32(self.data[at : at + _STEP], self.sums[-1]))
        upto = lambda at: zlib.crc32(self.data[at // _STEP * _STEP : at], self.sums[at // _STEP])
        return upto(b) ^ _shifted(upto(a), b - a)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, bits reversed."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=1)
def _zeros() -> list[list[int]]:
    """For each byte of a number of zero bytes, and each value of it, the factor that they are."""
    tables, step = [], 0x00800000  # x**8
    for _ in range(5):
        row = [0x80000000]  # 1
        for _ in range(256):
            row.append(_times(row[-1], step))
        step = row.pop()
        tables.append(row)
    return tables


def _shifted(sum_: int, zeros: int) -> int:
    """What a CRC-32 contributes once so many further bytes have passed."""
    for row in _zeros():
        if zeros & 255:
            sum_ = _times(row[zeros & 255], sum_)
        zeros >>= 8
    return sum_


def _wav_end(data: memoryview, at: int, seen: _Seen) -> int:
    if len(data) < at + 44 or bytes(data[at + 8 : at + 16]) != b"WAVEfmt ":
        return 0
    riff, = struct.unpack_from("<I", data, at + 4)
    end = at + 8 + riff
    if end > len(data):
        return 0
    pos, fmt = _wav_data(data, at + 12, seen)
    if not pos or not fmt or pos + 8 > end:
        return 0
    size, = struct.unpack_from("<I", data, pos + 4)
    kind = struct.unpack_from("<HHIIHH", data, fmt + 8)
    return end if pos + 8 + size <= end and kind[0] == 1 and kind[1] and kind[4] == kind[1] * kind[5] // 8 and size % kind[4] == 0 else 0


def _wav_data(data: memoryview, at: int, seen: _Seen) -> tuple[int, int]:
    """The data chunk that chunks from a place lead to, and the last format chunk before it; 0 for none."""
    known, trail, pos = seen.walked["wav"], [], at
    while pos not in known:
        if pos + 8 > len(data):
            known[pos] = 0, 0
            break
        name, size = bytes(data[pos : pos + 4]), struct.unpack_from("<I", data, pos + 4)[0]
        if name == b"data":
            known[pos] = pos, 0
            break
        trail.append((pos, name == b"fmt " and size >= 16))
        pos += 8 + size + size % 2
    spot, fmt = known[pos]
    for pos, is_format in reversed(trail):
        fmt = fmt or (pos if is_format else 0)
        known[pos] = spot, fmt
    return known[at]


def _png_end(data: memoryview, at: int, seen: _Seen) -> int:
    if len(data) < at + 20 or struct.unpack_from(">I", data, at + 8)[0] != 13 or data[at + 12 : at + 16] != b"IHDR":
        return 0
    known, trail, pos, end = seen.walked["png"], [], at + 8, 0
    while pos not in known and pos + 12 <= len(data):
        trail.append(pos)
        size, last = struct.unpack_from(">I", data, pos)[0], data[pos + 4 : pos + 8] == b"IEND"
        if pos + 12 + size > len(data) or seen.crc32(pos + 4, pos + 8 + size) != struct.unpack_from(">I", data, pos + 8 + size)[0]:
            break
        pos += 12 + size
        if last:
            end = pos
            break
    else:
        end = known.get(pos, 0)
    known.update(dict.fromkeys(trail, end))
    return end


def _gif_end(data: memoryview, at: int, seen: _Seen) -> int:
    if len(data) < at + 14 or 0 in struct.unpack_from("<HH", data, at + 6):
        return 0
    known, trail, end = seen.walked["gif"], [], 0
    pos = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while pos not in known and pos < len(data):
        trail.append(pos)
        kind = data[pos]
        if kind == 0x3B:
            end = pos + 1
            break
        if kind == 0x2C and pos + 10 < len(data):
            pos += 11 + (3 << (data[pos + 9] & 7) + 1 if data[pos + 9] & 128 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            break
        pos = _after_blocks(data, pos, seen)
    else:
        end = known.get(pos, 0)
    known.update(dict.fromkeys(trail, end))
    return end


def _after_blocks(data: memoryview, at: int, seen: _Seen) -> int:
    """Behind the empty block that ends the blocks from a place on."""
    known, trail, pos = seen.walked["gif blocks"], [], at
    while pos not in known and pos < len(data) and data[pos]:
        trail.append(pos)
        pos += data[pos] + 1
    end = known.get(pos, pos + 1)
    known.update(dict.fromkeys(trail, end))
    return end


def _jpeg_end(data: memoryview, at: int, seen: _Seen) -> int:
    known, trail, pos, frame, end = seen.walked["jpeg"], [], at + 2, False, 0
    while (pos, frame) not in known and pos + 4 <= len(data) and data[pos] == 0xFF:
        trail.append((pos, frame))
        kind, size = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(data):
            break
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        if kind == 0xDA:
            end = seen.find(b"\xff\xd9", pos) + 2 if frame else 0
            end = end if end > 1 else 0
            break
        pos += 2 + size
    else:
        end = known.get((pos, frame), 0)
    known.update(dict.fromkeys(trail, end))
    return end


def _bmp_end(data: memoryview, at: int, seen: _Seen) -> int:
    if len(data) < at + 54:
        return 0
    size, unused, offset, header = struct.unpack_from("<IIII", data, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    good = header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + header <= offset <= size <= len(data) - at and not unused
    return at + size if good and size - offset >= (width * bits + 31) // 32 * 4 * abs(height) else 0


def _pdf_end(data: memoryview, at: int, seen: _Seen) -> int:
    """The last startxref, number and %%EOF before another %PDF- header, as a file may hold several revisions."""
    if len(data) < at + 8 or data[at + 5] not in b"12" or data[at + 6] != 46:
        return 0
    pos, end = at + 8, 0
    for m in _PDF_MARKS.finditer(data, pos):
        if m[0] == b"%PDF-":
            break
        end = m.end()
    return end


def _zip_end(data: memoryview, at: int, seen: _Seen) -> int:
    """The end of the archive whose local entries begin here: its directory's offsets must fit this start."""
    start = _zip_directory(data, at, seen)
    if start not in seen.ends:
        pos = start
        while start and len(data) >= pos + 46 and data[pos : pos + 4] == b"PK\x01\x02":
            pos += 46 + sum(struct.unpack_from("<HHH", data, pos + 28))
        good = start and len(data) >= pos + 22 and data[pos : pos + 4] == b"PK\x05\x06"
        seen.ends[start] = (pos, *struct.unpack_from("<IIH", data, pos + 12)) if good else (0, 0, 0, 0)
    pos, size, offset, comment = seen.ends[start]
    return pos + 22 + comment if pos and size == pos - start and offset == start - at and pos + 22 + comment <= len(data) else 0


def _zip_directory(data: memoryview, at: int, seen: _Seen) -> int:
    """Where the directory stands behind the local entries that begin here, 0 if they break off."""
    known, pos, walked = seen.walked["zip"], at, []
    while pos and pos not in known and len(data) >= pos + 30 and data[pos : pos + 4] == b"PK\x03\x04":
        walked.append(pos)
        flags, method = struct.unpack_from("<HH", data, pos + 6)
        packed, plain, name, extra = struct.unpack_from("<IIHH", data, pos + 18)
        pos += 30 + name + extra
        if not flags & 8:
            pos = pos + packed if pos + packed <= len(data) else 0
        elif method == 8:  # sizes follow the data: where deflated data end, they say themselves
            end = _inflated_end(data, pos, -15, seen)
            pos = end + 12 + 4 * (data[end : end + 4] == b"PK\x07\x08") if end else 0
        else:
            pos = _descriptor_of_stored(data, pos, seen)
    pos = known.get(pos, pos if data[pos : pos + 4] in (b"PK\x01\x02", b"PK\x05\x06") else 0)
    known.update(dict.fromkeys(walked, pos))
    return pos


def _descriptor_of_stored(data: memoryview, at: int, seen: _Seen) -> int:
    """The end of the first descriptor that states the length and the sum of what precedes it."""
    if seen.described is None:
        seen.described = defaultdict(list)  # by the place that their lengths lead back to
        for m in re.finditer(b"PK\x07\x08", data):
            if m.end() + 12 <= len(data):
                packed, plain = struct.unpack_from("<II", data, m.start() + 8)
                if packed == plain <= m.start():
                    seen.described[m.start() - packed].append(m.start())
    for pos in seen.described.get(at, ()):
        if struct.unpack_from("<I", data, pos + 4)[0] == seen.crc32(at, pos):
            return pos + 16
    return 0


def _stored_chain(data: memoryview, at: int, seen: _Seen) -> tuple[int, int]:
    """Where stored blocks from a byte on lead, and the bytes that they hold: behind the last block, or 0 if one is cut or damaged, or minus the place of a block that is not stored."""
    known, trail, pos, last = seen.walked["stored"], [], at, False
    while pos not in known and not last:
        if pos < len(data) and data[pos] >> 1 & 3:
            known[pos] = -pos, 0
            break
        size, other = struct.unpack_from("<HH", data, pos + 1) if pos + 5 <= len(data) else (0, 0)
        if size ^ other != 0xFFFF or pos + 5 + size > len(data):
            known[pos] = 0, 0
            break
        trail.append((pos, size))
        last, pos = bool(data[pos] & 1), pos + 5 + size
    end, held = (pos, 0) if last else known[pos]
    for pos, size in reversed(trail):
        held += size
        known[pos] = end, held
    return end, held


def _inflated_end(data: memoryview, at: int, window: int, seen: _Seen) -> int:
    """Where the compressed stream that begins at a place ends, 0 if it is none; read in pieces, nothing is kept.

    Stored blocks are walked over by their lengths; a gzip stream of stored
    blocks alone is only read if its stated length is right.
    """
    start = at if window < 0 else _gzip_body(data, at, seen)
    if not start:
        return 0
    end, held = _stored_chain(data, start, seen)
    if end == 0 or (end > 0 and window < 0):
        return end
    if end > 0 and (len(data) < end + 8 or struct.unpack_from("<I", data, end + 4)[0] != held & 0xFFFFFFFF):
        return 0
    unzip, pos = zlib.decompressobj(window), at
    try:
        while not unzip.eof and pos < len(data):
            piece = data[pos : pos + _PIECE]
            pos += len(piece)
            unzip.decompress(piece, _PIECE)
            while unzip.unconsumed_tail and not unzip.eof:
                unzip.decompress(unzip.unconsumed_tail, _PIECE)
    except zlib.error:
        return 0
    return pos - len(unzip.unused_data) if unzip.eof else 0


def _gzip_body(data: memoryview, at: int, seen: _Seen) -> int:
    """Where the compressed data of a gzip member begin, 0 if its header is cut."""
    flags, pos = data[at + 3], at + 10
    if flags & 4:
        pos += 2 + (struct.unpack_from("<H", data, pos)[0] if pos + 2 <= len(data) else len(data))
    for bit in (8, 16):
        if flags & bit:
            pos = seen.find(b"\0", pos) + 1
            if not pos:
                return 0
    pos += 2 * bool(flags & 2)
    return pos if pos < len(data) else 0


def _gzip_end(data: memoryview, at: int, seen: _Seen) -> int:
    return 0 if len(data) < at + 18 or data[at + 3] & 0xE0 else _inflated_end(data, at, 31, seen)


def _flac_end(data: memoryview, at: int, seen: _Seen) -> int:
    """Stream information, further metadata blocks, then frames whose headers have right sums, up to the number of samples stated.

    A frame ends where the next one's header begins or, the last one, where the
    sum over the frame is right.
    """
    if len(data) < at + 42 or data[at + 4] & 127 or data[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    low, high = struct.unpack_from(">HH", data, at + 8)
    stated = int.from_bytes(data[at + 18 : at + 26], "big") & (1 << 36) - 1
    pos = _after_metadata(data, at + 4, seen)
    if not 16 <= low <= high or not pos or pos > len(data):
        return 0
    if seen.flac is None:
        seen.flac = _Flac(data)
    return seen.flac.end(pos, stated)


def _after_metadata(data: memoryview, at: int, seen: _Seen) -> int:
    """Behind the last of the metadata blocks from a place on, 0 if they are cut."""
    known, trail, pos = seen.walked["flac"], [], at
    while pos not in known and len(data) >= pos + 4:
        trail.append(pos)
        last, pos = data[pos] & 128, pos + 4 + int.from_bytes(data[pos + 1 : pos + 4], "big")
        if last:
            known.update(dict.fromkeys(trail, pos))
            return pos
    end = known.get(pos, 0)
    known.update(dict.fromkeys(trail, end))
    return end


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """x to each power below 32767, the order of x, modulo the polynomial of FLAC's sum over frames."""
    out = np.empty(32767, np.uint16)
    value = 1
    for i in range(len(out)):
        out[i] = value
        value = (value << 1 & 0xFFFF) ^ (0x8005 if value & 0x8000 else 0)
    return out


class _Flac:
    """All frames of a file and how they follow one another.

    The sum over a span, its own two bytes with it, is 0 if and only if a
    running sum, each byte of which is taken back by its place, is alike at
    both ends. So a frame's end is the next place with the value of its begin.
    """

    def __init__(self, data: memoryview):
        frames = {m.start(): f for m in re.finditer(b"\xff[\xf8\xf9]", data) if (f := _flac_frame(data, m.start()))[0]}
        self.at = np.array(list(frames), np.int64)
        self.samples = np.array([f[0] for f in frames.values()], np.int64)
        body = np.array([f[1] for f in frames.values()], np.int64)
        if not len(self.at):
            return
        value = self._running(data)
        order = np.argsort(value, kind="stable")
        sorted_ = value[order]
        # Places of equal value stand together, in order: the first one from behind the header on.
        group = np.searchsorted(sorted_, value[self.at], "right")
        self.any_end = np.full(len(self.at), -1, np.int64)
        self.next = np.full(len(self.at), -1, np.int64)
        key = sorted_.astype(np.int64) * (len(value) + 1) + order
        spot = np.searchsorted(key, value[self.at].astype(np.int64) * (len(value) + 1) + body + 2)
        found = spot < group
        self.any_end[found] = order[spot[found]]
        own = value[self.at].astype(np.int64) * (len(value) + 1) + self.at
        by_value = np.argsort(own)
        spot = np.searchsorted(own[by_value], value[self.at].astype(np.int64) * (len(value) + 1) + body + 2)
        there = spot < len(own)
        there[there] = value[self.at][by_value[spot[there]]] == value[self.at][there]
        self.next[there] = by_value[spot[there]]
        self._chains()

    @staticmethod
    def _running(data: memoryview) -> np.ndarray:
        every = np.frombuffer(data, np.uint8)
        out = np.zeros(len(every) + 1, np.uint16)
        for a in range(0, len(every), 1 << 20):
            part = every[a : a + (1 << 20)]
            place, powers, sums = np.arange(a, a + len(part)), _powers(), np.zeros(len(part), np.uint16)
            for bit in range(8):
                sums ^= np.where(part >> bit & 1, powers[(8 + bit - 8 * place) % 32767], np.uint16(0)).astype(np.uint16)
            out[a + 1 : a + 1 + len(part)] = np.bitwise_xor.accumulate(sums) ^ out[a]
        return out

    def _chains(self) -> None:
        """What follows a frame 1, 2, 4 ... frames on, and the samples until there; and, without a stated number, where all ends."""
        n = len(self.at)
        step, held = np.where(self.next < 0, n, self.next), np.append(self.samples, 0)
        self.steps, self.held = [np.append(step, n)], [held]
        while (self.steps[-1] < n).any():
            step, held = self.steps[-1], self.held[-1]
            self.steps.append(step[step])
            self.held.append(held + held[step])
        number = {int(a): i for i, a in enumerate(self.at)}
        self.number, self.last = number, np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            end = int(self.any_end[i])
            self.last[i] = 0 if end < 0 else self.last[number[end]] if end in number else end

    def end(self, pos: int, stated: int) -> int:
        """Where the frames from a place on end that hold so many samples (0: all that follow)."""
        if not len(self.at) or pos not in self.number:
            return 0
        i = self.number[pos]
        if not stated:
            return int(self.last[i])
        # The longest way that stays below the number; the frame after it is the last one.
        for step, held in zip(reversed(self.steps), reversed(self.held), strict=True):
            if i < len(self.at) and held[i] < stated:
                i, stated = int(step[i]), stated - int(held[i])
        return max(0, int(self.any_end[i])) if i < len(self.at) else 0


def _flac_frame(data: memoryview, at: int) -> tuple[int, int]:
    """The samples of the frame whose header begins at a place and where the header ends; 0, 0 if there is none."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return 0, 0
    size, rate, first = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    pos = at + 5 + more
    wide = {6: 1, 7: 2}.get(size, 0)
    end = pos + wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or len(data) <= end:
        return 0, 0
    sum_ = 0
    for byte in data[at:end]:
        sum_ = _FLAC_HEADS[sum_ ^ byte]
    if sum_ != data[end]:
        return 0, 0
    samples = int.from_bytes(data[pos : pos + wide], "big") + 1 if wide else 192 if size == 1 else 144 << size if size < 6 else 1 << size
    return samples, end + 1


def _ogg_end(data: memoryview, at: int, seen: _Seen) -> int:
    known, trail, pos, end = seen.walked["ogg"], [], at, 0
    while pos not in known and len(data) >= pos + 27 and data[pos : pos + 5] == b"OggS\0":
        trail.append(pos)
        table = data[pos + 27 : pos + 27 + data[pos + 26]]
        last, pos = data[pos + 5] & 4, pos + 27 + len(table) + sum(table)
        if pos > len(data):
            break
        if last:
            end = pos
            break
    else:
        end = known.get(pos, 0)
    known.update(dict.fromkeys(trail, end))
    return end


#: Each gives the end of the format's file that begins at a place, 0 if none does.
VALID = {
    "audio/wav": _wav_end, "image/png": _png_end, "image/gif": _gif_end, "image/jpeg": _jpeg_end, "image/bmp": _bmp_end, "application/pdf": _pdf_end,
    "application/zip": _zip_end, "application/gzip": _gzip_end, "audio/flac": _flac_end, "audio/ogg": _ogg_end,
}


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick over the magic bytes, read as Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each confirmed file: the outer one first if it begins at 0, then those embedded.

    A candidate inside another embedded one that is already confirmed is part
    of that one. Empty bytes hold no file.
    """
    view, found, covered = memoryview(data), [], 0
    seen = _Seen(view)
    for last, (size, kind) in automaton().iter(data.decode("latin-1")):
        start = last - size + 1
        if start and start < covered:
            continue
        if end := VALID[kind](view, start, seen):
            found.append((kind, start, end))
            covered = end if start else covered
    return found


def samples(data: bytes) -> bytes:
    """The samples of a confirmed WAVE file."""
    pos = 12
    while (name := data[pos : pos + 4]) != b"data":
        if not name:
            raise ValueError("no samples")
        pos += 8 + (size := struct.unpack_from("<I", data, pos + 4)[0]) + size % 2
    return data[pos + 8 : pos + 8 + struct.unpack_from("<I", data, pos + 4)[0]]


def _le32(n: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))


def as_wave(body: Column) -> Column:
    """Bytes as the samples of a WAVE file (8 bits, mono), padded by 0 to a positive multiple of BLOCK."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / BLOCK)).cast("long") * BLOCK
    payload = F.rpad(body, size.cast("int"), F.lit(b"\0"))
    fmt = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _le32(size + 36), F.lit(fmt), _le32(size), payload)


_FOUND = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("media_type", T.StringType()), ("embedded", T.IntegerType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()),
            ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
        )
    ]
)


@F.pandas_udf(_FOUND)
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import hashlib

    names = ["media_type", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for stored in batches:
        rows = []
        for media in stored:
            found = sniff(media)
            outer = next((x for x in found if x[1] == 0 and x[2] == len(media)), None)
            if outer is None or outer[0] != "audio/wav":
                raise ValueError("stored media is damaged")
            payload = samples(media)
            wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
            inner = [x for x in found if x is not outer]
            crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
            level = int((wave.astype(np.int64) ** 2).sum() // len(wave))
            feature = f"{outer[0]};samples={len(wave)};power={level};crossings={crossings};embedded={','.join(f'{k}@{a}+{b - a}' for k, a, b in inner)}"
            rows.append((outer[0], len(inner), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(rows, columns=names)


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Writes a table doc_id, n_bytes, declared_type, media and reads it back. A null text is empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.encode(text_or_empty(text), "UTF-8").alias("body"))
    return persist(rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(declared).alias("declared_type"), as_wave(F.col("body")).alias("media")))


def media_features(stored: DataFrame) -> DataFrame:
    """stored without its bytes, with the corrected media_type and the features of what is read back.

    Rows that repeat stand each; empty table: no rows.
    """
    small_batches(stored.sparkSession)
    return stored.withColumn("found", _features("media")).select("doc_id", "n_bytes", "declared_type", "found.*")


def corrected_types(stored: DataFrame, id_column: str = "doc_id", declared: str = "declared_type", media: str = "media") -> DataFrame:
    """doc_id, declared_type, media_type, corrected for every row of stored.

    media_type is the format confirmed from the first byte to the last, else
    the one confirmed at the start, else the declared type. Null media keep
    their declared type. Rows that repeat stand each.
    """
    small_batches(stored.sparkSession)

    @F.pandas_udf("string")
    def kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            yield pd.Series([_outer_type(x) for x in many], dtype=object)

    found = stored.select(F.col(id_column).alias("doc_id"), F.col(declared).alias("declared_type"), kind(media).alias("kind"))
    return found.select("doc_id", "declared_type", F.coalesce("kind", "declared_type").alias("media_type"), (F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("declared_type"))).alias("corrected"))


def _outer_type(data: bytes | None) -> str | None:
    at_start = [] if data is None else [(b == len(data), k) for k, a, b in sniff(data) if a == 0]
    return max(at_start)[1] if at_start else None


def carve(stored: DataFrame, id_column: str = "doc_id", media: str = "media") -> DataFrame:
    """doc_id, media_type, start, content: each confirmed file inside stored media, the outer one not counted.

    Null and empty media have none; rows that repeat are carved each.
    """
    small_batches(stored.sparkSession)

    @F.pandas_udf("array<struct<media_type:string,start:long,content:binary>>")
    def carved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            yield pd.Series([[{"media_type": k, "start": a, "content": x[a:b]} for k, a, b in sniff(x) if a] if x is not None else [] for x in many], dtype=object)

    return stored.select(F.col(id_column).alias("doc_id"), F.explode(carved(media)).alias("part")).select("doc_id", "part.*")
