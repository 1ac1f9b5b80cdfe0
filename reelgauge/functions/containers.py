"""What a media file's own structure says about it: pictures to the end of their streams, films to the place of each sample.

Parsers ask a Reader for ranges of bytes, so a film of many GB costs its index and three samples. They raise ``Broken`` with the
text of the failure. Pixels are not decoded.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
TRUNCATED = "OSError: image file is truncated"
UNKNOWN_IMAGE = "UnidentifiedImageError: cannot identify image file"
NOT_OPENED = "VideoOpenError: could not open file"
NO_FRAMES = "VideoMetadataError: invalid frame count"
NOT_READ = "VideoReadError: no readable frames"


class Broken(Exception):
    pass


class Reader:
    """Ranges of a file: read(at, n) gives n bytes, or fewer at its end. After seconds it raises TimeoutError."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, seconds: float | None = None):
        self.fetch, self.size, self.seconds, self.began = fetch, size, seconds, time.monotonic()

    @classmethod
    def of(cls, data: bytes, seconds: float | None = None) -> "Reader":
        return cls(lambda at, n: data[at : at + n], len(data), seconds)

    def read(self, at: int, n: int) -> bytes:
        if self.seconds is not None and time.monotonic() - self.began > self.seconds:
            raise TimeoutError("took too long to probe")
        return self.fetch(at, max(0, min(n, self.size - at))) if 0 <= at < self.size else b""


# ---------------------------------------------------------------- pictures

#: Fixed values of the PNG format: channels by colour type, and the seven passes (first column, first row, steps) of interlacing.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _scanline_bytes(width: int, height: int, bits: int) -> int:
    return height * (1 + (width * bits + 7) // 8) if width and height else 0


def check_png(file: Reader) -> None:
    """Chunks with sound checksums up to IEND, whose IDAT stream inflates to exactly the scanlines that IHDR promises."""
    at, stream, got, want, seen_end = 8, zlib.decompressobj(), 0, None, False
    while not seen_end:
        head = file.read(at, 8)
        if len(head) < 8:
            raise Broken(TRUNCATED)
        size, kind = struct.unpack(">I4s", head)
        if at + size + 12 > file.size:
            raise Broken(TRUNCATED)
        crc, first = zlib.crc32(kind), b""
        for part in range(at + 8, at + 8 + size, CHUNK):
            data = file.read(part, min(CHUNK, at + 8 + size - part))
            crc = zlib.crc32(data, crc)
            first = first or data
            if kind == b"IDAT":
                try:
                    while data:
                        got += len(stream.decompress(data, CHUNK))
                        data = stream.unconsumed_tail
                except zlib.error as error:
                    raise Broken(f"OSError: broken data stream when reading image file ({error})") from None
        if crc != int.from_bytes(file.read(at + 8 + size, 4), "big"):
            raise Broken(f"SyntaxError: broken PNG chunk {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise Broken("SyntaxError: broken PNG header")
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", first)
            if not width or not height or colour not in PNG_CHANNELS:
                raise Broken("SyntaxError: broken PNG header")
            bits = depth * PNG_CHANNELS[colour]
            passes = [(-(-max(0, width - x) // dx), -(-max(0, height - y) // dy)) for x, y, dx, dy in ADAM7] if interlaced else [(width, height)]
            want = sum(_scanline_bytes(w, h, bits) for w, h in passes)
        seen_end = kind == b"IEND"
        at += size + 12
    if want is None:
        raise Broken("SyntaxError: PNG without a header")
    if not stream.eof or got < want:
        raise Broken(TRUNCATED)
    if got > want:
        raise Broken("OSError: more image data than the header promises")


def check_jpeg(file: Reader) -> None:
    """Marker segments up to a frame and a scan, then scan data up to the end marker."""
    at, framed, scanned = 2, False, False
    while True:
        head = file.read(at, 4)
        if len(head) < 2:
            raise Broken(TRUNCATED)
        if head[0] != 0xFF:
            raise Broken("OSError: marker expected in JPEG data")
        marker = head[1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker == 0xD9:
            if not scanned:
                raise Broken("OSError: JPEG without image data")
            return
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        else:
            size = int.from_bytes(head[2:4], "big")
            if len(head) < 4 or size < 2 or at + 2 + size > file.size:
                raise Broken(TRUNCATED)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                body = file.read(at + 4, 6)
                if size < 11 or not int.from_bytes(body[1:3], "big") or not int.from_bytes(body[3:5], "big") or not body[5]:
                    raise Broken("SyntaxError: broken JPEG frame header")
                framed = True
            at += 2 + size
            if marker == 0xDA:
                if not framed:
                    raise Broken("SyntaxError: JPEG scan before its frame header")
                start, at = at, _end_of_scan(file, at)
                scanned = scanned or at > start


def _end_of_scan(file: Reader, at: int) -> int:
    """Place of the next marker that is neither a stuffed byte nor a restart."""
    while at < file.size:
        data = np.frombuffer(file.read(at, CHUNK), "u1")
        if len(data) < 2:
            break
        hit = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0) & (data[1:] != 0xFF) & ((data[1:] < 0xD0) | (data[1:] > 0xD7)))
        if len(hit):
            return at + int(hit[0])
        at += len(data) - 1
    raise Broken(TRUNCATED)


def check_webp(file: Reader) -> None:
    """RIFF chunks that fill the stated length, one of them with image data."""
    end = int.from_bytes(file.read(4, 4), "little") + 8
    if end > file.size:
        raise Broken(TRUNCATED)
    kinds = {kind for kind, _, size in riff_chunks(file, 12, end) if size}
    if not kinds & {b"VP8 ", b"VP8L", b"ANMF"}:
        raise Broken("OSError: WEBP without image data")


def check_bmp(file: Reader) -> None:
    """The rows that the header promises, behind the header."""
    head = file.read(0, 54)
    if len(head) < 30 or file.size < int.from_bytes(head[2:6], "little"):
        raise Broken(TRUNCATED)
    start, info = struct.unpack("<II", head[10:18])
    if info < 40:
        width, height, bits, packed = *struct.unpack("<HH", head[18:22]), int.from_bytes(head[24:26], "little"), 0
    else:
        width, height = struct.unpack("<ii", head[18:26])
        bits, packed = struct.unpack("<HI", head[28:34])
    if width <= 0 or not height or not bits:
        raise Broken("OSError: broken BMP header")
    if packed in (0, 3) and start + (width * bits + 31) // 32 * 4 * abs(height) > file.size:
        raise Broken(TRUNCATED)


def probe_image(file: Reader) -> None:
    head = file.read(0, 12)
    if not head:
        raise Broken("UnidentifiedImageError: empty file")
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        check_png(file)
    elif head[:3] == b"\xff\xd8\xff":
        check_jpeg(file)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        check_webp(file)
    elif head[:2] == b"BM":
        check_bmp(file)
    else:
        raise Broken(UNKNOWN_IMAGE)


# ---------------------------------------------------------------- films


@dataclass
class Samples:
    """Frames of the first picture track: how many, and the place and size in the file of the one with a given number."""

    count: int
    place: Callable[[int], tuple[int, int]]
    within: Callable[[int, int], bool] = lambda at, size: True


def probe_numbers(count: int) -> list[int]:
    """First, middle and last, each once."""
    return sorted({0, (count - 1) // 2, count - 1}) if count > 0 else []


def boxes(file: Reader, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, start and end of each box's body; the last may be cut short by the end."""
    while at + 8 <= end:
        head = file.read(at, 16)
        if len(head) < 8:
            return
        size, kind, skip = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - at
        if size < skip:
            return
        yield kind, at + skip, min(at + size, end)
        at += size


def _find(file: Reader, at: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    for kind, a, b in boxes(file, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _find(file, a, b, *path[1:])


def _table(file: Reader, span: tuple[int, int] | None, skip: int, columns: int, width: int = 4) -> np.ndarray:
    """Big-endian numbers after the count that stands skip bytes into a box."""
    if span is None:
        return np.empty((0, columns), "int64")
    a, b = span
    rows = min(int.from_bytes(file.read(a + skip, 4), "big"), max(0, b - a - skip - 4) // (columns * width))
    return np.frombuffer(file.read(a + skip + 4, rows * columns * width), f">u{width}").astype("int64").reshape(rows, columns)


def mp4_samples(file: Reader) -> Samples:
    tops = list(boxes(file, 0, file.size))
    kinds = {k for k, _, _ in tops}
    if b"ftyp" not in kinds or b"moov" not in kinds:
        raise Broken(NOT_OPENED)
    moov = next((a, b) for k, a, b in tops if k == b"moov")
    data = [(a, b) for k, a, b in tops if k == b"mdat"]
    inside = lambda at, size: any(a <= at and at + size <= b for a, b in data)
    for trak in _find(file, *moov, b"trak"):
        handler = next(_find(file, *trak, b"mdia", b"hdlr"), None)
        if handler is not None and file.read(handler[0] + 8, 4) != b"vide":
            continue
        stbl = next(_find(file, *trak, b"mdia", b"minf", b"stbl"), None)
        if stbl is None:
            continue
        own = {k: (a, b) for k, a, b in boxes(file, *stbl)}
        if b"stsz" not in own:
            continue
        every, count = struct.unpack(">II", file.read(own[b"stsz"][0] + 4, 8).ljust(8, b"\0"))
        sizes = None if every else _table(file, own[b"stsz"], 8, 1)[:, 0]
        if count and sizes is not None and len(sizes) < count:
            raise Broken(NO_FRAMES)
        offsets = _table(file, own.get(b"co64"), 4, 1, 8)[:, 0] if b"co64" in own else _table(file, own.get(b"stco"), 4, 1)[:, 0]
        if count:
            return Samples(count, _chunked(count, every, sizes, offsets, _table(file, own.get(b"stsc"), 4, 3)), inside)
    return Samples(*_fragments(file, tops), inside)


def _chunked(count: int, every: int, sizes: np.ndarray | None, offsets: np.ndarray, runs: np.ndarray) -> Callable[[int], tuple[int, int]]:
    """Sample to chunk by the run-length table (first chunk, samples a chunk), then to a byte by the sizes before it in the chunk."""
    first_chunk, per = runs[:, 0] - 1, runs[:, 1]
    chunks = np.diff(np.r_[first_chunk, len(offsets)])
    first_sample = np.r_[0, np.cumsum(chunks * per)]

    def place(n: int) -> tuple[int, int]:
        run = int(np.searchsorted(first_sample, n, "right")) - 1
        if not 0 <= run < len(per) or per[run] <= 0:
            raise Broken(NOT_READ)
        chunk, nth = divmod(n - int(first_sample[run]), int(per[run]))
        at = int(offsets[int(first_chunk[run]) + chunk])
        if sizes is None:
            return at + nth * every, every
        return at + int(sizes[n - nth : n].sum()), int(sizes[n])

    return place


def _fragments(file: Reader, tops: list[tuple[bytes, int, int]]) -> tuple[int, Callable[[int], tuple[int, int]]]:
    """Samples of movie fragments: their runs of the first track, with sizes of their own or the fragment's."""
    runs, total = [], 0  # first sample, place, sizes or the size of all
    for kind, a, b in tops:
        if kind != b"moof":
            continue
        for start, end in _find(file, a, b, b"traf"):
            default = 0
            for head, _ in _find(file, start, end, b"tfhd"):
                flags = int.from_bytes(file.read(head + 1, 3), "big")
                skip = 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2) + 4 * bool(flags & 8)
                default = int.from_bytes(file.read(head + skip, 4), "big") if flags & 16 else 0
            for head, stop in _find(file, start, end, b"trun"):
                flags, n = int.from_bytes(file.read(head + 1, 3), "big"), int.from_bytes(file.read(head + 4, 4), "big")
                at = a - 8 + (int.from_bytes(file.read(head + 8, 4), "big") if flags & 1 else b - a + 16)
                fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                n = min(n, (stop - head) // max(1, 4 * len(fields))) if fields else n
                rows = np.frombuffer(file.read(head + 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4), 4 * n * len(fields)), ">u4").reshape(-1, max(1, len(fields)))
                sizes = rows[:, fields.index(0x200)].astype("int64") if 0x200 in fields else None
                runs.append((total, at, sizes, default))
                total += len(sizes) if sizes is not None else n
            break

    def place(n: int) -> tuple[int, int]:
        first, at, sizes, default = next(r for r in reversed(runs) if r[0] <= n)
        if sizes is None:
            return at + (n - first) * default, default
        return at + int(sizes[: n - first].sum()), int(sizes[n - first])

    return total, place


def riff_chunks(file: Reader, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, place and size of each chunk's body."""
    while at + 8 <= min(end, file.size):
        kind, size = struct.unpack("<4sI", file.read(at, 8))
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def avi_samples(file: Reader) -> Samples:
    """Picture chunks of the index, or of the data list where there is none; index places count from the list or from the file."""
    if file.read(8, 4) != b"AVI ":
        raise Broken(NOT_OPENED)
    header, data, index = None, None, None
    for kind, at, size in riff_chunks(file, 12, file.size):
        name = file.read(at, 4)
        if kind == b"LIST" and name == b"hdrl":
            header = next((a for k, a, _ in riff_chunks(file, at + 4, at + size) if k == b"avih"), None)
        elif kind == b"LIST" and name == b"movi":
            data = (at, min(at + size, file.size))
        elif kind == b"idx1":
            index = (at, min(size, file.size - at))
    if header is None or data is None:
        raise Broken(NOT_OPENED)
    if index is None:
        found = np.array([(a, s) for k, a, s in riff_chunks(file, data[0] + 4, data[1]) if k[2:] in (b"dc", b"db")], "int64").reshape(-1, 2)
    else:
        rows = np.frombuffer(file.read(index[0], index[1] // 16 * 16), "<u4").reshape(-1, 4).astype("int64")
        tags = rows[:, 0] >> 16
        rows = rows[(tags == int.from_bytes(b"dc", "little")) | (tags == int.from_bytes(b"db", "little"))]
        base = 0 if len(rows) and rows[0, 2] >= data[0] else data[0]
        found = np.stack([rows[:, 2] + base + 8, rows[:, 3]], 1)
    return Samples(len(found), lambda n: (int(found[n, 0]), int(found[n, 1])), lambda at, size: data[0] <= at and at + size <= data[1])


#: Fixed ids of the Matroska format.
EBML, SEGMENT, CLUSTER, TRACKS, TRACK, NUMBER, TYPE, BLOCK_GROUP, BLOCK, SIMPLE_BLOCK = (
    0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0xA0, 0xA1, 0xA3,
)


def _varint(data: bytes, keep_mark: bool) -> tuple[int | None, int]:
    """A number of variable length and its length; None where all its bits are 1 (unknown)."""
    if not data or not data[0]:
        raise Broken(NOT_OPENED)
    n = 9 - data[0].bit_length()
    value = int.from_bytes(data[:n], "big")
    if keep_mark:
        return value, n
    value -= 1 << (7 * n)
    return (None if value == (1 << (7 * n)) - 1 else value), n


def ebml_elements(file: Reader, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """id, start and end of each element's body; one of unknown size runs to the end."""
    while at + 2 <= end:
        head = file.read(at, 12)
        if len(head) < 2:
            return
        name, a = _varint(head, True)
        size, b = _varint(head[a:], False)
        start = at + a + b
        at = end if size is None else start + size
        yield name, start, at


def matroska_samples(file: Reader) -> Samples:
    track, found = None, []
    segment = next(((a, b) for i, a, b in ebml_elements(file, 0, file.size) if i == SEGMENT), None)
    if segment is None:
        raise Broken(NOT_OPENED)

    def blocks(a: int, b: int) -> None:
        for name, x, y in ebml_elements(file, a, b):
            if name == BLOCK_GROUP:
                blocks(x, y)
            elif name in (SIMPLE_BLOCK, BLOCK):
                number, n = _varint(file.read(x, 8), False)
                if track is None or number == track:
                    found.append((x + n + 3, y - x - n - 3))
            elif name == CLUSTER:  # after one of unknown size
                blocks(x, min(y, file.size))

    for name, a, b in ebml_elements(file, segment[0], min(segment[1], file.size)):
        if name == TRACKS:
            for _, x, y in (e for e in ebml_elements(file, a, b) if e[0] == TRACK):
                fields = {i: int.from_bytes(file.read(p, q - p), "big") for i, p, q in ebml_elements(file, x, y) if i in (NUMBER, TYPE)}
                if fields.get(TYPE) == 1 and track is None:
                    track = fields.get(NUMBER)
        elif name == CLUSTER:
            blocks(a, min(b, file.size))
    return Samples(len(found), lambda n: found[n])


def film_samples(file: Reader) -> Samples:
    head = file.read(0, 4)
    if head == b"RIFF":
        return avi_samples(file)
    return matroska_samples(file) if head == EBML.to_bytes(4, "big") else mp4_samples(file)


def film_probes(file: Reader) -> list[tuple[int, int, int, bool]]:
    """number, place, size and readable (not empty, inside the media data and the file) of the first, middle and last sample."""
    samples = film_samples(file)
    if samples.count <= 0:
        raise Broken(NO_FRAMES)
    out = []
    for n in probe_numbers(samples.count):
        try:
            at, size = samples.place(n)
        except (Broken, IndexError):
            at, size = -1, 0
        out.append((n, at, size, size > 0 and at >= 0 and at + size <= file.size and samples.within(at, size) and len(file.read(at, 1)) == 1))
    return out


def probe_video(file: Reader) -> None:
    if not any(ok for *_, ok in film_probes(file)):
        raise Broken(NOT_READ)
