"""Pictures followed to their ends and films to their samples, one fixture per failure."""

import struct
import zlib

import pytest

from reelgauge.functions import containers as C
from reelgauge.operators import media


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width=3, height=2, depth=8, colour=2, interlaced=0, raw=None, cut=0, extra=b""):
    sizes = [(-(-max(0, width - x) // dx), -(-max(0, height - y) // dy)) for x, y, dx, dy in C.ADAM7] if interlaced else [(width, height)]
    bits = depth * C.PNG_CHANNELS[colour]
    rows = b"".join((b"\0" + b"\7" * ((w * bits + 7) // 8)) * h for w, h in sizes if w and h) if raw is None else raw
    stream = zlib.compress(rows + extra)
    stream = stream[: len(stream) - cut]
    half = len(stream) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + chunk(b"IDAT", stream[:half]) + chunk(b"IDAT", stream[half:]) + chunk(b"IEND", b"")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


SOF = segment(0xC0, struct.pack(">BHHB", 8, 4, 4, 1) + b"\1\x11\0")
SOS = segment(0xDA, b"\1\1\0\0\x3f\0")


def jpeg(data=b"scan\xff\x00data\xff\xd0more", frame=SOF, scan=SOS, end=b"\xff\xd9"):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\xff\xd9" * 3) + frame + scan + data + end


def riff(form, *chunks):
    body = form + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(width=3, height=2, bits=24, rows=None):
    size = (width * bits + 31) // 32 * 4 * height
    return b"BM" + struct.pack("<IHHI", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, size, 0, 0, 0, 0) + b"\1" * (size if rows is None else rows)


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(sizes=(4, 5, 6, 7, 8), per=2, late=0, uniform=0, handler=b"vide", wide=False, brand=True, index=True, before=b""):
    head = (box(b"ftyp", b"isom") if brand else b"") + before
    chunks, at = [], len(head) + 8
    for i in range(0, len(sizes), per):
        chunks.append(at + late)
        at += sum(sizes[i : i + per])
    mdat = box(b"mdat", b"f" * sum(sizes))
    stsz = box(b"stsz", struct.pack(">III", 0, uniform, len(sizes)) + (b"" if uniform else b"".join(struct.pack(">I", s) for s in sizes)))
    full, rest = divmod(len(sizes), per)
    runs = [(1, per, 1)] * bool(full) + ([(full + 1, rest, 1)] if rest else [])
    stsc = box(b"stsc", struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs))
    stco = box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(chunks)) + b"".join(struct.pack(">Q" if wide else ">I", c) for c in chunks))
    hdlr = box(b"hdlr", b"\0" * 8 + handler + b"\0" * 12)
    trak = box(b"trak", box(b"mdia", hdlr + box(b"minf", box(b"stbl", stsz + stsc + stco))))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"soun" + b"\0" * 12) + box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 1, 99))))))
    return head + mdat + (box(b"moov", sound + trak) if index else b"")


def fragmented(sizes=(3, 4, 5), listed=True, offset=True):
    def moof(at_data):
        flags = (1 if offset else 0) | (0x200 if listed else 0)
        trun = box(b"trun", struct.pack(">II", flags, len(sizes)) + (struct.pack(">I", at_data) if offset else b"") + (b"".join(struct.pack(">I", s) for s in sizes) if listed else b""))
        return box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">III", 0 if listed else 16, 1, 4)[: 8 if listed else 12]) + trun))

    data = box(b"mdat", b"f" * (sum(sizes) if listed else 4 * len(sizes)))
    first = moof(0)
    return box(b"ftyp", b"isom") + box(b"moov", b"") + moof(len(first) + 8) + data


def avi(frames=3, index=True, absolute=False, total=True):
    movi = b"movi" + b"".join(b"00dc" + struct.pack("<I", 4) + b"data" + b"01wb" + struct.pack("<I", 2) + b"sd" for _ in range(frames))
    hdrl = b"hdrl" + b"avih" + struct.pack("<I", 56) + b"\0" * 56
    start = 12 + 8 + len(hdrl) + 8
    base = start if absolute else 0
    idx = b"".join(b"00dc" + struct.pack("<III", 16, base + 4 + 22 * i, 4) + b"01wb" + struct.pack("<III", 0, base + 16 + 22 * i, 2) for i in range(frames))
    chunks = [(b"LIST", hdrl)] * total + [(b"LIST", movi)] + ([(b"idx1", idx)] if index else [])
    return riff(b"AVI ", *chunks)


def element(name, body, unknown=False):
    size = b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else struct.pack(">Q", len(body) | 1 << 56)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size + body


def matroska(frames=4, unknown=False, payload=b"frame", track=1):
    tracks = element(C.TRACKS, element(C.TRACK, element(C.NUMBER, b"\2") + element(C.TYPE, b"\2")) + element(C.TRACK, element(C.NUMBER, b"\1") + element(C.TYPE, b"\1")))
    blocks = [element(C.SIMPLE_BLOCK, bytes([0x80 | track]) + b"\0\0\0" + payload) if i % 2 else element(C.BLOCK_GROUP, element(C.BLOCK, bytes([0x80 | track]) + b"\0\0\0" + payload)) for i in range(frames)]
    clusters = b"".join(element(C.CLUSTER, b + element(C.SIMPLE_BLOCK, b"\x82\0\0\0sound"), unknown) for b in blocks)
    return element(C.EBML, b"\x42\x82\x84webm") + element(C.SEGMENT, tracks + clusters, unknown)


SOUND = {
    "png": png(), "png grey": png(9, 5, 1, 0), "png interlaced": png(5, 5, 8, 6, 1), "png of a pixel, interlaced": png(1, 1, 8, 0, 1), "png of many MB": png(3000, 1500),
    "jpeg": jpeg(), "jpeg of two scans": jpeg(b"one" + SOS + b"two"), "jpeg fill bytes": jpeg(frame=b"\xff" + SOF),
    "webp": riff(b"WEBP", (b"VP8X", b"0" * 10), (b"VP8 ", b"abc")), "bmp": bmp(), "bmp upside down": bmp(height=2).replace(struct.pack("<ii", 3, 2), struct.pack("<ii", 3, -2)),
}


@pytest.mark.parametrize("name", SOUND)
def test_sound_pictures(name):
    assert media.image_error(SOUND[name]) is None


BROKEN = {
    "png stream cut, checksums sound": (png(cut=6), "OSError: image file is truncated"), "png of too few rows": (png(raw=b"\0" * 9), "OSError: image file is truncated"),
    "png of too many rows": (png(extra=b"\0" * 30), "OSError: more image data"), "png of a false checksum": (png()[:-1] + b"!", "SyntaxError: broken PNG chunk"),
    "png noise, checksums sound": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"noise") + chunk(b"IEND", b""), "OSError: broken data stream"),
    "png without header": (b"\x89PNG\r\n\x1a\n" + chunk(b"IEND", b""), "SyntaxError: PNG without a header"), "png of no width": (png(width=0), "SyntaxError: broken PNG header"), "png cut": (png()[:-9], "OSError: image file is truncated"),
    "jpeg cut": (jpeg()[:-2], "OSError: image file is truncated"), "jpeg cut, end marker in its thumbnail": (jpeg()[:40], "OSError: image file is truncated"), "jpeg without scan": (jpeg(b"", scan=b""), "OSError: JPEG without image data"),
    "jpeg without frame": (jpeg(frame=b""), "SyntaxError: JPEG scan before"), "jpeg of no height": (jpeg(frame=segment(0xC0, struct.pack(">BHHB", 8, 0, 4, 1) + b"\1\x11\0")), "SyntaxError: broken JPEG frame"), "jpeg junk": (b"\xff\xd8\xff" + b"1" * 20 + b"\xff\xd9", "OSError"),
    "jpeg segment past the end": (b"\xff\xd8" + b"\xff\xe0\xff\xf0abc", "OSError: image file is truncated"), "webp without data": (riff(b"WEBP", (b"EXIF", b"abcd")), "OSError: WEBP without image data"), "webp cut": (SOUND["webp"][:-3], "OSError: image file is truncated"),
    "bmp of too few rows": (bmp(rows=5), "OSError: image file is truncated"), "bmp cut": (bmp()[:20], "OSError: image file is truncated"), "empty": (b"", "UnidentifiedImageError: empty file"), "text": (b"text", "UnidentifiedImageError"),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pictures(name):
    data, error = BROKEN[name]
    assert (media.image_error(data) or "").startswith(error)


FILMS = {
    "mp4": (mp4(), 5), "mp4 of one frame": (mp4((9,)), 1), "mp4 of two": (mp4((9, 9)), 2), "mp4 of equal frames": (mp4((4,) * 7, 3, uniform=4), 7), "mp4 with wide places": (mp4(wide=True), 5), "mp4 with a wide box": (mp4(before=struct.pack(">I4sQ", 1, b"free", 24) + b"0" * 8), 5),
    "fragments": (fragmented(), 3), "fragments of equal samples": (fragmented(listed=False), 3), "fragments without offset": (fragmented(offset=False), 3), "avi": (avi(), 3), "avi without index": (avi(index=False), 3), "avi with places in the file": (avi(absolute=True), 3),
    "matroska": (matroska(), 4), "live matroska": (matroska(unknown=True), 4),
}


@pytest.mark.parametrize("name", FILMS)
def test_sound_films(name):
    data, frames = FILMS[name]
    probes = C.film_probes(C.Reader.of(data))
    assert [p[0] for p in probes] == C.probe_numbers(frames) and all(p[3] for p in probes) and media.video_error(data) is None
    for _, at, size, _ in probes:
        assert data[at : at + size] in (b"f" * size, b"data", b"frame")


def test_samples_lie_where_the_tables_say():
    data = mp4((4, 5, 6, 7, 8), 2)
    start = data.index(b"mdat") + 4
    assert [C.film_samples(C.Reader.of(data)).place(i) for i in range(5)] == [(start, 4), (start + 4, 5), (start + 9, 6), (start + 15, 7), (start + 22, 8)]


BAD_FILMS = {
    "no brand": (mp4(brand=False), C.NOT_OPENED), "no index": (mp4(index=False), C.NOT_OPENED), "empty": (b"", C.NOT_OPENED), "text": (b"some text that is no film", C.NOT_OPENED), "avi without header": (avi(total=False), C.NOT_OPENED), "wave": (riff(b"WAVE", (b"data", b"0" * 99)), C.NOT_OPENED),
    "no samples": (mp4(()), C.NO_FRAMES), "sound only": (mp4(handler=b"soun", sizes=()), C.NO_FRAMES), "avi of no frames": (avi(0), C.NO_FRAMES), "matroska of no frames": (matroska(0), C.NO_FRAMES), "matroska of another track": (matroska(track=3), C.NO_FRAMES), "size table cut": (mp4().replace(struct.pack(">III", 0, 0, 5), struct.pack(">III", 0, 0, 500)), C.NO_FRAMES),
    "samples outside the data": (mp4(late=1000), C.NOT_READ), "empty samples": (mp4((0, 0, 0)), C.NOT_READ), "empty matroska blocks": (matroska(payload=b""), C.NOT_READ), "matroska header only": (element(C.EBML, b"\x42\x82\x84webm" + b"0" * 90), C.NOT_OPENED),
}


@pytest.mark.parametrize("name", BAD_FILMS)
def test_bad_films(name):
    data, error = BAD_FILMS[name]
    assert media.video_error(data) == error


def test_one_readable_probe_is_enough():
    data = mp4((4, 5, 6), 1)
    cut = data.replace(struct.pack(">II", 0, 3) + struct.pack(">I", data.index(b"mdat") + 4), struct.pack(">II", 0, 3) + struct.pack(">I", 5000))
    probes = C.film_probes(C.Reader.of(cut))
    assert [p[3] for p in probes] == [False, True, True] and media.video_error(cut) is None


def test_random_damage_never_breaks_a_task():
    import random

    rng = random.Random(3)
    for data in [d for d, _ in FILMS.values()] + [d for n, d in SOUND.items() if "MB" not in n]:
        for _ in range(60):
            harmed = bytearray(data)
            for _ in range(rng.randint(1, 6)):
                harmed[rng.randrange(len(harmed))] = rng.randrange(256)
            for error in (media.image_error(bytes(harmed)), media.video_error(bytes(harmed))):
                assert error is None or ":" in error


def slow(file):
    import time

    while file.read(0, 1):
        time.sleep(0.01)


def test_probers_of_ones_own_ranges_and_time_limit(spark, tmp_path):
    files = {"a.png": png(), "b.png": png()[:-3], "c.mp4": mp4(), "d.mp4": mp4(late=999), "e.wav": b"RIFF"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    kinds = {"png": "image", "mp4": "video", "wav": "sound"}
    rows = [(f"file://{tmp_path}/{n}", 1, kinds[n[2:]]) for n in files] + [(f"file://{tmp_path}/none.png", 0, "image")]
    df = spark.createDataFrame(rows, "path string, label int, dtype string")

    def starts_with_riff(file):
        if file.read(0, 4) != b"RIFF":
            raise C.Broken("no sound")

    got = {r.path.rpartition("/")[2]: r.error for r in media.validate_paths(df, media.PROBERS | {"sound": starts_with_riff}).collect()}
    assert (got["a.png"], got["c.mp4"], got["e.wav"]) == (None, None, None)
    assert got["b.png"] == C.TRUNCATED and got["d.mp4"] == C.NOT_READ and got["none.png"].startswith("FileNotFoundError")
    assert media.validate_paths(df.filter("dtype = 'sound'")).first().error == "ValueError: Unsupported dtype: sound"
    late = media.validate_paths(df.filter("dtype = 'sound'"), {"sound": slow}, seconds=0.1).first()
    assert late.error.startswith("TimeoutError")
    read = []
    reader = C.Reader.of(mp4((100_000,) * 20))
    fetch = reader.fetch
    reader.fetch = lambda at, n: read.append(n) or fetch(at, n)
    C.probe_video(reader)
    assert sum(read) < 2000  # of two million bytes


def test_second_opinion_of_the_image_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png())
    (tmp_path / "in" / "b.png").write_bytes(png()[:30])
    (tmp_path / "c.mp4").write_bytes(mp4())
    df = spark.createDataFrame([(f"file://{tmp_path}/in/a.png", 1, "image"), (f"file://{tmp_path}/in/b.png", 0, "image"), (f"file://{tmp_path}/c.mp4", 0, "video")], "path string, label int, dtype string")
    got = media.with_second_opinion(spark, media.validate_paths(df), f"file://{tmp_path}/in").collect()
    assert {r.path.rpartition("/")[2]: (r.ok, r.decoded) for r in got} == {"a.png": (True, True), "b.png": (False, False), "c.mp4": (True, None)}
