"""What a media path tells: kind, label, identity, dataset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats and the folder names that carry a label.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv")
REAL_SEGMENTS = ("real", "youtube-real", "celeb-real")
FAKE_SEGMENTS = ("fake", "celeb-fake", "ai")


def forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    return F.split(forward(path), "/")


def file_name(path: Column) -> Column:
    return F.substring_index(forward(path), "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(forward(path), "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def label_by_segment(path: Column) -> Column:
    """1 if a whole segment means real, else 0 if one means fake, else null."""
    parts = F.transform(segments(path), F.lower)
    return F.when(F.arrays_overlap(parts, _strings(REAL_SEGMENTS)), 1).when(F.arrays_overlap(parts, _strings(FAKE_SEGMENTS)), 0)


def label_by_substring(path: Column) -> Column:
    """0 if the path contains fake or /ai/, else 1 if it contains real, else null: the other priority."""
    low = F.lower(forward(path))
    return F.when(low.contains("fake") | low.contains("/ai/"), 0).when(low.contains("real"), 1)


def identity(path: Column) -> Column:
    """Person or clip key from the file name, else the path itself."""
    name = F.lower(file_name(path))
    head = F.substring_index(name, "_", 1)
    return F.when(name.startswith("id"), head).when(name.contains("_") & F.substring(name, 1, 3).rlike("^[0-9]{3}$"), head).otherwise(path)


def dataset(path: Column) -> Column:
    """Segment after images, else after videos, else unknown."""
    parts = segments(path)

    def after(word: str) -> Column:
        at = F.array_position(parts, word)
        return F.when(at > 0, F.get(parts, at.cast("int")))

    return F.coalesce(after("images"), after("videos"), F.lit("unknown"))


def below(path: Column, folder: str) -> Column:
    """Path relative to the first segment ``folder``."""
    return F.regexp_replace(forward(path), f"^(.*/)?{folder}/", "")
