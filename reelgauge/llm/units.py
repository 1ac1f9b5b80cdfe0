"""Texts cut into recurring units, so that work on a unit is done once for each distinct one of a slice.

A column of texts is taken as its Arrow buffers. Where a unit begins is a mask over the bytes; the
units are laid over the same bytes without a copy, dictionary-encoded by Arrow, and what belongs to
each distinct unit is gathered back by its code. Slices of about SLICE_BYTES keep the memory bounded,
whatever the rows of a batch; one text is never cut in two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_500_000

BLANK, MARK, LETTER, CAPITAL, LEAD, SMALL_TAIL, CAPITAL_TAIL, PLAIN_NEXT = (1 << i for i in range(8))


def _byte_classes() -> np.ndarray:
    """Flags of each byte. Tails are second bytes of the Latin-1 letters U+00C0 to U+00FF, whose first is LEAD."""
    flags = np.zeros(256, "u1")
    flags[[0x20, *range(0x09, 0x0E)]] |= BLANK
    flags[list(b".,;:!?")] |= MARK
    flags[list(range(ord("a"), ord("z") + 1))] |= LETTER
    flags[list(range(ord("A"), ord("Z") + 1))] |= LETTER | CAPITAL
    flags[0xC3] |= LEAD | PLAIN_NEXT
    flags[[b for b in range(0x9F, 0xC0) if b != 0xB7]] |= SMALL_TAIL
    flags[[b for b in range(0x80, 0x9F) if b != 0x97]] |= CAPITAL_TAIL
    flags[:0x80] |= PLAIN_NEXT
    return flags


CLASSES = _byte_classes()


class Texts(NamedTuple):
    data: np.ndarray  # bytes of the texts, one after another
    offsets: np.ndarray  # where each starts, and the end


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in order, nulls as empty ones."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, "<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype("int64")
    data = np.frombuffer(column.buffers()[2] or b"", "u1")
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def _shifted(flags: np.ndarray) -> np.ndarray:
    """The flags of the byte before; none before the first."""
    out = np.zeros_like(flags)
    out[1:] = flags[:-1]
    return out


def closing_marks(flags: np.ndarray) -> np.ndarray:
    """A mark of .,;:!? that follows a letter of ASCII or Latin-1."""
    before = _shifted(flags)
    letter = ((before & LETTER) != 0) | (((before & (SMALL_TAIL | CAPITAL_TAIL)) != 0) & ((_shifted(before) & LEAD) != 0))
    return ((flags & MARK) != 0) & letter


def small_letters(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The bytes with capitals of ASCII and Latin-1 made small, but for those that the next character may be composed with."""
    follows = np.ones(len(flags), bool)
    follows[:-1] = (flags[1:] & PLAIN_NEXT) != 0
    capital = ((flags & CAPITAL) != 0) | (((flags & CAPITAL_TAIL) != 0) & ((_shifted(flags) & LEAD) != 0))
    return data + (capital & follows).astype("u1") * np.uint8(32)


class Units(NamedTuple):
    distinct: list[bytes]
    codes: np.ndarray  # index into distinct of each unit, in order
    first: np.ndarray  # where each text's units start in codes, and the end


def cut_units(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> Units:
    """Units that start where ``begins`` is set and at every text's start."""
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    places = np.r_[at, len(data)].astype("<i8")
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return Units(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(at, offsets))


def word_units(texts: Texts, specials: list[bytes] = ()) -> Units:
    """For vocabularies that drop white space, fold case and part letters from marks: a word or its closing marks, without what blanks lie before it.

    Case is folded here where that changes nothing else; not in a slice in which a special string may begin.
    """
    data, offsets = texts
    flags = CLASSES[data]
    blank = (flags & BLANK) != 0
    begins = blank & ~_shifted(blank)
    begins |= closing_marks(flags)
    if specials:
        folded = data.tobytes().lower()
        whole = not any(s[:2].lower() in folded for s in specials)
    else:
        whole = True
    units = cut_units(small_letters(data, flags) if whole else data, offsets, begins)
    return units._replace(distinct=[u.lstrip() for u in units.distinct])


def gathered(values: list[bytes], dtype: str, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all units one after another, values[i] being those of distinct unit i; and where each text's start, with the end."""
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(b"".join(values), dtype)
    sizes = np.fromiter(map(len, values), "int64", len(values)) // width
    starts = np.cumsum(sizes) - sizes
    n = sizes[units.codes]
    ends = np.cumsum(n)
    place = np.repeat(starts[units.codes] - (ends - n), n)
    place += np.arange(len(place))
    return flat[place], np.r_[0, ends][units.first]


class UnitCache:
    """unit -> value for the units of one slice after another, in two generations of at most ``limit`` entries beyond a slice's.

    ``make`` computes the values of all units that neither generation holds, in one call.
    """

    def __init__(self, make: Callable[[list[bytes]], list], limit: int):
        self.make, self.limit = make, limit
        self.new: dict = {}
        self.old: dict = {}

    def values(self, units: list[bytes]) -> list:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        todo = []
        for u in set(units).difference(new):
            kept = old.get(u)
            if kept is None:
                todo.append(u)
            else:
                new[u] = kept
        if todo:
            new.update(zip(todo, self.make(todo)))
        return [new[u] for u in units]

    def clear(self) -> None:
        """At the end of a task: a worker process lives on in other stages."""
        self.new, self.old = {}, {}
