"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

``PieceEncoder`` keeps an agenda of adjacent symbol pairs ordered by piece score, leftmost first
among equals; the best pair merges, its new neighbours enter, stale entries are skipped (``merges``). Symbols
outside the vocabulary become byte pieces. A normalized text is cut where no piece of the vocabulary can span: in
front of a run of word marks, around line breaks and tabs that occur in no longer piece, and between a letter and
closing marks if no piece holds both. Each distinct unit of a slice of an Arrow batch is encoded once, with a
bounded cache over slices. All units that are computed for a slice are also put together into one text, kept apart by
line breaks where they would touch otherwise, and encoded by the sentencepiece library; a difference stops the
job. Decoding is the library's.

Null and empty texts: no pieces between the begin and end ids, decoded as the empty text. A null
doc_id, repeated rows and extra columns make no difference: one row out for each row in, none for an empty table. A
text of any length is encoded whole, at about twenty times its bytes in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .merges import PairMerger
from .units import CLASSES, Texts, UnitCache, closing_marks, cut_units, gathered, text_slices

MARK = "▁"
CACHE = 240_000
LETTERS = {chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)}


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces need resegmentation, which is not built")
        plain = {pieces[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece spans words; texts can't be cut at word marks")
        joined = {c for p in plain if len(p) > 1 for c in p}
        if "\n" in joined:
            raise ValueError("a line break merges; checked units can't be kept apart")
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in "\n\t\r" if c not in joined]] = True
        self.marks_apart = not any(a in LETTERS and b in ".,;:!?" for p in plain for a, b in zip(p, p[1:]))
        # Symbols: ids of pieces, then characters that only longer pieces hold, then all others under one number without pairs.
        number = plain | {c: n + i for i, c in enumerate(sorted(joined - plain.keys()))}
        self.other = n + len(joined - plain.keys())
        scores = {s: i for i, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        order = [scores.get(sp.get_score(i), 0) for i in range(n)]
        pairs = ((number[a], number[b], i) for p, i in plain.items() for cut in range(1, len(p)) if (a := p[:cut]) in number and (b := p[cut:]) in number)
        self.merger = PairMerger(self.other + 1, pairs, order, list(range(n)))
        single = {c: i for c, i in number.items() if len(c) == 1}
        self.merger.initial(single.values())
        self.codes = np.array(sorted(map(ord, single)), "int64")
        self.code_number = np.array([single[chr(c)] for c in self.codes], "int64")
        bytes_of = {int(pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = (lambda c: [bytes_of[b] for b in c.encode()]) if bytes_of else (lambda c: [sp.unk_id()])
        self.n, self.head, self.gap = n, sp.encode("\n"), sp.encode("a\n")[len(sp.encode("a")) :]
        self.cache = UnitCache(self.unit_ids, CACHE)

    def agenda(self, units: list[str]) -> list[list[int]]:
        sizes = np.fromiter(map(len, units), "int64", len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype("int64")
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        symbols = np.where(self.codes[at] == codes, self.code_number[at], self.other)
        out, n = [], self.n
        for unit, (merges, own) in zip(units, self.merger.merge(symbols, sizes)):
            ids = [s for s in own if s >= 0] if merges else own
            if max(ids) >= n:  # a symbol without a piece is a character that has not merged, at its own place
                ids = [i for c, s in zip(unit, own) if s >= 0 for i in (self.unknown(c) if s >= n else (s,))]
            out.append(ids)
        return out

    def check(self, units: list[str], found: list[list[int]]) -> None:
        """The library must give the same ids for all units in one text; it puts a word mark in front of that."""
        text, mine = ["\n"], [*self.head]
        for u, ids in zip(units, found):
            if u[0] != MARK:
                text.append("\n")
                mine += self.gap
            text.append(u)
            mine += ids
            if u[-1] == MARK:
                text.append("\n")
                mine += self.gap
        if self.lib.encode("".join(text).replace(MARK, " ")) == mine:
            return
        for u, ids in zip(units, found):
            lib = self.lib.encode("\n" + u.replace(MARK, " "))[len(self.head) :]
            if lib != ids:
                raise AssertionError(f"unit {u!r}: {ids} is not the library's {lib}")
        raise AssertionError("units put together are not the library's encoding of their text")

    def unit_ids(self, units: list[bytes]) -> list[bytes]:
        texts = [u.decode() for u in units]
        found = self.agenda(texts)
        self.check(texts, found)
        sizes = np.fromiter(map(len, found), "int64", len(found))
        flat = np.fromiter((i for ids in found for i in ids), "<u4", int(sizes.sum())).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        raw = texts.data.tobytes()
        normal = [t.encode() for t in self.lib.normalize([raw[a:b].decode() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])])]
        data = np.frombuffer(b"".join(normal), "u1")
        offsets = np.r_[0, np.cumsum([len(t) for t in normal], dtype="int64")]
        begins = np.zeros(len(data), bool)
        mark = np.flatnonzero(data == 0xE2)
        mark = mark[mark + 2 < len(data)]
        mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
        if len(mark):
            begins[mark[np.r_[True, np.diff(mark) != 3]]] = True
        alone = self.alone[data]
        begins |= alone
        begins[1:] |= alone[:-1]
        if self.marks_apart:
            begins |= closing_marks(CLASSES[data])
        units = cut_units(data, offsets, begins)
        ids, bounds = gathered(self.cache.values(units.distinct), "<u4", units)
        begin, end = np.array([self.bos], "<u4"), np.array([self.eos], "<u4")
        return [np.concatenate([begin, ids[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:])]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encoded(docs: DataFrame, path: str, text: str, doc_id: str, columns: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """doc_id and what ``row`` makes of a text's ids and their decoded text, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                ids = e.encode(texts)
                rows = [row(i, e.lib.decode(i.tolist())) for i in ids]
                made = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), columns.values())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), *made], ["doc_id", *columns])
                at += len(ids)
        e.cache.clear()

    given = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return given.mapInArrow(run, ", ".join([f"doc_id {given.schema['doc_id'].dataType.simpleString()}", *(f"{c} {kind}" for c, (kind, _) in columns.items())]))


def encode_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int> with begin and end ids, decoded string (the library's decode of the ids)."""
    columns = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    return _encoded(docs, path, text, doc_id, columns, lambda ids, decoded: (ids.astype("int32"), decoded))


def piece_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_pieces``, hashed where they are made."""
    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _encoded(docs, path, text, doc_id, columns, lambda ids, decoded: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
