"""Token counts by heap-and-linked-list byte-pair merging; no ids of texts are made.

``MergeCounter`` reads the merge ranks of a byte-level BPE file. A word is a linked list of symbols
and a heap of its adjacent pairs by (rank, position), merged as in ``merges``. The count is the initial
symbols minus the merges.

White space never reaches a token of these vocabularies, case is folded and letters are parted from
punctuation (probed when the file is read; another vocabulary is refused). So the texts of an Arrow
batch are cut into words and closing marks (``units``), each distinct one of a slice is
counted once, with a bounded cache over slices, and the counts are gathered and summed
by document. Special strings inside a text count as one token each, as the library's default has it.

Null and empty texts have 0 tokens; a null doc_id, repeated rows and extra columns make no difference: one
row out for each row in, none for an empty table. A text of any length is counted whole; it takes about
ten times its bytes in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import PairMerger
from .units import Texts, UnitCache, text_slices, word_units

LIMIT = 2048
CACHE = 240_000
#: A word of small letters, or marks: one pre-tokenized word, which the normalizer leaves as it is.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[.,;:!?]+").fullmatch


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def word_tokenizer(path: str):
    """The library's tokenizer and its special strings; refuses a vocabulary whose texts don't fall into word units."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    specials = [t["content"] for t in added]
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens must match raw text plainly")
    if any(re.search(r"\s|[A-Za-zÀ-ÿ][.,;:!?]", t) for t in specials):
        raise ValueError("an added token would cross units")
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    probes = [("\t a \n", "a"), ("a b\r\nc", "a", "b", "c"), ("word.,;:!?", "word", ".,;:!?"), ("é, ß!?x", "é", ",", "ß", "!?x"), ("AZÀÖØÞ", "azàöøþ"), ("Don't. stop", "don't", ".", "stop")]
    if any(ids(whole) != [i for p in parts for i in ids(p)] for whole, *parts in probes):
        raise ValueError("the vocabulary keeps white space or case, or joins letters and marks")
    return lib, specials


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE file is needed")
        lib, specials = word_tokenizer(path)
        self.normalizer, self.pre_tokenizer = lib.normalizer, lib.pre_tokenizer
        vocab, suffix, shown = model["vocab"], model.get("end_of_word_suffix") or "", byte_symbols()
        if any(s + e not in vocab for s in shown.values() for e in ("", suffix)):
            raise ValueError("a byte has no symbol")
        self.number = np.array([[vocab[shown[b] + e] for b in range(256)] for e in ("", suffix)], "int64")
        self.bytes = {s: b for b, s in shown.items()}
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        ranked = ((vocab[a], vocab[b], i) for i, (a, b) in enumerate(pairs))
        self.merger = PairMerger(max(vocab.values()) + 1, ranked, list(range(len(pairs))), [vocab[a + b] for a, b in pairs])
        self.merger.initial(self.number.ravel().tolist())
        self.specials = [s.encode() for s in specials]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.counts = UnitCache(self.unit_tokens, CACHE)

    def merged_lengths(self, words: list[bytes]) -> list[int]:
        """Symbols that are left of each pre-tokenized word, none of them empty, when nothing more merges."""
        raw = np.frombuffer(b"".join(words), "u1")
        sizes = np.fromiter(map(len, words), "int64", len(words))
        symbols = self.number[0][raw]
        final = np.cumsum(sizes) - 1
        symbols[final] = self.number[1][raw[final]]
        return [n - merges for n, (merges, _) in zip(sizes.tolist(), self.merger.merge(symbols, sizes))]

    def words(self, text: str) -> list[bytes]:
        words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text)) if text else []
        return [bytes(map(self.bytes.__getitem__, w)) for w, _ in words if w]

    def unit_tokens(self, units: list[bytes]) -> list[int]:
        """Tokens of each unit: of its words, which are the unit itself if it is plain, and of its special strings."""
        counts, words, owners = np.zeros(len(units), "int64"), [], []
        for i, unit in enumerate(units):
            if PLAIN(unit):
                words.append(unit)
                owners.append(i)
                continue
            text = unit.decode()
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                counts[i] = len(parts) - 1
            own = [w for p in parts for w in self.words(p)]
            words += own
            owners += [i] * len(own)
        np.add.at(counts, owners, self.merged_lengths(words))
        return counts.tolist()

    def count(self, texts: Texts) -> np.ndarray:
        """Tokens of each text."""
        units = word_units(texts, self.specials)
        each = np.array(self.counts.values(units.distinct), "int64")
        before = np.r_[0, np.cumsum(each[units.codes])]
        return np.diff(before[units.first])


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; path: a vocabulary file present on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            counts = [c.count(t) for t in text_slices(batch.column("text"))]
            counts = np.concatenate(counts) if counts else np.empty(0, "int64")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        c.counts.clear()

    body = docs[text]
    given = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), body.alias("text"))
    counted = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
