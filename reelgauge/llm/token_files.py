"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory map.

The documents are range-partitioned and sorted by doc_id (null first, ties by text). Each task encodes its partition and writes
  part-NNNNN-<unique>.ids      the ids of its documents, one after another, little-endian uint16 or uint32
  part-NNNNN-<unique>.offsets  n_docs + 1 int64: where each document starts, counted in ids
  part-NNNNN-<unique>.docs     n_docs int64: the doc_ids (0 for null; nulls come first, the manifest counts them)
and hands back one manifest row. A lost task writes anew under another name, so the manifest, written once, only
lists complete files. Prefix sums over it give each partition's base, and with
it every document's place in the whole corpus. The folder must be one that all executors share and
that pyarrow can open (file, hdfs, s3, gs).

Null and empty texts are one end id. Repeated rows are written each; extra columns are ignored. A text of any
length is encoded whole, at about ten times its bytes in memory. No rows: no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, shuffle_partitions
from .token_counts import PLAIN, byte_symbols, word_tokenizer
from .units import Texts, UnitCache, gathered, text_slices, word_units

MANIFEST = "part int, file string, n_docs long, n_null long, n_tokens long"
CACHE = 240_000


class LibraryEncoder:
    """ids of texts by the tokenizers library.

    by_word: for vocabularies that drop white space, fold case and part letters from punctuation (others are refused). There a
    text's ids are those of its words and marks put together, so each distinct one of a slice goes through the
    library once and is kept in a bounded cache.
    """

    def __init__(self, path: str, dtype: str, end_id: int | None, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.dtype, self.end_id, self.by_word, self.specials = dtype, end_id, by_word, []
        if by_word:
            self.lib, specials = word_tokenizer(path)
            self.specials = [s.encode() for s in specials]
        else:
            self.lib = Tokenizer.from_file(path)
        self.symbols = {b: "".join(shown[x] for x in chr(b).encode()) for shown in [byte_symbols()] for b in range(256)}
        self.cache = UnitCache(self.unit_ids, CACHE)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def unit_ids(self, units: list[bytes]) -> list[bytes]:
        """A plain unit is one pre-tokenized word, which the library's model takes as it is."""
        tokenize, dtype, symbols = self.lib.model.tokenize, self.dtype, self.symbols
        found: dict[bytes, bytes] = {}
        other = []
        for u in units:
            if PLAIN(u):
                shown = u.decode() if u.isascii() else u.decode().translate(symbols)
                found[u] = np.array([t.id for t in tokenize(shown)], dtype).tobytes()
            else:
                other.append(u)
        found.update(zip(other, self.whole([u.decode() for u in other])))
        return list(map(found.__getitem__, units))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text's end."""
        n = len(texts.offsets) - 1
        if self.by_word:
            units = word_units(texts, self.specials)
            ids, bounds = gathered(self.cache.values(units.distinct), self.dtype, units)
        else:
            raw = texts.data.tobytes()
            each = self.whole([raw[a:b].decode() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])])
            ids, bounds = np.frombuffer(b"".join(each), self.dtype), np.r_[0, np.cumsum([len(e) for e in each], dtype="int64") // np.dtype(self.dtype).itemsize]
        if self.end_id is None:
            return ids, bounds[1:]
        return np.insert(ids, bounds[1:], self.end_id), bounds[1:] + np.arange(1, n + 1)


_ENCODERS: dict[tuple, LibraryEncoder] = {}


def _encoder(*key) -> LibraryEncoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(*key)
    return _ENCODERS[key]


def _open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, path: str, folder: str, end_id: int | None, dtype: str = "<u4", by_word: bool = False, parts: int | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Encode and write (an action); returns the manifest: MANIFEST with first_doc and first_token, the bases."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, dtype, end_id, by_word)
        store = None
        starts, ids, n_null, total = [np.zeros(1, "<i8")], [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            if store is None:
                filesystem, root = _open_folder(folder)
                filesystem.create_dir(root, recursive=True)
                name = f"{root}/part-{part:05d}-{uuid.uuid4().hex}"
                store = filesystem.open_output_stream(f"{name}.ids")
            n_null += batch.column("doc_id").null_count
            ids.append(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8"))
            for texts in text_slices(batch.column("text")):
                found, ends = e.encode(texts)
                starts.append(total + ends.astype("<i8"))
                total += len(found)
                store.write(found.tobytes())
        e.cache.clear()
        if store is not None:
            store.close()
            for kind, arrays in (("offsets", starts), ("docs", ids)):
                with filesystem.open_output_stream(f"{name}.{kind}") as f:
                    f.write(np.concatenate(arrays).tobytes())
            n_docs = sum(map(len, ids))
            row = {"part": part, "file": name.rpartition("/")[2], "n_docs": n_docs, "n_null": n_null, "n_tokens": total}
            yield pa.RecordBatch.from_pylist([row], pa.schema({"part": pa.int32(), "file": pa.string(), "n_docs": pa.int64(), "n_null": pa.int64(), "n_tokens": pa.int64()}))

    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    ordered = given.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return manifest.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"),
    )


class Numbers:
    """A flat file of numbers, of which ranges are taken: mapped if it lies on a mounted folder, else read range by range."""

    def __init__(self, filesystem, path: str, dtype: str):
        from pyarrow import fs

        self.dtype, self.file, self.mapped = np.dtype(dtype), None, None
        if isinstance(filesystem, fs.LocalFileSystem):
            self.mapped = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        else:
            self.file = filesystem.open_input_file(path)

    def __len__(self) -> int:
        return len(self.mapped) if self.file is None else self.file.size() // self.dtype.itemsize

    def take(self, a: int, b: int) -> np.ndarray:
        if self.file is None:
            return self.mapped[a:b]
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)


READ_TOKENS = 4_000_000
READ_DOCS = 4096


def _runs(ends: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Documents (from, to) of at most READ_TOKENS ids together, one at least; ends: where each ends."""
    a = 0
    while a < len(ends):
        first = start if a == 0 else int(ends[a - 1])
        b = max(a + 1, int(np.searchsorted(ends, first + READ_TOKENS, "right")))
        yield a, b
        a = b


def read_token_files(manifest: DataFrame, folder: str, dtype: str = "<u4", with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian uint32), and ids if asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _open_folder(folder)
        for batch in batches:
            for row in batch.itertuples():
                ids, offsets, docs = (Numbers(filesystem, f"{root}/{row.file}.{kind}", t) for kind, t in (("ids", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for at in range(0, len(docs), READ_DOCS):
                    own, places = docs.take(at, min(at + READ_DOCS, len(docs))), offsets.take(at, min(at + READ_DOCS, len(docs)) + 1)
                    for a, b in _runs(places[1:], int(places[0])):
                        held = ids.take(int(places[a]), int(places[b]))
                        spans = [held[x:y].astype("<u4") for x, y in zip(places[a:b] - places[a], places[a + 1 : b + 1] - places[a])]
                        out = pd.DataFrame(
                            {
                                "doc_id": pd.array(own[a:b], "Int64"),
                                "start": row.first_token + places[a:b],
                                "n_tokens": np.diff(places[a : b + 1]),
                                "ids_crc32": np.array([zlib.crc32(s.tobytes()) for s in spans], "int64"),
                            }
                        )
                        out.loc[np.arange(at + a, at + b) < row.n_null, "doc_id"] = pd.NA
                        if with_ids:
                            out["ids"] = [s.astype("int64") for s in spans]
                        yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    parts = shuffle_partitions(manifest.sparkSession)
    return manifest.repartitionByRange(parts, "part").mapInPandas(read, schema)


def token_file_digests(docs: DataFrame, path: str, end_id: int | None, dtype: str = "<u2", by_word: bool = False, folder: str | None = None, **columns) -> DataFrame:
    folder = folder or scratch_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, folder, end_id, dtype, by_word, **columns), folder, dtype)
