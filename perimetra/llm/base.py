"""Helpers shared by the text operators: words of Arrow columns in a few array passes, bounded slices, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one array pass handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 4_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True at the bytes of the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Separators of words split at white space, and of words of letters and digits (all ASCII, so UTF-8 can be split by byte).
WHITE = byte_table((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@dataclass
class Words:
    """All words of a column of texts, in order. `doc` is the row of each word; `first[d]:first[d + 1]` are the words of row d."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def array(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.offsets, dtype=np.int64)), pa.py_buffer(self.data)]
        )

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """The code of each word, and the distinct words by code."""
        enc = self.array().dictionary_encode()
        return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """128 bits of each word, as two columns."""
        codes, distinct = self.coded()
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in distinct), dtype=np.uint64).reshape(-1, 2)
        return digests[codes]

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The words each followed by one space, and where each begins (one entry more at the end)."""
        n = len(self)
        lengths = np.diff(self.offsets)
        starts = self.offsets + np.arange(n + 1)
        out = np.full(int(starts[-1]), 32, dtype=np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(n), lengths)] = self.data
        return out.tobytes(), starts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column (null: empty) and the offsets of its rows in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, separators: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes outside `separators` of every text; `lower` maps A-Z to a-z first."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data[inside], np.concatenate([[0], np.cumsum(ends - starts)]), doc, first)


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows whose texts have at most `most` bytes together, or a single row."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):  # no chunk at all
            return
    n = len(col)
    if not n:
        return
    ends = text_bytes(col)[1]
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def joined(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def rows_in(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one the session names in spark.checkpoint.dir, else one made here (single machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: short lineage that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
