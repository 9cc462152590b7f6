"""Removal of repeated passages: windows of words that also start earlier somewhere in the corpus.

The corpus is split into blocks of documents. Every block sends a count-min sketch of its windows, in sparse form: the cells
that it touches in each sketch row, cut into ranges of cells. A range meets all blocks in one small group, where the counts
are added; each block gets back the cells that more than one block touched. A window whose cells are all among them is
*estimated* repeated (never too few, as counts only overestimate), and only such windows go on to the second pass, where
their 128-bit hashes are grouped exactly and the first owner of each is found. What a block repeats within itself it sees
alone. A window enters each exchange once per block, however often the block has it, so a passage that a third of all
documents share costs one entry per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import WHITE, Words, joined, settled, words_of

WINDOW = 20
#: Bytes of text in a block, cells of a sketch row for each window of the corpus, rows of the sketch, cells in one range.
BLOCK_BYTES = 4_000_000
CELLS_PER_WINDOW = 8
SKETCH_ROWS = 2
RANGE_BITS = 22
#: Windows (estimated repeated or not) for each group of the exact pass.
BUCKET_WINDOWS = 1_000_000

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SEEDS = [np.uint64(0x243F6A8885A308D3 * (2 * i + 1) % 2**64) for i in range(8)]
_LAST = 2**63 - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _rolled(lane: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """The polynomial of every `width` consecutive entries, by doubling: blocks of 1, 2, 4, ... entries are put together."""
    n = len(lane) - width + 1
    out, done, power = None, 0, base
    block, size = lane, 1
    while True:
        if width & size:
            out = block if out is None else _put(out, done, block, power)
            done += size
        if size * 2 > width:
            break
        block = block[: len(block) - size] * power + block[size:]
        power = np.multiply(power, power, dtype=np.uint64)
        size *= 2
    return out[:n]


def _put(head: np.ndarray, head_size: int, block: np.ndarray, power: np.uint64) -> np.ndarray:
    """The hash of `head_size` entries followed by those of a block; `power` moves the head over the block."""
    m = min(len(head), len(block) - head_size)
    return head[:m] * power + block[head_size : head_size + m]


class Windows:
    """The windows of a block's texts: two hash lanes, the row and the first word of each, in order of row and start."""

    def __init__(self, texts: pa.Array, width: int) -> None:
        self.words: Words = words_of(texts, WHITE, lower=False)
        doc = self.words.doc
        if len(doc) < width:
            self.start = np.zeros(0, np.int64)
            self.hash = np.zeros((2, 0), np.uint64)
            return
        lanes = self.words.hashes()
        whole = doc[: len(doc) - width + 1] == doc[width - 1 :]
        self.start = np.flatnonzero(whole)
        self.hash = np.stack([_mixed(_rolled(np.ascontiguousarray(lanes[:, i]), width, _MUL[i]))[whole] for i in (0, 1)])

    def cells(self, row: int, bits: int) -> np.ndarray:
        return _mixed(self.hash[0] ^ _SEEDS[row]) >> np.uint64(64 - bits)

    def later(self) -> np.ndarray:
        """True at windows that also start earlier in the block."""
        a, b = self.hash
        order = np.argsort(a, kind="stable")
        s = a[order]
        same = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
        run = same | np.concatenate([same[1:], [False]])
        at = order[run]
        at = at[np.lexsort((at, b[at], a[at]))]
        rep = np.concatenate([[False], (a[at][1:] == a[at][:-1]) & (b[at][1:] == b[at][:-1])]) if len(at) else np.zeros(0, bool)
        out = np.zeros(len(a), dtype=bool)
        out[at[rep]] = True
        return out


def _in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership of `values` in the sorted `wanted`; a table of low bits rules most out first."""
    out = np.zeros(len(values), dtype=bool)
    if not len(wanted) or not len(values):
        return out
    low = np.uint64((1 << 22) - 1)
    table = np.zeros(1 << 22, dtype=bool)
    table[wanted & low] = True
    maybe = np.flatnonzero(table[values & low])
    at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
    out[maybe] = wanted[at] == values[maybe]
    return out


def _in_pairs(pairs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership of the columns of `pairs` (2, n) in those of `wanted` (2, m)."""
    out = np.zeros(pairs.shape[1], dtype=bool)
    if not wanted.shape[1] or not len(out):
        return out
    wanted = wanted[:, np.argsort(wanted[0], kind="stable")]
    maybe = np.flatnonzero(_in(pairs[0], wanted[0]))
    lo = np.searchsorted(wanted[0], pairs[0][maybe], side="left")
    hi = np.searchsorted(wanted[0], pairs[0][maybe], side="right")
    ok = wanted[1][lo] == pairs[1][maybe]
    for i in np.flatnonzero(~ok & (hi - lo > 1)):
        ok[i] = (wanted[1][lo[i] : hi[i]] == pairs[1][maybe[i]]).any()
    out[maybe] = ok
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of the sorted `keys`, and where each begins (one entry more at the end)."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.append(at, len(keys))


def _cut(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The bytes of `values` cut into one binary for each of the sorted `keys`."""
    kinds, ends = _groups(keys)
    values = np.ascontiguousarray(values)
    wide = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = ends.astype(np.int64) * wide
    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kinds), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
    return kinds, blob.cast(pa.binary())


def _packed(keys: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted cells of each of the sorted `keys` as one binary: how many have each upper part (64 of them), then the lower 16 bits."""
    kinds, ends = _groups(keys)
    heads = np.bincount(np.repeat(np.arange(len(kinds)), np.diff(ends)) * 64 + (cells >> 16), minlength=64 * len(kinds)).astype(np.uint32).reshape(-1, 64)
    lows = cells.astype(np.uint16)
    rows = [heads[i].tobytes() + lows[ends[i] : ends[i + 1]].tobytes() for i in range(len(kinds))]
    return kinds, pa.array(rows, pa.binary())


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a column of packed binaries, and how many each row has."""
    heads, lows = [np.zeros((0, 64), np.uint32)], [np.zeros(0, np.uint16)]
    for row in column.to_pylist():
        heads.append(np.frombuffer(row, dtype=np.uint32, count=64)[None, :])
        lows.append(np.frombuffer(row, dtype=np.uint16, offset=256))
    heads = np.concatenate(heads)
    upper = np.repeat(np.tile(np.arange(64, dtype=np.uint32), len(heads)), heads.reshape(-1))
    return (upper << np.uint32(16)) | np.concatenate(lows), heads.sum(axis=1).astype(np.int64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 32 bits."""
    return (x & np.uint64(2**32 - 1)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a block by doc_id, null last, then by text: the order that says which copy of a passage is the first."""
    return table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """`(block, doc_id, tie, text)`: rows of `(doc_id, tie, text)` in blocks, those of one doc_id in the same unless they have more bytes than a block.

    Rows of such an id, or of none, are written in ranges of id and tie to blocks of their own, so that block numbers rise with the order
    of an id's rows; equal rows may fall into several.
    """
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = settled(sizes.where((F.col("n") > 1) & (F.col("bytes") > BLOCK_BYTES)).select(F.col("doc_id").alias("id"), "bytes"))
    held = large.agg(F.sum("bytes")).first()[0]
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    if not held:
        return rows.select(block, "doc_id", "tie", "text")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    apart = rows.join(large, same, "left_semi").withColumn("salt", F.rand(1)).repartitionByRange(math.ceil(held / BLOCK_BYTES), "doc_id", "tie", "salt")
    apart = settled(apart.select((F.spark_partition_id() + blocks).alias("block"), "doc_id", "tie", "text"))
    return rows.join(large, same, "left_anti").select(block, "doc_id", "tie", "text").union(apart)


def unrepeated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """`(doc_id, n_words, n_removed, removed, text)` for every row of `docs(doc_id, text)`.

    A word is a run of non-white-space, unchanged. A word goes if some window of `width` words of its document that covers it
    has a word sequence that also starts earlier (smaller doc_id, or same document and earlier start), judged on the input.
    `removed` lists the cut word ranges `(first, end)`, `text` the kept words joined by one space. Null, empty and blank texts
    have no words and an empty text; texts shorter than a window keep all words. Rows without a doc_id come after all
    others; rows of one doc_id follow each other by a hash of their text, so of equal rows one keeps its words. An empty
    table gives no rows; other columns are ignored.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    windows = max(1, total // 6)
    bits = max(RANGE_BITS, math.ceil(math.log2(CELLS_PER_WINDOW * windows)))
    bucket_bits = max(1, math.ceil(math.log2(max(2, windows / BUCKET_WINDOWS))))
    ranges = 1 << (bits - RANGE_BITS)
    low = np.uint64((1 << RANGE_BITS) - 1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    parts = _dealt(rows, blocks)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        found = Windows(joined(table["text"]), width)
        names, blobs = [], []
        for row in range(SKETCH_ROWS):
            cells = _groups(np.sort(found.cells(row, bits)))[0]
            kinds, blob = _packed((cells >> np.uint64(RANGE_BITS)).astype(np.int64) + row * ranges, (cells & low).astype(np.int64))
            names.append(kinds)
            blobs.append(blob)
        names = np.concatenate(names)
        return pa.table({"span": names, "block": pa.array([key[0].as_py()] * len(names), pa.int32()), "cells": pa.concat_arrays(blobs)})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        cells, sizes = _unpacked(table["cells"])
        order = np.argsort(cells, kind="stable")
        s = cells[order]
        same = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
        twice = np.zeros(len(cells), dtype=bool)
        twice[order] = same | np.concatenate([same[1:], [False]])
        owner = np.repeat(np.arange(len(sizes)), sizes)[twice]
        kinds, blob = _packed(owner, cells[twice].astype(np.int64))
        span = pa.array(np.full(len(kinds), key[0].as_py(), dtype=np.int64))
        return pa.table({"block": table["block"].combine_chunks().take(pa.array(kinds)), "span": span, "cells": blob})

    def survivors(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
        table = _ordered(table)
        found = Windows(joined(table["text"]), width)
        cells, sizes = _unpacked(repeated["cells"])
        span = np.repeat(repeated["span"].to_numpy(), sizes)
        likely = np.ones(found.hash.shape[1], dtype=bool)
        for row in range(SKETCH_ROWS):
            own = (span // ranges) == row
            wanted = np.sort(((span[own] % ranges).astype(np.uint64) << np.uint64(RANGE_BITS)) | cells[own].astype(np.uint64))
            likely &= _in(found.cells(row, bits), wanted)
        at = np.flatnonzero(likely)
        # of a window that the block has several times, the first stands for all
        order = at[np.lexsort((at, found.hash[1][at], found.hash[0][at]))]
        a, b = found.hash[0][order], found.hash[1][order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
        order = order[first]
        a, b = found.hash[0][order], found.hash[1][order]
        ids = table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        whose = ids[found.words.doc[found.start[order]]] if len(order) else np.zeros(0, np.int64)
        least = int(whose.min(initial=_LAST))
        narrow = int(whose.max(initial=least)) - least < 2**32
        columns = [*_halves(a), _halves(b)[0], *_halves((whose - least).view(np.uint64))[: 1 if narrow else 2]]
        kinds, blob = _cut((a >> np.uint64(64 - bucket_bits)).astype(np.int64), np.stack(columns, axis=1))
        n = len(kinds)
        return pa.table({"bucket": kinds, "block": pa.array([key[0].as_py()] * n, pa.int32()), "least": pa.array([least] * n, pa.int64()), "wide": pa.array([len(columns)] * n, pa.int64()), "hashes": blob})

    def owners(key: tuple, table: pa.Table) -> pa.Table:
        found, ids, blocks_of = [], [], []
        for block, least, wide, row in zip(*(table[c].to_pylist() for c in ("block", "least", "wide", "hashes"))):
            v = np.frombuffer(row, dtype=np.uint32).reshape(-1, wide)
            found.append(v[:, :3])
            ids.append(least + (v[:, 3].astype(np.int64) if wide == 4 else (v[:, 3].astype(np.uint64) | (v[:, 4].astype(np.uint64) << np.uint64(32))).view(np.int64)))
            blocks_of.append(np.full(len(v), block, dtype=np.int32))
        found, ids, blocks_of = np.concatenate(found), np.concatenate(ids), np.concatenate(blocks_of)
        a = found[:, 0].astype(np.uint64) | (found[:, 1].astype(np.uint64) << np.uint64(32))
        b = found[:, 2]
        # only hashes that several blocks hold need an owner
        order = np.argsort(a, kind="stable")
        same = np.concatenate([[False], a[order][1:] == a[order][:-1]])
        order = order[same | np.append(same[1:], False)]
        order = order[np.lexsort((blocks_of[order], ids[order], b[order], a[order]))]
        x, y = a[order], b[order]
        at = order[np.concatenate([[False], (x[1:] == x[:-1]) & (y[1:] == y[:-1])])] if len(order) else order
        at = at[np.argsort(blocks_of[at], kind="stable")]
        kinds, blob = _cut(blocks_of[at], found[at])
        return pa.table({"block": pa.array(kinds, pa.int32()), "hashes": blob})

    def cut(key: tuple, table: pa.Table, foreign: pa.Table) -> pa.Table:
        table = _ordered(table)
        found = Windows(joined(table["text"]), width)
        late = np.frombuffer(b"".join(foreign["hashes"].to_pylist()), dtype=np.uint32).reshape(-1, 3)
        late = np.stack([late[:, 0].astype(np.uint64) | (late[:, 1].astype(np.uint64) << np.uint64(32)), late[:, 2].astype(np.uint64)])
        goes = found.later() | _in_pairs(np.stack([found.hash[0], found.hash[1] & np.uint64(2**32 - 1)]), late)
        words = found.words
        n = len(words)
        step = np.zeros(n + 1, dtype=np.int64)
        np.add.at(step, found.start[goes], 1)
        np.add.at(step, found.start[goes] + width, -1)
        gone = np.cumsum(step[:n]) > 0
        n_words = np.diff(words.first)
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_removed = lost[words.first[1:]] - lost[words.first[:-1]]
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": n_words,
                "n_removed": n_removed,
                "removed": _ranges(gone, words),
                "text": _kept(words, gone, n_words - n_removed),
            }
        )

    cells = parts.groupBy("block").applyInArrow(sketch, "span long, block int, cells binary")
    repeated = cells.groupBy("span").applyInArrow(merge, "block int, span long, cells binary")
    likely = parts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(survivors, "bucket long, block int, least long, wide long, hashes binary")
    late = likely.groupBy("bucket").applyInArrow(owners, "block int, hashes binary")
    return (
        parts.groupBy("block")
        .cogroup(late.groupBy("block"))
        .applyInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, text string")
    )


def _ranges(gone: np.ndarray, words: Words) -> pa.Array:
    """The runs of removed words of each row, by word number in the row."""
    doc = words.doc
    new = np.ones(len(gone), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    begins = np.flatnonzero(gone & (new | ~np.concatenate([[False], gone[:-1]]))) if len(gone) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gone & (np.append(new[1:], True) | ~np.append(gone[1:], False))) + 1 if len(gone) else np.zeros(0, np.int64)
    base = words.first[doc[begins]]
    spans = pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(ends - base, pa.int64())], ["first", "end"])
    counts = np.bincount(doc[begins], minlength=len(words.first) - 1)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)


def _kept(words: Words, gone: np.ndarray, n_kept: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space in each row."""
    lengths = np.diff(words.offsets)
    keep = np.flatnonzero(~gone)
    data = words.data[np.repeat(~gone, lengths)]
    kept = Words(data, np.concatenate([[0], np.cumsum(lengths[keep])]), words.doc[keep], np.concatenate([[0], np.cumsum(n_kept)]))
    joint, starts = kept.spaced()
    ends = starts[kept.first]
    view = memoryview(joint)
    texts = [bytes(view[a : max(a, b - 1)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.array(texts, pa.binary()).cast(pa.string())
