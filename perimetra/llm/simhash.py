"""Near-duplicates by 64-bit similarity fingerprints: pigeonhole blocks, joins on blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from perimetra.llm.base import WHITE, joined, rows_in, settled, words_of
from perimetra.llm.graph import components

SHINGLE = 3
BITS = 3
BLOCKS = 6
#: Longest list of fingerprints with one key whose pairs are compared; longer ones get further keys.
TILE = 1024
#: Lists whose fingerprints can differ in no more places than this have at most 2 ** CUBE entries and need no further keys.
CUBE = 18
_SMALL = 16


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    words = words_of(texts, WHITE, lower=True)
    n_words = np.diff(words.first)
    joint, starts = words.spaced()
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    base = np.repeat(words.first[:-1], n_sh)
    inner = np.arange(n_sh.sum()) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    lo = base + inner
    hi = np.minimum(lo + width, np.repeat(words.first[1:], n_sh))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joint[a:b], 42) for a, b in zip(starts[lo].tolist(), (starts[hi] - 1).tolist())), dtype=np.uint64, count=len(lo)
    )
    out = np.zeros(len(texts), dtype=np.uint64)
    has = np.flatnonzero(n_sh)
    if not len(has):
        return out
    counts = np.zeros((len(has), 64), dtype=np.int64)
    ends = np.cumsum(n_sh[has])
    for lo_d, hi_d in _runs(n_sh[has], 200_000):
        a, b = int(ends[lo_d] - n_sh[has][lo_d]), int(ends[hi_d - 1])
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = (ends[lo_d:hi_d] - n_sh[has][lo_d:hi_d]) - a
        counts[lo_d:hi_d] = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    set_bits = (2 * counts > n_sh[has][:, None]).astype(np.uint8)
    out[has] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries that sum to about `most`."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """`(doc_id, fp)` for every row of `docs(doc_id, text)`: one bit is the majority of that bit over the XXH64 (seed 42) of all shingles.

    Words are runs of non-white-space of the text with A-Z lower-cased. Fewer words than a shingle: the whole sequence is one.
    Null, empty and blank texts: fingerprint zero. Rows are neither merged nor dropped; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_in(batches):
            fp = _fingerprints(joined(part.column("text")), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def fingerprinted(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """`(row, fp)` for every row of `rows(row, text)`; `row` is any struct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_in(batches):
            fp = _fingerprints(joined(part.column("text")), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fp)], ["row", "fp"])

    return rows.mapInArrow(run, StructType([StructField("row", rows.schema["row"].dataType), StructField("fp", LongType())]))


def block_masks(free: int, bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """Sets of the places in `free`, all of `blocks - bits` of `blocks` parts: two fingerprints that differ in at most `bits` places agree in one set at least."""
    if not bits < blocks <= 16:
        raise ValueError("blocks must exceed bits")
    places = [b for b in range(64) if free >> b & 1]
    edges = [len(places) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in places[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - bits)]


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _list_links(fps: np.ndarray, reps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links of one list: every entry hangs on the least representative that it reaches inside it."""
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order], reps[order]
    label = _reached(fps, bits) if len(fps) <= TILE else _reached_by_places(fps, bits)
    off = np.flatnonzero(label != np.arange(len(fps)))
    return reps[off], reps[label[off]]


def _reached(fps: np.ndarray, bits: int) -> np.ndarray:
    """The first entry that each entry reaches, from all pairs."""
    near = _close(fps[:, None], fps[None, :], bits)
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reached_by_places(fps: np.ndarray, bits: int) -> np.ndarray:
    """The same for a long list of distinct fingerprints that differ in few places: each looks up those that 1 to `bits` changed places make of it."""
    n = len(fps)
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [b for b in range(64) if differ >> b & 1]
    short = np.zeros(n, dtype=np.int64)
    for i, b in enumerate(places):
        short |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    at = np.full(1 << len(places), n, dtype=np.int32)
    at[short] = np.arange(n, dtype=np.int32)
    changes = [sum(1 << i for i in chosen) for k in range(1, bits + 1) for chosen in combinations(range(len(places)), k)]
    label = np.arange(n + 1)
    while True:
        before = label.copy()
        for change in changes:
            np.minimum(label[:n], label[at[short ^ change]], out=label[:n])
        label = label[label]
        if (label == before).all():
            return label[:n]


def _small_links(lens: np.ndarray, fps: np.ndarray, reps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links inside many short lists at once: each entry is compared with those up to 15 places on in the same list."""
    owner = np.repeat(np.arange(len(lens)), lens)
    found_a, found_b = [], []
    for d in range(1, int(lens.max(initial=1))):
        ok = (owner[d:] == owner[:-d]) & _close(fps[d:], fps[:-d], bits)
        found_a.append(reps[d:][ok])
        found_b.append(reps[:-d][ok])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (reps[:0], reps[:0])


def _as_long(x: int) -> int:
    return x - 2**64 if x >> 63 else x


@cache
def _further(mask: int, bits: int, blocks: int) -> list[int]:
    """The sets of places that a list which agrees in those of `mask` is keyed by next."""
    return [_as_long(mask | more) for more in block_masks(~mask & (2**64 - 1), bits, blocks)]


def lists(classes: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> list[DataFrame]:
    """Frames `(of)` of lists of `(fp, rep)` from `classes(fp, rep)` of distinct fingerprints; all pairs within `bits` bits share a list.

    Entries are keyed by what they have in a set of places. Keys are counted by partial aggregates; only lists of up to `TILE`
    are collected. The entries of longer ones are keyed anew, by blocks of the places in which they can still differ, until
    the lists are short or at most `CUBE` places are left, which bounds a list of distinct fingerprints whatever the rows are.
    """
    keyed = classes.select("fp", "rep", F.explode(F.array(*[F.lit(m).cast("long") for m in _further(0, bits, blocks)])).alias("mask"))
    free, found = 64, []

    def further(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, of = np.unique(batch.column(2).to_numpy(), return_inverse=True)
            for nexts in np.array([_further(int(m) % 2**64, bits, blocks) for m in masks], dtype=np.int64).reshape(len(masks), -1).T:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nexts[of])], ["fp", "rep", "mask"])

    while True:
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        widths = sorted(free * (i + 1) // blocks - free * i // blocks for i in range(blocks))
        free -= sum(widths[: blocks - bits])
        short, more = keyed, None
        if free > CUBE:
            # written, so that its size is known to the two joins
            more = settled(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("mask", "key"))
            more = None if more.isEmpty() else more
        if more is not None:
            short = keyed.join(more, ["mask", "key"], "left_anti")
        found.append(short.groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("of")).where(F.size("of") > 1).select("of"))
        if more is None:
            return found
        keyed = keyed.join(more, ["mask", "key"], "left_semi").select("fp", "rep", "mask").mapInArrow(further, "fp long, rep long, mask long")


def links(classes: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """`(a, b)`: enough verified links between `classes(fp, rep)` of distinct fingerprints to connect all that are within `bits` bits.

    Fingerprints meet in `lists`. What a list emits grows with its entries, not with their pairs; its rows are streamed, and one list at a
    time is held whole. Nothing is dropped.
    """

    def linked(heads: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        at = np.append(np.flatnonzero(heads), len(heads))
        lens = np.diff(at)
        small = lens <= _SMALL
        take = np.repeat(small, lens)
        out = [_small_links(lens[small], fps[take], reps[take], bits)]
        out += [_list_links(fps[at[i] : at[i + 1]], reps[at[i] : at[i + 1]], bits) for i in np.flatnonzero(~small)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            heads, fps, reps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [heads == 0, fps.view(np.uint64), reps]
            begins = np.flatnonzero(rows[0])
            if not len(begins):
                held.append(rows)
                continue
            # the last list may go on in the next batch
            last = begins[-1]
            done = [np.concatenate(c) for c in zip(*held, [c[:last] for c in rows])]
            held = [[c[last:] for c in rows]]
            if len(done[0]):
                yield linked(*done)
        if held:
            yield linked(*(np.concatenate(c) for c in zip(*held)))

    found = [of.select(F.posexplode("of").alias("pos", "e")).select("pos", "e.fp", "e.rep").mapInArrow(run, "a long, b long") for of in lists(classes, bits, blocks)]
    return reduce(DataFrame.union, found).distinct()


def grouped(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, width: int = SHINGLE) -> DataFrame:
    """`(doc_id, fp, family, component_id)` for every row of `docs(doc_id, text)`; rows of one component have one `family`, its least fingerprint.

    Nodes are fingerprints, not ids: rows of one doc_id with unrelated texts stay apart, and any doc_id will do. See `near_duplicates`.
    """
    fps = settled(fingerprints(docs, width))
    classes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(classes.select("fp", F.col("fp").alias("rep")), bits, blocks))
    families = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("family"))
    named = families.groupBy("family").agg(F.min("least").alias("component_id"))
    return fps.join(families.select("fp", "family").join(named, "family"), "fp").select("doc_id", "fp", "family", "component_id")


def near_duplicates(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, width: int = SHINGLE) -> DataFrame:
    """`(doc_id, fp, component_id)` for every row of `docs(doc_id, text)`.

    Documents link if their fingerprints differ in at most `bits` bits; `component_id` is the least doc_id that a document
    reaches over links, itself included. Equal fingerprints are merged before any pairing, so exact copies, empty texts
    (fingerprint zero) and repeated rows cost one entry. A null doc_id keeps its row and never names a component; a
    component of null ids only has a null component_id. Rows of one doc_id with different texts are different documents. An empty
    table gives no rows.
    """
    return grouped(docs, bits, blocks, width).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **settings: int) -> DataFrame:
    """`docs` with one row of each near-duplicate component: that of the least doc_id and, where rows of that id are in it with several
    fingerprints, of the least of these; of several rows with that id and fingerprint the least one as JSON.

    All columns stay as they are, of whatever type. Rows without a doc_id cannot be named and are all kept.
    """
    parts = settled(grouped(docs, **settings).where("doc_id is not null").select("doc_id", "fp", "family"))
    first = parts.groupBy("family").agg(F.min(F.struct("doc_id", "fp")).alias("of")).select("of.doc_id", "of.fp")
    rows = docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    often = parts.groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = rows.join(often, "doc_id", "left_anti")
    # only rows of repeated ids need another look at their texts
    several = rows.join(often, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    width = settings.get("width", SHINGLE)
    marked = fingerprinted(several.select("row", F.col("row.text").cast("string").alias("text")), width)
    best = marked.groupBy(F.col("row.doc_id").alias("doc_id"), "fp").agg(F.min_by("row", F.to_json("row")).alias("row"))
    chosen = best.join(first, ["doc_id", "fp"], "left_semi").select("row.*")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*plain).union(chosen.select(*plain)).union(docs.where("doc_id is null"))
