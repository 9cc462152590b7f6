"""Benchmark decontamination: an FM-index of each training shard, searched backward for the windows of all test items."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import NOT_ALNUM, joined, rows_in, words_of
from perimetra.llm.fmindex import FMIndex

WINDOW = 13
#: Bytes of test items that go to every task at once; a larger benchmark is searched in several passes over the shards.
ITEM_BYTES = 16_000_000
FOUND = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"


@dataclass
class Phrases:
    """The distinct windows of some test items: their words by code, the items of each, and the length of the shortest."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]
    shortest: int


def phrases_of(items: list[tuple[str | None, str]], width: int = WINDOW) -> Phrases:
    words = words_of(pa.array([t for _, t in items], pa.string()), NOT_ALNUM, lower=True)
    codes, distinct = words.coded()
    owners: dict[bytes, set[str]] = {}
    for d, (name, _) in enumerate(items):
        own = (codes[words.first[d] : words.first[d + 1]] + 1).astype(np.int32)
        for i in range(max(1, len(own) - width + 1) if len(own) else 0):
            owners.setdefault(own[i : i + width].tobytes(), set()).update(() if name is None else (name,))
    windows = [np.frombuffer(k, dtype=np.int32) for k in owners]
    return Phrases({w: i + 1 for i, w in enumerate(distinct)}, windows, [sorted(s) for s in owners.values()], min(map(len, windows), default=1))


def shard_hits(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text; every found window as its number and first word (over the shard); and the rows of words per text.

    Words that no test item has can be in no window: they end a run of the others. The index holds the runs that are as long as the
    shortest window at least, closed by a separator, and stands for the shard exactly as far as any window can tell.
    """
    words = words_of(texts, NOT_ALNUM, lower=True)
    codes, distinct = words.coded()
    table = np.fromiter((phrases.vocabulary.get(w, 0) for w in distinct), dtype=np.int64, count=len(distinct))
    text = table[codes] if len(codes) else np.zeros(0, np.int64)
    known = text > 0
    new = np.ones(len(text), dtype=bool)
    new[1:] = words.doc[1:] != words.doc[:-1]
    begins = np.flatnonzero(known & (new | ~np.concatenate([[False], known[:-1]]))) if len(text) else np.zeros(0, np.int64)
    ends = np.flatnonzero(known & (np.append(new[1:], True) | ~np.append(known[1:], False))) + 1 if len(text) else np.zeros(0, np.int64)
    long = ends - begins >= phrases.shortest
    begins, sizes = begins[long], (ends - begins)[long] + 1
    if not len(begins):
        return np.diff(words.first), np.zeros(0, np.int64), np.zeros(0, np.int64), words.first
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(begins, sizes) + inner
    closing = inner == np.repeat(sizes - 1, sizes)
    kept = np.where(closing, 0, text[np.minimum(place, len(text) - 1)])
    which, at = FMIndex(kept).find(phrases.windows)
    return np.diff(words.first), which, place[at], words.first


def _cover(first: np.ndarray, begins: np.ndarray, lengths: np.ndarray, before: list[list]) -> tuple[pa.Array, list]:
    """Merged spans of each text, by word number in the text, from the found windows and the spans known before."""
    n = int(first[-1])
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, begins + lengths, -1)
    for d, spans in enumerate(before):
        for s in spans or ():
            step[first[d] + s["first"]] += 1
            step[first[d] + s["end"]] -= 1
    hit = np.cumsum(step[:n]) > 0
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(n, dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    lo = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]]))) if n else np.zeros(0, np.int64)
    hi = np.flatnonzero(hit & (np.append(new[1:], True) | ~np.append(hit[1:], False))) + 1 if n else np.zeros(0, np.int64)
    base = first[doc[lo]]
    spans = pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], ["first", "end"])
    counts = np.bincount(doc[lo], minlength=len(first) - 1)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)


def _searcher(phrases: Phrases, column: str, text: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(w) for w in phrases.windows], dtype=np.int64)
        for part in rows_in(batches, text):
            texts = joined(part.column(text))
            n_words, which, begins, first = shard_hits(texts, phrases)
            known = part.column(column).to_pylist()
            spans = _cover(first, begins, sizes[which], [k and k["spans"] for k in known])
            items = [set(k["items"]) if k else set() for k in known]
            doc = np.searchsorted(first, begins, side="right") - 1
            pairs = np.unique(np.stack([doc, which], axis=1), axis=0) if len(which) else np.zeros((0, 2), int)
            for d, w in pairs.tolist():
                items[d].update(phrases.items[w])
            found = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), spans, pa.array([sorted(s) for s in items], pa.list_(pa.string()))], ["n_words", "spans", "items"]
            )
            at = part.schema.get_field_index(column)
            arrays = [found if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    return run


def searched(docs: DataFrame, benchmark: DataFrame, column: str = "found", width: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """`docs` with the struct `column` of n_words, merged removal `spans` (first and end word) and the `items` whose windows occur.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is `width` consecutive words of an item; an
    item of fewer words, but not none, is one window. Null, empty and wordless texts have no words, no spans and no items; items without
    a text are left out, those without an id are searched but not listed; rows of one item_id count as one item. An empty benchmark or table gives no hits or rows. All columns of
    `docs` pass through; `column` must not be one of them. The items are a stated query set: they go to the tasks in passes of at most
    about `item_bytes`, so a benchmark of any size is searched whole.
    """
    if column.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {column} already")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / item_bytes))
    text = next(c for c in docs.columns if c.lower() == "text")
    out = docs.withColumn(column, F.lit(None).cast(f"struct<{FOUND.replace(' long', ':long').replace(' array', ':array')}>"))
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        out = out.mapInArrow(_searcher(phrases_of([(r.item_id, r.text) for r in part], width), column, text), out.schema)
    return out


def _hits(column: str) -> F.Column:
    return F.aggregate(f"{column}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def _contaminated(column: str) -> F.Column:
    return (_hits(column) > 0) & (20 * _hits(column) >= F.col(f"{column}.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """`(doc_id, n_words, n_hit, items, spans, contaminated)` for every row of `docs(doc_id, text)`; see `searched`.

    A word inside any occurring window is hit; a document is contaminated if a twentieth of its words are hit, and one at least.
    """
    found = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, "found", width)
    return found.select("doc_id", "found.n_words", _hits("found").alias("n_hit"), "found.items", "found.spans", _contaminated("found").alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of `docs` that are not contaminated, unchanged."""
    column = "found"
    while column in map(str.lower, docs.columns):
        column += "_"
    return searched(docs, benchmark, column, width).where(~_contaminated(column)).drop(column)
