"""Byte-level byte-pair encoding of words in a prefix trie, and decoding.

The distinct words of a slice of texts are cut into pieces and the pieces not met before go into a trie. One depth-first walk hands each
node's last-token states to its children: the last token of every prefix on the path. So what words share at their start is encoded
once, whatever number of words goes on from there, and the ids of a piece are read off the states at its end.
"""

from __future__ import annotations

import json
import os
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import byte_table, joined, rows_in, text_bytes
from perimetra.llm.bpe import Merges
from perimetra.llm.tokencount import PIECES, _byte_names

#: Words, pieces and pairs of tokens that a worker keeps; beyond, it starts anew. Longer ones than KEPT_BYTES are not kept.
KEPT_WORDS, KEPT_PIECES, KEPT_PAIRS = 300_000, 700_000, 300_000
KEPT_BYTES = 64

_SPACE = 0x20
_ASCII_WHITE = byte_table((0x09, 0x0D), (0x20, 0x20))


class Trie:
    """Distinct strings of bytes (as latin-1), with labelled edges: `root` and nodes are [label, children by first byte, number of the string]."""

    def __init__(self) -> None:
        self.root: list = ["", {}, -1]

    def insert(self, word: str, number: int) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [word[at:], {}, number]
                return
            label = child[0]
            if word.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = len(os.path.commonprefix((label, word[at : at + len(label)])))
            upper = [label[:k], {label[k]: child}, -1]
            child[0] = label[k:]
            node[1][word[at]] = upper
            node, at = upper, at + k
        node[2] = number


class Pairs(Merges):
    """Which tokens may follow each other; without the automaton that finds tokens in running text."""

    def __init__(self, tokens: set[str], ranks: dict[tuple[str, str], int]) -> None:
        self.tokens, self.rank, self.ties = tokens, lambda a, b: ranks.get((a, b)), frozenset()
        self._whole, self._built, self._spines, self._fits = set(), {}, {}, {}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a vocabulary file; empty where it has no token."""
    spec = _spec(path)
    plain = str.maketrans(_byte_names())
    known = {i: t.translate(plain).encode("latin-1") for t, i in spec["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [known.get(i, b"") for i in range(1 + max(known))]


def decode(ids: np.ndarray, known: list[bytes]) -> str:
    """The text of ids; ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD."""
    return b"".join(map(known.__getitem__, ids[(ids >= 0) & (ids < len(known))].tolist())).decode("utf-8", "replace")


class Vocabulary:
    """One vocabulary file: ids of texts."""

    def __init__(self, path: str) -> None:
        spec = _spec(path)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is read")
        plain = str.maketrans(_byte_names())
        self.ids = {t.translate(plain): i for t, i in model["vocab"].items()}
        if any(chr(b) not in self.ids for b in range(256)):
            raise ValueError(f"{path}: a byte has no token")
        pairs = [tuple(p.translate(plain) for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.merges = Pairs(set(self.ids), {p: i for i, p in enumerate(pairs)})
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that take their surroundings are not read")
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.special_cut = regex.compile(b"|".join(regex.escape(c) for c in sorted(self.special, key=len, reverse=True))) if added else None
        self.cut = regex.compile(PIECES)
        #: Tokens by their last byte, the one before and so on: the next bytes, and the token that is whole here (None: none).
        self._ends: dict[str, tuple[dict, str | None]] = {}
        for t in sorted((t[::-1] for t in self.ids), key=len):
            node = self._ends
            for c in t[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[t[-1]] = (node[t[-1]][0] if t[-1] in node else {}, t[::-1])
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct pieces (bytes as latin-1): a trie of them, walked depth first.

        The state of a byte is the last token of the encoding up to it: of the tokens that end there the one that fits the state before it.
        """
        trie = Trie()
        for number, piece in enumerate(pieces):
            trie.insert(piece, number)
        out: list[tuple[int, ...]] = [()] * len(pieces)
        longest = max(map(len, pieces), default=0)
        path, last = [""] * longest, [""] * (longest + 1)
        ends, fits, stands, ids = self._ends, self.merges.fits, self.merges.stands, self.ids
        known, whole = self.merges._fits.get, self.merges._whole
        stack = [(trie.root, 0)]
        while stack:
            (label, children, number), depth = stack.pop()
            for c in label:
                path[depth] = c
                depth += 1
                at, node = depth, ends
                while True:
                    at -= 1
                    node, token = node[path[at]]
                    if token is not None:
                        if at:
                            before = last[at]
                            ok = known((before, token))
                            if ok is None:
                                ok = fits(before, token)
                            if not ok:
                                continue
                        if token in whole or stands(token):
                            last[depth] = token
                            break
            if number >= 0:
                at, back = depth, []
                while at:
                    back.append(ids[last[at]])
                    at -= len(last[at])
                out[number] = tuple(back[::-1])
            for child in children.values():
                stack.append((child, depth))
        return out

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of distinct words; unknown pieces of all of them are encoded together."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        if len(self.merges._fits) > KEPT_PAIRS:
            self.merges._fits.clear()
        out = list(map(self.words.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        cut = [self.cut.findall(words[k].decode()) for k in missing]
        fresh = sorted(set(chain.from_iterable(cut)).difference(self.pieces))
        known = dict(zip(fresh, self.encode_pieces([p.encode().decode("latin-1") for p in fresh])))
        self.pieces.update((p, ids) for p, ids in known.items() if len(p) <= KEPT_BYTES)
        known = ChainMap(known, self.pieces) if any(len(p) > KEPT_BYTES for p in fresh) else self.pieces
        for k, pieces in zip(missing, cut):
            word = words[k]
            out[k] = known[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(known.__getitem__, pieces)))
            if len(word) <= KEPT_BYTES:
                self.words[word] = out[k]
        return out

    def _special_edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where special strings begin and end; one that crosses two texts is none."""
        raw = data.tobytes()
        if self.special_cut is None or not any(s in raw for s in self.special):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = [
            (a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in self.special_cut.finditer(raw[a:b])
        ]
        flat = np.array(spans, np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and the offsets of the rows in them. Null: empty."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin, end = self._special_edges(data, offsets)
        edge = _cuts(data)
        for a, b in zip(begin, end):
            edge[a:b] = False
        edge[begin] = True
        edge[end[end < len(data)]] = True
        edge[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(edge)
        bounds = np.append(starts, len(data))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        ids = self.encode_words(distinct)
        if len(begin):
            ids = [(self.special[w],) if w in self.special else i for w, i in zip(distinct, ids)]
        code = words.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        n = sizes[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], n)
        return flat[at], upto[np.searchsorted(starts, offsets)]


def _cuts(data: np.ndarray) -> np.ndarray:
    """True at spaces before which no piece goes on: those after what is no white space, or between white space and a visible ASCII byte.

    Where this says nothing, the word goes on, and its pieces are found by the full pattern.
    """
    white = _ASCII_WHITE[data]
    # last bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000
    one = np.concatenate([[0], data[:-1]])
    two = np.concatenate([[0, 0], data[:-2]])[: len(data)]
    white |= (one == 0xC2) & ((data == 0x85) | (data == 0xA0))
    white |= (two == 0xE1) & (one == 0x9A) & (data == 0x80)
    white |= (two == 0xE2) & (one == 0x80) & ((data >= 0x80) & (data <= 0x8A) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    white |= (two == 0xE2) & (one == 0x81) & (data == 0x9F)
    white |= (two == 0xE3) & (one == 0x80) & (data == 0x80)
    before = np.concatenate([[False], white[:-1]])
    visible = np.concatenate([(data[1:] < 0x80) & ~_ASCII_WHITE[data[1:]], [False]])
    return (data == _SPACE) & (~before | visible)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """`(doc_id, ids)` for every row of `docs(doc_id, text)`: the ids that the vocabulary's library gives, no special tokens added.

    With `back` also `decoded`, the text that the ids give: `decoded()` in the same worker, so that no second one takes memory.

    `path` is the vocabulary file, readable at the same place on all executors. Special strings inside a text are their one token. Null and
    empty texts have no ids. Rows are neither merged nor dropped, repeated ones stay, an empty table gives none; other columns are ignored.
    Each text is encoded where it was read: nothing is shuffled, and a task holds one slice of texts (about 4 MB, or one text) and the
    ids of at most KEPT_WORDS short words and KEPT_PIECES pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(path), token_bytes(path)
        for part in rows_in(batches):
            flat, offsets = words.encode(joined(part.column("text")))
            out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
            if back:
                out.append(pa.array([decode(flat[a:b], known) for a, b in zip(offsets[:-1], offsets[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "ids", "decoded"][: 2 + back]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * back)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """`(doc_id, ids, text)` for every row of `ids(doc_id, ids)`; null ids are an empty text, null entries and ids outside the vocabulary nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            rows = joined(batch.column("ids"))
            flat = rows.values.cast(pa.int64()).fill_null(-1).to_numpy()
            ends = rows.offsets.to_numpy()
            held = rows.is_valid().to_numpy(zero_copy_only=False)
            texts = [decode(flat[a:b], known) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], held)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    plain = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>, text string")
