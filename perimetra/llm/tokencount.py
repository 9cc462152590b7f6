"""Exact token counts of texts and of all their prefixes for a byte-level byte-pair vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import rows_in
from perimetra.llm.bpe import Merges

LIMIT = 512
#: Pieces whose counts a worker keeps; beyond, it starts anew.
KEPT_PIECES = 700_000
#: Fixed value: how the vocabulary's library cuts text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, str]:
    """The character that stands for each byte in the vocabulary file, and the byte as latin-1: visible ones are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class Counter:
    """Counts for one vocabulary file. A piece's counts at all its prefixes come from one pass; they are kept for later texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer is read")
        names = _byte_names()
        plain = str.maketrans(names)
        pairs = [tuple(p.translate(plain) for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ranks = {p: i for i, p in enumerate(pairs)}
        tokens = {t.translate(plain) for t in model["vocab"]}
        self.merges = Merges(tokens, lambda a, b: ranks.get((a, b)), max(map(len, tokens)))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PIECES)
        self.torn = regex.compile(r"\s \s")
        self.white = regex.compile(r"\s+")
        self.totals: dict[str, int] = {}
        self.word_totals: dict[str, int] = {}

    def byte_counts(self, raw: bytes) -> list[int]:
        """Tokens of every prefix of one piece, by bytes."""
        text = raw.decode("latin-1")
        last = self.merges.reach(text, 0, len(text), None)
        counts = [0] * (len(text) + 1)
        for p in range(1, len(text) + 1):
            counts[p] = counts[p - len(last[p])] + 1
        return counts

    def _total(self, piece: str) -> int:
        n = self.byte_counts(piece.encode())[-1]
        if len(self.totals) > KEPT_PIECES:
            self.totals.clear()
        self.totals[piece] = n
        return n

    def _sums(self, pieces: list[str]) -> list[int]:
        known, total = self.totals.get, self._total
        return [known(p) or total(p) for p in pieces]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings, which count as one token each."""
        if self.special is None:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def words(self, text: str) -> list[str]:
        """The text cut before each space, which no piece crosses; whole where a space stands between white space and may be inside one."""
        if self.torn.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def _word(self, word: str) -> int:
        n = sum(self._sums(self.cut.findall(word)))
        if len(word) < 64:
            if len(self.word_totals) > KEPT_PIECES:
                self.word_totals.clear()
            self.word_totals[word] = n
        return n

    def _word_sums(self, words: list[str]) -> list[int]:
        known, total = self.word_totals.get, self._word
        return [known(w) or total(w) for w in words]

    def count_plain(self, text: str) -> int:
        return sum(self._word_sums(self.words(text)))

    def count(self, text: str) -> int:
        return sum(1 if special else self.count_plain(s) for s, special in self.segments(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text), each as if that prefix were encoded alone."""
        out, base = [0], 0
        tail = ""
        for segment, special in self.segments(text):
            if special:
                so_far = base - (self.count_plain(tail) if tail else 0)
                out += [so_far + self.count_plain(tail + segment[:i]) for i in range(1, len(segment))] + [base + 1]
                base += 1
                tail = ""
            else:
                inner = self._plain_prefixes(segment)
                out += [base + n for n in inner[1:]]
                base += inner[-1]
                tail = segment
        return np.array(out, dtype=np.int64)

    def _plain_prefixes(self, text: str) -> list[int]:
        out, base = [0], 0
        run_base, run = 0, ""
        for piece in self.cut.findall(text):
            n = len(piece)
            white = self.white.fullmatch(piece) is not None  # not what str.isspace says of U+001C to U+001F
            if white:
                # white space at the end of a prefix is one piece, however the rest of the text would cut it
                if not run:
                    run_base = base
                counts = self._ends(run + piece)
                out += [run_base + counts[len(run) + i] for i in range(1, n + 1)]
                run += piece
            else:
                counts = self._ends(piece)
                if piece[0] == "'" and n > 1 and piece[1:].isalpha():
                    inner = [1] + [1 + self._ends(piece[1:i])[-1] for i in range(2, n)] + [counts[-1]]
                else:
                    inner = counts[1:]
                if run and piece[0] == " ":
                    out.append(run_base + self._ends(run + " ")[-1])
                    inner = inner[1:]
                out += [base + c for c in inner]
                run = ""
            base += counts[-1] if not white else self._ends(piece)[-1]
        return out

    def _ends(self, piece: str) -> list[int]:
        """Tokens of every prefix of one piece, by characters."""
        counts = self.byte_counts(piece.encode())
        return [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]

    def longest_within(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that has at most `limit` tokens."""
        if len(self.segments(text)) > 1:
            return int(np.flatnonzero(self.prefix_counts(text) <= limit)[-1])
        words = self.words(text)
        ends = list(accumulate(self._word_sums(words), initial=0))
        if ends[-1] <= limit:
            return len(text)
        # only the words about the limit can hold the end: white space before one may count less together with its space
        k = max(0, int(np.searchsorted(ends, limit, side="right")) - 2)
        inner = np.array(self._plain_prefixes("".join(words[k : k + 3])))
        return sum(map(len, words[:k])) + int(np.flatnonzero(ends[k] + inner <= limit)[-1])


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit, fit_chars)` for every row of `docs(doc_id, text)`.

    `path` is the vocabulary file, readable at the same place on all executors. `n_tokens` is what its library gives, special
    strings of the vocabulary inside a text counting as their one token; `over_limit` says n_tokens > `limit`; `fit_chars` is the
    length of the longest prefix of at most `limit` tokens. Null and empty texts have no bytes and no tokens. Rows are neither merged nor
    dropped; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in rows_in(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = [count.count(t) for t in texts]
            fit = [len(t) if n <= limit else count.longest_within(t, limit) for t, n in zip(texts, tokens)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(fit, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "fit_chars"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """`(doc_id, counts)`: the token count of every prefix of each text, from the empty one to the whole; see `token_counts`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in rows_in(batches):
            counts = [count.prefix_counts(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, counts array<long>")
