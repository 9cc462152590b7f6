"""SentencePiece encoding and decoding, giant texts by a parallel scan over max-plus transfer matrices.

The encoding is the best path through the lattice of pieces: a step from one piece to the next costs one, or is impossible
where merging would not leave the two as they are (see `bpe`). A giant text is cut into chunks at fixed places. A piece that
covers the first character of a chunk is one state of that border; for each pair of states at its two borders a chunk gives the best score of a
path between them, a transfer matrix over (max, +). Matrices are combined in order, the states of the true path are read back from the
end, and each chunk then traces its own pieces between its two known states.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import rows_in, settled
from perimetra.llm.bpe import Merges

#: Characters of a chunk; longer texts are split.
CHUNK = 16_384
#: Words whose pieces a worker keeps; beyond, it starts anew.
KEPT_WORDS = 500_000
#: Both stand for the start of a word in a model; texts and pieces are held with plain spaces here.
MARK, SPACE = "▁", " "
_START, _END = -1, -2
NONE = -np.inf


class Pieces:
    """The pieces of one byte-pair model with byte fallback, and paths through the lattice of a text."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a  b ﬁ Ａ\t\n x  "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path}: only models that keep text as it is and put a space before it are read")
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i).replace(MARK, SPACE) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError(f"{path}: a piece crosses the start of a word")
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = {p: model.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        ranks = {p: order[s] for p, s in scores.items()}
        seen: set[int] = set()
        ties = {r for r in ranks.values() if r in seen or seen.add(r)}
        self.longest = max(map(len, ranks))
        self.merges = Merges(set(ranks), lambda a, b: ranks.get(a + b), self.longest, ties)
        self.inside = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        if n > 65_536:
            raise ValueError(f"{path}: more pieces than two bytes number")
        self.words: dict[str, bytes] = {}
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.start_of_word = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        texts: list[bytes] = [p.encode() for p in self.names]
        for b, i in enumerate(self.bytes):
            texts[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                texts[i] = b""
        self.texts = texts

    # one piece after the other

    def ids_of(self, tokens: list[str]) -> bytes:
        """The ids of the tokens, two bytes each."""
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            out += [i] if i is not None else [self.bytes[b] for b in t.encode()]
        return array("H", out).tobytes()

    def _word(self, word: str) -> bytes:
        # no piece holds the two characters at a cut, so the parts are encoded alone; most of them are known from other words
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        if cuts:
            ids = b"".join([self.words.get(word[a:b]) or self._part(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)])])
        else:
            ids = self._part(word)
        return self._keep(word, ids)

    def _part(self, part: str) -> bytes:
        return self._keep(part, self.ids_of(self.merges.back(self.merges.reach(part, 0, len(part), None), len(part))))

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a normalized stretch that begins and ends where no piece crosses, two bytes each."""
        known, make = self.words.get, self._word
        return b"".join([known(w) or make(w) for w in self.word.findall(text)])

    def decode(self, ids: Iterable[int]) -> str:
        texts = self.texts
        raw = b"".join([texts[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")

    # chunks

    def _is_piece(self, token: str) -> bool:
        return len(token) == 1 or (token in self.ids and self.merges.stands(token))

    def _states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces that cover the character `at`, as (characters before it, characters from it on)."""
        return [
            (at - a, b - at)
            for a in range(max(0, at - self.longest + 1), at + 1)
            for b in range(at + 1, min(len(text), a + self.longest) + 1)
            if self._is_piece(text[a:b])
        ]

    def _breaks(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last start of a word in lo + 1 .. hi, which every path must meet."""
        first = self.start_of_word.search(text, lo + 1, hi + 1)
        if first is None:
            return None
        last = max(self.start_of_word.finditer(text, max(first.start(), hi - 4096), hi + 1), key=lambda m: m.start(), default=first)
        if last.start() == first.start():
            last = max(self.start_of_word.finditer(text, first.start(), hi + 1), key=lambda m: m.start(), default=first)
        return first.start(), last.start()

    def _out(self, text: str, start: int, before: str | None, hi: int, last: bool) -> dict[int, float]:
        """The states at border `hi` that paths from `start` (after the piece `before`) reach, with minus the pieces that takes."""
        end = len(text) if last else min(len(text), hi + self.longest)
        reach = self.merges.reach(text, start, end, before)
        count = [0 if i == 0 else (NONE if t is None else 0) for i, t in enumerate(reach)]
        for i in range(1, len(reach)):
            if reach[i] is not None:
                count[i] = count[i - len(reach[i])] - 1
        if last:
            return {_END: count[-1]} if len(reach) == 1 or reach[-1] is not None else {}
        out = {}
        for p in range(max(hi + 1, start + 1), end + 1):
            t = reach[p - start]
            if t is not None and p - len(t) <= hi:
                out[_key(hi - (p - len(t)), p - hi)] = float(count[p - start])
        return out

    def transfer(self, text: str, lo: int, hi: int, last: bool) -> tuple[list[int], list[int], np.ndarray]:
        """The transfer matrix of the chunk lo..hi of `text` (which goes on to both sides as far as a piece can reach).

        Rows are the states at `lo` (the start of the text if lo is 0), columns those at `hi`; scores are minus the pieces after
        the row's piece, up to the column's piece. Pieces between the first and the last start of a word in the chunk are the same on
        every path; they are not counted.
        """
        entries = [(0, 0)] if lo == 0 else self._states(text, lo)
        keys = [_START] if lo == 0 else [_key(*e) for e in entries]
        breaks = self._breaks(text, lo, hi)
        rows: list[dict[int, float]] = []
        if breaks is None:
            for back, on in entries:
                before = text[lo - back : lo + on] if keys[0] != _START else None
                if lo + on > hi and not last:  # the piece covers the whole chunk
                    rows.append({_key(hi - lo + back, lo + on - hi): 0.0})
                else:
                    rows.append(self._out(text, lo + on, before, hi, last))
        else:
            first, final = breaks
            tail = self._out(text, final, None, hi, last)
            for back, on in entries:
                before = text[lo - back : lo + on] if keys[0] != _START else None
                reach = self.merges.reach(text, lo + on, first, before)
                if len(reach) > 1 and reach[-1] is None:
                    rows.append({})
                    continue
                head = len(self.merges.back(reach, len(reach) - 1))
                rows.append({k: v - head for k, v in tail.items()})
        columns = sorted({k for r in rows for k in r})
        return keys, columns, np.array([[r.get(k, NONE) for k in columns] for r in rows], dtype=np.float64).reshape(len(keys), len(columns))

    def trace(self, text: str, lo: int, hi: int, last: bool, entry: int, leave: int) -> bytes:
        """The ids of the pieces that begin in the chunk, between its two known states."""
        back, on = (0, 0) if entry == _START else _pair(entry)
        before = None if entry == _START else text[lo - back : lo + on]
        out = [before] if before is not None and back == 0 else []
        start = lo + on
        if leave == _END:
            stop, final = len(text), None
        else:
            back, on = _pair(leave)
            stop, final = hi - back, text[hi - back : hi + on] if back else None
        if start > stop:  # one piece covers the whole chunk
            return self.ids_of(out)
        if final is not None and stop < lo:
            final = None
        breaks = self._breaks(text, lo, min(hi, stop))
        if breaks is None or breaks[0] < start:
            reach = self.merges.reach(text, start, stop, before)
            return self.ids_of(out + self.merges.back(reach, len(reach) - 1) + ([final] if final else []))
        first, end = breaks
        head = self.merges.reach(text, start, first, before)
        tail = self.merges.reach(text, end, stop, None)
        ids = self.ids_of(out + self.merges.back(head, len(head) - 1))
        ids += self.encode(text[first:end])
        return ids + self.ids_of(self.merges.back(tail, len(tail) - 1) + ([final] if final else []))


def _key(back: int, on: int) -> int:
    return back * 4096 + on


def _pair(key: int) -> tuple[int, int]:
    return divmod(key, 4096)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=NONE)


@lru_cache(maxsize=4)
def model(path: str) -> Pieces:
    return Pieces(path)


def normalized(text: str | None) -> str:
    return SPACE + text.replace(MARK, SPACE) if text else ""


def _lists(ids: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(ids), dtype=np.uint16).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(i) // 2 for i in ids]]), pa.int32()), pa.array(flat))


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """`(doc_id, ids)`: the piece ids of every row of `docs(doc_id, text)`, as the model's library gives them, without added control pieces.

    `path` is the model file, readable at the same place on all executors: a byte-pair model that keeps text as it is, puts one space before
    it and has no piece across the start of a word (else ValueError). Characters outside the vocabulary become byte pieces. Null
    and empty texts have no ids. Texts over `chunk` characters are cut into chunks that are dealt out to all tasks; what one task holds of a text is its
    chunk, or its matrices and states (some hundred bytes a chunk). Rows are neither merged nor dropped; an empty table gives none;
    other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for part in rows_in(batches):
            ids = [pieces.encode(normalized(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    small = plain.where(F.coalesce(F.length("text"), F.lit(0)) < chunk).mapInArrow(short, "doc_id long, ids array<int>")
    large = plain.where(F.length("text") >= chunk).withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model(path).longest
        for part in rows_in(batches):
            for doc_id, text, row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "row"))):
                text = normalized(text)
                n = -(-len(text) // chunk)
                for first in range(0, n, 256):
                    nos = range(first, min(n, first + 256))
                    los = [i * chunk for i in nos]
                    leads = [min(lo, reach) for lo in los]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(nos), pa.int64()),
                            pa.array([doc_id] * len(nos), pa.int64()),
                            pa.array(list(nos), pa.int64()),
                            pa.array(leads, pa.int32()),
                            pa.array([min(chunk, len(text) - lo) for lo in los], pa.int32()),
                            pa.array([i == n - 1 for i in nos]),
                            pa.array([text[lo - lead : lo + chunk + reach] for lo, lead in zip(los, leads)], pa.string()),
                        ],
                        ["row", "doc_id", "no", "lead", "size", "last", "text"],
                    )

    # the row numbers must stay as they are for all that follows
    chunks = settled(large.mapInArrow(cut, "row long, doc_id long, no long, lead int, size int, last boolean, text string").repartition("row", "no"))

    def transfers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for part in rows_in(batches):
            rows = [pieces.transfer(r["text"], r["lead"], r["lead"] + r["size"], r["last"]) for r in part.select(["text", "lead", "size", "last"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("no"),
                    pa.array([a for a, _, _ in rows], pa.list_(pa.int32())),
                    pa.array([b for _, b, _ in rows], pa.list_(pa.int32())),
                    pa.array([m.reshape(-1) for _, _, m in rows], pa.list_(pa.float64())),
                ],
                ["row", "no", "entries", "exits", "scores"],
            )

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        """The state of the true path at every border: scores from the left, then the best states from the end back."""
        table = table.sort_by("no")
        entries, exits = table["entries"].to_pylist(), table["exits"].to_pylist()
        scores = [np.array(s).reshape(len(a), len(b)) for s, a, b in zip(table["scores"].to_pylist(), entries, exits)]
        at = {_START: 0.0}
        ahead = []
        for a, b, m in zip(entries, exits, scores):
            v = np.array([at.get(k, NONE) for k in a])
            ahead.append(v)
            at = dict(zip(b, combined(v[None, :], m)[0]))
        chosen = [_END]
        for a, b, m, v in zip(entries[::-1], exits[::-1], scores[::-1], ahead[::-1]):
            chosen.append(a[int(np.argmax(v + m[:, b.index(chosen[-1])]))])
        chosen = chosen[::-1]
        return pa.table({"row": table["row"], "no": table["no"], "entry": pa.array(chosen[:-1], pa.int32()), "leave": pa.array(chosen[1:], pa.int32())})

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for part in rows_in(batches):
            ids = [
                pieces.trace(r["text"], r["lead"], r["lead"] + r["size"], r["last"], r["entry"], r["leave"])
                for r in part.select(["text", "lead", "size", "last", "entry", "leave"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "no")), _lists(ids)], ["row", "doc_id", "no", "ids"])

    states = chunks.mapInArrow(transfers, "row long, no long, entries array<int>, exits array<int>, scores array<double>").groupBy("row")
    states = states.applyInArrow(scan, "row long, no long, entry int, leave int")
    parts = chunks.join(states, ["row", "no"]).mapInArrow(traced, "row long, doc_id long, no long, ids array<int>")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("of"))
    return small.union(whole.select("doc_id", F.flatten(F.col("of.ids")).alias("ids")))


def decoded(pieces: DataFrame, path: str) -> DataFrame:
    """`pieces(…, ids)` with the `text` that the ids stand for; null ids give an empty text. Other columns stay (`text` must not be one)."""
    if "text" in pieces.columns:
        raise ValueError("there is a column text already")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy())).tolist()
                texts = [table.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    schema = pieces.withColumn("text", F.lit("")).schema
    return pieces.mapInArrow(run, schema)
