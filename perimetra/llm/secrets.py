"""Secrets in texts: an Aho-Corasick pass finds keywords, anchored expressions run only at their places, embedded checksums decide."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import byte_table, joined, rows_in, text_bytes

BASE = ("assign", "access", "hex")
#: Kinds in their order at equal starts.
KINDS = (*BASE, "github", "npm", "age")
_SPAN = "array<struct<kind:string,start:long,end:long>>"
_HEX = byte_table((0x30, 0x39), (0x61, 0x66))
_HEX_CHARS = 16
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"

#: The keywords of each rule (lower case), and its expression, which is tried exactly where a keyword begins.
_RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    ),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+")),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "age": (("age-secret-key-1",), re.compile(rb"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")),
}


def crc_ending(body: bytes) -> bytes:
    """The CRC-32 of a token's body as six base-62 digits, which such tokens end with."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d : d + 1] + out
    return out


def bech32_holds(prefix: bytes, data: bytes) -> bool:
    """True if the checksum of a bech32 string (its lower-case parts before and after the 1) is right."""
    values = [c >> 5 for c in prefix] + [0] + [c & 31 for c in prefix] + [_BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> i & 1:
                state ^= g
    return state == 1


def _holds(kind: str, m: re.Match) -> bool:
    """What a match must still satisfy: base kinds a length, the others their checksum."""
    if kind == "assign":
        return m.end(1) - m.start(1) >= 12
    if kind == "access":
        return m.end() - m.start() >= 18
    if kind == "age":
        return bech32_holds(b"age-secret-key-", m.group(1).lower())
    return crc_ending(m.group(1)) == m.group(2)


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, (words, _) in _RULES.items():
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    return automaton


def _near_keywords(raw: bytes, low: str) -> list[tuple[int, int, int]]:
    """The spans of all rules but `hex`, in bytes, as (start, kind, end): leftmost and not overlapping within a kind."""
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _keywords().iter(low))
    after = dict.fromkeys(_RULES, 0)
    out = []
    for start, kind in hits:
        if start < after[kind]:
            continue
        m = _RULES[kind][1].match(raw, start)
        if m:
            after[kind] = m.end()
            if _holds(kind, m):
                out.append((start, KINDS.index(kind), m.end()))
    return out


def spans_of(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text (null: empty) its spans as (start, kind, end) in code points, by start and kind."""
    data, ends = text_bytes(texts)
    digit = np.concatenate([[False], _HEX[data], [False]])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    starts = np.flatnonzero(digit[1:] & np.append(~digit[:-2] | edge[:-1], False)) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(digit[1:-1] & (~digit[2:] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    long = stops - starts >= _HEX_CHARS
    starts, stops = starts[long], stops[long]
    row = np.searchsorted(ends, starts, side="right") - 1
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for d, a, b in zip(row.tolist(), (starts - ends[row]).tolist(), (stops - ends[row]).tolist()):
        runs.setdefault(d, []).append((a, KINDS.index("hex"), b))
    raw_all = data.tobytes()
    low_all = raw_all.lower().decode("latin-1")
    bounds = ends.tolist()
    out = []
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        raw = raw_all[a:b]
        spans = _near_keywords(raw, low_all[a:b]) + runs.get(d, [])
        spans.sort()
        if spans and not raw.isascii():
            places = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            at = np.concatenate([[0], places])
            spans = [(int(at[s]), k, int(at[e])) for s, k, e in spans]
        out.append(spans)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """`(doc_id, spans)` for every row of `docs(doc_id, text)`: kind, start and end (code points, end exclusive), by start, then as in `KINDS`.

    `assign`, `access` and `hex` are found by form alone; `github` and `npm` tokens must end with the checksum of their body, `age` keys
    satisfy theirs. Spans of different kinds may overlap. Null and empty texts have no spans. Rows are neither merged
    nor dropped; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_in(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in spans_of(joined(part.column("text")))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, spans {_SPAN}")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """`text` with each run of overlapping spans replaced by `mask`."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """`docs` with the secrets of `text` replaced by `mask`; other texts, null and all other columns stay as they are."""
    at = [c.lower() for c in docs.columns].index("text")
    name = docs.columns[at]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_in(batches, name):
            texts = part.column(at).to_pylist()
            new = [masked(t, s, mask) if s else t for t, s in zip(texts, spans_of(joined(part.column(at))))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def counted(found: DataFrame) -> DataFrame:
    """The digest of `secrets`: counts of the base kinds, a hash of the base spans, all spans as text."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = line(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(n, BASE), F.sha2(base, 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
