"""Repair of conversation structure by aligning turns with the strings of the turn grammar `(s?(ua)+)?`.

Roles are seen by their initials. The grammar has one string of each feasible length: `ua` repeated, after an `s` where the length is odd.
Turns are aligned with these strings by the Wagner-Fischer recurrence. Shorter strings are ends of longer ones, so one table, filled from
the last turn to the first, has the cost of every length in its first line; a cell is kept only within the band that the cost of a simple
alignment (the incumbent) allows, as in Ukkonen's cut-off. Where lengths cost the same, the audits traced back from them are compared.

A conversation is worked through in blocks of turns: what a block costs from each place in the grammar to each other, with its audit, is
joined to what came before. As an audit tells the cost of its turns, of two audits of one cost neither begins with the other, so the
least audit of the whole is made of least audits of blocks. Letters that all ways have in common are written out at once, with their turns.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: Turns aligned at once.
BLOCK = 512
#: Places in the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
OTHER = {USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What it costs at most to go on from the first place as any continuation of the second would: inserts, and a system turn deleted, not kept.
INSTEAD = {
    (NONE, SYSTEM): 0, (NONE, ASSISTANT): 0, (NONE, USER): INSERT,
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, NONE): DELETE, (ASSISTANT, USER): INSERT,
    (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, NONE): INSERT + DELETE,
    (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT, (SYSTEM, NONE): 2 * INSERT + DELETE,
}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = " \t\n\x0b\x0c\r"
LONG_MAX = (1 << 63) - 1

Turn = tuple[str, bool, bool]  # initial, must be deleted, cut off


def _cost(turn: Turn, char: str) -> int | None:
    """What it takes to have this turn stand for `char`; None: it can't."""
    initial, gone, cut = turn
    if gone:
        return None
    return (initial != char) * REROLE + cut * CUT_OFF


def _chars(last: str) -> Iterator[str]:
    """The alternating string from its end."""
    while True:
        yield last
        last = OTHER[last]


def _incumbent(turns: list[Turn], last: str, odd: bool) -> int:
    """The cost of one alignment with a string of the given parity that ends in `last`, at least one pair or turn long."""
    total, count, chars = 0, 0, _chars(last)
    char = next(chars)
    for turn in reversed(turns):
        if turn[1] or turn[2]:
            total += DELETE
        else:
            total, count, char = total + _cost(turn, char), count + 1, next(chars)
    while count == 0 or (count % 2 == 1) != odd:
        total, count = total + INSERT, count + 1
    return total


def _table(turns: list[Turn], last: str, bound: int) -> list[dict[int, int]]:
    """For each turn the cost of aligning it and all after it with the last j characters of the alternating string that ends in `last`.

    Cells from which no alignment of the block stays within `bound` are left out: what the turns before must cost (two for each one that has
    to go or is cut off) counts too.
    """
    before = [0]
    for _, gone, cut in turns:
        before.append(before[-1] + (DELETE if gone or cut else 0))
    char_at = (last, OTHER[last])  # the j-th character from the end is char_at[(j - 1) % 2]
    n = len(turns)
    line = {j: j * INSERT for j in range((bound - before[n]) // INSERT + 1)} if bound >= before[n] else {}
    table: list[dict[int, int]] = [{}] * n + [line]
    for i in range(n - 1, -1, -1):
        most, here = bound - before[i], {}
        initial, gone, cut = turns[i]
        extra = CUT_OFF if cut else 0
        below, left = line.get, None
        j, end = 0, max(line, default=-1) + 1
        while j <= end or (left is not None and left + INSERT <= most):
            cost = below(j)
            cost = most + 1 if cost is None else cost + DELETE
            if j and not gone:
                match = below(j - 1)
                if match is not None:
                    match += extra + (initial != char_at[(j - 1) % 2]) * REROLE
                    if match < cost:
                        cost = match
            if left is not None and left + INSERT < cost:
                cost = left + INSERT
            if cost <= most:
                here[j] = left = cost
            else:
                left = None
            j += 1
        table[i] = line = here
    return table


def _trace(turns: list[Turn], table: list[dict[int, int]], last: str, i: int, j: int) -> str:
    """The least audit of the cheapest alignments of turns[i:] with the last j characters."""
    out, n = [], len(turns)
    while i < n or j:
        cost = table[i][j]
        if i < n and table[i + 1].get(j, -DELETE - 1) + DELETE == cost:
            out.append("D")
            i += 1
        elif j and table[i].get(j - 1, -INSERT - 1) + INSERT == cost:
            out.append("I")
            j -= 1
        else:
            out.append("K" if turns[i][0] == (last if j % 2 else OTHER[last]) else "R")
            i, j = i + 1, j - 1
    return "".join(out)


def transfers(turns: list[Turn], whole: bool) -> dict[tuple[str, str], tuple[int, str]]:
    """Cost and audit of a block from each place in the grammar to each other that it can lead to; `whole`: only those of a full conversation."""
    n = len(turns)
    nothing = (n * DELETE, "D" * n)
    best: dict[tuple[str, str], tuple[int, str]] = {(NONE, NONE): nothing}
    starts = [p for p, (initial, gone, _) in enumerate(turns) if initial == SYSTEM and not gone]
    if not whole:
        best |= {(p, p): nothing for p in (SYSTEM, USER, ASSISTANT)}
        if starts:
            cheap = [p for p in starts if not turns[p][2]] or starts
            best[NONE, SYSTEM] = ((n - 1) * DELETE + turns[cheap[-1]][2] * CUT_OFF, "D" * cheap[-1] + "K" + "D" * (n - 1 - cheap[-1]))
    for last in (ASSISTANT,) if whole else (ASSISTANT, USER):
        # after an assistant turn, or the start, the string begins with a user turn; after a user turn with an assistant turn
        ways = {USER: last == USER, ASSISTANT: last == ASSISTANT}  # first character: is the length odd
        wanted = (USER,) if whole else (USER, ASSISTANT)
        bound = max(_incumbent(turns, last, ways[first]) for first in wanted)
        table = _table(turns, last, min(bound, nothing[0]) if whole else bound)
        for first in wanted:
            odd = ways[first]
            least = 1 if odd else 2
            heads = [(0, "", 0)]
            if first == USER:
                heads += [(p + 1, "D" * p + "K", p * DELETE + turns[p][2] * CUT_OFF) for p in starts]
            plain, begun = [], []
            for at, head, paid in heads:
                fits = [(paid + cost, at, j, head) for j, cost in table[at].items() if j >= least and j % 2 == odd]
                (begun if head else plain).extend(fits)
            for places, options in (((first == USER and (SYSTEM, ASSISTANT) or (USER,)), plain), ((NONE,) if first == USER else (), plain + begun)):
                if not options or not places:
                    continue
                cost = min(o[0] for o in options)
                audit = min(head + _trace(turns, table, last, at, j) for c, at, j, head in options if c == cost)
                for place in places:
                    if (place, last) not in best or (cost, audit) < best[place, last]:
                        best[place, last] = (cost, audit)
    return best


class Repair:
    """One conversation, turn by turn in order. `emit(role, text, letter)` gets what stays (and inserted turns) as soon as it is certain."""

    def __init__(self, emit=None) -> None:
        self.emit = emit
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.distinct = 0
        self.cost, self.audit = 0, []
        self.digest = hashlib.sha256()
        self._block: list[Turn] = []
        self._pending: deque = deque()
        self._ways = {NONE: (0, "")}
        self._place, self._written, self._previous = NONE, 0, None
        self._blocks = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        initial, body = role[:1], text.rstrip(WHITE)
        gone, cut = True, False
        if not body:
            self.blank += 1
        elif again or (self._previous and self._previous[1:] == (role, text)):
            self.duplicate += 1
        else:
            gone, cut = False, body[-1] not in ".!?"
            self.truncated += cut
        if self._previous and (self._previous[1][:1], initial) not in LEGAL:
            self.illegal += 1
        if turn is not None and (self._previous is None or turn != self._previous[0]):
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self._previous = (turn, role, text)
        if len(self._block) == BLOCK:
            self._close(False)
        self._block.append((initial, gone, cut))
        self._pending.append((role, text))

    def _close(self, end: bool) -> None:
        steps = transfers(self._block, end and not self._blocks)
        self._blocks += 1
        ways: dict[str, tuple[int, str]] = {}
        for (a, b), (cost, audit) in steps.items():
            if a in self._ways:
                way = (self._ways[a][0] + cost, self._ways[a][1] + audit)
                if b not in ways or way < ways[b]:
                    ways[b] = way
        # a way that costs more than another and the step over to its place is never part of the cheapest
        ways = {b: w for b, w in ways.items() if all(w[0] <= v[0] + INSTEAD.get((a, b), 0) for a, v in ways.items())}
        shared = len(commonprefix([audit for _, audit in ways.values()]))
        self._write(next(iter(ways.values()))[1][:shared])
        self._ways = {b: (cost, audit[shared:]) for b, (cost, audit) in ways.items()}
        self._block = []

    def _write(self, letters: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self._pending.popleft()
            if letter == "D":
                continue
            place = SYSTEM if letter == "K" and role[:1] == SYSTEM else ASSISTANT if self._place == USER else USER
            if letter != "K":
                role = NAMES[place]
            self._place = place
            self.digest.update(f"{chr(10) if self._written else ''}{role}:{text}".encode())
            self._written += 1
            if self.emit:
                self.emit(role, text, letter)

    def finish(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
        if self._block:
            self._close(True)
        self.cost, rest = min(self._ways[p] for p in (NONE, ASSISTANT) if p in self._ways)
        self._write(rest)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, LONG_MAX)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _ordered(rows: DataFrame, lost: Column | None) -> DataFrame:
    """Turns by conversation in order, `again` telling that role and text stand at an earlier turn number; lost ones first.

    Repeats are found by grouping digests, not by holding a conversation: `first` is the least turn number of role and text in it. Repeats
    with one turn number come next to each other.
    """
    blank = F.lit(" ")
    plain = rows.select(
        F.col("conv_id").alias("conv_id"),
        (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    ).withColumn("same", F.when(~F.col("lost"), F.unhex(F.substring(F.sha2(F.concat_ws("\0", "role", "text"), 256), 1, 32))))
    spoken = F.when(F.col("turn").isNotNull(), F.col("turn"))
    repeats = (
        plain.where(~F.col("lost"))
        .groupBy(F.col("conv_id").alias("of"), F.col("same").alias("known"))
        .agg(F.count("*").alias("n"), F.min(spoken).alias("first"), F.count_if(F.col("turn").isNull()).alias("unnumbered"))
        .where("n > 1")
        .drop("n")
    )
    joined = plain.join(repeats, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("known")), "left")
    later = F.col("turn").isNotNull() & ((F.col("unnumbered") > 0) | (F.col("turn") > F.col("first")))
    return (
        joined.select("conv_id", "lost", "turn", "role", "text", F.coalesce(later, F.lit(False)).alias("again"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("lost"), F.asc_nulls_first("turn"), "role", "text")
    )


def _conversations(batches: Iterable[pa.RecordBatch], emit=None) -> Iterator[tuple]:
    """Each conversation of sorted rows with its result; one open conversation is held, as far as its turns are not yet certain."""
    open_id, work = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "lost", "turn", "role", "text", "again")]
        for conv, lost, *turn in zip(*columns):
            if work is None or conv != open_id:
                if work is not None:
                    yield open_id, work.finish()
                open_id, work = conv, Repair(emit and emit(conv))
            if not lost:
                work.add(*turn)
    if work is not None:
        yield open_id, work.finish()


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audited(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conv_id of `rows(conv_id, turn, role, text)`: faults, cost and audit of the cheapest repair, digest of what it gives.

    Turns go by turn number (nulls first), those of one number by role and text. Where `lost` holds, a row only names its conversation; one
    without any other row has zeros, an empty audit and the digest of nothing. Null roles and texts are one space, so a null text is a
    blank turn and a null or empty role stands for none of s, u, a. A null conv_id is a conversation of its own. Repeated rows are duplicate
    turns. An empty table gives none; other columns are ignored. `gaps` ends at the greatest long.

    Repeats are found by grouping digests of role and text, so rows are shuffled once for that (where the repeats are too many to be
    broadcast) and once by conversation. A conversation of any length streams through one task: the digest of its text is one chain.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [(n, pa.string()) for n in ("audit", "repaired_sha256")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches), None)
        if first is None:
            return
        ids, out = [], []

        def packed() -> pa.RecordBatch:
            data = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            return pa.RecordBatch.from_arrays([pa.array(ids, first.column("conv_id").type), *data], ["conv_id", *schema.names])

        for conv, result in _conversations(chain([first], batches)):
            ids.append(conv)
            out.append(result)
            if len(ids) == 2000:
                yield packed()
                ids, out = [], []
        if ids:
            yield packed()

    return _ordered(rows, lost).mapInArrow(run, f"conv_id {kind}, {COLUMNS}")


def repaired(rows: DataFrame) -> DataFrame:
    """`(conv_id, place, role, text, edit)`: the turns of every repaired conversation, numbered from 0; edit is Keep, Rerole or Insert by its initial.

    See `audited` for order and odd rows. Conversations of which nothing stays have no turns.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches), None)
        if first is None:
            return
        out: list[tuple] = []

        def sink(conv):
            places = iter(range(1 << 62))
            return lambda role, text, letter: out.append((conv, next(places), role, text, letter))

        types = [first.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "place", "role", "text", "edit"]

        def pieces() -> Iterator[list[tuple]]:
            for batch in chain([first], batches):
                yield batch

        for _ in _conversations(pieces(), sink):
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return _ordered(rows, None).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows(conv_id, turn, role, text)` as a faulty export gives them, by crc32(conv_id:turn) % 20 (nulls: one space): 0 loses the row (`lost`),
    1 empties its text, 2 takes out `.`, `!` and `?`, 3 writes it twice, 4 makes it a user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rolled = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text")).withColumn(
        "fault", F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    )
    return rolled.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("lost"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
