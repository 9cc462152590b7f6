"""Chat conversations packed as a prefix tree: initial turns that conversations share are emitted once, depth first.

Each turn of a conversation is known by a hash of all turns up to it. Distinct conversations, sorted by these hashes, are the branches of the
tree in depth-first order: a branch emits what it does not share with the one before. Branches are dealt out by ranges of that order;
what a range needs from those before it is one small row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimetra.llm.base import settled

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_STACK = "array<struct<owner:string,first:long,end:long>>"
_SPANS = "array<struct<first:long,end:long>>"


def escaped(text: str) -> str:
    """`text` without any control string: each backslash is doubled, and one is put inside each `<|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its text begins and ends in it."""
    head = START + escaped(role).replace("\n", "\\n") + "\n"
    body = escaped(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescaped(role), unescaped(rest[: -len(END) - 1])))
    return out


def _branches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
            digest, path, texts, spans, at = b"", [], [], [], 0
            for t in turns:
                text, lo, hi = segment(t["role"], t["text"])
                digest = hashlib.blake2b(digest + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                path.append(digest.hex())
                texts.append(text)
                if t["role"] == LEARNED:
                    spans.append({"first": at + lo, "end": at + hi})
                at += len(text)
            rows.append({"conv_id": conv_id, "branch": path[-1], "path": path, "texts": texts, "loss": spans})
        yield pa.RecordBatch.from_pylist(
            rows,
            pa.schema(
                [
                    ("conv_id", pa.int64()),
                    ("branch", pa.string()),
                    ("path", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())),
                    ("loss", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                ]
            ),
        )


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _until(stack: list[dict], end: int) -> list[dict]:
    """What of a path's owners lies before place `end`."""
    return [{"owner": s["owner"], "first": s["first"], "end": min(s["end"], end)} for s in stack if s["first"] < end]


def _emitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Branches in order: where each leaves the one before, and who owns what it shares. The first of a range shares nothing yet."""
    part = TaskContext.get().partitionId()
    path: list[str] = []
    stack: list[dict] = []
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ends = [0]
            for t in r["texts"]:
                ends.append(ends[-1] + len(t))
            n = _shared(path, r["path"])
            stack = _until(stack, ends[n])
            rows.append(
                {
                    "part": part,
                    "branch": r["branch"],
                    "head": not path,
                    "path": r["path"],
                    "ends": ends[1:],
                    "position": ends[n],
                    "owners": list(stack),
                    "text": "".join(r["texts"][n:]),
                    "loss": r["loss"],
                }
            )
            if ends[-1] > ends[n]:
                stack = [*stack, {"owner": r["branch"], "first": ends[n], "end": ends[-1]}]
            path = r["path"]
        yield pa.RecordBatch.from_pylist(rows, _EMITTED)


_SPAN_TYPE = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_OWNER_TYPE = pa.struct([("owner", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
_EMITTED = pa.schema(
    [
        ("part", pa.int32()),
        ("branch", pa.string()),
        ("head", pa.bool_()),
        ("path", pa.list_(pa.string())),
        ("ends", pa.list_(pa.int64())),
        ("position", pa.int64()),
        ("owners", pa.list_(_OWNER_TYPE)),
        ("text", pa.string()),
        ("loss", pa.list_(_SPAN_TYPE)),
    ]
)


def _resolved(stack: list[dict], head: str, shared: int, carried: list[dict]) -> list[dict]:
    """A path's owners once it is known that the first branch of the range got its first `shared` places from the ranges before."""
    out = []
    for s in stack:
        if s["owner"] == head and s["first"] < shared:
            out += _until(carried, min(shared, s["end"]))
            if s["end"] > shared:
                out.append({"owner": head, "first": shared, "end": s["end"]})
        else:
            out.append(s)
    return out


def _chained(table: pa.Table) -> pa.Table:
    """From one row of each range: what its first branch shares with the ranges before, who owns that, and where the range begins."""
    rows, base, path, stack = [], 0, [], []
    for r in table.sort_by("part").to_pylist():
        n = _shared(path, r["head_path"])
        shared = r["head_ends"][n - 1] if n else 0
        carried = _until(stack, shared)
        rows.append({"part": r["part"], "first_branch": r["head"], "shared": shared, "carried": carried, "base": base})
        base += r["total"] - shared
        path = r["tail_path"]
        own = [*r["tail_owners"]]
        if r["tail_end"] > r["tail_position"]:
            own.append({"owner": r["tail"], "first": r["tail_position"], "end": r["tail_end"]})
        stack = _resolved(own, r["head"], shared, carried)
    return pa.Table.from_pylist(
        rows,
        pa.schema([("part", pa.int32()), ("first_branch", pa.string()), ("shared", pa.int64()), ("carried", pa.list_(_OWNER_TYPE)), ("base", pa.int64())]),
    )


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cut = r["shared"] if r["head"] else 0
            owners = _until(r["carried"], cut) if r["head"] else _resolved(r["owners"], r["first_branch"], r["shared"], r["carried"])
            position = r["position"] + cut
            rows.append({"branch": r["branch"], "part": r["part"], "position": position, "owners": owners, "text": r["text"][cut:], "loss": r["loss"]})
        yield pa.RecordBatch.from_pylist(
            rows,
            pa.schema([("branch", pa.string()), ("part", pa.int32()), ("position", pa.int64()), ("owners", pa.list_(_OWNER_TYPE)), ("text", pa.string()), ("loss", pa.list_(_SPAN_TYPE))]),
        )


def packed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of `conversations(conv_id, turn, role, text)` and the branch of each conversation.

    Branches `(branch, start, position, text, loss, owners)`: one for each distinct conversation. `text` is what it does not share with the branch
    before, to be placed at `start` of the packed sequence (in code points, which stand for tokens); its first place has the position id `position`,
    and the next ones follow. `owners` are the stretches of its earlier positions (`first` to `end`) and the branches that emitted
    them, in order: with `attention`, the intervals that its places may look back to besides those of their own branch.
    `loss` are the assistant texts of the whole conversation, by position. Members `(conv_id, branch, n_conv_turns)`.

    Turns are ordered by turn, role and text, null turns first; null roles and texts are empty, a null conv_id is a conversation like
    any other, repeated rows are turns like any other. An empty table gives no branches. Control strings inside roles and
    texts are escaped. Conversations of the same turns share one branch, however many they are; one conversation is handled in one piece.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    known = settled(whole.mapInArrow(_branches, f"conv_id long, branch string, path array<string>, texts array<string>, loss {_SPANS}"))
    distinct = known.groupBy("branch").agg(*[F.first(c).alias(c) for c in ("path", "texts", "loss")])
    schema = f"part int, branch string, head boolean, path array<string>, ends array<long>, position long, owners {_STACK}, text string, loss {_SPANS}"
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    out = settled(ordered.mapInArrow(_emitted, schema).withColumn("nth", F.monotonically_increasing_id()))
    size = F.length("text").cast("long")
    edge = out.groupBy("part").agg(
        F.sum(size).alias("total"),
        *[F.min_by(c, "nth").alias(f"head{n}") for c, n in (("branch", ""), ("path", "_path"), ("ends", "_ends"))],
        *[F.max_by(c, "nth").alias(f"tail{n}") for c, n in (("branch", ""), ("path", "_path"), ("owners", "_owners"), ("position", "_position"))],
        F.max_by(F.element_at("ends", -1), "nth").alias("tail_end"),
    )
    # one row for each range of branches: as many as there are partitions, in one task and then in every task
    chain = edge.groupBy(F.lit(0).alias("all")).applyInArrow(_chained, f"part int, first_branch string, shared long, carried {_STACK}, base long")
    placed = out.join(F.broadcast(chain), "part")
    rows = placed.mapInArrow(_placed, f"branch string, part int, position long, owners {_STACK}, text string, loss {_SPANS}")
    starts = placed.select("branch", "base", "nth", "part", (size - F.when(F.col("head"), F.col("shared")).otherwise(F.lit(0))).alias("size"))
    return rows.join(_running(starts), "branch").select("branch", "start", "position", "text", "loss", "owners"), known.select("conv_id", "branch", F.size("path").cast("long").alias("n_conv_turns"))


def _running(starts: DataFrame) -> DataFrame:
    """Where each branch begins in the packed sequence: the sizes before it in its range, after all earlier ranges."""
    before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return starts.select("branch", (F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("start"))


def attention(branches: DataFrame) -> DataFrame:
    """`(branch, ancestors)`: the intervals `(first, end)` of the packed sequence that a branch's places may look back to, in order of position."""
    looks = branches.select("branch", F.posexplode("owners").alias("i", "o")).select("branch", "i", F.col("o.owner").alias("owner"), F.col("o.first").alias("first"), F.col("o.end").alias("end"))
    owner = branches.select(F.col("branch").alias("owner"), (F.col("start") - F.col("position")).alias("shift"))
    found = looks.join(owner, "owner").select("branch", F.struct("i", (F.col("first") + F.col("shift")).alias("first"), (F.col("end") + F.col("shift")).alias("end")).alias("x"))
    found = found.groupBy("branch").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"))).alias("ancestors"))
    return branches.select("branch").join(found, "branch", "left").select("branch", F.coalesce("ancestors", F.array().cast(_SPANS)).alias("ancestors"))


def read_back(branches: DataFrame) -> DataFrame:
    """`(branch, formatted, loss)`: the whole formatted conversation of each branch, put together from what its owners emitted."""
    looks = branches.select("branch", F.explode("owners").alias("o")).select("branch", F.col("o.owner").alias("owner"), F.col("o.first").alias("first"), F.col("o.end").alias("end"))
    owner = branches.select(F.col("branch").alias("owner"), "position", "text")
    shared = looks.join(owner, "owner").select("branch", "first", F.expr("substring(text, cast(first - position + 1 as int), cast(end - first as int))").alias("text"))
    own = branches.select("branch", F.col("position").alias("first"), "text")
    whole = shared.union(own).groupBy("branch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "").alias("formatted"))
    return whole.join(branches.select("branch", "loss"), "branch")


def digests(conversations: DataFrame) -> DataFrame:
    """What the packed output holds of each conversation, read back from it: turns, text under the loss mask, formatted length."""
    branches, members = packed(conversations)
    branches = settled(branches)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for branch, text, spans in zip(*(batch.column(c).to_pylist() for c in ("branch", "formatted", "loss"))):
                turns = turns_of(text)
                learned = [unescaped(text[s["first"] : s["end"]]) for s in spans]
                sha = lambda parts: hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((branch, len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, learned)), sha(learned), len(text)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    found = read_back(branches).mapInArrow(run, "branch string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    places = branches.select("branch", F.col("start").alias("packed_start"), F.length("text").cast("long").alias("packed_chars"))
    return members.join(found.join(places, "branch"), "branch").select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "packed_start", "packed_chars"
    )
