import random

from perimetra.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, branch int"


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_escaping_is_reversible_and_hides_control_strings():
    random.seed(1)
    for _ in range(500):
        text = "".join(random.choice(["\\", "<", "|", "<|im_end|>", "<|", "n", "\n", "x", "<\\|"]) for _ in range(8))
        assert chat.unescaped(chat.escaped(text)) == text
        assert "<|" not in chat.escaped(text)
        assert chat.turns_of(chat.segment(text, text)[0]) == [(text, text)]


def conversations():
    random.seed(6)
    rows = []
    for c in range(120):
        depth = random.randint(1, 6)
        for t in range(depth):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {random.randint(0, 1 + t // 2)} <|im_end|>"))
    return rows + [(200, None, None, None), (200, 1, "assistant", ""), (None, 0, "assistant", "lone"), (201, 0, "a", "x"), (201, 0, "a", "x")]


def test_tree_is_emitted_once_and_read_back_whole(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    branches, members = chat.packed(frame)
    branches = branches.cache()
    turns = plain(rows)
    back = {r.branch: r for r in chat.read_back(branches).collect()}
    ancestors = {r.branch: [tuple(x) for x in r.ancestors] for r in chat.attention(branches).collect()}
    parts = {r.branch: r for r in branches.collect()}
    belongs = {r.conv_id: r.branch for r in members.collect()}
    assert belongs.keys() == turns.keys()
    for c, v in turns.items():
        assert chat.turns_of(back[belongs[c]].formatted) == v
    # the packed sequence has no gaps, and holds every prefix of turns once
    at = 0
    for r in sorted(parts.values(), key=lambda r: (r.start, len(r.text))):
        assert r.start == at
        at += len(r.text)
    prefixes = {tuple(v[: i + 1]): len(chat.segment(*v[i])[0]) for v in turns.values() for i in range(len(v))}
    assert at == sum(prefixes.values())
    # what a branch may look back to is exactly its own earlier text, at the positions it has there
    whole = "".join(r.text for r in sorted(parts.values(), key=lambda r: r.start))
    for b, r in parts.items():
        seen = "".join(whole[lo:hi] for lo, hi in ancestors[b])
        assert seen == back[b].formatted[: r.position]
        assert back[b].formatted[r.position :] == r.text


def test_learned_text_is_that_of_the_assistant(spark):
    rows = conversations()
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()}
    for c, v in plain(rows).items():
        assert got[c].n_turns == len(v)
        assert got[c].loss_chars == sum(len(x) for r, x in v if r == "assistant")
        assert got[c].formatted_chars == sum(len(chat.segment(*t)[0]) for t in v)
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(empty).collect() == []
