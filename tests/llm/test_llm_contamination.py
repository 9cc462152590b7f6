import random
import re

import numpy as np
import pyarrow as pa
import pytest

from perimetra.llm import contamination
from perimetra.llm.fmindex import FMIndex, suffix_order

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def plain(docs, items, width=13):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).update([] if name is None else [str(name)])
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[key]
        n = sum(hit)
        out.append((doc_id, len(w), n, sorted(found), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=repr)


def test_suffix_order_and_search():
    random.seed(1)
    for _ in range(30):
        text = np.array([random.randint(0, 3) for _ in range(random.randint(1, 60))])
        assert suffix_order(np.append(text + 1, 0)).tolist() == sorted(range(len(text) + 1), key=lambda i: [*(text[i:] + 1).tolist(), 0])
        phrases = [np.array([random.randint(0, 4) for _ in range(random.randint(1, 4))]) for _ in range(10)]
        which, at = FMIndex(text).find(phrases)
        want = {(k, i) for k, p in enumerate(phrases) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p.tolist()}
        assert set(zip(which.tolist(), at.tolist())) == want and len(which) == len(want)


def test_equals_brute_force(spark):
    random.seed(2)
    pool = ["Aé", "b", "C1", "d", "e-f", "日本"]
    text = lambda n: " ".join(random.choice(pool) for _ in range(n))
    items = [(i, text(random.randint(10, 20))) for i in range(12)] + [(12, "b"), (13, "d b"), (14, ""), (15, None), (None, "C1 d"), (3, text(14)), (20, "!?")]
    docs = [(d, " ".join([text(5), random.choice(items)[1] or "", text(random.randint(0, 200))])) for d in range(40)]
    docs += [(100, None), (101, ""), (102, "... --"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1])]
    for items_used in (items, items[:12], []):
        bench = spark.createDataFrame(items_used, "item_id long, text string")
        frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, found int")
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination.contamination(frame, bench).collect()), key=repr)
        assert got == plain(docs, items_used)
        clean = contamination.uncontaminated(frame, bench)
        assert clean.columns == frame.columns
        assert clean.count() == sum(not r[-1] for r in got)


def test_passes_over_a_large_benchmark_give_the_same(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(15))) for i in range(9)]
    docs = spark.createDataFrame([(d, f"{items[d % 9][1]} mid {items[(d + 1) % 9][1]}") for d in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r.doc_id, r.found["items"], r.found.spans) for r in df.collect())
    assert key(contamination.searched(docs, bench, item_bytes=100)) == key(contamination.searched(docs, bench))
    assert contamination.searched(docs.where("false"), bench).collect() == []


def test_shard_positions_do_not_cross_documents():
    p = contamination.phrases_of([("1", "a b c")], 13)
    _, which, at, _ = contamination.shard_hits(pa.array(["a b", "c a b c", "x a b c"]), p)
    assert len(which) == 2 and sorted(at.tolist()) == [3, 7]


def test_items_without_an_id_are_searched_and_names_may_clash_in_case(spark):
    words = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, words, 4), (2, "clean words only here", 5)], "doc_id long, text string, Found int")
    bench = spark.createDataFrame([(None, words), (None, None), (None, "")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in contamination.contamination(docs, bench).collect()}
    assert got == {1: (20, [], True), 2: (0, [], False)}
    assert [tuple(r) for r in contamination.uncontaminated(docs, bench).collect()] == [(2, "clean words only here", 5)]
    with pytest.raises(ValueError):
        contamination.searched(docs, bench, "FOUND")
