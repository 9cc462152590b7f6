import random

import pytest
from pyspark.sql import functions as F

from perimetra.llm import substrings


def plain(rows, width):
    out, seen = [], set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [200, 10_000_000])
def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block_bytes)
    random.seed(4)
    shared = [[f"p{k}w{i}" for i in range(30)] for k in range(4)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(random.randint(0, 4)):
            words += random.choice(shared) if random.random() < 0.5 else [random.choice(["é", "a", "the", "x y"]) for _ in range(random.randint(1, 30))]
        rows.append((d * 3, random.choice([" ", "\n", "  "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "z " * 100)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.unrepeated(docs, 8).collect()), key=repr)
    assert got == plain(rows, 8)


def test_copies_and_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, [tuple(s) for s in r.removed]) for r in substrings.unrepeated(docs).collect()), key=repr)
    assert got == sorted([(2, 0, []), *[(i, 30, [(0, 30)]) for i in (4, 4, None, None)]], key=repr)
    assert substrings.unrepeated(docs.where("false")).collect() == []


def test_rows_of_one_id_or_of_none_are_spread(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1000)
    rng = random.Random(8)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(6)]
    texts = [" ".join(rng.choice([rng.choice(passages), f"a{rng.random()} b{rng.random()}"]) for _ in range(4)) for _ in range(200)]
    ids = [None] * 80 + [7] * 60 + list(range(100, 160))
    rows = list(zip(ids, texts)) + [(None, texts[0])] * 40 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tied = docs.selectExpr("doc_id", "xxhash64(text) as tie", "text")
    sizes = {r.block: r.n for r in substrings._dealt(tied, 20).groupBy("block").agg(F.count("text").alias("n")).collect()}
    assert sum(sizes.values()) == len(rows) - 1 and max(sizes.values()) < 30
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.unrepeated(docs, 8).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in tied.orderBy("tie").collect()], 8)
