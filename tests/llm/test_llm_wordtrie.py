import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF
from tokenizers import Tokenizer

from perimetra.llm import queries, wordtrie

BYTES = public_tokenizers.path("byte_bpe_50k.json")
BITS = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　'stremvlld019.,!?-_#ae") + [
    "<|endoftext|>", "<|endoftext", "'ll", "'re", "  ", "   ", " \n ", "don't", "é", "日本", "😀", "²", "\x00", "the ", " and", " straße", "  ", " \xa0",
]


def by_library(texts):
    lib = Tokenizer.from_file(BYTES)
    return [lib.encode(t, add_special_tokens=False).ids for t in texts]


def rows_of(flat, offsets):
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_ids_equal_the_library():
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    texts += ["", " ", "a" * 3000, " " * 500, "ab" * 2000 + " " + "é" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    words = wordtrie.Vocabulary(BYTES)
    got = []
    for k in range(0, len(texts), 500):  # several slices share what a worker keeps
        got += rows_of(*words.encode(pa.array(texts[k : k + 500])))
    want = by_library(texts)
    assert got == want
    lib, known = Tokenizer.from_file(BYTES), wordtrie.token_bytes(BYTES)
    for ids in want:
        assert wordtrie.decode(np.array(ids, np.int64), known) == lib.decode(ids, skip_special_tokens=False)


def test_ids_do_not_hang_on_what_a_worker_keeps(monkeypatch):
    for name in ("KEPT_WORDS", "KEPT_PIECES", "KEPT_PAIRS"):
        monkeypatch.setattr(wordtrie, name, 3)
    monkeypatch.setattr(wordtrie, "KEPT_BYTES", 4)
    texts = ["the theory of thermal things", "there then the other", "theory theories theoretical", None, "the theory of thermal things"]
    words = wordtrie.Vocabulary(BYTES)
    for _ in range(2):
        assert rows_of(*words.encode(pa.array(texts))) == by_library([t or "" for t in texts])


def test_shared_prefixes_are_walked_once():
    words = [" inter", " internal", " international", " interest", " inn", "x"]
    trie = wordtrie.Trie()
    for k, w in enumerate(words):
        trie.insert(w, k)
    labels, found, stack = [], {}, [(trie.root, "")]
    while stack:
        (label, children, number), before = stack.pop()
        labels.append(label)
        found |= {number: before + label} if number >= 0 else {}
        stack += [(c, before + label) for c in children.values()]
    assert found == dict(enumerate(words))
    assert sum(map(len, labels)) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_decoding_of_odd_ids():
    lib, known = Tokenizer.from_file(BYTES), wordtrie.token_bytes(BYTES)
    r = random.Random(5)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert wordtrie.decode(np.array(ids, np.int64), known) == lib.decode(ids, skip_special_tokens=False)
    assert wordtrie.decode(np.array([-1, 464, 99999], np.int64), known) == "The"


def test_query_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op11(spark, SF).collect())) == sorted(want)


def test_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, 3, {"a": 1}), (None, "", 3, None), (2, "a b", 3, None), (2, "a b", 3, None), (3, "z " * 40_000, 3, None)],
        "doc_id long, text string, ids int, `Text_` map<string,int>",
    )
    got = sorted(((r.doc_id, r.ids) for r in wordtrie.encoded(odd, BYTES).collect()), key=repr)
    assert got == sorted([(1, []), (None, []), (2, [64, 275]), (2, [64, 275]), (3, by_library(["z " * 40_000])[0])], key=repr)
    assert wordtrie.encoded(odd.where("false"), BYTES).collect() == []
    back = wordtrie.decoded(spark.createDataFrame([(1, None), (2, [64, None, 275]), (3, [])], "doc_id long, ids array<int>"), BYTES)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "", 2: "a b", 3: ""}
