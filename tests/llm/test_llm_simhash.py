import numpy as np
import xxhash
from conftest import SF

from perimetra.llm import graph, simhash

DOCS = "doc_id long, text string, source string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_and_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    parts = plain_components(fps)
    assert got == {i: (fps[i], parts[i]) for i in fps}


def test_close_fingerprints_are_linked_in_long_lists(spark):
    # one dense cloud around a centre, far more than a tile, and stray ones: what the keys give must equal all pairs
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    while len(fps) < 1500:
        x = centre
        for b in rng.integers(0, 63, size=int(rng.integers(1, 4))):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, size=200)}
    fps = dict(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(f, i) for i, f in fps.items()], "fp long, rep long")
    found = {r.node: r.component for r in graph.components(simhash.links(classes)).collect()}
    a = np.array(list(fps.values()), dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while not (new := np.where(near, label[None, :], len(a)).min(axis=1)).tolist() == label.tolist():
        label = new
    assert [found.get(i, i) for i in range(len(a))] == label.tolist()


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (None, " \n", "c"), (7, "One two", "d"), (7, "one TWO", "d"), (9, "x " * 5000, "e"), (None, "alone here now", "f")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.fp == 0, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    want = [(5, True, 3), (3, True, 3), (None, True, 3), (7, False, 7), (7, False, 7), (9, False, 9), (None, False, None)]
    assert got == sorted(want, key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(3, "", "b"), (7, "One two", "d"), (9, "x " * 5000, "e"), rows[2], rows[6]], key=repr)
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)}


def test_a_long_list_is_keyed_anew(spark):
    # all share the lower half, so one key at least has them all; the upper halves are spread, with chains of close ones and one dense cloud
    rng = np.random.default_rng(11)
    upper = {int(x) for x in rng.integers(0, 2**31, size=3000)}
    for x in list(upper)[:300]:
        for _ in range(3):
            for b in rng.integers(0, 31, size=3):
                x ^= 1 << int(b)
            upper.add(x)
    upper |= {0x5A5A0000 ^ int(x) for x in rng.choice(2**16, size=1800, replace=False)}
    fps = dict(enumerate(sorted(x << 32 | 0x12345678 for x in upper)))
    classes = spark.createDataFrame([(f, i) for i, f in fps.items()], "fp long, rep long")
    sizes = [r.n for of in simhash.lists(classes) for r in of.selectExpr("size(of) as n").collect()]
    assert max(sizes) <= 1900 < len(fps) and sum(sizes) < 400 * len(fps)
    found = {r.node: r.component for r in graph.components(simhash.links(classes)).collect()}
    a = np.array(list(fps.values()), dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while not (new := np.where(near, label[None, :], len(a)).min(axis=1)).tolist() == label.tolist():
        label = new
    assert len(set(label.tolist())) > 1000
    assert [found.get(i, i) for i in range(len(a))] == label.tolist()


def test_rows_of_one_id_with_different_texts_both_stay(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "a b c d e f g h i j k " * 9)
    rows = [(5, a, {"k": 1}), (5, b, {"k": 2}), (5, b, {"k": 1}), (6, b, {"k": 3}), (7, c, {"k": 4}), (2**62 + 5, c, {"k": 5}), (2**62 + 9, a, {"k": 6})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    got = sorted((r.doc_id, r.text, r.tags["k"]) for r in simhash.keep_first(docs).collect())
    named = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == sorted([(5, a, 1), (5, b, 1), (7, c, 4)]) and named == {(5, 5), (6, 5), (7, 7), (2**62 + 5, 7), (2**62 + 9, 5)}
    far = docs.where("doc_id > 100")
    assert {r.component_id for r in simhash.near_duplicates(far).collect()} == {2**62 + 5, 2**62 + 9}
    assert simhash.keep_first(docs.where("false")).collect() == []
