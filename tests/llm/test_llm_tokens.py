import random

import public_tokenizers
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from perimetra.llm import pieces, tokencount

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = list(" \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0　​'stremvlld019.,!?-_#ae") + ["<|endoftext|>", "'ll", "'re", "  ", "don't", "é", "日本", "😀", "²", "\x00", "the ", " and"]


def texts(n, bits, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(bits) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_counts_of_texts_and_prefixes_equal_the_library():
    lib, own = Tokenizer.from_file(BYTES), tokencount.Counter(BYTES)
    count = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    for s in texts(300, BITS, 25):
        want = [count(s[:i]) for i in range(len(s) + 1)]
        assert own.count(s) == want[-1]
        assert own.prefix_counts(s).tolist() == want
        for limit in (0, 1, 4, 9):
            assert own.longest_within(s, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_token_counts_of_documents(spark):
    lib = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in tokencount.token_counts(docs, BYTES).collect()}
    for r in docs.collect():
        n = len(lib.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 512)
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "a b", 3), (2, "a b", 3)], "doc_id long, text string, n_tokens int")
    assert sorted((tuple(r) for r in tokencount.token_counts(odd, BYTES, 1).collect()), key=repr) == sorted(
        [(1, 0, 0, False, 0), (None, 0, 0, False, 0), (2, 3, 2, True, 1), (2, 3, 2, True, 1)], key=repr
    )
    assert tokencount.prefix_counts(odd.where("doc_id = 2").limit(1), BYTES).first().counts == [0, 1, 2, 2]
    assert tokencount.token_counts(odd.where("false"), BYTES).collect() == []


def test_pieces_and_chunks_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    bits = ["the", "tion", " ", "  ", "    ", "▁", "é", "日", "😀", "a", "1", "\n", "----", "***", "=", "Hello", "ing", "\x00", "ﬁ", "x" * 40]
    rows = texts(60, bits, 40, 2) + [c * n for c in " -a=" for n in (1, 7, 50)] + [None, "", "w" * 3000, "日本語" * 400]
    rows += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(None, "twice", "x"), (None, "twice", "x")], "doc_id long, text string, ids string")
    for chunk in (3, 20, 100, 16_384):
        got = sorted(((r.doc_id, r.ids) for r in pieces.encoded(docs, MODEL, chunk).collect()), key=repr)
        assert got == sorted([*((i, lib.encode(t or "")) for i, t in enumerate(rows)), (None, lib.encode("twice")), (None, lib.encode("twice"))], key=repr)
    back = pieces.decoded(pieces.encoded(docs, MODEL), MODEL)
    assert all(r.text == lib.decode(r.ids) for r in back.collect())
    assert pieces.encoded(docs.where("false"), MODEL).collect() == []


def test_transfer_matrices_combine_associatively():
    import numpy as np

    model, text = pieces.Pieces(MODEL), pieces.normalized("internationalization" * 6)
    cuts = [0, 20, 33, 70, len(text)]
    parts = []
    for lo, hi in zip(cuts, cuts[1:]):
        lead = min(lo, model.longest)
        parts.append(model.transfer(text[lo - lead : hi + model.longest], lead, lead + hi - lo, hi == len(text)))
    whole = model.transfer(text, 0, len(text), True)[2]

    def aligned(a, b):
        place = {k: i for i, k in enumerate(b[0])}
        m = np.stack([b[2][place[k]] for k in a[1]])
        return (a[0], b[1], pieces.combined(a[2], m))

    left = aligned(aligned(aligned(parts[0], parts[1]), parts[2]), parts[3])
    right = aligned(parts[0], aligned(parts[1], aligned(parts[2], parts[3])))
    assert left[2].tolist() == right[2].tolist() == whole.tolist()


def test_prefix_counts_with_separators_that_are_no_white_space():
    lib, own = Tokenizer.from_file(BYTES), tokencount.Counter(BYTES)
    for s in texts(1500, list("\x1c\x1d\x1e\x1f \n a'1"), 8, seed=4):
        want = [len(lib.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert own.prefix_counts(s).tolist() == want, repr(s)
