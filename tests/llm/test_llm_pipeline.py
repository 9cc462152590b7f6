"""The pipeline on a small corpus of which every row's fate is known, stage by stage and at once."""

import os
import random
import sys

import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SECRET = "token=abcdef0123456789"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, Found int, spans string, tags map<string,int>"


def prose(seed, words=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8))) for _ in range(words)).capitalize() + "."


PASSAGE = prose(99, 13).lower().rstrip(".")
#: (doc_id, text, what becomes of the text; None: the row goes)
ROWS = [
    (1, prose(1), prose(1)),
    (2, prose(1), None),  # a copy
    (3, f"{prose(3)} {PASSAGE} {prose(4)}", None),  # 13 of 93 words are a benchmark passage
    (4, f"{prose(5)} {SECRET} {prose(6)}", f"{prose(5)} [secret] {prose(6)}"),
    (5, "too few words", None),
    (6, None, None),
    (7, prose(7), prose(7)),  # one id, two documents
    (7, prose(8), prose(8)),
    (None, prose(9), prose(9)),
    (8, "", None),
    (9, " ".join(["same words again and again"] * 9), None),  # repeats itself
    (10, prose(10, 6000), prose(10, 6000)),
    (11, f"{PASSAGE[:20]} {prose(11)}", f"{PASSAGE[:20]} {prose(11)}"),  # less than a window of the passage
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en" if k % 2 else None, "web", None if t is None else len(t), k, "x", {"k": k}) for k, (i, t, _) in enumerate(ROWS)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench = [("a", PASSAGE), ("b", None), (None, "some words that nobody says here in a row of more than thirteen of them")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_gives_the_pieces_of_what_stays(spark, corpus):
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    want = [(i, lib.encode(t)) for i, _, t in ROWS if t is not None]
    got = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_written_and_read_again(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    gone = {"quality_rules": {5, 6, 8, 9}, "simhash_near_dedup": {2}, "benchmark_decontamination": {3}, "secret_scans": set(), "sentencepiece": set()}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(gone)
    ids = sorted((r.doc_id for r in docs.collect()), key=repr)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [i for i in ids if i not in gone[name]]
        assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr) == ids, name
        if name != "sentencepiece":
            assert out.columns == docs.columns
        docs = out
        if name == "secret_scans":
            masked = out.filter("doc_id = 4").first()
            assert SECRET not in masked.text and masked.n_chars == len(masked.text) and masked.tags == {"k": 3}


def test_an_empty_corpus(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
