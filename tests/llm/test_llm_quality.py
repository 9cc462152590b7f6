import math
import random
import re

from conftest import SF

from perimetra.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed


def test_base_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][n] for n in names) == plain(r.text)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [r.d for r in df.select(quality.distance("p", "q").alias("d")).collect()]
    js = 0.5 * sum(x * math.log2(2 * x / (x + 0.5)) + 0.5 * math.log2(1 / (x + 0.5)) for x in (0.9, 0.1))
    assert got[:2] == [1.0, 0.0] and abs(got[2] - math.sqrt(js)) < 1e-12


def test_junk_goes_and_prose_and_short_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    prose = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    junk = [(10_000 + i, " ".join(f"{k * 7919 + i}%%%$$$###" for k in range(200)), "en") for i in range(3)]
    odd = [(20_000, None, "en"), (20_001, "", None), (20_002, "just ten words of a text that is not long", "xx"), (20_003, "%%% " * 9, "en"), (None, "a b c d e f g h i j k", None)]
    frame = spark.createDataFrame([(*r, 1) for r in prose + junk + odd], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in quality.judged(frame).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i, _, _ in junk)
    assert [got[i].kept for i in (20_000, 20_001, 20_002, 20_003, None)] == [False, False, True, False, True]
    kept = quality.kept(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judged(frame.where("false")).collect() == []


def test_every_language_has_its_own_reference(spark):
    latin = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()]
    russian = "мы вышли рано утром и долго шли вдоль реки пока солнце не поднялось над лесом а ветер гнал по воде мелкую рябь".split()
    greek = "το πρωί περπατήσαμε δίπλα στο ποτάμι και είδαμε τα καράβια που έφευγαν αργά για τα νησιά του νότου".split()
    prose = lambda words, i: " ".join(random.Random(i).choices(words, k=160))
    many = [(30_000 + i, prose(russian, i), "ru") for i in range(12)]
    few = [(31_000 + i, prose(greek, i), "el") for i in range(3)]
    none = [(32_000, prose(russian, 4), None), (32_001, prose(greek, 4), ""), (32_002, prose(russian, 5), " ")]
    junk = [(33_000, " ".join(f"{k * 7919}%%%$$$###" for k in range(200)), "ru")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(latin + many + few + none + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i].base_failed for i, _, _ in many + few + none + junk)
    assert all(got[i].kept and got[i].class_distance is not None and got[i].word_distance is None for i, _, _ in many)
    assert all(got[i].kept and got[i].class_distance is None and got[i].word_distance is None for i, _, _ in few + none)
    assert not got[33_000].kept and got[33_000].class_distance > quality.CLASS_DISTANCE
    # the others are judged as if no other language were there
    alone = {r.doc_id: r for r in quality.judged(spark.createDataFrame(latin, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == alone[i] and (got[i].word_distance is not None or got[i].n_words < 100 or got[i].word_chars < 400) for i, _, _ in latin)
