"""Quality rules by divergence: how far a document's character classes and common words are from those of its language.

DataFrame functions only. One pass over the texts makes a short row of counts for each document; those rows are written once, the references
are means over all documents that pass the base rules, and the Jensen-Shannon distances come from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import settled

#: White space that separates words, and characters counted as symbols.
SPACES = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: Frequent function words of the languages that have a reference by words too.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "en": "the of and to in is that it for on was be with as by this at from".split(),
    "es": "de la que el en y los del se las por un para con no una su es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au il".split(),
}
#: Documents below these lengths are not judged by divergence.
LEAST_WORDS = 100
LEAST_CHARS = 400
#: A language with fewer good documents of that length has no reference.
LEAST_GOOD = 10
#: Largest Jensen-Shannon distance (0 to 1) of a kept document by character classes, and largest sum of that and the one by common words.
CLASS_DISTANCE = 0.30
BOTH_DISTANCES = 0.42
#: Base rules: fewest words, and the largest share in percent of words in repeated five-word windows.
MIN_WORDS = 10
MAX_REPEATED = 20
_WINDOW = 5
_CLASSES = 6


def _length_without(text: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """`(doc_id, lang, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common)` for every row of `docs(doc_id, text, lang)`.

    `classes` counts lower, upper, digit, white, other ASCII characters and extra bytes of non-ASCII ones; `common` counts the words
    of the document's list in `COMMON` and then all others, and is null where the language has no list. `row` holds the whole input
    row if `carry` is set.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    row = (F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("boolean")).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), row)
    rows = rows.withColumn("trimmed", F.btrim("t", F.lit(SPACES)))
    rows = rows.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", _SPLIT))).drop("trimmed")
    lines = F.filter(F.split("t", "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    starts = F.when(F.size("w") >= _WINDOW, F.sequence(F.lit(0), F.size("w") - _WINDOW)).otherwise(F.array().cast("array<int>"))
    table = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = sorted({x for v in COMMON.values() for x in v})
    rows = rows.select(
        "doc_id",
        "lang",
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        _length_without("t", _NOT_SYMBOLS).alias("n_symbols"),
        _length_without("t", "[^a-z]+").alias("n_lower"),
        _length_without("t", "[^A-Z]+").alias("n_upper"),
        _length_without("t", "[^0-9]+").alias("n_digit"),
        lines.alias("lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(_WINDOW)])).alias("h"),
        F.filter("w", lambda x: x.isin(known)).alias("known"),
        F.element_at(table, F.col("lang")).alias("list"),
    )
    # repeated windows: their starts by hash and place, then the places in order; most documents have none
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("again", F.size("h") > F.size(F.array_distinct("h")))
    rows = rows.withColumn("z", F.when(F.col("again"), pairs)).drop("h")
    near = lambda k, by: F.coalesce(F.get("z", k + by)["h"] == F.get("z", k)["h"], F.lit(False))
    rows = rows.withColumn("p", F.when(F.col("again"), F.sort_array(F.transform(F.filter("z", lambda x, k: near(k, -1) | near(k, 1)), lambda x: x["i"]))))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-_WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(_WINDOW), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    counts = F.transform("list", lambda c: F.size(F.filter("known", lambda x: x == c)).cast("long"))
    rows = rows.withColumn("counts", counts)
    white = F.col("n_chars") - F.col("word_chars")
    extra = F.col("n_bytes") - F.col("n_chars")
    seen = [F.col("n_lower"), F.col("n_upper"), F.col("n_digit"), white]
    rest = F.greatest(F.lit(0).cast("long"), F.col("n_chars") - sum(seen[1:], seen[0]) - extra)
    return rows.select(
        "doc_id",
        "lang",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array(*seen, rest, extra).alias("classes"),
        F.when(
            F.col("list").isNotNull(),
            F.concat("counts", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)))),
        ).alias("common"),
    )


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def distance(p: str, q: str) -> Column:
    """The Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judged(docs: DataFrame, carry: bool = False) -> DataFrame:
    """`features` with `base_failed`, the distances `class_distance` and `word_distance`, and `kept`, for every row of `docs(doc_id, text, lang)`.

    A document is kept if it passes the base rules and its distances are not over their limits. The reference of a document is the mean of the
    good documents of its own `lang`, whatever that is. Distances are null, and do not count, for documents under `LEAST_WORDS` words or
    `LEAST_CHARS` characters in words, for documents of no language (null or blank) or of one with fewer than `LEAST_GOOD` good
    documents, and, by words, for languages without a list in `COMMON`. Null and empty texts have no
    words and fail the base rules. Rows are neither merged nor dropped; an empty table gives none; other columns are ignored.
    """
    rows = settled(features(docs, carry).withColumn("base_failed", base_failed()))
    rows = rows.withColumn("own", F.when(F.btrim("lang") != "", F.col("lang")))
    rows = rows.withColumn("by_class", _shares("classes")).withColumn("by_word", _shares("common"))
    enough = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_chars") >= LEAST_CHARS)
    good = rows.where(enough & ~F.col("base_failed"))
    mean = lambda c, n: F.array(*[F.coalesce(F.round(F.avg(F.get(c, F.lit(i)).cast("decimal(20,12)")), 9), F.lit(0)).cast("double") for i in range(n)])
    width = max(map(len, COMMON.values())) + 1
    # one row for each language, written so that its size is known: Spark sends a small table to every task and splits skewed sides otherwise
    own = good.where("own is not null").groupBy("own").agg(F.count("*").alias("n_good"), mean("by_class", _CLASSES).alias("ref_class"), mean("by_word", width).alias("ref_word"))
    refs = settled(own.where(F.col("n_good") >= LEAST_GOOD).select("own", "ref_class", F.when(F.col("own").isin(*COMMON), F.col("ref_word")).alias("ref_word")))
    rows = rows.join(refs, "own", "left")
    rows = rows.withColumn("class_distance", F.when(enough & F.col("ref_class").isNotNull(), distance("by_class", "ref_class")))
    rows = rows.withColumn("word_distance", F.when(enough & F.col("ref_word").isNotNull(), distance("by_word", "ref_word")))
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (by_class > CLASS_DISTANCE) | (by_class + by_word > BOTH_DISTANCES)
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", "lang", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"
    )


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, unchanged. They are written once with their counts, so that no join has to find them again."""
    return judged(docs, carry=True).where("kept").select("row.*")
