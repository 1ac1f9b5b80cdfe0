"""Quality rules as one projection (native Spark expressions only).

``RULES`` is the threshold table: (measure, least, most). ``quality_rules`` compiles it, with the
measures it names, into a single projection over the documents: no shuffle, no Python.

Null or blank text: all counts 0, base_failed true, kept false. A null doc_id, repeated rows and
extra columns pass through without effect: each input row gives one output row, and an empty table none. A very
long text is taken whole; its words and windows are arrays of one row, at about a hundred bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP_PATTERN, split_words

#: Fixed word list: frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "was", "for", "on", "that", "with", "as", "it", "be", "by", "this", "are",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "sur", "par",
    "der", "die", "und", "den", "das", "zu", "mit", "von", "ist", "ein", "eine", "im", "auf", "sich", "nicht",
    "el", "y", "los", "del", "se", "las", "por", "con", "para", "su", "es", "una", "al", "lo", "o",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: measure, least allowed, most allowed (None: no bound). Ratios of a document without words are null and pass.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 15.0),
    ("symbols_per_word", None, 0.25),
    ("dup_line_share", None, 0.5),
    ("stop_word_share", 0.02, None),
    ("repeat_word_share", None, 0.3),
)


def _let(value: Column, use) -> Column:
    """Evaluate value once, then use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur at least twice in the array.

    Windows compare by a 64-bit hash built by doubling (1, 2, 4, 8 words). Sorted (hash, start)
    pairs show the repeated starts; each repeated start adds the words that the one before it,
    in text order, has not covered yet.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return _let(
            hashes,
            lambda h: F.zip_with(
                F.slice(h, F.lit(1), F.size(h) - step),
                F.slice(h, F.lit(step + 1), F.size(h) - step),
                lambda a, b: F.xxhash64(a, b),
            ),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = doubled(hashes, step)

    def starts(pairs: Column) -> Column:
        last = F.size(pairs) - 1

        def twin(pair: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(pairs, i - 1)["h"] == pair["h"])
            after = (i < last) & (F.get(pairs, i + 1)["h"] == pair["h"])
            return before | after

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def covered(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            _let(pairs, starts),
            lambda at: F.aggregate(
                F.transform(at, lambda s, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), s - F.get(at, k - 1)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    any_twice = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(any_twice)


def _verdict(rules) -> Column:
    ok = F.lit(True)
    for measure, least, most in rules:
        if least is not None:
            ok = ok & F.coalesce(F.col(measure) >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(F.col(measure) <= most, F.lit(True))
    return ok


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the ratios."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        split_words(body).alias("words"),
        F.length(F.regexp_replace(body, GAP_PATTERN, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    ).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).alias("n_stop_words"),
    )
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    measured = counted.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_share"),
        (F.col("n_stop_words") / n).alias("stop_word_share"),
        (F.col("n_repeat_words") / n).alias("repeat_word_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & _verdict(rules)).alias("kept"),
        "mean_word_chars", "symbols_per_word", "dup_line_share", "stop_word_share", "repeat_word_share",
    )
