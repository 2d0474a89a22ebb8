"""Operator 6, line-first quality rules, in DataFrame functions only.

Every line of a text that holds a word is judged by itself; failing lines are removed, and a document
that loses more than ``MAX_LOST`` percent of its words is rejected. The base rules (too few words,
too much repeated text) are judged on the text as given.

Line rules (a line fails when one holds):

* symbols: over ``MAX_SYMBOLS`` percent of its characters are of ``[#*$%&|<>]``;
* shouting: at least 3 ``!`` or ``?``, and one for every 3 words or more;
* navigation: at least 2 separators (``|``, ``»``, ``›``, ``·``), and one for every 4 words or more;
* boilerplate: under 25 words and a fixed notice phrase;
* repetition: at least 10 words, under a quarter of them distinct;
* no sentence: under 3 words and no mark ``. ! ? : ;`` at its end (ASCII or wide forms).

Defined results: null text = empty text: no words, base-failed, not kept, cleaned text empty. Every
row gets its own result, repeated rows and rows without id included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED = 50, 50
MAX_LOST, MAX_SYMBOLS = 50, 8
# Notice phrases of web and licence boilerplate
NOTICES = ["all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
           "use cookies", "click here", "enable javascript", "sign up for", "subscribe to our", "back to top", "general public license"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable, never inlined per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows found twice or more in the text (the first occurrence included)."""
    def windows(h: Column) -> Column:
        two = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(h, F.lit(3), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.slice(three, F.lit(1), F.size(h) - 2)

    def covered(keys: Column) -> Column:
        at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        pairs = let(at, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"]))))
        starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        def total(s: Column) -> Column:
            gaps = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g)
        return let(starts, total)

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    counted = let(let(hashed, windows), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys)))
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(counted)


def _count(text: Column, marks: str) -> Column:
    return F.regexp_count(text, F.lit(marks))


def line_fails(line: Column) -> Column:
    def judge(ws: Column) -> Column:
        n = F.size(ws)
        marks = _count(line, r"[!?]")
        separators = _count(line, r"[|»›·]")
        low = F.lower(line)
        notice = F.lit(False)
        for phrase in NOTICES:
            notice = notice | F.contains(low, F.lit(phrase))
        return (
            (_count(line, r"[#*$%&|<>]") * 100 > F.length(line) * MAX_SYMBOLS)
            | ((marks >= 3) & (marks * 3 >= n))
            | ((separators >= 2) & (separators * 4 >= n))
            | ((n < 25) & notice)
            | ((n >= 10) & (F.size(F.array_distinct(ws)) * 4 < n))
            | ((n < 3) & ~F.btrim(line, F.lit(BLANKS)).rlike(r"[.!?:;。！？：；…]$"))
        )
    return let(words(line), judge)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base figures, ``n_kept_words``, ``cleaned_text``, ``base_failed`` and ``kept``.

    Extra columns pass through; the operator's own columns replace columns of the same names."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text", "n_kept_words"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], body.alias("__body"), words(body).alias("__words"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    base = base.withColumn("__lines", F.filter(F.split(F.col("__body"), "\n"), has_word))
    ws, lines = F.col("__words"), F.col("__lines")
    base = base.select(
        "*",
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        _count(F.col("__body"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    base = base.withColumn("n_kept_words", F.size(words(F.col("cleaned_text"))).cast("long")).withColumn("base_failed", failed)
    lost = (F.col("n_words") - F.col("n_kept_words")) * 100 > F.col("n_words") * MAX_LOST
    return base.withColumn("kept", ~F.col("base_failed") & ~lost).drop("__body", "__words", "__lines")
