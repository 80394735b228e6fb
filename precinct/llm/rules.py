"""Quality rules over whole texts as a short-circuit cascade, in DataFrame functions only.

``statistics`` computes what the rules look at.  ``Cascade`` estimates on a sample what each rule costs (seconds a row)
and what share of the rows it rejects, and orders the rules by rejection per cost; in the one CASE made from them, rows
that a rule rejects are not shown to the rules behind it.  The order decides the work, never the verdict.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.session import store

SPACE, WINDOW = r"[\x20\x09-\x0D]+", 8
SAMPLE_ROWS = 2000  # rows that costs and rejections are estimated on, about

# Name -> condition of rejection, over the columns of ``statistics``.
RULES = {
    "symbols": "n_symbols > 0.3 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "repeated_lines": "n_dup_lines > 0.5 * n_lines",
    "shouting": r"regexp_count(text, r'\p{Lu}') > 0.6 * regexp_count(text, r'\p{L}')",
    "exclamation": "regexp_count(text, '!') > 0.5 * n_words",
    "no_letters": r"size(filter(words, w -> w rlike r'\p{L}')) < 0.5 * n_words",
    "stuttering": "size(filter(words, (w, i) -> coalesce(w = get(words, i - 1), false))) > 0.3 * n_words",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Each line is a projection of its own, so that Spark computes an array once and the next line uses it.  Windows of
    eight words are compared by a 64-bit hash of the words' 64-bit hashes, within their text; only texts in which two
    windows agree are sorted to find which.
    """
    df = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.expr(f"filter(split(text, r'{SPACE}'), w -> w <> '')"))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.expr("aggregate(words, 0L, (n, w) -> n + length(w))"),
        "n_symbols": F.expr("cast(regexp_count(text, '[#*$%&|<>]') as long)"),
        "lines": F.expr(r"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"),
        "hashes": F.expr("transform(words, w -> xxhash64(w))")})
    df = df.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": F.expr("cast(size(lines) - size(array_distinct(lines)) as long)"),
        "windows": F.expr(f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64(slice(hashes, i + 1, {WINDOW}))) ELSE cast(array() as array<bigint>) END")})
    df = df.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> struct(h, i))) ELSE cast(array() as array<struct<h: bigint, i: int>>) END"))
    df = df.withColumn("places", F.expr("array_sort(transform(filter(sorted, (x, j) -> coalesce(get(sorted, j - 1).h = x.h, false) or coalesce(get(sorted, j + 1).h = x.h, false)), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.expr(f"aggregate(transform(places, (p, j) -> least({WINDOW}, coalesce(get(places, j + 1) - p, {WINDOW}))), 0L, (n, x) -> n + x)"))
    return df.select("doc_id", "text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass
class Rule:
    name: str
    seconds: float
    rejected: float

    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


class Cascade:
    """Rules in the order of rejection per cost."""

    def __init__(self, docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS):
        self.rules = rules
        total = docs.count()
        part = docs.sample(False, min(1.0, sample_rows / total), seed=1) if total else docs
        sample = store(statistics(part))
        rows = max(1, sample.count())

        def timed(condition: str) -> tuple[float, int]:
            start = time.perf_counter()
            count = sample.agg(F.count_if(F.coalesce(F.expr(condition), F.lit(False))).alias("n")).first().n
            return time.perf_counter() - start, count

        timed("n_words < 0")  # compile and open the files once
        empty = timed("n_words < 0")[0]
        measured = []
        for name, condition in rules.items():
            seconds, count = timed(condition)
            measured.append(Rule(name, max(0.0, seconds - empty) / rows, count / rows))
        self.order = sorted(measured, key=lambda r: (-r.worth(), r.name))

    def accepts(self) -> Column:
        """True if no rule rejects; a rule is evaluated only for rows that all before it let pass."""
        verdict = None
        for rule in self.order:
            condition = F.coalesce(F.expr(self.rules[rule.name]), F.lit(False))
            verdict = F.when(condition, False) if verdict is None else verdict.when(condition, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge(docs: DataFrame, cascade: Cascade) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts and texts of white space have no words and fail.  Rows that repeat a doc_id are judged each.
    Empty table: no rows.  Nothing is shuffled: each row is judged by itself.
    """
    judged = statistics(docs).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.when(F.col("base_failed"), False).otherwise(cascade.accepts()).alias("kept"))
