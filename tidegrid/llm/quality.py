"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A document is kept when no rule rejects it.  The rules' order does not change that, only the work: each rule's cost
and rejection rate are estimated on a sample, rules run by falling rejection per cost, and a rejected document skips
the rest.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import words

# fixed values
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """``rejects`` is a condition over ``text`` and the measures of ``measured``."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * size(split(text, '\n'))"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words"),
    Rule("upper_case", "length(text) > 100 AND 10 * length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > 5 * length(regexp_replace(text, '[^\\\\p{L}]+', ''))"),
    Rule("no_letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]+', '')) < word_chars"),
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(tokens: Column, n: int = WINDOW) -> Column:
    """How many words lie in ``n``-word windows that occur twice or more in the same text.

    Windows are compared by 64-bit hash; sorting them costs n log n, also where all are alike.
    """
    hashes = _let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(n)])),
    )

    def covered(ordered):
        at = lambda i: F.get(ordered, i)["h"]
        twice = F.filter(ordered, lambda e, i: F.coalesce(at(i - 1) == e["h"], F.lit(False)) | F.coalesce(at(i + 1) == e["h"], F.lit(False)))
        return _let(
            F.sort_array(F.transform(twice, lambda e: e["i"])),
            lambda places: F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(places, j + 1) - p, F.lit(n)))), F.lit(0).cast("bigint"), lambda a, x: a + x),
        )

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(tokens) > n, found).otherwise(F.lit(0).cast("bigint"))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text`` and the base measures of every whole text; NULL counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    return rows.withColumn(
        "m",
        _let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))),
    ).select(
        F.col(f"`{id_col}`"),
        "text",
        "m.n_words",
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("n_dup_lines"),
        "m.n_repeat_words",
    )


def order_rules(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules with their seconds and rejection rate on a measured sample, by falling rejection per cost."""
    sample = sample.cache()
    try:
        sample.count()
        rates = sample.agg(*[F.avg(F.expr(r.rejects).cast("double")).alias(r.name) for r in rules]).first()
        costs = {}
        for r in rules:
            began = time.perf_counter()
            sample.filter(F.expr(r.rejects)).count()
            costs[r.name] = time.perf_counter() - began
    finally:
        sample.unpersist()
    return sorted(((r, costs[r.name], rates[r.name] or 0.0) for r in rules), key=lambda x: -x[2] / x[1])


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them repeated.
    ``rejected_by`` names the first rule of the cascade that rejects (NULL if none, ``base`` if the base fails); which
    one is first depends on the order found on about ``sample_rows`` rows, ``kept`` does not.  NULL and empty texts
    fail the base; repeated rows give a row each; other columns are left out.  No shuffle and no Python.
    """
    rows = measured(df, id_col, text_col)
    total = df.count()
    ranked = order_rules(measured(df.sample(min(1.0, sample_rows / max(1, total)), 1), id_col, text_col), rules)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    verdict = F.when(F.col("base_failed"), "base")
    for rule, _, _ in ranked:
        verdict = verdict.when(F.expr(rule.rejects), rule.name)
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", verdict)
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
