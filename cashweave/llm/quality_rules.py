"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Every rule is a DataFrame expression. On a bounded random sample each rule is timed and its
rejection rate counted; the cascade is one CASE expression that tries the rules with the most
rejections per second first and stops at the first that rejects. The order changes only the
work: a text is kept if no rule rejects it, in whatever order they are tried.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import SPACE, let, pick, stored, words

#: Expected rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 1_000
#: Timed runs of a rule over the sample, and how often each row is in it.
RUNS, REPEAT = 3, 4
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(word_list: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the list.

    Windows are compared by 64-bit hashes chained over their words. A list without equal
    windows, the usual case, is settled by one hash set; else the (hash, position) pairs
    are sorted, equal neighbours give the repeated positions, and each position covers the words up
    to the next one, ``width`` at most.
    """
    def windows(w):
        return F.when(F.size(w) >= width, F.transform(
            F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(width)))))

    def covered(positions):
        return F.aggregate(
            F.transform(positions, lambda p, i: F.least(F.lit(width), F.coalesce(
                F.get(positions, i + 1) - p, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(F.transform(s, lambda e, i: F.when(
            F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)), e["i"])), lambda p: p.isNotNull()))
        return let(F.sort_array(twice), covered)

    return F.coalesce(let(windows(word_list), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), repeated(h))), F.lit(0)).cast("long")


def base_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and the counts every rule starts from; NULL text counts as empty."""
    rows = pick(docs, key, text).withColumn(text, F.coalesce(text, F.lit("")))
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = rows.select(
        key, text, let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                    repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"),
        _without(t, f"[{SPACE}]+").cast("long").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"))
    counted = counted.select(
        key, text, "_w.n_words", "word_chars", "n_symbols", (F.col("_l.n") - F.col("_l.d")).cast("long")
        .alias("n_dup_lines"), "_w.n_repeat_words", F.col("_l.n").cast("long").alias("n_lines"))
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is a Boolean Column over :func:`base_metrics`' columns."""

    name: str
    rejects: Callable[[Column], Column]


RULES = (
    Rule("capitals", lambda t: let(F.length(F.regexp_replace(t, r"[^A-Z]+", "")), lambda up: (up >= 20) & (
        2 * up > F.length(F.regexp_replace(t, r"[^A-Za-z]+", ""))))),
    Rule("dup_lines", lambda t: (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
    Rule("symbols", lambda t: 10 * F.col("n_symbols") > 2 * F.col("n_words")),
    Rule("word_length", lambda t: (F.col("word_chars") < 2 * F.col("n_words"))
         | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("shouting", lambda t: 5 * F.regexp_count(t, F.lit(r"[!?]{2,}")) > F.col("n_words")),
    Rule("few_letters", lambda t: 2 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < F.col("word_chars")),
    Rule("top_word", lambda t: 5 * F.size(F.array_distinct(F.split(F.lower(t), f"[{SPACE}]+"))) < F.least(
        F.col("n_words"), F.lit(500))),
)


def plan(metrics: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple]:
    """(rule, seconds, rejection rate) in the order to try, from about ``rows`` random rows.

    The sample is drawn from the rows that get as far as the cascade and is stored once. Each rule runs alone over
    it: once to compile, then RUNS times over each row REPEAT times, of which the shortest counts. The rate is
    (rejected + 1) / (rows + 2), so that cost alone orders rules that reject nothing. Without rows the given order stays.
    """
    total = metrics.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = stored(metrics.sample(min(1.0, 1.2 * rows / total), 7).filter(~F.col("base_failed")), "rules-sample")
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def timed(condition):
        n, hits = sample.agg(F.count(F.lit(1)), F.count_if(condition)).first()
        seconds = []
        for _ in range(RUNS):
            began = time.perf_counter()
            again.agg(F.count(F.lit(1)), F.count_if(condition)).first()
            seconds.append(time.perf_counter() - began)
        return min(seconds), (hits + 1) / (n + 2)

    idle = timed(F.lit(False))[0]
    found = [(r, *timed(r.rejects(F.col(text)))) for r in rules]
    found = [(r, max(s - idle, 1e-4) / REPEAT, rate) for r, s, rate in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES,
                order: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, the base counts, base_failed, and kept.

    A text that fails the base is not kept and never reaches the cascade; else it is kept if no
    rule rejects it. Very long texts are judged whole. ``order`` gives the rules in a known order and saves the sample. NULL and empty texts
    have no words, so they fail the base; repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored. No shuffle: one pass over the texts (two with the sample).
    """
    metrics = base_metrics(docs, key, text)
    if order is None:
        narrow = pick(docs, key, text)
        total = narrow.count()
        drawn = narrow.sample(min(1.0, 1.2 * SAMPLE_ROWS / total), 7) if total else narrow
        order = [r for r, _, _ in plan(stored(base_metrics(drawn, key, text), "rules-drawn"), text, rules)]
    kept = F.when(F.col("base_failed"), False)
    for rule in order:
        kept = kept.when(rule.rejects(F.col(text)), False)
    return metrics.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                          kept.otherwise(True).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
         unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k
  FROM d WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.t, d.w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up,
         length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS az
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (up >= 20 AND 2 * up > az) OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
            OR 10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 5 * len(regexp_extract_all(t, '[!?]{2,}')) > n_words
            OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
            OR 5 * len(list_distinct(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'))) < least(n_words, 500)) AS kept
FROM b
"""
