"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every column is row-local, so the plan is a scan, projections and nothing else: no shuffle, and no
key that could be hot. Arrays of words live only inside a task's current row.

Defined cases: a null or empty text has no words and fails (``n_words`` 0). Repeated rows and ties
are judged alike, an empty table gives an empty table, and other columns are carried along by
``quality_filter`` under their own names (working columns are named ``__q_*``). ``score_quality``
returns only its own columns besides ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import count_words, free_name, split_words, trimmed, without_space

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from or an not have "
    "der die und den von zu das sich mit des auf für ist im nicht dem ein eine als auch es "
    "de la le et les en un du une que est pour par dans avec qui pas sur au ce il "
    "el y los las se del por con no una su para al lo como más o"
).split()

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures must lie within [low, high]; None leaves a side open. A zero denominator passes."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are the columns made by :func:`measures`.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.002, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
)
MIN_WORDS = 50
_WS = r"' \t\n\u000b\f\r'"


def measures(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """``docs`` with one column per measure, each named ``prefix`` + measure."""
    p = prefix
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumns(
        {
            f"{p}w": split_words(trimmed(t)),
            f"{p}n_words": count_words(trimmed(t)),
            f"{p}word_chars": F.length(without_space(t)).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            f"{p}lines": F.filter(F.split(t, "\n", -1), lambda x: trimmed(x) != ""),
        }
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    out = out.withColumns(
        {
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{p}n_stop_words": F.expr(f"size(filter({p}w, x -> lower(x) IN ({stop})))").cast("long"),
            # 64-bit hashes of the 3-word windows, by position
            f"{p}h": F.expr(
                f"CASE WHEN size({p}w) >= 3 THEN transform(sequence(0, size({p}w) - 3), "
                f"i -> xxhash64({p}w[i], {p}w[i + 1], {p}w[i + 2])) ELSE array() END"
            ).cast("array<bigint>"),
        }
    ).drop(f"{p}lines")
    # Only a text that repeats a window is sorted; its equal windows are then neighbours.
    out = out.withColumn(
        f"{p}s",
        F.expr(
            f"CASE WHEN size(array_distinct({p}h)) < size({p}h) "
            f"THEN array_sort(transform({p}h, (x, i) -> struct(x AS h, i AS i))) END"
        ),
    )
    out = out.withColumn(
        f"{p}n_repeat_words",
        F.expr(
            f"CASE WHEN {p}s IS NULL THEN 0 ELSE size(array_distinct(flatten(transform(filter({p}s, (e, k) -> "
            f"coalesce(get({p}s, k - 1).h = e.h, false) OR coalesce(get({p}s, k + 1).h = e.h, false)), "
            f"e -> array(e.i, e.i + 1, e.i + 2))))) END"
        ).cast("long"),
    )
    return out.drop(f"{p}w", f"{p}h", f"{p}s")


def verdict(prefix: str = "__q_", rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The base failure, and whether the text is kept (false if the base rules fail)."""
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > 50 * n)
    passes = F.lit(True)
    for r in rules:
        over, under = F.col(f"{prefix}{r.over}").cast("double"), F.col(f"{prefix}{r.under}").cast("double")
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (over >= r.low * under)
        if r.high is not None:
            ok = ok & (over <= r.high * under)
        passes = passes & ((under == 0) | ok)
    return failed, ~failed & passes


def score_quality(docs: DataFrame) -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``."""
    m = measures(docs.select("doc_id", "text"))
    failed, kept = verdict()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in names], failed.alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    A plain filter would be pushed below the projections, where each use of an array computes it anew;
    a row is dropped by exploding an empty array instead.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    prefix = free_name(docs, "q_")
    once = F.when(verdict(prefix)[1], F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return measures(docs, prefix=prefix).select(*own, F.explode(once).alias(f"{prefix}kept")).select(*own)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
          SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, len(w) AS n_words,
        len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
      FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words
  AND n_symbols <= 0.1::DOUBLE * n_words AND n_stop_words >= 0.002::DOUBLE * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_repeat_words <= 0.5 * n_words AS kept
FROM f
""".replace("{stop}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
