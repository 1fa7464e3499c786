"""Benchmark decontamination by winnowing: shared fingerprints are joined and extended to whole windows.

A text's k-grams of six words are hashed, and of each five neighbouring hashes the least is kept. Ten words
hold five such k-grams, so two equal runs of ten words keep the same least hash: every shared span of ten
words has a shared fingerprint, whatever stands around it. Fingerprints of documents are joined with those
of the benchmark. Only texts with a shared one are looked at again: each place of a shared fingerprint is
extended to the ten words that it stands for, and these are compared as words, so that no hash decides.
Items of fewer than ten words are one window each; their fingerprint is the hash of all their words, at
every place, and only lengths that the benchmark has are looked for.

Plan: texts are split once, and a slim table (id, digest of the text, number of words, fingerprints) is
written. A text is known by its digest, so copies of a text are extended once. Windows that many items
share are one window. The joins with fingerprints and with contaminated texts broadcast only below
``BROADCAST_ROWS`` rows of fixed width (counted); beyond that they are shuffled on hashes. Windows as words
have no fixed width: there Spark's own threshold on the written table's size decides.

Defined cases: a null text has no words and no hit, as has one of separators only; items with null or
such texts have no window. Repeated documents give repeated rows; repeated item ids count once for a
document and repeated rows of an item are one. A null item_id counts as an item of its own for ``n_items``
and is not in the joined ids. Ties of hashes keep one value, whose places are all extended. Very long texts
are arrays of their words, one row a text. Empty tables give an empty table, or rows without hits; other
columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import ascii_lower, written

WINDOW = 10
KGRAM = 6
#: Rows (of at most 100 bytes each) that are broadcast at most, after they are counted.
BROADCAST_ROWS = 500_000
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _words() -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), _SPLIT, -1), "")


def _grams(n: int, window: int) -> str:
    """SQL: hashes of all n-grams of ``__h``, in order of their places; the window's length is part of a hash."""
    parts = ", ".join(f"get(__h, i + {j})" for j in range(n))
    return f"CASE WHEN size(__h) >= {n} THEN transform(sequence(0, size(__h) - {n}), i -> xxhash64({window}, {parts})) ELSE array() END"


def _kept() -> str:
    """SQL: of each window of ten words the least hash of its k-grams ``__g``, in order of the windows' places."""
    span = WINDOW - KGRAM
    parts = ", ".join(f"get(__g, i + {j})" for j in range(span + 1))
    return f"CASE WHEN size(__g) > {span} THEN transform(sequence(0, size(__g) - {span + 1}), i -> least({parts})) ELSE array() END"


def _fingerprints(words: DataFrame, short: list[int]) -> DataFrame:
    """``words`` with an array ``__f<m>`` of fingerprints by place for windows of ten words and of each length in ``short``."""
    df = words.withColumn("__h", F.expr("transform(__w, x -> xxhash64(x))"))
    df = df.withColumn("__g", F.expr(_grams(KGRAM, WINDOW))).withColumn(f"__f{WINDOW}", F.expr(_kept()).cast("array<bigint>"))
    for m in short:
        df = df.withColumn(f"__f{m}", F.expr(_grams(m, m)).cast("array<bigint>"))
    return df.drop("__h", "__g")


def _small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint, if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _windows_of_items(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item, fingerprint, the window's words joined), each once, and the lengths of items of fewer than ten words."""
    items = benchmark.select("item_id", _words().alias("__w")).filter(F.size("__w") > 0)
    short = sorted(r[0] for r in items.filter(F.size("__w") < WINDOW).select(F.size("__w")).distinct().collect())  # nine lengths at most
    df = _fingerprints(items, short)
    for m in short:  # an item of fewer words has one window
        df = df.withColumn(f"__f{m}", F.expr(f"IF(size(__w) = {m}, __f{m}, array())"))
    lists = ", ".join(f"transform(__f{m}, (f, i) -> struct(f AS __f, array_join(slice(__w, i + 1, {m}), ' ') AS __words))" for m in (WINDOW, *short))
    return written(df.select("item_id", F.expr(f"inline(concat({lists}))")).distinct(), "windows"), short


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, the hit ones, the items found in it and whether it is contaminated."""
    windows, short = _windows_of_items(benchmark)
    prints = _small(written(windows.select("__f").distinct(), "prints"))
    lengths = (WINDOW, *short)

    split = _fingerprints(docs.select("doc_id", _digest().alias("__t"), _words().alias("__w")), short)
    base = written(split.select("doc_id", "__t", F.size("__w").cast("long").alias("n_words"), *[f"__f{m}" for m in lengths]), "fingerprints")

    # places of shared fingerprints, by text
    places = [base.select("__t", F.posexplode(f"__f{m}").alias("s", "__f")).join(prints, "__f", "left_semi").select("__t", "s", F.lit(m).alias("m")) for m in lengths]
    shared = reduce(DataFrame.unionByName, places).distinct().groupBy("__t").agg(F.collect_list(F.struct("s", "m")).alias("__at"))
    shared = written(shared, "shared")

    # each is extended to its window, and the windows are compared as words
    texts = docs.select(_digest().alias("__t"), "text").join(_small(shared.select("__t")), "__t", "left_semi").dropDuplicates(["__t"])
    spans = texts.join(shared, "__t").select("__t", "__at", _words().alias("__w"))
    spans = spans.select("__t", F.expr("inline(transform(__at, a -> struct(a.s AS s, a.m AS m, array_join(slice(__w, a.s + 1, a.m), ' ') AS __words)))"))
    found = written(spans.join(windows.select("__words").distinct(), "__words", "left_semi").select("__t", "s", "m", "__words"), "hits")

    # overlapping spans are united in order of their starts
    fold = (
        "aggregate(array_sort(collect_set(struct(s, m))), named_struct('e', 0, 'n', 0L), "
        "(acc, x) -> named_struct('e', greatest(acc.e, x.s + x.m), 'n', acc.n + greatest(0, x.s + x.m - greatest(acc.e, x.s))), acc -> acc.n)"
    )
    hit = found.groupBy("__t").agg(F.expr(fold).alias("__hit"))
    by_item = found.select("__t", "__words").distinct().join(windows.select("item_id", "__words").distinct(), "__words").select("__t", "item_id").distinct()
    named = by_item.groupBy("__t").agg(
        F.count(F.lit(1)).alias("__items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("__ids"),
    )
    result = _small(written(hit.join(named, "__t"), "contaminated"))
    return base.select("doc_id", "__t", "n_words").join(result, "__t", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__ids", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("__hit").isNotNull().alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same rows without fingerprints: all windows of a document joined with all windows of the items.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(list_slice(w, s, s + least(len(w), {WINDOW}) - 1), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT k, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS x
  FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT DISTINCT k, m, s, x FROM dw WHERE x IN (SELECT x FROM iw)),
p AS (SELECT k, count(DISTINCT s + j) AS n FROM (SELECT k, s, unnest(range(0, m)) AS j FROM h) GROUP BY k),
q AS (SELECT k, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT h.k, iw.item_id FROM h JOIN iw ON h.x = iw.x) GROUP BY k)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(q.n, 0)::BIGINT AS n_items,
  sha256(coalesce(q.ids, '')) AS items_sha256, p.n IS NOT NULL AS contaminated FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN q ON d.k = q.k"""
