"""Quality rules, license scans and sharding against plain Python."""

import re
import zlib
from collections import Counter

from paritas.llm import license, quality, sharding


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def expected_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), failed


def test_quality_measures(docs, rows):
    got = multiset(quality.score_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((r[0], *expected_quality(r[1])) for r in rows)


def test_quality_filter_keeps_columns_and_drops_failures(docs):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    scored = {r.doc_id: r.kept for r in quality.score_quality(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in scored.items() if k}


def test_quality_rejects_symbols_and_keeps_prose(spark):
    prose = " ".join(f"the word{i} of" for i in range(40))
    df = spark.createDataFrame([(1, prose), (2, prose.replace(" of", " ###"))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.score_quality(df).collect()} == {1: True, 2: False}


def test_license_base_places(docs, rows):
    def expected(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted((i, label) for p, label in license.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))

    got = multiset(license.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == Counter((r[0], *expected(r[1])) for r in rows)


def test_license_labels_and_scores(spark):
    texts = ["GNU General Public License version 3", "nothing here", None, "under the MIT license", "the apache license, version 2.0 and cc-by-sa 4.0", "gnu gnu license license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(6)] == ["gpl-3", "", "", "mit", "apache-2,cc-by-sa", ""]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == 0 < got[3].score


def test_sharding_law(docs, rows):
    got = sharding.shard_documents(docs, shards=7, vnodes=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = Counter(r.shard for r in got)
    assert len(by) == 7 and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))


def test_sharding_moves_little(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, shards=n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)  # dealing by remainder would move 8 of 9


def test_overflow_plan_covers_every_rank():
    arcs = [(0, 0, 50), (10, 1, 0), (20, 0, 3), (30, 2, 1)]
    pieces = sharding.overflow_plan(arcs, 3)
    for arc, _, n in arcs:
        ranks = sorted(x for a, lo, hi, _, _ in pieces if a == arc for x in range(lo, hi))
        assert ranks == list(range(n))


def test_empty_tables(none):
    for f in (quality.score_quality, quality.quality_filter, license.scan_licenses, sharding.shard_documents):
        assert f(none).count() == 0
