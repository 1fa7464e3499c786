"""Joins, near-duplicates and toxicity against brute force; the pipeline on a small table."""

import re
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from paritas.llm import components, jaccard, neardup, quality, toxicity


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    own = classes(range(len(rows)), links)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if own[j] == own[k] and rows[j][0] is not None]
        out.append((doc, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc))
    return Counter(out)


def test_jaccard_odd_rows(docs, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect())
    assert got == brute([(r[0], r[1]) for r in rows])


def test_jaccard_chains_thresholds_and_common_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(12):  # families with edits of every size, so that many pairs lie near the threshold
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 12)):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n + i, " ".join([word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(0, 25))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect())
    assert got == brute(rows)


def test_jaccard_large_groups_of_many_edits(spark):
    rng = random.Random(8)
    base, extra = [f"w{i}" for i in range(80)], [f"e{i}" for i in range(6)]
    rows = []
    for i in range(400):  # edits up to and beyond the threshold, some with words that other copies take too
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(80)] = rng.choice(extra) if rng.random() < 0.5 else f"x{rng.randrange(5000)}"
        if rng.random() < 0.3:
            t += [rng.choice(extra) for _ in range(rng.randint(1, 8))]
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()) == brute(rows)


def test_jaccard_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_documents(df).collect()} == {0}


def test_one_document_stays(docs, rows):
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    by = {d: c for d, _, c in brute([(r[0], r[1]) for r in rows])}
    assert ids == Counter({d: 1 for d, c in by.items() if c == d or c is None})


def test_one_document_stays_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = lambda t: t + " more"
    rows = [(7, a), (9, near(a)), (3, b), (7, near(b)), (5, c), (5, near(c)), (8, c), (5, ""), (4, d), (None, near(d)), (None, "one of its own"), (7, a)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = jaccard.one_per_group(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, a), (3, b), (5, c), (5, ""), (4, d), (None, "one of its own")])


@pytest.mark.parametrize("finish", [0, 20_000])
def test_components_of_paths_stars_and_cycles(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH", finish)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)]
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes({x for p in links for x in p}, links)
    assert len(got) == len(want)
    assert {frozenset(n for n in got if got[n] == r) for r in set(got.values())} == {frozenset(n for n in want if want[n] == r) for r in set(want.values())}


def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 16))
    rows = [(i, (centres[rng.integers(25)] + rng.normal(size=16) * rng.choice([0.01, 0.05, 0.08])).tolist(), int(i % 2)) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 1), (303, [1.0] * 8, 0), (304, [1.0] * 8, 0), (305, rows[0][1], None), (306, [], 1), (307, [1e300] * 16, 1), (308, [1e300] * 16, 1), (309, [None, *[1.0] * 15], 1)]
    return rows


def test_near_duplicates(spark):
    rows = vectors()
    unit = {}
    for i, e, label in rows:
        v = np.array([np.nan if x is None else x for x in e or []], float)
        if label is not None and v.size and np.isfinite(v).all() and np.abs(v).max() > 0:
            v = v / np.abs(v).max()
            unit[i] = v / np.linalg.norm(v), label
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    count = Counter(x for p in links for x in p)
    own = classes([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for block in (16, 1024):  # split many times, and not at all
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, block=block).collect()}
        assert got == {r[0]: (count[r[0]], own[r[0]], own[r[0]] == r[0]) for r in rows}


def test_near_duplicates_of_equal_vectors_split_by_hash(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1) for i in range(100)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in neardup.near_duplicates(df, block=8).collect()} == {(99, 0)}


def test_estimates_grow_no_faster_than_the_rounds(spark, monkeypatch, capsys):
    """The sizes by which Spark plans have few digits: they filled the driver's memory when they grew by a power a round."""
    def digits(df):
        df.explain("cost")
        return max([0, *map(int, re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out))])

    monkeypatch.setattr(components, "FINISH", 10)
    path = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    found = components.components(path)
    assert digits(found) < 300 and found.count() == 3001 and found.select("root").distinct().count() == 1
    x = np.random.default_rng(2).normal(size=(400, 8)) * 0.02 + np.eye(8)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, "0", bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id long, node string, v binary, copies long")
    split = neardup._split(nodes, 4)
    assert digits(split) < 600 and split.count() == 400 and split.groupBy("node").count().agg({"count": "max"}).first()[0] <= 4
    assert len(neardup.nets(x, 20)) == 20  # a dense group is parted too


def test_near_duplicates_across_groups_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 2)
    x = np.random.default_rng(3).normal(size=(150, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df, block=8).collect()}
    own = classes(list(range(150)), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit)) if a < b])
    assert got == {i: (int(hit[i].sum()) - 1, own[i]) for i in range(150)}


def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(0)
    index = toxicity.Index([str(i) for i in range(30)], np.ones(30), [], np.zeros(0))
    vecs = [index.weigh(Counter(rng.integers(0, 30, rng.integers(1, 6)).tolist())) for _ in range(500)]
    index = toxicity.Index([str(i) for i in range(30)], np.ones(30), vecs, rng.integers(0, 2, 500))
    for v in vecs[:60]:
        every = sorted((-round(sum(x * dict(e).get(t, 0) for t, x in v.items()), 9) for e in index.entries))
        got = [-round(c, 9) for c, _ in index.nearest(v, 10)]
        assert np.allclose(got, every[: len(got)], atol=1e-6)


def test_toxicity_held_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    bad = ["vile", "nasty", "awful", "horrid"]
    rows, labels = [], []
    for i in range(600):
        t = [word() for _ in range(40)]
        if i % 5 == 0:
            t[3], t[20] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(i % 5 == 0) and 0 <= got[i].score <= 1
    assert got[1000].predicted == got[1001].predicted == 0 and got[None].predicted == 1


def test_toxicity_meets_copies_of_examples_by_any_word(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = [(i, " ".join([*(word() for _ in range(30)), *["vile"] * (i % 5 == 0)])) for i in range(300)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    learned, held = (next(i for i in range(1000, 2000) if (zlib.crc32(str(i).encode()) % 3 == 1) == h) for h in (False, True))
    text = "wörter die sonst nirgends stehen"
    df = spark.createDataFrame([*rows, (learned, text), (held, text), (3000, "")], "doc_id long, text string")
    tags = spark.createDataFrame([*labels, (learned, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, tags)
    assert set(index.of) == {w for i, x in [*rows, (learned, text)] if zlib.crc32(str(i).encode()) % 3 != 1 for w in x.split()}
    (cosine, zero, one), *_ = index.evidence(text)
    assert abs(cosine - 1) < 1e-6 and (zero, one) == (0, 1)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, tags).collect()}
    assert got[held] == got[learned] > 0.5 > got[3000]
    for i, x in rows[:40]:
        v = index.vector(x)
        every = sorted((sum(a * dict(e).get(t, 0) for t, a in v.items()) for e in index.entries), reverse=True)
        assert np.allclose([c for c, _ in index.nearest(v, 10)], every[:10], atol=1e-6), i


def test_toxicity_takes_one_row_of_an_id(spark):
    """One id in very many rows is one example; scores are those of all entries compared one by one."""
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:59]
    rows = [(i, " ".join(rng.choice(words[:40] if i % 2 else words[20:], 30))) for i in ids] + [(ids[0], " ".join(rng.choice(words, 12))) for _ in range(5000)]
    rows += [(None, "waa wab"), (1000, None), (1001, ""), (1002, "unknown words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tags = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    index = toxicity.fit(df, tags)
    assert index.counts.sum() == len(ids)
    dense = np.zeros((len(index.counts), len(index.idf)))
    for n, e in enumerate(index.entries):
        for t, w in e:
            dense[n, t] = w

    def expected(text):
        v = np.zeros(len(index.idf))
        for t, x in index.vector(text).items():
            v[t] = x
        if v.any():
            cosine = np.round(dense @ v, 12)
            near = [(cosine[n], n) for n in sorted(range(len(cosine)), key=lambda n: (-cosine[n], n))[:15] if cosine[n] > 0]
        else:
            near = [(1.0, n) for n, e in enumerate(index.entries) if not e]
        w = [1 / (max(0, 1 - c) + 0.05) for c, _ in near]
        up = 10 * index.prior + sum(x * index.counts[n][1] for x, (_, n) in zip(w, near))
        p = min(max(up / (10 + sum(x * index.counts[n].sum() for x, (_, n) in zip(w, near))), 1e-4), 1 - 1e-4)
        return round(1 / (1 + math.exp(-(index.scale * math.log(p / (1 - p)) + index.shift))), 9)

    texts = {t for _, t in rows}
    want = {t: expected(t) for t in texts}
    got = toxicity.score_toxicity(df, tags).collect()
    assert Counter((r.doc_id, r.held_out, round(r.score, 9)) for r in got) == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, want[t]) for i, t in rows)


def test_toxicity_examples_end_at_their_bytes(spark, monkeypatch):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame([(i, "abcd efgh") for i in ids], "doc_id long, text string")
    tags = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", 40 * 10 + 5)  # 40 an example
    assert toxicity.fit(df, tags).counts.sum() == 10


def test_toxicity_without_labels_or_rows(spark, docs, rows, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, empty).count() == len(rows)
    assert toxicity.score_toxicity(none, empty).count() == 0


def test_empty_tables(spark, none):
    assert jaccard.similar_documents(none).count() == 0 and jaccard.one_per_group(none).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == columns, name
    assert set(corpus_pipeline.STAGES[-1][1](spark, now, "").columns) == {"doc_id", "ids", "n_tokens"}
    assert quality.quality_filter(now).count() == now.count()
