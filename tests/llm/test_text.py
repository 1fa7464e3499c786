"""Mixing, encoding, token files and secrets."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paritas.llm import bpe, mixing, secrets, tokens
from paritas.llm.queries import vocabulary


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(vocabulary(), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(docs, rows, encoding):
    def expected(t):
        ids = encoding.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = Counter(tuple(r) for r in bpe.encode_digests(docs, vocabulary()).collect())
    assert got == Counter((r[0], *expected(r[1])) for r in rows)


def test_bpe_odd_characters_round_trip(spark, encoding):
    texts = ["a  b", "x\x1c\x1d y", "日本語 テキスト 123", "🙂🙂 ok", "it's we'll DON'T", "  \n\n  tail  ", "²³¼ Ⅷ", "a" * 3000, "ab" * 400, "  z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, vocabulary()).collect():
        assert r.decoded == texts[r.doc_id]
        assert list(r.ids) == encoding.encode_ordinary(texts[r.doc_id])


def test_encoding_stage_decodes_its_ids(spark, docs, monkeypatch):
    assert corpus_pipeline.encoding_stage(spark, docs, "").count() == docs.count()
    encode = bpe.Encoder.encode

    def short(self, texts):
        for ids, decoded in encode(self, texts):
            yield ids.rpartition(" ")[0], decoded

    monkeypatch.setattr(bpe.Encoder, "encode", short)
    with pytest.raises(Exception, match="do not decode to its text"):
        corpus_pipeline.encoding_stage(spark, docs, "").collect()


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:  # the rule as stated
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    assert all(math.isclose(got[s], (capped | share)[s], abs_tol=1e-6) for s in order)


def test_mix_comes_near_its_targets_and_reruns_agree(docs, rows):
    got = mixing.mix_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        key = r.source_size, r.target
        taken[key] += r.taken
        target[key] = r.target
        most[key] = max(most[key], r["size"])
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[k] - target[k]) <= most[k] + 1e-6 for k in taken)


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40).astype(float)
    f = np.full(40, 0.3)
    mean = np.zeros(40)
    for k in range(400):
        out, held = mixing.pivotal(size, f, np.random.default_rng(k).random(40))
        assert abs(np.dot(size, out) - np.dot(size, f)) < 1e-6
        assert sum(0 < x < 1 for x in out) <= 1
        mean += out
    assert np.abs(mean / 400 - 0.3).max() < 0.12


def test_mixed_documents_repeat_as_taken(docs):
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    want = Counter()
    for r in mixing.mix_report(docs).collect():
        if r["size"]:
            want[r.doc_id] += r.taken // r["size"]
    assert copies == +want


def test_token_files_stitch_blocks(docs, rows, encoding):
    for block in (7, 64, 1 << 16):
        blocks = tokens.write_token_files(docs, vocabulary(), block=block)
        assert blocks.agg(F.max(F.length("ids"))).first()[0] <= 2 * block
        names = blocks.select("file_id", "block_no", F.posexplode("ending").alias("in_block", "doc_id"))
        counted = tokens.count_tokens(blocks).withColumn("in_block", F.col("in_block").cast("int"))
        got = Counter((r.doc_id, r.n_tokens) for r in counted.join(names, ["file_id", "block_no", "in_block"]).collect())
        assert got == Counter((r[0], len(encoding.encode_ordinary(r[1] or ""))) for r in rows)


def test_tail_without_an_end_is_reported(spark):
    ids = np.array([5, 6, tokens.EOD, 7, 8, 9], "<u2").tobytes()
    blocks = spark.createDataFrame([(1, 0, bytearray(ids[:8])), (1, 1, bytearray(ids[8:]))], "file_id long, block_no long, ids binary")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in tokens.count_tokens(blocks).collect())
    assert got == [(0, 0, 2, True), (1, 3, 3, False)]


def test_flat_files_are_read_in_blocks(spark, tmp_path):
    ids = np.array([1, 2, tokens.EOD] * 5 + [3], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    got = sorted((r.ordinal, r.n_tokens, r.ended) for r in tokens.count_tokens(tokens.read_flat_files(spark, str(tmp_path), block=4)).collect())
    assert got == [(i, 2, True) for i in range(5)] + [(5, 1, False)]


def base_expected(text):
    """The rules as stated: match, then drop what is too short."""
    t, out = text or "", []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), kind, f"{secrets.KINDS[kind]}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return ",".join(x for *_, x in sorted(out))


ODD = ["token=token:abcdef", "TOKEN = 'abc' secret:longvalue1", "apikey=abcdef api_key: abcdef", "AKIAXAKIA" + "B" * 20, "f" * 23 + " " + "0" * 24, "ſecret=abcdefg toKen=abcdefg", "é" * 5 + "passwd:" + "a" * 6]


def test_secret_rules(spark, docs, rows):
    more = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for df, texts in ((docs, [(r[0], r[1]) for r in rows]), (more, list(enumerate(ODD)))):
        got = Counter((r.doc_id, r.base_sha256) for r in secrets.secret_digests(df).collect())
        assert got == Counter((i, hashlib.sha256(base_expected(t).encode()).hexdigest()) for i, t in texts)


def test_network_finds_keys_and_leaves_words(spark):
    rng = np.random.default_rng(3)
    key = lambda n=40: "".join(rng.choice(list("0123456789abcdef"), n))
    prose = "the words of plain texts are not secrets although some are_long_words_with_parts"
    rows = [(i, f'{prose} token = "{key()}" {prose}') for i in range(80)] + [(100 + i, f"{prose} {i} {prose}") for i in range(80)]
    rows.append((999, f"{prose} {key().upper()} {prose}"))
    found = {r.doc_id: r.spans for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("assign" in found[i] for i in range(80)) and not any(found[100 + i] for i in range(80))
    at = len(prose) + 1
    assert found[999] == f"cnn:{at}:{at + 40}"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghiklmnorstu"), rng.integers(2, 15))) for _ in range(n))


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"{prose(rng, 30)} and some_long_name-of/a.path TheOtherKindOfName 2024-01-02 {'password: hunter2x' * (i % 4 == 0)}") for i in range(400)]
    return secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_network_finds_forms_that_it_was_not_trained_on(network):
    """Recall of at least 0.9 on forms that neither rules nor training have, and few clean runs found."""
    rng = np.random.default_rng(9)
    alnum = secrets._ALNUM
    forms = [("pypi-AgEI", alnum + "_-", 60), ("hf_", alnum, 34), ("rk_test_", alnum, 24), ("EAAC", alnum, 60), ("shpat_", "0123456789ABCDEF", 32)]
    hits = runs = wrong = 0
    for k in range(300):
        start, chars, n = forms[k % len(forms)]
        key = start + "".join(rng.choice(list(chars), n))
        left = prose(rng, 20)
        hits += any(kind == "cnn" and s <= len(left) + 1 and e >= len(left) + 1 + len(key) for kind, s, e, _ in secrets.spans_of(f"{left} {key} {prose(rng, 20)}", network))
        clean = prose(rng, 60)
        runs += len(secrets.candidates(clean, []))
        wrong += len(secrets.spans_of(clean, network))
    assert hits >= 270 and runs > 2000 and wrong <= 0.01 * runs


def test_added_spans_are_those_of_a_plain_network(network):
    """Every run that no base span touches, read whole, place by place."""
    rng = np.random.default_rng(10)
    code = {c: i + 2 for i, c in enumerate(secrets._ALPHABET)}

    def plain(text, s, e):
        x = [0, 0] + [code.get(text[i], 1) + (secrets._CONTEXT if s <= i < e else 0) for i in range(max(0, s - 12), min(len(text), e + 12))] + [0, 0]
        h = np.array([np.maximum(sum(network.k[j][x[i + j]] for j in range(5)) + network.b, 0) for i in range(len(x) - 4)])
        own = [k for k, c in enumerate(x[2:-2]) if c > secrets._CONTEXT]
        z = np.concatenate([h.max(0), h[own].mean(0)]) @ network.w + network.c
        return 1 / (1 + np.exp(-np.clip(network.scale * z + network.shift, -40, 40)))

    texts = ["", "short", "a" * 500, "é日本 " + secrets.made_key(rng), "password=abcdefghijkl " + "f" * 30 + "x" * 12, "x" * 11 + " " + "y" * 12, "0" * 3000 + "Zq" * 700]
    for _ in range(60):
        parts = [secrets.made_key(rng) if rng.random() < 0.4 else secrets.made_name(rng, ["alpha", "beta", "é", "token="]) for _ in range(rng.integers(1, 6))]
        texts.append(" \n,é"[rng.integers(4)].join(parts))
    for text in texts:
        base = secrets.base_spans(text)
        want = sorted((m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text) if m.end() - m.start() >= 12 and not any(s < m.end() and m.start() < e for s, e, _ in base) and plain(text, *m.span()) >= network.threshold)
        assert [(s, e) for kind, s, e, _ in secrets.spans_of(text, network) if kind == "cnn"] == want
        assert [(k, s, e) for k, s, e, _ in secrets.spans_of(text, network) if k != "cnn"] == [(k, s, e) for s, e, k in sorted(base, key=lambda x: (x[0], secrets.KINDS.index(x[2])))]


def test_redaction_leaves_no_base_span(docs, rows):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    out = clean.collect()
    assert len(out) == len(rows)
    for r in out:
        assert not [x for x in secrets.base_spans(r.text or "") if x[2] != "assign"]
        assert r.n_chars == (None if r.text is None else len(r.text))
    plain = {r[0]: r[1] for r in rows if r[1] and not secrets.base_spans(r[1]) and r[0] is not None}
    assert all(r.text == plain[r.doc_id] for r in out if r.doc_id in plain)


def test_repeated_rows_come_near_their_target(spark):
    text = " ".join(["ten"] * 10)
    rows = [(7, text, "a", i) for i in range(900)] + [(8, "five words of another text", "a", 0)] * 3 + [(1000 + i, text, "b", i) for i in range(900)] + [(3000 + i, text + " more", "c", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        source = "a" if r.doc_id < 1000 else "b" if r.doc_id < 3000 else "c"
        taken[source] += r.taken
        target[source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 12 for s in target)
    copies = Counter((r.doc_id, r.extra) for r in mixing.mix_documents(docs).collect())
    words = Counter()
    for (doc, _), k in copies.items():
        words["a" if doc < 1000 else "b" if doc < 3000 else "c"] += k * (5 if doc == 8 else 11 if doc >= 3000 else 10)
    assert words == taken


def test_a_unit_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = spark.createDataFrame([(7, "two words", "a")] * 300 + [(1000 + i, "three words here", "b") for i in range(200)] + [(None, "two words", None)] * 50, "doc_id long, text string, source string").repartition(3)
    got = Counter((r.doc_id, r.taken) for r in mixing.mix_report(docs).collect())
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    for doc, size in ((7, 2), (None, 2)):
        assert sum(t * k for (d, t), k in got.items() if d == doc) == size * copies[doc]
        assert len({t for d, t in got if d == doc}) <= 2
    assert sum(got.values()) == 550


def test_empty_tables(none):
    for f in (lambda d: bpe.encode_digests(d, vocabulary()), mixing.mix_report, mixing.mix_documents, lambda d: tokens.token_report(d, vocabulary()), secrets.secret_digests, secrets.redact):
        assert f(none).count() == 0


LARGE = 2**53 + 1


def test_large_ids_stay_exact_beside_nulls(spark):
    from paritas.llm import jaccard, license, neardup, quality, sharding, toxicity

    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(LARGE, text, "a"), (None, text, "a"), (LARGE + 2, "other", "a")], "doc_id long, text string, source string").coalesce(1)
    labels = spark.createDataFrame([(LARGE, 1), (LARGE + 2, 0)], "doc_id long, toxic int")
    for f in (
        mixing.mix_report,
        lambda d: bpe.encode_digests(d, vocabulary()),
        lambda d: bpe.encode_documents(d, vocabulary()),
        lambda d: toxicity.score_toxicity(d, labels),
        jaccard.similar_documents,
        sharding.shard_documents,
        lambda d: tokens.token_report(d, vocabulary()),
        license.scan_licenses,
        quality.score_quality,
        secrets.secret_digests,
    ):
        assert Counter(r.doc_id for r in f(docs).collect()) == Counter([LARGE, None, LARGE + 2])
    vectors = spark.createDataFrame([(LARGE, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (LARGE + 2, [1.0, 0.01], 1), (5, [0.0, 1.0], None)], "vec_id long, embedding array<double>, label long").coalesce(1)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(vectors).collect()}
    assert got == {LARGE: (2, LARGE), None: (2, LARGE), LARGE + 2: (2, LARGE), 5: (0, 5)}


def test_stages_with_names_of_their_own_columns(spark):
    from paritas.llm import jaccard, quality

    good = " ".join(f"the word{i} of" for i in range(40))
    names = ["__q_w", "__q_", "__i", "__h", "__s", "__k", "__c", "__n", "__id", "__key", "__top", "__text", "__hash", "__place", "__bucket", "__bit", "__found", "__number", "__copies", "a.b"]
    rows = [(i, good if i < 2 else good + f" more{i}", "a", 1, *range(len(names))) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "n_chars", *names])
    for stage in (quality.quality_filter, jaccard.one_per_group, secrets.redact, mixing.mix_documents):
        out = stage(docs)
        assert out.columns == docs.columns and all(list(r)[4:] == list(range(len(names))) for r in out.collect())
    assert [r.doc_id for r in jaccard.one_per_group(docs).collect()] == [0]
    assert quality.quality_filter(docs).count() == 3
