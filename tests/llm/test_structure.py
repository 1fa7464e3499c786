"""Collocations, conversation repair and decontamination against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from paritas.llm import collocations, conversations, decontaminate


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- collocations ----


def expected_collocations(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= 50 * a for q, b in c.items() if len(q) > len(p) and b >= least and any(q[j : j + len(p)] == p for j in range(len(q)))):
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, n[lang], -score))
    return Counter(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    out = []
    for i in range(120):
        words = rng.choices(["The", "the", "ox", "of", "é", "naïve", "x-y", "#", "\x01", "日本"], [6, 5, 4, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 60))
        out.append((rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \x0b", "  "]) for w in words)))
    out += [("en", None), (None, None), ("en", ""), ("fr", " . , "), ("de", "a b " * 5000), ("hot", "of the ox"), *[("hot", "of the ox")] * 40]
    return out


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 7)])
def test_collocations_are_all_counted(spark, prose, least, top):
    df = spark.createDataFrame([(*r, 1, "x") for r in prose], "lang string, text string, rank int, phrase string").repartition(5)
    got = collocations.mine_collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert Counter(map(tuple, got)) == expected_collocations(prose, least, top)


def test_collocations_of_small_tries_and_many_ranges(spark, prose, monkeypatch):
    monkeypatch.setattr(collocations, "TRIE_WORDS", 50)
    monkeypatch.setattr(collocations, "ROWS", 7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(prose, "lang string, text string").repartition(3)
        got = collocations.mine_collocations(df, 4, 50).collect()
        assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == expected_collocations(prose, 4, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_collocations_of_nothing(spark, none, docs):
    assert collocations.mine_collocations(none).count() == 0
    assert collocations.mine_collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
    assert collocations.mine_collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# ---- conversations ----


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            r = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [r, r] if k == 3 else [r]
    return out


def faults(rows):
    seen, out = set(), []
    for r in rows:
        bare = re.sub(r"[ \t-\r]", "", r[3])
        out.append("blank" if not bare else "duplicate" if r[2:] in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add(r[2:])
    return out


def cheapest(rows, found):
    """All edits of a short conversation, one after another: (cost, audit, repaired lines) of the cheapest."""
    choices = []
    for r, f in zip(rows, found):
        one = [(2, "D", None)]
        if f not in ("blank", "duplicate"):
            extra = 5 * (f == "truncated")
            one += [(extra, "K", (r[2], r[3])), *[(1 + extra, "R", (x, r[3])) for x in ("user", "assistant")]]
        choices.append(one)
    inserts = [[], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]]
    best = None
    for pick in product(*choices):
        for gaps in product(inserts, repeat=len(rows) + 1):
            turns, audit = [*gaps[0]], "I" * len(gaps[0])
            cost = sum(x[0] for x in pick) + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            for (_, letter, turn), gap in zip(pick, gaps[1:]):
                audit += letter + "I" * len(gap)
                turns += ([turn] if turn else []) + gap
            if re.fullmatch(r"(s?(ua)+)?", "".join(x[0][:1] or "-" for x in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def program(rows, found):
    """The same for long conversations: audits are compared as texts."""
    far = {0: (0, "", ())}
    for r, f in zip(rows, found):
        new = {q: (c + 2, a + "D", t) for q, (c, a, t) in far.items()}
        if f not in ("blank", "duplicate"):
            for m, (c, a, t) in far.items():
                for q, i in conversations.INITIALS.items():
                    if (m, q) in conversations.BETWEEN and (r[2][:1] == i or q != 1):
                        lines = conversations.BETWEEN[m, q]
                        keep = r[2][:1] == i
                        entry = (c + 5 * len(lines) + (not keep) + 5 * (f == "truncated"), a + "I" * len(lines) + "RK"[keep], (*t, *[(conversations.ROLES[x], "") for x in lines], (r[2] if keep else conversations.ROLES[q], r[3])))
                        if q not in new or entry < new[q]:
                            new[q] = entry
        far = new
    return min((c + 5 * len(end), a + "I" * len(end), (*t, *[(conversations.ROLES[x], "") for x in end])) for q, (c, a, t) in far.items() for end in [conversations.AT_END[q]])


def expected_repair(rows, solve):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    out = Counter()
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = solve(mine, found)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        out[conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest] += 1
    return out


SCHEMA = "conv_id long, turn long, role string, text string, cost int, part int, c int, key string"
COLUMNS = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def chat(rng, conv, turns):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "no", "Why?", "  ", "", None, "é…", "Well then! \n", "Line\none."]
    return [(conv, i + 3 * (rng.random() < 0.1) if rng.random() < 0.95 else None, rng.choice(roles[:5] if rng.random() < 0.9 else roles), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}.") for i in range(turns)]


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in conversations.repair_damaged(df).select(*COLUMNS).collect())


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(1)
    rows = [r for c in range(60) for r in chat(rng, c, rng.randint(1, 3))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (98, None, "user", None), (99, None, None, None)]
    assert repaired(spark, rows) == expected_repair(rows, cheapest)


def test_program_of_the_test_is_the_cheapest_of_all_edits():
    rng = random.Random(2)
    for c in range(40):
        mine = damage(chat(rng, c, 3))[:3]
        cost, audit, lines = program(mine, faults(mine))
        assert (cost, audit, list(lines)) == cheapest(mine, faults(mine))


def test_repair_of_long_and_hot_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(30) for r in chat(rng, c, rng.randint(1, 25))]
    rows += chat(rng, 500, 3000)  # in many ranges
    rows += [(600, 7, "user", "Again.")] * 900 + [(600, 8, "assistant", "Again.")] * 3 + [(700, i, "user", "ok.") for i in range(400)]  # repeated rows, one text
    rows += [(800, 1, "user", "Long. " * 20000 + "end."), (800, 2, "assistant", "x")]
    assert repaired(spark, rows) == expected_repair(rows, program)


def test_repair_of_nothing(spark):
    got = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_damaged(got).count() == 0
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(drop, 0, "user", "Hi.")]) == Counter({(drop, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1})


# ---- decontamination ----


def expected_hits(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = Counter()
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= x
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)

    def text(n, letters="abcdé日"):
        return [rng.choice(letters) * rng.randint(1, 3) for _ in range(n)]

    bench = [text(rng.randint(10, 60), "abcdefghij") for _ in range(25)]
    items = [(i, ", ".join(w)) for i, w in enumerate(bench)] + [(0, "repeated row " * 8), (0, "repeated row " * 8), (None, " ".join(bench[3])), (900, " ".join(bench[3]).upper())]
    items += [(901, None), (902, " .. "), (903, "Single"), (904, "two words"), (905, "a b c d e f"), (906, "one two three four five six seven eight nine"), (907, "z " * 40)]
    docs = []
    for i in range(80):
        w, b = text(rng.randint(0, 40)), rng.choice(bench)
        n = rng.randint(8, 14)
        at, to = rng.randint(0, max(0, len(b) - n)), rng.randint(0, len(w))
        docs.append((i, " ".join([*w[:to], *b[at : at + n], *w[to:]])))
    docs += [(200, None), (201, ""), (202, "single"), (203, "TWO-words, two words"), (204, "x a b c d e f a b c d e f"), (None, items[5][1]), (205, "z " * 3000), (206, " ".join(text(4000)) + " " + items[7][1])]
    docs += [(207, "a one two three four five six seven eight nine b"), (208, " ".join(bench[3]))] + [(208, " ".join(bench[3]))] * 3
    return docs, items


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_is_every_window(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    docs, items = corpus
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, item_id int, n_hit int, m int").repartition(3)
    bench = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, doc_id int, s int")
    got = decontaminate.decontaminate(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(map(tuple, got.collect())) == expected_hits(docs, items)


def test_decontamination_of_nothing(spark, docs, none, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.decontaminate(none, some).count() == 0
