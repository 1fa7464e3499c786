"""Toxicity by nearest labelled examples: exact TF-IDF cosines over a block-max inverted index.

Examples are labelled documents of the training folds, at most ``EXAMPLES`` of each label, chosen by a
hash of their id, while their distinct words have at most ``EXAMPLE_BYTES`` bytes together (the documented
bounds of the fit); an id stands for one document. The vocabulary is all words of the examples; inverse
document frequencies are counted over all documents. Words whose presence among the examples does not
differ by label (a chi-square test against the number of words tried, near copies sharing one vote)
count ``LIGHT`` as much. A text is the TF-IDF vector of its words of the vocabulary, over the whole text,
so a copy of an example has cosine 1 with it. Examples with equal vectors are one entry with counts by
label.

The index keeps, for each word, postings in blocks of entries with the block's largest weight. A query
sums the block maxima of its words, visits the blocks of highest bound, and then all others that can still
beat its k-th best cosine: the nearest entries are exact. Postings of words that many entries hold are kept
as rows of a matrix. The entries vote with weight 1 / (distance + 0.05), with
the prior as ``PRIOR`` more votes; the vote is calibrated by Platt scaling on examples that are left out of
their own neighbourhood. The index is bounded by the examples and is broadcast; scoring is row-local. Texts are taken apart once:
their word numbers and counts are written, frequencies and scores are computed from them.

Defined cases: a null or empty text, or one without a word of any example, meets the entry of the
empty vector: its score is the share of label 1 among examples alike (or 0.5 without labels). Null
labels and null ids are not learned from; a null id is held out by no fold (false); an id in many rows of
documents is one example, the text of least hash; repeated rows score alike; very long texts are scored
whole; entries of equal cosine go by their place in the index; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, written

EXAMPLES, NEIGHBOURS, BLOCK = 2000, 15, 64
EXAMPLE_BYTES = 64_000_000  # of distinct words of the examples, 16 more for each: bounds the driver, the vocabulary and the index
FIRST = 4  # blocks that a query visits before it compares bounds
OFTEN = 16  # words in more than one of so many entries are rows of a matrix
LIGHT = 0.3  # weight of a word that the label test does not pass (least leave-one-out loss of 1, 0.3, 0.1, 0.03)
PRIOR = 10.0  # votes of the prior: a single near example does not decide
_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (ASCII letters and all other characters beyond ASCII)."""
    import re

    return re.findall(_WORD, text.lower()) if isinstance(text, str) else []


def codes(of: dict[str, int], text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's known words, in order, and how often they occur."""
    words = words_of(text)
    t, c = np.unique(np.fromiter(map(of.get, words, itertools.repeat(-1)), np.int32, len(words)), return_counts=True)
    known = int(len(t) > 0 and t[0] < 0)
    return t[known:], c[known:]


#: {word: weight}, or words in order and their weights
Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]


class Index:
    """Labelled examples as a block-max inverted index over TF-IDF vectors."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, vectors: list[Vector], labels: np.ndarray) -> None:
        self.of, self.idf = {w: i for i, w in enumerate(vocabulary)}, np.asarray(idf, float)
        entries: dict[bytes, tuple] = {}
        for v, y in zip(vectors, labels, strict=True):
            v = self.arrays(v)
            entries.setdefault(self.key(v), (v, [0.0, 0.0]))[1][int(y)] += 1
        # similar entries side by side, so that block maxima are sharp
        order = sorted(entries, key=lambda e: (entries[e][0][0].astype(">i4").tobytes(), e))
        self.counts = np.array([entries[e][1] for e in order]).reshape(-1, 2)
        self.place = {e: n for n, e in enumerate(order)}
        # postings by word and entry; a pair is a word in a block: its postings lie side by side
        t = np.concatenate([np.zeros(0, np.int32), *(entries[e][0][0] for e in order)])
        n = np.repeat(np.arange(len(order), dtype=np.int32), [len(entries[e][0][0]) for e in order])
        w = np.concatenate([np.zeros(0), *(entries[e][0][1] for e in order)])
        by = np.lexsort((n, t))
        t, self.entry, self.weight = t[by], n[by], w[by]
        first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(self.entry // BLOCK) != 0)][: len(t)])
        self.pair_block = self.entry[first] // BLOCK
        self.pair_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.pair_at = np.r_[first, len(t)]
        self.word_at = np.searchsorted(t[first], np.arange(len(vocabulary) + 1))
        total = self.counts.sum(0) if len(self.counts) else np.zeros(2)
        self.prior = float((total[1] + 1) / (total.sum() + 2))
        self.scale, self.shift = 1.0, 0.0
        self.known: dict[bytes, float] = {}
        self.matrix: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def state(self) -> dict:
        """What a worker needs for ``restored``; the rest it makes itself."""
        return vars(self) | {"known": {}, "matrix": None}

    @classmethod
    def restored(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        vars(index).update(state, known={})
        return index

    def often(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of each word (-1: none), its weights by entry and its maxima by block."""
        if self.matrix is None:
            entries = len(self.counts)
            lo, hi = self.pair_at[self.word_at[:-1]], self.pair_at[self.word_at[1:]]
            words = np.flatnonzero((hi - lo) * OFTEN > entries)
            row = np.full(len(lo), -1, np.int32)
            row[words] = np.arange(len(words))
            weights = np.zeros((len(words), -(-entries // BLOCK) * BLOCK))
            for n, t in enumerate(words.tolist()):
                weights[n, self.entry[lo[t] : hi[t]]] = self.weight[lo[t] : hi[t]]
            self.matrix = row, weights, weights.reshape(len(words), -1, BLOCK).max(2, initial=0.0)
        return self.matrix

    @property
    def entries(self) -> list[tuple]:
        """The vectors of the entries."""
        out: list[list] = [[] for _ in self.counts]
        pair_word = np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))
        for t, n, w in zip(np.repeat(pair_word, np.diff(self.pair_at)).tolist(), self.entry.tolist(), self.weight.tolist(), strict=True):
            out[n].append((t, w))
        return [tuple(e) for e in out]

    @staticmethod
    def arrays(v: Vector) -> tuple[np.ndarray, np.ndarray]:
        """Words in order and their weights."""
        if isinstance(v, tuple):
            return v
        t = np.fromiter(v.keys(), np.int32, len(v))
        by = np.argsort(t)
        return t[by], np.fromiter(v.values(), float, len(v))[by]

    @staticmethod
    def key(v: tuple[np.ndarray, np.ndarray]) -> bytes:
        return hashlib.blake2b(v[0].tobytes() + v[1].tobytes(), digest_size=16).digest()

    def vector(self, text: str | None) -> dict[int, float]:
        t, x = self._vector(text)
        return dict(zip(t.tolist(), x.tolist(), strict=True))

    def _vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self._weigh(codes(self.of, text))

    def weigh(self, counts: dict[int, int]) -> dict[int, float]:
        t, x = self._weigh(counts)
        return dict(zip(t.tolist(), x.tolist(), strict=True))

    def _weigh(self, counts: Vector) -> tuple[np.ndarray, np.ndarray]:
        t, c = self.arrays(counts)
        x = (1 + np.log(c)) * self.idf[t]
        norm = math.sqrt(float((x * x).sum()))
        return (t, np.round(x / norm, 9)) if norm else (t[:0], x[:0])

    def nearest(self, v: Vector, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k entries of largest cosine (cosine, entry); exact. An empty vector meets only its like."""
        t, x = self.arrays(v)
        if not len(t):
            n = self.place.get(self.key((t, x)))
            return [] if n is None else [(1.0, n)]
        row, weights, most = self.often()
        r = row[t]
        rows, mass = r[r >= 0], x[r >= 0]
        t, x = t[r < 0], x[r < 0]
        pairs, of = _spans(self.word_at[t], self.word_at[t + 1] - self.word_at[t])
        block, x = self.pair_block[pairs], x[of]
        lo = self.pair_at[pairs]
        size = self.pair_at[pairs + 1] - lo
        blocks = most.shape[1]
        bound = mass @ most[rows] + np.bincount(block, x * self.pair_most[pairs], blocks)
        now = np.zeros(blocks, bool)
        now[np.argsort(-bound, kind="stable")[:FIRST]] = True
        open_, best = ~now, []
        while now.any():
            mine = np.flatnonzero(now[block])
            places, of = _spans(lo[mine], size[mine])
            score = np.bincount(self.entry[places], x[mine][of] * self.weight[places], blocks * BLOCK).astype(float).reshape(blocks, BLOCK)
            if 2 * now.sum() > blocks:
                score = np.where(now[:, None], score + (mass @ weights[rows]).reshape(blocks, BLOCK), 0)
            else:
                for b in np.flatnonzero(now).tolist():
                    score[b] += mass @ weights[rows, b * BLOCK : (b + 1) * BLOCK]
            score = np.round(score.ravel(), 12)
            if without >= 0:
                score[without] = 0
            found = np.flatnonzero(score)
            if len(found) > k:
                some = score[found]
                found = found[some >= np.partition(some, -k)[-k]]
            best = sorted([*best, *zip(score[found].tolist(), found.tolist(), strict=True)], key=lambda z: (-z[0], z[1]))[:k]
            # a bound and a cosine may differ in rounding
            now = open_ & (bound > 0) & (bound >= (best[-1][0] - 1e-9 if len(best) == k else 0))
            open_ = np.zeros(blocks, bool)
        return best

    def vote(self, v: Vector, own: int | None = None) -> float:
        """Distance-weighted share of label 1; ``own`` is a label to leave out at the vector's own entry."""
        up, down = PRIOR * self.prior, PRIOR
        here = self.place.get(self.key(self.arrays(v)), -1)
        for cosine, n in self.nearest(v):
            zero, one = self.counts[n]
            if own is not None and n == here:
                zero, one = zero - (own == 0), one - (own == 1)
            w = 1.0 / (max(0.0, 1.0 - cosine) + 0.05)
            up += w * one
            down += w * (zero + one)
        return up / down

    def calibrate(self, vectors: list[Vector], labels: np.ndarray) -> Index:
        p = np.clip(np.array([self.vote(v, int(y)) for v, y in zip(vectors, labels, strict=True)]), 1e-4, 1 - 1e-4)
        z, y = np.log(p / (1 - p)), np.asarray(labels, float)
        if 0 < y.sum() < len(y):
            for _ in range(500):
                q = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))
                self.scale -= 0.2 * float(((q - y) * z).mean())
                self.shift -= 0.2 * float((q - y).mean())
        return self

    def score(self, text: str | None) -> float:
        return self.score_codes(codes(self.of, text))

    def score_codes(self, counts: Vector) -> float:
        v = self._weigh(counts)
        key = self.key(v)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            p = min(max(self.vote(v), 1e-4), 1 - 1e-4)
            self.known[key] = 1 / (1 + math.exp(-min(max(self.scale * math.log(p / (1 - p)) + self.shift, -40), 40)))
        return self.known[key]

    def evidence(self, text: str | None, k: int = 3) -> list[tuple[float, float, float]]:
        """(cosine, examples of label 0, of label 1) of the nearest entries."""
        return [(c, *self.counts[n].tolist()) for c, n in self.nearest(self._vector(text), k)]


def _spans(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of ``size`` from ``lo``, and the range of each."""
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) + np.repeat(lo - np.cumsum(size) + size, size), of


def _copy_weights(bags: list) -> np.ndarray:
    """1 / (size of the group of near copies) per example: copies are not independent evidence of a word."""
    parent = list(range(len(bags)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    first: dict[tuple, int] = {}
    rng = np.random.default_rng(0)
    factors = rng.integers(1, 2**63, (8, 6), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n, words in enumerate(bags):
        if not len(words):
            continue
        h = np.array([zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode()) for w in words], np.uint64)
        for band, six in enumerate(factors):
            key = (band, *[int(((h * f) >> np.uint64(20)).min()) for f in six])
            a, b = find(first.setdefault(key, n)), find(n)
            parent[max(a, b)] = min(a, b)
    group = np.array([find(i) for i in range(len(bags))], int)
    return 1.0 / np.bincount(group, minlength=max(1, len(bags)))[group] if len(bags) else np.zeros(0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of the labelled examples."""
    return _fit(docs, labels)[0]


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[Index, DataFrame]:
    """Choose examples, weigh their words, write all texts as codes, count frequencies, build the index."""
    learn = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).distinct()
    order = F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")
    picked = [learn.filter(F.col("y") == y).orderBy(*order).limit(EXAMPLES) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * EXAMPLES rows

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = [Counter(words_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "h": batch["h"], "doc_id": batch["doc_id"], "w": [list(c) for c in counted], "c": [list(c.values()) for c in counted]})

    # one row an id: of several the one of least hash
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    found = written(one.select("y", F.xxhash64(*order).alias("h"), "doc_id", "text").mapInPandas(distinct, "y int, h long, doc_id long, w array<string>, c array<int>"), "examples")
    # at most 2 * EXAMPLES slim rows: those whose words fit, in order of their hashes
    size = F.expr("aggregate(w, 0L, (n, x) -> n + octet_length(x) + 16)")
    so_far = F.sum("size").over(Window.orderBy("h", "doc_id", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = found.select("y", "h", "doc_id", size.alias("size")).withColumn("total", so_far).filter(F.col("total") <= EXAMPLE_BYTES).select("y", "h", "doc_id")
    rows = found.join(F.broadcast(fits), ["y", "h", "doc_id"]).orderBy("h", "doc_id", "y").select("y", "w", "c").toPandas()
    y = rows["y"].to_numpy(int)
    weight = _copy_weights(rows["w"].tolist())
    total = np.bincount(y, weight, minlength=2)
    seen: dict[str, np.ndarray] = {}
    for ws, label, share in zip(rows["w"], y, weight, strict=True):
        for w in ws:
            seen.setdefault(w, np.zeros(2))[label] += share
    # chi-square of presence against label; the bar grows with the words tried
    bar, scored = 2 * math.log(max(2, len(seen))) + 6, []
    n = total.sum()
    for w, (a, b) in seen.items():
        c, d = total[0] - a, total[1] - b
        under = (a + b) * (c + d) * total[0] * total[1]
        if under and a + b >= 3 and (x := n * float(a * d - b * c) ** 2 / float(under)) > bar:
            scored.append((-x, w))
    tested = [w for _, w in sorted(scored)]
    vocabulary = tested + sorted(seen.keys() - set(tested))
    coded = _coded(docs, {w: i for i, w in enumerate(vocabulary)})
    size = len(vocabulary) + 1  # the last place counts the documents

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column("t").flatten().to_numpy(), minlength=size)
            found[-1] += len(batch)
        places = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(found[places])], names=["t", "n"])

    df = np.zeros(size)
    for t, n in coded.select("t").mapInArrow(presence, "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        df[t] = n
    idf = np.log(1 + df[-1] / np.maximum(1, df[:-1])) * np.where(np.arange(len(vocabulary)) < len(tested), 1.0, LIGHT)
    blank = Index(vocabulary, idf, [], np.zeros(0))
    vectors = [blank._weigh({blank.of[w]: c for w, c in zip(ws, cs, strict=True)}) for ws, cs in zip(rows["w"], rows["c"], strict=True)]
    del rows, seen, df, blank
    return Index(vocabulary, idf, vectors, y).calibrate(vectors, y), coded


def _coded(docs: DataFrame, of: dict[str, int]) -> DataFrame:
    """(doc_id, held_out, t, c) of every document, written: its known words' numbers and their counts."""
    known = docs.sparkSession.sparkContext.broadcast(of)  # the words of the examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(known.value, t) for t in batch.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(t) for t, _ in found)]), pa.int32())
            lists = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in found)]).astype(np.int32) for k in (0, 1))
            columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "t", "c"])

    ids = F.col("doc_id").cast("long")
    rows = docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), "text")
    return written(rows.mapInArrow(run, "doc_id long, held_out boolean, t array<int>, c array<int>"), "words")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    index, coded = _fit(docs, labels)
    state = docs.sparkSession.sparkContext.broadcast(index.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.restored(state.value)
        for batch in batches:
            t, c = batch.column("t"), batch.column("c")
            ends, t, c = np.cumsum([0, *t.value_lengths().to_pylist()]), t.flatten().to_numpy(), c.flatten().to_numpy()
            score = [index.score_codes((t[a:b], c[a:b])) for a, b in itertools.pairwise(ends.tolist())]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.7) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return coded.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


by_value(__name__)
