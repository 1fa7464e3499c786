"""Secret scans: rule matches, and a character convolutional network over every other candidate.

Base spans are the matches of three patterns and always stay. Candidates are all runs of ``LEAST`` token
characters or more that touch no base span. A small convolutional network in numpy reads each whole candidate
and the characters around it, candidate and context apart (a character counts as another one where it is
context), and adds those above its threshold as kind ``cnn``. It scores base spans too, as evidence. Long
candidates are read in pieces that share four characters: each place of the convolution is in one of them,
so pooling over pieces is pooling over the candidate.

The network is trained on the driver on labelled findings from at most ``SAMPLE_DOCS`` documents that hold a
key word and as many others, chosen by a hash of their id (repeated rows of one text count once), at most
``SAMPLE_FINDINGS`` of each label. Label 1 are the rules' matches and keys of the public ``FORMS``, made up
and set between words of the sample's texts, ``MADE`` a text. Label 0 are at most ``SAMPLE_RUNS`` runs of each of these
texts, and ``MADE`` made of its words the way names, paths, versions, dates and numbers are. Both kinds of made findings have the same
words before them, so that context alone does not decide. Findings longer than ``LONGEST`` are not trained on.
Scores are calibrated (Platt) on a fold apart; the threshold is the highest one that keeps ``RECALL`` of that
fold's secrets. Without ``FEWEST`` findings of both labels there is no network and only base spans.
The scan is row-local: no shuffle. Patterns run over whole texts.

Defined cases: null or empty texts have no spans; very long texts and runs are read whole; spans of equal start
go by kind as listed; repeated rows are scanned alike; an empty table gives an empty table; other columns are
ignored by ``find_secrets`` and carried by ``redact``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, checkpoint, give_back

KINDS = ("assign", "access", "hex", "cnn")
#: The base patterns. ASCII letters of the key words in either case.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KEY_WORDS = "(?i)password|passwd|secret|token|api_?key|akia"
SAMPLE_DOCS, SAMPLE_FINDINGS, SAMPLE_RUNS, MADE, FEWEST, RECALL = 1000, 3000, 4, 8, 20, 0.99
LEAST, LONGEST, CONTEXT, PIECE, FILTERS, WIDTH = 12, 400, 12, 80, 16, 5
STEPS = 500  # of the fit at least, of 64 findings each
_RUN = r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST
_LOWER, _DIGITS, _HEX_UPPER = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789ABCDEF"
_UPPER = _LOWER.upper()
_ALNUM = _LOWER + _UPPER + _DIGITS
_BASE64 = _ALNUM + "+/"
#: Public forms of keys, as parts: a text, or characters and how many of them.
FORMS = (
    ("ghp_", (_ALNUM, 36)), ("glpat-", (_ALNUM + "_-", 20)), ("sk_live_", (_ALNUM, 24)), ("sk-live-", (_ALNUM, 32)), ("sk-", (_ALNUM, 48)), ("npm_", (_ALNUM, 36)),
    ("AIza", (_ALNUM + "_-", 35)), ("xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)), ("SG.", (_ALNUM + "_-", 22), ".", (_ALNUM + "_-", 43)),
    ("eyJ", (_ALNUM + "_-", 33), ".eyJ", (_ALNUM + "_-", 60), ".", (_ALNUM + "_-", 43)), ((_BASE64, 40),), ((_BASE64, 62), "=="), ((_HEX_UPPER, 40),), ((_HEX_UPPER, 32),),
    ((_ALNUM, 20),), ((_ALNUM, 32),), ((_LOWER + _DIGITS, 24),), ((_LOWER + _DIGITS, 40),), ((_UPPER + _DIGITS, 20),), ((_UPPER + _DIGITS, 32),),
)
#: Words before made findings of either label.
_BEFORE = ("", "", "", "key ", "export KEY=", "bearer ", "id: ", "see ", "= ", '"', "value=", "(")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"
#: Numbers of characters: 0 is none, then context (1 is any other one), then the candidate itself.
_CONTEXT = len(_ALPHABET) + 1
_CODES = np.ones(128, np.int32)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(2, len(_ALPHABET) + 2)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within each kind; short matches are dropped."""
    out = [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    # a run is taken whole or not at all, so asking for its length at once drops the same matches
    out += [(m.start(), m.end(), "access") for m in _access.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]


_assign, _access, _hex, _run = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX), re.compile(_RUN)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of token characters that no base span touches."""
    out, at, taken = [], 0, sorted(taken)
    ends = np.maximum.accumulate([e for _, e, _ in taken]) if taken else ()
    for m in _run.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            at += 1
        if not at or ends[at - 1] <= s:  # spans that begin before this run's end have ended before it
            out.append((s, e))
    return out


def sequences(text: str, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Each whole span with its context as numbers of characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODES[np.minimum(points, 127)], 1).astype(np.int32)
    out = []
    for s, e in spans:
        x = codes[max(0, s - CONTEXT) : e + CONTEXT].copy()
        at = s - max(0, s - CONTEXT)
        x[at : at + e - s] += _CONTEXT
        out.append(x)
    return out


class CharCNN:
    """One-hot characters, one convolution, ReLU, the maximum over places and the candidate's mean, a logistic output."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.k = r.normal(0, 0.1, (WIDTH, 2 * _CONTEXT + 1, FILTERS))
        self.k[:, 0] = 0
        self.b, self.w, self.c = np.zeros(FILTERS), r.normal(0, 0.3, 2 * FILTERS), 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _conv(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The convolution at each place, where there is a character, and where it is the candidate's."""
        n = x.shape[1] - WIDTH + 1
        middle = x[:, WIDTH // 2 : WIDTH // 2 + n]
        return sum(self.k[j][x[:, j : j + n]] for j in range(WIDTH)) + self.b, middle > 0, middle > _CONTEXT

    def features(self, found: list[np.ndarray]) -> np.ndarray:
        """Maxima and means of whole findings, piece by piece."""
        step, edge = PIECE - WIDTH + 1, WIDTH // 2
        counts = np.array([-(-len(x) // step) for x in found], int)
        x = np.zeros((counts.sum(), PIECE), np.int32)
        at = 0
        for f, n in zip(found, counts, strict=True):
            padded = np.zeros(n * step + WIDTH - 1, np.int32)
            padded[edge : edge + len(f)] = f
            for k in range(n):
                x[at + k] = padded[k * step : k * step + PIECE]
            at += n
        most, total, size = np.zeros((len(x), FILTERS)), np.zeros((len(x), FILTERS)), np.zeros(len(x))
        for i in range(0, len(x), 512):
            h, there, own = self._conv(x[i : i + 512])
            h = np.maximum(h, 0)
            most[i : i + 512] = (h * there[..., None]).max(1)
            total[i : i + 512], size[i : i + 512] = (h * own[..., None]).sum(1), own.sum(1)
        first = np.cumsum(counts) - counts
        return np.hstack([np.maximum.reduceat(most, first), np.add.reduceat(total, first) / np.maximum(1, np.add.reduceat(size, first))[:, None]])

    def logit(self, found: list[np.ndarray]) -> np.ndarray:
        return self.features(found) @ self.w + self.c if len(found) else np.zeros(0)

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(found) + self.shift, -40, 40)))

    def fit(self, found: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 1) -> CharCNN:
        r = np.random.default_rng(seed)
        held = np.arange(len(found)) % 4 == 0
        train_, length = np.flatnonzero(~held), np.array([len(x) for x in found])
        moments = [[np.zeros_like(np.asarray(v, float)) for _ in range(2)] for v in (self.k, self.b, self.w, self.c)]
        step = 0
        for _ in range(max(epochs, -(-STEPS * 64 // max(1, len(train_))))):
            # findings of about one length meet in a batch
            order = r.permutation(train_)
            order = np.concatenate([np.zeros(0, int), *(b[np.argsort(length[b], kind="stable")] for b in np.array_split(order, max(1, len(order) // 1024)))]).astype(int)
            batches = np.array_split(order, max(1, len(order) // 64))
            for at in (batches[i] for i in r.permutation(len(batches))):
                if not len(at):
                    continue
                x = np.zeros((len(at), max(len(found[i]) for i in at) + WIDTH - 1), np.int32)
                for row, i in enumerate(at):
                    x[row, WIDTH // 2 : WIDTH // 2 + len(found[i])] = found[i]
                blind = x[::2]
                blind[blind <= _CONTEXT] = 0  # half of the time the network sees no context
                h, there, own = self._conv(x)
                h = np.maximum(h, 0) * there[..., None]
                top, size = h.argmax(1), np.maximum(1, own.sum(1))
                z = np.hstack([np.take_along_axis(h, top[:, None], 1)[:, 0], (h * own[..., None]).sum(1) / size[:, None]])
                g = (1 / (1 + np.exp(-np.clip(z @ self.w + self.c, -40, 40))) - y[at]) / len(at)
                gh = own[..., None] * (g[:, None] * self.w[FILTERS:] / size[:, None])[:, None, :]
                np.put_along_axis(gh, top[:, None], np.take_along_axis(gh, top[:, None], 1) + (g[:, None] * self.w[:FILTERS])[:, None], 1)
                gh = (gh * (h > 0)).reshape(-1, FILTERS)
                gk, n = np.zeros_like(self.k), h.shape[1]
                some = np.flatnonzero(gh.any(1))
                part = gh[some].astype(np.float32)
                for j in range(WIDTH):
                    hot = np.zeros((len(some), gk.shape[1]), np.float32)
                    hot[np.arange(len(some)), x[:, j : j + n].ravel()[some]] = 1
                    gk[j] = hot.T @ part
                gk[:, 0] = 0
                step += 1
                new = []
                for v, d, mo in zip((self.k, self.b, self.w, self.c), (gk, gh.sum(0), z.T @ g, g.sum()), moments, strict=True):
                    mo[0] = 0.9 * mo[0] + 0.1 * d
                    mo[1] = 0.99 * mo[1] + 0.01 * d * d
                    new.append(v - rate * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.99**step)) + 1e-8))
                self.k, self.b, self.w, self.c = new
        z, t = self.logit([found[i] for i in np.flatnonzero(held)]), y[held].astype(float)
        for _ in range(400):  # Platt scaling on the fold apart
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))
            self.scale -= 0.1 * float(((p - t) * z).mean())
            self.shift -= 0.1 * float((p - t).mean())
        hits = np.sort(1 / (1 + np.exp(-np.clip(self.scale * z[t == 1] + self.shift, -40, 40))))
        self.threshold = float(hits[int((1 - RECALL) * len(hits))]) if len(hits) else 1.0
        return self


def made_key(rng: np.random.Generator) -> str:
    form = FORMS[rng.integers(len(FORMS))]
    return "".join(p if isinstance(p, str) else "".join(rng.choice(list(p[0]), p[1])) for p in form)


def made_name(rng: np.random.Generator, words: list[str]) -> str:
    """A name, path, version, date or number of a text's words, as long as keys are."""
    def word() -> str:
        return words[rng.integers(len(words))] if words else "word"

    def number(n: int) -> str:
        return "".join(rng.choice(list(_DIGITS), n))

    kind, out = rng.integers(8), ""
    if kind == 0:
        return number(int(rng.integers(LEAST, 24)))
    if kind == 1:
        return f"20{number(2)}-{number(2)}-{number(2)}T{number(2)}.{number(2)}.{number(2)}Z"
    while len(out) < LEAST or (len(out) < 60 and rng.random() < 0.5):
        w = word()
        out += {2: "_", 3: "-", 4: "/", 5: ".", 6: ""}.get(int(kind), "")
        out += w.capitalize() if kind == 6 else w if kind < 7 else w + number(int(rng.integers(1, 3))) + "-"
    out = out.strip("_-/.") if kind != 4 else out
    return out.upper() if rng.random() < 0.3 else out


def labelled(text: str) -> list[tuple[int, np.ndarray]]:
    """A sampled text's findings: (label, numbers of characters)."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    hits = base_spans(text)
    got = [(1, x) for x in sequences(text, [h[:2] for h in hits])]
    runs = candidates(text, hits)
    got += [(0, x) for x in sequences(text, [runs[i] for i in rng.permutation(len(runs))[:SAMPLE_RUNS]])]
    places = [m.end() for m in re.finditer(r"\s", text)] or [len(text)]
    words = re.findall(r"[A-Za-z]{2,12}", text)
    for label in (0, 1):
        for _ in range(MADE):
            found, before = made_key(rng) if label else made_name(rng, words), _BEFORE[rng.integers(len(_BEFORE))]
            at = places[rng.integers(len(places))]
            left, right = text[max(0, at - CONTEXT) : at] + before, text[at : at + CONTEXT]
            right = right if right[:1].isspace() else " " + right
            got += [(label, x) for x in sequences(left + found + right, [(len(left), len(left) + len(found))])]
    return [(y, x) for y, x in got if len(x) <= LONGEST]


def train(docs: DataFrame) -> CharCNN | None:
    """Fit the network on findings of a bounded sample of documents; None if they are too few."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["h", "n", "x"]
    rows = docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", F.lit("secrets")).alias("h"), F.length(text).alias("n"), F.xxhash64(text).alias("x"), text.alias("text"))
    # keys are chosen without their texts, which are then fetched for at most 2 * SAMPLE_DOCS keys
    both = [rows.filter(F.col("text").rlike(KEY_WORDS)), rows]
    picked = [r.select(*key).orderBy(*key).limit(SAMPLE_DOCS).withColumn("part", F.lit(n)) for n, r in enumerate(both)]
    chosen = picked[0].unionByName(picked[1]).distinct()
    sample = rows.join(F.broadcast(chosen), key).groupBy("part", *key).agg(F.min("text").alias("text")).select("text")

    def findings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [f for t in batch["text"] for f in labelled(t)]
            yield pd.DataFrame({"y": [g[0] for g in got], "x": [g[1] for g in got]})

    found = checkpoint(sample.mapInPandas(findings, "y int, x array<int>"))
    rows_ = [r for label in (0, 1) for r in found.filter(F.col("y") == label).orderBy(F.xxhash64("x"), "x").limit(SAMPLE_FINDINGS).collect()]
    y = np.array([r[0] for r in rows_])
    if min((y == 0).sum(), (y == 1).sum()) < FEWEST:
        return None
    order_ = np.random.default_rng(0).permutation(len(y))
    return CharCNN().fit([np.array(rows_[i][1], np.int32) for i in order_], y[order_])


def spans_of_all(texts: list[str], model: CharCNN | None) -> list[list[tuple[str, int, int, float]]]:
    """All spans (kind, start, end, score) of each text by start, then kind as listed; findings are scored together."""
    found, all_ = [], []
    for text in texts:
        base = base_spans(text)
        more = candidates(text, base) if model else []
        found.append((base, more))
        if model and (base or more):
            all_ += sequences(text, [(s, e) for s, e, _ in base] + more)
    score, at, out = model.score(all_).tolist() if model else [], 0, []
    for base, more in found:
        mine = score[at : at + len(base) + len(more)] or [1.0] * len(base)
        at += len(base) + len(more)
        spans = [(k, s, e, p) for (s, e, k), p in zip(base, mine, strict=False)]
        spans += [("cnn", s, e, p) for (s, e), p in zip(more, mine[len(base) :], strict=True) if p >= model.threshold]
        out.append(sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
    return out


def spans_of(text: str, model: CharCNN | None) -> list[tuple[str, int, int, float]]:
    return spans_of_all([text], model)[0]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: a worker holds the texts of one of them as Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    give_back()


def find_secrets(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """(doc_id, spans array of (kind, start, end, score)) for every whole text; offsets in code points."""
    model = model or train(docs)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in of] for i in range(0, len(texts), 64) for of in spans_of_all(texts[i : i + 64], model)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, "text").mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>")


def secret_digests(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """Counts and digests of the spans, one row per document."""
    found = find_secrets(docs, model)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] != "cnn")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: CharCNN | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced in ``text`` (and ``n_chars``, if present, made to agree)."""
    model = model or train(docs)
    fields = docs.columns

    def clean(text: str | None, spans: list) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, s, e, _ in spans:
            if e > at:
                out += [text[at : max(s, at)], mark] if s >= at else []
                at = e
        return "".join(out) + text[at:] if at else text

    def run(batches):
        for batch in _small(batches):
            texts = batch.column(fields.index("text")).to_pylist()
            texts = [clean(t, of) for i in range(0, len(texts), 64) for t, of in zip(texts[i : i + 64], spans_of_all([t or "" for t in texts[i : i + 64]], model), strict=True)]
            columns = list(batch.columns)
            columns[fields.index("text")] = pa.array(texts, batch.schema.field(fields.index("text")).type)
            if "n_chars" in fields:
                columns[fields.index("n_chars")] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(fields.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    # names with dots do not pass mapInArrow
    plain = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    return plain.mapInArrow(run, plain.schema).toDF(*fields)


by_value(__name__)
