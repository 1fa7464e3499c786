"""Byte-level BPE in DuckDB, one embedded database per task.

A task splits its texts into pieces, collects the pieces it has not met, and lets recursive queries
encode them: rows of (piece, position, token) join the merge table, each piece's leftmost pair of
lowest rank is contracted, and a piece leaves the recursion when no pair is left. An ordered
aggregation then gives each piece its ids and, through the vocabulary, its decoded bytes. Texts are
put together from their pieces, so nothing is shuffled and a row's work does not depend on others.

The vocabulary (its size is fixed by its file: some 50,000 entries, 1 MB) is read on the driver and
broadcast. Some ``REMEMBER`` pieces are remembered per task, those in use longest; texts are taken in chunks of ``CHUNK``
characters, so memory is bounded by those and by the longest text. Pieces over ``LONG`` bytes (the
recursion writes all rows of a piece again for each merge) go through a heap with the same merge rule.

Defined cases: a null text counts as empty and has no tokens; null ids stay null and ids of any size
stay exact; repeated rows are encoded alike; pairs of equal rank go from the left; an empty table gives
an empty table; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, give_back

CHUNK, REMEMBER, LONG = 2_000_000, 200_000, 200
STEPS = 800_000  # rows that one query may write, at most (a piece of n bytes: n * n / 2)

#: A row is a token with its successor and the rank of their pair (null: none). Each step looks at a word's
#: pair of lowest rank, the leftmost of equal ones: its right token becomes the merged one, its left token
#: goes, positions close up, and only rows beside the merge look up a new rank.
_ENCODE = """
WITH RECURSIVE s(w, p, t, nt, r, done) AS (
  SELECT w, p, t, nt, c, false FROM start LEFT JOIN merges ON ab = t * 1048576::BIGINT + nt
  UNION ALL
  (WITH best AS MATERIALIZED (
     SELECT w, arg_min(p, r * 1048576::BIGINT + p) AS k, min(r) AS c FROM s WHERE r IS NOT NULL GROUP BY w),
   x AS (
     SELECT s.w, CASE WHEN p > k THEN p - 1 ELSE p END AS p, CASE WHEN p = k + 1 THEN c ELSE t END AS t,
       CASE WHEN p = k - 1 THEN c ELSE nt END AS nt, r, p BETWEEN k - 1 AND k + 1 AS touched, k IS NULL AS done
     FROM s LEFT JOIN best ON s.w = best.w WHERE NOT done AND p IS DISTINCT FROM k)
   SELECT w, p, t, nt, CASE WHEN touched THEN m.c ELSE r END, done
   FROM x LEFT JOIN merges m ON m.ab = CASE WHEN touched THEN t * 1048576::BIGINT + nt END))
SELECT w, string_agg(t::VARCHAR, ' ' ORDER BY p) AS ids, string_agg(h, '' ORDER BY p) AS bytes
FROM s JOIN vocabulary v ON v.id = s.t WHERE done GROUP BY w
"""


def load_vocabulary(path: str) -> list[bytes]:
    """Tokens by id from a file of lines "base64 rank" with ranks from 0."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long piece, with a heap over a linked list."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

    def push(i: int) -> None:
        if i >= 0 and (j := nxt[i]) < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    heap: list = []
    for i in range(len(parts)):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[i] < len(parts):
            prv[nxt[i]] = i
        push(prv[i])
        push(i)
    return [ranks[x] for x in parts if x is not None]


class Encoder:
    """Encodes pieces for one task."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        import re

        import duckdb
        import pyarrow as pa
        import regex

        self.pa, self.vocabulary, self.ranks = pa, vocabulary, {t: i for i, t in enumerate(vocabulary)}
        ranks = self.ranks
        merges = {ranks[t[:k]] << 20 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        # bounded by STEPS, so it need not spill: a task's own folder is no place for that
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        table = pa.table({"ab": pa.array(merges.keys(), pa.int64()), "c": pa.array(merges.values(), pa.int32())})
        words = pa.table({"id": pa.array(range(len(vocabulary)), pa.int32()), "h": [t.hex() for t in vocabulary]})
        for name, rows in (("merges", table), ("vocabulary", words)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.known: dict[str, tuple[str, bytes]] = {}
        self.before: dict[str, tuple[str, bytes]] = {}  # what was known earlier: a piece in use moves on
        # Classes are spelled out: \s of the regex module has more characters than Unicode's White_Space.
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{space}]+(?![^{space}])|[{space}]+")
        self.any = regex.compile(own)
        # Below U+0250 the same classes as plain ranges: the standard module is four times as fast.
        letters, digits = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
        low = own.replace(rf"[^{space}\p{{L}}\p{{N}}]", f"[^{space}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
        self.low = re.compile(low) if "\\p" not in low and "\\s" not in low else None
        self.high = re.compile("[^\\x00-\\u024f]")

    def pieces(self, text: str) -> list[str]:
        if self.low is not None and not self.high.search(text):
            return self.low.findall(text)
        return self.any.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        if len(self.known) > REMEMBER:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = []
        for piece in pieces - known.keys():
            if piece in before:
                known[piece] = before[piece]
            else:
                new.append(piece)
        byte, part, steps = self.bytes, [], 0
        for piece in new:
            b = piece.encode()
            if len(b) > LONG:
                ids = merge_long(b, self.ranks)
                known[piece] = " ".join(map(str, ids)), b"".join(self.vocabulary[x] for x in ids)
                continue
            part.append((piece, [byte[x] for x in b]))
            steps += len(b) * (len(b) + 1) // 2
            if steps > STEPS:
                self._query(part)
                part, steps = [], 0
        if part:
            self._query(part)

    def _query(self, part: list[tuple[str, list[int]]]) -> None:
        pa = self.pa
        w = [i for i, (_, t) in enumerate(part) for _ in t]
        p = [k for _, t in part for k in range(len(t))]
        t = [x for _, t in part for x in t]
        following = [x for _, t in part for x in (*t[1:], None)]
        self.con.register("start", pa.table({n: pa.array(c, pa.int32()) for n, c in (("w", w), ("p", p), ("t", t), ("nt", following))}))
        for i, ids, h in self.con.execute(_ENCODE).fetchall():
            self.known[part[i][0]] = ids, bytes.fromhex(h)
        self.con.unregister("start")

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by spaces, and the bytes they decode to."""
        chunk, chars = [], 0
        for k, text in enumerate(texts):
            chunk.append(self.pieces(text))
            chars += len(text)
            if chars >= CHUNK or k + 1 == len(texts):
                self.learn(set().union(*chunk))
                known = self.known
                for pieces in chunk:
                    both = [known[x] for x in pieces]
                    yield " ".join([x[0] for x in both]), b"".join([x[1] for x in both])
                chunk, chars = [], 0

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


def _over(docs: DataFrame, path: str, pattern: str | None, schema: str, rows) -> DataFrame:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary.value, pattern)
            texts = [x or "" for x in batch.column("text").to_pylist()]
            at, chars = 0, 0
            for k, text in enumerate(texts):  # results leave the worker chunk by chunk
                chars += len(text)
                if chars >= CHUNK or k + 1 == len(texts):
                    found = rows(batch.column("doc_id").slice(at, k + 1 - at), encoder, texts[at : k + 1])
                    yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
                    at, chars = k + 1, 0
        if encoder:  # the worker lives on: give back what this task held
            encoder.con.close()
            del encoder
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _digest_rows(ids: pa.Array, encoder: Encoder, texts: list[str]) -> dict[str, pa.Array]:
    out = [(s.count(" ") + 1 if s else 0, hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256(b).hexdigest()) for s, b in encoder.encode(texts)]
    return {"doc_id": ids, "n_tokens": pa.array([x[0] for x in out], pa.int64()), "ids_sha256": pa.array([x[1] for x in out], pa.string()), "decoded_sha256": pa.array([x[2] for x in out], pa.string())}


def _numbers(ids: str) -> np.ndarray:
    return np.fromiter(map(int, ids.split()), np.int32)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, decoded: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) for every whole text, and what the ids decode to.

    Without ``decoded`` the ids are decoded in their task all the same and held against the text, byte by
    byte; a text that they do not give back stops the job.
    """

    def rows(ids: pa.Array, encoder: Encoder, texts: list[str]) -> dict[str, pa.Array]:
        out = [(_numbers(s), b.decode("utf-8", "replace") if decoded else None) for s, b in encoder.encode(texts)]
        found = {"doc_id": ids, "ids": pa.array([x[0] for x in out], pa.list_(pa.int32()))}
        if decoded:
            return found | {"decoded": pa.array([x[1] for x in out], pa.string())}
        for doc_id, (numbers, _), text in zip(ids, out, texts, strict=True):
            if encoder.decode(numbers) != text.encode():
                raise ValueError(f"the ids of document {doc_id} do not decode to its text")
        return found

    return _over(docs, path, pattern, "doc_id long, ids array<int>" + ", decoded string" * decoded, rows)


def encode_digests(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every whole text; ids stay in their task."""
    return _over(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_rows)


by_value(__name__)
