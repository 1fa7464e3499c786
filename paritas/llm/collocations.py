"""Phrase collocation mining: count tries per shard, serialised in order and merged by ranges of prefixes.

Each task reads its texts into tries of depth three, one for each language. A trie is one sorted array: a node
is a number that holds the ranks of its words in the trie's sorted dictionary, with a field of zero for each
word that it lacks, so the order of numbers is the order of a walk. A trie that has taken in ``TRIE_WORDS``
words is written out and a new one begins, which bounds a task's memory.

Tries are cut at the same paths everywhere, and each range of prefixes is merged in one task: the pieces of
all shards are sorted runs, which a stable sort merges, and counts of equal paths are added. A cut may lie
anywhere below a word, so a word that begins a third of all phrases is dealt to many ranges; each piece also
carries its shard's counts of the words and pairs above its cut, so a range knows all that its walk needs. A walk over
a merged range gives each node's left parts, the counts of the nodes above it. Right parts come by suffix
links: a pair's link is its second word, a triple's link is the pair of its last two words, whose own link is
already known. Nodes of fewer than ``least`` occurrences take part in counts and end after the merge, since
no part of a phrase is rarer than the phrase.

Cuts are chosen from a sample of some documents a range; they decide where nodes are merged and nothing else.
Counts, scores and ranks are exact: scores are decimals of 38 digits, which hold counts up to 10 to the 15th.

Defined cases: null and empty texts have no words; a null language is ``und``. Repeated rows count each time.
Very long texts and long pieces are read whole. Ties of scores go to the higher count and then to the phrase
in UTF-8 byte order. An empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.shared import arrow_rows, by_value, written

#: Words that one trie takes in, and so bounds a task's memory; three ranks of 21 bits fill a node's number.
TRIE_WORDS = 600_000
BITS = 21
#: Ranges of prefixes for each partition of the input or the shuffle, whichever are more.
RANGES = 2
FIELD = (1 << BITS) - 1
#: Documents and paths a document in the sample that cuts the ranges, and bytes of a word in a cut.
CUT_DOCS, CUT_PATHS, CUT_BYTES = 4, 16, 32
#: Texts in a batch of rows.
ROWS = 256
#: Ends a piece; no UTF-8 text has this byte.
_END = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")
_EACH_END = b" " + _END + b" "


def _tokens(texts: list[str]) -> list[bytes]:
    """Words of all texts in order, in ASCII lower case, with an end after each piece."""
    data = _EACH_END.join(t.encode() for t in texts).lower().translate(_PIECES)
    return data.replace(_END, _EACH_END).split() + [_END]


def _code(dictionary: list[bytes], path: tuple[bytes, ...]) -> int:
    """The least number of a node that stands at ``path`` or after it."""
    out = 0
    for depth, word in enumerate(path):
        rank = bisect_left(dictionary, word)
        out |= (rank + 1) << BITS * (2 - depth)
        if rank == len(dictionary) or dictionary[rank] != word:
            break
    return out


class Trie:
    """Encoded words of one shard and language, and their trie."""

    def __init__(self) -> None:
        self.parts: list = []
        self.words = 0

    def add(self, tokens: list[bytes]) -> None:
        import pyarrow as pa

        self.parts.append(pa.array(tokens, pa.binary()).dictionary_encode())
        self.words += len(tokens)

    def nodes(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The sorted dictionary, the nodes' numbers in order and their counts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        one = pa.chunked_array(self.parts).unify_dictionaries().combine_chunks()
        order = pc.sort_indices(one.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = rank[one.indices.to_numpy()] + 1
        ids[ids == len(order)] = 0  # the end of a piece sorts last
        dictionary = one.dictionary.take(pa.array(order[:-1])).to_pylist()
        there = (ids[:-1] > 0) & (ids[1:] > 0)
        pairs = (ids[:-1] << 2 * BITS) | (ids[1:] << BITS)
        triples = (pairs[:-1] | ids[2:])[there[:-1] & there[1:]]
        codes = np.concatenate([ids[ids > 0] << 2 * BITS, pairs[there], triples])
        del one, order, rank, ids, there, pairs, triples
        codes.sort()
        begins = np.flatnonzero(np.diff(codes, prepend=-1))
        return dictionary, codes[begins], np.diff(begins, append=len(codes))


def _packed(values: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _pieces(lang: str, trie: Trie, cuts: list[tuple]):
    """A trie cut into its ranges: (range, lang, words, nodes, fields, counts, counts above the cut)."""
    dictionary, codes, counts = trie.nodes()
    if not len(codes):
        return

    def count(code: int) -> int:
        at = np.searchsorted(codes, code)
        return int(counts[at]) if at < len(codes) and codes[at] == code else 0

    starts, above = [0], [(0, 0)]
    for cut in cuts:
        if cut[0] == lang:
            path = cut[1:]
            starts.append(int(np.searchsorted(codes, _code(dictionary, path))))
            ranks = [bisect_left(dictionary, w) for w in path[:2]]
            known = [r < len(dictionary) and dictionary[r] == w for r, w in zip(ranks, path)]
            one = count((ranks[0] + 1) << 2 * BITS) if len(path) > 1 and known[0] else 0
            two = count((ranks[0] + 1) << 2 * BITS | (ranks[1] + 1) << BITS) if len(path) > 2 and all(known) else 0
            above.append((one, two))
        else:
            starts.append(0 if cut[0] < lang else len(codes))
            above.append((0, 0))
    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(codes)])):
        if lo == hi and above[k] == (0, 0):
            continue
        part = codes[lo:hi]
        fields = np.stack([part >> 2 * BITS, part >> BITS & FIELD, part & FIELD])
        used, fields = np.unique(fields, return_inverse=True)
        if not len(used) or used[0]:  # zero stands for no word
            used, fields = np.insert(used, 0, 0), fields + 1
        words = b" ".join([dictionary[i - 1] for i in used[1:]])
        yield k, lang, words, hi - lo, _packed(fields.astype(np.uint32)), _packed(counts[lo:hi].astype(np.int64)), *above[k]


PIECE = "range int, lang string, words binary, nodes long, fields binary, counts binary, above1 long, above2 long"
NODE = "lang string, depth int, phrase string, suffix string, a long, left1 long, left2 long"


def _shard(cuts: list[tuple]):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("nodes", pa.int64()), ("fields", pa.binary()), ("counts", pa.binary()), ("above1", pa.int64()), ("above2", pa.int64())])
        tries: dict[str, Trie] = {}

        def out():
            for lang, trie in tries.items():
                rows = list(_pieces(lang, trie, cuts))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            tries.clear()

        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                tries.setdefault(lang, Trie()).add(_tokens(texts))
            if sum(t.words for t in tries.values()) >= TRIE_WORDS:
                yield from out()
        yield from out()

    return run


def _merged(least: int):
    """All pieces of one range and language -> its nodes of ``least`` occurrences or more, and its words (depth 0)."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        lang = table.column("lang")[0].as_py()
        lists = [pa.array(w.as_py().split(b" ") if w.as_py() else [], pa.binary()) for w in table.column("words")]
        one = pa.concat_arrays(lists).dictionary_encode()
        order = pc.sort_indices(one.dictionary).to_numpy()
        rank = np.zeros(len(order) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(order) + 1)
        at, codes, counts = 0, [], []
        for words, n, fields, c in zip(lists, table.column("nodes").to_pylist(), table.column("fields"), table.column("counts")):
            local = rank[np.concatenate([[0], one.indices[at : at + len(words)].to_numpy() + 1]).astype(np.int64)]
            at += len(words)
            f = local[_unpacked(fields.as_py(), 3 * n, np.uint32)].reshape(3, n)
            codes.append(f[0] << 2 * BITS | f[1] << BITS | f[2])
            counts.append(_unpacked(c.as_py(), n, np.int64))
        codes, counts = np.concatenate(codes), np.concatenate(counts)
        del lists
        merged = np.argsort(codes, kind="stable")  # runs in order: they are merged
        codes, counts = codes[merged], counts[merged]
        begins = np.flatnonzero(np.diff(codes, prepend=-1))
        codes, counts = codes[begins], np.add.reduceat(counts, begins) if len(begins) else counts
        # the walk: the last word and the last pair before a node are above it, or stand above the range's cut
        above = [sum(table.column(x).to_pylist()) for x in ("above1", "above2")]
        depth = 1 + (codes >> BITS & FIELD > 0) + (codes & FIELD > 0)
        places = np.arange(len(codes))
        left = []
        for d in (1, 2):
            last = np.maximum.accumulate(np.where(depth == d, places, -1))
            mask = ~((1 << (3 - d) * BITS) - 1)
            here = (last >= 0) & (codes[last] == codes & mask)
            left.append(np.where(here, counts[last], above[d - 1]) if len(codes) else counts)
        often = np.flatnonzero(counts >= least)
        names = [w.decode() for w in one.dictionary.take(pa.array(order)).to_pylist()] if len(often) else []
        rows = [(lang, 0, "", None, int(counts[depth == 1].sum()), 0, 0)]
        for i in often.tolist():
            c = int(codes[i])
            words = [names[x - 1] for x in (c >> 2 * BITS, c >> BITS & FIELD, c & FIELD) if x]
            rows.append((lang, len(words), " ".join(words), " ".join(words[1:]), int(counts[i]), int(left[0][i]), int(left[1][i])))
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({x.split(" ")[0]: pa.array(c, t) for x, c, t in zip(NODE.split(", "), zip(*rows), types)})

    return run


def _paths(batches):
    """Some paths of each text, cut short: (lang, w1, w2, w3)."""
    import pyarrow as pa

    for b in batches:
        found = []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            tokens = _tokens([text])
            for i in range(0, len(tokens), max(1, len(tokens) // CUT_PATHS)):
                path = [w[:CUT_BYTES] for w in tokens[i : i + 3]]
                if _END not in path and len(path) == 3:
                    found.append((lang, *path))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.string(), *[pa.binary()] * 3])], names=["lang", "w1", "w2", "w3"])


def _cuts(texts: DataFrame, ranges: int) -> list[tuple]:
    """Paths that cut the walk into about equal ranges; at most ``CUT_DOCS * CUT_PATHS`` paths a range reach the driver."""
    rows = texts.count()
    if not rows or ranges < 2:
        return []
    share = min(1.0, ranges * CUT_DOCS / rows)
    sample = texts.sample(share, seed=11) if share < 1 else texts
    paths = sample.mapInArrow(_paths, "lang string, w1 binary, w2 binary, w3 binary").limit(2 * ranges * CUT_DOCS * CUT_PATHS).collect()
    paths = sorted({(r[0], bytes(r[1]), bytes(r[2]), bytes(r[3])) for r in paths})
    return sorted({paths[k * len(paths) // ranges] for k in range(1, ranges)}) if paths else []


def nodes_of(docs: DataFrame, least: int) -> DataFrame:
    """Merged trie nodes of ``least`` occurrences or more: lang, depth, phrase, suffix, a, left1, left2."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")
    with arrow_rows(spark, ROWS):
        cuts = _cuts(texts, RANGES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions()))
        tries = written(texts.mapInArrow(_shard(cuts), PIECE), "tries")
        return written(tries.groupBy("range", "lang").applyInArrow(_merged(least), NODE), "nodes")


def mine_collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two and three words of each language by score."""
    nodes = nodes_of(docs, least)
    depth = [nodes.filter(F.col("depth") == d) for d in range(4)]
    total = depth[0].groupBy("lang").agg(F.sum("a").alias("n"))
    # suffix links: from a pair to its second word, from a triple to the pair of its last words and on to the word
    word = depth[1].select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("right1"))
    pairs = depth[2].join(word, ["lang", "suffix"]).select("lang", "phrase", "a", "left1", "right1")
    pair = pairs.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("right1"), F.col("right1").alias("right2"))
    triples = depth[3].join(pair, ["lang", "suffix"])

    def score(left: str, right: str):
        return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST({left} AS DECIMAL(16,0)) * CAST({right} AS DECIMAL(16,0))) AS BIGINT)")

    # a pair goes if a triple that holds it is at least half as frequent
    inside = depth[3].select("lang", "a", F.explode(F.array_distinct(F.array("suffix", F.regexp_extract("phrase", "(?s)^(.*) [^ ]*$", 1)))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    pairs = pairs.select("lang", "phrase", "a", F.col("left1").alias("l"), F.col("right1").alias("r"), score("left1", "right1").alias("score"))
    cuts = triples.select("lang", "phrase", "a", F.array(*[F.struct(score(f"left{k}", f"right{k}").alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("r")) for k in (1, 2)]).alias("cuts"))
    triples = cuts.select("lang", "phrase", "a", F.array_min("cuts").alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    # each language's best, first within parts of its phrases
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same rows by counting all phrases.
ORACLE = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, x, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, x, f AS a, string_split(x, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
e AS (SELECT c.*, i, array_to_string(list_slice(w, 1, i), ' ') AS lx, array_to_string(list_slice(w, i + 1, k), ' ') AS rx FROM c, (VALUES (1), (2)) t(i) WHERE i < k),
s AS (SELECT e.lang, e.k, e.x, e.a, i, fl.f AS l, fr.f AS r, (1000000::HUGEINT * e.a * e.a) // (fl.f::HUGEINT * fr.f) AS score
  FROM e JOIN f fl ON fl.lang = e.lang AND fl.x = e.lx AND fl.k = i JOIN f fr ON fr.lang = e.lang AND fr.x = e.rx AND fr.k = e.k - i),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, i) AS best FROM s),
h AS (SELECT lang, array_to_string(list_slice(w, j, j + 1), ' ') AS x, max(a) AS longer FROM c, (VALUES (1), (2)) t(j) WHERE k = 3 GROUP BY ALL),
o AS (SELECT b.lang, b.x AS phrase, a, l, r, score FROM b LEFT JOIN h ON b.lang = h.lang AND b.x = h.x WHERE best = 1 AND (k = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n ON q.lang = n.lang WHERE rank <= 2000"""

by_value(__name__)
