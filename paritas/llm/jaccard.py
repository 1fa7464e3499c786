"""N-gram Jaccard join with set-relation skipping.

A document's set is its 64-bit shingle hashes. Equal sets share a digest and are one node from then on.
The join is exact: a prefix filter finds every pair that can reach the threshold, bounds on sizes and
positions skip most of them, and the rest is decided on whole sets.

1. Counting. Tasks cut their rows into slices, reduce copies to distinct sets and deal their tokens by
   hash into buckets (packed arrays, each token once a slice). A bucket counts its tokens and sends
   those that occur twice or more back to their slices. So tokens are ordered by the frequency that they
   have in the whole table, and a set knows how many of its tokens (``own``) no other set holds.
2. Prefixes. Two sets can only link if their prefixes in that order share a token. Passages that many
   documents share are frequent, come last and are in few prefixes; most sets have none and are done.
3. Index. Lists of equal members are one list. ``own`` and the size give each set the range of sizes
   that a partner can have (``most``). Lists whose sets lie in one cluster are skipped, and sets that no
   size in their list lets link.
4. Answers. In each list sets are compared with a leader, the set with the fewest tokens of its own, and
   sets linked so form clusters; within a cluster no further pair has to be found. What is left is
   derived from the distances to the leader: blocks (a cluster in a leader's group) are skipped by their
   extremes, some links are sure by the triangle inequality, and any other pair has to share enough of
   its differences from the leader, which a prefix filter over those differences finds.

Nothing is gathered by list: leaders are minima, and the joins by list have a small side or few rows.
The sets themselves are made again, for those documents only that share a list with others; a bitmap
sized by their number (broadcast up to ``MOST_BITS``; beyond it a join) picks them from the table.

Rows should come from files or a checkpoint, so that a lost task reads the same rows again. Defined
cases: null and empty texts have empty sets, link with nothing and are their own component; with fewer
than five words the whole sequence is the one shingle; null ids take part, and a component's id is the
smallest id that is not null (null if there is none); repeated rows are equal sets; texts of any length
are taken whole; ties of size or frequency go by hash; an empty table gives an empty table; other
columns are not touched, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.components import components
from paritas.llm.shared import arrow_rows, by_value, checkpoint, free_name, give_back, may_hold, written

WORDS, NUM, DEN = 5, 75, 100  # shingle length; a link needs DEN * intersection >= NUM * union
SLICE, SLICE_ROWS = 500_000, 60_000  # tokens and sets of a slice
BUCKET_BYTES = 12_000_000  # of text, for each bucket of tokens
ROWS = 200  # per Arrow batch
PAIR_ROWS = 50  # of pairs with both whole sets
MOST_BITS = 1 << 27  # 16 MB
_ROWS = "doc_id long, th long, key binary, n long, own long, last long, prefix array<long>"
_BLOBS = "bucket long, slice long, tokens binary, rows binary, classes binary"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    w = text.encode().lower().split() if isinstance(text, str) else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    s = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(words):
        s += h[i : i + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64 | 1
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def set_key(u: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(u.tobytes())


def prefix_size(n):
    return n - -(-NUM * n // DEN) + 1


# -- counting ---------------------------------------------------------------------------------------


def _slice_blobs(number: int, buckets: int, sets: dict[bytes, np.ndarray], rows: list[tuple]) -> list[tuple]:
    """A slice's tokens by bucket, and its rows with what the tokens' buckets need not see."""
    sizes = np.array([len(u) for u in sets.values()], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
    row = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
    again = np.flatnonzero(~first)  # a token goes to its bucket once; further rows that hold it stay with the slice
    several = np.zeros(len(tokens), bool)
    several[again - 1] = True
    extra = (tokens[again], row[again])
    tokens, row, several = tokens[first], row[first], several[first]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    tokens, row, several = ((tokens // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order], row[order], several[order]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    out = []
    for b in range(buckets):
        lo, hi = (int(ends[b - 1]) if b else 0), int(ends[b])
        if hi > lo:
            out.append((b, number, tokens[lo:hi].tobytes(), row[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes()))
    held = pickle.dumps((list(sets), sizes, rows, extra, buckets))
    return [*out, (number % buckets, number, held, None, None)]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of each blob the tokens that the bucket holds twice or more, with a class of their frequency."""
    slices, tokens, rows, several = (table.column(c).to_pylist() for c in ("slice", "tokens", "rows", "classes"))
    bucket = table.column("bucket")[0].as_py()
    mine = [i for i, r in enumerate(rows) if r is not None]
    out = [(bucket, slices[i], tokens[i], None, None) for i, r in enumerate(rows) if r is None]
    if mine:
        t = np.concatenate([np.frombuffer(tokens[i], "<u4") for i in mine])
        sizes = [len(tokens[i]) // 4 for i in mine]
        here = 1 + np.concatenate([np.unpackbits(np.frombuffer(several[i], np.uint8), count=n) for i, n in zip(mine, sizes, strict=True)]).astype(np.int64)
        known, at = np.unique(t, return_inverse=True)
        count = np.bincount(at, here)[at]
        kind = np.minimum(127, np.floor(4 * np.log2(count))).astype(np.uint8)
        end = 0
        for i, n in zip(mine, sizes, strict=True):
            part = slice(end, end + n)
            end += n
            often = count[part] >= 2
            if often.any():
                out.append((bucket, slices[i], t[part][often].tobytes(), np.frombuffer(rows[i], "<u2")[often].tobytes(), kind[part][often].tobytes()))
    return pa.Table.from_batches([_arrow(out, table.schema)], table.schema)


def _code(bucket, token) -> np.ndarray:
    """A token's name: its bucket and 32 bits of the rest of its hash. Two tokens of one name only cost time."""
    return (np.asarray(bucket).astype(np.int64) << 32) | np.asarray(token).astype(np.int64)


def _prefixes(table: pa.Table) -> pa.Table:
    """A slice's rows with the shared tokens of their prefixes."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("own", pa.int64()), ("last", pa.int64()), ("prefix", pa.list_(pa.int64()))])
    buckets, tokens, rows, kinds = (table.column(c).to_pylist() for c in ("bucket", "tokens", "rows", "classes"))
    held = next(tokens[i] for i, r in enumerate(rows) if r is None)
    keys, n, docs, (more, more_row), number = pickle.loads(held)
    mine = [i for i, r in enumerate(rows) if r is not None]
    code = np.concatenate([np.zeros(0, np.int64), *(_code(buckets[i], np.frombuffer(tokens[i], "<u4")) for i in mine)])
    row = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(rows[i], "<u2").astype(np.int64) for i in mine)])
    kind = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(kinds[i], np.uint8).astype(np.int64) for i in mine)])
    if len(more):
        extra = _code(more % np.uint64(number), (more // np.uint64(number)) & np.uint64(0xFFFFFFFF))
        by = np.argsort(code, kind="stable")
        at = by[np.minimum(np.searchsorted(code, extra, sorter=by), len(code) - 1)]
        code, row, kind = np.r_[code, extra], np.r_[row, more_row.astype(np.int64)], np.r_[kind, kind[at]]
    place = kind << 56 | code
    order = np.lexsort((place, row))
    place, code, row = place[order], code[order], row[order]
    have = np.bincount(row, minlength=len(n))
    own = n - have
    at = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
    want = np.maximum(0, prefix_size(n) - own)
    inside = at < want[row]
    # tokens of one name at the end of a prefix go in together
    last = np.full(len(n), -1, np.int64)
    np.maximum.at(last, row[inside], place[inside])
    inside |= place == last[row]
    inside[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1])  # each name once
    code, row = code[inside], row[inside]
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(n)))]
    of = np.array([d[2] for d in docs], np.int64)
    lists = [code[ends[s] : ends[s + 1]] for s in of.tolist()]
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    columns = [
        pa.array([d[0] for d in docs], pa.int64()),
        pa.array([d[1] for d in docs], pa.int64()),
        pa.array([keys[s] for s in of.tolist()], pa.binary()),
        pa.array(n[of], pa.int64()),
        pa.array(own[of], pa.int64()),
        pa.array(last[of], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def make_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Every document with its set's digest, size, own tokens and the shared tokens of its prefix."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(12, size // BUCKET_BYTES + 1)
    schema = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("tokens", pa.binary()), ("rows", pa.binary()), ("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        sets, place, out, have = {}, {}, [], 0
        for batch in batches:
            for doc, text, th in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "th")), strict=True):
                u = shingles(text, words)
                key = set_key(u)
                if key not in sets:
                    place[key] = len(sets)
                    sets[key] = u
                    have += len(u)
                out.append((doc, th, place[key]))
                if have >= SLICE or len(sets) >= SLICE_ROWS or len(out) >= 4 * SLICE_ROWS:
                    yield _arrow(_slice_blobs(number, buckets, sets, out), schema)
                    number, sets, place, out, have = number + 1, {}, {}, [], 0
        if out:
            yield _arrow(_slice_blobs(number, buckets, sets, out), schema)
        sets, place, out = {}, {}, []
        give_back()

    with arrow_rows(docs.sparkSession, ROWS):
        counted = rows.mapInArrow(run, _BLOBS).groupBy("bucket").applyInArrow(_count_bucket, _BLOBS)
        return written(counted.groupBy("slice").applyInArrow(_prefixes, _ROWS), "sets")


# -- index and answers ------------------------------------------------------------------------------


def _lists(nodes: DataFrame) -> DataFrame:
    """(list, m, key, n, own, last, most): members of lists of two sets or more, equal lists once."""
    entries = nodes.select(F.explode("prefix").alias("list"), "key", "n", "own", "last")
    h = [F.xxhash64("key", F.lit(i)) for i in range(2)]
    alike = entries.groupBy("list").agg(F.count("*").alias("k"), *[F.bit_xor(x).alias(f"h{i}") for i, x in enumerate(h)]).filter("k > 1")
    once = alike.groupBy("k", "h0", "h1").agg(F.min("list").alias("list"), F.count("*").alias("m")).select("list", "m")
    # the largest partner: an intersection of n - own at most is NUM / (NUM + DEN) of both sizes
    most = F.floor(F.least(DEN * F.col("n") / NUM, (NUM + DEN) * (F.col("n") - F.col("own")) / NUM - F.col("n"))).cast("long")
    return checkpoint(entries.join(once, "list").withColumn("most", most))


def _roots(df: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias(key), F.col("root").alias(name))
    return df.join(r, key, "left").withColumn(name, F.coalesce(name, key))


def _fits(x: str, y: str) -> Column:
    """Whether the sets' sizes lie in each other's ranges, and their clusters differ."""
    col = F.col
    return (col(f"n{x}") <= col(f"most{y}")) & (col(f"n{y}") <= col(f"most{x}")) & (col(f"root{x}") != col(f"root{y}"))


def _merged(clusters: DataFrame, upper: DataFrame) -> DataFrame:
    """(node, root) after roots got roots of their own."""
    up = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = clusters.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return checkpoint(moved.unionByName(upper.filter("node <> root").join(clusters.select("node"), "node", "left_anti")))


def _above(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of clusters, from links between their members."""
    over = _roots(_roots(links.select("a", "b"), clusters, "a", "ra"), clusters, "b", "rb").filter("ra <> rb")
    return components(over.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def sets_of(docs: DataFrame, need: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, data) for the sets of ``need`` (th): made again from their texts."""
    rows, _ = may_hold(docs.select("text", F.xxhash64("text").alias("th")), "th", need, MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            th, text = (batch.column(c).to_pylist() for c in ("th", "text"))
            new = [i for i, t in enumerate(th) if t not in done and not done.add(t)]
            if len(done) > 1_000_000:
                done.clear()
            sets = [shingles(text[i], words) for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(u) for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["key", "data"])
        give_back()

    with arrow_rows(docs.sparkSession, ROWS):
        return written(rows.mapInArrow(run, "key binary, data binary").groupBy("key").agg(F.first("data").alias("data")), "data")


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``both``: the size of the intersection of the sets a and b, on the whole sets."""
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("data").alias("da")), "a")
    joined = joined.join(sets.select(F.col("key").alias("b"), F.col("data").alias("db")), "b")
    names = [*pairs.columns, "both"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for x, y in zip(batch.column("da"), batch.column("db"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                u, v = (u, v) if len(u) <= len(v) else (v, u)
                both.append(int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(u) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(both, pa.int64())], names=names)

    with arrow_rows(sets.sparkSession, PAIR_ROWS):
        return checkpoint(joined.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", both long"))


def _linked(both: Column, na: Column, nb: Column) -> Column:
    return (NUM + DEN) * both >= NUM * (na + nb)


def _leaders(sets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their lists' leaders, and each set's distance to the leaders of its lists: (key, lead, n, nl, apart).

    A list's leader is its set with the smallest share of own tokens: the less a copy was edited, the
    fewer tokens it has that no other copy holds, and the more copies are similar to it.
    """
    order = F.struct((F.col("own") * 10_000 / F.col("n")).cast("long").alias("share"), "key", "n")
    lead = checkpoint(members.groupBy("list").agg(F.min(order).alias("f")).select("list", F.col("f.key").alias("lead"), F.col("f.n").alias("nl")))
    members = checkpoint(members.join(lead, "list"))
    pairs = members.filter("key <> lead").select(F.col("key").alias("a"), "n", F.col("lead").alias("b"), "nl").distinct()
    near = overlaps(sets, checkpoint(pairs))
    return members, near.select(F.col("a").alias("key"), F.col("b").alias("lead"), "n", "nl", (F.col("n") + F.col("nl") - 2 * F.col("both")).alias("apart"))


def _open(members: DataFrame) -> DataFrame:
    """Distinct (lead, key) of the lists that hold several clusters, without sets that no size in their list lets link."""
    by = members.groupBy("list").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("n").alias("least"), F.max("most").alias("top"))
    left = members.join(checkpoint(by.filter("r <> s")), "list").filter("most >= least AND n <= top")
    return left.select("lead", "key", "n", "own", "most", "root").distinct()


def _within_reach(found: DataFrame) -> DataFrame:
    """Sets of a leader's group that a set of another cluster may link with, by their distances to the leader.

    None of x's own tokens is among the differences that it shares with y, so x and y differ in at
    least apart(y) - apart(x) + 2 * own(x) tokens. They can link only if far(y) <= reach(x) and
    far(x) <= reach(y). A block, the part of a group that lies in one cluster, is known by its extremes.
    """
    col = F.col
    own = F.when(col("key") == col("lead"), 0).otherwise(col("own"))  # the leader differs from itself in nothing
    far, reach = (NUM + DEN) * col("apart") - (DEN - NUM) * col("n"), (NUM + DEN) * (col("apart") - 2 * own) + (DEN - NUM) * col("n")
    found = checkpoint(found.withColumns({"far": far, "reach": reach}))
    blocks = checkpoint(found.groupBy("lead", "root").agg(F.min("far").alias("far"), F.max("reach").alias("reach")))
    best = blocks.groupBy("lead").agg(F.min(F.struct("far", "root")).alias("f"), F.max(F.struct("reach", "root")).alias("r"))
    # the extremes of the blocks of a leader's other clusters
    others = blocks.join(best, "lead").groupBy("lead", "f", "r").agg(F.min(F.when(col("root") != col("f.root"), col("far"))).alias("f2"), F.max(F.when(col("root") != col("r.root"), col("reach"))).alias("r2"))
    least = F.when(col("root") == col("f.root"), col("f2")).otherwise(col("f.far"))
    most = F.when(col("root") == col("r.root"), col("r2")).otherwise(col("r.reach"))
    kept = found.join(others, "lead").withColumns({"least": least, "widest": most})
    return checkpoint(kept.filter("far <= widest AND reach >= least").drop("f", "r", "f2", "r2", "widest"))


def _sure(found: DataFrame) -> DataFrame:
    """Links (a, b) that distances to the leader prove. Of a set's links of this kind one is enough: the others lie in the leader's cluster."""
    least = found.groupBy("lead").agg(F.min(F.struct("far", "key", "root")).alias("y"))
    return found.join(least, "lead").filter("far + y.far <= 0 AND root <> y.root").select(F.col("key").alias("a"), F.col("y.key").alias("b"))


def _differences(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(lead, key, token): the tokens that a set and its leader do not share."""
    joined = found.select("lead", "key").join(sets.select("key", F.col("data").alias("dx")), "key").join(sets.select(F.col("key").alias("lead"), F.col("data").alias("dl")), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.setxor1d(*(np.frombuffer(z.as_buffer(), "<i8") for z in two), assume_unique=True) for two in zip(batch.column("dx"), batch.column("dl"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("key"), pa.array(tokens, pa.list_(pa.int64()))], names=["lead", "key", "tokens"])

    with arrow_rows(sets.sparkSession, ROWS):
        return checkpoint(joined.mapInArrow(run, "lead binary, key binary, tokens array<long>")).select("lead", "key", F.explode("tokens").alias("token"))


def _left_over(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between clusters that no distance has shown.

    Sets x and y of a leader's group differ in apart(x) + apart(y) - 2 * (shared differences from the
    leader) tokens. So they link only if they share enough of those, and a prefix filter over the
    differences, rare ones first, finds all such pairs (but for those that need share none, see ``_sure``).
    """
    col = F.col
    tokens = _differences(sets, found)
    often = checkpoint(tokens.groupBy("lead", "token").agg(F.count("*").alias("k")).filter("k > 1"))
    shared = tokens.join(often, ["lead", "token"]).groupBy("lead", "key").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("shared"))
    need = F.greatest(F.lit(1), F.ceil((col("far") + col("least")) / (2 * (NUM + DEN))))
    take = (F.size("shared") - need + 1).cast("int")  # differences that no other set of the group has come before the shared ones
    rows = found.join(shared, ["lead", "key"]).withColumn("take", take).filter("take > 0")
    rows = rows.withColumn("token", F.explode(F.slice("shared", F.lit(1), col("take")))).withColumn("token", col("token.token"))
    rows = checkpoint(rows.select("lead", "token", "key", "n", "most", "root", "far", "reach"))
    side = lambda s: rows.select("lead", "token", *[col(c).alias(c + s) for c in ("key", "n", "most", "root", "far", "reach")])
    joined = side("x").join(side("y"), ["lead", "token"]).filter(_fits("x", "y") & (col("keyx") < col("keyy")) & (col("farx") <= col("reachy")) & (col("fary") <= col("reachx")))
    pairs = checkpoint(joined.select(col("keyx").alias("a"), col("keyy").alias("b"), col("nx").alias("na"), col("ny").alias("nb")).distinct())
    return overlaps(sets, pairs).filter(_linked(col("both"), col("na"), col("nb"))).select("a", "b")


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    return _grouped(docs, words).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, th, n, top, component_id) for every document: its text's hash, its set's size, and the set that names its component."""
    col = F.col
    rows = make_rows(docs, words)
    nodes = rows.filter(F.size("prefix") > 0).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "own", "last", "prefix")], F.min("th").alias("th"))
    nodes = written(nodes, "nodes")
    members = _lists(nodes)
    need = nodes.join(members.select("key").distinct(), "key", "left_semi").select("th")
    sets = sets_of(docs, checkpoint(need), words)
    members, near = _leaders(sets, members)
    linked = near.filter(((NUM + DEN) * col("apart")) <= (DEN - NUM) * (col("n") + col("nl")))
    clusters = components(linked.select(col("key").alias("a"), col("lead").alias("b")))
    found = _open(_roots(members, clusters, "key", "root")).join(near.select("lead", "key", "apart"), ["lead", "key"], "left")
    found = _within_reach(found.withColumn("apart", F.coalesce("apart", F.lit(0))))
    clusters = _merged(clusters, _above(_sure(found).unionByName(_left_over(sets, found)), clusters))

    named = _roots(rows.select("doc_id", "th", "key", "n"), clusters, "key", "top")
    first = named.filter("n > 0").groupBy("top").agg(F.min("doc_id").alias("component_id"))
    full = named.filter("n > 0").join(first, "top").select("doc_id", "th", "n", "top", "component_id")
    return full.unionByName(named.filter("n = 0").select("doc_id", "th", "n", "top", col("doc_id").alias("component_id")))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the component's.

    Rows that repeat both id and text stay once. Of several texts under that id the one with the least
    hash stays; where no row of a component has an id, so does the least text of all. Documents without words stay.
    """
    found = checkpoint(_grouped(docs).filter("n > 0").groupBy("doc_id", "th", "top").agg(F.count("*").alias("k")))
    own = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "th")
    stays = found.groupBy("top").agg(F.min(own).alias("stays"))
    marked = found.join(stays, "top").select("doc_id", "th", "k", own.eqNullSafe(F.col("stays")).alias("keep"))
    touched = checkpoint(marked.filter("NOT keep OR k > 1"))
    i, t, h = (free_name(docs, x) for x in ("id", "text", "hash"))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64("text"), h: F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))})
    need = touched.select(F.xxhash64("doc_id", "th").alias("hash"))
    rest, clear = may_hold(rows, h, need, MOST_BITS)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    side = touched.select(F.col("doc_id").alias(f"{i}t"), F.col("th").alias(f"{t}t"), F.col("keep").alias(f"{h}t"))
    joined = rest.join(side, F.col(i).eqNullSafe(F.col(f"{i}t")) & F.col(t).eqNullSafe(F.col(f"{t}t")), "left")
    plain = joined.filter(F.col(f"{h}t").isNull())
    once = joined.filter(F.col(f"{h}t")).dropDuplicates([i, t])
    return clear.select(*columns).unionByName(plain.select(*columns)).unionByName(once.select(*columns))


by_value(__name__)
