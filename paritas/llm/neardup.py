"""Embedding near-dedup: cover trees, traversed two at a time, find all pairs above a cosine threshold.

On unit vectors cosine >= c is distance <= eps = sqrt(2 - 2c). Vectors of a label form a tree of nodes.
Upper levels: a node with more than ``BLOCK`` vectors is split by centres, a greedy net with halving
radii over a bounded hashed sample of its vectors; every vector goes to its nearest centre, again until
nodes are small (a node of vectors that centres cannot part is dealt by hash). Every vector is indexed;
only the choice of centres looks at a sample. The upper
tree is traversed against itself from the labels' roots: a pair of nodes is pruned if their centres are
further apart than both covering radii and eps, else all pairs of their children are looked at. Lower
levels: each leaf of it carries nested nets with halving radii, made once, and two leaves are traversed
against each other with the same bound at every level, all pairs of a level in one matrix product; the
surviving pairs are decided by exact cosines in double precision. So the pairs are exact. A task takes the
pairs of leaves between two groups of at most ``GROUP`` leaves of a label.

Equal vectors of a label are one vector with a number of copies before anything else is shuffled. A pair
of leaves returns link counts per vector and a spanning forest of its links, never the pairs themselves,
so a large group costs rows in proportion to its size. In many dimensions unrelated vectors are nearly
orthogonal, and the bounds prune little: the exact work within a label is then quadratic in its distinct
vectors, though in blocks of matrix products.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows whose
label is null, link with nothing; vectors of other lengths than their partner's never link; repeated
rows are vectors of their own and link; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.components import components
from paritas.llm.shared import by_value, checkpoint, written

COSINE, BLOCK, SAMPLE, MOST_CENTRES = 0.98, 1024, 512, 32
GROUP = 32  # leaves that a task holds on each side


def unit(embeddings: list) -> list[np.ndarray | None]:
    """Vectors of length 1, or None for those that link with nothing."""
    out = []
    for e in embeddings:
        v = None if e is None else np.array(e, dtype=np.float64)
        n = np.sqrt((v * v).sum()) if v is not None and v.size and np.isfinite(v).all() else 0.0
        if n and not np.isfinite(n):  # squares overflow
            v = v / np.abs(v).max()
            n = np.sqrt((v * v).sum())
        elif v is not None and v.size and np.isfinite(v).all() and not n and v.any():  # squares underflow
            v = v / np.abs(v).max()
            n = np.sqrt((v * v).sum())
        out.append(v / n if n else None)
    return out


def nets(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x: nested greedy nets with radii 1, 1/2, ... until there are ``most`` centres or no two rows are apart."""
    centres, far, radius = [], np.full(len(x), np.inf), 1.0
    while len(centres) < most and radius > 1e-6:
        for i in range(len(x)):
            if far[i] > radius:
                centres.append(i)
                if len(centres) >= most:
                    break
                far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[i]))))
        radius /= 2
    return np.array(centres)


class Tree:
    """Nested nets over one block: levels of (centre, covering radius, members by children)."""

    def __init__(self, x: np.ndarray, eps: float) -> None:
        self.x, self.levels = x, []
        centres, radius = np.array([0]), 2.0
        while True:
            # every vector belongs to its nearest centre of this level
            near = np.empty(len(x), np.int64)
            dist = np.empty(len(x))
            for at in range(0, len(x), 2048):
                s = x[at : at + 2048] @ x[centres].T
                near[at : at + 2048] = s.argmax(1)
                dist[at : at + 2048] = np.sqrt(np.maximum(0, 2 - 2 * s.max(1)))
            cover = np.zeros(len(centres))
            np.maximum.at(cover, near, dist)
            self.levels.append((centres, cover + 1e-7, near))
            if radius <= eps or len(centres) == len(x):
                break
            radius /= 2
            more, far = [], dist.copy()
            for i in np.flatnonzero(dist > radius):
                if far[i] > radius:
                    more.append(i)
                    far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[i]))))
            centres = np.concatenate([centres, np.array(more, np.int64)])  # nested: old centres stay

    @classmethod
    def of(cls, x: np.ndarray, levels: list) -> Tree:
        tree = cls.__new__(cls)
        tree.x, tree.levels = x, levels
        return tree

    def below(self, alive: np.ndarray, level: int) -> np.ndarray:
        """Rows for the nodes of ``level``, alive where a node above that holds one of their vectors is."""
        a, b = self.levels[level - 1][2], self.levels[level][2]
        out = np.zeros((len(self.levels[level][0]), alive.shape[1]), bool)
        both = np.unique(np.stack([b, a], 1), axis=0)
        start = np.flatnonzero(np.r_[True, both[1:, 0] != both[:-1, 0]])
        out[both[start, 0]] = np.logical_or.reduceat(alive[both[:, 1]], start, axis=0)
        return out


def descend(s: Tree, t: Tree, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf nodes of both trees that some surviving pair holds, and whether each pair of these survives.

    All pairs of nodes of a level are bounded by one matrix product of their centres.
    """
    alive = np.ones((1, 1), bool)
    for level in range(max(len(s.levels), len(t.levels))):
        for side, tree in enumerate((s, t)):
            if 0 < level < len(tree.levels):
                alive = tree.below(alive if side == 0 else alive.T, level)
                alive = alive if side == 0 else alive.T
        (ca, ra, _), (cb, rb, _) = s.levels[min(level, len(s.levels) - 1)], t.levels[min(level, len(t.levels) - 1)]
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(i):
            return i, j, alive[:0, :0]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (s.x[ca[i]] @ t.x[cb[j]].T)))
        near = apart <= ra[i][:, None] + rb[j][None, :] + eps
        alive[np.ix_(i, j)] &= near
    i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    return i, j, alive[np.ix_(i, j)]


def join_blocks(s: Tree, t: Tree | None, cosine: float, ws: np.ndarray | None = None, wt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the vectors of s and of t (None: s against itself), and a spanning forest with t after s.

    ``ws`` and ``wt`` count the copies of each vector: a link to a vector is one to all its copies.
    """
    own = t is None
    t = s if own else t
    ws, wt = (np.ones(len(x.x), np.int64) if w is None else w for x, w in ((s, ws), (t, ws if own else wt)))
    cx, cy = np.zeros(len(s.x), np.int64), np.zeros(0 if own else len(t.x), np.int64)
    none = np.zeros((0, 2), np.int64)
    if s.x.shape[1] != t.x.shape[1]:
        return cx, cy, none
    i, j, alive = descend(s, t, float(np.sqrt(2 - 2 * cosine)) + 1e-7)
    if not len(i):
        return cx, cy, none
    near_s, near_t = s.levels[-1][2], t.levels[-1][2]
    a, b = np.flatnonzero(np.isin(near_s, i)), np.flatnonzero(np.isin(near_t, j))
    hit = (s.x[a] @ t.x[b].T >= cosine) & alive[np.searchsorted(i, near_s[a])][:, np.searchsorted(j, near_t[b])]
    if own:  # a and b are the same vectors, since survival is symmetric
        np.fill_diagonal(hit, False)
        hit |= hit.T
    cx[a] = hit @ wt[b]
    if not own:
        cy[b] = hit.T @ ws[a]
    shift = 0 if own else len(s.x)
    label = np.arange(len(cx) + len(cy))
    forest = [none]
    for r in np.flatnonzero(hit.any(1)):
        cells = b[hit[r]] + shift
        groups, first = np.unique(label[cells], return_index=True)
        mine = label[a[r]]
        fresh = groups != mine
        if fresh.any():
            far = cells[first[fresh]]
            forest.append(np.stack([np.full(len(far), a[r]), far], 1))
            label[np.isin(label, groups)] = mine
    return cx, cy, np.concatenate(forest)


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            v = [None if u is None or label is None else _pack(u) for u, label in zip(unit(batch.column("embedding").to_pylist()), labels, strict=True)]
            keys = [None if u is None else hashlib.sha256(b"%d/" % label + u).digest() for u, label in zip(v, labels, strict=True)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(v, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "key"])

    rows = vectors.select(*[F.col(c).cast("long").alias(c) for c in ("vec_id", "label")], F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(units, "vec_id long, label long, v binary, key binary"), "vectors")
    # equal vectors of a label are one vector with a number of copies, before anything else is shuffled
    alike = rows.filter("v IS NOT NULL").groupBy("key", "label", "v").agg(F.count("*").alias("copies"))
    alike = checkpoint(alike.withColumn("id", F.monotonically_increasing_id()))
    top = F.concat_ws("/", "label", F.length("v"))
    blocks = _blocks(_split(alike.select("id", top.alias("node"), "v", "copies"), block), cosine)
    ends = _meeting(blocks, float(np.sqrt(2 - 2 * cosine)) + 1e-6)
    # a task takes the pairs between two groups of leaves, so that a leaf is shipped once for each group it meets
    label = F.substring_index("node", ".", 1)
    order = Window.partitionBy("top").orderBy("node")
    leaves = blocks.select("node", label.alias("top")).withColumns({"at": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("top"))})
    group = F.floor(F.col("at") / F.least(F.lit(GROUP), F.greatest(F.lit(4), F.ceil(F.col("n") / 4))))
    leaves = written(leaves.select("node", "top", group.alias("group")), "leaves")
    ga, gb = leaves.toDF("nodea", "top", "ga"), leaves.select("node", "group").toDF("nodeb", "gb")
    pairs = checkpoint(ends.join(ga, "nodea").join(gb, "nodeb"))
    cell = ["top", "ga", "gb"]
    need = pairs.select(*[F.col(c).alias(f"{c}s") for c in cell], F.explode(F.array("nodea", "nodeb")).alias("node")).distinct()
    shipped = need.join(blocks.select("node", "ids", "copies", "x", "tree"), "node")

    def link(met: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        held = {r.node: (_tree(r.x, r.tree), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.copies, "<i8")) for r in given.itertuples()}
        total = {node: np.zeros(len(ids), np.int64) for node, (_, ids, _) in held.items()}
        forest = [np.zeros((0, 2), np.int64)]
        for m, n in zip(met["nodea"], met["nodeb"], strict=True):
            (s, ids, ws), (t, others, wt) = held[m], (None, np.zeros(0, np.int64), None) if m == n else held[n]
            cx, cy, f = join_blocks(s, t, cosine, ws, wt)
            total[m] += cx
            if m != n:
                total[n] += cy
            forest.append(np.concatenate([ids, others])[f])
        f = np.concatenate(forest)
        every, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([held[n][1] for n in total], total.values()))
        has = count > 0
        return pd.DataFrame({"a": np.concatenate([every[has], f[:, 0]]), "b": np.concatenate([np.full(has.sum(), -1), f[:, 1]]), "n": np.concatenate([count[has], np.zeros(len(f), np.int64)])})

    found = checkpoint(pairs.groupBy(*cell).cogroup(shipped.groupBy(*[f"{c}s" for c in cell])).applyInPandas(link, "a long, b long, n long"))
    counts = found.filter("b < 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("b >= 0"))
    named = alike.select("key", "id", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    named = named.select("key", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    named = checkpoint(rows.select("vec_id", "key").join(named, "key", "left").drop("key"))
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "root", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tree(x: bytes, levels: bytes) -> Tree:
    found = pickle.loads(levels)
    return Tree.of(np.frombuffer(x).reshape(len(found[0][2]), -1), found)


def _blocks(nodes: DataFrame, cosine: float) -> DataFrame:
    """One row for each leaf of the upper tree: its vectors, its own tree (made once), a centre and a radius."""
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-7

    def gather(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v) for v in p["v"]])
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        one = [p["node"].iloc[0], p["id"].to_numpy("<i8").tobytes(), p["copies"].to_numpy("<i8").tobytes(), _pack(x), pickle.dumps(Tree(x, eps).levels), centre, radius]
        return pd.DataFrame([one], columns=["node", "ids", "copies", "x", "tree", "centre", "radius"])

    return checkpoint(nodes.groupBy("node").applyInPandas(gather, "node string, ids binary, copies binary, x binary, tree binary, centre array<double>, radius double"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def _meeting(blocks: DataFrame, eps: float) -> DataFrame:
    """(nodea, nodeb) of the leaf pairs that centres and covering radii do not rule out, a <= b.

    The upper tree is traversed against itself from the labels' roots down. A pair of nodes has a few
    children only, so neither a label nor a node is one task's work. A node's centre is one of its
    blocks' centres, its covering radius reaches the far side of every block.
    """
    parts = F.split("node", r"\.")
    balls = blocks.select("node", "centre", "radius", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), F.size(parts).alias("deepest"))
    balls = balls.withColumn("inner", F.expr("substring_index(node, '.', depth)"))
    middle = balls.groupBy("inner", "depth", "deepest").agg(F.min("node").alias("node")).groupBy("inner", "depth").agg(F.min("node").alias("node"))
    middle = middle.join(blocks.select("node", F.col("centre").alias("middle")), "node").select("inner", "middle")
    upper = balls.join(middle, "inner").groupBy("inner", "depth", "middle").agg(F.max(_distance("centre", "middle") + F.col("radius")).alias("reach"), F.max(F.col("depth") == F.col("deepest")).alias("leaf"))
    upper = written(upper.withColumn("parent", F.when(F.col("depth") > 1, F.expr("substring_index(inner, '.', depth - 1)"))), "upper")
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    pairs = upper.filter("depth = 1").select(F.col("inner").alias("nodea"), F.col("inner").alias("nodeb"))
    for depth in range(2, deepest + 1):
        # a leaf stays what it is while others descend
        down = upper.filter(F.col("depth") == depth).select("parent", "inner", "middle", "reach").union(
            upper.filter(F.col("leaf") & (F.col("depth") < depth)).select(F.col("inner").alias("parent"), "inner", "middle", "reach")
        )
        a, b = (down.toDF(f"node{s}", f"child{s}", f"middle{s}", f"reach{s}") for s in "ab")
        both = pairs.join(a, "nodea").join(b, "nodeb").filter("childa <= childb OR nodea <> nodeb")
        both = both.filter(_distance("middlea", "middleb") <= F.col("reacha") + F.col("reachb") + F.lit(eps))
        pairs = checkpoint(both.select(F.col("childa").alias("nodea"), F.col("childb").alias("nodeb")))
    return pairs


def _split(nodes: DataFrame, block: int) -> DataFrame:
    """Split large nodes by centres until all are small."""
    done = []
    nodes = checkpoint(nodes)
    while True:
        # small tables of a round are files: a checkpoint keeps the estimate of its plan, in which joins multiply, so that
        # what joins itself round after round is planned with sizes whose digits grow as a power of the rounds
        sizes = written(nodes.groupBy("node").agg(F.count("*").alias("size")), "sizes")
        large = sizes.filter(F.col("size") > block)
        if large.isEmpty():
            return _union([*done, nodes])
        marked = nodes.join(large, "node", "left")
        done.append(marked.filter("size IS NULL").drop("size"))
        marked = marked.filter("size IS NOT NULL")
        # about SAMPLE vectors of each node, by a hash
        lucky = F.pmod(F.xxhash64("id", "node"), F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) / F.col("size")

        def centres(p: pd.DataFrame) -> pd.DataFrame:
            x = np.stack([np.frombuffer(v) for v in p.sort_values("id")["v"]])
            want = int(min(MOST_CENTRES, max(2, -(-2 * p["size"].iloc[0] // block))))
            c = nets(x, want)
            return pd.DataFrame({"node": [p["node"].iloc[0]], "c": [_pack(x[c])], "k": [len(c)]})

        chosen = written(marked.filter(lucky).groupBy("node").applyInPandas(centres, "node string, c binary, k int"), "centres")
        given = marked.join(chosen, "node", "left")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = []
                for _, q in p.groupby("node", sort=False):
                    x = np.stack([np.frombuffer(v) for v in q["v"]])
                    if q["k"].iloc[0] > 1:  # (also false without centres)
                        c = np.frombuffer(q["c"].iloc[0]).reshape(-1, x.shape[1])
                        to = (x @ c.T).argmax(1)
                        names = q["node"] + "." + pd.Series(to, index=q.index).astype(str)
                    else:  # vectors that no centres part
                        names = q["node"] + ".h" + (q["id"] % (q["size"] // block + 1)).astype(str)
                    out.append(q.assign(node=names)[["id", "node", "v", "copies"]])
                if out:
                    yield pd.concat(out)

        before = nodes
        nodes = checkpoint(given.mapInPandas(assign, before.schema))
        # a node whose vectors nearly all went to one centre again is dealt by hash in the end
        nodes = nodes.withColumn("node", F.when(F.length("node") > 200, F.concat(F.substring("node", 1, 180), F.lit("."), F.xxhash64("id"))).otherwise(F.col("node")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


by_value(__name__)
