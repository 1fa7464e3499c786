"""Disclosure control: cells, primary and complementary suppression, membership atoms.

Spark makes cells and atoms; the complementary step runs on the driver over atoms, exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Why a cell is hidden.
REASONS = {"primary": "ad_sparse_report_cell", "complementary": "ad_complementary_suppression"}


def cells(membership: DataFrame) -> DataFrame:
    """(table_id, cell_id, n) from rows (table_id, cell_id, entity_id)."""
    return membership.groupBy("table_id", "cell_id").agg(F.countDistinct("entity_id").alias("n"))


def primary(cell_counts: DataFrame, minimum: int) -> DataFrame:
    hidden = F.col("n") < minimum
    return cell_counts.select("table_id", "cell_id", F.when(~hidden, F.col("n")).alias("n"), hidden.alias("suppressed"), F.when(hidden, F.lit(f"0..{minimum - 1}")).alias("bucket"))


def atoms(membership: DataFrame) -> DataFrame:
    """(signature, n): entities that lie in the same cells."""
    cell = F.concat_ws(":", "table_id", "cell_id")
    per = membership.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(cell)), "|").alias("signature"))
    return per.groupBy("signature").agg(F.count("*").alias("n"))


Row = list[int]


def _without_divisor(row: Row) -> Row:
    d = gcd(*row)
    return [v // d for v in row] if d > 1 else row


def _reduced(rows: list[tuple[int, Row]], new: Sequence[int]) -> list[tuple[int, Row]]:
    """Reduced rows (pivot, whole numbers) and one more: the same rows whatever the order in which they come, without fractions."""
    row = list(new)
    for pivot, old in rows:
        if row[pivot]:
            k, m = row[pivot], old[pivot]
            row = [m * v - k * w for v, w in zip(row, old, strict=True)]
    row = _without_divisor(row)
    at = next((i for i, v in enumerate(row) if v), None)
    if at is None:
        return rows  # a sum of others
    if row[at] < 0:
        row = [-v for v in row]
    out = [(p, _without_divisor([row[at] * v - old[at] * w for v, w in zip(old, row, strict=True)]) if old[at] else old) for p, old in rows]
    return sorted([*out, (at, row)])


def _basis(rows: list[tuple[int, Row]], width: int) -> list[Row]:
    """A whole basis of {x: rows . x = 0}, one direction for each free column."""
    pivots = {p for p, _ in rows}
    out = []
    for free in (c for c in range(width) if c not in pivots):
        scale = lcm(*(r[p] // gcd(r[p], r[free]) for p, r in rows if r[free])) if rows else 1
        x = [0] * width
        x[free] = scale
        for p, r in rows:
            x[p] = -r[free] * scale // r[p]
        out.append(_without_divisor(x))
    return out


def _leave_one_out(cells: list[str], vectors: dict[str, Row], held: list[tuple[int, Row]]) -> Iterator[tuple[str, list[tuple[int, Row]]]]:
    """The reduced rows without each cell: halves are added in turn, so a cell costs log(cells) additions and not all of them."""
    if len(cells) == 1:
        yield cells[0], held
        return
    half = len(cells) // 2
    for mine, others in ((cells[:half], cells[half:]), (cells[half:], cells[:half])):
        rows = held
        for c in others:
            rows = _reduced(rows, vectors[c])
        yield from _leave_one_out(mine, vectors, rows)


def complementary(
    atom_counts: dict[tuple[str, ...], int], counts: dict[str, int], minimum: int, locked: frozenset[str] = frozenset(), totals: frozenset[str] = frozenset()
) -> dict[str, str]:
    """Cells to hide, with the reason: hide released cells until no hidden one is determined.

    A hidden cell is determined if no whole step along the released cells' nullspace changes it while
    atoms stay non-negative. For the first such cell the smallest released cell goes that alone frees
    it; if none does, the smallest released cell; ``totals`` only where nothing else is left and one
    frees it. Raises if a determined cell cannot be freed.
    """
    signatures = sorted(atom_counts)
    hidden = {c: "primary" for c in sorted(counts) if counts[c] < minimum}
    if locked & hidden.keys():
        raise ValueError("a released cell would have to be hidden")

    vectors = {c: [int(c in x) for x in signatures] for c in counts}

    def steps(rows: list[tuple[int, Row]]) -> list[Row]:
        whole = _basis(rows, len(signatures))
        return [x for x in whole if any(all(atom_counts[s] + sign * w >= 0 for s, w in zip(signatures, x, strict=True)) for sign in (1, -1))]

    def is_open(cell: str, ways: list[Row]) -> bool:
        return any(sum(a * b for a, b in zip(vectors[cell], s, strict=True)) for s in ways)

    while True:
        shown = [c for c in sorted(counts) if c not in hidden]
        rows: list[tuple[int, Row]] = []
        for c in shown:
            rows = _reduced(rows, vectors[c])
        ways = steps(rows)
        unsafe = next((c for c in sorted(hidden) if shown and not is_open(c, ways)), None)
        if unsafe is None:
            return hidden
        frees = {c: is_open(unsafe, steps(rest)) if len(shown) > 1 else True for c, rest in _leave_one_out(shown, vectors, []) if c not in locked}
        left = sorted(frees, key=lambda c: (counts[c], c))
        parts = [c for c in left if c not in totals]
        chosen = next((c for c in parts if frees[c]), None) or next(iter(parts), None) or next((c for c in left if c in totals and frees[c]), None)
        if chosen is None:
            raise ValueError("no cell is left to hide")
        hidden[chosen] = "complementary"


def release(membership: DataFrame, minimum: int, declared: DataFrame | None = None, totals: frozenset[str] = frozenset(), earlier: DataFrame | None = None) -> DataFrame:
    """(table_id, cell_id, state, n, bucket, reason): what may be published of all tables together.

    ``declared`` (table_id, cell_id) adds cells without members, which are hidden and hide nothing else. What an ``earlier`` release published
    stays so and must not have changed. No count of a hidden cell is in the result. Cells and atoms, which are
    aggregates, are decided on the driver.
    """
    spark = membership.sparkSession
    found = cells(membership)
    if declared is not None:
        found = declared.select("table_id", "cell_id").distinct().join(found, ["table_id", "cell_id"], "full").select("table_id", "cell_id", F.coalesce("n", F.lit(0)).alias("n"))
    names = {(r.table_id, r.cell_id): r.n for r in found.collect()}
    counts = {f"{t}:{c}": n for (t, c), n in names.items()}
    locked = set()
    if earlier is not None:
        before = earlier.filter("state = 'published'").select("table_id", "cell_id", F.col("n").alias("was")).join(found, ["table_id", "cell_id"])
        for r in before.collect():
            if r.was != r.n:
                raise ValueError(f"{r.table_id}:{r.cell_id} was published with another count")
            locked.add(f"{r.table_id}:{r.cell_id}")
    groups = {tuple(r.signature.split("|")): r.n for r in atoms(membership).collect()}
    empty = {c for c, n in counts.items() if not n}
    if locked & empty:
        raise ValueError("a released cell would have to be hidden")
    hidden = complementary(groups, {c: n for c, n in counts.items() if n}, minimum, frozenset(locked), totals) | dict.fromkeys(empty, "primary")
    bucket = {"primary": f"0..{minimum - 1}", "complementary": "hidden"}
    out = []
    for (t, c), n in sorted(names.items()):
        why = hidden.get(f"{t}:{c}")
        out.append((t, c, "suppressed" if why else "published", None if why else n, bucket.get(why), REASONS.get(why)))
    return spark.createDataFrame(out, "table_id string, cell_id string, state string, n long, bucket string, reason string")
