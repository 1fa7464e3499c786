"""Conversation structure repair: the cheapest edits that give alternating turns, by a retained-subsequence program.

A conversation's turns are kept, reroled or deleted and empty turns are inserted, until the roles' initials
read ``(s?(ua)+)?``. The program runs over the retained turns only. A state is the role of the last retained
turn (or none yet); a gap of deleted turns costs their sum, the two roles beside a gap say how many turns must
be inserted, and each state keeps the running minimum over all places of its last turn. Equal costs go to the
ASCII-least audit. All audits of one prefix of turns have as many letters besides I, and none ends in I (turns
are inserted just before a retained one, or at the end), so none begins another one: a rank among the states
decides, and no audit is compared letter by letter.

Ranks and costs compose: a segment of a conversation is a table from the state before it to the state after
it. So rows are dealt out by ranges of (conversation, turn), a conversation of any length lies in many
segments, each of them is solved in its own task, and only its table (and the audits of its entries) go on.
The digest of a repaired conversation needs its texts one after another; a last pass streams them, sorted,
through the digest and holds no more than the conversation's audit.

Defined cases: null roles and texts are one space (blank; initial a space), and null ids and turns are one
space in the damage's key; a null conv_id is one conversation. Turns are ordered nulls first; ties by role,
then by the text's first 64 characters and its MD5. Equal rows of a conversation are one row with a count
until they are edited, so a row that repeats without bound is no burden. Empty and very long texts are
texts like others. An empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, written

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States, and roles that are inserted or given.
NONE, S, U, A = range(4)
INITIALS = {S: "s", U: "u", A: "a"}
ROLES = {U: "user", A: "assistant"}
LEGAL = ("su", "ua", "au")
#: Turns to be inserted between a state's role and the next retained one; pairs that are not there can't be mended.
BETWEEN = {(NONE, S): (), (NONE, U): (), (NONE, A): (U,), (S, U): (), (S, A): (U,), (U, A): (), (U, U): (A,), (A, U): (), (A, A): (U,)}
AT_END = {NONE: (), S: (U, A), U: (A,), A: ()}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, __c): rows after damage, ``__c`` times each."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    df = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("__k"))
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    return df.filter("__k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("__k") == 3, 2).otherwise(1).alias("__c"))


# ---- one segment of a conversation ----


class Segment:
    """Costs, ranks and audits from each state before a segment's turns to each state after them."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.starts = starts
        self.cost = {p: {p: 0} for p in starts}
        self.rank = {p: {p: 0} for p in starts}
        self.back: list[dict] = []  # by turn: {start: {state: (state before, letters)}}

    def add(self, initial: str, fault: str, copies: int) -> None:
        """A turn, with further copies of it: the first one may stay unless it is blank or a duplicate."""
        after = "D" * (copies - 1)
        retained = []
        if fault not in ("blank", "duplicate"):
            for q, name in INITIALS.items():
                if initial == name or q != S:
                    retained.append((q, "K" if initial == name else "R", (initial != name) * REROLE + (fault == "truncated") * TRUNCATED))
        step = {}
        for p in self.starts:
            found: dict[int, tuple] = {}
            for m, cost in self.cost[p].items():
                options = [(m, "D" + after, cost + DELETE * copies)]
                for q, letter, price in retained:
                    if (m, q) in BETWEEN:
                        new = BETWEEN[m, q]
                        options.append((q, "I" * len(new) + letter + after, cost + price + INSERT * len(new) + DELETE * (copies - 1)))
                for q, letters, price in options:
                    entry = (price, self.rank[p][m], letters, m)
                    if q not in found or entry < found[q]:
                        found[q] = entry
            order = {q: k for k, q in enumerate(sorted(found, key=lambda q: found[q][1:3]))}
            self.cost[p], self.rank[p] = {q: found[q][0] for q in found}, order
            step[p] = {q: (found[q][3], found[q][2]) for q in found}
        self.back.append(step)

    def audit(self, p: int, q: int) -> str:
        out = []
        for step in reversed(self.back):
            q, letters = step[p][q]
            out.append(letters)
        return "".join(reversed(out))


def compose(tables: list[tuple[dict, dict]]) -> tuple[int, list[int], str]:
    """Least cost of segments in order, the state after each of them (the first is the start), and the inserts at the end."""
    cost, rank, back = {NONE: 0}, {NONE: 0}, []
    for costs, ranks in tables:
        found: dict[int, tuple] = {}
        for m in cost:
            for q, c in costs[m].items():
                entry = (cost[m] + c, rank[m], ranks[m][q], m)
                if q not in found or entry < found[q]:
                    found[q] = entry
        cost = {q: e[0] for q, e in found.items()}
        rank = {q: k for k, q in enumerate(sorted(found, key=lambda q: found[q][1:3]))}
        back.append({q: e[3] for q, e in found.items()})
    last = min(cost, key=lambda q: (cost[q] + INSERT * len(AT_END[q]), rank[q]))
    states = [last]
    for step in reversed(back):
        states.append(step[states[-1]])
    return cost[last] + INSERT * len(AT_END[last]), states[::-1], "I" * len(AT_END[last])


def _runs(batches, key: str):
    """Rows of sorted Arrow batches, by their key: (key, rows) with rows to be used up before the next key."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: r[key])


def _arrow(ddl: str):
    import pyarrow as pa

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(x.split(" ")[0], types[x.split(" ")[1]]) for x in ddl.split(", ")])


def _batches(rows, ddl: str):
    """Dictionaries -> Arrow batches of some hundred rows."""
    from itertools import islice

    import pyarrow as pa

    rows, schema = iter(rows), _arrow(ddl)
    while held := list(islice(rows, 512)):
        yield pa.RecordBatch.from_pylist(held, schema)


SEGMENTS = "conv_id {kind}, part int, place long, blank long, duplicate long, truncated long, pairs long, first string, last string, low long, high long, turns long, costs string, audits string"


def _solve(kind: str):
    """Sorted rows of one partition -> a row for each conversation in it."""

    def solved(part: int, place: int, conv, rows) -> dict:
        import json

        # only a partition's first conversation can have begun in another one
        segment = Segment((NONE, S, U, A) if place == 0 else (NONE,))
        out = {"conv_id": conv, "part": part, "place": place, "blank": 0, "duplicate": 0, "truncated": 0, "pairs": 0, "turns": 0, "first": None, "last": None, "low": None, "high": None}
        for r in rows:
            initial, copies, fault = r["initial"], r["c"], r["fault"]
            segment.add(initial, fault, copies)
            if fault:
                out[fault] += 1
            out["blank" if fault == "blank" else "duplicate"] += copies - 1
            out["pairs"] += copies - 1 + (out["last"] is not None and out["last"] + initial not in LEGAL)
            out["first"] = initial if out["first"] is None else out["first"]
            out["last"] = initial
            if (turn := r["turn"]) is not None:
                out["turns"] += turn != out["high"]
                out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
        audits = {p: {q: segment.audit(p, q) for q in segment.cost[p]} for p in segment.starts}
        return out | {"costs": json.dumps({p: [segment.cost[p], segment.rank[p]] for p in segment.starts}), "audits": json.dumps(audits)}

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _batches((solved(part, k, conv, rows) for k, (conv, rows) in enumerate(_runs(batches, "conv_id"))), SEGMENTS.format(kind=kind))

    return run


FOUND = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _found(conv, rows) -> dict:
    """A conversation's segments, in order (and a row without one for each original conversation) -> its findings."""
    import json

    out = {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    tables, audits, before, low, high, turns = [], [], None, None, None, 0
    for r in rows:
        if r["part"] < 0:
            continue
        for k in ("blank", "duplicate", "truncated"):
            out[k] += r[k]
        out["illegal"] += r["pairs"] + (before is not None and before + r["first"] not in LEGAL)
        before = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
        both = json.loads(r["costs"])
        tables.append(tuple({int(p): {int(q): v for q, v in x[k].items()} for p, x in both.items()} for k in (0, 1)))
        audits.append(json.loads(r["audits"]))
    if low is not None:
        out["gaps"] = high - low + 1 - turns
    out["cost"], states, end = compose(tables)
    return out | {"audit": "".join(a[str(p)][str(q)] for a, p, q in zip(audits, states, states[1:])) + end}


def _join(kind: str):
    return lambda batches: _batches((_found(conv, rows) for conv, rows in _runs(batches, "conv_id")), FOUND.format(kind=kind))


def _edited(rows) -> dict:
    """A conversation's findings and then its rows, in order -> the findings with the digest of its repaired turns."""
    head = next(rows)
    audit, at, state, digest, begun = head["audit"], 0, NONE, hashlib.sha256(), False

    def line(role: str, text: str) -> None:
        nonlocal begun
        digest.update(("\n" * begun + f"{role}:{text}").encode())
        begun = True

    for r in rows:
        for _ in range(r["c"]):
            inserts = 0
            while audit[at] == "I":
                inserts, at = inserts + 1, at + 1
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            # the state, the inserts and the letter say which role the turn has
            q = next(q for (m, q), new in BETWEEN.items() if m == state and len(new) == inserts and (q != S if letter == "R" else INITIALS[q] == r["initial"]))
            for x in BETWEEN[state, q]:
                line(ROLES[x], "")
            line(r["role"] if letter == "K" else ROLES[q], r["text"])
            state = q
    for x in AT_END[state]:
        line(ROLES[x], "")
    return {k: head[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} | {"repaired_sha256": digest.hexdigest()}


def _digests(kind: str):
    return lambda batches: _batches((_edited(rows) for _, rows in _runs(batches, "conv_id")), FOUND.format(kind=kind) + ", repaired_sha256 string")


def repair(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Findings and the repaired form's digest of every conversation of ``originals`` (conv_id), from ``rows`` (with counts ``__c``)."""
    spark = rows.sparkSession
    kind = "string" if dict(rows.dtypes)["conv_id"] == "string" else "long"
    rows = rows.select(F.col("conv_id").cast(kind), F.col("turn").cast("long"), "role", "text", "__c")
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("__c").alias("c"))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    one = one.select(
        "conv_id", "turn", "role", "text", "c", F.substring("role", 1, 1).alias("initial"), F.substring("text", 1, 64).alias("pre"), F.md5("text").alias("key"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("").alias("own"),
    )
    one = written(one, "turns")
    order = ["conv_id", "turn", "role", "pre", "key"]
    slim = one.select(*order, "c", "initial", "own")
    # the first place of a role and text; equal places are one row already, so the join's key is unique
    firsts = slim.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at")).select("conv_id", "role", "key", F.col("at.turn").alias("turn"), F.lit(True).alias("first"))
    a, b = slim.alias("a"), firsts.alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key"))
    for c in ("conv_id", "turn", "role"):
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    marked = a.join(b, same, "left").select("a.*", F.when(F.col("own") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("own")).alias("fault"))
    marked = written(marked.select(*order, "c", "initial", "fault"), "faults")
    # the shuffle's own number of partitions: one range each
    dealt = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    solved = dealt.select("conv_id", "turn", "c", "initial", "fault").mapInArrow(_solve(kind), SEGMENTS.format(kind=kind))
    solved = written(solved, "segments")
    all_ids = originals.select(F.col("conv_id").cast(kind)).distinct().withColumn("part", F.lit(-1))
    segments = solved.unionByName(all_ids, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    found = segments.mapInArrow(_join(kind), FOUND.format(kind=kind))
    # findings stand before their rows, which come in the order of the segments
    both = found.withColumn("row", F.lit(0)).unionByName(one.select(*order, "text", "c", "initial").withColumn("row", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "row", *order[1:])
    return both.mapInArrow(_digests(kind), FOUND.format(kind=kind) + ", repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The findings of every conversation after the fixed damage."""
    return repair(damaged(conversations), conversations)


def _oracle() -> str:
    """The same rows as DuckDB SQL: a recursion over each conversation's turns with its four states, their audits and lines."""
    far = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    names = {NONE: "n", S: "s", U: "u", A: "a"}

    def least(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    new = {}
    for q, name in names.items():
        options = [f"{{'c': r.{name}.c + 2, 'a': r.{name}.a || 'D', 't': r.{name}.t}}"]
        for (m, to), inserts in BETWEEN.items():
            if to != q:
                continue
            x = names[m]
            lines = "".join(f"'{ROLES[i]}:', " for i in inserts)
            letters = "I" * len(inserts)
            price = f"r.{x}.c + {INSERT * len(inserts)} + CASE WHEN d.fault = 'truncated' THEN 5 ELSE 0 END"
            options.append(f"CASE WHEN d.may AND d.initial = '{INITIALS[q]}' THEN {{'c': {price}, 'a': r.{x}.a || '{letters}K', 't': list_concat(r.{x}.t, [{lines}d.role || ':' || d.text])}} ELSE {far} END")
            if q != S:
                options.append(f"CASE WHEN d.may THEN {{'c': {price} + 1, 'a': r.{x}.a || '{letters}R', 't': list_concat(r.{x}.t, [{lines}'{ROLES[q]}:' || d.text])}} ELSE {far} END")
        new[name] = least(options)
    ends = []
    for q, inserts in AT_END.items():
        x = names[q]
        lines = ", ".join(f"'{ROLES[i]}:'" for i in inserts)
        ends.append(f"{{'c': r.{x}.c + {INSERT * len(inserts)}, 'a': r.{x}.a || '{'I' * len(inserts)}', 't': {f'list_concat(r.{x}.t, [{lines}])' if inserts else f'r.{x}.t'}}}")
    # CRC-32 of a short ASCII key, four bits at a time
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)

    def four(c: str, v: str) -> str:
        return f"xor({c} >> 4, {table}[(xor({c}, {v}) & 15) + 1])"

    codes = "list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda c, b: {four(four('c', '(b & 15)'), '(b >> 4)')}), 4294967295::BIGINT)"
    return f"""WITH RECURSIVE o AS (SELECT conv_id, turn, role, text, {crc} % 20 AS k FROM
  (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE k <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM dam),
flt AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd FROM num),
d AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS may FROM flt),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS n, {far} AS s, {far} AS u, {far} AS a FROM conversations
  UNION ALL SELECT r.conv_id, d.i, {new["n"]}, {new["s"]}, {new["u"]}, {new["a"]} FROM r JOIN d ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = r.i + 1),
top AS (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id),
best AS (SELECT r.conv_id, {least(ends)} AS b FROM r JOIN top ON r.conv_id IS NOT DISTINCT FROM top.conv_id AND r.i = top.i),
agg AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM d GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM best LEFT JOIN agg ON best.conv_id IS NOT DISTINCT FROM agg.conv_id"""


ORACLE = _oracle()

by_value(__name__)
