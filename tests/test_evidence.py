"""Risk, alternative data, disclosure, proxy, bootstrap, research, streaming; every query against its SQL."""

import datetime
import hashlib
import math
import os
import random
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.functions import ranked
from paritas.operators import altdata, bootstrap, disclosure, proxy, research, risk, signals
from paritas.plans import catalogue
from paritas.streaming import gate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([("a", 0.9, True, 2.0), ("b", 0.8, False, 1.0), ("c", 0.8, True, 1.0), ("zero", 0.7, True, 0.0)], "entity_id string, s double, bad boolean, w double").filter("w > 0")


def test_risk_oracle(entities):
    k = ranked.ks(entities, "s", "bad", "w").first()
    assert k.ks == pytest.approx(2 / 3) and k.ks_score == 0.9
    a = risk.auc_gini(entities).first()
    assert a.auc == pytest.approx(5 / 6) and a.gini == pytest.approx(2 / 3)
    got = {r.fraction: (r.selected, r.lift) for r in ranked.lift(entities, "s", "bad", "w", [0.5, 0.75, 1.0]).collect()}
    assert got[0.5] == (1, pytest.approx(4 / 3)) and got[0.75] == (3, pytest.approx(1.0)) and got[1.0][0] == 3
    assert [(r.band, r.n) for r in risk.bands(entities, [0.25, 0.5, 0.75]).orderBy("band").collect()] == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_ks_ties_take_the_lowest_score(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.7, False)], "s double, bad boolean").withColumn("w", F.lit(1.0))
    assert ranked.ks(df, "s", "bad", "w").first().ks_score == 0.8


def test_auc_is_the_pairwise_share(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 6) / 6, rng.random() < 0.4, float(rng.randint(1, 4))) for _ in range(80)]
    pairs = [(wa * wb, 1 if a > b else 0.5 if a == b else 0) for a, ya, wa in rows if ya for b, yb, wb in rows if not yb]
    want = sum(w * x for w, x in pairs) / sum(w for w, _ in pairs)
    df = spark.createDataFrame(rows, "s double, y boolean, w double").withColumn("k", F.lit(1))
    assert ranked.auc(df, ["k"], "s", "y", "w").first().auc == pytest.approx(want)


def test_calibration_slope(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 0.7 * np.log(p / (1 - p)))))
    df = spark.createDataFrame([(float(a), bool(b), 1.0) for a, b in zip(p, y, strict=True)], "s double, bad boolean, w double")
    r = risk.calibration_slope(df)
    assert r["reason"] is None and abs(r["slope"] - 0.7) < 0.15
    assert risk.calibration_slope(df.withColumn("s", F.lit(0.5)))["reason"] == "constant_probability"
    assert risk.calibration_slope(df.withColumn("bad", F.lit(True)))["reason"] == "separation"


def test_stream_matches_plain_python(spark):
    def plain(n, length, seed, key, role, domain):
        out, c = [], 0
        limit = 2**64 - 2**64 % n
        while len(out) < length:
            h = hashlib.sha256(f"{domain}{seed}\0{key}\0{role}".encode() + c.to_bytes(8, "big")).digest()
            out += [v % n for v in (int.from_bytes(h[i : i + 8], "big") for i in range(0, 32, 8)) if v < limit]
            c += 1
        return out[:length]

    for n in (1, 4, 7, 3 * 2**61):  # the last one skips a quarter of the candidates
        got = bootstrap.index_stream(spark, n, 40, 7, "overall.selection_rate", "scope").orderBy("position").collect()
        assert [r["index"] for r in got] == plain(n, 40, 7, "overall.selection_rate", "scope", bootstrap.DOMAIN)
    d = bootstrap.draws(spark, 4, 3, 7, "k").orderBy("draw", "i").collect()
    assert [r["index"] for r in d] == plain(4, 12, 7, "k", "scope", bootstrap.DOMAIN)


def test_interval_is_type_seven(spark):
    v = spark.createDataFrame([("k", x) for x in [0.0, 1.0, 2.0, 10.0, None]], "key string, v double")
    r = bootstrap.interval(v, ["key"], 0.5, 4).first()
    assert (r.valid, r.lower, r.upper) == (4, 0.75, 4.0)
    assert bootstrap.interval(v, ["key"], 0.5, 5).first().lower is None


def test_multinomial_agrees_with_exact_draws(spark):
    m = bootstrap.multinomial(spark, [30, 20, 10, 40], 400, 1).select(((F.col("tp") + F.col("fp")) / 100).alias("v"))
    got = m.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(got[0] - 0.5) < 0.01 and abs(got[1] - math.sqrt(0.25 / 100)) < 0.01


def test_leakage_order(spark):
    t = "TIMESTAMP'2025-01-{}'"
    rows = {"future": (2, 30, "NULL", "posted"), "after": (12, 12, "NULL", "posted"), "revision": (2, 12, "'x'", "posted"), "late": (2, 12, "NULL", "pending"), "pending": (2, 3, "NULL", "pending"), "fine": (2, 3, "NULL", "posted")}
    sql = " UNION ALL ".join(f"SELECT '{k}' AS k, {t.format(f'{a:02}')} AS event_time, {t.format(f'{b:02}')} AS observed_at, CAST({r} AS STRING) AS revision_of, '{s}' AS status" for k, (a, b, r, s) in rows.items())
    got = {r.k: (r.disposition, r.code) for r in gate.gated(spark.sql(sql), "2025-01-10", "2025-01-20").collect()}
    assert got == {"future": ("error", "ad_future_timestamp"), "after": ("error", "ad_feature_after_decision"), "revision": ("exclude", "ad_revision_after_decision"), "late": ("exclude", "ad_observed_after_decision"), "pending": ("unavailable", "ad_pending_record"), "fine": ("eligible", None)}


def test_revisions(spark):
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "d", None), (2, "a", None)]
    df = spark.createDataFrame(rows, "source_id int, record_id string, revision_of string")
    assert {(r.source_id, r.record_id) for r in altdata.terminal_records(df).collect()} == {(1, "c"), (1, "d"), (2, "a")}
    rejected = altdata.terminal_records(df, F.col("record_id") != "c")  # a rejected revision replaces nothing
    assert {(r.source_id, r.record_id) for r in rejected.collect()} == {(1, "b"), (1, "d"), (2, "a")}


def test_outcome_order(spark):
    day = lambda x: F.to_timestamp(F.lit(f"2025-01-{x:02}"))
    rows = {"future": (5, 25, 8), "immature": (1, 2, 22), "early": (3, 4, 8), "before_window": (5, 6, 8), "after_window": (16, 17, 18), "fine": (8, 9, 10)}
    got = {}
    for k, (at, seen, mature) in rows.items():
        gate_ = altdata.outcome_gate(day(at), day(at), day(seen), day(mature), day(4), day(7), day(15), day(20))
        got[k] = tuple(spark.range(1).select(gate_.alias("g")).select("g.*").first())
    assert got == {
        "future": ("error", "ad_future_timestamp"),
        "immature": ("unavailable", "ad_label_immature"),
        "early": ("error", "ad_outcome_not_post_decision"),
        "before_window": ("exclude", "ad_outcome_outside_window"),
        "after_window": ("exclude", "ad_outcome_outside_window"),
        "fine": ("eligible", None),
    }


def ledger(spark, rows):
    """(record_id, event_type, status, day, amount, reversal_of, obligation_id, due) of one entity and source."""
    schema = "record_id long, event_type string, status string, event_time timestamp, amount decimal(18,2), reversal_of long, obligation_id string, due_date date"
    rows = [(r[0], r[1], r[2], datetime.datetime.fromisoformat(r[3]), None if r[4] is None else Decimal(r[4]), r[5], r[6], r[7] and datetime.date.fromisoformat(r[7])) for r in rows]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'s' AS source_id", "1 AS entity_id", "event_time AS observed_at", "'x' AS category_id", "'uncertain' AS transfer_scope", "'USD' AS currency")
    return df.selectExpr("*", "event_time AS period_start", "event_time AS period_end", "CAST(NULL AS STRING) AS provider_id", "'power' AS service_type")


def test_cash_flow_profile(spark):
    rows = [
        (1, "inflow", "posted", "2025-01-05", 100, None, None, None), (2, "inflow", "posted", "2025-02-05", 40, None, None, None), (3, "inflow", "posted", "2025-02-06", 60, None, None, None),
        (4, "reversal", "posted", "2025-02-07", 60, 3, None, None), (5, "outflow", "posted", "2025-03-02", 30, None, None, None), (6, "inflow", "pending", "2025-03-03", 999, None, None, None), (7, "transfer", "posted", "2025-03-04", None, None, None, None),
    ]
    r = signals.cash_flow_profile(ledger(spark, rows), "2025-01-01", "2025-04-30").first()
    assert (r.state, r.calendar_period_count, r.observed_period_count, r.missing_period_count) == ("available", 4, 3, 1)
    assert (r.inflow_total, r.net_cash_flow, r.reversed_amount, r.mean_monthly_inflow) == (140, 110, 60, 35.0)
    assert r.monthly_inflow_population_stddev == pytest.approx(np.std([100, 40, 0, 0]))
    assert r.reason_codes == ["ad_balance_history_unavailable", "ad_cashflow_reversal_observed", "ad_uncertain_transfer"]
    r = signals.cash_flow_profile(ledger(spark, [*rows, (8, "inflow", "unavailable", "2025-01-09", None, None, None, None)]), "2025-01-01", "2025-04-30").first()
    assert (r.state, r.observed_period_count, r.mean_monthly_inflow) == ("unavailable", 2, None) and "ad_provider_reporting_gap" in r.reason_codes


def test_rent_profile(spark):
    rows = [
        (1, "obligation", "posted", "2025-01-01", 100, None, "a", "2025-01-10"), (2, "payment", "posted", "2025-01-08", 60, None, "a", None), (3, "partial_payment", "posted", "2025-01-12", 30, None, "a", None), (4, "waiver", "posted", "2025-01-01", -10, None, "a", None),
        (5, "obligation", "posted", "2025-01-01", 100, None, "b", "2025-02-10"), (6, "payment", "posted", "2025-02-09", 100, None, "b", None), (7, "reversal", "posted", "2025-02-11", 100, 6, None, None), (8, "payment", "posted", "2025-02-09", 5, None, "lost", None),
    ]
    for grace, timely in ((1, 0), (2, 1)):
        r = signals.rent_profile(ledger(spark, rows), grace).first()
        # the payment of b is reversed: b is not observed, and that is no missed payment
        assert (r.scheduled_obligation_count, r.observable_obligation_count, r.fully_paid_count, r.timely_paid_count, r.partial_payment_count) == (2, 1, 1, timely, 1)
        assert (r.observable_obligation_amount, r.linked_payment_amount, r.provider_coverage_rate) == (90, 90, 0.5)
        assert r.reason_codes == ["ad_rent_partial_payment_observed", "ad_rent_waiver_observed", "ad_unmatched_obligation"]
    gap = (9, "reporting_unavailable", "posted", "2025-01-10", None, None, None, None)
    r = signals.rent_profile(ledger(spark, [*rows, gap]), 2).first()
    assert (r.state, r.fully_paid_rate, r.reporting_gap_count) == ("unavailable", None, 1)
    with pytest.raises(Exception, match="ad_linkage_family_mismatch"):
        signals.rent_profile(ledger(spark, rows).withColumn("currency", F.when(F.col("record_id") == 2, "EUR").otherwise("USD")), 2).collect()


def test_utility_profile(spark):
    rows = [(1, "bill", "posted", "2025-01-01", 100, None, "a", "2025-01-10"), (2, "estimated_bill", "posted", "2025-02-01", 50, None, "b", "2025-02-10"), (3, "adjustment", "posted", "2025-02-02", -20, None, "b", None), (4, "payment", "posted", "2025-02-03", 30, None, "b", None), (5, "service_interruption", "posted", "2025-02-04", None, None, None, None)]
    r = signals.utility_profile(ledger(spark, rows)).first()
    assert (r.original_billed_amount, r.net_adjusted_obligation, r.estimated_bill_rate, r.adjustment_rate, r.provider_count, r.service_type_count) == (150, 130, 0.5, 0.5, 1, 1)
    assert (r.fully_paid_count, r.timely_paid_count, r.service_interruption_count) == (1, 1, 1)


def test_complementary_suppression_hides_a_second_cell():
    atoms = {("all", "a"): 20, ("all", "b"): 30, ("all", "c"): 4}
    counts = {"all": 54, "a": 20, "b": 30, "c": 4}
    assert disclosure.complementary(atoms, counts, 10) == {"c": "primary", "a": "complementary"}
    assert disclosure.complementary(atoms, counts, 3) == {}
    with pytest.raises(ValueError):
        disclosure.complementary(atoms, counts, 10, frozenset({"all", "a", "b"}))
    # an unrelated split protects nothing and stays; totals go last
    atoms = {("A", "X", "all"): 1, ("A", "Y", "all"): 2, ("B", "X", "all"): 19, ("B", "Y", "all"): 18}
    counts = {"all": 40, "A": 3, "B": 37, "X": 20, "Y": 20}
    assert disclosure.complementary(atoms, counts, 10, totals=frozenset({"all"})) == {"A": "primary", "B": "complementary"}


def test_suppression_decides_as_elimination_in_fractions_does():
    """Leave-one-out rows in whole numbers against elimination in fractions for each cell by itself."""
    from fractions import Fraction

    def basis(rows, width):
        m, pivots, at = [[Fraction(v) for v in r] for r in rows], [], 0
        for c in range(width):
            hit = next((r for r in range(at, len(m)) if m[r][c]), None)
            if hit is not None:
                m[at], m[hit] = m[hit], m[at]
                m[at] = [v / m[at][c] for v in m[at]]
                m = [r if i == at or not r[c] else [v - r[c] * w for v, w in zip(r, m[at])] for i, r in enumerate(m)]
                pivots.append(c)
                at += 1
        out = []
        for free in (c for c in range(width) if c not in pivots):
            x = [Fraction(0)] * width
            x[free] = Fraction(1)
            for r, p in enumerate(pivots):
                x[p] = -m[r][free]
            scale = math.lcm(*(v.denominator for v in x))
            whole = [int(v * scale) for v in x]
            out.append([v // math.gcd(*whole) for v in whole])
        return out

    def plain(atoms, counts, minimum, totals):
        names = sorted(atoms)
        hidden = {c: "primary" for c in sorted(counts) if counts[c] < minimum}

        def opened(cell, shown):
            if not shown:
                return True
            ways = [x for x in basis([[int(c in n) for n in names] for c in shown], len(names)) if any(all(atoms[n] + g * w >= 0 for n, w in zip(names, x)) for g in (1, -1))]
            return any(sum(w for n, w in zip(names, x) if cell in n) for x in ways)

        while True:
            shown = [c for c in sorted(counts) if c not in hidden]
            unsafe = next((c for c in sorted(hidden) if not opened(c, shown)), None)
            if unsafe is None:
                return hidden
            left = sorted(shown, key=lambda c: (counts[c], c))
            frees = [c for c in left if opened(unsafe, [x for x in shown if x != c])]
            pick = [c for c in frees if c not in totals] or [c for c in left if c not in totals] or [c for c in frees if c in totals]
            if not pick:
                return None
            hidden[pick[0]] = "complementary"

    rng = np.random.default_rng(2)
    several = 0
    for _ in range(60):
        atoms = {}
        for _ in range(rng.integers(2, 9)):
            a, b, c = rng.integers(0, 3), rng.integers(0, 3), rng.integers(0, 2)
            key = ("all", f"a{a}", f"b{b}", *([f"ab{a}{b}"] if rng.random() < 0.5 else []), *(["c"] if c else []))
            atoms[key] = atoms.get(key, 0) + int(rng.integers(1, 30))
        counts = {c: sum(n for k, n in atoms.items() if c in k) for c in {c for k in atoms for c in k}}
        want = plain(atoms, counts, 10, {"all"})
        if want is None:
            with pytest.raises(ValueError):
                disclosure.complementary(atoms, counts, 10, totals=frozenset({"all"}))
        else:
            assert disclosure.complementary(atoms, counts, 10, totals=frozenset({"all"})) == want
            several += len(want) > 2
    assert several > 5


def test_release_keeps_what_was_published(spark):
    rows = [("group", "a", i) for i in range(20)] + [("group", "b", i) for i in range(20, 50)] + [("group", "c", i) for i in range(50, 54)] + [("all", "all", i) for i in range(54)]
    m = spark.createDataFrame(rows, "table_id string, cell_id string, entity_id long")
    declared = spark.createDataFrame([("group", "none"), ("group", "a")], "table_id string, cell_id string")
    first = disclosure.release(m, 10, declared, frozenset({"all:all"}))
    got = {r.cell_id: (r.state, r.n, r.bucket, r.reason) for r in first.collect()}
    assert got["c"] == got["none"] == ("suppressed", None, "0..9", "ad_sparse_report_cell") and got["b"][1] == 30
    assert got["a"] == ("suppressed", None, "hidden", "ad_complementary_suppression")
    again = disclosure.release(m, 10, declared, frozenset({"all:all"}), first)
    assert {r.cell_id: (r.state, r.n, r.bucket, r.reason) for r in again.collect()} == got
    more = m.unionByName(spark.createDataFrame([("group", "b", 99), ("all", "all", 99)], m.schema))
    with pytest.raises(ValueError, match="another count"):
        disclosure.release(more, 10, declared, frozenset({"all:all"}), first)
    with pytest.raises(ValueError, match="released cell"):
        disclosure.release(m, 31, declared, frozenset({"all:all"}), first)


def test_proxy_oracles(spark):
    df = spark.createDataFrame([(0.0, "A"), (2.0, "A"), (4.0, "B"), (6.0, "B")], "v double, g string")
    assert proxy.eta_squared(df, "g", "v").first()[0] == pytest.approx(0.8)
    ab = spark.createDataFrame([("a", "a"), ("b", "b")] * 10, "x string, y string")
    assert proxy.cramers_v(ab, "x", "y").first()[0] == pytest.approx(1.0)
    e = spark.createDataFrame([(str(i),) for i in range(50)], "e string")
    got = {r.e: r.f for r in e.select("e", proxy.fold_of(F.col("e"), 5, 7, "p1", "d").alias("f")).collect()}
    pack = lambda t: len(t).to_bytes(4, "big") + t
    assert got == {str(i): int(hashlib.sha256(b"d" + pack(b"p1") + (7).to_bytes(8, "big") + pack(str(i).encode())).hexdigest(), 16) % 5 for i in range(50)}


def test_research(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    assert {r.test: round(r.adjusted, 9) for r in research.holm(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert research.student_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-5) and research.student_tail(-2.0, 10) == pytest.approx(1 - 0.036694, abs=1e-5)


def test_streaming_windows(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS source_id, 'inflow' AS event_type, TIMESTAMP'2025-01-05' AS event_time, 2D AS amount UNION ALL SELECT 1, 'outflow', TIMESTAMP'2025-01-06', 3D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = gate.windowed_flow(stream).writeStream.outputMode("update").format("memory").queryName("flow").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.inflow, r.outflow, r.records) for r in spark.table("flow").collect()] == [(2.0, 3.0, 2)]


def canon(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*columns).collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == canon(duck.execute(f"SELECT {names} FROM ({sql})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_bootstrap_interval_resamples_the_whole_table(spark, duck):
    d = [r[0] for r in duck.execute("SELECT (c_acctbal > 0)::INT FROM customer ORDER BY c_custkey").fetchall()]
    n, resamples, material = len(d), 40, f"{bootstrap.DOMAIN}7\0overall.selection_rate\0scope".encode()
    h = b"".join(hashlib.sha256(material + i.to_bytes(8, "big")).digest() for i in range(n * resamples // 4 + 1))
    at = [int.from_bytes(h[8 * k : 8 * k + 8], "big") % n for k in range(n * resamples)]
    rates = np.array(d, float)[at].reshape(resamples, n).mean(1)
    got = catalogue.queries()["bootstrap_interval"](spark, SF).first()
    assert got.valid == resamples and (got.lower, got.upper) == pytest.approx(tuple(np.quantile(rates, [0.05, 0.95])))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_complementary_suppression_decides_every_cell(spark):
    q = catalogue.queries()
    got = {(r.table_id, r.cell_id): r for r in q["complementary_suppression"](spark, SF).collect()}
    counts = {(r.table_id, r.cell_id): r.n for r in q["disclosure_cells"](spark, SF).collect()}
    primary = {(r.table_id, r.cell_id) for r in q["primary_suppression"](spark, SF).collect() if r.suppressed}
    assert got.keys() == counts.keys() and {k for k, r in got.items() if r.reason == "ad_sparse_report_cell"} == primary
    hidden = {k for k, r in got.items() if r.state == "suppressed"}
    assert primary < hidden and all((r.n is None) == (k in hidden) and (k in hidden or r.n == counts[k]) for k, r in got.items())
