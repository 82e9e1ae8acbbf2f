"""Scans, alignment, throttling and containment against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from unitwise.functions.scan import numbered, order_statistics, running
from unitwise.operators import cells as C
from unitwise.operators import quality, reconcile, score
from unitwise.sources import tables as T
from unitwise.streaming import progress as X


def test_running_matches_plain_scan(spark):
    rnd = random.Random(1)
    pos = rnd.sample(range(5000), 400)
    data = [(k, p, rnd.randint(-5, 9) if rnd.random() < 0.8 else None)
            for p in pos for k in (0, p % 3)]
    data = list({(k, p): (k, p, v) for k, p, v in data}.values())
    df = spark.createDataFrame(data, "k int, p long, v int")
    for levels in (1, 2, 3):
        for how in ("sum", "max"):
            got = running(df, ["k"], "p", {"o": F.col("v")}, how, levels, bits=4).collect()
            want = {}
            for k in {d[0] for d in data}:
                acc = None
                for _, p, v in sorted((d for d in data if d[0] == k), key=lambda d: d[1]):
                    if v is not None:
                        acc = v if acc is None else (acc + v if how == "sum" else max(acc, v))
                    want[k, p] = acc
            for r in got:
                w = want[r.k, r.p]
                assert r.o == w or (how == "sum" and w is None and r.o == 0), (levels, how, r, w)
    n = {(r.k, r.p): r.o for r in numbered(df, ["k"], "p", "o").collect()}
    for k in {d[0] for d in data}:
        for i, p in enumerate(sorted(d[1] for d in data if d[0] == k), 1):
            assert n[k, p] == i


def test_order_statistics(spark):
    rnd = random.Random(2)
    data = [(k, round(float(rnd.choice([1, 2, 2.5, 900.25, rnd.random() * 1e5])), 2))
            for k in (1, 2) for _ in range(57)]
    df = spark.createDataFrame(data, "k int, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = order_statistics(df, ["k"], "v", {"q": F.floor(F.col("_n") * 0.25)}).collect()
    for r in got:
        vals = sorted(v for k, v in data if k == r.k)
        assert float(r.q) == vals[int(len(vals) * 0.25)] and r.n == 57


def test_order_statistics_at_every_level(spark):
    """Ranges of eight, ties, negative values and several values of one position."""
    rnd = random.Random(12)
    data = [(k, rnd.choice([-7.25, 0.0, 0.001, 0.002, 3.0, rnd.randint(-90, 900) / 4])) for k in range(5)
            for _ in range(rnd.randint(1, 40))] + [(9, None)]
    df = spark.createDataFrame(data, "k int, v double").withColumn("v", F.col("v").cast("decimal(18,3)"))
    ranks = {"a": F.lit(0), "b": F.floor((F.col("_n") - 1) / 2), "c": F.floor(F.col("_n") * 0.75), "d": F.col("_n") - 1}
    for levels in (1, 2, 4):
        got = {r.k: r for r in order_statistics(df, ["k"], "v", ranks, levels=levels, bits=3).collect()}
        assert set(got) == set(range(5))
        for k, r in got.items():
            vals = sorted(v for j, v in data if j == k)
            n = len(vals)
            want = [vals[i] for i in (0, (n - 1) // 2, int(n * 0.75), n - 1)]
            assert r.n == n and [float(r[x]) for x in "abcd"] == want


def test_quartiles_read_units_once(spark, sf_dir):
    """Both fields are counted in one read; the levels go over the staged counts."""
    from unitwise.operators import outliers
    plan = outliers.highlights(T.units(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_totalprice") > 0 and "_pos" in plan
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("o_orderkey" in line for line in scans) == 1


def brute_align(truth, found):
    used, out = set(), {}
    for i, g in truth:
        for j, e in found:
            if j not in used and e == g and g:
                out[i] = j
                used.add(j)
                break
    for i, g in truth:
        if i in out or not g:
            continue
        near = [j for j, e in found if j not in used and e and min(len(e), len(g)) >= 2
                and (e.endswith(g) or g.endswith(e))]
        if len(near) == 1:
            out[i] = near[0]
            used.add(near[0])
    return out


def test_align(spark):
    rnd = random.Random(3)
    pool = ["1", "12", "112", "A12", "BA12", "2B", "C2B", "99", "7C", "N7C", "S7C", "SS7C"]
    truth, found, want = [], [], set()
    for doc in range(60):
        g = [(p, rnd.choice(pool)) for p in range(rnd.randint(1, 9))]
        e = [(p, rnd.choice(pool)) for p in range(rnd.randint(1, 9))]
        truth += [(doc, p, u) for p, u in g]
        found += [(doc, p, u) for p, u in e]
        want |= {(doc, i, j) for i, j in brute_align(g, e).items()}
    schema = "doc_id long, pos long, unit_number string"
    got = score.align(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema))
    assert {tuple(r) for r in got.select("doc_id", "gt_pos", "ex_pos").collect()} == want


def test_align_waits_for_earlier_rows(spark):
    """Long families, many copies of a truth id, and chains in which each taking waits for the one before."""
    rnd = random.Random(8)
    truth, found, want = [], [], set()
    for doc in range(25):
        ids = ["".join(rnd.choice("12") for _ in range(rnd.randint(1, 5))) for _ in range(14)]
        g = [(p * 3, rnd.choice(ids)) for p in range(40)]
        e = [(p * 2, rnd.choice(ids)) for p in range(rnd.randint(1, 25))]
        truth += [(doc, p, u) for p, u in g]
        found += [(doc, p, u) for p, u in e]
        want |= {(doc, i, j) for i, j in brute_align(g, e).items()}
    # Nines of falling length: every id ends with all shorter ones.
    chain_g = [(p, "9" * (10 - p)) for p in range(8)]
    chain_e = [(0, "A" + "9" * 10), (1, "999999999"), (2, "99999999"), (3, "9999999")]
    truth += [(99, p, u) for p, u in chain_g]
    found += [(99, p, u) for p, u in chain_e]
    want |= {(99, i, j) for i, j in brute_align(chain_g, chain_e).items()}
    schema = "doc_id long, pos long, unit_number string"
    got = score.align(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema))
    assert {tuple(r) for r in got.select("doc_id", "gt_pos", "ex_pos").collect()} == want


def test_align_empty(spark):
    none = spark.createDataFrame([], "doc_id long, pos long, unit_number string")
    some = spark.createDataFrame([(1, 1, "12"), (1, 2, None), (None, 3, "2")], none.schema)
    assert score.align(none, some).count() == 0 and score.align(some, none).count() == 0


def brute_views(sheets):
    keep = [True] * len(sheets)
    for a, (ua) in enumerate(sheets):
        for b, (ub) in enumerate(sheets):
            if a == b or not keep[a] or not keep[b] or not ub:
                continue
            if len(ub) > len(ua) or (len(ub) == len(ua) and b < a):
                continue
            if any(t for _, t in ub) and set(ub) <= set(ua):
                keep[b] = False
    return [i for i, k in enumerate(keep) if k]


def test_drop_duplicate_views(spark):
    rnd = random.Random(4)
    rows, want = [], set()
    for doc in range(40):
        sheets = []
        for _ in range(rnd.randint(1, 5)):
            sheets.append([(rnd.choice("12"), rnd.choice(["", "ann", "bob"]))
                           for _ in range(rnd.randint(1, 4))])
        want |= {(doc, i) for i in brute_views(sheets)}
        rows += [(doc, i, f"s{i}", u, t or None) for i, s in enumerate(sheets) for u, t in s]
    df = spark.createDataFrame(
        rows, "doc_id long, sheet_no int, sheet string, unit_number string, tenant_name string")
    got = {(r.doc_id, r.sheet_no) for r in C.drop_duplicate_views(df).collect()}
    assert got == want


def brute_throttle(events):
    last, stage, out = None, None, []
    for eid, t, st, kind in events:
        if kind is None and st == stage and last is not None and t - last < 1000:
            continue
        last, stage = t, st
        out.append(eid)
    return out


def feed(spark, seed=5):
    rnd = random.Random(seed)
    rows, want = [], set()
    for job in range(6):
        t, events = 0, []
        for i in range(120):
            t += rnd.choice([100, 300, 400, 700, 999, 1000, 2500])
            kind = "info" if rnd.random() < 0.08 else None
            events.append((job * 1000 + i, t, "a" if rnd.random() < 0.95 else "b", kind))
        want |= {(job, e) for e in brute_throttle(events)}
        rows += [(job, e, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms),
                  st, f"d{e}" if e % 3 else None, k) for e, ms, st, k in events]
    df = spark.createDataFrame(rows, "job_id long, event_id long, event_at timestamp, stage string,"
                                     " detail string, kind string")
    return df, want


def test_throttle(spark):
    df, want = feed(spark)
    assert {tuple(r) for r in X.throttle(df).select("job_id", "event_id").collect()} == want


def test_throttle_long_chains(spark, monkeypatch):
    """Seconds in groups of two, so that chains run through every level; repeated times and ids in any order."""
    monkeypatch.setattr(X, "_SCAN_BITS", 1)
    monkeypatch.setattr(X, "_SCAN_LEVELS", 4)
    rnd = random.Random(6)
    rows, want = [], set()
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for job in range(8):
        t, events = 0, []
        for _ in range(300):
            t += rnd.choice([0, 0, 1, 5, 130, 330, 700, 999])
            events.append((t, rnd.randrange(10**9), "a" if rnd.random() < 0.99 else None,
                           "info" if rnd.random() < 0.01 * (job % 3) else None))
        events.sort(key=lambda e: e[:2])
        want |= {(job, e) for e in brute_throttle([(i, ms, st, k) for ms, i, st, k in events])}
        rows += [(job, i, start + dt.timedelta(milliseconds=ms), st, None, k) for ms, i, st, k in events]
    df = spark.createDataFrame(rows, "job_id long, event_id long, event_at timestamp, stage string,"
                                     " detail string, kind string")
    assert {tuple(r) for r in X.throttle(df.repartition(5)).collect()} == want
    assert X.throttle(df.limit(0)).count() == 0


def test_throttle_orders_no_job_in_one_task(spark):
    """No Python, and every exchange is dealt by more than the job but the one of the topmost groups."""
    df, _ = feed(spark)
    plan = X.throttle(df)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_streams_equal_batch(spark, tmp_path):
    df, want = feed(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = X.latest_progress(stream).writeStream.outputMode("complete").format("memory").queryName(
        "latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("latest").select("job_id", "stage", "detail", "n_events").collect()}
    assert got == {tuple(r) for r in X.latest_progress(df).select(
        "job_id", "stage", "detail", "n_events").collect()}
    q = X.throttled_stream(stream).writeStream.outputMode("append").format("memory").queryName(
        "written").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.job_id, r.event_id) for r in spark.table("written").collect()} == want


def test_layout_does_not_matter(spark, sf_dir):
    """Repartitioned and reordered input gives the same checks."""
    u, s = T.units(spark, sf_dir), T.stated(spark, sf_dir)
    base = {tuple(r) for r in quality.verify(u, s).collect()}
    mixed = u.orderBy(F.rand(7)).repartition(5)
    assert {tuple(r) for r in quality.verify(mixed, s).collect()} == base


def test_flagship_has_every_basis(spark):
    from unitwise.registry import all_queries
    rows = all_queries()["reconcile_rent"](spark, "/root/testdata/sf0.01").collect()
    assert {r.basis for r in rows} == {
        "exact", "non_tenant_rent", "convention", "unexplained_in_tolerance", "mismatch"}
    assert len(rows) == 40


def test_one_document_plan_is_partially_aggregated(spark, sf_dir):
    """The statistics need a single exchange and no window."""
    from unitwise.operators.stats import summary_stats
    plan = summary_stats(T.units(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_stated_rate(spark):
    df = spark.createDataFrame([(1, 5, None, None, None, 0.9231, None, -1)],
                               "doc_id long, stated_units long, stated_rent decimal(28,2), stated_market"
                               " decimal(28,2), stated_sqft decimal(28,2), stated_rate double,"
                               " stated_occupied long, stated_vacant long")
    r = reconcile.stated_or_null(df).first()
    assert str(r.stated_rate) == "92.3100" and r.stated_vacant is None


@pytest.mark.parametrize("parts", [1, 7])
def test_units_pair_once_with_missed_and_invented(spark, parts):
    rng = random.Random(11)
    ids = ["A1", "a-1", "Unit 2", "2", "B3", "C4", "", None, "D5"]
    side = lambda n: [(rng.randrange(3), k, rng.choice(ids) if rng.random() < 0.6 else f"u{k}") for k in range(n)]
    truth, found = side(150), side(170)
    schema = "doc_id long, pos long, unit_number string"
    rows = score.pair_units(spark.createDataFrame(truth, schema).repartition(parts),
                            spark.createDataFrame(found, schema).repartition(parts)).collect()
    clean = lambda u: (u or "").upper().removeprefix("UNIT").replace("-", "").strip()

    def numbered_copies(units):
        seen, out = {}, {}
        for doc, pos, unit in units:
            if clean(unit):
                key = (doc, clean(unit))
                seen[key] = seen.get(key, 0) + 1
                out[key, seen[key]] = pos
        return out
    g, a = numbered_copies(truth), numbered_copies(found)
    want = {(key[0], pos, a.get((key, k))) for (key, k), pos in g.items()}
    want |= {(key[0], None, pos) for (key, k), pos in a.items() if (key, k) not in g}
    want |= {(doc, pos, None) for doc, pos, unit in truth if not clean(unit)}
    want |= {(doc, None, pos) for doc, pos, unit in found if not clean(unit)}
    assert {(r.doc_id, r.gt_pos, r.ex_pos) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert (r.g and r.g.pos) == r.gt_pos and (r.a and r.a.pos) == r.ex_pos
