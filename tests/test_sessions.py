import datetime as dt
import random

from lorikeet.operators.sessions import ROOT, _build, _merge, cut, gap_tree

T0 = dt.datetime(2024, 1, 1)
DDL = "username string, id long, created_at timestamp, entity string, n long, open boolean"


def brute(rows, gap):
    seen = {}
    for u, i, t in rows:
        if u is not None and i is not None and t is not None:
            seen[i] = min(seen.get(i, (t, u)), (t, u))
    out = set()
    for user in {u for _, u in seen.values()}:
        evs = sorted((t, i) for i, (t, u) in seen.items() if u == user)
        start, prev, n = evs[0], evs[0], 0
        for e in evs:
            if (e[0] - prev[0]).total_seconds() > gap:
                out.add((user, start[1], prev[1], n))
                start, n = e, 0
            prev, n = e, n + 1
        out.add((user, start[1], prev[1], n))
    return out


def run(spark, rows, gaps):
    df = spark.createDataFrame([(u, i, t, "x", 1, True) for u, i, t in rows], DDL)
    tree = gap_tree(df, "username", "created_at", "id").cache()
    return {g: {(r.entity, r.first_id, r.last_id, r.n_events) for r in cut(tree, g).collect()} for g in gaps}


def test_against_brute_force_with_hot_user_ties_and_repeats(spark):
    rnd = random.Random(3)
    rows = [
        ("hot" if rnd.random() < 0.6 else f"u{rnd.randrange(20)}", rnd.randrange(900), T0 + dt.timedelta(seconds=rnd.randrange(60_000)))
        for _ in range(1500)
    ]
    rows += rows[:40] + [(None, 5000, T0), ("a", None, T0), ("a", 5001, None)]
    gaps = (0, 10, 60, 1800, 10**7)
    got = run(spark, rows, gaps)
    for g in gaps:
        assert got[g] == brute(rows, g)


def test_exactly_the_gap_is_no_break(spark):
    rows = [("a", 1, T0), ("a", 2, T0 + dt.timedelta(seconds=1800)), ("a", 3, T0 + dt.timedelta(seconds=3600, microseconds=1))]
    assert run(spark, rows, (1800,))[1800] == {("a", 1, 2, 2), ("a", 3, 3, 1)}


def test_empty(spark):
    assert run(spark, [], (1800,))[1800] == set()


def test_regular_heartbeat_leaves_short_spines():
    """Equal gaps at the open edges must not pile up unfinished subtrees."""
    import pyarrow as pa

    n = 10_000
    b = pa.record_batch([pa.array(["a"] * n), pa.array(range(0, n * 60, 60)), pa.array(range(n))], names=["entity", "us", "id"])
    t = pa.Table.from_batches(list(_build([b])))
    assert sum(t.column("open").to_pylist()) < 5
    merged = _merge(t.filter(t.column("open"))).to_pylist()
    assert [r["n"] for r in merged if r["parent_height"] == ROOT] == [n]
