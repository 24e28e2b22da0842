"""Login attempts folded into lock states and the outcome of every attempt.

Per user, in order of (time, id): an attempt while locked changes nothing; a
failure raises the count, and at the limit locks for a while and sets the count
to 0; below the limit a failure clears an old lock; a success clears both and is
the user's last login.

Attempts are range-partitioned on (user, time, id) and streamed in order.  A user
who begins inside a task starts from the empty state, so these outcomes are final.
Only a task's first user may go on from the task before.  That stretch is
summarised as a transition: the exit state for every possible entry state, which
is a count below the limit, or a lock.  A lock that is over before attempt ``k``
acts like an empty state there, and it must be over within the lock time, so one
exit for each attempt of the stretch's first lock time is enough.  The transitions
of a user, one per task, are folded in a small second stage, and the stretches are
replayed from their entry states, each again in a task of its own.  A user with a
third of all attempts, all of them failures, is thus spread over many tasks, and no
task ever holds more than one range of attempts.

Edge cases: rows without user, time, id or outcome are left out; repeated ids
count once; users missing in ``users``, if given, are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.functions.text import iso_time
from lorikeet.session import cut_lineage

LIMIT, LOCK_S = 5, 15 * 60
_FREE = -(2**62)
_LISTS = ("starts", "start_failed", "start_until", "exit_failed", "exit_until")
_SCHEMA = pa.schema(
    [("username", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("fail", pa.bool_()), ("seg", pa.int64()), ("failed", pa.int64()), ("until", pa.int64()), ("locked", pa.bool_()), ("n", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in _LISTS]
)
_DDL = "username string, us bigint, id bigint, fail boolean, seg bigint, failed bigint, until bigint, locked boolean, n bigint, " + ", ".join(f"{c} array<bigint>" for c in _LISTS)


def step(failed: int, until: int, us: int, fail: bool, limit: int, lock_us: int) -> tuple[int, int, bool]:
    """Count and lock behind an attempt, and whether it met a lock."""
    if until > us:
        return failed, until, True
    if not fail:
        return 0, _FREE, False
    if failed + 1 >= limit:
        return 0, us + lock_us, False
    return failed + 1, _FREE, False


def transition(us: list[int], fail: list[bool], limit: int, lock_us: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Exit states of a stretch: ``starts`` with the exit of an empty state at each of its
    first attempts, then the exit of every count at the first."""
    n = len(us)
    out_failed, out_until = [0] * (n + 1), [_FREE] * (n + 1)

    def run(k: int, failed: int) -> tuple[int, int]:
        """From a count before attempt ``k`` to the end, over known exits of later attempts."""
        while k < n:
            if not fail[k]:
                return out_failed[k + 1], out_until[k + 1]
            failed += 1
            if failed >= limit:
                until = us[k] + lock_us
                j = bisect_left(us, until, k + 1)
                return (0, until) if j == n else (out_failed[j], out_until[j])
            k += 1
        return failed, _FREE

    for k in range(n - 1, -1, -1):
        out_failed[k], out_until[k] = run(k, 0)
    m = bisect_left(us, us[0] + lock_us) + 1  # a lock from before is over here
    exits = [run(0, f) for f in range(limit)]
    return us[:m], out_failed[:m], out_until[:m], [e[0] for e in exits], [e[1] for e in exits]


def _run(limit: int, lock_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId()
        head: list[tuple[int, int, bool]] = []
        first = user = since = None
        failed, until = 0, _FREE
        cols: list[list] = [[] for _ in range(8)]

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip([*cols, [None] * len(cols[0])], _SCHEMA)]
            out = pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(cols[0]), f.type) for f in list(_SCHEMA)[9:])], schema=_SCHEMA)
            for c in cols:
                c.clear()
            return out

        def summary() -> pa.RecordBatch:
            us, ids, fail = (list(c) for c in zip(*head))
            row = [first, us[0], ids[0], None, seg, None, None, None, len(us), *transition(us, fail, limit, lock_us)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            for u, us, i, f in zip(*(c.to_pylist() for c in b.columns)):
                if first is None:
                    first = u
                if u == first:
                    head.append((us, i, f))
                    row = (u, us, i, f, seg, 0, _FREE, False)
                else:
                    if u != user:
                        user, failed, until, since = u, 0, _FREE, [us, i, 0]
                    since[2] += 1
                    failed, until, locked = step(failed, until, us, f, limit, lock_us)
                    row = (u, us, i, f, -1, failed, until, locked)
                for c, x in zip(cols, row):
                    c.append(x)
            if len(cols[0]) > 20_000:
                yield flush()
        if cols[0]:
            yield flush()
        if head:
            yield summary()
        if user is not None:  # the task's last user may go on in the next one, from this state
            row = [user, since[0], since[1], None, -1, failed, until, None, since[2], *[None] * len(_LISTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA)], schema=_SCHEMA)

    return run


def _enter(t: pa.Table) -> pa.Table:
    """Entry states of one user's stretches, one after the other."""
    failed, until = 0, _FREE
    out = []
    for r in sorted(t.to_pylist(), key=lambda r: (r["us"], r["id"])):
        if r["seg"] < 0:  # begun inside a task: its state is known
            failed, until = r["failed"], r["until"]
            continue
        out.append((r["seg"], failed, until))
        if until <= r["us"]:
            failed, until = r["exit_failed"][failed], r["exit_until"][failed]
        else:
            k = bisect_left(r["starts"], until)
            if k < r["n"]:
                failed, until = r["start_failed"][k], r["start_until"][k]
    cols = zip(*out) if out else [[]] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["seg", "entry_failed", "entry_until"])


def _replay(limit: int, lock_us: int):
    def replay(t: pa.Table) -> pa.Table:
        t = t.sort_by([("us", "ascending"), ("id", "ascending")])
        failed, until = t.column("entry_failed")[0].as_py(), t.column("entry_until")[0].as_py()
        out = []
        for us, fail in zip(t.column("us").to_pylist(), t.column("fail").to_pylist()):
            failed, until, locked = step(failed, until, us, fail, limit, lock_us)
            out.append((failed, until, locked))
        f, u, k = zip(*out)
        return pa.table([*(t.column(c) for c in ("username", "us", "id", "fail")), pa.array(f, pa.int64()), pa.array(u, pa.int64()), pa.array(k)], names=["username", "us", "id", "fail", "failed", "until", "locked"])

    return replay


def login_outcomes(attempts: DataFrame, user: Column | str, ts: Column | str, event_id: Column | str, failed: Column | str, limit: int = LIMIT, lock_s: int = LOCK_S, users: DataFrame | None = None) -> DataFrame:
    """``username, us, id, fail, failed, until, locked`` of every attempt: what it was, and the
    state behind it (``until`` null where there is no lock)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = (
        attempts.select(col(user).alias("u"), F.unix_micros(col(ts).cast("timestamp")).alias("us"), col(event_id).cast("bigint").alias("id"), col(failed).alias("f"))
        .where("u is not null and us is not null and id is not null and f is not null")
        .groupBy("id")
        .agg(F.min(F.struct("us", "u", "f")).alias("e"))
        .select("e.u", "e.us", "id", "e.f")
    )
    if users is not None:
        rows = rows.join(users.select(F.col("username").alias("u")), "u", "left_semi").select("u", "us", "id", "f")
    lock_us = lock_s * 1_000_000
    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, "u", "us", "id").sortWithinPartitions("u", "us", "id").mapInArrow(_run(limit, lock_us), _DDL)
    runs = cut_lineage(runs)
    states = "username string, us bigint, id bigint, fail boolean, failed bigint, until bigint, locked boolean"
    entries = runs.where("n is not null").groupBy("username").applyInArrow(_enter, "seg bigint, entry_failed bigint, entry_until bigint")
    # One entry per task of the range partitioning, so this side has a fixed size.
    open_ = runs.where("n is null and seg >= 0").select("username", "us", "id", "fail", "seg").join(F.broadcast(entries), "seg")
    replayed = open_.groupBy("seg").applyInArrow(_replay(limit, lock_us), states)
    done = runs.where("n is null and seg < 0").select("username", "us", "id", "fail", "failed", "until", "locked")
    return done.unionByName(replayed).withColumn("until", F.when(F.col("until") != _FREE, F.col("until")))


def lock_states(attempts: DataFrame, user: Column | str, ts: Column | str, event_id: Column | str, failed: Column | str, limit: int = LIMIT, lock_s: int = LOCK_S, users: DataFrame | None = None) -> DataFrame:
    """``username, failed_attempts, locked_until_us, n_attempts, n_while_locked, n_locks, last_login_us``."""
    o = login_outcomes(attempts, user, ts, event_id, failed, limit, lock_s, users)
    count = lambda c: F.sum(c.cast("bigint"))
    s = o.groupBy("username").agg(
        F.max(F.struct("us", "id", "failed", "until")).alias("last"),
        F.count("*").alias("n_attempts"),
        count(F.col("locked")).alias("n_while_locked"),
        count(~F.col("locked") & F.col("until").isNotNull()).alias("n_locks"),
        F.max(F.when(~F.col("fail") & ~F.col("locked"), F.col("us"))).alias("last_login_us"),
    )
    return s.select("username", F.col("last.failed").alias("failed_attempts"), F.col("last.until").alias("locked_until_us"), "n_attempts", "n_while_locked", "n_locks", "last_login_us")


def locked_events(outcomes: DataFrame) -> DataFrame:
    """``username, us, id, event_type, metadata``: the audit row of every attempt that met a lock."""
    text = F.concat(F.lit('{"locked_until": "'), iso_time("until"), F.lit('"}'))
    return outcomes.where("locked").select("username", "us", "id", F.lit("LOGIN_LOCKED").alias("event_type"), text.alias("metadata"))
