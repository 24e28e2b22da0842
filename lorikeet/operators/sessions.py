"""Sessions from a Cartesian tree over the gaps between consecutive events.

Per entity, the events in order of (time, id) are the leaves and the gaps
between neighbours the inner nodes of a max-Cartesian tree: the root is the
longest gap, each child the longest gap on its side.  Cutting the tree at a
threshold ``T`` leaves the maximal subtrees whose longest gap is at most ``T``,
which are exactly the sessions for that inactivity gap.  The tree is built once
and cut for any number of gap settings by a plain filter, because every node
carries its own height and its parent's.

Distribution: the events are range-partitioned on (entity, time, id), so an
entity that holds a third of all rows is spread over many tasks.  Each task
builds the tree of its run of rows in one streaming pass (its memory is the
right spine).  Entities wholly inside a task are finished there.  Of the at most
two entities that reach a task's edges, only the subtrees on the open spines
stay unfinished - those bounded by strictly rising gaps from the left and
strictly falling gaps to the right, logarithmically many for ordinary data -
and a second, small stage merges these by the very same algorithm, with
subtrees in place of events.  Gaps that fall strictly for n events in a row add up
to n * n / 2 units of time, so an entity has at most sqrt(2 * span) open subtrees
per direction: some 25,000 in ten years of times given in seconds, whatever the
number of its events.

Edge cases: rows without entity, time or id are left out; rows that repeat an
id count once (the earliest time wins, then the smallest entity); equal times
are ordered by id; an empty input gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.session import cut_lineage

#: Parent height of a root, and height of a single event (below every gap).
ROOT, LEAF = 2**63 - 1, -1

_NODE = "entity string, first_id bigint, last_id bigint, start_us bigint, end_us bigint, n bigint, height bigint, parent_height bigint, open boolean"
_ARROW = pa.schema(
    [("entity", pa.string())]
    + [(c, pa.int64()) for c in ("first_id", "last_id", "start_us", "end_us", "n", "height", "parent_height")]
    + [("open", pa.bool_())]
)
_FLUSH = 20_000


class _Spine:
    """The Cartesian tree of one entity under construction.

    Trees are tuples ``(first_id, last_id, start, end, n, height)``.  ``stack``
    holds (tree, gap to its right) with falling gaps.  While the left edge is
    open, subtrees that touch it are frozen instead of merged.
    """

    __slots__ = ("entity", "stack", "cur", "frozen", "left_open", "out")

    def __init__(self, entity: str, tree: tuple, left_open: bool, out: list) -> None:
        self.entity, self.cur, self.left_open, self.out = entity, tree, left_open, out
        self.stack: list = []
        self.frozen: list = []

    def _emit(self, t: tuple, parent: int) -> None:
        if t[5] != parent:  # a node as high as its parent is no session at any threshold
            self.out.append((self.entity, *t, parent, False))

    def _join(self, left: tuple, gap: int, right: tuple) -> tuple:
        self._emit(left, gap)
        self._emit(right, gap)
        return (left[0], right[1], left[2], right[3], left[4] + right[4], gap)

    def add(self, tree: tuple) -> None:
        gap, cur, stack = tree[2] - self.cur[3], self.cur, self.stack
        while stack and stack[-1][1] <= gap:
            if len(stack) == 1 and self.left_open:
                if stack[0][1] < gap:
                    self.frozen.append(stack.pop()[0])
                break
            left, g = stack.pop()
            cur = self._join(left, g, cur)
        stack.append((cur, gap))
        self.cur = tree

    def close(self) -> None:
        cur = self.cur
        while self.stack:
            left, g = self.stack.pop()
            cur = self._join(left, g, cur)
        self._emit(cur, ROOT)

    def leave_open(self) -> None:
        for t in [*self.frozen, *(t for t, _ in self.stack), self.cur]:
            self.out.append((self.entity, *t, 0, True))


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of one sorted run of (entity, us, id); edge entities stay open."""
    out: list = []
    spine: _Spine | None = None
    for b in batches:
        for e, us, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            leaf = (i, i, us, us, 1, LEAF)
            if spine is None:
                spine = _Spine(e, leaf, True, out)
            elif spine.entity == e:
                spine.add(leaf)
            else:
                spine.leave_open() if spine.left_open else spine.close()
                spine = _Spine(e, leaf, False, out)
        if len(out) >= _FLUSH:
            yield _batch(out)
            out.clear()
    if spine is not None:
        spine.leave_open()
    yield _batch(out)


def _merge(t: pa.Table) -> pa.Table:
    """The remaining nodes of one entity from its unfinished subtrees, in order."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("start_us", "first_id", "last_id", "end_us", "n", "height"))))
    entity, out = t.column("entity")[0].as_py(), []
    trees = [(fi, la, st, en, n, h) for st, fi, la, en, n, h in rows]
    spine = _Spine(entity, trees[0], False, out)
    for x in trees[1:]:
        spine.add(x)
    spine.close()
    return pa.Table.from_batches([_batch(out)])


def gap_tree(df: DataFrame, entity: Column | str, ts: Column | str, event_id: Column | str) -> DataFrame:
    """All nodes of every entity's gap tree that are a session at some threshold.

    Result: ``entity, first_id, last_id, start_us, end_us, n, height,
    parent_height`` (microseconds); a node is a session for every threshold
    ``T`` with ``height <= T < parent_height``.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = (
        df.select(col(entity).cast("string").alias("entity"), F.unix_micros(col(ts).cast("timestamp")).alias("us"), col(event_id).cast("bigint").alias("id"))
        .where("entity is not null and us is not null and id is not null")
        .groupBy("id")
        .agg(F.min(F.struct("us", "entity")).alias("e"))
        .select("e.entity", "e.us", "id")
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, "entity", "us", "id").sortWithinPartitions("entity", "us", "id")
    nodes = runs.mapInArrow(_build, _NODE)
    nodes = cut_lineage(nodes)  # read twice below, so computed once and kept
    done = nodes.where("not open")
    rest = nodes.where("open").groupBy("entity").applyInArrow(_merge, _NODE)
    return done.unionByName(rest).drop("open")


def cut(tree: DataFrame, gap_seconds: float) -> DataFrame:
    """Sessions of ``tree`` for one inactivity gap; exactly the gap is no break."""
    t = int(gap_seconds * 1_000_000)
    return tree.where((F.col("height") <= t) & (F.col("parent_height") > t)).select(
        "entity",
        "first_id",
        "last_id",
        F.timestamp_micros("start_us").alias("session_start"),
        F.timestamp_micros("end_us").alias("session_end"),
        ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"),
        F.col("n").alias("n_events"),
    )
