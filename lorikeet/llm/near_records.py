"""Near-duplicate records by T-occurrence search with DivideSkip.

Two records are linked if the Jaccard similarity of their word-shingle sets is
at least ``threshold``.  A record with ``n`` shingles needs at least ``T =
ceil(threshold * n)`` in common with any partner, so with the inverted lists of
all shingles in one global order, short lists first:

* shingles that nobody else has are left out; a record that keeps fewer than ``T``
  has no partner;
* Divide: a record's last ``T - c`` lists are its long lists, all others its short
  ones (``c`` is a share of the smaller record's size, so that chance meetings of long
  records don't suffice).  Of a pair, both sizes are known, and with them a larger number
  ``A`` of shingles that it must share; so of each record of the pair, all but the last
  ``A - c`` lists are short.  Between records of one size this is a quarter of the lists at
  threshold 0.6, where ``T`` alone leaves 0.4, and the lists saved are the longest;
* Merge: only short lists are merged, with a count per pair of records and the
  cut-off ``c``.  Every posting carries the number of lists from its own on, which bounds
  the size of its partners, so most pairs of a list are not even formed; and it carries
  a parity sketch of its whole set, whose differing bits bound the difference of two sets
  from below: a bound that loses no link ends most chance meetings in the lists of a
  formulaic collection at once;
* Skip: everything that two records share up to the end of the short part that ends
  first lies in the short lists of both.  Of the few pairs left, the long lists of the
  record whose short part ends first are decided by binary search in the other record.
  Its probes and the merged count add up to the exact overlap; no long list is ever read.

In Spark terms: exact copies are collapsed to one representative first (equal
shingle sets).  The order comes from a table of counters of fixed size, to which
shingles are hashed: any order that all records share is exact, and this one
needs neither a join of all shingles nor a broadcast that grows.  Lists are merged
in cells of bounded size, ordered by record size, so a list of any length is the
work of many tasks; within a task the meetings of one pair are counted before the
shuffle, by sorting instead of a heap.  Hot shingles are long lists and never
merged, so a clause found in a third of all records costs no quadratic work unless
these records really are alike.  All joins sort and merge.

Edge cases: null keys and texts and records under ``min_words`` words take no
part; rows with equal key count once (the smallest text); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.components import components
from lorikeet.llm.shingles import flat, lists, mix, overlaps, parity_sketch, set_keys, shingle_sets, word_hashes
from lorikeet.session import cut_lineage, release

SHINGLE, THRESHOLD, MIN_WORDS = 5, 0.8, 1
#: Times that a partner must occur in the short lists, as a share of the shingles.
HITS = 0.04
#: Counters of the global order: four bytes each, 4 MB sent to every executor.
COUNTERS = 1 << 20
#: Words of 64 bits in a parity sketch; sets of more than ``LONG`` shingles carry twice as many.
LANES, LONG = 8, 400
#: Longest list, or block of one, whose postings meet each other in one place.
CELL = 4096
#: Most long cells whose table is sent to all tasks (20 bytes each); more are joined.
MOST_SENT = 100_000
#: Columns of a signed set.
SET = "set struct<a:bigint,b:bigint>, n int, sh array<bigint>, sketch binary"
#: Pairs looked at in one vector operation, and pairs counted together.
PAIRS, COUNTED = 1 << 15, 1 << 18


def _pack(narrow: np.ndarray, upper: np.ndarray, wide: np.ndarray) -> pa.Array:
    """Sketches as one binary column: ``LANES`` words, and as many again for wide rows."""
    size = np.where(wide, 2 * LANES, LANES)
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(off[-1]), dtype=np.int64)
    lane = np.arange(LANES)
    out[off[:-1, None] + lane] = narrow
    out[off[:-1][wide][:, None] + LANES + lane] = upper[wide]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * off).astype(np.int32)), pa.py_buffer(out)])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower words of all sketches, and the upper ones, 0 where a set is short."""
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    words = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]].view(np.uint64)
    off = (off - off[0]) // 8
    lane = np.arange(LANES)
    upper = np.zeros((len(column), LANES), dtype=np.uint64)
    wide = np.diff(off) > LANES
    upper[wide] = words[off[:-1][wide][:, None] + LANES + lane]
    return words[off[:-1, None] + lane], upper


def signed(key: pa.Array, v: np.ndarray, o: np.ndarray, alone: pa.Array | None = None) -> pa.RecordBatch:
    """``key, set, n, sh, sketch`` of shingle sets; ``alone`` names the sets that are empty."""
    keys = set_keys(v, o)
    sid = pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["a", "b"])
    if alone is not None and not np.diff(o).all():
        sid = pc.if_else(pa.array(np.diff(o) > 0), sid, alone)
    wide = parity_sketch(v, o, 2 * LANES)
    # The narrow sketch is the wide one folded, so the upper half tells both.
    sketch = _pack(wide[:, :LANES] ^ wide[:, LANES:], wide[:, LANES:], np.diff(o) > LONG)
    return pa.record_batch([key, sid, pa.array(np.diff(o).astype(np.int32)), lists(v, o), sketch], names=["key", "set", "n", "sh", "sketch"])


def shingled(df: DataFrame, key: Column | str, text: Column | str, k: int, min_words: int) -> DataFrame:
    """``key, set, n, sh, sketch``: per record its set's 128-bit hash, size and sorted shingle hashes."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).cast("string").alias("key"), col(text).alias("text")).where("key is not null and text is not null")
    rows = rows.groupBy("key").agg(F.min("text").alias("text")).select("key", word_hashes("text").alias("w")).where(F.size("w") >= max(1, min_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield signed(b.column(0), *shingle_sets(*flat(b.column(1)), k))

    return rows.mapInArrow(run, f"key string, {SET}")


def _counter(v: np.ndarray, counters: int) -> np.ndarray:
    return (mix(v.view(np.uint64)) % np.uint64(counters)).astype(np.int64)


def list_lengths(rows: DataFrame) -> np.ndarray:
    """``COUNTERS`` numbers: occurrences of the shingles hashed to each, over all rows."""

    size = COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            n += np.bincount(_counter(flat(b.column(0))[0], size), minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["at", "n"])

    # Not more rows than counters, whatever the size of the collection.
    t = rows.select("sh").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int32)
    out[t.column("at").to_numpy()] = np.minimum(t.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def _required(n: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles that two sets of together ``n`` must share at least."""
    t = threshold - 1e-9
    return np.ceil(t / (1 + t) * n - 1e-9).astype(np.int64)


def _hits(n: np.ndarray) -> np.ndarray:
    """The cut-off ``c`` of a pair whose smaller set has ``n`` shingles."""
    return np.ceil(n * HITS).astype(np.int64)


def divide(sets: DataFrame, sent: Broadcast, threshold: float) -> DataFrame:
    """``set, n, sketch, ranked, n_short, crowded``: the lists of every set in the global order,
    none where it can have no partner, and how many of them are short for any partner.

    ``crowded`` are those of the short part whose counter is over ``CELL``: no other list can
    be that long.
    """
    cell = CELL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy().astype(np.int64)
            v, o = flat(b.column(2))
            length = sent.value[_counter(v, len(sent.value))]
            row = np.repeat(np.arange(len(n)), np.diff(o))
            shared = length > 1  # a counter of one is one shingle of one set
            v, length, row = v[shared].view(np.int64), length[shared], row[shared]
            by_length = np.lexsort((v, length, row))
            kept = np.bincount(row, minlength=len(n))
            need = np.ceil(threshold * n - 1e-9).astype(np.int64)
            first = np.cumsum(kept) - kept
            ok = kept >= need
            n_short = np.where(ok, kept - need + _hits(n), 0)
            v, length = v[by_length], length[by_length]
            at = np.arange(len(v)) - first[row]
            part = lambda m: lists(v[m].view(np.uint64), np.concatenate(([0], np.cumsum(np.bincount(row[m], minlength=len(n))))))  # noqa: E731, B023
            crowded = part((at < n_short[row]) & (length > cell))
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), part(ok[row]), pa.array(n_short.astype(np.int32)), crowded], names=["set", "n", "sketch", "ranked", "n_short", "crowded"])

    return sets.select("set", "n", "sh", "sketch").mapInArrow(run, "set struct<a:bigint,b:bigint>, n int, sketch binary, ranked array<bigint>, n_short int, crowded array<bigint>")


def _meet(threshold: float):
    """Merges short lists: pairs of postings of one cell that pass all bounds, with their count."""
    share = threshold / (1 + threshold)

    def counted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Meetings of equal pairs are runs once both ids are sorted; ``n`` is the smaller size."""
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, dtype=np.int64)
        return pa.record_batch([pa.array(x[new]), pa.array(y[new]), pa.array(np.diff(np.append(new, len(x))).astype(np.int32)), pa.array(n[new])], names=["sid_x", "sid_y", "met", "n"])

    def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        tok, i, j, n, left, sid, block = (t.column(c).to_numpy() for c in ("t", "i", "j", "n", "left", "sid", "block"))
        narrow, upper = _unpack(t.column("sketch").chunk(0))
        halves = narrow[:, : LANES // 2], narrow[:, LANES // 2 :]
        lower = narrow ^ upper
        plain = not (i != j).any()
        new = np.ones(len(tok), dtype=np.int64)
        new[1:] = (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.cumsum(new)
        order = group * (1 << 32) + n
        # Rows of a cell lie in order of size, so partners within the size bound follow closely.
        # A partner so large that this list is a long one of the pair is out of bounds, too.
        reach = _hits(n) + left - 1
        bound = np.minimum(n / threshold, (reach + 1e-6) / share - n) + 1e-6
        last = np.searchsorted(order, group * (1 << 32) + np.maximum(np.floor(bound), 0).astype(np.int64), side="right")
        count = np.maximum(last - np.arange(len(tok)) - 1, 0)
        # Bit counts fit into 32 bits, and so do sizes.
        n, left, reach = n.astype(np.int32), left.astype(np.int32), reach.astype(np.int32)
        spare = _hits(n).astype(np.int32) - 1
        ends = np.cumsum(count)
        lo = 0
        while lo < len(tok):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            c = count[lo:hi]
            x = np.repeat(np.arange(lo, hi, dtype=np.int32), c)
            y = np.arange(len(x), dtype=np.int32)
            y += np.repeat((np.arange(lo + 1, hi + 1) - np.cumsum(c) + c).astype(np.int32), c)
            if not plain:
                ok = (i[x] == j[x]) | (block[x] != block[y])
                x, y = x[ok], y[ok]
            both_n = n.take(x) + n.take(y)
            need = _required(both_n, threshold).astype(np.int32)
            # The list must be a short one of both records.
            ok = np.flatnonzero((left.take(y) + spare.take(x) >= need) & (reach.take(x) >= need))
            x, y, need, both_n = x.take(ok), y.take(ok), need.take(ok), both_n.take(ok)
            # Allowed difference in bits, less what the halves looked at so far differ in.
            room = both_n - 2 * need
            for half in halves:
                room -= np.bitwise_count(half.take(x, axis=0) ^ half.take(y, axis=0)).sum(axis=1, dtype=np.int32)
                ok = np.flatnonzero(room >= 0)
                x, y, room = x.take(ok), y.take(ok), room.take(ok)
            both = np.flatnonzero((n.take(x) > LONG) & (n.take(y) > LONG))
            if len(both):
                u, v = x.take(both), y.take(both)
                differ = sum(np.bitwise_count(w.take(u, axis=0) ^ w.take(v, axis=0)).sum(axis=1, dtype=np.int32) for w in (lower, upper))
                ok = np.ones(len(x), dtype=bool)
                both_n = n.take(u) + n.take(v)
                ok[both] = differ <= both_n - 2 * _required(both_n, threshold)
                x, y = x[ok], y[ok]
            if len(x):
                a, b = sid[x], sid[y]
                yield np.minimum(a, b), np.maximum(a, b), np.minimum(n[x], n[y])
            lo = hi

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole cells."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t, i, j = (b.column(c).to_numpy() for c in ("t", "i", "j"))
            edge = np.flatnonzero((t != t[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0
            if held:
                h = held[0]
                same = all(h.column(c)[0].as_py() == x[0] for c, x in (("t", t), ("i", i), ("j", j)))
                if cut or not same:  # else the cell goes on
                    held.append(b.slice(0, cut))
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
            elif cut:
                yield pa.Table.from_batches([b.slice(0, cut)]).combine_chunks()
            held.append(b.slice(cut))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in cells(batches):
            if not t.num_rows:
                continue
            for p in pairs(t):
                held.append(p)
                n += len(p[0])
                if n > COUNTED:
                    yield counted(*(np.concatenate(c) for c in zip(*held)))
                    held, n = [], 0
        if held:
            yield counted(*(np.concatenate(c) for c in zip(*held)))

    return run


def _slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.ListArray:
    ends = np.cumsum(size)
    return lists(values[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))], np.concatenate(([0], ends)))


def similar_sets(sets: DataFrame, sent: Broadcast, threshold: float) -> DataFrame:
    """``a, b, similarity`` of all pairs ``a < b`` of the divided sets."""
    posting = sets.select("sid", "n", "sketch", F.size("ranked").alias("k"), F.posexplode(F.slice("ranked", 1, F.col("n_short"))).alias("at", "t"))
    posting = posting.select("sid", "n", "sketch", (F.col("k") - F.col("at")).alias("left"), "t")
    # Lists over CELL long are cut into blocks, and every two blocks meet in one cell.
    long = cut_lineage(sets.select(F.explode("crowded").alias("t")).groupBy("t").agg(F.count("*").alias("len")).where(F.col("len") > CELL).select("t", F.ceil(F.col("len") / CELL).cast("int").alias("m")))
    n_long = long.count()
    if n_long:
        posting = posting.join(F.broadcast(long) if n_long <= MOST_SENT else long.hint("merge"), "t", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        posting = posting.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    else:
        posting = posting.withColumns({"block": F.lit(0), "other": F.lit(0)})
    cells = posting.select("t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "left", "sid", "block", "sketch")
    cells = cells.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "n")
    met = cells.mapInArrow(_meet(threshold), "sid_x bigint, sid_y bigint, met int, n int").groupBy("sid_x", "sid_y").agg(F.sum("met").cast("int").alias("met"), F.first("n").alias("n"))
    met = met.where(F.col("met") >= F.ceil(F.col("n") * HITS)).drop("n")
    side = lambda s: sets.select(F.col("sid").alias(f"sid_{s}"), F.col("n").alias(f"n_{s}"), F.col("ranked").alias(f"ranked_{s}"))
    both = met.join(side("x").hint("merge"), "sid_x").join(side("y").hint("merge"), "sid_y")
    both = both.select("sid_x", "sid_y", "met", "n_x", "n_y", "ranked_x", "ranked_y")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            met, n_x, n_y = (b.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
            (vx, ox), (vy, oy) = flat(b.column(5)), flat(b.column(6))
            # Lists of either record that are long for this pair.
            long = _required(n_x + n_y, threshold) - _hits(np.minimum(n_x, n_y))
            ex, ey = vx[ox[1:] - long - 1], vy[oy[1:] - long - 1]
            lx, ly = (sent.value[_counter(e, len(sent.value))] for e in (ex, ey))
            # The record whose short part ends first is probed with; all that it has beyond is in its long lists.
            x_first = (lx < ly) | (lx == ly) & (ex.view(np.int64) <= ey.view(np.int64))
            v, ends = np.concatenate((vx, vy)), (ox[1:], len(vx) + oy[1:])
            probing = _slices(v, np.where(x_first, *ends) - long, long)
            whole = np.where(x_first, np.diff(oy), np.diff(ox))
            common = met + overlaps(probing, _slices(v, np.where(x_first, *ends[::-1]) - whole, whole), sort=True)
            sim = common / np.maximum(n_x + n_y - common, 1)
            keep = pa.array(sim >= threshold - 1e-9)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(sim).filter(keep)], names=["a", "b", "similarity"])

    return both.mapInArrow(probe, "a bigint, b bigint, similarity double")


def link_sets(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``members (key, sid)`` and ``links (a, b, similarity)`` of the written table of signed sets."""
    sent = rows.sparkSession.sparkContext.broadcast(list_lengths(rows))
    sets = divide(rows.groupBy("set").agg(*(F.first(c).alias(c) for c in ("n", "sh", "sketch"))), sent, threshold)
    # A written id is eight bytes wide in every posting, and can't collide.
    sets = cut_lineage(sets.withColumn("sid", F.monotonically_increasing_id()))
    members = cut_lineage(rows.select("key", "set").join(sets.select("set", "sid").hint("merge"), "set").select("key", "sid"))
    release(rows)
    return members, similar_sets(sets.drop("set"), sent, threshold)


def near_records(df: DataFrame, key: Column | str, text: Column | str, k: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``members (key, sid)`` and ``links (a, b, similarity)`` between set ids."""
    return link_sets(cut_lineage(shingled(df, key, text, k, min_words)), threshold)


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``a < b``: the links as pairs of record keys, exact copies included."""
    x, y = members.select(F.col("key").alias("p"), F.col("sid").alias("a")), members.select(F.col("key").alias("q"), F.col("sid").alias("b"))
    across = links.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("p", "q")
    copies = members.join(members.groupBy("sid").count().where("count > 1").select("sid").hint("merge"), "sid", "left_semi")
    twins = copies.select("sid", F.col("key").alias("p")).join(copies.select("sid", F.col("key").alias("q")).hint("merge"), "sid").where("p < q").select("p", "q")
    return across.unionByName(twins).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, group_key, n_links``: one row per record with its group and its links.

    ``group_key`` is the smallest key of the group; ``n_links`` counts all
    partners, copies included, without expanding them into pairs.
    """
    links = cut_lineage(links.select("a", "b"))
    size = cut_lineage(members.groupBy("sid").agg(F.count("*").alias("copies"), F.min("key").alias("first_key")))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = ends.join(size.select(F.col("sid").alias("b"), "copies").hint("merge"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("copies").alias("others"))
    comp = components(links)
    nodes = size.join(comp.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = nodes.groupBy("component").agg(F.min("first_key").alias("group_key"))
    per_set = nodes.join(named.hint("merge"), "component").join(partners.hint("merge"), "sid", "left")
    per_set = per_set.select("sid", "group_key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(per_set.hint("merge"), "sid").select("key", "group_key", "n_links")
