"""Exact cosine nearest neighbours for many queries at once.

The queries are a matrix that is sent to every task, in as few parts as keep it
under ``SENT`` bytes, so the searched table is scanned once for any number of
queries that fits.  A task multiplies its rows with blocks of the matrix and
keeps only the ``k`` best rows per query, found by partitioning, not sorting, so
what is shuffled is at most ``tasks x queries x k`` rows, whatever the size of the
searched table.

Edge cases: null or zero vectors, and vectors of another length than the
query's, are no neighbours; ties go to the smaller id; a query without
neighbours gives no rows; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, BLOCK, WEAK = 15, 1024, 1.2
#: Bytes of query vectors sent to the tasks at once; more queries mean another scan.
SENT = 64 << 20
#: Rows multiplied with a block of queries in one product.
ROWS = 2048
#: Most rows of found neighbours that are sent to the tasks to fetch their texts.
MOST_FOUND = 200_000


def dot(a: Column | str, b: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two array columns; null where a length differs or a norm is 0."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((norms > 0) & (F.size(a) == F.size(b)), dot(a, b) / norms)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors, and their row numbers."""
    ok = np.array([v is not None and len(v) == dim and None not in v for v in vectors.to_pylist()], dtype=bool) if vectors.null_count or vectors.values.null_count else np.diff(vectors.offsets.to_numpy()) == dim
    rows = np.flatnonzero(ok)
    m = np.array(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), dim)
    norm = np.sqrt((m * m).sum(axis=1))
    return m[norm > 0] / norm[norm > 0, None], rows[norm > 0]


class _Top:
    """The ``k`` best rows of every query of one length, over all batches of a task."""

    def __init__(self, ids: np.ndarray, collections: list[str | None], vectors: np.ndarray, k: int) -> None:
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        ok = norm > 0
        self.ids, self.unit = ids[ok], vectors[ok] / norm[ok, None]
        names = [c for c, u in zip(collections, ok) if u]
        self.code = {c: j for j, c in enumerate(sorted({c for c in names if c is not None}))}
        self.wanted = np.array([-1 if c is None else self.code[c] for c in names], dtype=np.int64)
        self.names, self.k = names, k
        self.dist = np.full((len(names), k), np.inf)
        self.row = np.full((len(names), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, block: int) -> None:
        for lo in range(0, len(self.ids), block):
            part = slice(lo, lo + block)
            d = np.round(1 - self.unit[part] @ rows.T, 12)
            wanted = self.wanted[part]
            if (wanted >= 0).any():
                d[(wanted[:, None] >= 0) & (wanted[:, None] != codes[None, :])] = np.inf
            bound = self.dist[part, -1]
            if d.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            q, r = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
            if not len(q):
                continue
            # Old and new candidates in one order: query, distance, id.
            n = len(wanted)
            qs = np.concatenate([np.repeat(np.arange(n), self.k), q])
            ds = np.concatenate([self.dist[part].ravel(), d[q, r]])
            rs = np.concatenate([self.row[part].ravel(), ids[r]])
            order = np.lexsort((rs, ds, qs))
            qs = qs[order]
            first = np.searchsorted(qs, np.arange(n))
            take = order[first[:, None] + np.arange(self.k)]
            self.dist[part], self.row[part] = ds[take], rs[take]

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.dist))
        names = pa.array(self.names, pa.string()).take(pa.array(q))
        return pa.record_batch([pa.array(self.ids[q]), names, pa.array(self.row[q, j]), pa.array(self.dist[q, j])], names=["query_id", "collection", "row_id", "distance"])


def nearest(queries: DataFrame, rows: DataFrame, k: int = K, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """The ``k`` nearest ``rows`` of each query within the query's collection.

    ``queries``: ``query_id, collection, vector``; ``rows``: ``row_id, collection,
    vector``; ids are integers, a null collection of a query stands for all rows.
    ``queries`` is read twice, so write it first if it is costly.
    Result: ``query_id, collection, row_id, distance, rank`` (from 1).
    """
    spark = rows.sparkSession
    q = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("collection").cast("string").alias("collection"), F.col("vector").cast("array<double>").alias("vector"))
    n, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, collection string, row_id bigint, distance double, rank int")
    parts = max(1, -(-n * max(1, width) * 8 // sent))
    slim = rows.where("row_id is not null and vector is not null").select(F.col("row_id").cast("bigint"), F.col("collection").cast("string"), F.col("vector").cast("array<double>"))
    best = None
    for p in range(parts):
        part = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        t = part.toArrow().combine_chunks()
        groups = {}
        size = np.array([len(v) if v is not None and None not in v else -1 for v in t.column("vector").to_pylist()])
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            own = t.take(pa.array(at))
            groups[dim] = (own.column("query_id").to_numpy().astype(np.int64), own.column("collection").to_pylist(), np.array(own.column("vector").to_pylist(), dtype=np.float64).reshape(len(at), dim))
        held = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tops = {dim: _Top(*g, k) for dim, g in held.value.items()}
            for b in batches:
                names = b.column(1).dictionary_encode()
                for dim, top in tops.items():
                    code = np.array([top.code.get(c, -2) for c in names.dictionary.to_pylist()] + [-2], dtype=np.int64)
                    codes = code[names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)]
                    for lo in range(0, b.num_rows, ROWS):
                        m, at = _matrix(b.column(2).slice(lo, ROWS), dim)
                        if len(at):
                            top.add(m, b.column(0).to_numpy()[lo + at], codes[lo + at], block)
            for top in tops.values():
                yield top.found()

        found = slim.mapInArrow(run, "query_id bigint, collection string, row_id bigint, distance double")
        best = found if best is None else best.unionByName(found)
    w = Window.partitionBy("query_id", "collection").orderBy("distance", "row_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Names of the shared and the personal collections.
SHARED, PERSONAL = "policy_documents", "user_{}_documents"


def personal_collection(username: Column | str, personal: str = PERSONAL) -> Column:
    before, _, behind = personal.partition("{}")
    return F.concat(F.lit(before), username, F.lit(behind))


def scoped_collections(collection: Column, scope: Column, username: Column, shared: str = SHARED, personal: str = PERSONAL) -> Column:
    """Collections to search, in order: an explicit one, else by scope; unclear scopes are shared."""
    own = personal_collection(username, personal)
    known = username.isNotNull() & (username != "")
    return (
        F.when(collection.isNotNull() & (collection != ""), F.array(collection))
        .when((scope == "personal") & known, F.array(own))
        .when((scope == "combined") & known, F.array(F.lit(shared), own))
        .otherwise(F.array(F.lit(shared)))
    )


def legacy_collections(scope: Column, username: Column, shared: str = SHARED, personal: str = PERSONAL) -> Column:
    """The older dispatch: by scope alone, without a look at the user; null for an unknown scope."""
    own = personal_collection(F.coalesce(username, F.lit("None")), personal)
    return F.when(scope == "shared", F.array(F.lit(shared))).when(scope == "personal", F.array(own)).when(scope == "combined", F.array(F.lit(shared), own))


def unknown_scope(scope: Column) -> Column:
    """The error of a scope that the older dispatch doesn't know, else null."""
    return F.when(~F.coalesce(scope.isin("shared", "personal", "combined"), F.lit(False)), F.concat(F.lit("Unknown scope: "), F.coalesce(scope, F.lit("None"))))


def concatenated(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """Per query the lists of its ``collections`` one after the other, each of ``k``.

    Adds ``source_rank`` (place of the collection) and ``position`` (from 0) of the
    joined list: no new order, no deduplication, no common limit.
    """
    each = queries.select("query_id", "vector", F.posexplode("collections").alias("source_rank", "collection"))
    found = nearest(each.select("query_id", "collection", "vector"), rows, k)
    found = found.join(each.select("query_id", "collection", "source_rank"), ["query_id", "collection"])
    w = Window.partitionBy("query_id").orderBy("source_rank", "rank")
    return found.withColumn("position", F.row_number().over(w) - 1)


def weak_match(found: DataFrame, queries: DataFrame, threshold: float = WEAK) -> DataFrame:
    """``query_id, first_distance, is_weak``: strictly above the threshold; none found counts as 2."""
    first = found.where("rank = 1").groupBy("query_id").agg(F.min("distance").alias("d"))
    d = F.coalesce("d", F.lit(2.0))
    return queries.select("query_id").distinct().join(first, "query_id", "left").select("query_id", d.alias("first_distance"), (d > threshold).alias("is_weak"))


def weighted_rerank(found: DataFrame, text_weight: float = 0.7, heading_weight: float = 0.3) -> DataFrame:
    """Adds ``combined_score`` and ``new_rank`` to rows with ``text_similarity`` and
    ``heading_similarity``; equal scores keep the retrieval order, missing ones come last."""
    score = F.col("text_similarity") * text_weight + F.col("heading_similarity") * heading_weight
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("combined_score", 9)), "rank")
    return found.withColumn("combined_score", score).withColumn("new_rank", F.row_number().over(w))
