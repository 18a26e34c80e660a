"""Exact top-k search by inner product of integer vectors (operator 12).

Query vectors go to the tasks in blocks of bounded size; each block is one pass over all candidates, which stay where they
are read. In a task, a batch of candidates meets the queries from coarse to fine: both sides are described by the means and
deviations of segments, and the product of two segments is at most length * (mean * mean + deviation * deviation), which is
the lower bound of their distance in another form. A pair whose bound is below the query's k-th score so far is discarded;
what survives the finest level is computed exactly in integers. A task returns its k best of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.llm.common import Scratch, read

K, STEP, SCALE = 5, 50, 256
#: Segments of a vector, coarse to fine.
LEVELS = (4, 16)
#: A block of queries, which is broadcast, holds about this many bytes; a batch of candidates this many rows.
QUERY_BYTES, ROWS = 16 << 20, 4096
#: Pairs that are gathered at once, and queries whose bounds are.
PAIRS, QUERIES = 1 << 18, 1024
#: Above this share of surviving pairs a block's next level is computed whole, by one matrix product.
DENSE = 0.01
LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "query_id long, query_key binary, vec_id long, score long"


def quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors of a list column and their components times SCALE, rounded down, in doubles (exact)."""
    at, out = [], []
    offsets, values = column.offsets.to_numpy(), column.values
    flat = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    null = column.is_null().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(~null & (bad[offsets[1:]] == bad[offsets[:-1]])):
        at.append(i)
        out.append(flat[offsets[i] : offsets[i + 1]])
    return np.array(at, dtype=np.int64), out


class Vectors:
    """Vectors of one length with the statistics of their segments."""

    def __init__(self, rows: np.ndarray):
        self.rows, d = rows, rows.shape[1]
        self.largest = float(np.abs(rows).max(initial=0.0))
        unit = self.largest or 1.0
        self.norms = np.sqrt(np.square(rows / unit).sum(axis=1)) * unit
        self.stats = []
        for n in LEVELS:
            if n >= d:
                break
            starts = np.unique(np.arange(n) * d // n)
            sizes = np.diff(np.append(starts, d)).astype(float)
            mean = np.add.reduceat(rows, starts, axis=1) / sizes
            spread = np.sqrt(np.add.reduceat(np.square(rows - np.repeat(mean, sizes.astype(int), axis=1)), starts, axis=1))
            self.stats.append(np.hstack([mean * np.sqrt(sizes), spread]))


def exact(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of rows; where doubles can't hold them, by Python's integers, cut to the range of a long."""
    if whole:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([min(LONG[1], max(LONG[0], sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for u, v in zip(a, b, strict=True)], dtype=np.int64)


class Best:
    """The k best (score, id) of each query; equal scores go to smaller ids, rows without id last."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.id, self.score, self.null = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        q, i, s, e = (np.concatenate(p) for p in ((self.query, query), (self.id, ids), (self.score, score), (self.null, null)))
        order = np.lexsort((i, e, ~s, q))  # ~s falls as s rises, without an overflow at the smallest long
        q, i, s, e = q[order], i[order], s[order], e[order]
        first = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - first[q]
        kept = place < self.k
        self.query, self.id, self.score, self.null = q[kept], i[kept], s[kept], e[kept]
        full = place == self.k - 1
        self.least[q[full]] = s[full]


def meet(queries: Vectors, query_ids: np.ndarray, best: Best, numbers: np.ndarray, cand: Vectors, ids: np.ndarray, null: np.ndarray) -> None:
    """Put the candidates among the best of the queries; numbers are the queries' places in best.

    Where many pairs of a block survive a level, the next one is computed for the block at once, else pair by pair.
    """
    whole = queries.rows.shape[1] * queries.largest * cand.largest < 2.0**53
    slack = 1e-9 * np.maximum(cand.norms.max(initial=0.0), 1.0)

    def keep(i: np.ndarray, j: np.ndarray, score: np.ndarray | None = None) -> None:
        own = (query_ids[i] != ids[j]) | null[j]
        i, j = i[own], j[own]
        score = exact(queries.rows[i], cand.rows[j], whole) if score is None else score[own].astype(np.int64)
        best.add(numbers[i], ids[j], score, null[j])

    for lo in range(0, len(query_ids), QUERIES):
        part = np.arange(lo, min(lo + QUERIES, len(query_ids)))
        margin = slack * np.maximum(queries.norms[part], 1.0)

        def bounds(level: int, part: np.ndarray = part) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                out = queries.stats[level][part] @ cand.stats[level].T
            return np.nan_to_num(out, copy=False, nan=np.inf, posinf=np.inf, neginf=np.inf)  # what overflows bounds nothing

        bound = bounds(0) if cand.stats else np.full((len(part), len(ids)), np.inf)
        fresh = np.flatnonzero(np.isneginf(best.least[numbers[part]]))
        alive = None
        if len(fresh):  # the largest bounds of a query that has no k rows yet give it a score to beat
            n = min(best.k + 1, len(ids))
            top = np.argpartition(bound[fresh], len(ids) - n, axis=1)[:, len(ids) - n :]
            keep(np.repeat(part[fresh], n), top.ravel())
            alive = np.ones(bound.shape, bool)
            alive[np.repeat(fresh, n), top.ravel()] = False  # counted already
        least = (best.least[numbers[part]] - margin)[:, None]
        alive = bound >= least if alive is None else alive & (bound >= least)
        left, level = np.count_nonzero(alive), 1
        while level < len(cand.stats) and left > DENSE * alive.size:
            alive &= bounds(level) >= least
            left, level = np.count_nonzero(alive), level + 1
        if whole and left > DENSE * alive.size:
            score = queries.rows[part] @ cand.rows.T
            alive &= score >= best.least[numbers[part]][:, None]
            flat = np.flatnonzero(alive)
            for at in range(0, len(flat), PAIRS):
                i, j = np.divmod(flat[at : at + PAIRS], len(ids))
                keep(part[i], j, score[i, j])
            continue
        flat = np.flatnonzero(alive)
        for at in range(0, len(flat), PAIRS):
            i, j = np.divmod(flat[at : at + PAIRS], len(ids))
            for q_stats, c_stats in zip(queries.stats[level:], cand.stats[level:], strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    finer = np.einsum("ij,ij->i", q_stats[part[i]], c_stats[j])
                ok = ~(finer < best.least[numbers[part[i]]] - margin[i])
                i, j = i[ok], j[ok]
            keep(part[i], j)


def _few(rows: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of some query: of equal vectors the first 2 k by id, k of each id.

    Whatever id a query leaves out as its own, k rows of the vector remain that come before all others.
    """
    _, kind = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True) if rows.shape[1] else (None, np.zeros(len(rows), np.int64))
    order = np.lexsort((ids, null, kind))

    def place(*keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
        starts = np.flatnonzero(new)
        return np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))

    order = order[place(kind, null, ids) < k]
    return order[place(kind) < 2 * k]


def searcher(block: "object", k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function of one pass; block: broadcast (query ids, keys, vectors as bytes)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, keys, packed = block.value
        by_size: dict[int, list[int]] = {}
        for n, v in enumerate(packed):
            by_size.setdefault(len(v) // 8, []).append(n)
        ready = {d: (np.array(ns), Vectors(np.frombuffer(b"".join(packed[n] for n in ns)).reshape(len(ns), d))) for d, ns in by_size.items()}
        best = Best(len(query_ids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                cut = batch.slice(lo, ROWS)
                at, vectors = quantised(pa.concat_arrays([cut.column("embedding")]))
                null = cut.column("vec_id").is_null().to_numpy(zero_copy_only=False)[at] if len(at) else np.empty(0, bool)
                ids = cut.column("vec_id").fill_null(LONG[1]).to_numpy(zero_copy_only=False)[at] if len(at) else np.empty(0, np.int64)
                sizes = np.array([len(v) for v in vectors])
                for d in np.unique(sizes):
                    if d not in ready:
                        continue
                    mine = np.flatnonzero(sizes == d)
                    rows = np.vstack([vectors[m] for m in mine]) + 0.0  # -0.0 becomes 0.0
                    few = _few(rows, ids[mine], null[mine], k)
                    numbers, queries = ready[d]
                    meet(queries, query_ids[numbers], best, numbers, Vectors(rows[few]), ids[mine][few], null[mine][few])
        for lo in range(0, len(best.query), 65_536):
            part = slice(lo, lo + 65_536)
            q = best.query[part]
            yield pa.record_batch({
                "query_id": pa.array(query_ids[q]), "query_key": pa.array([keys[n] for n in q], pa.binary()), "vec_id": pa.array(best.id[part], mask=best.null[part]), "score": pa.array(best.score[part]),
            })

    return search


def _as_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, vectors = quantised(pa.concat_arrays([batch.column("embedding")]))
        yield pa.record_batch({"query_id": batch.column("vec_id").take(pa.array(at)), "vec": pa.array([(v + 0.0).tobytes() for v in vectors], pa.binary())})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query among the candidates (vec_id, embedding).

    Components count as floor(256 * x). Vectors that are null or hold null or non-finite components take no part; a vector
    meets those of its own length, also of length 0 (score 0). A query never meets rows with its vec_id. Queries without
    vec_id aren't asked; candidates without one come last among equal scores. Every candidate row counts, repeated ones too;
    a query row that repeats another counts once, and rows of one vec_id with different vectors are queries of their own,
    each with ranks from 1. Scores beyond a long are cut to its range before they are ranked. Empty tables give an empty result; other columns are
    ignored. At most query_bytes of queries (and never less than one) are broadcast at once; each such block scans the
    candidates once more.
    """
    spark = candidates.sparkSession
    with Scratch(spark) as scratch:
        asked = queries.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(_as_queries, "query_id long, vec binary")
        asked = scratch.save(asked.withColumn("query_key", F.unhex(F.sha2("vec", 256))).dropDuplicates(["query_id", "query_key"]), "queries")
        n_bytes = asked.agg(F.sum(F.octet_length("vec") + 64)).first()[0] or 0
        n_blocks = max(1, -(-n_bytes // query_bytes))
        if n_blocks > 1:
            asked = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(n_blocks))).repartition("block"), "blocks")
        passes = []
        for b in range(n_blocks):
            got = (asked.where(F.col("block") == b) if n_blocks > 1 else asked).select("query_id", "query_key", "vec").toArrow()
            block = spark.sparkContext.broadcast((got["query_id"].to_numpy(), got["query_key"].to_pylist(), got["vec"].to_pylist()))
            found = candidates.select("vec_id", "embedding").where("embedding is not null").mapInArrow(searcher(block, k), FOUND)
            passes.append(scratch.save(found, f"pass-{b}"))
            block.destroy()
        found = passes[0]
        for p in passes[1:]:
            found = found.union(p)
        order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scratch.keep(best.select("query_id", "rank", "vec_id", "score"), "top")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores of each row of `embeddings` whose vec_id is divisible by 50, among all other rows."""
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % STEP == 0), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
