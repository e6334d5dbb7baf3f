"""Exact top-k by inner product with multi-resolution segment statistics.

Every vector is described at several resolutions by the means and deviations of
its equal segments.  From these follows a lower bound of the squared distance of
two vectors, sum of length * ((mean - mean')**2 + (deviation - deviation')**2),
and with both norms an upper bound of their inner product.  Bounds go from coarse to
fine, down to segments of about four components; only pairs that outlive the finest get their
exact integer product, those with the highest bounds first, so that the others have more to
outlive.

Vectors are turned before, by an orthogonal matrix, which leaves products as they are: the main
axes of a bounded sample (``SAMPLE`` rows by a hash of their ids) go, in their order, to the
directions that the coarse segments' means see, then to those of the finer ones.  So the
means hold as much of the vectors as any few numbers can.  How many pairs outlive the bounds depends on the
vectors: few where a few axes say most, nearly all where every axis says as much as any other.

Queries and vectors meet in a grid of cells, each with a block of queries of at most ``QUERY_BYTES``
and a part of the vectors, of which a task sees one batch at a time.  Nothing is collected or
broadcast but the matrix and two counts.  Each cell gives at most k rows for each query.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without an id.  Vectors of unlike lengths aren't compared.  Rows that
carry the query's id are the query's own.  Ties go to the smaller id.  Repeated
rows of a candidate are candidates each.  Rows that repeat a query's id are asked
each, and the id's answer is the k best of all their pairs, so that a candidate may
stand in it once for each of them.  An empty table has no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
#: Segment counts from coarse to fine, as shares of the components.
LEVELS = (1 / 64, 1 / 16, 1 / 4)
#: Rows that the turn is fitted on at most.
SAMPLE = 4096
#: Queries of one cell, and vectors of one cell, in bytes.
QUERY_BYTES = 32 << 20
VECTOR_BYTES = 64 << 20
#: Queries and vectors whose bounds are held at once.
QUERIES_AT_ONCE = 256
VECTORS_AT_ONCE = 4096


def levels(d: int) -> list[int]:
    return sorted({max(1, round(d * share)) for share in LEVELS})


def _starts(d: int, segments: int) -> np.ndarray:
    return np.arange(segments) * d // segments


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Root of length times mean, then of length times deviation, of each segment; products of two such rows sum
    up to the bound of the inner product."""
    starts = _starts(x.shape[1], segments)
    n = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
    mean = np.add.reduceat(x, starts, axis=1) / n
    spread = np.sqrt(np.maximum(0.0, np.add.reduceat(x * x, starts, axis=1) / n - mean * mean))
    return np.concatenate((mean * np.sqrt(n), spread * np.sqrt(n)), axis=1)


def turn(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix for rows like these: main axes in order go to what the segments' means of the coarsest level
    see, then of the next one, and the last to what none sees."""
    d = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    seen = []
    for segments in levels(d):
        ends = np.append(_starts(d, segments), d)
        seen += [(np.arange(d) >= a) & (np.arange(d) < b) for a, b in zip(ends, ends[1:], strict=False)]
    # one direction after the other, without those that the ones before span
    basis = np.zeros((d, 0))
    for v in [*np.array(seen, np.float64), *np.eye(d)]:
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        if (n := np.linalg.norm(v)) > 1e-6 and basis.shape[1] < d:
            basis = np.concatenate((basis, (v / n)[:, None]), axis=1)
    return axes[:, ::-1] @ basis.T


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of query number, score and candidate id."""
        hit = np.unique(q)
        if not len(hit):
            return
        q = np.concatenate((np.repeat(hit, self.k), q))
        score = np.concatenate((self.score[hit].ravel(), score))
        ids = np.concatenate((self.id[hit].ravel(), ids))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, hit)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.score[q[top], rank[top]] = score[top]
        self.id[q[top], rank[top]] = ids[top]


class Searcher:
    """Queries of one length with their statistics; counts what the bounds leave."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, matrix: np.ndarray | None = None):
        self.ids, self.x = ids, vectors.astype(np.float64)
        self.matrix = np.eye(vectors.shape[1]) if matrix is None else matrix
        self.levels = levels(vectors.shape[1])
        turned = self.x @ self.matrix
        self.stats = [statistics(turned, s).astype(np.float32) for s in self.levels]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.best = Best(len(ids), k)
        self.pairs = self.products = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), VECTORS_AT_ONCE):
            self._meet(ids[a : a + VECTORS_AT_ONCE], vectors[a : a + VECTORS_AT_ONCE])

    def _meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        turned = x @ self.matrix
        stats = [statistics(turned, s).astype(np.float32) for s in self.levels]
        norm = np.sqrt((x * x).sum(axis=1))
        for a in range(0, len(self.ids), QUERIES_AT_ONCE):
            self._block(np.arange(a, min(a + QUERIES_AT_ONCE, len(self.ids))), ids, x, norm, stats)

    def _block(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, stats: list[np.ndarray]) -> None:
        """Queries q and all these vectors; rows and columns without a living pair are left behind."""
        c = np.arange(len(ids))
        alive = self.ids[q, None] != ids[None, c]
        self.pairs += int(alive.sum())
        # |q|^2 + |x|^2 - 2 * bound is the lower bound of the squared distance, and with the k-th score in the place of the
        # bound the squared distance to be outlived; room for rounding
        for mine, theirs in zip(self.stats, stats, strict=True):
            least = self.best.score[q, -1] - 1e-3
            room = 2e-5 * self.norm[q][:, None] * norm[c][None, :]
            bound = mine[q] @ theirs[c].T + room.astype(np.float32)
            alive &= bound >= least[:, None]
            rows, columns = alive.any(axis=1), alive.any(axis=0)
            if not rows.any():
                return
            if rows.mean() < 0.8 or columns.mean() < 0.8:
                q, c, alive, bound = q[rows], c[columns], alive[np.ix_(rows, columns)], bound[np.ix_(rows, columns)]
        # the highest bounds first
        first = 4 * self.best.k
        if alive.shape[1] > 4 * first:
            bound[~alive] = -np.inf
            top = np.argpartition(-bound, first, axis=1)[:, :first]
            chosen = np.zeros_like(alive)
            np.put_along_axis(chosen, top, True, axis=1)
            self._exact(q, chosen & alive, c, ids, x)
            alive &= ~chosen & (bound >= self.best.score[q, -1][:, None] - 1e-3)
        self._exact(q, alive, c, ids, x)

    def _exact(self, q: np.ndarray, alive: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Integer products of the living pairs alone."""
        who, scores, found = [], [], []
        for k in np.flatnonzero(alive.any(axis=1)).tolist():
            own = c[alive[k]]
            self.products += len(own)
            score = x[own] @ self.x[q[k]]
            good = np.flatnonzero(score >= self.best.score[q[k], -1])
            who.append(np.full(len(good), q[k]))
            scores.append(score[good])
            found.append(ids[own[good]])
        if who:
            self.best.add(np.concatenate(who), np.concatenate(scores), np.concatenate(found))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.best.score))
        return self.ids[q], self.best.id[q, r], self.best.score[q, r].astype(np.int64)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, x): rows that take part, as doubles."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)


def _quantised(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(256 * x) of a list column, for each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def _turns(every: DataFrame) -> dict[int, np.ndarray]:
    """A matrix for each of the lengths in the sample; at most SAMPLE rows reach the driver."""
    seen = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    return {v.shape[1]: turn(v) for _, v in (_quantised(seen.column("x").combine_chunks()) if seen.num_rows else [])}


def search(vectors: DataFrame, is_query, *, key: str = "vec_id", column: str = "embedding", k: int = K, query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all rows for every row for which ``is_query`` (a Column over
    ``id``) holds."""
    every = usable(vectors, key, column)
    size = F.size("x") * 8 + 8
    n = every.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(is_query, size)), F.lit(0))).first()
    parts, blocks = max(every.sparkSession.sparkContext.defaultParallelism, -(-n[0] // vector_bytes)), max(1, -(-n[1] // query_bytes))
    sent = every.sparkSession.sparkContext.broadcast(_turns(every))
    up_to = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # rows are dealt by their places, so that equal ones are spread too
    every = every.withColumn("place", F.monotonically_increasing_id())
    dealt = F.xxhash64("place")
    queries = every.filter(is_query).select(F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), up_to(parts).alias("part"), F.lit(0).alias("role"), "id", "x")
    candidates = every.select(up_to(blocks).alias("block"), F.pmod(dealt, F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "id", "x")
    # within a cell queries come first
    cells = queries.unionByName(candidates).repartition(int(min(parts * blocks, 20_000)), "block", "part").sortWithinPartitions("block", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, own = None, [], None

        def made() -> Iterator[pa.RecordBatch]:
            for s in (own or {}).values():
                q, v, score = s.rows()
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(score, pa.int64())})

        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("block", "part", "role")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for a, end in zip(cuts, cuts[1:], strict=False):
                if a == end:
                    continue
                if at != tuple(place[:2, a]):
                    yield from made()
                    at, asked, own = tuple(place[:2, a]), [], None
                ids, x = b.column("id").slice(a, end - a).to_numpy(), b.column("x").slice(a, end - a)
                if place[2, a] == 0:
                    asked.append((ids, x))
                    continue
                if own is None:
                    own = {}
                    if asked:
                        ask_ids, ask_x = np.concatenate([i for i, _ in asked]), pa.concat_arrays([v for _, v in asked])
                        own = {v.shape[1]: Searcher(ask_ids[rows], v, k, sent.value.get(v.shape[1])) for rows, v in _quantised(ask_x)}
                        asked = []
                for rows, v in _quantised(x):
                    if v.shape[1] in own:
                        own[v.shape[1]].meet(ids[rows], v)
        yield from made()

    found = cells.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
