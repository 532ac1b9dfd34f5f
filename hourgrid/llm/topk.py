"""Exact top-k search by inner product: a ball tree in every shard, branch and bound over its nodes.

A node bounds the inner product of every vector below it by q.c + |q| r.  Nodes are visited in the order of this
bound and left out where it is below the query's current kth score.  That score is shared: it starts from a
pilot sample that every query is held against first, and rises from node to node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Candidates that form one tree, and queries that meet it together.
SHARD_ROWS = 4096
QUERY_BLOCK = 4096
LEAF = 64
#: Rows of the pilot sample.
PILOT_ROWS = 1024
SCALE = 64


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exact: in doubles where all sums stay below 2**53, else in Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    out = a.astype(object) @ b.T.astype(object)
    return out.astype(np.int64)  # fails where a score does not fit a long


class BallTree:
    """Nodes are rows of ``span`` (first and last position in ``order``), ``center``, ``radius`` and ``child``."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        span, center, radius, child = [], [], [], []
        points = x.astype(np.float64)

        def build(a: int, b: int) -> int:
            at, mine = self.order[a:b], len(span)
            c = points[at].mean(0)
            span.append((a, b))
            center.append(c)
            radius.append(np.sqrt(np.square(points[at] - c).sum(1).max()))
            child.append(None)
            if b - a > LEAF:
                part = points[at]
                axis = int((part.max(0) - part.min(0)).argmax()) if part.shape[1] else 0
                if part.shape[1] and part[:, axis].max() > part[:, axis].min():
                    half = (b - a) // 2
                    self.order[a:b] = at[np.argpartition(part[:, axis], half)]
                    child[mine] = (build(a, a + half), build(a + half, b))
            return mine

        build(0, len(x))
        self.span, self.child = span, child
        self.center, self.radius = np.array(center), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of every query with every node, with room for rounding."""
        norm = np.sqrt(np.square(q.astype(np.float64)).sum(1))
        reach = np.sqrt(np.square(self.center).sum(1)) + self.radius
        return q.astype(np.float64) @ self.center.T + norm[:, None] * self.radius + 1e-9 * (1 + norm[:, None] * reach)


def search(q: np.ndarray, q_id: np.ndarray, kth: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the k best rows of x for each query, as far as they reach ``kth``.

    Rows with the query's own id take no part; ties go to the smaller id.
    """
    lowest = np.iinfo(np.int64).min
    best = np.full((len(q), k), lowest)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    kth = kth.copy()
    tree = BallTree(x)
    upper = tree.bounds(q)

    def visit(node: int, active: np.ndarray) -> None:
        active = active[upper[active, node] >= kth[active]]
        if not len(active):
            return
        if tree.child[node]:
            for c in sorted(tree.child[node], key=lambda c: -upper[active, c].mean()):
                visit(c, active)
            return
        at = tree.order[slice(*tree.span[node])]
        score = _product(q[active], x[at])
        score[q_id[active][:, None] == x_id[at]] = lowest
        hit = score.max(1) >= np.maximum(kth[active], lowest + 1)
        active, score = active[hit], score[hit]
        if not len(active):
            return
        score = np.concatenate([best[active], score], 1)
        ids = np.concatenate([best_id[active], np.broadcast_to(x_id[at], (len(active), len(at)))], 1)
        order = np.lexsort((ids, -np.maximum(score, lowest + 1)), axis=1)[:, :k]
        best[active] = np.take_along_axis(score, order, 1)
        best_id[active] = np.take_along_axis(ids, order, 1)
        kth[active] = np.maximum(kth[active], best[active, k - 1])

    visit(0, np.arange(len(q)))
    row, column = np.nonzero((best > lowest) & (best >= kth[:, None]))
    return row, best_id[row, column], best[row, column]


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(np.int64)


def quantised(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim): vectors of finite components only, each component x as floor(scale * x)."""
    whole = df.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return whole.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of every query (all, if there are fewer).

    Both tables have columns (vec_id, v, dim) as ``quantised`` gives them; a query meets the candidates of its own
    dimension but for those of its own vec_id.  Equal query rows are one query, and rows of one vec_id with
    different vectors are ranked apart; every candidate row counts, so a repeated one may hold several ranks.
    An empty table gives an empty result.
    """
    n_shards = max(1, -(-candidates.count() // SHARD_ROWS))
    queries = queries.distinct()
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    pilots: dict[int, list] = {}  # a bounded sample, by hash
    for row in candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).collect():
        pilots.setdefault(row["dim"], []).append((row["vec_id"], row["v"]))
    pilots = {d: (np.array([v for _, v in some], np.int64).reshape(len(some), d), np.array([i for i, _ in some], np.int64)) for d, some in pilots.items()}

    def first_scores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, dims = part.column("vec_id").to_numpy(), part.column("dim").to_numpy()
            kth = np.full(len(ids), np.iinfo(np.int64).min)
            for d in np.unique(dims):
                x, x_id = pilots.get(int(d), (np.zeros((0, int(d)), np.int64), np.zeros(0, np.int64)))
                at = np.flatnonzero(dims == d)
                if len(x) > k:
                    score = _product(_matrix(part.column("v").take(pa.array(at)), int(d)), x)
                    score[ids[at][:, None] == x_id] = np.iinfo(np.int64).min
                    kth[at] = -np.partition(-np.maximum(score, np.iinfo(np.int64).min + 1), k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kth)], [*part.schema.names, "kth"])

    seeded = queries.select(F.col("vec_id").cast("long"), F.col("v").cast("array<long>").alias("v"), "dim").mapInArrow(first_scores, "vec_id long, v array<long>, dim int, kth long")
    left = (candidates.select(F.col("vec_id").cast("long"), "v", "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    right = (seeded.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))))

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(some) or not len(asked):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "query", "vec_id", "score")})
        dim = some.column("dim")[0].as_py()
        q, q_id = _matrix(asked.column("v"), dim), asked.column("vec_id").to_numpy()
        row, ids, score = search(q, q_id, asked.column("kth").to_numpy(), _matrix(some.column("v"), dim), some.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": q_id[row], "query": asked.column("query").to_numpy()[row], "vec_id": ids, "score": score})

    by = ["dim", "shard", "block"]
    found = left.groupBy(*by).cogroup(right.withColumn("query", F.xxhash64("vec_id", "v")).groupBy(*by)).applyInArrow(meet, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
