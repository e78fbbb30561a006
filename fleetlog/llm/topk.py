"""Exact top-k search by a three-phase uniform threshold.

Vectors are whole numbers; the score of two is their inner product. A score is the sum of parts, one for
each of ``PARTS`` runs of dimensions, and every (query, block of candidates) has a score list
for each part.

1. Every block gives, for each query, the k candidates at the head of each part's list, scored in full. The k-th best
   of all these is a lower bound of the k-th best score there is: a cutoff that is safe.
2. The cutoff goes to every block. A candidate that scores at least the cutoff has at least
   ``cutoff / PARTS`` in one of its parts, so each list gives its entries from there on and no others.
3. Only these are scored in full; of those that reach the cutoff a block returns its k best.

The last step puts at most k rows of each block in order for each query. Queries and candidates are
cut into blocks of bounded size by a hash; a block of queries meets a block of candidates in one
group. So a task holds two blocks, ties and copies of one vector stay in their blocks, and
nothing depends on how candidates are distributed.

Defined cases: vectors that are missing, or hold a missing or non-finite number, take no part,
nor do rows without an id. Shorter vectors count as filled up with 0. Rows that repeat an id are candidates (and queries) of
their own and fill places of their own, as in the SQL, but a query's own id is never its result. A query id has one list of k rows.
Numbers too large for exact double products are multiplied as Python integers; a score beyond 64 bits is cut to the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import stored

K = 10
SCALE = 1024
PARTS = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
_EXACT = float(1 << 53)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (id, v) that take part, components as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.col("v").isNotNull() & F.col("id").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(whole & finite)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles; shorter ones are filled up with 0."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exactly."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    bound = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(width, 1)
    if bound < _EXACT:
        return q @ x.T
    big = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return big(q) @ big(x).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _int64(scores: list) -> list[int]:
    return [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]


def _parts(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Query x candidate scores of each run of dimensions."""
    width = min(q.shape[1], x.shape[1])
    edges = np.linspace(0, width, PARTS + 1).astype(int)
    return [_products(q[:, a:b], x[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _first_lists(qid, q, cid, x, _cutoff, k):
    parts = _parts(q, x)
    total = sum(parts[1:], parts[0])
    for i in range(len(qid)):
        heads = [np.argpartition(-p[i].astype(float), min(k, len(cid) - 1))[: k + 1] for p in parts]
        at = np.unique(np.concatenate(heads))
        at = at[cid[at] != qid[i]]
        yield i, at[_best(total[i, at], cid[at], k)], total[i]


def _rest(qid, q, cid, x, cutoff, k):
    parts = _parts(q, x)
    total = None
    for i in range(len(qid)):
        low = cutoff[i]
        if low is None:
            at = np.arange(len(cid))
        else:
            at = np.flatnonzero(np.any([p[i] * PARTS >= low for p in parts], axis=0))
        at = at[cid[at] != qid[i]]
        score = sum(p[i, at] for p in parts[1:]) + parts[0][i, at]
        if low is not None:
            at, score = at[score >= low], score[score >= low]
        best = _best(score, cid[at], k)
        total = dict(zip(at[best].tolist(), score[best], strict=True))
        yield i, at[best], total


def _meet(queries: DataFrame, candidates: DataFrame, phase, k: int) -> DataFrame:
    """Run a phase on every pair of blocks: rows (query_id, vec_id, score)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            qid, cid = left["id"].to_numpy(), right["id"].to_numpy()
            q, x = _whole(_matrix(left["v"])), _whole(_matrix(right["v"]))
            cutoff = left["cutoff"].to_pylist() if "cutoff" in left.column_names else None
            for i, at, score in phase(qid, q, cid, x, cutoff, k):
                out["query_id"] += [int(qid[i])] * len(at)
                out["vec_id"] += cid[at].tolist()
                out["score"] += _int64([score[j] for j in at.tolist()])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(work, "query_id long, vec_id long, score long")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")


def _every(blocks: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # at most k rows of each block of candidates for each row of a query; repeated rows stay, so that blocks that gave k have k here
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """Rows query_id, rank, vec_id, score for the rows where ``is_query`` (a condition on ``id``) holds."""
    rows = usable(vectors, vec_id, vector)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    qs, cs = max(1, -(-counts.q // QUERY_BLOCK)), max(1, -(-counts.n // CANDIDATE_BLOCK))
    asked = rows.where(is_query)
    candidates = rows.select(F.col("id").alias("id"), F.col("v").alias("v"), _block(cs).alias("cb"), _every(qs, "qb"))  # columns of their own
    queries = asked.select("id", "v", _block(qs).alias("qb"), _every(cs, "cb"))
    heads = _ranked(_meet(queries, candidates, _first_lists, k), k)
    cutoffs = heads.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("cutoff"))
    cutoffs = stored(cutoffs, "cutoffs")
    informed = asked.join(cutoffs, F.col("id") == F.col("of"), "left").select("id", "v", "cutoff", _block(qs).alias("qb"), _every(cs, "cb"))
    return _ranked(_meet(informed, candidates, _rest, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
