"""Approximate nearest neighbours: a forest of random-projection trees.

Fit, on a bounded sample (``SAMPLE`` distinct vectors of smallest keyed hash): every node of a
tree splits at the median projection on the difference of two random sample vectors. The
forest is broadcast; its size is bounded by ``TREES`` * 2^``MAX_DEPTH`` directions. Every
vector is indexed: equal vectors collapse into one entry with their smallest ids, and each
entry goes to its leaf in every tree.

Search: all trees share one priority queue, ordered by the largest margin crossed on the way;
leaves are taken until their entries reach the budget. The budget is measured, not guessed:
for ``PROBES`` sampled queries the true neighbours are found by brute force over all rows, and
the budget is the share of the index at which ``TARGET`` of them have been reached. Queries
and entries meet by (tree, leaf), large leaves in blocks; candidates are reranked by their
exact cosine on the original vectors in double precision, ties to the smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows with a null id or of another dimension than most. Repeated rows count once; a row
never finds rows of its own id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

TREES = 8
LEAF = 512  # entries aimed at in a leaf
MAX_DEPTH = 12
SAMPLE = 20_000
PROBES = 128
TARGET = 0.97
BLOCK = 4096  # entries of a leaf compared in one group


class Forest:
    """Per tree a complete binary tree: ``w`` directions, ``t`` thresholds in heap order."""

    def __init__(self, w: np.ndarray, t: np.ndarray, depth: int):
        self.w, self.t, self.depth = w, t, depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of unit vectors in every tree (rows x trees)."""
        out = np.zeros((len(x), len(self.w)), np.int64)
        for k in range(len(self.w)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.w[k][node]).sum(axis=1) > self.t[k][node])
            out[:, k] = node - (2**self.depth - 1)
        return out

    def visit(self, q: np.ndarray):
        """(tree, leaf) in the order of the shared queue."""
        margins = [w @ q - t for w, t in zip(self.w, self.t, strict=True)]
        queue = [(0.0, k, 0) for k in range(len(self.w))]
        inner = 2**self.depth - 1
        while queue:
            worst, k, node = heapq.heappop(queue)
            while node < inner:
                m = margins[k][node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(worst, abs(m)), k, 4 * node + 3 - near))
                node = near
            yield k, node - inner


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    n = 2**depth - 1
    w, t = np.zeros((trees, max(1, n), dims)), np.zeros((trees, max(1, n)))
    for k in range(trees):
        at = np.zeros(len(sample), np.int64)
        for node in range(n):
            own = np.flatnonzero(at == node)
            way = np.zeros(dims)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                way = sample[a] - sample[b]
            if np.linalg.norm(way) < 1e-9:
                way = rng.normal(size=dims)
            w[k, node] = way / np.linalg.norm(way)
            side = sample[own] @ w[k, node]
            t[k, node] = np.median(side) if len(own) else 0.0
            at[own] = 2 * node + 1 + (side > t[k, node])
    return Forest(w, t, depth)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(shared):
    def run(batches):
        forest = shared.value
        for b in batches:
            if b.num_rows:
                leaf = forest.leaves(_unit(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(leaf), pa.list_(pa.int64()))], names=["ids", "vector", "leaves"])

    return run


def _search(shared, sizes, budget: float):
    """Leaves of each query, in queue order, until the budget is spent."""
    def run(batches):
        forest, size = shared.value, sizes.value
        for b in batches:
            out = []
            for q in _unit(_matrix(b.column(1))) if b.num_rows else []:
                got, spent = [], 0
                for k, leaf in forest.visit(q):
                    n = size.get((k, leaf), 0)
                    if n:
                        got.append({"tree": k, "leaf": leaf})
                        spent += n
                        if spent >= budget:
                            break
                out.append(got)
            kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["query_id", "vector", "visits"])

    return run


def best(queries: np.ndarray, query_ids, vectors: np.ndarray, ids: list, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k best: exact cosines, ties to smaller ids.
    ``ids`` has the sorted ids of each vector."""
    out = []
    near = _unit(queries) @ _unit(vectors).T
    length = np.sqrt((vectors * vectors).sum(axis=1))
    take = min(k + 1, len(vectors))
    for q, own, row in zip(queries, query_ids, near, strict=True):
        edge = np.partition(row, len(row) - take)[len(row) - take] - 1e-9
        cand = np.flatnonzero(row >= edge)
        score = (vectors[cand] * q).sum(axis=1) / (length[cand] * np.sqrt((q * q).sum()))
        found = [(-s, i) for s, c in zip(score.tolist(), cand.tolist(), strict=True) for i in ids[c] if i != own]
        out += [(own, i, -s) for s, i in heapq.nsmallest(k, found)]
    return out


def _meet(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            vectors = np.stack(right["vector"].to_list()).astype(np.float64)
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                rows += best(np.stack(part["vector"].to_list()).astype(np.float64), part["query_id"].tolist(), vectors, right["ids"].tolist(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _brute(shared, k: int):
    """The best of each batch for the broadcast probes."""
    def run(batches):
        ids, vectors = shared.value
        for b in batches:
            if b.num_rows:
                rows = best(vectors, ids, _matrix(b.column(1)), b.column(0).to_pylist(), k)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                                 names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _budget(entries: DataFrame, queries: DataFrame, forest: Forest, sizes: dict, k: int) -> float:
    """Entries to visit so that TARGET of the probes' true neighbours are reached."""
    spark = entries.sparkSession
    probes = queries.orderBy(F.xxhash64("query_id", F.lit(3)), "query_id").limit(PROBES).collect()
    if not probes:
        return 0.0
    vectors = np.array([r.vector for r in probes], np.float64)
    shared = spark.sparkContext.broadcast(([r.query_id for r in probes], vectors))
    truth = _ranked(entries.select("ids", "vector").mapInArrow(_brute(shared, k), FOUND), k).select("query_id", "vec_id")
    homes = entries.select(F.explode("ids").alias("vec_id"), "leaves").join(truth, "vec_id").select("query_id", "leaves").collect()
    wanted: dict[int, list] = {}
    for r in homes:
        wanted.setdefault(r.query_id, []).append(r.leaves)
    costs = []
    for r, q in zip(probes, _unit(vectors), strict=True):
        left, spent = [dict(enumerate(x)) for x in wanted.get(r.query_id, [])], 0
        for tree, leaf in forest.visit(q):
            if not left:
                break
            spent += sizes.get((tree, leaf), 0)
            hit = [x for x in left if x[tree] == leaf]
            costs += [spent] * len(hit)
            left = [x for x in left if x[tree] != leaf]
    return float(np.quantile(costs, TARGET)) if costs else 0.0


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of every row that ``is_query`` (a
    condition on the id column) selects, against all rows."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and size(vector) > 0")
    # A null or non-finite component leaves the sum of absolute values null or non-finite.
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x))
    rows = rows.where((norm > 0) & (norm < float("inf")) & ~F.isnan(norm))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialise(rows.where(F.size("vector") == common[0].d).distinct(), "vectors")
    # One entry a distinct vector with its k + 1 smallest ids: enough for any query's k best.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(entries.select("ids", "vector"), "entries")
    queries = rows.where(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id")

    n = entries.count()
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(2, n / LEAF)))))
    sample = entries.orderBy(F.xxhash64("vector", F.lit(1)), "vector").limit(SAMPLE).select("vector")
    forest = grow(_unit(np.array([r.vector for r in sample.collect()], np.float64)), TREES, depth)
    shared = spark.sparkContext.broadcast(forest)
    indexed = materialise(entries.mapInArrow(_assign(shared), "ids array<long>, vector array<double>, leaves array<long>"), "indexed")
    homes = indexed.select("ids", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    counted = materialise(homes.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")), "leaves")
    sizes = {(r.tree, r.leaf): r.n for r in counted.collect()}  # at most TREES * 2^MAX_DEPTH
    budget = _budget(indexed, queries, forest, sizes, k)

    visits = queries.select("query_id", "vector").mapInArrow(
        _search(shared, spark.sparkContext.broadcast(sizes), budget), "query_id long, vector array<double>, visits array<struct<tree:int,leaf:long>>")
    blocks = counted.select("tree", "leaf", "n_blocks")
    asked = visits.select("query_id", "vector", F.inline("visits")).join(blocks, ["tree", "leaf"])
    asked = asked.withColumn("block", F.explode(F.expr("sequence(0, n_blocks - 1)"))).drop("n_blocks")
    held = homes.join(blocks, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vector"), F.col("n_blocks").cast("long")).cast("int")).drop("n_blocks")
    keys = ["tree", "leaf", "block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_meet(k), FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

