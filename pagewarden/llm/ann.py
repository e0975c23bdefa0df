"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is filed in one leaf of each tree.  A query
keeps one priority queue over the nodes of all trees, ordered by the smallest margin that had to be
given up on the way, and opens leaves until they hold enough vectors.  In each opened leaf the
candidates are scored exactly, and the best of all leaves are ranked again on the original vectors,
summed in the order of the components in double precision.

For inner products the vectors are lifted: a last component makes all lengths equal to the largest,
so that the nearest lifted vectors are those with the largest inner product.

Copies of one vector are one class with its k + 1 smallest ids, which is all that a search for k
can return of them, so a vector of a third of all rows is one entry of a leaf.

Defined results: vectors that are null, zero, hold a null or a component that is not finite, or
differ in length from the most common length, take no part; repeated (id, vector) rows are one row;
fewer candidates than k are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_unit, scratch, small_batches

K = 20
TREES = 8
#: Documented bound of the sample on which the trees are fitted.
SAMPLE_ROWS = 20_000
#: Vectors in a leaf, about: a share of the index between these.
LEAST_LEAF, LEAF, LEAF_SHARE = 16, 1024, 1 / 64
#: Of the nearest vectors of TUNE_QUERIES vectors of the sample, within it, how many the search has to
#: find; this sets how many vectors a query looks at (a share of the index, counted in every tree).  In
#: the whole index the nearest are nearer than in the sample, and found with fewer.
RECALL, TUNE_QUERIES = 0.95, 64
#: Of the product of two lengths: by how much a product of matrices can be off.
_ROUNDING = 1e-12


class Forest:
    """Trees as arrays: a node n has children 2n + 1 and 2n + 2; the last level are leaves."""

    def __init__(self, planes: np.ndarray, cuts: np.ndarray, depth: int, top: float, sizes: np.ndarray):
        self.planes, self.cuts, self.depth, self.top, self.sizes = planes, cuts, depth, top, sizes

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        y = self.lift(x)
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = (y * self.planes[t][node]).sum(axis=1) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node
        return out

    def search(self, q: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold about ``enough`` vectors."""
        y = np.append(q * (self.top / max(np.linalg.norm(q), 1e-300)), 0.0)
        first, heap, found, held = 2**self.depth - 1, [], [], 0.0
        margin = self.planes @ y - self.cuts  # of all nodes of all trees at once
        for t in range(len(self.planes)):
            heap.append((0.0, t, 0))
        heapq.heapify(heap)
        while heap and held < enough:
            lost, t, node = heapq.heappop(heap)
            while node < first:
                m = margin[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (max(lost, abs(m)), t, far))
                node = near
            found.append((t, node))
            held += self.sizes[t, node - first]
        return found


def fit_forest(sample: np.ndarray, n: int, top: float, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Median splits along random directions; ``sizes`` are the expected numbers of the n vectors in each leaf."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) // 4)))))  # at least four of the sample in a leaf
    dim = sample.shape[1] + 1
    inner = 2**depth - 1
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, max(1, inner), dim)) / np.sqrt(dim)
    cuts = np.zeros((trees, max(1, inner)))
    sizes = np.zeros((trees, inner + 1))
    shell = Forest(planes, cuts, depth, top, sizes)
    y = shell.lift(sample)
    for t in range(trees):
        parts = [np.arange(len(y))]
        for node in range(inner):
            rows = parts[node]
            z = y[rows] @ planes[t, node]
            cuts[t, node] = np.median(z) if len(rows) else 0.0
            side = z > cuts[t, node]
            parts += [rows[~side], rows[side]]
        sizes[t] = [len(p) * n / max(1, len(y)) for p in parts[inner:]]
    return shell


def leaf_size(n: int) -> int:
    return int(min(LEAF, max(LEAST_LEAF, n * LEAF_SHARE)))


def tuned_share(forest: Forest, sample: np.ndarray, n: int, k: int = K, recall: float = RECALL, queries: int = TUNE_QUERIES) -> float:
    """The share of the n vectors that a query has to look at, by the sample: that many of its queries' nearest are in the leaves opened by then."""
    if len(sample) < 3:
        return float(len(forest.planes))
    leaves, first = forest.leaves(sample), 2**forest.depth - 1
    needed = []
    for i in range(min(queries, len(sample))):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 2))[: min(k, len(sample) - 1)]
        order = forest.search(sample[i], np.inf)
        before = np.cumsum([0.0, *(forest.sizes[t, node - first] for t, node in order)])
        opened = np.empty((len(forest.planes), first + 1))
        for held, (t, node) in zip(before, order, strict=False):
            opened[t, node - first] = held
        needed += [opened[np.arange(len(opened)), leaves[j] - first].min() for j in near]
    return (float(np.quantile(needed, recall)) + 1.0) / n


def best_of(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, exact product) of the m rows of x with the largest products, of equal ones the first, for each row of y.

    The product of the matrices only leaves out what cannot be among them.
    """
    rough = y @ x.T
    if m < len(x):
        last = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
        slack = _ROUNDING * np.linalg.norm(y, axis=1) * np.sqrt((x * x).sum(axis=1).max())
        q, c = np.nonzero(rough >= (last - 2 * slack)[:, None])
    else:
        q, c = np.divmod(np.arange(len(x) * len(y)), len(x))
    exact = np.concatenate([dots(x[c[k : k + 65536]], y[q[k : k + 65536]]) for k in range(0, len(q), 65536)] or [np.empty(0)])
    order = np.lexsort((c, -exact, q))
    q, c, exact = q[order], c[order], exact[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    keep = place < m
    return q[keep], c[keep], exact[keep]


def dots(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(np.broadcast_shapes(c.shape[:-1], q.shape[:-1]))
    for d in range(c.shape[-1]):
        out += c[..., d] * q[..., d]
    return out


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, without repeated rows; v holds floats if the column does, else doubles."""
    v = F.col(vector).cast("array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>")
    big = F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0)).distinct()


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int | None = None, least: int = 0, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each of queries(id, v) among vectors(id, v), not counting itself.

    A query looks at ``least`` vectors or a ``share`` of them, whichever is more; without a share, at what
    tuned_share says.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    same = W.partitionBy("v").orderBy("id")
    few = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)  # Spark limits the groups before it shuffles
    classes = scratch(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "ids", "v"), "classes")
    n, top = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    taken = classes.where(hash_unit(F.col("c"), F.lit("forest")) < min(1.0, SAMPLE_ROWS / n)).select("c", "v").collect()
    sample = np.array([r["v"] for r in sorted(taken)] or [classes.first()["v"]], np.float64)
    leaf = leaf or leaf_size(n)
    forest = fit_forest(sample, n, top, trees, leaf)
    enough = max(least, (tuned_share(forest, sample, n, k) if share is None else share) * n)
    shared = spark.sparkContext.broadcast(forest)  # trees x sample / 4 nodes at most
    # Where the sample allows no more leaves, a leaf is dealt over parts, so that no task's memory grows with the index.
    parts = max(1, int(np.ceil(n / 2**forest.depth / (4 * leaf))))

    @F.arrow_udf("array<bigint>")
    def file(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        leaves = shared.value.leaves(x) if len(x) else np.zeros((0, trees), np.int64)
        return pa.array((leaves * trees + np.arange(trees)).tolist(), pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def open_leaves(v: pa.Array) -> pa.Array:
        return pa.array([[node * trees + t for t, node in shared.value.search(np.array(q.as_py(), np.float64), enough)] for q in v], pa.list_(pa.int64()))

    filed = classes.select(F.lit(0).alias("kind"), "c", "v", F.explode(file.asNondeterministic()("v")).alias("leaf"))
    filed = filed.withColumn("leaf", F.col("leaf") * parts + F.pmod(F.xxhash64("c"), F.lit(parts)))
    asked = queries.repartition("id").select(F.lit(1).alias("kind"), F.col("id").alias("c"), "v", F.explode(open_leaves.asNondeterministic()("v")).alias("leaf"))
    if parts > 1:
        asked = asked.select("kind", "c", "v", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda p: F.col("leaf") * parts + p)).alias("leaf"))
    else:
        asked = asked.select("kind", "c", "v", "leaf")
    cells = filed.union(asked).repartition("leaf").sortWithinPartitions("leaf", "kind", "c")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_now, held, waiting = None, [], []

        def best() -> pa.RecordBatch | None:
            if not held or not waiting:
                return None
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            qs, y = np.concatenate([h[0] for h in waiting]), np.concatenate([h[1] for h in waiting])
            q, c, exact = best_of(x, y, k + 1)  # the rows of a leaf come in the order of their ids
            return pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(ids[c]), pa.array(exact)], ["q", "c", "score"])

        for batch in batches:
            leaf, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 0))
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            marks = leaf * 2 + kind
            starts = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else []
            for a, b in zip(starts, np.append(starts[1:], len(marks)), strict=True):
                if leaf[a] != leaf_now:
                    if (out := best()) is not None:
                        yield out
                    leaf_now, held, waiting = leaf[a], [], []
                (waiting if kind[a] else held).append((ids[a:b], x[a:b]))
                if kind[a] and sum(len(h[0]) for h in waiting) >= 512:  # a popular leaf: as many queries at a time
                    if (out := best()) is not None:
                        yield out
                    waiting = []
        if (out := best()) is not None:
            yield out

    scored = cells.mapInArrow(score, "q long, c long, score double")
    by_class = W.partitionBy("q").orderBy(F.desc("score"), "c")
    # The same class may come from several leaves, at most one row each tree.
    top_rows = scored.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= (k + 1) * trees).select("q", "c", "score").distinct()
    members = top_rows.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("q"))
    ranked = members.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
