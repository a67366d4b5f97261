"""Approximate nearest neighbours: a forest of random-projection trees, then exact ranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import Sent, cut_lineage, subset

TREES = 8
#: Rows that a leaf should hold, and leaves that a query opens, over all trees together: so many, or this share of
#: all leaves if that is more, so that the searched share of the rows doesn't fall as the table grows.
LEAF_ROWS, LEAVES, LEAF_SHARE = 512, 160, 0.1
#: The trees are fitted on so many vectors at most, those whose ids hash lowest; every row is put into the leaves.
FIT_ROWS = 50_000
#: A leaf of many more rows than planned (copies of a vector, say) is dealt out in parts of so many.
PART_ROWS = 4096
SEED = 20


class Forest:
    """Trees over directions: each inner node halves the vectors it was fitted on.

    Node i of a tree has the children left[i] and right[i]; a negative child is the leaf ~child. A node's normal is
    the difference of two of its vectors at random, its bound the median of their projections.
    """

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.normals, self.bounds, self.left, self.right, self.leaves = [], [], [], [], []
        least = max(1, len(sample) // max(leaves, 1))
        for _ in range(trees):
            normals, bounds, left, right = [], [], [], []
            count = 0

            def grow(rows: np.ndarray) -> int:
                nonlocal count
                for _ in range(4 if len(rows) > least and len(rows) > 1 else 0):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    normal = (sample[rows[a]] - sample[rows[b]]).astype(np.float32)
                    along = sample[rows] @ normal
                    bound = np.float32(np.median(along))
                    below = along < bound
                    if below.any():
                        node = len(normals)
                        normals.append(normal)
                        bounds.append(bound)
                        left.append(0)
                        right.append(0)
                        left[node], right[node] = grow(rows[below]), grow(rows[~below])
                        return node
                count += 1
                return ~(count - 1)

            root = grow(np.arange(len(sample)))
            size = max(len(normals), 1)
            self.normals.append(np.array(normals, np.float32).reshape(len(normals), sample.shape[1]))
            self.bounds.append(np.array(bounds, np.float32))
            self.left.append(np.array(left if normals else [root] * size, np.int64))
            self.right.append(np.array(right if normals else [root] * size, np.int64))
            self.leaves.append(count)

    def leaf_of(self, tree: int, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector; all go down a level at a time."""
        at = np.zeros(len(vectors), np.int64)
        if not len(self.normals[tree]):
            return at
        going = np.arange(len(vectors))
        while len(going):
            node = at[going]
            along = np.einsum("ij,ij->i", vectors[going], self.normals[tree][node])
            at[going] = np.where(along < self.bounds[tree][node], self.left[tree][node], self.right[tree][node])
            going = going[at[going] >= 0]
        return ~at

    def open_leaves(self, vector: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The (tree, leaf) to look into: one queue over all trees, the branch that lies least far off first."""
        queue = [(0.0, tree, 0 if len(self.normals[tree]) else ~0) for tree in range(len(self.normals))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            off, tree, node = heapq.heappop(queue)
            while node >= 0:
                normal = self.normals[tree][node]
                margin = float(vector @ normal - self.bounds[tree][node]) / (float(np.sqrt(normal @ normal)) or 1.0)
                near, far = (self.left, self.right) if margin < 0 else (self.right, self.left)
                heapq.heappush(queue, (max(off, abs(margin)), tree, int(far[tree][node])))
                node = int(near[tree][node])
            found.append((tree, ~node))
        return found


def usable(vector: str) -> Column:
    """Neither null, empty or zero nor with a null or non-finite component."""
    numbers = F.col(vector).cast("array<double>")
    plain = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & plain & F.exists(numbers, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _directions(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, summed in one order wherever the rows stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(query_ids, queries, ids, vectors, k: int):
    """For each query its k best of the vectors: (query id, id, cosine) columns."""
    near = (queries / np.sqrt((queries * queries).sum(1, keepdims=True))) @ (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    if near.shape[1] > k:  # the product may be off by a few units in the last place, and copies tie
        worst = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        q, v = np.nonzero((near >= worst[:, None] - 1e-9) & (near > -np.inf))
    else:
        q, v = np.nonzero(near > -np.inf)
    score = cosines(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    kept = rank < k
    return query_ids[q[kept]], ids[v[kept]], score[kept]


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    leaves: int = LEAVES,
    fit_rows: int = FIT_ROWS,
    leaf_share: float = LEAF_SHARE,
) -> DataFrame:
    """For each row that `queries` holds for, the k nearest found of all other rows by cosine.

    A forest is fitted on a bounded sample and every row put into one leaf of each tree. A query opens the
    leaves that one priority queue over all trees gives. Rows and queries meet by leaf; there the cosines are
    exact, and each leaf passes on k for each query, of which the best remain. An overfull leaf is dealt
    out in parts and its queries with it, so no leaf has to fit in a task and no row is left out.

    Rows with a null key or a vector that is null, empty, zero, of another length than most, or holds null or
    non-finite numbers take no part. Ties go to the smaller key; repeated keys count once, at their nearest.
    With fewer than k others, all found are given. An empty table gives no rows. Other columns play no part.

    Returns query_id, rank (from 1), vec_id, score.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    session = rows.sparkSession
    kept = rows.select(
        F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector).alias("v")
    )
    # float components go as float; the cosines are taken in double.
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    kept = kept.where(F.col("id").isNotNull() & usable("v")).select("id", "asks", F.col("v").cast(kind).alias("v"))
    widths = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return session.createDataFrame([], schema)
    width, count = int(widths["width"]), int(widths["count"])
    kept = kept.where(F.size("v") == width)
    share = min(1.0, fit_rows / count)
    bound = min(int(-(2**63) + 2**64 * share), 2**63 - 1)
    sample = kept.where(F.xxhash64("id") <= F.lit(bound)).select("v").limit(2 * fit_rows).toArrow()["v"].combine_chunks()
    forest = Forest(_directions(_matrix(sample, width)), trees, max(1, count // leaf_rows))
    most = max(leaves, int(np.ceil(leaf_share * sum(forest.leaves))))
    held = Sent(session, forest)
    base = np.concatenate([[0], np.cumsum(forest.leaves)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = _directions(_matrix(part.column(1), width))
                for tree in range(len(forest.leaves)):
                    leaf = base[tree] + forest.leaf_of(tree, vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), part.column(0), part.column(1)], ["leaf", "id", "v"])

    placed = kept.select("id", "v").mapInArrow(place, f"leaf long, id long, v {kind}")
    # One number for each leaf, and fit_rows bounds the leaves.
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().where(F.col("count") > PART_ROWS).collect()}
    parts = session.sparkContext.broadcast({leaf: -(-n // PART_ROWS) for leaf, n in sizes.items()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, leaf, portion = [], [], []
                for i, direction in enumerate(_directions(_matrix(part.column(1), width))):
                    for tree, own in forest.open_leaves(direction, most):
                        place = int(base[tree]) + own
                        for p in range(parts.value.get(place, 1)):
                            row.append(i)
                            leaf.append(place)
                            portion.append(p)
                took = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), pa.array(portion, pa.int64()), part.column(0).take(took), part.column(1).take(took)],
                    ["leaf", "part", "id", "v"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leaf and part, in each the vectors before the queries."""
        mark, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part, asks, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            every = _matrix(batch.column(4), width)
            cuts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
            for begin, end in zip(cuts, [*cuts[1:], len(leaf)]):
                if mark != (leaf[begin], part[begin]):
                    mark, ids, vectors = (leaf[begin], part[begin]), [], []
                if not asks[begin]:
                    ids.append(own[begin:end])
                    vectors.append(every[begin:end])
                    continue
                if not ids:
                    continue
                against, known = np.concatenate(vectors), np.concatenate(ids)
                for at in range(begin, end, 256):
                    upto = min(end, at + 256)
                    columns = _best(own[at:upto], every[at:upto], known, against, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    portions = F.lit(1)
    if sizes:
        table = session.createDataFrame([(leaf, -(-n // PART_ROWS)) for leaf, n in sizes.items()], "leaf long, parts long")
        placed = placed.join(F.broadcast(table), "leaf", "left")
        portions = F.coalesce("parts", F.lit(1))
    stored = placed.select("leaf", F.pmod(F.xxhash64("id"), portions).cast("long").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = (
        kept.where("asks").select("id", "v").dropDuplicates(["id"])
        .mapInArrow(ask, f"leaf long, part long, id long, v {kind}")
        .select("leaf", "part", F.lit(True).alias("asks"), "id", "v")
    )
    met = stored.unionByName(asked).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks")
    found = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cut_lineage(
        once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
