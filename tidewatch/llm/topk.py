"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Vectors are dealt to shards of bounded size by hash; a shard's ball tree is built once and written. Queries stream through the
trees: nodes are opened in descending order of the upper bound ``q.c + |q| r`` and the search ends when no bound can beat the current
k-th score. Shards are met in rounds of 1, 2, 4, ... for each query, beginning with a shard of its own; between rounds the best of all shards so
far give each query the k-th score from which the next round starts.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Vectors of a leaf and of a shard, and queries searched at once.
LEAF, SHARD, BLOCK = 64, 16_384, 1_024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    vectors: object
    ids: object
    rows: object
    centers: object
    radii: object
    spans: list[tuple[int, int, int, int]]
    least: list[int]


def build(vectors, ids, rows) -> Tree:
    """A ball tree over integer vectors; leaves hold LEAF vectors, or any number of equal ones, by ascending id."""
    import numpy as np

    x = vectors.astype(float)
    order = np.lexsort((rows, ids))
    centers, radii, spans, least = [], [], [], []
    todo, base = [(order, -1, False)], 0
    placed = []
    while todo:
        mine, parent, right = todo.pop()
        k = len(centers)
        center = x[mine].mean(axis=0)
        away = np.sqrt(((x[mine] - center) ** 2).sum(axis=1))
        centers.append(center)
        radii.append(float(away.max()))
        least.append(int(ids[mine].min()))
        if parent >= 0:
            a, b, left, r = spans[parent]
            spans[parent] = (a, b, left, k) if right else (a, b, k, r)
        far = x[mine[away.argmax()]]
        distance = ((x[mine] - far) ** 2).sum(axis=1)
        if len(mine) <= LEAF or not distance.any():
            spans.append((base, base + len(mine), -1, -1))
            placed.append(mine)
            base += len(mine)
            continue
        spans.append((0, 0, -1, -1))
        axis = x[mine[distance.argmax()]] - far
        side = np.argsort((x[mine] - far) @ axis, kind="stable")
        half = len(mine) // 2
        # ``mine`` is by ascending id, and so are both halves.
        todo += [(mine[np.sort(side[half:])], k, True), (mine[np.sort(side[:half])], k, False)]
    all_rows = np.concatenate(placed)
    return Tree(vectors[all_rows], ids[all_rows], rows[all_rows], np.array(centers), np.array(radii), spans, least)


def search(tree: Tree, queries, rows, floors, k: int):
    """For each query (its own row left out) the best k (score, id, row) of the tree that can still count: a score at its floor or above."""
    import numpy as np

    big = max(1, int(np.abs(tree.vectors).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, queries.shape[1])
    exact = float if big < 1 << 53 else np.int64 if big < 1 << 62 else object
    vectors, q = tree.vectors.astype(exact), queries.astype(exact)
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    bounds = queries.astype(float) @ tree.centers.T + norms[:, None] * tree.radii[None, :]
    bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * (tree.radii + np.sqrt((tree.centers**2).sum(axis=1)))[None, :] + 1)
    found = []
    for i in range(len(q)):
        best: list[tuple[int, int, int]] = []  # a heap with the worst on top: (score, -id, -row)
        floor, bound = floors[i], bounds[i]
        frontier = [(-bound[0], 0)]
        while frontier:
            upper, node = heapq.heappop(frontier)
            upper = -upper
            if len(best) == k and (upper < best[0][0] or upper < best[0][0] + 1 and tree.least[node] > -best[0][1]) or upper < floor:
                if upper < floor or upper < best[0][0]:
                    break
                continue
            a, b, left, right = tree.spans[node]
            if left >= 0:
                heapq.heappush(frontier, (-min(upper, bound[left]), left))
                heapq.heappush(frontier, (-min(upper, bound[right]), right))
                continue
            scores = vectors[a:b] @ q[i]
            bar = max(floor, best[0][0]) if len(best) == k else floor
            for j in np.flatnonzero(scores >= bar):
                row = int(tree.rows[a + j])
                item = (min(max(int(scores[j]), LEAST), MOST), -int(tree.ids[a + j]), -row)
                if row == rows[i]:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                elif item[0] == best[0][0] and tree.radii[node] == 0:
                    break  # equal vectors by ascending id: no later one counts
        found.append(best)
    return found


def quantized(embedding: Column) -> Column:
    """floor(1024 x) of each component; null for a vector that is null or holds a null or non-finite component."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~F.exists(doubles, bad), F.transform(doubles, lambda x: F.floor(x * 1024).cast("long")))


def matrix(table: pa.Table | pa.RecordBatch):
    """The vectors (column q) of rows of one dimension."""
    import numpy as np

    lists = table.column("q")
    flat = lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()
    return np.array(flat, np.int64).reshape(table.num_rows, -1)


def plant(vectors: pa.Table) -> pa.Table:
    """The tree of a shard, in a row; components take as few bytes as they need."""
    import numpy as np

    x = matrix(vectors)
    small = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or np.abs(x).max(initial=0) <= np.iinfo(t).max)
    tree = build(x, np.array(vectors.column("vec_id"), np.int64), np.array(vectors.column("uid"), np.int64))
    tree.vectors = tree.vectors.astype(small)
    key = [vectors.column(c).slice(0, 1) for c in ("dim", "shard")]
    return pa.table({"dim": key[0], "shard": key[1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


FOUND = "quid long, query_id long, vec_id long, uid long, score long"


def searched(trees: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The best k of each shard for the queries that want it: sorted partitions stream each tree and then its queries past the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key = tree = None
        for batch in batches:
            keys = np.stack([np.array(batch.column(c), np.int64) for c in ("dim", "shard", "kind")], axis=1)
            at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(at, at[1:], strict=False):
                if keys[lo, 2] == 0:
                    key, tree = tuple(keys[lo, :2]), pickle.loads(batch.column("tree")[lo].as_py())
                elif key == tuple(keys[lo, :2]):
                    for first in range(lo, hi, BLOCK):
                        part = batch.slice(first, min(BLOCK, hi - first))
                        names, mine = (np.array(part.column(c), np.int64) for c in ("vec_id", "uid"))
                        floors = [LEAST if f is None else f for f in part.column("floor").to_pylist()]
                        out = [(int(row), int(name), -i[1], -i[2], i[0]) for name, row, best in zip(names, mine, search(tree, matrix(part), mine, floors, k), strict=True) for i in best]
                        columns = list(zip(*out, strict=True)) if out else [[]] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    both = wanted.withColumn("kind", F.lit(1)).unionByName(trees.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``vectors`` (vec_id, q: array<long>) that is a query the best k other rows.

    Ties go to the smaller vec_id (of repeated rows, to the one read first). Vectors meet those of their own dimension only. Rows without
    id or vector take no part; a query's own row is no candidate, a copy of it is. Scores are held to 64 bits. An empty table, or one without queries,
    gives no rows; very long vectors are a dimension like others; other columns are left out, whatever their names.
    """
    rows = vectors.where("vec_id is not null and q is not null").select("vec_id", "q", F.size("q").alias("dim"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("uid"))
    rows = stored(rows, "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    trees = stored(rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(plant, "dim int, shard int, tree binary"), "trees")
    queries = stored(rows.where("is_query").select("uid", "vec_id", "q", "dim", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(shards)).alias("turn")), "queries")
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid"))
    best, done, step = None, 0, 1
    while done < shards:
        # The stated query set against all rows, a round of shards at a time.
        upto = min(shards, done + step)
        wanted = queries.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1)))).withColumn("shard", F.pmod(F.col("turn") + F.col("shard"), F.lit(shards)).cast("int"))
        if best is None:
            wanted = wanted.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = best.groupBy("quid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            wanted = wanted.join(floors, wanted["uid"] == floors["quid"], "left").drop("quid")
        found = searched(trees, wanted.drop("turn"), k)
        found = found if best is None else best.unionByName(found)
        best = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
        done, step = upto, 2 * step
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
