"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

1. Equal vectors are one point: those that occur more than once are found by
   their content keys and keep one row, and beside it their smallest ids,
   which is all that any answer can name.
2. A coordinator tree over a bounded sample (``sample_rows`` vectors, those
   with the smallest keys) cuts space into regions. Every point goes to its
   region, and a region of many points is cut into shards by the points' keys.
   A region's ball is the mean of its sample and the largest distance of any
   of its points.
3. Each shard's tree is built once and stored. A node keeps a vantage point,
   the median distance to it and the range of distances on either side.
4. A query first searches the shards of its own region. Its k-th distance
   there then says which other regions it must visit: those whose ball, by the
   triangle inequality, may hold something nearer. Inside a tree the same rule
   prunes nodes. Bounds are multiplied by ``factor``: one is exact; larger
   factors prune more and lose some neighbours.

Trees are searched for a block of queries at once. Queries come in blocks of
``block_rows`` and are broadcast only up to ``BROADCAST_QUERIES`` visits, so a
task holds one shard and one block. Distances are computed once more in double
precision, summed in the order of the components, which gives the same bits
everywhere.

Defined cases: vectors that are null, zero or hold a null or a non-finite
component take no part; vectors of another length are never compared; rows
with a null id take no part; rows that share a query's id are its own and no
candidates; of other repeated ids every row counts; a query that occurs twice
is one query if the vectors are equal; with fewer than k candidates all are
returned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, stored

LEAF = 256
_SLACK = 1 + 1e-9  # rounding of bounds must not prune a tie
#: Query rows that may be broadcast (a vector each).
BROADCAST_QUERIES = 20_000
KEY = ["k1", "k2"]


class VPTree:
    """An exact tree over float64 rows; ``ids`` break ties, smaller first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.squares = np.einsum("ij,ij->i", self.rows, self.rows)
        #: leaves: [None, rows]; others: [point, near child, far child, split, ranges of near and far distances]
        self.nodes: list[list] = []
        random = np.random.default_rng(seed)
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = me
            if len(at) <= leaf:
                self.nodes.append([None, np.sort(at)])
                continue
            point = self.rows[at[random.integers(len(at))]]
            d = distances(self.rows[at], point)
            split = np.partition(d, len(d) // 2)[len(d) // 2]
            near = d < split
            if not near.any():
                split = np.nextafter(split, np.inf)
                near = d < split
            if near.all():  # all as far away: a sphere
                self.nodes.append([None, np.sort(at)])
                continue
            far = ~near
            self.nodes.append([point, -1, -1, split, d[near].min(), d[near].max(), d[far].min(), d[far].max()])
            todo += [(at[far], me, 2), (at[near], me, 1)]

    def state(self) -> tuple:
        """Plain values: classes travel to workers by value and can't be pickled there."""
        return self.ids, self.rows, self.squares, self.nodes

    @classmethod
    def of(cls, state: tuple) -> VPTree:
        tree = cls.__new__(cls)
        tree.ids, tree.rows, tree.squares, tree.nodes = state
        return tree

    def leaves(self) -> list[int]:
        return [n for n, node in enumerate(self.nodes) if node[0] is None]

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while todo:
            n, at = todo.pop()
            node = self.nodes[n]
            if node[0] is None:
                out[at] = n
                continue
            near = distances(rows[at], node[0]) < node[3]
            todo += [(node[1], at[near]), (node[2], at[~near])]
        return out

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, within: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (distances, rows) of its k nearest rows, ties to smaller ids; ``within``: known k-th distances."""
        limit = np.full(len(queries), np.inf) if within is None else within.astype(float).copy()
        best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in queries]
        if not len(self.ids):
            return best
        squares = np.einsum("ij,ij->i", queries, queries)
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            n, at, bound = todo.pop()
            fits = bound * factor <= limit[at] * _SLACK
            at = at[fits]
            if not len(at):
                continue
            node = self.nodes[n]
            if node[0] is None:
                self._leaf(node[1], at, queries, squares, limit, best, k)
                continue
            d = distances(queries[at], node[0])
            near, far = (np.maximum(np.maximum(low - d, d - high), 0.0) for low, high in ((node[4], node[5]), (node[6], node[7])))
            first = d < node[3]  # each half of the block sees its nearer side first
            todo += [(node[2], at[first], far[first]), (node[1], at[~first], near[~first]), (node[1], at[first], near[first]), (node[2], at[~first], far[~first])]
        return best

    def _leaf(self, rows, at, queries, squares, limit, best, k) -> None:
        about = self.squares[rows][None, :] + squares[at][:, None] - 2 * (queries[at] @ self.rows[rows].T)
        reach = limit[at] ** 2
        chosen = about <= (reach + 1e-9 * (self.squares[rows].max() + squares[at] + 1))[:, None]  # rounding may not lose a row
        for i in np.flatnonzero(chosen.any(axis=1)).tolist():
            q, mine = at[i], rows[chosen[i]]
            d = distances(self.rows[mine], queries[q])
            inside = d <= limit[q] * _SLACK
            d, mine = np.concatenate([best[q][0], d[inside]]), np.concatenate([best[q][1], mine[inside]])
            order = np.lexsort((mine, d))[:k]  # rows are in id order
            best[q] = (d[order], mine[order])
            if len(order) == k:
                limit[q] = min(limit[q], d[order[-1]])


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    difference = rows - query
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a component that is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def exact_distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each summed in the order of the components."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        step = rows[:, j] - query[j]
        total += step * step
    return np.sqrt(total)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


class Coordinator:
    """Regions of space for each length of vectors: a tree over a sample, whose leaves are the regions."""

    def __init__(self, samples: dict[int, np.ndarray], counts: dict[int, int], region_rows: int):
        self.trees: dict[int, VPTree] = {}
        self.centres: dict[tuple[int, int], np.ndarray] = {}
        for dim, rows in samples.items():
            regions = -(-counts[dim] // region_rows)
            tree = self.trees[dim] = VPTree(np.arange(len(rows)), rows, leaf=max(1, len(rows) // regions))
            for n in tree.leaves():
                self.centres[dim, n] = tree.rows[tree.nodes[n][1]].mean(axis=0)

    def state(self) -> tuple:
        return {dim: tree.state() for dim, tree in self.trees.items()}, self.centres

    @classmethod
    def of(cls, state: tuple) -> Coordinator:
        guide = cls.__new__(cls)
        guide.trees, guide.centres = {dim: VPTree.of(x) for dim, x in state[0].items()}, state[1]
        return guide

    def place(self, dim: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(region, distance to its centre) of each row; a length that the sample lacks is one region without a centre."""
        if dim not in self.trees:
            return np.zeros(len(rows), dtype=np.int64), np.full(len(rows), np.inf)
        regions, far = self.trees[dim].route(rows), np.zeros(len(rows))
        for n in np.unique(regions):
            mine = regions == n
            far[mine] = distances(rows[mine], self.centres[dim, n])
        return regions, far


def _placed(points: DataFrame, coordinator) -> DataFrame:
    """``points`` (..., v, dim) with region and far, its distance to the region's centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guide = Coordinator.of(coordinator.value)
        for rows in batches:
            rows = rows.reset_index(drop=True)
            region, far = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
            for dim, mine in rows.groupby("dim").indices.items():
                region[mine], far[mine] = guide.place(dim, _matrix(rows.v.to_numpy()[mine]))
            yield rows.assign(region=region, far=far)

    return points.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", region long, far double")


def _built(shards: DataFrame) -> DataFrame:
    """dim, region, part, tree: the pickled tree of each shard, with its points' keys and ids."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = VPTree(rows.id.to_numpy(), _matrix(rows.v))
        order = np.argsort(rows.id.to_numpy(), kind="stable")
        return pd.DataFrame([(*key, pickle.dumps((tree.state(), rows.k1.to_numpy()[order], rows.k2.to_numpy()[order]), protocol=5))], columns=["dim", "region", "part", "tree"])

    return shards.groupBy("dim", "region", "part").applyInPandas(build, "dim int, region long, part int, tree binary")


def _searched(index: DataFrame, visits: DataFrame, n_visits: int, k: int, factor: float, block_rows: int) -> DataFrame:
    """query_id, q1, q2, k1, k2, id, score: the k nearest points that each visit (dim, region, query, v, within) finds in each shard."""
    block = F.pmod(F.xxhash64("query_id", "q1", "q2"), F.greatest(F.ceil(F.count("*").over(Window.partitionBy("dim", "region")) / block_rows), F.lit(1)))
    blocks = visits.withColumn("block", block).groupBy("dim", "region", "block").agg(F.collect_list(F.struct("query_id", "q1", "q2", "v", "within")).alias("asked"))  # some block_rows each
    asked = index.join(F.broadcast(blocks) if n_visits <= BROADCAST_QUERIES else blocks, ["dim", "region"]).select("dim", "region", "part", "tree", "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            for dim, region, part, blob, queries in batch.itertuples(index=False):
                if last != (dim, region, part):
                    last, held = (dim, region, part), pickle.loads(blob)
                tree, k1, k2 = VPTree.of(held[0]), *held[1:]
                points, out = _matrix([q["v"] for q in queries]), []
                found = tree.search(points, k, factor, np.array([q["within"] for q in queries], dtype=float))
                for q, point, (_, rows) in zip(queries, points, found):
                    for row, score in zip(rows.tolist(), exact_distances(tree.rows[rows], point).tolist()):
                        out.append((q["query_id"], q["q1"], q["q2"], k1[row], k2[row], tree.ids[row], score))
                yield pd.DataFrame(out, columns=["query_id", "q1", "q2", "k1", "k2", "id", "score"])

    return asked.mapInPandas(run, "query_id long, q1 long, q2 long, k1 long, k2 long, id long, score double")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 16_384,
    block_rows: int = 2_048,
    sample_rows: int = 20_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query row, nearest first."""
    if factor < 1:
        raise ValueError("factor is at least 1")
    spark = vectors.sparkSession
    v = F.col(vector_col)
    good = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(7), v).alias("k2"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    good = stored(good, "vectors")
    # vectors that occur more than once, and the ids that an answer may name
    again = stored(good.groupBy(*KEY).agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "repeated")
    n_again = again.count()
    few = bounded(again, n_again)
    smallest = Window.partitionBy(*KEY).orderBy("member")
    members = good.join(few, KEY).groupBy(*KEY, F.col("id").alias("member")).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    members = stored(members.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1).drop("nth"), "members")
    marked = good.join(few, KEY, "left")
    point = ["id", "dim", *KEY]
    points = marked.where("first IS NULL").select(*point, "v")
    points = points.unionByName(marked.where("id = first").groupBy(*point).agg(F.first("v").alias("v")))
    # the coordinator: a bounded sample on the driver
    counts = {r.dim: r["count"] for r in good.groupBy("dim").count().collect()}
    samples: dict[int, list] = {}
    for r in good.select("v", "dim", *KEY).dropDuplicates(KEY).orderBy(*KEY).limit(sample_rows).select("v", "dim").collect():
        samples.setdefault(r.dim, []).append(r.v)
    per_core = -(-sum(counts.values()) // max(1, spark.sparkContext.defaultParallelism))
    region_rows = max(1, min(shard_rows, max(per_core, 1024)))
    guide = Coordinator({d: _matrix(x) for d, x in samples.items()}, counts, region_rows)
    coordinator = spark.sparkContext.broadcast(guide.state())  # plain values, since a broadcast is pickled by reference
    placed = stored(_placed(points, coordinator), "points")
    balls = {(r.dim, r.region): (r.radius, r.n) for r in placed.groupBy("dim", "region").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each leaf of the sample's trees
    parts = spark.createDataFrame([(d, n, -(-size // shard_rows)) for (d, n), (_, size) in balls.items()], "dim int, region long, parts int")
    shards = placed.join(F.broadcast(parts), ["dim", "region"]).withColumn("part", F.pmod("k1", "parts").cast("int"))
    index = stored(_built(shards.select(*point, "v", "region", "part")), "trees")
    # first the home region of each query, then all that its k-th distance does not rule out
    asked = good.where("asks").select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), "v", "dim").dropDuplicates(["query_id", "q1", "q2"])
    asked = stored(_placed(asked, coordinator).drop("far"), "queries")
    n_asked = asked.count()
    want = k + 1  # points: the query's own may be among them
    home = stored(_searched(index, asked.withColumn("within", F.lit(float("inf"))), n_asked, want, factor, block_rows), "home")
    by_query = Window.partitionBy("query_id", "q1", "q2").orderBy("score", "id")
    bound = home.withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") == want).select("query_id", "q1", "q2", F.col("score").alias("within"))
    bounded_queries = asked.join(bound, ["query_id", "q1", "q2"], "left").fillna(float("inf"), ["within"])
    shared = spark.sparkContext.broadcast(balls)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, regions = coordinator.value[1], {}
        for (d, n), (radius, _) in shared.value.items():
            regions.setdefault(d, []).append((n, centres.get((d, n)), radius))
        flat = {d: ([n for n, _, _ in x], None if x[0][1] is None else np.stack([c for _, c, _ in x]), np.array([r for _, _, r in x])) for d, x in regions.items()}
        for rows in batches:
            for _, q in rows.iterrows():
                names, middles, radii = flat[q.dim]
                if middles is None:
                    continue
                least = np.maximum(distances(middles, np.asarray(q.v, dtype=float)) - radii, 0.0)
                goes = [names[i] for i in np.flatnonzero(least * factor <= q.within * _SLACK) if names[i] != q.region]
                if goes:
                    yield pd.DataFrame({"query_id": q.query_id, "q1": q.q1, "q2": q.q2, "v": [q.v] * len(goes), "dim": q.dim, "region": goes, "within": q.within})

    kind = asked.schema["v"].dataType.simpleString()
    further = stored(bounded_queries.mapInPandas(visits, f"query_id long, q1 long, q2 long, v {kind}, dim int, region long, within double"), "visits")
    found = home.unionByName(_searched(index, further, further.count(), want, factor, block_rows))
    best = found.withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") <= want).drop("nth")
    named = best.join(bounded(members), KEY, "left").select("query_id", "q1", "q2", "score", F.coalesce("member", "id").alias("vec_id"), F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1)))).alias("_"))
    order = Window.partitionBy("query_id", "q1", "q2").orderBy("score", "vec_id")
    ranked = named.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
