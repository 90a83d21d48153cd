"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most SAMPLE distinct vectors (smallest hash) on the driver; every vector is then put in a leaf by
descending to the nearest centre. A query goes through the tree with a priority queue of centres and visits leaves best
bin first. How many is calibrated: for up to CALIBRATION queries the exact neighbours are found in one pass over all
vectors, and visits widen until the share of those neighbours in the visited leaves reaches the target. A query goes on
beyond that number while the leaves visited hold fewer vectors than it needs.

Scale. Equal vectors are one candidate with their k + 1 smallest ids (enough for any query), so a vector that a third of
the rows hold is one row. Leaves are cut in shards of SHARD vectors; a task holds one shard and streams the queries that
visit it. The tree that is broadcast has at most about SAMPLE / LEAF leaves.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, staged

K, EVERY = 5, 50
SAMPLE, LEAF, BRANCH = 20_000, 64, 8
CALIBRATION, RECALL = 256, 0.95
SHARD = 2048
#: The margin for the error of rough scores.
EDGE = 1e-9


@dataclass
class Tree:
    """Nodes in order of making; children of node i are first[i] .. first[i] + count[i] - 1; a node without is a leaf."""

    centers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    held: dict = field(default_factory=dict)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (unit vectors)."""
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.count[at] > 0)
        while len(live):
            for node in np.unique(at[live]):
                rows = live[at[live] == node]
                a, n = self.first[node], self.count[node]
                at[rows] = a + (x[rows] @ self.centers[a : a + n].T).argmax(axis=1) if n else node
            live = live[self.count[at[live]] > 0]
        return at

    def visits(self, q: np.ndarray, least: int, vectors: int) -> list[int]:
        """Leaves in best-bin-first order: at least `least`, and on until they hold `vectors` vectors or none is left."""
        queue, out, have = [(0.0, 0)], [], 0
        while queue and (len(out) < least or have < vectors):
            node = heapq.heappop(queue)[1]
            while n := int(self.count[node]):
                a = int(self.first[node])
                near = self.centers[a : a + n] @ q
                best = int(near.argmax())
                for i in range(n):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), a + i))
                node = a + best
            out.append(node)
            have += self.held.get(node, 0)
        return out


def _kmeans(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        own = (x @ centers.T).argmax(axis=1)
        for i in range(k):
            if (mine := own == i).any():
                c = x[mine].mean(axis=0)
                centers[i] = c / (np.linalg.norm(c) or 1.0)
    own = (x @ centers.T).argmax(axis=1)
    used = np.unique(own)
    return centers[used], np.searchsorted(used, own)


def grow(x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 3) -> Tree:
    rng = np.random.Generator(np.random.PCG64(seed))
    dim = x.shape[1] if x.ndim == 2 else 0
    centers, first, count, todo = [np.zeros(dim)], [0], [0], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        c, own = _kmeans(x[rows], min(branch, len(rows)), rng)
        if len(c) < 2:
            continue
        first[node], count[node] = len(centers), len(c)
        for i in range(len(c)):
            todo.append((len(centers), rows[own == i]))
            centers.append(c[i])
            first.append(0)
            count.append(0)
    return Tree(np.array(centers).reshape(len(centers), dim), np.array(first), np.array(count))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1, so that no square overflows
    or vanishes. That is exact, and cosines stay what they are; what is 2^-1022 times smaller than the largest counts for nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten()).astype(np.float64)
    return scaled(flat.reshape(len(col), -1)) if len(col) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(col: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & fine & F.exists(F.col(col), lambda x: x != 0)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of v."""
    return (v * q).sum(axis=-1) / (np.linalg.norm(v, axis=-1) * np.linalg.norm(q))


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k rows of v of largest cosine: row numbers and exact scores.

    Equal scores tie, and ties go to the smaller id: all rows that come within EDGE of the k-th rough score are scored
    exactly, however many they are.
    """
    rough = _unit(q) @ _unit(v).T
    k = min(len(v), k)
    take = min(len(v), k + 8)
    edge = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] - EDGE
    near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
    picked = v[near]
    exact = (picked * q[:, None, :]).sum(axis=2) / (np.linalg.norm(picked, axis=2) * np.linalg.norm(q, axis=1)[:, None])
    order = np.lexsort((ids[near], -exact), axis=1)[:, :k]
    near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
    for i in np.flatnonzero((rough >= edge[:, None]).sum(axis=1) > take):  # more ties than the rows taken
        every = np.flatnonzero(rough[i] >= edge[i])
        score = _exact(q[i], v[every])
        first = np.lexsort((ids[every], -score))[:k]
        near[i], exact[i] = every[first], score[first]
    return near, exact


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = K, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`; calibrated_recall, the share
    of the calibration queries' true neighbours that lie in the leaves a query visits.

    Order is that of the scores as doubles; equal ones go to the smaller id.

    Rows with a null id, or a null, empty, zero or non-finite vector, take no part, nor do vectors of another length than
    the most common one. Rows that repeat an id count once (the smallest vector). Fewer than k candidates: all of them. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = new_dir(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("id").agg(F.min("v").alias("v"))
    rows = staged(rows, f"{base}/rows")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = staged(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), f"{base}/distinct")
    picked = distinct.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    x = np.array(picked["v"].tolist(), np.float64)
    tree = grow(_unit(x), leaf) if len(x) else Tree(np.zeros((1, 1)), np.zeros(1, int), np.zeros(1, int))
    sent = spark.sparkContext.broadcast(tree)

    def put(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.place(_unit(_matrix(b.column(1)))), pa.int64())], names=["rep", "v", "ids", "leaf"])

    placed = staged(distinct.select("rep", "v", "ids").mapInArrow(put, "rep long, v array<double>, ids array<long>, leaf long"), f"{base}/placed")
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
    tree.held = held
    asking = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v")
    queries = staged(asking.groupBy("v").agg(F.min("query_id").alias("q")), f"{base}/queries")
    visits, reached = calibrate(placed, queries, tree, k, recall)
    sent2 = spark.sparkContext.broadcast(tree)

    def traverse(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _unit(_matrix(b.column(1)))
            leaves = [sent2.value.visits(m[i], visits, k + 1) for i in range(len(m))]
            n = np.array([len(x) for x in leaves])
            at = pa.array(np.repeat(np.arange(len(m)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(leaves).astype(np.int64))], names=["q", "v", "leaf"])

    asked = queries.select("q", "v").mapInArrow(traverse, "q long, v array<double>, leaf long")
    shards = spark.createDataFrame([(int(n), -(-c // SHARD)) for n, c in held.items()] or [(0, 0)], "leaf long, n int").where("n > 0")
    no_ids = F.lit(None).cast("array<bigint>")
    left = placed.join(F.broadcast(shards), "leaf").select("leaf", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("rep").alias("id"), "v", "ids")
    right = asked.join(F.broadcast(shards), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"), F.lit(1).alias("kind"), F.col("q").alias("id"), "v", no_ids.alias("ids"))

    def search(batches):
        state = {"key": None, "v": [], "ids": [], "rep": []}
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                part, group = b.slice(a, z - a), tuple(key[a, :2])
                if group != state["key"]:
                    state = {"key": group, "v": [], "ids": [], "rep": []}
                if key[a, 2] == 0:
                    state["v"].append(_matrix(part.column(4)))
                    state["rep"].append(np.asarray(part.column(3)))
                    state["ids"] += part.column(5).to_pylist()
                elif state["v"]:
                    v, rep = np.concatenate(state["v"]), np.concatenate(state["rep"])
                    q, who = _matrix(part.column(4)), np.asarray(part.column(3))
                    for c in range(0, len(q), 1024):
                        near, score = _best(q[c : c + 1024], v, rep, k + 1)
                        flat = near.ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who[c : c + 1024], near.shape[1])), pa.array(score.ravel()), pa.array(rep[flat]), pa.array([state["ids"][i] for i in flat], pa.list_(pa.int64()))], names=["q", "score", "rep", "ids"])

    dealt = left.unionByName(right).repartition("leaf", "shard").sortWithinPartitions("leaf", "shard", "kind")
    found = dealt.mapInArrow(search, "q long, score double, rep long, ids array<long>")
    found = found.withColumn("far", -F.col("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("far", "rep"))).where(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.collect_list(F.struct("far", "score", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("id"), x["score"].alias("score")))))
    own = asking.join(queries, "v").select("query_id", "q")
    top = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("query_id"))), 1, k)
    out = own.join(best, "q").select("query_id", F.posexplode(top).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"), F.lit(reached).alias("calibrated_recall"))


def calibrate(placed: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float) -> tuple[int, float]:
    """The number of leaves to visit for the target recall, and the recall it reaches, by exact neighbours of up to
    CALIBRATION queries over all vectors. A query's own vector is no neighbour of it unless other ids hold it too."""
    some = queries.orderBy(F.xxhash64("q"), "q").limit(CALIBRATION).toPandas()
    leaves = int((tree.count == 0).sum())
    if not len(some) or leaves == 1:
        return 1, 1.0
    q, own = scaled(np.array(some["v"].tolist(), np.float64)), np.asarray(some["q"])
    sent = placed.sparkSession.sparkContext.broadcast(q)

    def exact(batches):
        best = None  # of the task so far, a few rows a query
        for b in batches:
            if b.num_rows:
                rep = np.asarray(b.column(0))
                near, score = _best(sent.value, _matrix(b.column(1)), rep, k + 1)
                new = [score, rep[near], np.asarray(b.column(2))[near], np.asarray(b.column(3))[near]]
                best = new if best is None else [np.concatenate([x, y], axis=1) for x, y in zip(best, new, strict=True)]
                order = np.lexsort((best[1], -best[0]), axis=1)[:, : k + 1]
                best = [np.take_along_axis(x, order, 1) for x in best]
        if best is not None:
            n = np.repeat(np.arange(len(best[0])), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(x.ravel()) for x in best)], names=["n", "score", "rep", "leaf", "ids"])

    near = placed.select("rep", "v", "leaf", F.size("ids").cast("long").alias("ids")).mapInArrow(exact, "n long, score double, rep long, leaf long, ids long")
    far = -F.col("score")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(far, "rep"))).where(F.col("r") <= k + 1).select("n", "rep", "leaf", "ids").toPandas()
    near = near[(near["rep"].to_numpy() != own[near["n"].to_numpy()]) | (near["ids"].to_numpy() > 1)]
    if not len(near):
        return 1, 1.0
    unit = _unit(q)
    order = [{leaf: i for i, leaf in enumerate(tree.visits(unit[n], leaves, 0))} for n in range(len(q))]
    depth = np.array([order[n][leaf] for n, leaf in zip(near["n"], near["leaf"], strict=True)])
    visits = 1
    while visits < leaves and (depth < visits).mean() < target:
        visits = min(leaves, max(visits + 1, visits * 5 // 4))
    return visits, float((depth < visits).mean())
