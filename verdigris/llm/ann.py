"""Approximate nearest neighbours: hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver from a bounded sample of the vectors and broadcast; every vector is then assigned to a leaf. A query walks the tree
with a priority queue of branches by the inner product to be expected of their best vector, and visits leaves in that order. How many vectors' worth of
leaves it must visit is calibrated on sampled queries against their exact neighbours in the whole table, widened until the wanted recall is reached.

Adjacent leaves form groups of about BLOCK vectors, and a group of many vectors (one leaf may hold a third of all) is cut into blocks. Queries go to
each block of a group once, with the leaves they visit there; blocks that many queries visit are copied, each copy for a share of the queries. A task
holds one block at a time while queries stream past it, so its memory depends neither on the table nor on the number of queries.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from verdigris.llm.common import Scratch, list_array

#: Most vectors that fit the tree; children of a node; vectors of the sample in a leaf; most levels.
MAX_SAMPLE, BRANCHES, LEAF, LEVELS = 20_000, 32, 64, 12
#: A branch's best vector is expected this many standard deviations beyond its centre.
REACH = 3.0
#: Sampled queries and recall of the calibration; the recall aimed at leaves room above the 0.9 that is required.
CALIBRATION_QUERIES, TARGET_RECALL = 300, 0.95
#: Vectors in a block on average, queries that share one copy of it, and queries scored at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 4096, 16_384, 256


class KMeansTree:
    """centers[i], spread[i] (standard deviation of a component), children[i] (empty for a leaf), leaf_id[i]; node 0 is the root.
    Leaves are numbered depth first, so neighbours in number are near each other."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.centers, self.spread, self.children, self.leaf_id = [x.mean(0)], [np.sqrt(x.var(0).mean())], [[]], [-1]
        self.leaves: list[int] = []
        random = np.random.default_rng(seed)
        todo = [(0, x, 0)]
        while todo:
            node, rows, level = todo.pop()
            parts = self.split(rows, random) if len(rows) > LEAF and level < LEVELS else []
            if len(parts) < 2:
                self.leaf_id[node] = len(self.leaves)
                self.leaves.append(node)
                continue
            for part in parts:
                self.children[node].append(len(self.centers))
                todo.append((len(self.centers), part, level + 1))
                self.centers.append(part.mean(0))
                self.spread.append(np.sqrt(part.var(0).mean()))
                self.children.append([])
                self.leaf_id.append(-1)
        self.centers, self.spread = np.array(self.centers), np.array(self.spread)

    @staticmethod
    def split(x: np.ndarray, random, rounds: int = 8) -> list[np.ndarray]:
        seeds = np.unique(x, axis=0)
        if len(seeds) < 2:
            return []
        c = seeds[random.choice(len(seeds), min(BRANCHES, len(seeds)), replace=False)]
        for _ in range(rounds):
            own = distances(x, c).argmin(1)
            used = np.unique(own)
            c = np.stack([x[own == i].mean(0) for i in used])
        own = distances(x, c).argmin(1)
        return [x[own == i] for i in range(len(c)) if (own == i).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, going down to the nearest child."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_id[node]
                continue
            own = distances(x[rows], self.centers[self.children[node]]).argmin(1)
            todo += [(child, rows[own == i]) for i, child in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, size: np.ndarray, enough: float) -> list[int]:
        """Leaves in best-bin-first order until they hold `enough` vectors (size: of each leaf)."""
        first = -(self.centers @ q + REACH * math.sqrt(q @ q) * self.spread)
        queue, out, held = [(first[0], 0)], [], 0
        while queue and held < enough:
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down to a leaf, leaving the other branches in the queue
                ranked = sorted(self.children[node], key=lambda c: first[c])
                for other in ranked[1:]:
                    heapq.heappush(queue, (first[other], other))
                node = ranked[0]
            out.append(self.leaf_id[node])
            held += size[self.leaf_id[node]]
        return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


def calibrate(tree: KMeansTree, size: np.ndarray, queries: np.ndarray, truth: list[tuple[int, int]]) -> float:
    """How many vectors a query must visit for the aimed recall; truth: (query, leaf) of each exact neighbour in the whole table."""
    met = []
    leaves = {}
    for query, leaf in truth:
        leaves.setdefault(query, []).append(leaf)
    for query, wanted in leaves.items():
        order = tree.visit(queries[query], size, math.inf)
        held = np.zeros(len(size))
        held[order] = np.cumsum(size[order])
        met += held[wanted].tolist()
    return float(np.quantile(met, TARGET_RECALL, method="higher")) if met else math.inf


def valid_vector(v: Column) -> Column:
    """Not null, no null, NaN or infinite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best_of(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, own: np.ndarray, allowed: np.ndarray, top: int):
    """For each query its `top` largest inner products with the allowed rows of x, ties to the smaller id: (query, ids, scores).

    One matrix product finds who may be among them; their scores are then taken row by row in double precision, so equal rows get equal scores.
    """
    rough = queries @ x.T
    rough[~(allowed & (ids != own[:, None]))] = -np.inf
    k = min(top, len(ids))
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    with np.errstate(invalid="ignore"):
        least -= 1e-9 * np.sqrt((queries * queries).sum(1) * (x * x).sum(1).max())
    for i in range(len(queries)):
        rows = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -np.inf))
        score = np.einsum("nd,d->n", x[rows], queries[i])
        rank = np.lexsort((ids[rows], -score))[:top]
        yield i, ids[rows[rank]], score[rank]


def nearest(vectors: DataFrame, is_query: Column, top: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query its `top` nearest others by inner product.

    Vectors that are null, zero or hold null or non-finite components, and rows without a key, take no part; vectors must share one length. A
    key that stands on several rows is a candidate once a row, and never its own query's; each of its rows that asks is answered by itself. Ties go
    to the smaller key. Fewer candidates than `top` give as many rows; an empty table gives an empty result; other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    given = vectors.schema[vector].dataType
    kept = "array<float>" if isinstance(given.elementType, T.FloatType) else "array<double>"
    asks = F.coalesce(is_query, F.lit(False))
    rows = vectors.filter(F.col(key).isNotNull() & valid_vector(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kept).alias("v"), asks.alias("q"))
    out = "query_id long, rank int, vec_id long, score double"
    drawn = lambda df, n: df.select("id", "v").orderBy(F.xxhash64("id", F.lit(13)), "id", "v").limit(n).toPandas()
    sample, probes = drawn(rows, MAX_SAMPLE), drawn(rows.filter("q"), CALIBRATION_QUERIES)
    if probes.empty:
        return spark.createDataFrame([], out)
    tree = KMeansTree(np.array(sample["v"].tolist(), np.float64))
    asked_ids, asked_v = probes["id"].to_numpy(np.int64), np.array(probes["v"].tolist(), np.float64)
    sent = spark.sparkContext.broadcast((tree.__dict__, asked_ids, asked_v))  # plain values, so that workers need not have this module
    columns = f"id long, v {kept}, q boolean, leaf int"

    def planted():
        tree = object.__new__(KMeansTree)
        tree.__dict__.update(sent.value[0])
        return tree

    def assigned(batches):
        tree = planted()
        for b in batches:
            leaf = tree.assign(matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=["id", "v", "q", "leaf"])

    # the row's number holds from here on, as it is written
    placed = scratch.table(rows.mapInArrow(assigned, columns).withColumn("row", F.monotonically_increasing_id()))
    # as many rows as leaves, whose number the sample bounds
    size = np.zeros(len(tree.leaves), np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        size[r["leaf"]] = r["n"]

    def exact(batches):
        """Each probe's best rows in a task's share of the table."""
        _, own, probes = sent.value
        score, leaf = np.full((len(own), 1), -np.inf), np.zeros((len(own), 1), np.int32)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                found = probes @ matrix(part.column(1)).T
                found[own[:, None] == part.column(0).to_numpy()] = -np.inf
                score, leaf = np.hstack([score, found]), np.hstack([leaf, np.broadcast_to(part.column(2).to_numpy(), found.shape)])
                if score.shape[1] > top:
                    best = np.argpartition(-score, top - 1, axis=1)[:, :top]
                    score, leaf = np.take_along_axis(score, best, 1), np.take_along_axis(leaf, best, 1)
        probe, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), pa.array(leaf[probe, at]), pa.array(score[probe, at])], names=["probe", "leaf", "score"])

    met = placed.select("id", "v", "leaf").mapInArrow(exact, "probe int, leaf int, score double")
    met = met.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy(F.col("score").desc(), "leaf"))).filter(F.col("n") <= top)
    # at most CALIBRATION_QUERIES * top rows
    enough = calibrate(tree, size, asked_v, [(r["probe"], r["leaf"]) for r in met.select("probe", "leaf").collect()])

    group, held = np.zeros(len(size), np.int32), 0  # of each leaf
    for i in range(1, len(size)):
        held += size[i - 1]
        group[i] = group[i - 1] + (held + size[i] > BLOCK)
        held *= int(group[i] == group[i - 1])
    blocks = np.maximum(1, -(-np.bincount(group, size).astype(np.int64) // BLOCK))
    known = spark.sparkContext.broadcast((size, group))
    many = placed.groupBy("id").agg(F.count("*").alias("same")).filter("same > 1")
    queries = placed.filter("q").join(many, "id", "left").select("row", "id", "v", F.coalesce("same", F.lit(1)).alias("same"))
    # walking the tree takes long for few bytes, so partitions by bytes would be too large
    queries = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    asking = f"row long, id long, v {kept}, visits array<struct<grp: int, leaves: array<int>>>"

    def visits(batches):
        tree, (size, group) = planted(), known.value
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                groups, leaves, n_groups, n_leaves = [], [], [], []
                for q, same in zip(matrix(part.column(2)), part.column(3).to_pylist()):
                    seen = np.sort(np.array(tree.visit(q, size, max(enough, top + same)), np.int32))  # groups ascend with leaves
                    mine, count = np.unique(group[seen], return_counts=True)
                    groups.append(mine)
                    leaves.append(seen)
                    n_groups.append(len(mine))
                    n_leaves.append(count)
                inner = list_array(np.concatenate(leaves), np.concatenate(n_leaves))
                stops = pa.StructArray.from_arrays([pa.array(np.concatenate(groups).astype(np.int32)), inner], names=["grp", "leaves"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(offsets, stops)], names=["row", "id", "v", "visits"])

    asked = scratch.table(queries.mapInArrow(visits, asking))
    # a row a group, of which there are no more than leaves
    crowd = np.zeros(len(blocks), np.int64)
    for r in asked.select(F.explode("visits.grp").alias("grp")).groupBy("grp").agg(F.count("*").alias("n")).collect():
        crowd[r["grp"]] = r["n"]
    copies = -(-crowd // QUERY_BLOCK)  # none of a group that no query visits
    plan = F.broadcast(spark.createDataFrame([(g, int(blocks[g]), int(copies[g])) for g in range(len(blocks)) if copies[g]], "grp int, n_blocks long, n_copies long"))
    of_leaf = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "leaf int, grp int"))
    spread = lambda n: F.pmod(F.xxhash64("row", F.lit(17)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = placed.join(of_leaf, "leaf").join(plan, "grp").select("grp", spread("n_blocks").alias("block"), each("n_copies").alias("copy"), F.lit(False).alias("asks"), "row", "id", "v", F.array("leaf").alias("leaves"))
    asked = asked.select("row", "id", "v", F.explode("visits").alias("visit")).select("row", "id", "v", F.col("visit.grp").alias("grp"), F.col("visit.leaves").alias("leaves"))
    asked = asked.join(plan, "grp").select("grp", each("n_blocks").alias("block"), spread("n_copies").alias("copy"), F.lit(True).alias("asks"), "row", "id", "v", "leaves")
    met = stored.unionByName(asked).repartition("grp", "block", "copy").sortWithinPartitions("grp", "block", "copy", "asks")

    def search(batches):
        """Each block's rows come first, then the queries that visit it."""
        place, ids, x, leaf = None, [], [], []
        for b in batches:
            at = np.stack([b.column(i).to_numpy() for i in range(3)] + [b.column(3).to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                if lo == hi:
                    continue
                if tuple(at[lo, :3]) != place:
                    place, ids, x, leaf = tuple(at[lo, :3]), [], [], []
                run = b.slice(lo, hi - lo)
                if not at[lo, 3]:
                    ids.append(run.column(5).to_numpy())
                    x.append(matrix(run.column(6)))
                    leaf.append(run.column(7).flatten().to_numpy())
                    continue
                if not ids:  # a block may stay empty
                    continue
                ids, x, leaf = ([np.concatenate(part)] for part in (ids, x, leaf))
                first = int(leaf[0].min())
                width = int(leaf[0].max()) - first + 1
                for start in range(0, len(run), AT_ONCE):
                    part = run.slice(start, AT_ONCE)
                    row, own, seen = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(7)
                    of, number = np.repeat(np.arange(len(part)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy() - first
                    fits = (number >= 0) & (number < width)
                    visited = np.zeros((len(part), width), bool)
                    visited[of[fits], number[fits]] = True
                    found = list(best_of(ids[0], x[0], matrix(part.column(6)), own, visited[:, leaf[0] - first], top))
                    counts = [len(f[1]) for f in found]
                    arrays = [np.repeat(row, counts), np.repeat(own, counts), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["row", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
