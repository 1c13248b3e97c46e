"""Nearest neighbours by largest inner product: vantage-point trees per shard, pruned by a relaxed triangle inequality.

Inner product becomes Euclidean distance by one more component: with M the largest norm, a vector x gets
sqrt(M**2 - |x|**2) and a query 0; then |q - x|**2 = M**2 + |q|**2 - 2qx.

1. A vantage-point tree over a sample of at most SAMPLE vectors (in the order of a hash of vec_id) is the map: its leaves
   are regions, and every vector goes down to one. A region of more than SHARD vectors is cut into shards by hash, so
   that neither a cluster nor a repeated vector makes a shard large.
2. Each shard's own tree is built once, over all its vectors, and kept as one row of an index table.
3. Each query first searches one shard of its own region; the k-th best found there is its bound. Then it goes to those
   shards whose regions the map does not rule out under that bound, and sends on what is at least as near. A task takes
   a shard's tree once and streams the queries past it.

A region or node is left out when its distance from the query is at least bound / factor. Factor 1 is exact search;
larger ones prune more. On unit vectors of 64 dimensions without clusters, as in the test tables, all distances are
nearly alike, so that exact search scores every vector; FACTOR is the measured compromise there (README has figures). On
clustered vectors exact search leaves out most of them.

Scores are inner products of the original vectors in double precision, each summed in the same order, so equal vectors
tie exactly and the smaller vec_id goes first.

Defined results: vectors null, empty, zero, or holding a null or non-finite component take no part, nor do rows of null
vec_id; vectors meet only others of the same length, however long; of rows that repeat a vec_id the least vector counts;
fewer candidates than k give fewer rows (at a factor above 1 a query may get fewer than there are only if it has not met
k); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, scratch, written

SHARD, LEAF = 8192, 128
#: Vectors of the map at most, and fewer where they are long (64 MB in all); lengths that get a map of their own.
SAMPLE, LENGTHS = 16384, 64
#: Measured on the test tables for a recall above 0.95; 1 is exact.
FACTOR = 6.0
_PLACE = "dim int, region int, part int"


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top**2 - (x * x).sum(1)))[:, None]])


def build(ids: np.ndarray, x: np.ndarray, top: float, leaf: int | None = None) -> tuple:
    """A tree: (ids, vectors in leaf order, nodes). A node: (start, end) for a leaf, else (vantage, inner radius, outer radius, inner, outer)."""
    leaf = leaf or LEAF
    lifted = lift(x, top)
    order, nodes = np.argsort(ids, kind="stable"), []

    def node(at: int, to: int) -> int:
        me = len(nodes)
        nodes.append(None)
        own, d = order[at:to], None
        if to - at > leaf:
            spread = np.linalg.norm(lifted[own] - lifted[own].mean(0), axis=1)
            vantage = lifted[own[int(spread.argmax())]]  # far from the middle: distances spread most
            d = np.linalg.norm(lifted[own] - vantage, axis=1)
        if d is None or d.min() == d.max():  # small, or all at one distance
            order[at:to] = own[np.argsort(ids[own], kind="stable")]
            nodes[me] = (at, to)
            return me
        by = np.argsort(d, kind="stable")
        order[at:to], d = own[by], d[by]
        half = (to - at) // 2
        nodes[me] = (vantage, d[half - 1], d[half], node(at, at + half), node(at + half, to))
        return me

    if len(ids):
        node(0, len(ids))
    return ids[order], x[order], nodes


def search(tree: tuple, queries: np.ndarray, own: np.ndarray, k: int, top: float, factor: float = FACTOR, floor: np.ndarray | None = None, count: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), one row a query, best first; a place that stays empty has score -inf.

    floor: scores that k others are known to reach, by query; only what is at least as near is found. count takes the
    number of vectors scored.
    """
    ids, x, nodes = tree
    n = len(queries)
    floor = np.full(n, -np.inf) if floor is None else floor
    lifted = np.hstack([queries, np.zeros((n, 1))])
    base = top**2 + (queries * queries).sum(1)
    best, score = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def least(q: np.ndarray) -> np.ndarray:
        return np.maximum(score[q, -1], floor[q])

    def leaf(at: int, to: int, q: np.ndarray) -> None:
        if count is not None:
            count.append(len(q) * (to - at))
        s = np.einsum("qd,ld->ql", queries[q], x[at:to])
        s[(ids[at:to][None, :] == own[q][:, None]) | (s < floor[q][:, None])] = -np.inf
        hit = s.max(axis=1) >= np.maximum(score[q, -1], np.finfo(float).min)
        q, s = q[hit], s[hit]
        if len(q):
            all_s = np.hstack([score[q], s])
            all_i = np.hstack([best[q], np.broadcast_to(ids[at:to], s.shape)])
            by = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            score[q], best[q] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_i, by, 1)

    def visit(me: int, q: np.ndarray) -> None:
        if len(nodes[me]) == 2:
            return leaf(*nodes[me], q)
        vantage, inner_to, outer_from, inner, outer = nodes[me]
        d = np.linalg.norm(lifted[q] - vantage, axis=1)
        near = d <= (inner_to + outer_from) / 2
        for first, second, part in ((inner, outer, near), (outer, inner, ~near)):
            if part.any():
                visit(first, q[part])
                gap = (outer_from - d[part]) if first == inner else (d[part] - inner_to)
                more = gap <= reach(base[q[part]], least(q[part]), top, factor)
                if more.any():
                    visit(second, q[part][more])

    if nodes:
        visit(0, np.arange(n))
    return best, score


def reach(base: np.ndarray, score: np.ndarray, top: float, factor: float) -> np.ndarray:
    """How far a region may be from a query that has k neighbours of at least this score."""
    return np.sqrt(np.maximum(0.0, base - 2 * score)) / factor + 1e-9 * top


class Map:
    """The tree over the sample, as a division of the whole space: nodes (vantage, radius, inner, outer) and (region,)."""

    def __init__(self, x: np.ndarray, top: float, regions: int):
        self.top, self.nodes, self.regions = top, [], 0
        leaf = max(8, -(-len(x) // max(1, regions)))
        for node in build(np.arange(len(x)), x, top, leaf)[2] or [(0, 0)]:
            if len(node) == 2:
                self.nodes.append((self.regions,))
                self.regions += 1
            else:
                vantage, inner_to, outer_from, inner, outer = node
                self.nodes.append((vantage, (inner_to + outer_from) / 2, inner, outer))

    def region(self, x: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        lifted, out = lift(x, self.top), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            me, rows = todo.pop()
            node = self.nodes[me]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                near = np.linalg.norm(lifted[rows] - node[0], axis=1) <= node[1]
                todo += [(node[2], rows[near]), (node[3], rows[~near])]
        return out

    def reached(self, q: np.ndarray, score: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(region, rows of q that must look there)."""
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        far = reach(self.top**2 + (q * q).sum(1), score, self.top, factor)
        todo = [(0, np.arange(len(q)))]
        while todo:
            me, rows = todo.pop()
            node = self.nodes[me]
            if len(node) == 1:
                yield node[0], rows
            elif len(rows):
                d = np.linalg.norm(lifted[rows] - node[0], axis=1)
                todo += [(node[2], rows[d - node[1] <= far[rows]]), (node[3], rows[node[1] - d <= far[rows]])]


def usable(v: Column) -> Column:
    fine = lambda c: F.coalesce((c == c) & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, fine), F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), b.filter(pa.array(dims == dim))


def placed(v: DataFrame, maps: dict[int, Map]) -> DataFrame:
    """Adds region to (vec_id, v, dim)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                region = maps[dim].region(_matrix(part.column("v"))) if dim in maps else np.zeros(part.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region, pa.int32())], [*part.schema.names, "region"])

    return v.mapInArrow(place, "vec_id long, v array<double>, dim int, norm double, region int")


def probe(index: DataFrame, asked: DataFrame, k: int, top: float, factor: float, tasks: int) -> DataFrame:
    """query_id, vec_id, score: what each row of asked (dim, region, part, query_id, v, floor) finds in the shard it names.

    A shard's tree and the queries for it are sorted into one stream, the tree first.
    """
    trees = index.select("dim", "region", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("floor"), "tree")
    rows = asked.select("dim", "region", "part", F.lit(1).alias("kind"), "query_id", "v", "floor", F.lit(None).cast("binary").alias("tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            kinds = b.column("kind").to_numpy()
            place = np.stack([b.column(c).to_numpy() for c in ("dim", "region", "part")], axis=1)
            cuts = [0, *(np.flatnonzero((kinds[1:] == 0) | (place[1:] != place[:-1]).any(axis=1)) + 1), b.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                part = b.slice(at, to - at)
                if part.num_rows and kinds[at] == 0:
                    tree = pickle.loads(part.column("tree")[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    own = part.column("query_id").to_numpy()
                    ids, scores = search(tree, _matrix(part.column("v")), own, k, top, factor, part.column("floor").to_numpy())
                    there = scores > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[there.ravel()]), pa.array(ids[there]), pa.array(scores[there])], ["query_id", "vec_id", "score"])

    both = trees.unionByName(rows).repartition(tasks, "dim", "region", "part").sortWithinPartitions("dim", "region", "part", "kind", "query_id")
    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score for every row where is_query holds (a condition on vec_id)."""
    spark = vectors.sparkSession
    folder = scratch(spark)
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    v = written(v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))), "vectors", folder)
    stats = v.agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.sum(is_query.cast("long")).alias("q")).first()
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = float(stats["top"]) * (1 + 1e-12)
    maps = {}
    for r in v.groupBy("dim").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "dim").limit(LENGTHS).collect():
        some = v.where(F.col("dim") == r.dim).orderBy(row_hash(["vec_id"], 5), "vec_id").limit(min(SAMPLE, max(16, (1 << 23) // r.dim)))
        maps[r.dim] = Map(np.stack([np.array(x.v) for x in some.select("v").collect()]), top, math.ceil(r["count"] / SHARD))

    v = written(placed(v, maps), "placed", folder)
    # a row a region: at most LENGTHS * SAMPLE / 8, and one for each length without a map
    sizes = v.groupBy("dim", "region").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int")
    v = written(v.join(sizes, ["dim", "region"]).withColumn("part", part), "parted", folder)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf.vec_id.to_numpy(), np.stack(pdf.v.to_numpy()), top)
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "region": [pdf.region.iloc[0]], "part": [pdf.part.iloc[0]], "tree": [pickle.dumps(tree, 5)]})

    index = written(v.select("dim", "region", "part", "vec_id", "v").groupBy("dim", "region", "part").applyInPandas(plant, f"{_PLACE}, tree binary"), "index", folder)
    shards = index.count()
    tasks = max(1, min(shards, 100_000))
    home = written(v.where(is_query).select("dim", "region", "part", F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor")), "home", folder)
    first = written(probe(index, home, k, top, factor, tasks), "first", folder)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("k_th"))
    bounded = home.drop("floor").join(floors, "query_id", "left").withColumn("floor", F.coalesce("k_th", F.lit(float("-inf")))).drop("k_th")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                q, floor = _matrix(part.column("v")), part.column("floor").to_numpy()
                for region, rows in maps[dim].reached(q, floor, factor) if dim in maps else [(0, np.arange(part.num_rows))]:
                    some = part.take(pa.array(rows))
                    names = ["dim", "query_id", "v", "floor", "home", "own"]
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array(np.full(len(rows), region, np.int32))], [*names, "region"])

    asked = bounded.withColumnsRenamed({"region": "home", "part": "own"}).mapInArrow(spread, "dim int, query_id long, v array<double>, floor double, home int, own int, region int")
    asked = asked.join(sizes, ["dim", "region"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("region != home or part != own")
    found = first.unionByName(probe(index, asked, k, top, factor, tasks))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
