"""Radius and nearest-neighbour search of many rows against few: a ball tree of the few, past which tasks stream the many.

A tree's node is a ball around its points. A row goes down into it only while the ball may hold a point within the radius
and none was found for the row yet, or while the ball may bring one of its own points nearer to a row than any before. A
task keeps each point's least distance from batch to batch, so that later rows find balls closed; tasks give one number a point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written

LEAF = 8
#: Rows of a batch that every point is compared with before the tree is used.
SEED = 16
#: Points of a tree at most: 64 MB of eight features.
MOST = 1_000_000


class Tree:
    """Nodes (centre, radius, from, to, left, right) over points in the order of the leaves; `order` has their own places."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes, points = np.arange(len(points)), [], np.asarray(points, float)

        def node(at: int, to: int) -> int:
            me = len(self.nodes)
            self.nodes.append(None)
            own = points[self.order[at:to]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            left = right = -1
            if to - at > LEAF and radius > 0:
                axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
                self.order[at:to] = self.order[at:to][np.argsort(own[:, axis], kind="stable")]
                half = (at + to) // 2
                left, right = node(at, half), node(half, to)
            self.nodes[me] = (centre, radius, at, to, left, right)
            return me

        if len(points):
            node(0, len(points))
        self.points = points[self.order]


class Search:
    """The state of a task: least squared distances by point (in the tree's order), and the number of distances computed."""

    def __init__(self, tree: Tree, radius: float):
        self.tree, self.radius, self.computed = tree, radius, 0
        self.best = np.full(len(tree.points), np.inf)

    def _compare(self, rows: np.ndarray, at: int, to: int) -> np.ndarray:
        self.computed += len(rows) * (to - at)
        d2 = ((rows[:, None, :] - self.tree.points[None, at:to, :]) ** 2).sum(axis=2)
        np.minimum(self.best[at:to], d2.min(axis=0), out=self.best[at:to])
        return np.sqrt(d2.min(axis=1)) <= self.radius

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Whether each row has a point within the radius."""
        within = np.zeros(len(rows), bool)
        if not self.tree.nodes or not len(rows):
            return within
        if np.isinf(self.best[0]):
            within[:SEED] = self._compare(rows[:SEED], 0, len(self.best))
        self._visit(0, np.arange(len(rows)), rows, within)
        return within

    def _visit(self, me: int, own: np.ndarray, rows: np.ndarray, within: np.ndarray) -> None:
        centre, radius, at, to, left, right = self.tree.nodes[me]
        gap = np.sqrt(((rows[own] - centre) ** 2).sum(axis=1)) - radius - 1e-9
        open_ = np.sqrt(self.best[at:to].max())
        by = np.argsort(gap, kind="stable")
        own, gap = own[by], gap[by]
        own, gap = (x[(gap < open_) | (~within[own] & (gap <= self.radius))] for x in (own, gap))
        if not len(own):
            return
        if left >= 0:
            self._visit(left, own, rows, within)
            self._visit(right, own, rows, within)
            return
        done = 0
        for size in (SEED, 256, len(own)):  # the nearest rows first: they close the ball for most others
            part = slice(done, done + size)
            some = own[part]
            some = some[(gap[part] < np.sqrt(self.best[at:to].max())) | ~within[some]]
            if len(some):
                within[some] |= self._compare(rows[some], at, to)
            done += size


@dataclass(frozen=True)
class Near:
    """crises: model, start, dist, dist_sample. windows: model, n_near, n_windows, and computed, the number of distances taken."""

    crises: DataFrame
    windows: DataFrame


def search(few: DataFrame, many: DataFrame, scale: DataFrame, features: Sequence[str], radius: float) -> Near:
    """Per model the distance of each of few (start, features) to the nearest of many (model, n, features), and how many of many, of weight n, have one of few within the radius.

    scale holds a row per model: the features' deviations, and all, the number of rows that they are taken over; the sample's
    deviation is larger by the root of all / (all - 1), so that one search serves both scales.
    """
    rows = few.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"at most {MOST} rows can be searched for")
    starts = np.array([r.start for r in rows], np.int64)
    points = np.array([[r[c] for c in features] for r in rows], float).reshape(len(rows), len(features))
    scales = {r.model: (np.array([r[c] for c in features], float), r["all"]) for r in scale.collect()}
    schema = pa.schema([("model", pa.string()), ("start", pa.int64()), ("d2", pa.float64()), ("n_near", pa.int64()), ("n_windows", pa.int64()), ("computed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}
        for b in batches:
            names = np.array(b.column("model").to_pylist(), dtype=object)
            n = b.column("n").to_numpy()
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], axis=1)
            for name in set(names):
                if name not in states:
                    states[name] = [Search(Tree(points / scales[name][0]), radius), 0, 0]
                own = names == name
                s = states[name]
                within = s[0].add(x[own] / scales[name][0])
                s[1] += int(n[own][within].sum())
                s[2] += int(n[own].sum())
        for name, (s, n_near, n_windows) in states.items():
            k = len(s.best)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (k + 1)), pa.array([*starts[s.tree.order].tolist(), None], pa.int64()), pa.array([*s.best.tolist(), None]), pa.array([0] * k + [n_near]), pa.array([0] * k + [n_windows]), pa.array([0] * k + [s.computed])], schema=schema)

    out = many.select("model", "n", *features).mapInArrow(run, "model string, start long, d2 double, n_near long, n_windows long, computed long")
    out = written(out, "nearest")
    crises = out.where("start is not null").groupBy("model", "start").agg(F.sqrt(F.min("d2")).alias("dist"))
    all_ = F.col("all").cast("double")
    crises = crises.join(F.broadcast(scale.select("model", "all")), "model").select("model", "start", "dist", (F.col("dist") * F.sqrt((all_ - 1) / all_)).alias("dist_sample"))  # a row a model
    return Near(crises, out.where("start is null").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n_near", "n_windows", "computed")]))
