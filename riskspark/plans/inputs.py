"""What the queries read: each intermediate table is written once in the store of its query, at its first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import options as op
from ..operators import realism as re_
from ..operators import scenarios as sc
from ..operators import validation as va
from ..sources import tables as t
from ..store import Store


class Inputs:
    """The tables of one query or report over a folder of source tables; release() of its store ends them.

    Simulations that drew the same block of the series have the same path, so paths are kept once each, with the number n of
    simulations: their figures, values and windows are computed per distinct path, and simulations are counted in one scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, ret: DataFrame | None = None, store: Store | None = None):
        self.spark, self.sf, self._ret = spark, sf_dir, ret
        self.store = store or Store(spark)

    @cached_property
    def ret(self) -> DataFrame:
        """series, rn, dt, r."""
        return self.store.table("returns", lambda: t.returns(self.spark, self.sf) if self._ret is None else self._ret)

    @cached_property
    def real(self) -> DataFrame:
        return self.ret.select("rn", "r")

    @cached_property
    def features(self) -> DataFrame:
        """All features, with nulls in the first rows."""
        return self.store.table("features", lambda: fe.market_features(fe.with_vix(self.ret, t.vix(self.spark, self.sf))))

    @cached_property
    def complete(self) -> DataFrame:
        """Rows with all features, from the 252nd on."""
        return self.features.dropna()

    @cached_property
    def labels(self) -> DataFrame:
        return self.store.table("labels", lambda: fe.stress_labels(self.ret))

    @cached_property
    def paths(self) -> DataFrame:
        """block_id, a, n."""
        return self.store.table("paths", lambda: t.drawn_blocks(self.spark, self.sf, self.ret))

    @cached_property
    def models(self) -> DataFrame:
        """model, sim_id, a, n: sim_id stands for all simulations of a path."""
        return self.store.table("models", lambda: t.models_of(self.paths.withColumnRenamed("block_id", "sim_id")))

    @cached_property
    def values(self) -> DataFrame:
        """model, v, c."""
        return self.store.table("values", lambda: va.step_values(self.models))

    @cached_property
    def figures(self) -> DataFrame:
        """model, sim_id, n and the figures of each path."""
        return self.store.table("figures", lambda: sc.per_array(self.models, ("model", "sim_id")))

    @cached_property
    def own_figures(self) -> DataFrame:
        """sim_id, n and the figures of the paths without a generator's scale and shift."""
        return self.store.table("own_figures", lambda: sc.per_array(self.paths.withColumnRenamed("block_id", "sim_id")))

    @cached_property
    def windows(self) -> DataFrame:
        return self.store.table("windows", lambda: re_.path_windows(self.real, self.models))

    @cached_property
    def crisis(self) -> DataFrame:
        """Crisis windows, typed by rule."""
        return self.store.table("crisis", lambda: re_.by_rule(fe.crisis_windows(fe.window_features(self.ret))))

    @cached_property
    def weights(self) -> DataFrame:
        """Blocks with their weights for the latest row."""
        return self.store.table("weights", lambda: sc.block_weights(sc.block_library(self.complete), self.complete))

    @cached_property
    def sims(self) -> DataFrame:
        return t.spread(t.table(self.spark, self.sf, "orders").select(F.col("o_orderkey").alias("sim_id")), "sim_id")

    @cached_property
    def puts(self) -> DataFrame:
        """The liquid puts with implied volatility and greeks."""
        return self.store.table("puts", lambda: op.bs_metrics(t.spread(op.liquid(op.quoted(t.chain(self.spark, self.sf))), "contract_id")))

    @cached_property
    def scored(self) -> DataFrame:
        return op.scored(self.store.table("priced", lambda: op.physical(self.puts, self.own_figures)))
