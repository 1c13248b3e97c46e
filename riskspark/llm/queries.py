"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, infill, line_dedup, media, mixing, near_dedup, neighbours, packing, sharding, toxicity, urls, warc, whitening
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    from .common import n_words, written

    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("words")), "sizes")
    return mixing.mix(sizes, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = media.media_table(table(spark, sf_dir, "documents"))
    return d.withColumn("digest", F.lower(F.hex("digest")))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op12_checkpoint_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_url_filter, op3_hyperminhash, op4_vantage_point, op5_label_propagation, op6_media, op7_line_runs, op8_warc_zst, op9_bin_slack, op10_toxicity, op11_residue_whitening, op12_checkpoint_infill, op13_prefix_join, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urls.oracle_sql(), "op7_line_runs": line_dedup.ORACLE_SQL, "op8_warc_zst": warc.ORACLE_SQL, "op12_checkpoint_infill": infill.ORACLE_SQL, "op13_prefix_join": decontaminate.ORACLE_SQL}
