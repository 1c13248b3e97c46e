"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from riskspark.llm.common import scratch, written

from .test_operators import brute_components, brute_lines


def test_stages_do_their_work(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    folder, at, seen = scratch(spark), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in at.collect()]
        columns = at.columns
        at = written(stage(spark, at, sf), name, folder)
        seen[name] = before, [tuple(r) for r in at.collect()]
        assert name == "packing" or at.columns == columns
    before, after = seen["toxicity"]
    assert not Counter(after) - Counter(before)
    before, after = seen["line_dedup"]
    assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
    assert sum(n for (_, _, dropped, _), n in brute_lines(before).items() if dropped) == len([r for r in after if r not in before])
    before, after = seen["near_dedup"]
    assert sorted(r[0] for r in after) == sorted(d for d, (_, root) in brute_components(before, 5, 80).items() if d == root)
    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    before, after = seen["packing"]
    assert {r[0] for r in after} == {r[0] for r in before}


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_clashing_names_and_an_empty_table(spark, odd, no_docs, tmp_path):
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    some = odd.where("doc_id < 40 or doc_id > 118")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, some, str(tmp_path))
        assert out.columns == some.columns, name
        assert all(r["score"] == r["size"] == r["taken"] == r["predicted"] == "clash" for r in out.select("score", "size", "taken", "predicted").collect()), name
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
