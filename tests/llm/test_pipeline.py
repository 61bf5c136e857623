"""The pipeline's stages on a small table: columns, decisions and what each one must keep."""

from __future__ import annotations

import sys

import pytest

import corpus_pipeline
from gymlake.llm.common import Scratch, read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    out, scratch = [("documents", docs)], Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][1].dtypes
    for _, df in stages[1:-1]:
        assert df.dtypes == columns
        assert df.groupBy("doc_id").count().where("count > 1").count() == 0


def test_each_stage_takes_effect(stages):
    counts = [df.count() for _, df in stages]
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4]
    words = [sum(len((r["text"] or "").split()) for r in df.select("text").collect()) for _, df in stages[:5]]
    assert words[2] >= words[3]
    assert stages[-1][1].count() >= counts[4]


def test_no_two_near_copies_stay(spark, stages):
    from gymlake.llm.ngram_join import similar_groups

    assert similar_groups(stages[2][1]).where("component_id <> doc_id").count() == 0


def test_registered_with_its_guard(spark):
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_the_pipeline_leaves_other_results_alone_and_drops_its_own(spark, tmp_path):
    from gymlake.llm.catalogue import QUERIES
    from gymlake.llm.common import shared_dir

    planned = [QUERIES[n](spark, SF) for n in ("op5_ngram_jaccard_join", "op6_pack_sequences", "op13_merkle_manifest")]
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folders = lambda: {f.getPath().getName() for f in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base) if f.getPath().getName().startswith("gymlake-")}
    before = folders()
    first = corpus_pipeline.run(spark, SF)
    assert len(folders() - before) == 1  # that of its result
    second = corpus_pipeline.run(spark, SF)
    assert first.count() == second.count() > 0
    assert all(df.count() >= 200 for df in planned)
