"""The registered training-data queries and the pipeline on the smallest tables."""

import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lociflow.llm import registry
from lociflow.sources.shared import written

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_stages(spark):
    """Each stage keeps the columns of documents, removes what it should of what it got and nothing else."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, DATA), "stage")
        assert docs.columns == before.columns
        was, now = ({r.doc_id: r.text for r in df.collect()} for df in (before, docs))
        assert set(now) <= set(was) and len(now) > 0.6 * len(was), name
        if name == "quality classifier":
            gone = set(was) - set(now)
            bad = {i for i in was if labels.get(i, (1, 0))[0] == 0}
            assert sum(labels.get(i) == (1, 0) for i in gone) <= 2 and len(bad & gone) > 0.6 * len(bad), (bad, gone)
        if name == "benchmark decontamination":
            assert not [i for i, t in now.items() if any(x in " ".join((t or "").lower().split()) for x in items)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and all(0 <= r.offset and r.offset + r.length <= 1024 for r in packed)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, empty and repeated rows, columns named as the stages' own, and an empty table."""
    import random

    r = random.Random(1)
    made = [(i, " ".join(r.choices("the re on an er ing ed st nd or ea".split(), k=60)), "en", "s", 5) for i in range(40)]
    made += [(None, "a b " + made[5][1], "en", "s", 1), (40, None, "en", "s", 0), (41, "", None, None, None), (None, made[0][1], "en", "s", 1), (42, made[1][1], None, None, None), (43, "#" * 50_000, "en", "s", 1), made[3], made[3]]
    docs = spark.createDataFrame([(*x, "x", 1, 2) for x in made] if rows == "odd" else [], "doc_id long, text string, lang string, source string, n_chars long, k0 string, n_lines int, component_id int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, made[5][1]), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.schema.simpleString() == before.schema.simpleString()
    ids = sorted(x.doc_id for x in docs.where("doc_id IS NOT NULL").collect())
    if rows == "none":
        assert ids == []
    else:
        assert not docs.where("doc_id IS NULL").where(F.col("text").contains(made[5][1])).count()
        assert 5 not in ids and 42 not in ids and 43 not in ids and 41 not in ids and ids.count(3) == 3 and len(set(ids)) >= 36
        assert all((x.k0, x.n_lines, x.component_id) == ("x", 1, 2) and x.n_chars == len(x.text) for x in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
