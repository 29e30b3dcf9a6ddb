"""The pipeline, stage by stage, on the smallest tables and on odd rows."""

from pathlib import Path

import pytest
from conftest import SCHEMA, rows_of

import corpus_pipeline as pipeline
from bloomgrid.llm import decontaminate, neardup, quality_rules
from bloomgrid.llm.queries import QUERIES, SQL, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the test tables")


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_every_operator_has_one_query():
    numbers = {int(name.split("_")[0][2:]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    kept = pipeline.quality_stage(spark, docs, FOLDER).cache()
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality_rules.judged(docs).where("kept"))
    good = pipeline.classifier_stage(spark, kept, FOLDER).cache()
    assert good.columns == docs.columns and set(ids(good)) <= set(ids(kept))
    single = pipeline.near_dedup_stage(spark, good, FOLDER).cache()
    assert ids(single) == ids(neardup.near_duplicates(good, 5).where("kept"))
    clean = pipeline.decontamination_stage(spark, single, FOLDER).cache()
    found = decontaminate.contaminated(single, table(spark, FOLDER, "benchmark"))
    assert ids(clean) == ids(found.where("NOT contaminated"))
    encoded = pipeline.encoding_stage(spark, clean, FOLDER)
    assert ids(encoded) == ids(clean)
    assert ids(pipeline.run(spark, FOLDER)) == ids(clean)


def test_stages_on_odd_rows_and_on_none(spark, corpus):
    odd = [x for x in corpus if x[0] is None or x[0] < 0 or x[0] >= 390 or x[0] < 20]
    for rows in (rows_of(odd), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.collect()
