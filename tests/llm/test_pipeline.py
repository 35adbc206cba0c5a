"""The pipeline against its operators, stage by stage, and on awkward tables."""

import random

import pytest

import corpus_pipeline
from memlattice.llm import queries


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        docs = after
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


@pytest.fixture(scope="module")
def awkward(spark, small, tmp_path_factory):
    """Real documents with repeated rows, near copies, nulls, an empty and a very long text, and columns whose names clash."""
    real = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en' AND length(text) > 600").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(2)
    words = " ".join(real).split()
    rows = [(i, t, "en") for i, t in enumerate(real)]
    rows += [(100 + i, t, "en") for i, t in enumerate(real[:5])] + [(7, real[7], "en")] * 3
    rows += [(200 + i, t + " one more", "en") for i, t in enumerate(real[10:14])]
    rows += [(300, None, "en"), (301, "", None), (302, " ".join(rng.choice(words) for _ in range(60_000)), None), (None, real[20] + " only here and nowhere else, a tail of its own", "en"), (303, "12 34", None)]
    folder = str(tmp_path_factory.mktemp("awkward"))
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, _row long, rid long, `a.b` long").repartition(5)
    df.write.parquet(f"{folder}/documents.parquet")
    return folder, real


def test_awkward_rows(spark, awkward):
    folder, real = awkward
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = after
    left = docs.collect()
    ids = [r.doc_id for r in left]
    assert len(set(ids)) == len(ids) and not {300, 301, 303} & set(ids) and 302 in ids
    assert ids.count(7) == 1 and len({r.text for r in left}) == len(left)
    for i in range(5):
        assert (i in ids) != (100 + i in ids)
    for i in range(4):
        assert (10 + i in ids) != (200 + i in ids)
    assert set(range(20, 40)) - {20} <= set(ids) and all(r["a.b"] == 3 and r._row == 1 for r in left)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(ids)
    assert max(r.offset + r.length for r in packed) <= 2048


def test_empty_table(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
