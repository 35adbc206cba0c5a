"""Derived tables are written and read in parts that do not grow with the table."""

import glob

import pytest
from pyspark.sql import functions as F

from memlattice.operators import units as U
from memlattice.plans import units as P
from memlattice.sources import tables as T


def test_tasks_that_write_a_derived_table_are_small(spark, small, monkeypatch):
    monkeypatch.setattr(T, "WRITE_BYTES", "4k")
    monkeypatch.setattr(T, "_known", {})
    before = spark.conf.get(T._ADVISED)
    rows = lambda: spark.range(0, 4000, 1, 16).select(F.sha2(F.col("id").cast("string"), 256).alias("s"), F.lit("one").alias("p"))
    assert T.stored(spark, small, "some_edges", [], rows, "p").count() == 4000
    (path, _), = T._known.values()
    assert len(glob.glob(f"{path.removeprefix('file://')}/p=one/part-*")) > 4 and spark.conf.get(T._ADVISED) == before


@pytest.mark.parametrize("query", [P.documents_by_source, P.document_edges_by_predicate, P.documents_by_entity, P.document_hydrate])
def test_rows_are_dealt_in_proportion_to_the_table(spark, small, monkeypatch, query):
    rows = lambda: sorted(map(repr, query(spark, small).collect()))
    want = rows()
    monkeypatch.setattr(T, "PART_BYTES", 10_000)
    n = T.n_parts(spark, small, "documents")
    assert n > T.LEAST_PARTS and rows() == want
    assert f", {n}), REPARTITION_BY_NUM" in query(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_documents_by_object_without_a_table(spark):
    edges = spark.createDataFrame([("a", "child_of", "d"), ("b", "child_of", "d"), ("a", "has_entity", "E"), ("b", "has_entity", "E"), ("c", "has_entity", "E")], "s string, p string, o string")
    assert [tuple(r) for r in U.documents_by_object(edges, "has_entity").collect()] == [("E", "d")]
