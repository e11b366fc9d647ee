"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from larder.llm import catalogue

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: None if x is None else round(x, 6) if isinstance(x, float) else x
    return collections.Counter(tuple(show(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in con.description]
    found = entry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, con.fetchall())


def test_thirteen_operators_and_pipeline():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


def test_pipeline_stages(spark):
    from larder.llm import suffix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.dtypes == docs.dtypes, name
        kept[name] = collections.Counter(r.doc_id for r in out.collect())
        docs = out
    assert set(kept["near_duplicates"]) <= set(kept["quality"]) and kept["repeats"] == kept["near_duplicates"]
    assert set(kept["mixing"]) <= set(kept["repeats"]) and max(kept["mixing"].values()) <= 2
    again = suffix.remove_repeats(docs.dropDuplicates(["doc_id"]))
    assert again.agg({"n_removed": "sum"}).first()[0] <= docs.count() * 200  # what is left has next to no repeats
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept["mixing"])
