"""A project's tables in aligned buckets: commits, cascades, tombstones."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lineage
from corpusloom.schemas import TABLES, table_schema
from corpusloom.sources import project as store

N = 40


@pytest.fixture
def tables(spark):
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.concat("id", F.lit(".txt")).alias("filename"))
    chunks = spark.range(N * 3).select(F.col("id").alias("chunk_id"), (F.col("id") % N).alias("doc_id"), F.lit(1).alias("run_id"))
    labels = spark.range(N * 6).select(F.col("id").alias("label_id"), (F.col("id") % (N * 3)).alias("chunk_id"))
    reviews = spark.range(N * 2).select(F.col("id").alias("review_id"), (F.col("id") * 2).alias("label_id"))
    return {
        "documents": docs, "chunking_runs": docs.select((F.col("doc_id") + 100).alias("run_id"), "doc_id"), "chunks": chunks,
        "labels": labels, "human_reviews": reviews,
        "chunk_embeddings": chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding")),
    }


@pytest.fixture
def filled(spark, tmp_path, tables):
    others = {"rubric_versions": spark.createDataFrame([(1, "r")], "rubric_id long, name string"),
              "audit_events": spark.createDataFrame([(1, "x")], "event_id long, event_type string")}
    project = store.create(str(tmp_path / "p"), buckets=8)
    return store.commit(spark, project, append={**store.with_documents(tables), **others})


def ids(spark, project, table, **kw):
    key = table_schema(table).fieldNames()[0]
    return sorted(r[key] for r in store.read(spark, project, table, **kw).select(key).collect())


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)


def test_all_tables_come_back(spark, filled, tables):
    again = store.latest(spark, filled.root)
    assert again == filled
    assert set(store.TABLE_NAMES) == set(TABLES)
    for t in TABLES:
        assert store.read(spark, again, t).columns == table_schema(t).fieldNames()
    assert ids(spark, again, "labels") == list(range(N * 6)) and ids(spark, again, "audit_events") == [1]
    some = store.touched(again, spark.createDataFrame([(3,), (4,)], "doc_id long"))
    near = store.read(spark, again, "human_reviews", only=some, with_doc=True).collect()
    assert {r.doc_id for r in near} >= {4} and all(r.label_id % N == r.doc_id for r in near)


@pytest.mark.parametrize("job,reference", [
    (store.delete_documents, lineage.delete_documents), (store.drop_chunking, lineage.drop_chunking),
    (store.bury, lineage.delete_documents)])
def test_cascades_equal_the_plain_ones(spark, filled, tables, job, reference):
    gone = spark.createDataFrame([(3,), (17,), (17,), (999,)], "doc_id long")
    after = job(spark, filled, gone)
    want = reference(tables, gone)
    for t in store.OF_DOCUMENTS:
        key = table_schema(t).fieldNames()[0]
        assert ids(spark, after, t) == sorted(r[key] for r in want[t].select(key).collect()), t
    assert ids(spark, filled, "labels") == list(range(N * 6))     # the state before is still there
    assert ids(spark, store.latest(spark, filled.root), "chunks") == ids(spark, after, "chunks")


def test_untouched_buckets_keep_their_files(spark, filled):
    gone = spark.createDataFrame([(3,)], "doc_id long")
    after = store.delete_documents(spark, filled, gone)
    hit = store.touched(filled, gone)
    assert len(hit) == 1
    assert all(versions == (1,) for (t, b), versions in after.parts.items() if b not in hit and t in store.OF_DOCUMENTS)


def test_cascade_moves_no_rows_to_find_them(spark, filled, monkeypatch):
    plans = []
    monkeypatch.setattr(store, "commit", lambda spark, project, replace, buckets: plans.extend(replace.values()))
    store.delete_documents(spark, filled, spark.createDataFrame([(3,)], "doc_id long"))
    assert len(plans) == len(store.OF_DOCUMENTS)
    for rows in plans:
        rows.collect()
        final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # The only exchange is that of the ids.
        assert final.count("BroadcastHashJoin") == 1 and final.count("Exchange hashpartitioning") <= 1


def test_buried_documents_cost_what_their_ids_cost(spark, filled):
    before = size(filled.root)
    after = store.bury(spark, filled, spark.createDataFrame([(5,)], "doc_id long"))
    assert size(filled.root) - before < 12_000 and 5 not in ids(spark, after, "documents")
    small = store.compact(spark, after)
    assert not [1 for t, _ in small.parts if t == store.BURIED]
    for t in store.OF_DOCUMENTS:
        assert ids(spark, small, t) == ids(spark, after, t)


def test_commits_on_one_state_collide(spark, filled):
    one = spark.createDataFrame([(5,)], "doc_id long")
    store.bury(spark, filled, one)
    with pytest.raises(Exception, match="(?i)exists"):
        store.bury(spark, filled, one)


def test_refused_rows(spark, filled, tables):
    with pytest.raises(ValueError, match="needs doc_id"):
        store.commit(spark, filled, append={"labels": tables["labels"]})
    with pytest.raises(ValueError, match="not replaced"):
        store.commit(spark, filled, replace={"documents": tables["documents"]}, buckets=[1])
    assert store.latest(spark, filled.root) == filled


def test_a_job_that_dies_leaves_the_project_as_it_was(spark, filled, monkeypatch):
    monkeypatch.setattr(store, "_filled", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.delete_documents(spark, filled, spark.createDataFrame([(3,)], "doc_id long"))
    assert store.latest(spark, filled.root) == filled and 3 in ids(spark, filled, "documents")
