from __future__ import annotations

import random

import corpus_pipeline
import pytest
from samples import ODD, prose

from corpusloom.llm.queries import QUERIES

EXTRA = ("place", "key", "kept")


@pytest.fixture
def folder(spark, make, tmp_path):
    def write(rows, items):
        make(rows).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/out-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    return out


def test_each_stage_does_its_work(spark, folder):
    rng = random.Random(1)
    rows = [(i, " ".join(prose(i, 60)) + ".") for i in range(30)]
    near = rows[4][1].split()
    near[30] = "changed"
    item = " ".join(prose(900, 20))
    rows += [(40, rows[3][1]), (41, " ".join(near)), (42, f"{rows[7][1][:50]} {item.title()} {rows[8][1][:60]}"),
             (43, " ".join(prose(43, 20)) + " password=abcdefgh99 " + " ".join(prose(44, 20)))]
    rows += [(None if i is None else 1000 + i, t) for i, t in ODD]
    rng.shuffle(rows)
    out = stages(spark, folder(rows, [(1, item)]))
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in out.items() if name != "packing"}
    assert not {1001, 1002, 1003, 1011} & set(ids["language_id"]) and set(range(30)) <= set(ids["language_id"])
    assert not {40, 41, 1008} & set(ids["near_dedup"]) and set(range(30)) <= set(ids["near_dedup"])
    assert ids["near_dedup"].count(1007) == 1 and None in ids["near_dedup"]
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {42}
    texts = {r.doc_id: (r.text, r.n_chars) for r in out["secret_scan"].collect()}
    assert sorted(map(str, texts)) == sorted(map(str, set(ids["decontamination"])))
    assert "[SECRET]" in texts[43][0] and texts[43][1] == len(texts[43][0]) and texts[3][0] == dict(rows)[3]
    assert {r.doc_id for r in out["packing"].collect()} == set(texts)


def test_run_equals_the_stages_and_takes_empty_tables(spark, folder):
    sf_dir = folder([], [(1, "kan lor")])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
