"""Positions under hot keys, edits, labels, reviews, lineage, export."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.identity import uuid5
from corpusloom.functions.vectors import udf_embedder
from corpusloom.operators import (
    analytics, edits, export, labels, lineage, positions, requests, responses, reviews, rubrics, runs, scoring,
    vector_store,
)
from corpusloom.schemas import DNB
from corpusloom.sources import tables as store


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds nine of ten rows; blocks of 16 positions cut it up."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        doc = 0 if i % 10 else i
        rows.append((doc, i, i * rng.randint(1, 1) + 0, rng.choice("aab"), rng.random() < 0.1))
    return rows, spark.createDataFrame(rows, "doc_id long, chunk_id long, char_start int, status string, pending boolean").repartition(5)


def test_positions_under_a_hot_key(hot):
    rows, df = hot
    docs: dict[int, list] = {}
    for r in sorted(rows):
        docs.setdefault(r[0], []).append(r)
    got = {r.chunk_id: r.ord for r in positions.number_rows(df, ["doc_id"], "char_start", width=16).collect()}
    ahead = {r.chunk_id: r.next for r in positions.next_match(
        df, ["doc_id"], "char_start", F.col("pending"), "chunk_id", width=16).collect()}
    runs_ = {(r.doc_id, r.run_no): (r.status, r.run_start, r.run_end, r.n_rows)
             for r in positions.runs(df, ["doc_id"], "char_start", "status", width=16).collect()}
    for doc, mine in docs.items():
        run = 0
        for i, r in enumerate(mine):
            assert got[r[1]] == i + 1
            assert ahead[r[1]] == next((x[1] for x in mine[i + 1:] if x[4]), None)
            if i == 0 or mine[i - 1][3] != r[3]:
                run += 1
            s, a, z, _ = runs_[doc, run]
            assert s == r[3] and a <= r[2] <= z
    assert sum(v[3] for v in runs_.values()) == len(rows)


def test_dense_ids_are_stable(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = {r.h: r.n for r in positions.dense_ids(df, "h", digits=1).collect()}
    two = {r.h: r.n for r in positions.dense_ids(df.repartition(7), "h", digits=3).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 501))
    assert [one[h] for h in sorted(one)] == list(range(1, 501))


CHUNK = ("chunk_id long, doc_id long, run_id long, text string, char_start int, char_end int, section_path array<string>, "
         "token_count int, chunk_type string, boundary_confidence double, manual_override map<string,string>")


def chunk(i, doc, text, start, run=1, path=()):
    return (i, doc, run, text, start, start + len(text), list(path), max(1, len(text) // 4), "t", 0.5, None)


def test_merge(spark):
    c = spark.createDataFrame([chunk(1, 1, "first", 0), chunk(2, 1, "second", 10), chunk(3, 2, "other", 0)], CHUNK)
    out = edits.merge_chunks(c, spark.createDataFrame([(2, 1), (1, 3), (1, 99)], "chunk_id_a long, chunk_id_b long"))
    got = {r.chunk_id: r for r in out.chunks.collect()}
    assert set(got) == {1, 3} and got[1].text == "first\n\nsecond" and got[1].char_end == 16
    assert got[1].manual_override == {"action": "merge", "merged_chunk_id": "2"} and got[1].token_count == 3
    assert {r.chunk_id for r in out.touched.collect()} == {1, 2}
    assert sorted(r.reason for r in out.rejects.collect()) == ["chunk not found", "chunks from different documents"]


def test_edits_that_share_a_chunk_are_rejected(spark):
    c = spark.createDataFrame([chunk(i, 1, f"t{i} and more", 20 * i) for i in range(1, 7)], CHUNK)
    pairs = [(1, 2), (1, 3), (4, 4), (5, 6)]
    out = edits.merge_chunks(c, spark.createDataFrame(pairs, "chunk_id_a long, chunk_id_b long"))
    got = {r.chunk_id: r.text for r in out.chunks.collect()}
    assert got == {**{i: f"t{i} and more" for i in range(1, 5)}, 5: "t5 and more\n\nt6 and more"}
    assert sorted(r.reason for r in out.rejects.collect()) == [
        "chunk in several edits", "chunk in several edits", "chunk merged with itself"]
    cuts = edits.split_chunks(c, spark.createDataFrame([(1, 3), (1, 4), (2, 3), (3, 3)], "chunk_id long, offset int"))
    rows = sorted((r.char_start, r.text, r.chunk_id) for r in cuts.chunks.collect())
    assert "".join(t for _, t, _ in rows).replace(" ", "") == "".join(f"t{i}andmore" for i in range(1, 7))
    assert len({i for *_, i in rows}) == 8 and {i for *_, i in rows} == set(range(1, 9))
    assert cuts.rejects.count() == 2


def test_split(spark):
    body = "x" * 60 + "\n" + "y" * 20
    c = spark.createDataFrame([chunk(1, 1, "head  tail", 5), chunk(2, 1, body, 20), chunk(3, 1, "ab   ", 0), chunk(4, 1, "z", 0)], CHUNK)
    out = edits.split_chunks(c, spark.createDataFrame(
        [(1, 5), (2, None), (3, 3), (4, 1), (9, 1)], "chunk_id long, offset int"))
    got = sorted(((r.char_start, r.text, r.char_end, (r.manual_override or {}).get("action"), r.chunk_type)
                  for r in out.chunks.collect() if r.doc_id == 1 and r.manual_override))
    assert got == [(5, "head", 9, "split", "t"), (9, "tail", 13, "split_result", None),
                   (20, "x" * 60, 80, "split", "t"), (80, "y" * 20, 100, "split_result", None)]
    assert sorted(r.reason for r in out.rejects.collect()) == [
        "chunk not found", "invalid split offset", "split would leave an empty chunk"]


def test_default_split_place(spark):
    def model(t):
        mid = len(t) // 2
        for o in range(min(100, mid)):
            for at in (mid + o, mid - o):
                if 0 < at < len(t) and t[at] == "\n":
                    return at + 1
        return mid

    rng = random.Random(5)
    texts = ["", "a", "ab", "\n\n", "a\nb", "x" * 500] + [
        "".join(rng.choice("abcdefgh" * 8 + "\n") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", edits.default_split_offset(F.col("t")).alias("o")).collect():
        assert r.o == model(r.t), r.t


@pytest.fixture
def project(spark):
    c = spark.createDataFrame([chunk(i, i // 10, f"text {i}", i, run=i // 10) for i in (10, 11, 20, 21)]
                              + [chunk(12, 1, "stale", 0, run=0)], CHUNK)
    r = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "run_id long, doc_id long")
    l = spark.createDataFrame(
        [(100, 10, 1, ["a"], {"a": 0.9}, 0.9), (101, 11, 1, [DNB], {DNB: 1.0}, None), (200, 20, 1, [], {}, 0.2),
         (201, None, 1, ["a"], {"a": 0.5}, 0.5), (202, 20, 2, ["b"], {"b": 0.1}, 0.1), (203, 999, 1, ["zz"], {"zz": 0.4}, 0.4)],
        "label_id long, chunk_id long, rubric_id long, predicted_categories array<string>, confidence map<string,double>, composite_confidence double")
    l = l.withColumns({"rationale": F.lit(""), "knn_agreement": F.lit(None).cast("double"),
                       "logprob_signal": F.lit(None).cast("double"), "llm_model": F.lit("m")})
    h = spark.createDataFrame(
        [(1, 100, "u", "skip", [], "n", "2024-01-01"), (2, 100, "u", "correct", ["b", "c"], "n", "2024-01-02"), (3, None, "u", "flag", [], "n", "2024-01-01")],
        "review_id long, label_id long, reviewer string, action string, final_categories array<string>, notes string, reviewed_at string")
    d = spark.createDataFrame([(1, "one.md", "parsed"), (2, "two.md", "parsed"), (3, "three.md", "failed")], "doc_id long, filename string, status string")
    return {"documents": d, "chunking_runs": r, "chunks": c, "labels": l, "human_reviews": h}


def test_null_keys_do_not_empty_results(project):
    p = project
    todo = labels.unlabeled_chunks(p["chunks"], p["chunking_runs"], p["labels"], 1)
    assert [r.chunk_id for r in todo.collect()] == [21]
    queue = reviews.review_queue(p["chunks"], p["chunking_runs"], p["labels"], p["human_reviews"], 1)
    assert [r.label_id for r in queue.collect()] == [200]


def test_cascade_leaves_no_orphans(project):
    out = lineage.delete_documents(project, project["documents"].where("doc_id = 1"))
    ids = {k: {r[0] for r in out[k].select(c).collect()} for k, c in (
        ("documents", "doc_id"), ("chunks", "chunk_id"), ("labels", "label_id"), ("human_reviews", "review_id"), ("chunking_runs", "run_id"))}
    assert ids == {"documents": {2, 3}, "chunks": {20, 21}, "labels": {200, 201, 202, 203}, "human_reviews": {3}, "chunking_runs": {2}}


def test_rerun_replaces_and_keeps_other_documents(spark, project):
    new = spark.createDataFrame([(1, 1, "n1", 0, 2, [], 1, None), (1, 2, "n2", 2, 4, [], 1, None)],
        "doc_id long, ord int, text string, char_start int, char_end int, section_path array<string>, token_count int, boundary_confidence double")
    out = runs.run_chunking(project, project["documents"].where("doc_id in (1, 3)"), new, strategy="structural",
                            params={"max_tokens": 5, "_secret": object()}, job_no=7)
    got = {r.doc_id: r for r in out["chunking_runs"].where("strategy is not null").collect()}
    assert got[1].n_chunks == 2 and got[3].n_chunks == 0 and got[1].params == {"max_tokens": "5"}
    assert {r.text for r in out["chunks"].where("doc_id = 1").collect()} == {"n1", "n2"}
    assert out["chunks"].where("doc_id = 2").count() == 2 and out["labels"].where("label_id = 100").count() == 0


def test_review_rules(project):
    current = reviews.current_reviews(project["human_reviews"])
    assert {r.label_id: r.review_id for r in current.where("label_id is not null").collect()} == {100: 2}
    eff = {r.label_id: (r.categories, r.confidence, r.status) for r in reviews.effective_outcomes(project["labels"], current).collect()}
    assert eff[100] == (["b", "c"], 1.0, "correct") and eff[101] == ([DNB], 0.0, "unreviewed") and eff[200][0] == [DNB]
    new = reviews.bypass_unreviewed(project["labels"], current, 1)
    assert {r.label_id: r.final_categories for r in new.collect()}[101] == [DNB]
    assert reviews.bypass_unreviewed(project["labels"], current.unionByName(new.withColumn("reviewed_at", F.lit("x"))), 1).count() == 0


def test_coverage_and_flags(spark, project):
    cats = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "rubric_id long, pos int, name string")
    cov = analytics.category_coverage(project["labels"], project["chunks"], reviews.current_reviews(project["human_reviews"]), cats, 1, ordered=True)
    rows = cov.collect()
    assert [(r.name, r.in_rubric, r["count"], r.doc_count, r.review_count, r.disagree_pct) for r in rows] == [
        ("a", True, 1, 1, 1, 1.0), ("b", True, 0, 0, 0, 0.0), (DNB, False, 1, 1, 0, 0.0)]
    flags = {r.name: (r.orphan, r.dead, r.low_confidence) for r in analytics.coverage_flags(cov).collect()}
    assert flags == {"a": (False, False, False), "b": (False, True, False), DNB: (True, False, False)}
    unused = analytics.category_coverage(project["labels"].where("false"), project["chunks"], None, cats, 1)
    assert not any(r.dead for r in analytics.coverage_flags(unused).collect())


@pytest.mark.parametrize("reply,cats,why", [
    ('{"predicted_categories": ["a"], "confidence_per_category": {"a": 0.5}, "rationale": "r"}', ["a"], "r"),
    ('```json\n{"predicted_categories": ["a", "zz"]}\n```', ["a", "zz"], ""),
    ('Sure! {"predicted_categories": ["a"]} ok?', ["a"], ""),
    ('{"predicted_categories": [], "rationale": "none fit"}', [DNB], "none fit"),
    ('{"rationale": ""}', [DNB], responses.NO_MATCH),
    ('{"predicted_categories": null}', [DNB], responses.NO_MATCH),
    ('[{"predicted_categories": ["a"]}]', [DNB], responses.UNPARSED),
    ("{'predicted_categories': ['a']}", [DNB], responses.UNPARSED),
    ("{broken", [DNB], responses.UNPARSED), ("", [DNB], responses.UNPARSED), ('{"a":1} {"b":2}', [DNB], responses.UNPARSED),
])
def test_reply_parsing(spark, reply, cats, why):
    r = spark.createDataFrame([(reply,)], "r string").select(responses.parse_classification(F.col("r")).alias("p")).first().p
    assert (r.categories, r.rationale) == (cats, why)
    if cats == [DNB]:
        assert r.confidence == {DNB: 1.0}


@pytest.mark.parametrize("conf,knn,lp,want", [
    ({}, 1.0, 0.0, 0.0), ({"a": 0.5}, None, None, 0.5), ({"a": 0.5, "b": 0.9}, 1.0, None, 0.945), ({"a": 0.99}, 1.0, None, 1.0),
    ({"a": 0.9}, 0.0, None, 0.63), ({"a": 0.8}, 0.0, None, 0.68), ({"a": 0.5}, None, -0.4, 0.515), ({"a": 0.5}, None, -0.5, 0.5),
    ({"a": 0.5}, None, -1.6, 0.46), ({"a": 1.4}, None, None, 1.0), ({"a": -1.0}, None, None, 0.0), ({DNB: 1.0}, 0.0, None, 0.7),
])
def test_composite(spark, conf, knn, lp, want):
    df = spark.createDataFrame([(conf, knn, lp)], "c map<string,double>, k double, l double")
    assert df.select(scoring.composite_confidence(F.col("c"), F.col("k"), F.col("l"))).first()[0] == pytest.approx(want)


def test_agreement(spark):
    ex = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (1, "b", 1, [1.0, 0.0]), (1, "c", 2, [0.0, 2.0]), (1, "c", 2, [0.0, 0.0])],
                               "rubric_id long, category string, rubric_pos int, embedding array<float>")
    rows = spark.createDataFrame([(1, 1, [3.0, 0.0], ["a"]), (2, 1, [3.0, 0.0], ["b"]), (3, 1, [0.0, 1.0], ["c"]), (4, 1, None, ["a"]), (5, 2, [1.0, 0.0], ["a"])],
                                 "i int, rubric_id long, embedding array<float>, predicted_categories array<string>")
    got = {r.i: r.knn_agreement for r in scoring.knn_agreement(rows, scoring.exemplar_centroids(ex)).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: None, 5: 0.0}


def test_stage_outcomes(spark, project):
    attempts = spark.createDataFrame([(21, False)], "chunk_id long, ok boolean")
    p = project
    got = {r.doc_id: (r.total, r.done, r.failed, r.outcome) for r in labels.label_stage_report(
        p["documents"], p["chunks"], p["chunking_runs"], p["labels"], attempts, 1).collect()}
    assert got == {1: (2, 2, 0, "done"), 2: (2, 1, 1, "done"), 3: (0, 0, 0, "no chunks")}
    failed = labels.label_stage_report(p["documents"], p["chunks"], p["chunking_runs"], p["labels"].where("false"),
        spark.createDataFrame([(20, False), (21, False)], "chunk_id long, ok boolean"), 1, cancelled=True)
    assert {r.doc_id: r.outcome for r in failed.collect()} == {1: "cancelled", 2: "failed", 3: "no chunks"}


def test_rubric_versions(spark):
    first = rubrics.version_rubrics(spark.createDataFrame([(1, "r"), (2, "r"), (3, "s")], "edit_id long, name string"))
    assert sorted((r.name, r.version) for r in first.collect()) == [("r", 1), ("r", 2), ("s", 1)]
    more = rubrics.version_rubrics(spark.createDataFrame([(9, "r")], "edit_id long, name string"), first)
    assert [(r.rubric_id, r.version) for r in more.collect()] == [(9, 3)]
    assert [r.rubric_id for r in rubrics.active_rubric(first).collect()] == [3]


def test_prompt_shape(spark):
    cats = [("p", "Def.", ["e1", "e2", "e3", "e4"], ["b1", "b2", "b3"], 0.85, None), ("q", "Other.", [], [], 0.85, None)]
    df = spark.createDataFrame([(1, cats)], "rubric_id long, categories array<struct<name:string,definition:string,exemplars:array<string>,"
                               "boundary_cases:array<string>,confidence_threshold:double,parent:string>>")
    prompt = requests.rubric_prompts(df).first().system_prompt
    assert '- **p**: Def.\n  Examples: "e1"; "e2"; "e3"\n  Boundary cases: b1; b2\n\n- **q**: Other.\n\nINSTRUCTIONS' in prompt


def test_export_files(spark, project, tmp_path):
    project_id = str(uuid.uuid4())
    emb = spark.createDataFrame([(10, [0.1, 0.2, 0.3], "m1")], "chunk_id long, embedding array<float>, embedding_model string")
    current = reviews.current_reviews(project["human_reviews"])
    args = (project["labels"], project["chunks"], project["documents"], current, emb)
    recs = export.chunk_records(*args, rubric_id=1, rubric_version=4, project_uuid=project_id, inline_embeddings=True)
    by_chunk = {r.chunk_id: r for r in recs.collect()}
    assert set(by_chunk) == {10, 11, 20}                       # labels without a chunk are left out
    assert by_chunk[10].chunk_uuid == str(uuid.uuid5(uuid.UUID(project_id), "10"))
    assert by_chunk[10].label.human_review.action == "correct" and by_chunk[11].label.human_review is None
    side = export.sidecar_rows(project["labels"], project["chunks"], project["documents"], emb, rubric_id=1, project_uuid=project_id)
    assert tuple(side.columns) == export.SIDECAR_COLUMNS
    info = export.sidecar_manifest(side, "c_embeddings.parquet")
    head = export.manifest(project["labels"], current, project["chunks"], rubric_id=1, rubric_name="r", rubric_version=4,
                           project_uuid=project_id, sidecar=info)
    rubric = rubrics.rubric_payload(spark.createDataFrame([(1, "r", 4, [])], "rubric_id long, name string, version int, categories array<struct<name:string,definition:string,exemplars:array<string>,boundary_cases:array<string>,confidence_threshold:double,parent:string>>"))
    store.write_corpus_json(recs, head, rubric, str(tmp_path / "lines"))
    whole = spark.read.json(str(tmp_path / "lines/manifest")).first()
    assert whole.total_chunks == 3 and whole.labeled_chunks == 5
    assert whole.embeddings.sidecar.dim == 3 and whole.reviewed_chunks == 1
    assert {r.label_id for r in spark.read.json(str(tmp_path / "lines/chunks")).collect()} == {r.label_id for r in recs.collect()}
    store.write_sidecar(side, str(tmp_path / "e.parquet"), {"dim": 3, "models": ["m1"]})
    assert spark.read.parquet(str(tmp_path / "e.parquet")).schema["embedding"].metadata == {"dim": 3, "models": ["m1"]}
    assert dict(spark.read.parquet(str(tmp_path / "e.parquet")).dtypes)["embedding"] == "array<float>"
    shown = export.preview(*args, rubric_id=1, rubric_version=4, project_uuid=project_id, max_chunks=1).collect()
    assert len(shown) == 1 and shown[0].total_chunks == 5 and shown[0].sidecar_rows == 1


def test_uuid5(spark):
    ns = str(uuid.uuid4())
    df = spark.range(200).select("id", uuid5(ns, F.col("id").cast("string")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.UUID(ns), str(r.id))) for r in df.collect())


def test_texts_seen_before_are_not_embedded_again(spark, tmp_path):
    log = tmp_path / "log"

    def make():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float(len(t))] for t in texts]
        return encode

    def sent():
        lines = log.read_text().split() if log.exists() else []
        log.unlink(missing_ok=True)
        return sorted(lines)

    def chunks(texts):
        return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")

    embedder = udf_embedder(make)
    first = vector_store.embed_by_content(chunks(["a", "bb", "a", None, "cc"]), vector_store.empty_store(spark), embedder, "m")
    assert {r.chunk_id: list(r.embedding) for r in first.chunk_embeddings.collect()} == {0: [1.0], 1: [2.0], 2: [1.0], 4: [2.0]}
    assert sent() == ["a", "bb", "cc"]
    again = vector_store.embed_by_content(chunks(["a", "dddd", "cc", "dddd"]), first.added, embedder, "m")
    assert sorted(r.chunk_id for r in again.chunk_embeddings.collect()) == [0, 1, 2, 3] and sent() == ["dddd"]
    other = vector_store.embed_by_content(chunks(["a"]), first.added, embedder, "another")
    assert other.chunk_embeddings.count() == 1 and sent() == ["a"]
