"""From files on disk to an exported corpus."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import udf_embedder
from corpusloom.operators import reviews, scoring, semantic_chunks, structure
from corpusloom.plans import export, ingest, labeling
from corpusloom.schemas import table_schema
from corpusloom.sources import rubric_json
from corpusloom.sources import tables as store
from corpusloom.workload.queries.labeling import letter_encoder


def empty(spark, name):
    return spark.createDataFrame([], table_schema(name))


def test_files_to_corpus(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# Top\n\nFirst part. It is long enough.\n\n## Next\n\nSecond part here.", encoding="utf-8")
    (src / "sub/copy.md").write_bytes((src / "a.md").read_bytes())
    (src / "b.txt").write_text("Plain text of one line.", encoding="utf-8")
    (src / "bad.pdf").write_bytes(b"%PDF")
    got = ingest.ingest(spark, empty(spark, "documents"), str(src))
    docs = {r.filename: r for r in got.documents.collect()}
    assert set(docs) == {"copy.md", "b.txt", "bad.pdf"}          # the last copy names the row
    assert docs["bad.pdf"].status == "failed" and docs["copy.md"].status == "parsed"
    assert len({r.doc_id for r in docs.values()}) == 3
    store.append_table(got.documents, str(tmp_path / "docs"), "documents", buckets=2)
    documents = store.read_table(spark, str(tmp_path / "docs"), "documents")
    again = ingest.ingest(spark, documents, str(src))
    assert {r.action for r in again.outcome.where("path not like '%.pdf'").collect()} == {"unchanged"}

    tables = {n: empty(spark, n) for n in ("chunking_runs", "chunks", "labels", "human_reviews", "chunk_embeddings")}
    tables["documents"] = documents
    good = documents.where("status = 'parsed'")
    with pytest.raises(ValueError):
        labeling.rechunk(tables, good, strategy="semantic", job_no=1)
    tables |= labeling.rechunk(tables, good, strategy="structural", job_no=1, min_tokens=1)
    assert sorted(r.n_chunks for r in tables["chunking_runs"].collect()) == [1, 2]

    rubric_text = json.dumps({"categories": [{"name": "procedure", "definition": "Steps.", "exemplars": ["part one"]}, {"name": "fact"}]})
    rubrics = rubric_json.parse_rubrics(spark.createDataFrame([(1, "r", 1, rubric_text)], "rubric_id long, name string, version int, json string")).rubrics
    todo = labeling.open_requests(tables, 1)
    assert todo.count() == 3 and "[Section: Top > Next]" in "".join(r.user_prompt for r in todo.collect())
    reply = json.dumps({"predicted_categories": ["procedure"], "confidence_per_category": {"procedure": 0.9}, "rationale": "x"})
    replies = todo.select("chunk_id", F.lit(reply).alias("response"), F.array(F.lit(-0.1)).alias("logprobs"))
    embedder = udf_embedder(letter_encoder)
    tables["chunk_embeddings"] = scoring.embed_chunks(tables["chunks"], embedder, "letters").cache()
    exemplars = spark.createDataFrame([(1, "procedure", 0, "part one"), (1, "fact", 1, "zzz")], "rubric_id long, category string, rubric_pos int, t string").withColumn(
        "embedding", F.get(embedder(F.array("t")), F.lit(0)))
    labeled = labeling.label(tables, replies.unionByName(replies), rubric_id=1, llm_model="m", llm_run_id="r1",
                             centroids=scoring.exemplar_centroids(exemplars))
    store.append_table(labeled, str(tmp_path / "labels"), "labels")
    tables["labels"] = store.read_table(spark, str(tmp_path / "labels"), "labels")
    assert tables["labels"].count() == 3
    assert {round(r.composite_confidence, 6) for r in tables["labels"].collect()} == {round(min(1, 0.9 * 1.05 * 1.03), 6)}
    assert labeling.open_requests(tables, 1).count() == 0

    tables["human_reviews"] = reviews.bypass_unreviewed(tables["labels"], tables["human_reviews"], 1)
    project = str(uuid.uuid4())
    export.export_corpus(tables, rubrics, str(tmp_path / "out"), rubric_id=1, project_uuid=project)
    head = spark.read.json(str(tmp_path / "out/manifest")).first()
    assert (head.total_chunks, head.labeled_chunks, head.reviewed_chunks, head.embeddings.sidecar.rows) == (3, 3, 3, 3)
    records = spark.read.json(str(tmp_path / "out/chunks"))
    side = spark.read.parquet(str(tmp_path / "out/corpus_embeddings.parquet"))
    assert records.join(side, "chunk_uuid").count() == 3


def test_ingest_opens_only_what_it_must(spark, tmp_path):
    """Unchanged and unwanted files are never opened, new and changed ones once."""
    src, log = tmp_path / "in", tmp_path / "log"
    src.mkdir()

    def opener(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        with open(path, "rb") as f:
            return f.read()

    def opened():
        names = Counter(os.path.basename(p) for p in log.read_text().split("\n") if p) if log.exists() else Counter()
        log.unlink(missing_ok=True)
        return names

    for name, body in {"a.md": "# A\n\nText.", "b.txt": "Plain.", "c.txt": "Plain.", "no.png": "x", "skip.txt": "s", "bad.pdf": "%"}.items():
        (src / name).write_text(body)
    (src / "m.docmap").write_text("*\n!skip.txt\n")
    run = lambda table, ledger: ingest.ingest(
        spark, table, str(src), doc_map=str(src / "m.docmap"), ledger=ledger, opener=opener)

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first = run(empty(spark, "documents"), None)
    table, ledger = stored(first.documents, "d1"), stored(first.ledger, "l1")
    assert opened() == {"a.md": 1, "b.txt": 1, "c.txt": 1, "bad.pdf": 1}
    assert {r.filename: r.status for r in table.collect()} == {"a.md": "parsed", "c.txt": "parsed", "bad.pdf": "failed"}
    assert [(r.path[-7:], r.error) for r in first.failures.collect()] == [("bad.pdf", "unsupported format: .pdf")]

    again = run(table, ledger)
    assert again.documents.count() == 3 and opened() == {}

    (src / "b.txt").write_text("Another text.")
    (src / "d.txt").write_text("New.")
    second = run(table, ledger)
    table2, ledger2 = stored(second.documents, "d2"), stored(second.ledger, "l2")
    assert opened() == {"b.txt": 1, "d.txt": 1}
    assert {r.full_text for r in table2.collect()} == {"# A\n\nText.", "Plain.", "Another text.", "New.", None}
    assert ledger2.count() == 5 and len({r.doc_id for r in table2.collect()}) == 5

    # The ledger knows a content that the table has lost: it is opened again.
    lost = run(table2.where("filename <> 'a.md'"), ledger2)
    assert {r.filename for r in lost.documents.collect()} >= {"a.md", "d.txt"} and opened() == {"a.md": 1}


def test_vectorized_embedder_matches_spread(spark):
    text = " ".join(f"Sentence {i} about things." for i in range(600))
    docs = structure.with_structure(spark.createDataFrame(
        [(0, "a.txt", "txt", text), (1, "b.txt", "txt", "One only."), (2, "c.txt", "txt", "")],
        "doc_id long, filename string, format string, full_text string"))
    embedder = udf_embedder(letter_encoder, batch_size=7)
    cols = ["doc_id", "ord", "text", "char_start", "char_end", "token_count"]
    one = semantic_chunks.semantic_chunks(docs, embedder, max_tokens=40, min_tokens=5, similarity_threshold=0.9)
    two = semantic_chunks.semantic_chunks(docs, embedder, max_tokens=40, min_tokens=5, similarity_threshold=0.9, spread=True)
    rows = lambda df: sorted(tuple(r) for r in df.select(cols).collect())
    assert rows(one) == rows(two) and len(rows(one)) > 50
