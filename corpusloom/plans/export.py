"""Labels → exported corpus folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import export, reviews, rubrics
from corpusloom.sources import tables as store

SIDECAR = "corpus_embeddings.parquet"


def export_corpus(tables: Mapping[str, DataFrame], rubric_table: DataFrame, path: str, *,
                  rubric_id: int, project_uuid: str, inline_embeddings: bool = False,
                  sidecar: bool = True) -> None:
    """Write records, manifest, rubric and, if wanted, the embedding sidecar.

    Output goes below ``path``, which must be new. The sidecar's figures for the
    manifest are read back from the file just written.
    """
    rubric = rubric_table.where(F.col("rubric_id") == rubric_id)
    head = rubric.select("name", "version").first()  # one row of a hand-written table
    if head is None:
        raise ValueError(f"rubric {rubric_id} not found")
    current = reviews.current_reviews(tables["human_reviews"])
    labels, chunks, docs = tables["labels"], tables["chunks"], tables["documents"]
    vectors = tables["chunk_embeddings"]
    info = None
    if sidecar:
        store.write_sidecar(
            export.sidecar_rows(labels, chunks, docs, vectors, rubric_id=rubric_id, project_uuid=project_uuid),
            f"{path}/{SIDECAR}",
        )
        info = export.sidecar_manifest(docs.sparkSession.read.parquet(f"{path}/{SIDECAR}"), SIDECAR)
    store.write_corpus_json(
        export.chunk_records(
            labels, chunks, docs, current, vectors, rubric_id=rubric_id,
            rubric_version=head.version, project_uuid=project_uuid, inline_embeddings=inline_embeddings,
        ),
        export.manifest(
            labels, current, chunks, rubric_id=rubric_id, rubric_name=head.name,
            rubric_version=head.version, project_uuid=project_uuid,
            inline_embeddings=inline_embeddings, sidecar=info,
        ),
        rubrics.rubric_payload(rubric),
        path,
    )
