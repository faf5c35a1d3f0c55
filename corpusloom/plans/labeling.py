"""Documents → chunks → requests, and replies → labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import Embedder
from corpusloom.operators import labels, requests, runs, scoring
from corpusloom.operators.semantic_chunks import hybrid_chunks, semantic_chunks
from corpusloom.operators.structural_chunks import structural_chunks

STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "structural": structural_chunks,
    "semantic": semantic_chunks,
    "hybrid": hybrid_chunks,
}


def rechunk(tables: Mapping[str, DataFrame], docs: DataFrame, *, strategy: str, job_no: int,
            embedder: Embedder | None = None, **params) -> dict[str, DataFrame]:
    """Chunk ``docs`` and replace what hung on them; returns the changed tables.

    Clause chunking is a request and reply round of its own: see
    ``operators.clauses``; pass its chunks to ``runs.run_chunking``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    if strategy == "structural":
        chunks = structural_chunks(docs, **params)
    elif embedder is None:
        raise ValueError(f"the {strategy} strategy needs an embedder")
    else:
        chunks = STRATEGIES[strategy](docs, embedder, **params)
    recorded = {k: v for k, v in params.items() if k != "counter"}
    return runs.run_chunking(tables, docs, chunks, strategy=strategy, params=recorded, job_no=job_no)


def open_requests(tables: Mapping[str, DataFrame], rubric_id: int) -> DataFrame:
    """What is left to send to a model, beside the rubric's prompt; after a full round it is empty."""
    return requests.classification_requests(
        tables["chunks"], tables["chunking_runs"], tables["labels"], rubric_id
    )


def label(tables: Mapping[str, DataFrame], responses: DataFrame, *, rubric_id: int, llm_model: str,
          llm_run_id: str, centroids: DataFrame | None = None) -> DataFrame:
    """The label table with the labels that replies ``(chunk_id, response)`` yield.

    Replies to chunks that the rubric has labeled already are left out, so a
    batch that is delivered twice counts once. Of several replies to one chunk the
    smallest text counts, whichever task is repeated.
    """
    todo = labels.unlabeled_chunks(tables["chunks"], tables["chunking_runs"], tables["labels"], rubric_id)
    others = [c for c in responses.columns if c not in ("chunk_id", "response")]
    one = responses.groupBy("chunk_id").agg(
        F.min(F.struct("response", *others)).alias("r")).select("chunk_id", "r.*")
    scored = scoring.score_responses(
        one, todo, tables.get("chunk_embeddings"), centroids,
        rubric_id=rubric_id,
    )
    new = labels.assemble_labels(
        scored, rubric_id=rubric_id, llm_model=llm_model, llm_run_id=llm_run_id, existing=tables["labels"]
    )
    return tables["labels"].unionByName(new, allowMissingColumns=True)
