"""Classification requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.labels import unlabeled_chunks

# The wording of the request around the rubric and the text.
SYSTEM_HEAD = """You are a text classification assistant. Given a text chunk, classify it into one or more of the following categories.

CATEGORIES:
"""
SYSTEM_TAIL = """

INSTRUCTIONS:
- Analyze the chunk carefully against each category definition.
- Assign the most appropriate category or categories.
- Provide a confidence score (0.0 to 1.0) for each assigned category.
- Write a brief rationale explaining your classification.

Respond with valid JSON only, no other text:
{
  "predicted_categories": ["category_name"],
  "confidence_per_category": {"category_name": 0.95},
  "rationale": "Brief explanation of why this classification was chosen."
}"""
USER_HEAD = "Classify this text chunk:\n\n"
MAX_EXEMPLARS = 3
MAX_BOUNDARY_CASES = 2


def classification_text(section_path: Column, body: Column) -> Column:
    """D3: the chunk text under its section path, if it has one."""
    prefix = F.concat(F.lit("[Section: "), F.array_join(section_path, " > "), F.lit("]\n\n"))
    return F.when(F.size(section_path) > 0, F.concat(prefix, body)).otherwise(body)


def system_prompt(categories: Column) -> Column:
    """The rubric as instructions to a classifier."""

    def extra(lead: str, items: Column, limit: int, quote: str) -> Column:
        shown = F.transform(
            F.slice(items, 1, limit), lambda e: F.concat(F.lit(quote), e, F.lit(quote))
        )
        return F.when(
            F.size(items) > 0, F.concat(F.lit(f"\n  {lead}: "), F.array_join(shown, "; "))
        ).otherwise("")

    def entry(c: Column) -> Column:
        return F.concat(
            F.lit("- **"), c["name"], F.lit("**: "), c["definition"],
            extra("Examples", c["exemplars"], MAX_EXEMPLARS, '"'),
            extra("Boundary cases", c["boundary_cases"], MAX_BOUNDARY_CASES, ""),
        )

    listing = F.array_join(F.transform(categories, entry), "\n\n")
    return F.concat(F.lit(SYSTEM_HEAD), listing, F.lit(SYSTEM_TAIL))


def rubric_prompts(rubrics: DataFrame) -> DataFrame:
    """One system prompt per rubric."""
    return rubrics.select("rubric_id", system_prompt(F.col("categories")).alias("system_prompt"))


def classification_requests(chunks: DataFrame, runs: DataFrame, labels: DataFrame,
                            rubric_id: int) -> DataFrame:
    """What to send for every chunk the rubric has not labeled yet.

    The system prompt is the same for all rows of a rubric. It is one row of
    ``rubric_prompts``, named by ``rubric_id``, and not repeated for each chunk.
    """
    todo = unlabeled_chunks(chunks, runs, labels, rubric_id)
    text = classification_text(F.col("section_path"), F.col("text"))
    return todo.select(
        "chunk_id",
        F.lit(rubric_id).cast("long").alias("rubric_id"),
        F.concat(F.lit(USER_HEAD), text).alias("user_prompt"),
    )
