"""Classification replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text
from corpusloom.schemas import DNB

# The rationales recorded when a reply names no category.
UNPARSED = "Failed to parse LLM response"
NO_MATCH = "No category match"


def parse_classification(response: Column) -> Column:
    """``struct<categories, confidence, rationale, parsed>`` of a reply.

    The reply may be fenced or have prose around the object. Without a JSON
    object, or without categories in it, the chunk does not belong (DNB).
    """
    body = text.strip_fences(response)
    whole = text.strict_json(body)
    inner = text.strict_json(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")))
    return _from_value(F.coalesce(whole, inner))


def _from_value(value: Column) -> Column:
    found = F.coalesce(text.variant_kind(value) == "OBJECT", F.lit(False))
    cats = F.coalesce(
        F.try_variant_get(value, "$.predicted_categories", "array<string>"),
        arrays.empty_array("string"),
    )
    conf = F.coalesce(
        F.try_variant_get(value, "$.confidence_per_category", "map<string,double>"),
        F.create_map().cast("map<string,double>"),
    )
    said = F.coalesce(F.try_variant_get(value, "$.rationale", "string"), F.lit(""))
    matched = found & (F.size(cats) > 0)
    why = F.when(~found, F.lit(UNPARSED)).when(said == "", F.lit(NO_MATCH)).otherwise(said)
    return F.struct(
        F.when(matched, cats).otherwise(F.array(F.lit(DNB))).alias("categories"),
        F.when(matched, conf).otherwise(F.create_map(F.lit(DNB), F.lit(1.0))).alias("confidence"),
        F.when(matched, said).otherwise(why).alias("rationale"),
        found.alias("parsed"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """D6 as a table job over ``responses(chunk_id, response, …)``."""
    parsed = responses.withColumn("_p", parse_classification(F.col("response")))
    return parsed.select(
        *responses.columns,
        F.col("_p.categories").alias("predicted_categories"),
        F.col("_p.confidence").alias("confidence"),
        F.col("_p.rationale").alias("rationale"),
        F.col("_p.parsed").alias("parsed"),
    )


def mean_logprob(logprobs: Column) -> Column:
    """Mean of the known token log-probabilities, null if there is none."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))
