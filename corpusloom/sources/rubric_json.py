"""Rubric JSON reader."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.schemas import CATEGORIES, DEFAULT_CONFIDENCE_THRESHOLD


class RubricParse(NamedTuple):
    rubrics: DataFrame  # input columns plus categories
    rejects: DataFrame  # input columns plus reason


def _category(v: Column) -> Column:
    def field(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}", kind), default).alias(name)

    none = F.array().cast("array<string>")
    return F.struct(
        F.variant_get(v, "$.name", "string").alias("name"),
        field("definition", "string", F.lit("")),
        field("exemplars", "array<string>", none),
        field("boundary_cases", "array<string>", none),
        field("confidence_threshold", "double", F.lit(DEFAULT_CONFIDENCE_THRESHOLD)),
        F.try_variant_get(v, "$.parent", "string").alias("parent"),
    )


def parse_rubrics(df: DataFrame, json_col: str = "json") -> RubricParse:
    """Rubrics from JSON texts: an object with ``categories``, or a bare array.

    Every category must be an object with a name. Texts that break a rule go to
    ``rejects`` with the reason.
    """
    keep = [c for c in df.columns if c != json_col]
    value = text.strict_json(F.col(json_col))
    parsed = df.withColumn("_v", value).withColumn("_kind", text.variant_kind(F.col("_v")))
    items = F.when(
        F.col("_kind") == "OBJECT",
        F.coalesce(F.try_variant_get("_v", "$.categories", "array<variant>"), F.array().cast("array<variant>")),
    ).when(F.col("_kind") == "ARRAY", F.try_variant_get("_v", "$", "array<variant>"))
    listed = parsed.withColumn("_items", items)
    objects = F.forall("_items", lambda i: text.variant_kind(i) == "OBJECT")
    named = F.forall(
        "_items", lambda i: F.coalesce(F.try_variant_get(i, "$.name", "string").isNotNull(), F.lit(False))
    )
    reason = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(F.col("_items").isNull(), "JSON must be an object or array")
        .when(~objects, "each category must be an object")
        .when(~named, "each category must have a name")
    )
    judged = listed.withColumn("reason", reason)
    good = judged.where("reason is null").select(
        *keep, F.transform("_items", _category).cast(CATEGORIES).alias("categories")
    )
    return RubricParse(good, judged.where("reason is not null").select(*keep, "reason"))
