"""Rubric versions and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.positions import number_rows


def version_rubrics(edits: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Turn saved edits ``(edit_id, name, categories…)`` into versions.

    Every save of a name adds a row whose version follows the highest one on
    record; ``edit_id`` gives the order and becomes the rubric id.
    """
    numbered = number_rows(edits, ["name"], "edit_id", out="version")
    if existing is not None:
        base = existing.groupBy("name").agg(F.max("version").alias("_base"))
        numbered = numbered.join(base, "name", "left").withColumn(
            "version", F.col("version") + F.coalesce("_base", F.lit(0))
        ).drop("_base")
    return numbered.withColumn("version", F.col("version").cast("int")).withColumnRenamed(
        "edit_id", "rubric_id"
    )


def latest_rubrics(versions: DataFrame) -> DataFrame:
    """The newest version of each rubric name."""
    newest = versions.groupBy("name").agg(F.max("rubric_id").alias("rubric_id"))
    return versions.join(newest.select("rubric_id"), "rubric_id", "left_semi")


def active_rubric(versions: DataFrame) -> DataFrame:
    """The newest row of all."""
    return versions.where(F.col("rubric_id") == versions.agg(F.max("rubric_id")).scalar())


def list_versions(versions: DataFrame) -> DataFrame:
    """All versions, oldest first."""
    return versions.orderBy("version", "rubric_id")


def validate_rubrics(categories: DataFrame) -> DataFrame:
    """Violations of rubrics given as one row per category ``(rubric_id, name)``.

    A rubric without categories is a row with a null name.
    """
    per_name = categories.groupBy("rubric_id", "name").agg(F.count("*").alias("n"))
    per_rubric = per_name.groupBy("rubric_id").agg(
        F.count_if(F.col("name").isNotNull()).alias("n_names"),
        F.count_if(F.col("name").isNotNull() & (F.col("n") > 1)).alias("n_repeated"),
        F.count_if(F.btrim("name") == "").alias("n_blank"),
    )
    rules = F.filter(
        F.array(
            F.when(F.col("n_names") == 0, "no category"),
            F.when(F.col("n_repeated") > 0, "category names must be unique"),
            F.when(F.col("n_blank") > 0, "category name is empty"),
        ),
        lambda r: r.isNotNull(),
    )
    return per_rubric.select("rubric_id", F.explode(rules).alias("violation"))


def explode_categories(rubrics: DataFrame) -> DataFrame:
    """One row per category with its place in the rubric."""
    return rubrics.select("rubric_id", F.posexplode("categories").alias("pos", "c")).select(
        "rubric_id", "pos", "c.*"
    )


def rubric_payload(rubrics: DataFrame) -> DataFrame:
    """The rubric as exported: name, version, five fields per category."""
    fields = ("name", "definition", "exemplars", "boundary_cases", "confidence_threshold")
    return rubrics.select(
        "name",
        "version",
        F.transform("categories", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias(
            "categories"
        ),
    )
