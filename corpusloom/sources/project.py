"""A project's tables in aligned buckets, changed together.

Every row stands in the bucket of its document: labels, reviews and vectors carry
their document's id in the files, though it is no column of theirs. A job on some
documents reads and rewrites only their buckets, in every table, and finds a
document's rows in all tables by ``doc_id`` alone, without a walk over chunk and
label ids. Tables without documents have one bucket.

Files are never changed. A commit writes new ones and then a manifest: which files
make up each bucket of each table. The manifest is the commit; a job that dies before
it leaves the project as it was, and readers of one manifest see all tables at one
point in time. Two commits on one state collide on the manifest's name, and the later
one fails.

Deletes can be cheap: ``bury`` records document ids, which readers leave out, and
``compact`` rewrites the buckets they are in later.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schemas import table_schema
from corpusloom.sources.tables import conform, doc_bucket

OF_DOCUMENTS = ("documents", "chunking_runs", "chunks", "chunk_embeddings", "labels", "human_reviews")
TABLE_NAMES = (*OF_DOCUMENTS, "rubric_versions", "audit_events")
# Ids of deleted documents, a table of the project like the others.
BURIED = "buried"
MANIFEST = "table string, bucket int, version int"


class Project(NamedTuple):
    """A project below ``root`` as of one ``version``; ``parts`` has table, bucket → versions of files."""

    root: str
    buckets: int
    version: int
    parts: Mapping[tuple[str, int], tuple[int, ...]]


def create(root: str, buckets: int = 256) -> Project:
    """An empty project; its first commit creates it."""
    return Project(root.rstrip("/"), buckets, 0, {})


def latest(spark: SparkSession, root: str) -> Project:
    """The project as of its last whole commit."""
    root = root.rstrip("/")
    rows = spark.read.parquet(f"{root}/manifest")
    last = rows.where(rows["commit"] == rows.agg(F.max("commit")).scalar()).collect()
    parts: dict[tuple[str, int], tuple[int, ...]] = {}
    for r in last:
        if r.table:
            parts[r.table, r.bucket] = (*parts.get((r.table, r.bucket), ()), r.version)
    return Project(root, last[0].buckets, last[0].commit, parts)


def touched(project: Project, doc_ids: DataFrame) -> list[int]:
    """Buckets of some documents, at most as many numbers as there are buckets."""
    return sorted(r.b for r in doc_ids.select(doc_bucket(project.buckets).alias("b")).distinct().collect())


def _stored(spark: SparkSession, project: Project, table: str, only: Iterable[int] | None) -> DataFrame:
    """The rows in the files, with ``doc_id`` and ``bucket``; buried documents included."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _columns(table))
    wanted = None if only is None else set(only)
    paths = [f"{project.root}/{table}/v={v}/bucket={b}" for (name, b), versions in sorted(project.parts.items())
             if name == table and (wanted is None or b in wanted) for v in versions]
    if not paths:
        return spark.createDataFrame([], schema + ", bucket int")
    # The version folders stay out of the columns, the bucket is one.
    rows = [spark.read.schema(schema + ", bucket int").option("basePath", f"{project.root}/{table}/v={v}").parquet(
        *[p for p in paths if f"/v={v}/" in p]) for v in sorted({int(p.split("/v=")[1].split("/")[0]) for p in paths})]
    return reduce(DataFrame.unionByName, rows)


def _columns(table: str):
    if table == BURIED:
        return [T.StructField("doc_id", T.LongType())]
    own = list(table_schema(table).fields)
    return own if table not in OF_DOCUMENTS or any(f.name == "doc_id" for f in own) else [
        *own, T.StructField("doc_id", T.LongType())]


def read(spark: SparkSession, project: Project, table: str, *, only: Iterable[int] | None = None,
         with_doc: bool = False) -> DataFrame:
    """A10: a table without the rows of buried documents; ``only`` reads just these buckets.

    ``with_doc`` keeps ``doc_id`` where it is no column of the table.
    """
    rows = _stored(spark, project, table, only)
    if table in OF_DOCUMENTS and any(name == BURIED for name, _ in project.parts):
        rows = rows.join(_stored(spark, project, BURIED, only).select("doc_id").distinct(), "doc_id", "left_anti")
    names = table_schema(table).fieldNames()
    return rows.select(*names, *["doc_id"] * (with_doc and table in OF_DOCUMENTS and "doc_id" not in names))


def with_documents(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``doc_id`` beside labels, reviews and vectors that come without it, found over their chunks and labels.

    New rows pass here once, when they are written; nothing has to find it again.
    Rows whose chunk or label is unknown have none, and all go to one bucket.
    """
    out = dict(tables)
    for table, key, parent in (("chunk_embeddings", "chunk_id", "chunks"), ("labels", "chunk_id", "chunks"),
                               ("human_reviews", "label_id", "labels")):
        if table in out and "doc_id" not in out[table].columns:
            out[table] = out[table].join(out[parent].select(key, "doc_id").dropDuplicates([key]), key, "left")
    return out


def _placed(project: Project, table: str, rows: DataFrame) -> DataFrame:
    if table == BURIED:
        return rows.select("doc_id").withColumn("bucket", doc_bucket(project.buckets))
    if table not in OF_DOCUMENTS:
        return conform(rows, table).withColumn("bucket", F.lit(0))
    if "doc_id" not in rows.columns:
        raise ValueError(f"{table} needs doc_id beside its columns; see with_documents")
    own = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in _columns(table)])
    return own.withColumn("bucket", doc_bucket(project.buckets))


def commit(spark: SparkSession, project: Project, *, append: Mapping[str, DataFrame] | None = None,
           replace: Mapping[str, DataFrame] | None = None, buckets: Iterable[int] | None = None) -> Project:
    """A10: new rows beside the old ones, or whole new contents of ``buckets`` (all by default), in one step.

    Replaced rows must lie in ``buckets``: what lies elsewhere is refused. The rows may
    be read from the project itself, since its files stay. The rebalance hint puts
    a bucket's rows in few files and splits a bucket that is too large.
    """
    version, changes = project.version + 1, {**(append or {}), **(replace or {})}
    parts = {k: v for k, v in project.parts.items()}
    whole = set(range(project.buckets)) if buckets is None else set(buckets)
    for table in replace or {}:
        for b in whole if table in OF_DOCUMENTS or table == BURIED else {0}:
            parts.pop((table, b), None)
    for table, rows in changes.items():
        path = f"{project.root}/{table}/v={version}"
        _placed(project, table, rows).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy(
            "bucket").parquet(path)
        filled = _filled(spark, path)
        if replace and table in replace and table in OF_DOCUMENTS and not filled <= whole:
            raise ValueError(f"{table} has rows in buckets {sorted(filled - whole)[:5]} that are not replaced")
        for b in filled:
            parts[table, b] = (*parts.get((table, b), ()), version)
    rows = [(t, b, v) for (t, b), versions in sorted(parts.items()) for v in versions] or [(None, None, None)]
    manifest = spark.createDataFrame(rows, MANIFEST).withColumn("buckets", F.lit(project.buckets))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{project.root}/manifest/commit={version}")
    return project._replace(version=version, parts=parts)


def _filled(spark: SparkSession, path: str) -> set[int]:
    """Buckets that have files, from their folders' names alone."""
    return {r.bucket for r in spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect()}


# Ids of at most 8 MB go to every task, so that no row of a project's tables is shuffled.
BROADCAST_IDS = 1 << 20


def _without(project: Project, tables: Iterable[str], spark: SparkSession, doc_ids: DataFrame) -> Project:
    hit = touched(project, doc_ids)
    gone = doc_ids.select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = {t: read(spark, project, t, only=hit, with_doc=True).join(gone, "doc_id", "left_anti") for t in tables}
    return commit(spark, project, replace=left, buckets=hit)


def delete_documents(spark: SparkSession, project: Project, doc_ids: DataFrame) -> Project:
    """H1: documents and all that hangs on them go; only their buckets are read and written."""
    return _without(project, OF_DOCUMENTS, spark, doc_ids)


def drop_chunking(spark: SparkSession, project: Project, doc_ids: DataFrame) -> Project:
    """H2: as H1, but the documents stay."""
    return _without(project, OF_DOCUMENTS[1:], spark, doc_ids)


def bury(spark: SparkSession, project: Project, doc_ids: DataFrame) -> Project:
    """H1 at once: only the ids are written; readers leave their documents out."""
    return commit(spark, project, append={BURIED: doc_ids.select("doc_id").distinct()})


def compact(spark: SparkSession, project: Project, buckets: Iterable[int] | None = None) -> Project:
    """Rewrites buckets without buried documents and with few files; all that hold any by default."""
    hit = sorted({b for name, b in project.parts if name == BURIED} if buckets is None else set(buckets))
    left = {t: read(spark, project, t, only=hit, with_doc=True) for t in OF_DOCUMENTS}
    none = spark.createDataFrame([], "doc_id long")
    return commit(spark, project, replace={**left, BURIED: none}, buckets=hit)
