"""File listings, content hashes and text conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.documents import basename
from corpusloom.operators.structure import with_structure
from corpusloom.schemas import SUPPORTED_EXTENSIONS

# Formats converted here. The other supported ones need a parser from the caller.
MARKDOWN = (".markdown", ".md")
PLAIN_TEXT = (".text", ".txt")


def extension(path: Column) -> Column:
    """Lowercase extension with its dot; names like ``.md`` have none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s).(\.[^.]+)\z", 1))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All regular files below a folder: ``path, length, modified_at``.

    Only metadata is read. Spark's listing leaves out names that start with
    ``.`` or ``_``. A missing folder is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        local_path(F.col("path")).alias("path"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )


def local_path(uri: Column) -> Column:
    """``file:/a`` and ``file:///a`` as ``/a``; other schemes as they are."""
    return F.regexp_replace(uri, r"\Afile:/+", "/")


def supported_files(listing: DataFrame, extensions: Iterable[str] = SUPPORTED_EXTENSIONS, *,
                    ordered: bool = False) -> DataFrame:
    """A1: the files of a listing that have a supported extension, by path."""
    hits = listing.where(extension(F.col("path")).isin(sorted(extensions)))
    return hits.orderBy("path") if ordered else hits


def scan_folder(spark: SparkSession, folder: str, *, ordered: bool = False) -> DataFrame:
    """A1: supported files below a folder."""
    return supported_files(list_folder(spark, folder), ordered=ordered)


def read_files(spark: SparkSession, paths: list[str] | str,
               extensions: Iterable[str] | None = None) -> DataFrame:
    """``path, content`` of files, or of all files below folders.

    With ``extensions`` other files are not even opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions is not None:
        either = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
        reader = reader.option("pathGlobFilter", "*{" + ",".join(map(either, sorted(extensions))) + "}")
    files = reader.load(paths)
    return files.select(local_path(F.col("path")).alias("path"), "content")


def open_path(path: str) -> bytes:
    """The bytes of one file: a local path, or a URI of a store that Arrow knows."""
    from pyarrow import fs

    store, inner = (fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path))
    with store.open_input_stream(inner, compression=None) as stream:
        return stream.read()


# Bytes that a task holds before it hands rows on; a larger file goes alone.
BATCH_BYTES = 8 << 20


def open_files(paths: DataFrame, opener: Callable[[str], bytes] = open_path) -> DataFrame:
    """``path, content, open_error``: exactly these files, each opened once, by the tasks.

    Where the list of paths lies decides how many tasks open files. A file that
    cannot be read has no content but the reason.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))],
                names=["path", "content", "open_error"])

        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    held.append((path, opener(path), None))
                except OSError as why:
                    held.append((path, None, f"cannot be read: {why.strerror or why}"))
                size += len(held[-1][1] or b"")
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return paths.select("path").mapInArrow(run, "path string, content binary, open_error string")


def content_hash(content: Column) -> Column:
    """Lowercase hex SHA-256 of the source bytes."""
    return F.sha2(content, 256)


def hash_files(files: DataFrame) -> DataFrame:
    """``path, source_hash``; contents go no further."""
    return files.select("path", content_hash(F.col("content")).alias("source_hash"))


def decode_text(content: Column, latin1_fallback: Column) -> Column:
    """UTF-8 text with ``\\n`` line ends.

    Bytes that are not UTF-8 are Latin-1 where allowed, else the text is null.
    """
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), as_text).when(
        latin1_fallback, F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(decoded, "\r\n?", "\n")


class Conversion(NamedTuple):
    documents: DataFrame  # converted rows with path and structure
    rejects: DataFrame    # path, error


def judged_files(files: DataFrame) -> DataFrame:
    """``path, source_hash, format, full_text, error`` in one pass over ``path, content``.

    Markdown must be UTF-8. Formats without a converter are rejected with the
    reason, as are files that do not decode, or could not be opened (``open_error``).
    """
    ext = extension(F.col("path"))
    is_md, is_txt = ext.isin(*MARKDOWN), ext.isin(*PLAIN_TEXT)
    kind = F.when(is_md, "md").when(is_txt, "txt")
    unread = F.col("open_error") if "open_error" in files.columns else F.lit(None).cast("string")
    return files.select(
        "path", content_hash(F.col("content")).alias("source_hash"), kind.alias("format"),
        F.when(kind.isNotNull(), decode_text(F.col("content"), is_txt)).alias("full_text"), unread.alias("_unread"),
    ).select(
        "path", "source_hash", "format", "full_text",
        F.coalesce("_unread", F.when(F.col("format").isNull(), F.concat(F.lit("unsupported format: "), ext)).when(
            F.col("full_text").isNull(), F.lit("not valid UTF-8"))).alias("error"),
    )


def convert_files(files: DataFrame) -> Conversion:
    """Convert ``path, content`` by extension."""
    return structured_files(judged_files(files))


def structured_files(judged: DataFrame) -> Conversion:
    """The good and the rejected rows of ``judged_files``; a caller who needs both writes it first."""
    good = judged.where("error is null").select(
        "path", basename(F.col("path")).alias("filename"), "format", "full_text", "source_hash")
    structured = with_structure(good)
    documents = structured.select(
        "path", "filename", "format", "full_text", "headings",
        F.array().cast("array<struct<page_number:int,char_start:int,char_end:int>>").alias("pages"),
        "sections",
        F.map_filter(
            F.create_map(
                F.lit("source"), F.col("path"),
                F.lit("clean_text_length"), F.col("clean_text_length").cast("string"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        F.lit("parsed").alias("status"),
        F.array().cast("array<string>").alias("warnings"),
        "source_hash",
    )
    return Conversion(documents, judged.where("error is not null").select("path", "error"))
