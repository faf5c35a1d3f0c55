"""Doc maps: include and exclude rules over a file listing (A2-A4).

The rules of all maps are a trie of their path segments, which comes to the paths: a
path walks it once and meets only rules that start as it does, however many maps there
are. Paths are neither exploded nor joined, so no folder can be a hot key. A trie holds
rules up to a size. Beyond it rules and paths are joined: each rule stands under one
name, or literal start of a name, that every path it matches must have, and of those it
has under the one that fewest paths have.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import arrays, text
from corpusloom.schemas import SUPPORTED_EXTENSIONS
from corpusloom.shipping import ship_package
from corpusloom.sources.files import extension
from corpusloom.sources.rule_trie import DEEP, FRONT, GLOB, LITERAL, RuleTrie

# Characters of patterns whose trie goes to the tasks; more are joined.
TRIE_CHARS = 1 << 20
VARIABLE = r"\$(?:\w+|\{[^}]*\})"


def parse_doc_map(maps: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """A2: rules ``line_no, pattern, is_exclude`` of doc-map texts in ``value``.

    Blank lines, ``#`` lines and a lone ``!`` give no rule. ``keys`` are columns
    to keep when several maps are parsed at once.
    """
    lines = maps.select(
        *keys, F.posexplode(F.split("value", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)).alias("i", "raw")
    )
    line = text.strip(F.col("raw"))
    excludes = F.startswith(line, F.lit("!"))
    return (
        lines.where((line != "") & ~F.startswith(line, F.lit("#")))
        .select(
            *keys,
            (F.col("i") + 1).alias("line_no"),
            F.when(excludes, text.strip(F.substring(line, F.lit(2), F.length(line)))).otherwise(line).alias("pattern"),
            excludes.alias("is_exclude"),
        )
        .where("pattern <> ''")
    )


def expand_patterns(rules: DataFrame, base_dir: str | Column, *, home: str | None = None,
                    env: Mapping[str, str] | None = None) -> DataFrame:
    """A3: expand ``$VAR`` and ``~`` and resolve against the map's folder: ``target``.

    Variables have the values in ``env``, such as ``os.environ``; others stay as
    they are written.
    """
    home = os.path.expanduser("~") if home is None else home
    pattern = F.col("pattern")
    if env:
        table = F.create_map(*[F.lit(x) for kv in sorted(env.items()) for x in kv])
        value = lambda r: F.coalesce(F.try_element_at(table, F.regexp_replace(r, r"[${}]", "")), r)
        pattern = arrays.split_with_gaps(
            pattern, VARIABLE, lambda gaps, refs: _weave(gaps, F.transform(refs, value))
        )
    expanded = F.regexp_replace(pattern, r"\A~(?=/|\z)", home.replace("\\", "\\\\").replace("$", "\\$"))
    base = F.lit(base_dir) if isinstance(base_dir, str) else base_dir
    absolute = F.when(F.startswith(expanded, F.lit("/")), expanded).otherwise(
        F.concat_ws("/", F.rtrim(base, F.lit("/")), expanded)
    )
    # Empty and "." segments mean nothing; a trailing slash neither.
    tidy = F.filter(F.split(absolute, "/", -1), lambda s: (s != "") & (s != "."))
    return rules.withColumn("target", F.concat(F.lit("/"), F.array_join(tidy, "/")))


def _quote(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()+^$|*?])", r"\\$1")


def _weave(gaps: Column, marks: Column) -> Column:
    """Gap, mark, gap, mark, … as one text."""
    pairs = F.zip_with(
        gaps, marks, lambda g, m: F.array(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))
    )
    return F.array_join(F.flatten(pairs), "")


def _segment_regex(segment: Column) -> Column:
    """One path segment of a glob: ``*``, ``?`` and ``[…]`` stay inside it."""

    def as_regex(m: Column) -> Column:
        inner = F.substring(m, F.lit(2), F.length(m) - 2)
        negated = F.startswith(inner, F.lit("!"))
        members = F.regexp_replace(
            F.when(negated, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner),
            r"([\\\[\]&^])", r"\\$1",
        )
        return (
            F.when(F.startswith(m, F.lit("*")), F.lit("[^/]*"))
            .when(m == "?", F.lit("[^/]"))
            .otherwise(F.concat(F.when(negated, F.lit("[^/")).otherwise(F.lit("[")), members, F.lit("]")))
        )

    return arrays.split_with_gaps(
        segment, r"\[!?\]?[^\]/]*\]|\*+|\?",
        lambda gaps, marks: _weave(F.transform(gaps, _quote), F.transform(marks, as_regex)),
    )


def compile_patterns(rules: DataFrame) -> DataFrame:
    """A3: adds ``segments``, an array of ``struct<kind,text>``, and ``whole``.

    Without wildcards the target is a file or a folder, and a folder means all
    files beneath it (``whole``). ``**`` stands for any number of folders; at the
    end of a pattern it means all files beneath. Segments before the first
    wildcard are literal.
    """
    parts = F.filter(F.split("target", "/", -1), lambda s: s != "")
    wild = F.transform("_parts", lambda s: s.rlike(r"[*?]"))
    split = rules.withColumn("_parts", parts).withColumn("_wild", F.array_position(wild, True))
    literal = F.col("_wild") == 0
    full = F.when(F.element_at("_parts", -1) == "**", F.concat("_parts", F.array(F.lit("*")))).otherwise(F.col("_parts"))

    def segment(s: Column, i: Column) -> Column:
        deep, plain = s == "**", literal | (i < F.col("_wild") - 1) | ~s.rlike(r"[*?\[]")
        return F.struct(
            F.when(plain, LITERAL).when(deep, DEEP).otherwise(GLOB).alias("kind"),
            F.when(plain, s).when(deep, "").otherwise(_segment_regex(s)).alias("text"))

    return split.withColumn("segments", F.transform(full, segment)).withColumn("whole", literal).drop("_parts", "_wild")


def walked(files: DataFrame, rules: DataFrame, keys: list[str], decided: bool) -> DataFrame:
    """``path, rule`` rows beside the rules' ``keys``, or what a map decides.

    ``decided``: a row for each map that includes the path and does not exclude it.
    Otherwise a row for each rule that matches.
    """
    ship_package(files.sparkSession)
    rows = rules.select(*keys, "segments", "whole", "is_exclude").toArrow().to_pylist()
    owners = sorted({tuple(r[k] for k in keys) for r in rows}, key=repr)
    number = {o: i for i, o in enumerate(owners)}
    trie = RuleTrie()
    mine, excludes = [], []
    for i, r in enumerate(rows):
        trie.add(i, [(s["kind"], s["text"]) for s in r["segments"]], r["whole"])
        mine.append(number[tuple(r[k] for k in keys)])
        excludes.append(r["is_exclude"])
    shared = files.sparkSession.sparkContext.broadcast((trie, mine, excludes))

    @F.arrow_udf("array<int>")
    def owners_of(paths: pa.Array) -> pa.Array:
        trie, mine, excludes = shared.value
        out = []
        for path in paths.to_pylist():
            hits = trie.matches(path)
            out.append(sorted({mine[i] for i in hits if not (decided and excludes[i])}
                              - {mine[i] for i in hits if decided and excludes[i]}))
        return pa.array(out, pa.list_(pa.int32()))

    named = files.sparkSession.createDataFrame(
        [(i, *o) for i, o in enumerate(owners)],
        T.StructType([T.StructField("owner", T.IntegerType()), *rules.select(*keys).schema.fields]))
    hits = files.select("path", F.explode(owners_of("path")).alias("owner"))
    return hits.join(F.broadcast(named), "owner").drop("owner")


def _whole_regex(segments: Column, whole: Column) -> Column:
    """A rule as one pattern of whole paths."""
    parts = F.transform(segments, lambda s: F.when(s["kind"] == LITERAL, F.concat(F.lit("/"), _quote(s["text"])))
                        .when(s["kind"] == DEEP, F.lit("(?:/[^/]+)*")).otherwise(F.concat(F.lit("/"), s["text"])))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ""), F.when(whole, r"(?:/.*)?\z").otherwise(r"\z"))


def _anchors(segments: Column) -> Column:
    """What every path of a rule must have: whole names (with a slash) and starts of names; else the empty start."""
    front = lambda s: F.regexp_replace(F.regexp_extract(s["text"], "(?s)" + FRONT, 1), r"(?s)\\(.)", "$1")
    each = F.filter(F.transform(segments, lambda s: F.when(s["kind"] == LITERAL, F.concat(s["text"], F.lit("/")))
                                .when(s["kind"] == DEEP, F.lit("")).otherwise(front(s))), lambda a: a != "")
    return F.array_distinct(F.when(F.size(each) > 0, each).otherwise(F.array(F.lit(""))))


def joined(files: DataFrame, compiled: DataFrame, keys: list[str], decided: bool) -> DataFrame:
    """As ``walked``, for any number of rules."""
    rules = compiled.select(*keys, "is_exclude", _whole_regex(F.col("segments"), F.col("whole")).alias("_re"),
                            _anchors(F.col("segments")).alias("_anchors"))
    anchors = rules.select("_re", F.explode(arrays.rows_of("_anchors")).alias("_key")).distinct()
    # At most as many numbers as a name has characters.
    lengths = [r.n for r in anchors.where("not endswith(_key, '/')").select(
        F.length("_key").alias("n")).distinct().collect()]
    names = F.filter(F.split("path", "/", -1), lambda s: s != "")
    starts = F.transform("_names", lambda s: F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(s)),
        lambda n: F.substring(s, F.lit(1), n)))
    whole_names = F.transform("_names", lambda s: F.concat(s, F.lit("/")))
    paths = files.select("path", names.alias("_names")).select(
        "path", F.concat(F.lit("/"), F.array_join("_names", "/")).alias("_tidy"),
        F.explode(F.array_distinct(F.concat(whole_names, F.flatten(starts)))).alias("_key"))
    seen = paths.join(anchors.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = anchors.join(seen, "_key", "left").groupBy("_re").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_a")).select("_re", F.col("_a._key").alias("_key"))
    hits = paths.join(rarest, "_key").where(F.rlike("_tidy", F.col("_re"))).select("path", "_re")
    matches = hits.join(rules.drop("_anchors"), "_re")
    if not decided:
        return matches.select(*keys, "path")
    return matches.groupBy(*keys, "path").agg(F.bool_or("is_exclude").alias("_out")).where("not _out").drop("_out")


def with_matches(files: DataFrame, compiled: DataFrame, keys: list[str], decided: bool) -> DataFrame:
    """``walked`` while the rules' trie is small, else ``joined``."""
    size = compiled.agg(F.coalesce(F.sum(F.length("target")), F.lit(0))).first()[0]
    return (walked if size <= TRIE_CHARS else joined)(files, compiled, keys, decided)


def resolve_doc_map(listing: DataFrame, compiled: DataFrame, *, keys: Iterable[str] = (),
                    extensions: Iterable[str] = SUPPORTED_EXTENSIONS, ordered: bool = False) -> DataFrame:
    """A3: included and not excluded files, each once; excludes always win."""
    keys = list(keys)
    files = listing.where(extension(F.col("path")).isin(sorted(extensions)))
    one = compiled if keys else compiled.withColumn("_map", F.lit(1))
    chosen = with_matches(files, one, keys or ["_map"], decided=True).select(*keys, "path").distinct()
    return chosen.orderBy(*keys, "path") if ordered else chosen


def unmatched_rules(listing: DataFrame, compiled: DataFrame, *, keys: Iterable[str] = ()) -> DataFrame:
    """A4: include rules that match no file of any extension."""
    keys = list(keys)
    includes = compiled.where("not is_exclude")
    seen = with_matches(listing, includes, [*keys, "line_no"], decided=False).select(*keys, "line_no").distinct()
    return includes.join(seen, [*keys, "line_no"], "left_anti").select(*keys, "line_no", "pattern")


def load_doc_map(spark: SparkSession, path: str, *, home: str | None = None,
                 env: Mapping[str, str] | None = None) -> DataFrame:
    """A2, A3: the compiled rules of a doc-map file. A missing file is an error."""
    value = spark.read.text(path, wholetext=True)
    base = os.path.dirname(os.path.abspath(path)) if "://" not in path else path.rsplit("/", 1)[0]
    return compile_patterns(expand_patterns(parse_doc_map(value), base, home=home, env=env))
