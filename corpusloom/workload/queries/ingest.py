"""Queries for sources, identity and structure (A, B, I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text
from corpusloom.functions.identity import uuid5
from corpusloom.operators import documents, lineage, structure
from corpusloom.schemas import DNB
from corpusloom.session import shared_folder, written
from corpusloom.sources import docmap, files, ledger, rubric_json
from corpusloom.sources import tables as store
from corpusloom.workload.registry import query
from corpusloom.workload.sql import cosine
from corpusloom.workload.tables import PROJECT_UUID, Tables
from corpusloom.functions import vectors


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def sha(c: Column | str) -> Column:
    return F.sha2(c, 256)


# ------------------------------------------------------------------ sources


@query("a1_supported_files", needs=["listing"], sql=r"""
    SELECT path FROM listing
    WHERE lower(regexp_extract(path, '\.[^./]+$')) IN ('.docx', '.markdown', '.md', '.pdf', '.text', '.txt')""")
def a1(t: Tables) -> DataFrame:
    return files.supported_files(t.listing())


MAP_TEXT_SQL = """
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"""


@query("a2_doc_map_rules", extra=[("l", MAP_TEXT_SQL), ("marked", """
    SELECT doc_id, i, CASE WHEN (i - 1) % 5 = 0 THEN '# ' WHEN (i - 1) % 3 = 1 THEN ' ! ' ELSE '  ' END || x AS raw FROM l""")],
    sql=r"""
    SELECT doc_id, i AS line_no, trim(regexp_replace(trim(raw), '^!', '')) AS pattern, trim(raw)[1] = '!' AS is_exclude
    FROM marked WHERE trim(raw) <> '' AND trim(raw)[1] <> '#' AND trim(regexp_replace(trim(raw), '^!', '')) <> ''""")
def a2(t: Tables) -> DataFrame:
    mark = lambda i: F.when(i % 5 == 0, "# ").when(i % 3 == 1, " ! ").otherwise("  ")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(mark(i), x))
    maps = t.given("documents").select("doc_id", F.array_join(lines, "\n").alias("value"))
    return docmap.parse_doc_map(maps, ["doc_id"])


def language_maps(t: Tables) -> DataFrame:
    """One doc map per language, with rules for every source of its texts."""
    lines = [
        F.concat("lang", F.lit("/"), "source", F.lit("/*.md")),
        F.concat("lang", F.lit("/**/*.txt")),
        F.lit("chat/?/**"),
        F.lit("chat/1*/user/*"),
        F.concat(F.lit("web/"), "source"),
        F.concat(F.lit("!*/"), "source", F.lit("/*[13579].md")),
    ]
    pairs = t.given("documents").select("lang", "source").distinct()
    maps = pairs.select("lang", F.concat_ws("\n", *lines).alias("v")).groupBy("lang").agg(
        F.array_join(F.array_sort(F.collect_list("v")), "\n").alias("value")
    )
    rules = docmap.parse_doc_map(maps, ["lang"])
    return docmap.compile_patterns(docmap.expand_patterns(rules, "/share", home="/home/u", env={}))


RULES_SQL = [("pairs", "SELECT DISTINCT lang, source FROM documents"), ("rules", r"""
    SELECT lang, '^/share/' || lang || '/' || source || '/[^/]*\.md$' AS re, false AS ex FROM pairs
    UNION SELECT lang, '^/share/' || lang || '/(.*/)?[^/]*\.txt$', false FROM pairs
    UNION SELECT lang, '^/share/chat/[^/]/.*$', false FROM pairs
    UNION SELECT lang, '^/share/chat/1[^/]*/user/[^/]*$', false FROM pairs
    UNION SELECT lang, '^/share/web/' || source || '(/.*)?$', false FROM pairs
    UNION SELECT lang, '^/share/[^/]*/' || source || '/[^/]*[13579]\.md$', true FROM pairs""")]


@query("a3_doc_map_files", needs=["listing"], extra=RULES_SQL, sql=r"""
    SELECT lang, path FROM listing, rules WHERE regexp_matches(path, re)
      AND lower(regexp_extract(path, '\.[^./]+$')) IN ('.docx', '.markdown', '.md', '.pdf', '.text', '.txt')
    GROUP BY lang, path HAVING bool_or(NOT ex) AND NOT bool_or(ex)""")
def a3(t: Tables) -> DataFrame:
    return docmap.resolve_doc_map(t.listing(), language_maps(t), keys=["lang"])


@query("a3_map_of_each_text", needs=["listing"], sql=r"""
    SELECT doc_id, path FROM documents d, (SELECT path, string_split(path, '/') AS p FROM listing
      WHERE lower(regexp_extract(path, '\.[^./]+$')) IN ('.docx', '.markdown', '.md', '.pdf', '.text', '.txt')) l
    WHERE (starts_with(path, '/share/' || d.lang || '/' || d.source || '/' || d.doc_id) OR starts_with(path, '/share/chat/' || d.doc_id || '/'))
      AND NOT (len(p) = 5 AND p[4] = d.source AND p[5] LIKE d.doc_id || '_.%')""")
def a3_each(t: Tables) -> DataFrame:
    """As many maps as texts: prefixes, a folder of a conversation, and an exclude that starts with a wildcard."""
    line = lambda *parts: F.concat(*[F.lit(x) if not x.isidentifier() else F.col(x) for x in parts])
    maps = t.given("documents").select("doc_id", F.concat_ws(
        "\n", line("lang", "/", "source", "/", "doc_id", "*"), line("chat/", "doc_id", "/"),
        line("!*/", "source", "/", "doc_id", "?.*")).alias("value"))
    rules = docmap.expand_patterns(docmap.parse_doc_map(maps, ["doc_id"]), "/share", home="/home/u")
    return docmap.resolve_doc_map(t.listing(), docmap.compile_patterns(rules), keys=["doc_id"])


@query("a4_unmatched_rules", needs=["listing"], extra=RULES_SQL, sql=r"""
    SELECT p.lang, p.pattern FROM (
      SELECT lang, lang || '/' || source || '/*.md' AS pattern, '^/share/' || lang || '/' || source || '/[^/]*\.md$' AS re FROM pairs
      UNION SELECT lang, 'web/' || source, '^/share/web/' || source || '(/.*)?$' FROM pairs) p
    WHERE NOT EXISTS (SELECT 1 FROM listing WHERE regexp_matches(path, p.re))""")
def a4(t: Tables) -> DataFrame:
    return docmap.unmatched_rules(t.listing(), language_maps(t), keys=["lang"]).select("lang", "pattern")


@query("a5_distinct_paths", sql="SELECT DISTINCT '/share/' || user_id || '/' || event_type AS path FROM events")
def a5(t: Tables) -> DataFrame:
    paths = t.given("events").select(
        F.concat(F.lit("/share/"), "user_id", F.lit("/"), "event_type").alias("path")
    )
    return documents.distinct_paths(paths)


@query("a6_content_hashes", sql="SELECT '/in/' || doc_id AS path, sha256(text) AS source_hash FROM documents")
def a6(t: Tables) -> DataFrame:
    return files.hash_files(t.given("documents").select(
        F.concat(F.lit("/in/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")
    ))


LEDGER_SQL = """
    SELECT DISTINCT ON (path) path, source_hash, length, modified_at FROM (
      SELECT '/in/' || doc_id AS path, sha256(text) AS source_hash, epoch_ms(doc_id * 1000) AS modified_at,
             strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS length FROM documents WHERE doc_id % 4 <> 0
      UNION ALL SELECT '/in/' || doc_id, sha256(source), epoch_ms(doc_id * 1000 - CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1000 END), strlen(text)
      FROM documents WHERE doc_id % 5 = 0) ORDER BY path, modified_at DESC"""


@query("a6_ledger_hashes", extra=[("last", LEDGER_SQL)], sql="""
    SELECT '/in/' || doc_id AS path, l.source_hash FROM documents LEFT JOIN last l
      ON l.path = '/in/' || doc_id AND l.length = strlen(text) AND l.modified_at = epoch_ms(doc_id * 1000)""")
def a6_ledger(t: Tables) -> DataFrame:
    """Listed files beside a ledger of two batches: unknown, changed and unchanged ones."""
    d, n = t.given("documents"), F.col("doc_id")
    path, size = F.concat(F.lit("/in/"), n).alias("path"), F.octet_length("text").cast("long")
    at = lambda s: F.timestamp_seconds(s).alias("modified_at")
    second = d.where(n % 4 != 0).select(
        path, (size + F.when(n % 3 == 0, 1).otherwise(0)).alias("length"), at(n), sha("text").alias("source_hash"))
    first = d.where(n % 5 == 0).select(
        path, size.alias("length"), at(n - F.when(n % 4 == 0, 0).otherwise(1)), sha("source").alias("source_hash"))
    listing = d.select(path, size.alias("length"), at(n))
    return ledger.with_known_hashes(listing, first.union(second)).select("path", "source_hash")


@query("a7_decoded_text", sql="SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_hash FROM documents")
def a7(t: Tables) -> DataFrame:
    """French texts as Latin-1 bytes where that can hold them; Windows line ends."""
    dos = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    latin = (F.col("lang") == "fr") & F.col("text").rlike(r"\A[\x00-\xFF]*\z")
    content = F.when(latin, F.encode(dos, "ISO-8859-1")).otherwise(F.encode(dos, "UTF-8"))
    d = t.given("documents").select("doc_id", content.alias("content"))
    decoded = files.decode_text(F.col("content"), F.lit(True))
    return d.select("doc_id", decoded.alias("t")).select(
        "doc_id", F.length("t").alias("n_chars"), sha("t").alias("text_hash")
    )


@query("a8_rubric_json", sql=f"""
    SELECT doc_id, CASE lang WHEN 'de' THEN 'each category must have a name' WHEN 'es' THEN 'invalid JSON' ELSE '' END AS reason,
           CASE lang WHEN 'en' THEN source WHEN 'fr' THEN source || '|' || doc_id ELSE '' END AS names,
           CASE lang WHEN 'en' THEN sha256(text) ELSE sha256('') END AS definition_hash,
           CASE lang WHEN 'en' THEN 0.85 WHEN 'fr' THEN 0.5 END AS threshold FROM documents""")
def a8(t: Tables) -> DataFrame:
    one = F.struct(F.col("source").alias("name"), F.col("text").alias("definition"))
    named = lambda c: F.struct(c.cast("string").alias("name"), F.lit(0.5).alias("confidence_threshold"))
    body = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(
            F.lit("r").alias("name"), F.array(one).alias("categories"))))
        .when(F.col("lang") == "fr", F.to_json(F.array(named(F.col("source")), named(F.col("doc_id")))))
        .when(F.col("lang") == "de", F.to_json(F.array(F.struct(F.col("text").alias("definition")))))
        .otherwise(F.col("text"))
    )
    good, bad = rubric_json.parse_rubrics(t.given("documents").select("doc_id", body.alias("json")))
    first = F.get("categories", F.lit(0))
    return good.select(
        "doc_id", F.lit("").alias("reason"), joined("categories.name").alias("names"),
        sha(first["definition"]).alias("definition_hash"), first["confidence_threshold"].alias("threshold"),
    ).unionByName(bad.select(
        "doc_id", "reason", F.lit("").alias("names"), sha(F.lit("")).alias("definition_hash"),
        F.lit(None).cast("double").alias("threshold"),
    ))


@query("a10_stored_chunks", needs=["chunks"], sql="""
    SELECT chunk_id, doc_id, run_id, sha256(text) AS text_hash, char_start, char_end,
           array_to_string(section_path, '|') AS section_path, token_count, chunk_type, boundary_confidence FROM chunks""")
def a10(t: Tables) -> DataFrame:
    """Written to the shared folder as a project table, and read back."""
    path = shared_folder(t.spark, "chunks")
    store.append_table(t.chunks(), path, "chunks", buckets=8)
    return store.read_table(t.spark, path, "chunks").select(
        "chunk_id", "doc_id", "run_id", sha("text").alias("text_hash"), "char_start", "char_end",
        joined("section_path").alias("section_path"), "token_count", "chunk_type", "boundary_confidence",
    )


# ----------------------------------------------------------------- identity


def hashed_texts(t: Tables) -> DataFrame:
    """doc_id, lang, n_chars, hash: identity is decided on these, so texts are hashed once."""
    d = t.given("documents")
    return written(d.select("doc_id", "lang", "n_chars", sha("text").alias("hash")), "hashes")


def existing_documents(hashed: DataFrame) -> DataFrame:
    """English and French texts already in a project; some moved, some without a hash."""
    n = F.col("n_chars")
    old = F.concat(F.lit("/old/"), "doc_id", F.lit(".txt"))
    here = F.concat(F.lit("/in/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    return hashed.where(F.col("lang").isin("en", "fr")).select(
        "doc_id",
        F.concat("doc_id", F.lit(".txt")).alias("filename"),
        F.create_map(F.lit("source"), F.when(n > 2000, old).otherwise(here)).alias("metadata"),
        F.when(~n.between(300, 600), F.col("hash")).alias("source_hash"),
    )


def incoming_files(hashed: DataFrame) -> DataFrame:
    return hashed.select(
        F.concat(F.lit("/in/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        F.col("hash").alias("source_hash"),
    )


IDENTITY = [
    ("ex", """SELECT doc_id, doc_id || '.txt' AS filename, CASE WHEN n_chars > 2000 THEN '/old/' || doc_id || '.txt'
        ELSE '/in/' || lang || '/' || doc_id || '.txt' END AS path,
        CASE WHEN n_chars NOT BETWEEN 300 AND 600 THEN sha256(text) END AS source_hash
        FROM documents WHERE lang IN ('en', 'fr')"""),
    ("inc", """SELECT sha256(text) AS source_hash, min('/in/' || lang || '/' || doc_id || '.txt') AS first_path,
        max('/in/' || lang || '/' || doc_id || '.txt') AS path FROM documents GROUP BY 1"""),
    ("known", """SELECT source_hash, min(doc_id) AS doc_id, arg_min(path, doc_id) AS path FROM ex
        WHERE source_hash IS NOT NULL GROUP BY 1"""),
    ("legacy", "SELECT filename, doc_id FROM ex WHERE source_hash IS NULL"),
    ("claims", r"""SELECT i.source_hash, l.doc_id FROM (
          SELECT *, row_number() OVER (PARTITION BY regexp_replace(first_path, '.*/', '') ORDER BY first_path) AS rn
          FROM inc WHERE source_hash NOT IN (SELECT source_hash FROM known)) i
        JOIN legacy l ON l.filename = regexp_replace(i.first_path, '.*/', '') WHERE rn = 1"""),
    ("judged", """SELECT i.source_hash, i.first_path, i.path, coalesce(k.doc_id, c.doc_id) AS doc_id,
        CASE WHEN k.doc_id IS NOT NULL THEN CASE WHEN k.path = i.path THEN 'unchanged' ELSE 'moved' END
             WHEN c.doc_id IS NOT NULL THEN 'backfilled' ELSE 'inserted' END AS action
        FROM inc i LEFT JOIN known k ON i.source_hash = k.source_hash LEFT JOIN claims c ON i.source_hash = c.source_hash"""),
    ("outcome", """SELECT source_hash, first_path, path, action,
        CASE WHEN action = 'inserted' THEN (SELECT max(doc_id) FROM ex) + row_number() OVER (PARTITION BY action ORDER BY source_hash)
             ELSE doc_id END AS doc_id FROM judged"""),
]


@query("b1_content_identity", extra=IDENTITY,
       sql="SELECT source_hash, first_path, path, action, doc_id FROM outcome")
def b1(t: Tables) -> DataFrame:
    hashed = hashed_texts(t)
    return documents.identify_documents(existing_documents(hashed), incoming_files(hashed)).select(
        "source_hash", "first_path", "path", "action", "doc_id"
    )


@query("b2_documents_after_ingest", extra=IDENTITY, sql=r"""
    SELECT e.doc_id, CASE WHEN o.action IS NULL THEN e.filename ELSE regexp_replace(o.path, '.*/', '') END AS filename,
           coalesce(e.source_hash, o.source_hash) AS source_hash,
           CASE WHEN o.action = 'moved' OR o.path <> o.first_path THEN o.path ELSE e.path END AS path
    FROM ex e LEFT JOIN outcome o ON e.doc_id = o.doc_id AND o.action <> 'inserted'
    UNION ALL SELECT doc_id, regexp_replace(path, '.*/', ''), source_hash, path FROM outcome WHERE action = 'inserted'""")
def b2(t: Tables) -> DataFrame:
    hashed = hashed_texts(t)
    existing, incoming = existing_documents(hashed), incoming_files(hashed)
    outcome = documents.identify_documents(existing, incoming)
    return documents.upsert_documents(existing, outcome, incoming).select(
        "doc_id", "filename", "source_hash", F.col("metadata")["source"].alias("path")
    )


@query("b3_failed_stubs", sql=r"""
    SELECT name AS filename, 'pdf' AS format, 'failed' AS status, 'bad ' || arg_min(lang, path) AS warning, min(path) AS path
    FROM (SELECT *, n_chars || '.PDF' AS name, '/in/' || lang || '/' || source || '/' || n_chars || '.PDF' AS path FROM documents)
    WHERE name NOT IN (SELECT n_chars || '.PDF' FROM documents WHERE lang = 'es') GROUP BY name""")
def b3(t: Tables) -> DataFrame:
    name = F.concat("n_chars", F.lit(".PDF"))
    d = t.given("documents")
    failures = d.select(
        F.concat(F.lit("/in/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"),
        F.concat(F.lit("bad "), "lang").alias("error"),
    )
    existing = d.where("lang = 'es'").select(name.alias("filename"))
    return documents.failed_stubs(failures, existing).select(
        "filename", "format", "status", F.get("warnings", F.lit(0)).alias("warning"),
        F.col("metadata")["source"].alias("path"),
    )


# ---------------------------------------------------------------- structure


@query("b4_markdown_headings", needs=["heads"],
       sql="SELECT doc_id, k, level, title, char_start, char_end FROM heads")
def b4(t: Tables) -> DataFrame:
    return t.markdown().select("doc_id", F.posexplode(structure.headings(F.col("full_text")))).select(
        "doc_id", (F.col("pos") + 1).alias("k"), "col.level", F.col("col.text").alias("title"),
        "col.char_start", "col.char_end",
    )


@query("b5_section_tree", needs=["sections"],
       sql="SELECT doc_id, k, array_to_string(path, ' > ') AS path, char_start, char_end FROM sections")
def b5(t: Tables) -> DataFrame:
    return structure.markdown_structure(t.markdown()).select("doc_id", F.posexplode(arrays.rows_of("sections"))).select(
        "doc_id", (F.col("pos") + 1).alias("k"), F.array_join("col.section_path", " > ").alias("path"),
        "col.char_start", "col.char_end",
    )


@query("b6_text_sections", needs=["docs"],
       sql="SELECT doc_id, doc_id::VARCHAR AS path, 0 AS char_start, length(full_text) AS char_end FROM docs")
def b6(t: Tables) -> DataFrame:
    return structure.with_structure(t.documents()).select("doc_id", F.explode(arrays.rows_of("sections")).alias("s")).select(
        "doc_id", joined("s.section_path").alias("path"), "s.char_start", "s.char_end"
    )


@query("b7_section_at_position", needs=["md", "sections"], extra=[("p", """
    SELECT doc_id, unnest(generate_series(0, length(full_text) + 50, 50)) AS pos FROM md""")], sql="""
    SELECT p.doc_id, p.pos, coalesce(array_to_string(arg_max(s.path, s.k), ' > '), '') AS path
    FROM p LEFT JOIN sections s ON p.doc_id = s.doc_id AND s.char_start <= p.pos AND p.pos < s.char_end
    GROUP BY p.doc_id, p.pos""")
def b7(t: Tables) -> DataFrame:
    """A probe every 50 characters, and one past the end."""
    probes = F.sequence(F.lit(0), F.length("full_text") + 50, F.lit(50))
    return probed(structure.markdown_structure(t.markdown()), F.col("sections"), probes)


def probed(d: DataFrame, sections: Column, probes: Column) -> DataFrame:
    runs = d.select("doc_id", F.explode(arrays.rows_of(structure.sections_of_positions(sections, probes))).alias("r"))
    return runs.select("doc_id", F.array_join("r.section_path", " > ").alias("path"), "r.positions").select(
        "doc_id", F.explode("positions").alias("pos"), "path").select("doc_id", "pos", "path")


@query("b7_overlapping_sections", needs=["md", "sections"], extra=[("p", """
    SELECT doc_id, unnest(generate_series(0, length(full_text) + 50, 70)) AS pos FROM md""")], sql="""
    SELECT p.doc_id, p.pos, coalesce(array_to_string(arg_max(s.path, s.k), ' > '), '') AS path
    FROM p LEFT JOIN sections s ON p.doc_id = s.doc_id AND s.char_start <= p.pos
      AND p.pos < CASE WHEN s.k % 3 = 1 THEN s.char_end + 900 WHEN s.k % 3 = 2 THEN s.char_start + 9 ELSE s.char_end END
    GROUP BY p.doc_id, p.pos""")
def b7_overlapping(t: Tables) -> DataFrame:
    """Every third section reaches far into the next ones, every third one ends early."""
    reach = lambda s, i: s.withField("char_end", F.when(i % 3 == 0, s["char_end"] + 900).when(
        i % 3 == 1, s["char_start"] + 9).otherwise(s["char_end"]))
    probes = F.sequence(F.lit(0), F.length("full_text") + 50, F.lit(70))
    return probed(structure.markdown_structure(t.markdown()), F.transform("sections", reach), probes)


@query("b8_stripped_markdown", needs=["md"], extra=[
    ("r1", r"SELECT doc_id, regexp_replace(full_text, '(?m)^#{1,6}\s+', '', 'g') AS x FROM md"),
    ("r2", r"SELECT doc_id, regexp_replace(x, '\*{1,3}(.+?)\*{1,3}', '\1', 'g') AS x FROM r1"),
    ("r3", r"SELECT doc_id, regexp_replace(x, '_{1,3}(.+?)_{1,3}', '\1', 'g') AS x FROM r2"),
    ("r4", r"SELECT doc_id, regexp_replace(x, '\[(.+?)\]\(.+?\)', '\1', 'g') AS x FROM r3"),
    ("r5", r"SELECT doc_id, regexp_replace(x, '(?s)```.*?```', '', 'g') AS x FROM r4"),
    ("r6", r"SELECT doc_id, trim(regexp_replace(x, '`(.+?)`', '\1', 'g'), ' ' || chr(10)) AS x FROM r5"),
], sql="SELECT doc_id, length(x) AS clean_text_length, sha256(x) AS clean_hash FROM r6")
def b8(t: Tables) -> DataFrame:
    clean = t.markdown().select("doc_id", structure.strip_markdown(F.col("full_text")).alias("x"))
    return clean.select("doc_id", F.length("x").alias("clean_text_length"), sha("x").alias("clean_hash"))


@query("b9_document_info", needs=["md", "heads"], sql="""
    SELECT m.doc_id, m.filename, length(full_text) AS n_chars, coalesce(n, 0) AS n_headings, 0 AS n_pages, 'md' AS format,
           'default' AS backend, 0 AS n_tables, 0 AS n_figures, 0 AS n_warnings
    FROM md m LEFT JOIN (SELECT doc_id, count(*) AS n FROM heads GROUP BY 1) h ON m.doc_id = h.doc_id""")
def b9(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    d = structure.markdown_structure(t.markdown()).withColumns({
        "pages": none, "warnings": none, "metadata": F.create_map().cast("map<string,string>"),
    })
    return documents.document_info(d)


@query("b10_ingest_counts", needs=["docs"], sql="""
    SELECT count(*) FILTER (status <> 'failed') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed FROM docs""")
def b10(t: Tables) -> DataFrame:
    return documents.ingest_counts(t.documents())


@query("b11_first_document_by_hash", needs=["docs"], sql="""
    SELECT source_hash, min(doc_id) AS doc_id, count(*) AS n_documents FROM docs GROUP BY source_hash""")
def b11(t: Tables) -> DataFrame:
    return documents.first_by(t.documents(), "source_hash")


@query("b11_document_by_id", needs=["docs"], sql="SELECT doc_id, filename, source_hash FROM docs WHERE doc_id = (SELECT max(doc_id) FROM docs)")
def b11_id(t: Tables) -> DataFrame:
    last = t.given("documents").agg(F.max("doc_id").alias("d")).first().d
    return documents.find_documents(t.documents(), doc_id=last).select("doc_id", "filename", "source_hash")


@query("b11_first_document_by_name", needs=["docs"], sql="SELECT filename, min(doc_id) AS doc_id, count(*) AS n_documents FROM docs GROUP BY filename")
def b11_name(t: Tables) -> DataFrame:
    return documents.first_by(t.documents(), "filename")


@query("a10_stored_tables", needs=["docs", "runs", "chunks", "labels_e", "reviews", "embs"], sql="""
    SELECT 'documents' AS table_name, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM docs
    UNION ALL SELECT 'chunking_runs', count(*), sum(run_id)::BIGINT FROM runs
    UNION ALL SELECT 'chunks', count(*), sum(chunk_id)::BIGINT FROM chunks
    UNION ALL SELECT 'labels', count(*), sum(label_id)::BIGINT FROM labels_e
    UNION ALL SELECT 'human_reviews', count(*), sum(review_id)::BIGINT FROM reviews
    UNION ALL SELECT 'chunk_embeddings', count(*), sum(chunk_id)::BIGINT FROM embs
    UNION ALL SELECT 'audit_events', count(*), sum(event_id)::BIGINT FROM events
    UNION ALL SELECT 'rubric_versions', count(*), sum(ascii(lang) * 256 + ascii(substring(lang, 2, 1)))::BIGINT
      FROM (SELECT DISTINCT lang FROM documents)""")
def a10_tables(t: Tables) -> DataFrame:
    """All eight tables written to the shared folder and read back."""
    keys = {"documents": "doc_id", "chunking_runs": "run_id", "chunks": "chunk_id", "labels": "label_id",
            "human_reviews": "review_id", "chunk_embeddings": "chunk_id", "audit_events": "event_id",
            "rubric_versions": "rubric_id"}
    every = {**t.tables(), "audit_events": t.audit(), "rubric_versions": t.rubrics()}
    out = None
    for name, key in keys.items():
        path = shared_folder(t.spark, name)
        store.append_table(every[name], path, name, buckets=8)
        one = store.read_table(t.spark, path, name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(key).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a10_replaced_buckets", needs=["chunks"], sql="""
    SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN reverse(text) ELSE text END AS text FROM chunks""")
def a10_replaced(t: Tables) -> DataFrame:
    """Every fifth document's chunks rewritten: only the buckets that hold them are read and replaced."""
    path = shared_folder(t.spark, "chunks")
    store.append_table(t.chunks(), path, "chunks", buckets=16)
    hit = store.touched_buckets(t.given("documents").where("doc_id % 5 = 0"), buckets=16)
    change = F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))
    # Derived from the source, not from the buckets that it replaces.
    fresh = t.chunks().withColumn("text", change).where(store.doc_bucket(16).isin(hit))
    store.replace_buckets(fresh, path, "chunks", buckets=16)
    return store.read_table(t.spark, path, "chunks").select("chunk_id", "text")


@query("b12_document_status", needs=["docs"], sql="""
    SELECT d.doc_id, d.filename, coalesce(e.status, d.status) AS status FROM docs d LEFT JOIN
      (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1) e ON d.doc_id = e.doc_id""")
def b12(t: Tables) -> DataFrame:
    """User events as status events of the document with the user's number."""
    events = t.given("events").select(
        F.col("user_id").alias("doc_id"), "event_id", F.col("event_type").alias("status")
    )
    return lineage.apply_status(t.documents().select("doc_id", "filename", "status"), events)


@query("b13_converted_files", needs=["md", "heads"], sql="""
    SELECT '/in/' || m.doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.pdf' ELSE '.markdown' END AS path,
           CASE lang WHEN 'en' THEN 'md' WHEN 'es' THEN 'md' WHEN 'fr' THEN 'txt' END AS format,
           CASE WHEN lang = 'de' THEN 'unsupported format: .pdf' END AS error,
           CASE WHEN lang IN ('en', 'es') THEN coalesce(n, 0) WHEN lang = 'fr' THEN 0 END AS n_headings,
           CASE WHEN lang IN ('en', 'es') THEN greatest(coalesce(n, 0), 1) WHEN lang = 'fr' THEN 1 END AS n_sections,
           CASE WHEN lang <> 'de' THEN sha256(full_text) END AS source_hash
    FROM md m LEFT JOIN (SELECT doc_id, count(*) AS n FROM heads GROUP BY 1) h ON m.doc_id = h.doc_id""")
def b13(t: Tables) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".TXT").when(
        F.col("lang") == "de", ".pdf").otherwise(".markdown")
    src = t.markdown().select(
        F.concat(F.lit("/in/"), "doc_id", ext).alias("path"), F.encode("full_text", "UTF-8").alias("content")
    )
    good, bad = files.convert_files(src)
    return good.select(
        "path", "format", F.lit(None).cast("string").alias("error"), F.size("headings").alias("n_headings"),
        F.size("sections").alias("n_sections"), "source_hash",
    ).unionByName(bad, allowMissingColumns=True)


# ------------------------------------------------------------ text functions


@query("i1_token_estimate", sql="SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def i1(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("i2_counted_tokens", sql="""
    SELECT doc_id, len(string_split(text, ' ')) AS tokens FROM documents""")
def i2(t: Tables) -> DataFrame:
    """With a caller's counter: words between single spaces."""
    words = lambda texts: F.transform(texts, lambda x: F.size(F.split(x, " ", -1)))
    return t.given("documents").select("doc_id", text.count_tokens(F.col("text"), words).alias("tokens"))


@query("i3_normalized_text", sql=r"""
    SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM documents""")
def i3(t: Tables) -> DataFrame:
    return t.given("documents").select(
        "doc_id", sha(text.normalize_whitespace(F.col("text"))).alias("text_hash")
    )


@query("i4_truncated_text", sql="""
    SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 197) || '...' ELSE text END AS short FROM documents""")
def i4(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("i5_first_sentence", sql=r"""
    SELECT doc_id, CASE WHEN regexp_extract(text, '^([^\n]*?[.!?])\s', 1) <> '' THEN regexp_extract(text, '^([^\n]*?[.!?])\s', 1)
      ELSE substring(text, 1, 200) END AS sentence FROM documents""")
def i5(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("i6_text_hash", sql="SELECT doc_id, sha256(text) AS text_hash FROM documents")
def i6(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query("i7_unfenced_text", sql=r"""
    SELECT doc_id, sha256(CASE lang WHEN 'es' THEN '~~~' || chr(10) || trim(text, ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END) AS text_hash
    FROM documents""")
def i7(t: Tables) -> DataFrame:
    """Texts inside fences of several kinds; Spanish ones in a fence that is none."""
    fenced = lambda a, b: F.concat(F.lit(a), "text", F.lit(b))
    body = (
        F.when(F.col("lang") == "en", fenced("```json\n", "\n```"))
        .when(F.col("lang") == "fr", fenced(" ``` ", " ```\n"))
        .when(F.col("lang") == "es", fenced("~~~\n", ""))
        .otherwise(F.col("text"))
    )
    return t.given("documents").select("doc_id", sha(text.strip_fences(body)).alias("text_hash"))


@query("i8_neighbour_cosine", sql=f"""
    SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def i8(t: Tables) -> DataFrame:
    e = t.given("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity")
    )


@query("i9_dnb_labels", needs=["labels_e"], sql=f"""
    SELECT label_id, len(predicted_categories) = 0 OR predicted_categories = ['{DNB}'] AS is_dnb FROM labels_e""")
def i9(t: Tables) -> DataFrame:
    return t.labels().select("label_id", text.is_dnb(F.col("predicted_categories")).alias("is_dnb"))


@query("g2_chunk_uuid", needs=["chunks"], extra=[("h", f"""
    SELECT chunk_id, sha1(unhex('{PROJECT_UUID.replace("-", "")}') || encode(chunk_id::VARCHAR)) AS x FROM chunks""")], sql="""
    SELECT chunk_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' ||
      translate(substr(x, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS chunk_uuid FROM h""")
def g2(t: Tables) -> DataFrame:
    return t.chunks().select(
        "chunk_id", uuid5(PROJECT_UUID, F.col("chunk_id").cast("string")).alias("chunk_uuid")
    )
